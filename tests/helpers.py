import datetime

from logsieve.plans import lint

LOG_SCHEMA = "query_id bigint, ts timestamp, user_id bigint, dialect string, sql string"


def make_log(spark, sqls, dialect="generic"):
    now = datetime.datetime(2024, 1, 1)
    rows = [
        (i, now, 1, *(s if isinstance(s, tuple) else (dialect, s))) for i, s in enumerate(sqls)
    ]
    return spark.createDataFrame(rows, LOG_SCHEMA)


def found(spark, sqls, catalog=None, parity=False, dialect="generic"):
    """Rule ids found per text, sorted, as a list of lists."""
    rows = lint.lint(make_log(spark, sqls, dialect), catalog, parity).collect()
    out = [[] for _ in sqls]
    for r in rows:
        out[r.query_id].append(r.rule_id)
    return [sorted(x) for x in out]
