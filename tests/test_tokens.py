from pyspark.sql import functions as F

from logsieve.operators import relations
from logsieve.plans import lint
from logsieve.plans.registry import events_log
from tests.helpers import LOG_SCHEMA, found, make_log


def toks(spark, sql, dialect="generic"):
    work = lint.prepare(make_log(spark, [(dialect, sql)]))
    return [(r.tok, r.kind) for r in work.tokens.select("pos", "tok", "kind").orderBy("pos").collect()]


def test_literals_and_names(spark):
    assert toks(spark, "SELECT 'it''s', '', '''q''', \"N m\".c, `x`, .5e-3, 1.5, t.* FROM a.b") == [
        ("SELECT", "path"), ("'it''s'", "str"), (",", "op"), ("''", "str"), (",", "op"),
        ("'''q'''", "str"), (",", "op"), ('"N m".c', "path"), (",", "op"), ("`x`", "path"), (",", "op"),
        (".5e-3", "num"), (",", "op"), ("1.5", "num"), (",", "op"), ("t.*", "path"), ("FROM", "path"),
        ("a.b", "path"),
    ]


def test_names_of_many_parts(spark):
    deep = ".".join("abcdefghijkl")
    assert toks(spark, f"SELECT {deep}, {deep}.* FROM t")[1:4] == [(deep, "path"), (",", "op"), (f"{deep}.*", "path")]
    assert toks(spark, f"SELECT {'[x y].' * 11}z FROM t", "MSSQL")[1] == ("[x y]." * 11 + "z", "path")
    very = ".".join(["part"] * 20_000)
    assert toks(spark, f"SELECT {very} FROM t")[1] == (very, "path")
    assert found(spark, [f"SELECT a FROM t WHERE {deep} = {deep} LIMIT 1"]) == [["L015"]]


def test_dialects(spark):
    assert toks(spark, 'SELECT "a"', "MySQL")[1] == ('"a"', "str")
    assert toks(spark, 'SELECT "a"', "oracle")[1] == ('"a"', "path")
    assert toks(spark, "SELECT 'it\\'s'", "bigquery")[1] == ("'it\\'s'", "str")
    assert toks(spark, "SELECT [a b].c", "MSSQL")[1] == ("[a b].c", "path")


def test_marks_count_where_they_stand(spark):
    """Hand-written tokens of each dialect."""
    def words(sql, dialect):
        return [t for t, _ in toks(spark, sql, dialect)]

    assert words("SELECT $a$ it's $$ $a$, E'it\\'s' -- x'", "postgresql") == ["SELECT", "$a$ it's $$ $a$", ",", "E'it\\'s'"]
    assert words("SELECT a--1, \"it's\" # it's", "mysql") == ["SELECT", "a", "-", "-", "1", ",", "\"it's\""]
    assert words("SELECT '''it's''', \"\"\"a \"b\" c\"\"\"", "bigquery") == ["SELECT", "'''it's'''", ",", "\"\"\"a \"b\" c\"\"\""]
    assert words("SELECT [it's]]x].[b c] FROM #tmp", "mssql") == ["SELECT", "[it's]]x].[b c]", "FROM", "#tmp"]
    assert words("SELECT `it's` . \"a \"\" b\" . c", "sqlite") == ["SELECT", "`it's`.\"a \"\" b\".c"]
    assert words("SELECT a - b # c", "ansi") == ["SELECT", "a", "-", "b", "#", "c"]


def test_comments_in_comments_of_any_depth(spark):
    deep = "SELECT 'a /*' /* " + "/* ' \" -- " * 3000 + "*/ " * 3000 + " */ , b /* c */ FROM t -- /* /*\nLIMIT 1"
    assert [t for t, _ in toks(spark, deep)] == ["SELECT", "'a /*'", ",", "b", "FROM", "t", "LIMIT", "1"]
    assert found(spark, ["SELECT a FROM t " + "/* " * 50 + "*/ " * 49 + "LIMIT 1"]) == [[]]
    assert lint.stats(make_log(spark, ["SELECT a /* /* */ FROM t"])).first().error == "unterminated comment"


def test_operands_of_any_length(spark):
    sql = "SELECT a FROM t WHERE NOT f(a, b) + 2 * (c - 1) >= CASE WHEN d = 1 THEN 2 END AND x BETWEEN 1 AND 2 AND y = 3 OR z <> -w"
    work = lint.prepare(make_log(spark, [sql]))
    got = [(r.left_operand, r.op, r.right_operand) for r in relations.comparisons(work.tokens).orderBy("pos").collect()]
    assert got == [
        ("f ( a , b ) + 2 * ( c - 1 )", ">=", "CASE WHEN d = 1 THEN 2 END"), ("d", "=", "1"), ("y", "=", "3"), ("z", "<>", "- w"),
    ]
    long = " + ".join(f"c{i}" for i in range(4000))
    assert found(spark, [f"SELECT a FROM t JOIN u ON {long} = {long} LIMIT 1", f"SELECT a FROM t JOIN u ON {long} = {long} + 1 LIMIT 1"]) == [
        ["L009", "L016"], ["L009"],
    ]


def test_long_literals_and_comments(spark):
    long = "SELECT '" + "a''b" * 50_000 + "' /* " + "* x\n" * 50_000 + " */ FROM t LIMIT 1"
    assert found(spark, [long]) == [[]]


def test_deep_nesting(spark):
    depth = 400
    sql = "SELECT a FROM t WHERE a = " + "(SELECT MAX(a) FROM t WHERE a = " * depth + "1" + ")" * depth + " LIMIT 1"
    assert found(spark, [sql]) == [["L010"] * depth]


def test_screen(spark):
    sqls = ["SELECT 1", "THIS IS NOT SQL !!!", "SELECT (1", "SELECT 1)", "SELECT 'a", "SELECT 1 /* x",
            "SELECT a FROM t WHERE", ";;", "-- only a comment", "SELECT 1; FOO"]
    rows = lint.stats(make_log(spark, sqls)).orderBy("query_id").collect()
    assert [r.error for r in rows] == [
        None, "not a statement", "unbalanced parenthesis", "unbalanced parenthesis", "unterminated quote",
        "unterminated comment", "incomplete statement", None, None, "not a statement",
    ]
    assert [r.statement_count for r in rows] == [1, 0, 0, 0, 0, 0, 0, 0, 0, 0]


def test_stats(spark):
    sql = ("SELECT c.c_name, o.o_orderkey FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey "
           "WHERE o.o_orderkey IN (SELECT l_orderkey FROM lineitem) ORDER BY o.o_orderkey LIMIT 5")  # fmt: skip
    r = lint.stats(make_log(spark, [sql])).first()
    counters = (r.statement_count, r.table_count, r.join_count, r.subquery_count, r.column_count)
    assert counters == (1, 3, 1, 1, 3)
    assert (r.has_where, r.has_group_by, r.has_order_by, r.has_limit) == (True, False, True, True)


def test_format(spark):
    sql = "select a,count( * )  from t left outer join u q on q.a=t.a where x='select  from' union select b,c from v -- z"
    work = lint.prepare(make_log(spark, [sql]))
    assert relations.normalised(work.tokens).first().formatted == (
        "SELECT a, count(*)\nFROM t\n  LEFT OUTER JOIN u q\n    ON q.a = t.a\nWHERE x = 'select  from'"
        "\nUNION\nSELECT b, c\nFROM v"
    )


def test_blank_texts_are_dropped(spark):
    assert lint.stats(make_log(spark, ["  \n\t ", "SELECT 1"])).count() == 1


def test_repeated_and_null_query_ids_lose_no_finding(spark):
    rows = [(7, None, 1, "generic", "SELECT * FROM a"), (7, None, 1, "generic", "DELETE FROM b"),
            (None, None, 1, "generic", "DROP TABLE c"), (None, None, 1, "generic", "DELETE FROM b")]
    log = spark.createDataFrame(rows, LOG_SCHEMA)
    found = sorted((str(r.query_id), r.rule_id) for r in lint.lint(log).collect())
    assert {f for f in found if f[1] in ("L001", "L002", "L007")} == {("7", "L001"), ("7", "L002"), ("None", "L002"), ("None", "L007")}
    assert lint.stats(log).count() == 4


def test_unknown_table_is_not_clean_with_a_catalog(spark):
    log = make_log(spark, ["SELECT x FROM no_such_table LIMIT 5", "SELECT x FROM known LIMIT 5"])
    schema = "table_name string, column_name string, data_type string, type_family string, is_indexed boolean"
    catalog = spark.createDataFrame([("known", "x", "int", "numeric", False)], schema)
    assert [r.query_id for r in lint.clean_queries(log, catalog).collect()] == [1]
    assert lint.clean_queries(log).count() == 2


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_clean_queries_make_their_tokens_once(spark):
    sqls = ["SELECT x FROM known LIMIT 5", "SELECT x FROM (known", "NOT SQL", "-- nothing", "SELECT x FROM known", "DELETE FROM known", "SELECT 'x"]
    log = make_log(spark, sqls)
    schema = "table_name string, column_name string, data_type string, type_family string, is_indexed boolean"
    catalog = spark.createDataFrame([("known", "x", "int", "numeric", False)], schema)
    for cat in (catalog, None):
        clean = lint.clean_queries(log, cat)
        assert sorted(r.query_id for r in clean.collect()) == [0, 3]
        assert _plan(clean).count("posexplode") == 1


def test_names_are_looked_up_in_a_stage_of_their_own(spark):
    schema = "table_name string, column_name string, data_type string, type_family string, is_indexed boolean"
    catalog = spark.createDataFrame([("known", "x", "int", "numeric", False)], schema)
    work = lint.prepare(make_log(spark, ["SELECT x FROM known"]))
    cuts = [_plan(df).count("RepartitionByExpression") for df in (work.tokens, lint.findings(work, catalog))]
    assert cuts[1] == cuts[0] + 1


def test_hot_text_is_salted(spark, sf_dir):
    from logsieve.operators.skew import attach_to_log

    log = events_log(spark, sf_dir)
    work = lint.prepare(log.withColumn("sql", F.when(F.col("query_id") % 3 == 0, "DELETE FROM t").otherwise(F.col("sql"))))
    per_text = lint.findings(work, only=["L002"])
    keyed = work.log.select("query_id", "text_id")
    plain = attach_to_log(keyed, work.texts, per_text)
    salted = attach_to_log(keyed, work.texts, per_text, rows_per_salt=7)
    cols = ["query_id", "pos", "rule_id"]
    assert sorted(plain.select(*cols).collect()) == sorted(salted.select(*cols).collect())
    assert plain.count() > 300


def test_one_exchange_for_all_tokens(spark, sf_dir):
    work = lint.prepare(events_log(spark, sf_dir))
    plan = lint.token_findings(work.tokens)._jdf.queryExecution().executedPlan().toString()
    # one to combine equal texts, one to spread them; none for the windows
    assert plan.count("Exchange hashpartitioning") == 2
    assert "ArrowEval" not in plan and "BatchEvalPython" not in plan


def test_token_stages_are_small(spark):
    """Windows are counted, as each takes several generated classes and a worker keeps a hundred."""
    work = lint.prepare(make_log(spark, ["SELECT a FROM t WHERE a = a LIMIT 1"]))
    for made in (work.tokens, lint.findings(work)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Window ") >= 10
        assert max(stage.count("Window ") for stage in plan.split("Exchange ")) <= 7
