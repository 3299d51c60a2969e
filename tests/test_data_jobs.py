import datetime
import random

import pytest
from pyspark.sql import functions as F

from logsieve.operators import conformance, flows, outputs, ranges, sketches
from logsieve.plans import incremental, lint
from logsieve.sources import catalog as catalogs
from tests.helpers import make_log


@pytest.mark.parametrize("number", [0, 3, 40, 99, 100, 1000])
def test_page_of_a_total_order(spark, number):
    rnd = random.Random(5)
    # one value fills a third of the first column, NULLs another part
    rows = [(rnd.choice([None, "x", "x", str(i % 7)]), rnd.choice([None, 1.5, float(i % 11)]), i) for i in range(500)]
    df = spark.createDataFrame(rows, "a string, b double, c int").repartition(5)
    got = ranges.page(df, [("a", False), ("b", True), ("c", False)], 5, number, at_once=10).collect()
    key = lambda r: ((r[0] is None, [-ord(x) for x in r[0] or ""]), (r[1] is not None, r[1] or 0), -r[2])
    assert [(r.a, r.b, r.c) for r in got] == sorted(rows, key=key)[5 * number : 5 * number + 5]
    assert all(r.all_rows == 500 for r in got)


def test_page_of_equal_rows_and_of_none(spark):
    same = spark.range(50).select(F.lit(1).alias("k"))
    assert ranges.page(same, [("k", True)], 4, 12, at_once=10).count() == 2
    assert ranges.page(same.where("k > 1"), [("k", True)], 4, 0).count() == 0


def test_zone_map(spark, tmp_path):
    rows = spark.range(0, 100, 1, 1).select(F.when(F.col("id") >= 10, F.col("id")).alias("k"))
    rows.write.parquet(str(tmp_path / "t"))
    zones = ranges.zones(spark.read.parquet(str(tmp_path / "t")), "k", 10)
    assert zones.count() == 10
    # the first block holds NULLs only and can always be skipped
    got = ranges.skipped(zones, F.lit(25), F.lit(40)).first()
    assert (got.blocks, got.skipped_blocks, got.skipped_rows) == (10, 8, 80)


def edges_of(spark, *sqls):
    found = flows.flow_edges(lint.prepare(make_log(spark, sqls)).tokens)
    return sorted((r.target, r.source) for r in found.collect())


def test_flow_edges(spark):
    assert edges_of(spark, "CREATE TABLE IF NOT EXISTS S.`T` AS SELECT * FROM A JOIN (SELECT * FROM b) x ON x.i = a.i") == [("s.t", "a"), ("s.t", "b")]
    # a name of a WITH list is no table, but inside its own body it is one
    assert edges_of(spark, "WITH c AS (SELECT * FROM c) INSERT INTO t SELECT * FROM c") == [("t", "c")]
    assert edges_of(spark, "CREATE VIEW v AS WITH c AS (SELECT * FROM a), d AS (SELECT * FROM c) SELECT * FROM d") == [("v", "a")]
    assert edges_of(spark, "INSERT OVERWRITE TABLE t SELECT * FROM a; SELECT * FROM b", "INSERT INTO t VALUES (1)", "CREATE TABLE t (a INT)", "SELECT * FROM z") == [("t", "a")]


def test_reach_ends_on_cycles(spark, tmp_path):
    rows = [("b", "a"), ("c", "b"), ("a", "c"), ("d", "c"), ("d", "a"), ("d", "a"), (None, "a"), ("e", "e")]
    got = flows.reach(spark.createDataFrame(rows, "target string, source string"), str(tmp_path / "reach"))
    want = {("b", "a", 1), ("b", "c", 2), ("b", "b", 3), ("c", "b", 1), ("c", "a", 2), ("c", "c", 3), ("a", "c", 1), ("a", "b", 2), ("a", "a", 3),
            ("d", "c", 1), ("d", "a", 1), ("d", "b", 2), ("e", "e", 1)}
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    assert flows.reach(spark.createDataFrame([], "target string, source string"), str(tmp_path / "none")).count() == 0


def test_reach_makes_pairs_of_end_tables_once(spark, tmp_path, monkeypatch):
    """Tables that nothing is filled from are not walked: what the rounds write does not grow with their pairs."""
    monkeypatch.setattr(flows, "SPREAD", 4)
    n = 12
    rows = [("hub", f"in{i}") for i in range(n)] + [(f"out{i}", "hub") for i in range(n)]
    rows += [("in0", "hub"), ("out0", "in1"), ("out0", "in0"), ("far", "out1"), ("far", "lone"), ("in2", "in2")]
    folder = tmp_path / "ends"
    got = flows.reach(spark.createDataFrame(rows, "target string, source string"), str(folder))
    sources, want = {}, set()
    for target, source in rows:
        sources.setdefault(target, set()).add(source)
    for table in sources:
        seen, at, distance = set(), sources[table], 1
        while at:
            want |= {(table, a, distance) for a in at}
            seen |= at
            at, distance = {s for a in at for s in sources.get(a, ())} - seen, distance + 1
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    assert [(f.name, f.dataType.simpleString()) for f in got.schema] == [("table", "string"), ("ancestor", "string"), ("distance", "int")]
    walked = {r["table"] for r in spark.read.parquet(str(folder / "rounds" / "*")).select("table").distinct().collect()}
    assert walked == {"hub", "in0", "in2", "out1"}


def test_ledger(spark, tmp_path):
    folder = str(tmp_path / "ledger")
    one, two, three = "SELECT * FROM t LIMIT 1", "DELETE FROM t", "DROP TABLE t"
    found = lambda log, cat=None: sorted((r.query_id, r.rule_id) for r in incremental.findings_of(log, folder, cat).collect())
    texts = lambda: {r.batch_id: r.texts for r in incremental.batches(spark, folder).collect()}
    incremental.update(make_log(spark, [one, two, one]), folder, 0)
    log = make_log(spark, [one, two, one, three])
    incremental.update(log, folder, 1)
    assert texts() == {0: 2, 1: 1}
    want = [(0, "L001"), (1, "L002"), (2, "L001"), (3, "L007")]
    assert found(log) == want
    # a repeated batch replaces its own rows and takes none of another's
    incremental.update(make_log(spark, [one, two, one]), folder, 0)
    incremental.update(log, folder, 2)
    assert texts() == {0: 2, 1: 1} and found(log) == want
    # findings of a batch that did not end do not count
    lost = incremental.known_findings(spark, folder).withColumn("version", F.lit(incremental.RULES_VERSION))
    lost.write.parquet(f"{folder}/found/batch_id=7")
    assert found(log) == want
    # another catalog makes every text unseen
    cat = catalogs.catalog_from_ddl(spark.createDataFrame([(1, "generic", "CREATE TABLE t (a INT)")], "ddl_id bigint, dialect string, sql string"))
    incremental.update(log, folder, 3, cat)
    assert texts() == {0: 2, 1: 1, 3: 3} and found(log) == want
    plain = sorted((r.query_id, r.rule_id) for r in lint.lint(log, cat).collect())
    assert found(log, cat) == plain


def test_conformance(spark):
    ddl = spark.createDataFrame([(1, "generic", "CREATE TABLE t (A INT PRIMARY KEY, b INT, c VARCHAR(3), gone DATE)")], "ddl_id bigint, dialect string, sql string")
    df = spark.createDataFrame([(1, 1.0, "x", [1]), (None, 2.5, None, [2])], "a int, B double, c string, more array<int>")
    got = {r.column_name: tuple(r)[2:] for r in conformance.conformance({"T": df}, catalogs.catalog_from_ddl(ddl)).collect()}
    assert got == {
        "a": ("int", "int", 2, 1, 1, "nulls"), "b": ("int", "double", 2, 0, 1, "type"), "c": ("string", "string", 2, 1, 1, "same"),
        "gone": ("date", None, None, None, None, "missing"), "more": (None, "array<int>", 2, 0, None, "extra"),
    }
    assert {r.rows for r in conformance.column_counts({"t": df.where("a > 9")}).collect()} == {0}


def test_json_fields(spark):
    rows = [('{"a": 1, "b": {"c": "x"}}',), ('{"a": "1"}',), ("[1]",), ("{bad",), (None,), ("{}",)]
    got = {(r.field, r.data_type): r["values"] for r in conformance.json_fields(spark.createDataFrame(rows, "j string"), "j").collect()}
    assert got == {("a", "BIGINT"): 1, ("a", "STRING"): 1, ("b", "OBJECT<c: STRING>"): 1, (None, "ARRAY<BIGINT>"): 1, (None, "invalid"): 1}


def test_sketches_are_kept_per_day(spark, tmp_path):
    folder = str(tmp_path / "profiles")
    day = lambda d: datetime.date(2024, 1, d)
    rows = [(day(1 + i % 3), float(i % 1000) if i % 10 else None, f"v{i % 700}") for i in range(6000)]
    df = spark.createDataFrame(rows, "d date, x double, s string")
    for d in (1, 2, 3, 2):  # the second day twice: replaced, not added
        sketches.store(sketches.by_day(df.where(F.col("d") == F.lit(day(d))), F.col("d"), ["x", "s"]), folder)
    got = {r.column_name: r for r in sketches.merged(spark.read.parquet(folder)).collect()}
    assert (got["x"].rows, got["x"].nulls, got["s"].nulls) == (6000, 600, 0)
    assert abs(got["s"].distinct_estimate - 700) < 35 and abs(got["x"].distinct_estimate - 900) < 45
    assert abs(got["x"].median - 500) < 30 and abs(got["x"].p99 - 990) < 15 and got["s"].median is None
    held = {r.column_name: r for r in sketches.checked(sketches.merged(spark.read.parquet(folder)), df, ["x", "s"]).collect()}
    assert held["x"].distinct_close and held["x"].median_close and held["s"].median_close is None and held["s"].distinct_values == 700
    assert not sketches.checked(sketches.merged(spark.read.parquet(folder)).withColumn("median", F.lit(1.0)), df, ["x"]).first().median_close


def test_records_survive_a_second_run_and_bad_lines(spark, tmp_path):
    folder = str(tmp_path / "records")
    records = lint.analyse(make_log(spark, ["SELECT * FROM t", "SELECT 'a\nb' FROM t LIMIT 1"]))
    for batch in ("one", "two", "one"):
        outputs.write_records(records, folder, batch)
    back = outputs.read_records(spark, folder, records.schema)
    assert sorted(back.groupBy("batch").count().collect()) == [("one", 2), ("two", 2)]
    plain = lambda df: sorted(df.select("text_id", "formatted_sql", "lint_issues", "stats").collect())
    assert plain(back.where("batch = 'one'")) == plain(records)
    with open(f"{folder}/batch=two/part-bad.txt", "w") as f:
        f.write("no record\n")
    assert [r.bad_line for r in outputs.read_records(spark, folder, records.schema).where("bad_line IS NOT NULL").collect()] == ["no record"]


def test_roundtrip_analyses_once(spark, tmp_path, monkeypatch):
    """Both writes read the stored records, not the events."""
    from logsieve.plans import registry

    folder = str(tmp_path)
    rows = [(i, datetime.datetime(2024, 1, 1), i % 3) for i in (0, 1, 1, 50, 56)]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint").write.parquet(f"{folder}/events.parquet")
    monkeypatch.setattr(registry, "TABLES", ["events"])
    read, write = [], registry.outputs.write_records

    def noted(records, *args):
        read.extend(records.inputFiles())
        write(records, *args)

    monkeypatch.setattr(registry.outputs, "write_records", noted)
    back = registry.record_roundtrip(spark, folder).collect()
    assert read and not any("events.parquet" in f for f in read)
    assert sorted((r.text_id, r.copies, r.uses, r.bad_lines) for r in back) == [(0, 1, 1, 0), (1, 1, 2, 0), (50, 1, 1, 0), (56, 1, 1, 0)]


def test_records_read_the_tokens_once(spark):
    schema = "table_name string, column_name string, data_type string, type_family string, is_indexed boolean"
    catalog = spark.createDataFrame([("known", "x", "int", "numeric", False)], schema)
    sqls = ["SELECT * FROM known", "select y from known where x = 'a,b' limit 1", "NOT SQL", "-- nothing", "SELECT 1; DELETE FROM known"]
    log = make_log(spark, [*sqls, sqls[0]])
    for cat in (catalog, None):
        records = lint.analyse(log, cat)
        assert records._jdf.queryExecution().optimizedPlan().toString().count("posexplode") == 1
        got = {r.first_query: r for r in records.collect()}
        assert sorted(got) == [0, 1, 2, 3, 4] and [got[i].uses for i in range(5)] == [2, 1, 1, 1, 1]
        assert [got[i].error for i in range(5)] == [None, None, "not a statement", None, None]
        assert got[1].formatted_sql == "SELECT y\nFROM known\nWHERE x = 'a,b'\nLIMIT 1" and got[2].formatted_sql == got[3].formatted_sql == ""
        assert (got[4].stats.statement_count, got[1].stats.has_where, got[0].stats.column_count) == (2, True, 1)
        assert ("L020" in [i.rule_id for i in got[1].lint_issues]) == (cat is not None) and got[2].lint_issues == []
        assert "L001" in [i.rule_id for i in got[0].lint_issues] and "L002" in [i.rule_id for i in got[4].lint_issues]


def test_records_in_turns_are_the_same(spark, tmp_path):
    log = make_log(spark, [f"SELECT * FROM t{i % 6}" for i in range(9)] + ["NOT SQL"])
    plain = lambda df: sorted(df.select("text_id", "uses", "formatted_sql", "lint_issues", "stats").collect())
    whole, parts = lint.analysed(log, f"{tmp_path}/one"), lint.analysed(log, f"{tmp_path}/two", most=3)
    assert plain(whole) == plain(parts) == plain(lint.analyse(log))
    assert len({f.rsplit("/", 2)[1] for f in parts.inputFiles()}) == 3
    assert lint.analysed(log.limit(0), f"{tmp_path}/none").count() == 0


def test_record_lines_are_compressed(spark, tmp_path):
    folder = tmp_path / "records"
    outputs.write_records(spark.range(3).selectExpr("cast(id AS string) AS text_id", "id"), str(folder), "all")
    assert all(f.name.endswith(".gz") for f in folder.glob("batch=all/part-*"))
    assert outputs.read_records(spark, str(folder), spark.range(3).selectExpr("cast(id AS string) AS text_id", "id").schema).count() == 3
