import duckdb
import pytest
from pyspark.sql import functions as F

from logsieve.operators import impact


def rows(df):
    return {r.form: r.rows for r in df.collect()}


@pytest.mark.parametrize("right", [[1, 2], [1, None], []])
def test_not_in_follows_null_rules(spark, right):
    left = [1, 2, 3, None]
    a = spark.createDataFrame([(x,) for x in left], "k int")
    b = spark.createDataFrame([(x,) for x in right], "r int")
    got = sorted((r.k for r in impact.not_in(a, b, "k", "r").collect()), key=str)
    con = duckdb.connect()
    con.execute("CREATE TABLE a(k INT); CREATE TABLE b(r INT)")
    con.executemany("INSERT INTO a VALUES (?)", [(x,) for x in left])
    if right:
        con.executemany("INSERT INTO b VALUES (?)", [(x,) for x in right])
    want = con.execute("SELECT k FROM a WHERE k NOT IN (SELECT r FROM b)").fetchall()
    assert got == sorted((r[0] for r in want), key=str)


def test_or_split_keeps_nulls_out(spark):
    df = spark.createDataFrame([(1, None), (None, 1), (1, 1), (None, None), (0, 0)], "a int, b int")
    r = rows(impact.or_split(df, F.col("a") == 1, F.col("b") == 1))
    assert r == {"either": 3, "overlap": 1, "union_all": 3}


def test_range_form_is_pushed_down(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    plan = lambda c: orders.filter(c).select("o_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate" in plan(impact.year_range("o_orderdate", 1996))
    assert "GreaterThanOrEqual(o_orderdate" not in plan(F.year("o_orderdate") == 1996)
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderdate" in plan(impact.year_range("o_orderdate", 1996))


def test_fanout_equals_the_join(spark):
    a = spark.createDataFrame([(1,), (1,), (2,), (None,)], "x int")
    b = spark.createDataFrame([(1,), (1,), (1,), (3,), (None,)], "y int")
    assert rows(impact.fanout_totals(a, b, "x", "y")) == {"joined": 6, "cartesian": 20}


def test_bytes_of_every_type(spark):
    df = spark.sql("SELECT true AS b, 1S AS s, CAST(1.5 AS DECIMAL(10,2)) AS d, DATE'2020-01-01' AS day, array(1) AS a")
    got = {r.column_name: r.bytes for r in impact.column_bytes(df, "t").collect()}
    assert got == {"b": 1, "s": 2, "d": 8, "day": 4, "a": None}


def test_layout_range_follows_the_type(spark):
    row = impact.column_layout(spark.range(8, 1500).toDF("k"), ["k"]).first()
    assert (row.min_value, row.max_value, row.advice) == ("8", "1499", "bucket")
