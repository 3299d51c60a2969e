"""Each row and the one after it in a global order, without bringing the table into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SPLITS = 200


def in_descending_order(rows: DataFrame, id_col: str, buckets: int = SPLITS) -> DataFrame:
    """rows and (bucket, at): buckets run from the highest ids to the lowest, `at` counts inside one.

    Split points are approximate quantiles of the ids, so buckets hold about as many rows each whatever the
    ids look like; null ids come last. Rows with equal ids go by the columns' hash.
    """
    cuts = rows.agg(F.percentile_approx(id_col, [i / buckets for i in range(1, buckets)], 10_000).alias("c")).first()["c"]
    above = F.size(F.filter(F.array(*(F.lit(c) for c in sorted(set(cuts or [])))).cast("array<long>"), lambda c: c >= F.col(id_col)))
    bucket = F.when(F.col(id_col).isNull(), F.lit(buckets)).otherwise(above)
    order = Window.partitionBy("bucket").orderBy(F.col(id_col).desc_nulls_last(), F.xxhash64(*rows.columns), *rows.columns)
    return rows.withColumn("bucket", bucket).withColumn("at", F.row_number().over(order))


def with_next(ordered: DataFrame, value: str, alias: str) -> DataFrame:
    """ordered and `alias`, the value of the next row; after the last row comes the first.

    Inside a bucket this is a window; the last row of a bucket takes the first of the next bucket that has
    rows. Those first values are one row a bucket, whatever the size of the table.
    """
    inside = Window.partitionBy("bucket").orderBy("at")
    firsts = ordered.where("at = 1").select("bucket", F.col(value).alias("head"))
    numbered = firsts.withColumn("turn", F.row_number().over(Window.orderBy("bucket")))
    count = numbered.agg(F.max("turn").alias("turns"))
    wanted = numbered.select("bucket", (F.col("turn") - 1).alias("turn"))
    wanted = wanted.join(count).select("bucket", (F.pmod(F.col("turn") + 1, "turns") + 1).alias("turn"))
    heads = wanted.join(numbered.select("turn", "head"), "turn").select("bucket", "head")
    led = ordered.withColumn("led", F.lead(F.struct(value)).over(inside))
    return led.join(heads, "bucket").withColumn(alias, F.when(F.col("led").isNull(), F.col("head")).otherwise(F.col(f"led.{value}"))).drop("led", "head")
