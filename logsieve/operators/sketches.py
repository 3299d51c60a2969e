"""Column profiles from sketches that are kept per day and merged, so that a new day costs only itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LG_SIZE = 12  # of the distinct counts: a standard error of 1.6 %
KLL_SIZE = 200  # of the quantiles: a rank error of about 1.65 %


def by_day(df: DataFrame, day: Column, columns: list[str]) -> DataFrame:
    """(day, column_name, rows, nulls, distinct, quantiles): one row per day and column, from one scan.

    ``distinct`` sketches the different values, ``quantiles`` the order of numbers (NULL for other
    types, and where a day holds no value). The aggregate runs on the map side; a sketch is a few kB.
    """
    made = []
    for name in columns:
        c, kind = F.col(name), df.schema[name].dataType
        number = c.cast("double") if isinstance(kind, T.NumericType) else F.lit(None).cast("double")
        usable = F.when(~F.isnan(number), number)
        made.append(
            F.struct(
                F.lit(name).alias("column_name"),
                F.count(F.lit(1)).alias("rows"),
                F.count_if(c.isNull()).alias("nulls"),
                F.hll_sketch_agg(c.cast("string"), F.lit(LG_SIZE)).alias("distinct"),
                F.when(F.count(usable) > 0, F.kll_sketch_agg_double(usable, F.lit(KLL_SIZE))).alias("quantiles"),
            ).alias(name)
        )
    days = df.groupBy(day.alias("day")).agg(*made)
    return days.select("day", F.explode(F.array(*[F.col(f"`{n}`") for n in columns])).alias("p")).select("day", "p.*")


def store(sketches: DataFrame, folder: str) -> None:
    """Write the days at hand; a day that is there already is replaced, others stay as they are."""
    writer = sketches.repartition("day").write.partitionBy("day").mode("overwrite")
    writer.option("partitionOverwriteMode", "dynamic").parquet(folder)


def merged(sketches: DataFrame, *by: str) -> DataFrame:
    """(column_name, rows, nulls, distinct_estimate, median, p99), over all days or per further column."""
    return (
        sketches.groupBy("column_name", *by)
        .agg(
            F.sum("rows").alias("rows"),
            F.sum("nulls").alias("nulls"),
            F.hll_sketch_estimate(F.hll_union_agg("distinct")).alias("distinct_estimate"),
            F.when(F.count("quantiles") > 0, F.kll_merge_agg_double("quantiles")).alias("q"),
        )
        .withColumns({"median": F.kll_sketch_get_quantile_double("q", F.lit(0.5)), "p99": F.kll_sketch_get_quantile_double("q", F.lit(0.99))})
        .drop("q")
    )


def checked(estimates: DataFrame, df: DataFrame, columns: list[str], share: float = 0.05, rank: float = 0.03) -> DataFrame:
    """Exact counts beside the estimates, and whether those are as close as promised; costs what the sketches save.

    ``distinct_close``: within ``share`` of the exact number; ``median_close``: the share of values up to the
    estimate is within ``rank`` of a half (NULL where there is no order).
    """
    out = None
    for name in columns:
        line = F.broadcast(estimates.filter(F.col("column_name") == name).select("distinct_estimate", "median"))  # one row
        per_value = df.groupBy(F.col(name).alias("v")).agg(F.count(F.lit(1)).alias("n"))
        number = F.col("v").try_cast("double") if isinstance(df.schema[name].dataType, T.NumericType) else F.lit(None).cast("double")
        one = per_value.join(line).agg(
            F.sum("n").alias("rows"),
            F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("nulls"),
            F.count("v").alias("distinct_values"),
            F.max("distinct_estimate").alias("estimate"),
            (F.sum(F.when(number <= F.col("median"), F.col("n"))) / F.sum(F.when(number.isNotNull(), F.col("n")))).alias("below"),
            (F.sum(F.when(number < F.col("median"), F.col("n"))) / F.sum(F.when(number.isNotNull(), F.col("n")))).alias("under"),
        ).withColumn("column_name", F.lit(name))
        out = one if out is None else out.unionByName(one)
    close = F.abs(F.col("estimate") - F.col("distinct_values")) <= F.greatest(F.lit(1.0), F.col("distinct_values") * share)
    middle = F.when(F.col("below").isNotNull(), (F.col("below") >= 0.5 - rank) & (F.coalesce("under", F.lit(0.0)) <= 0.5 + rank))
    return out.select("column_name", "rows", "nulls", "distinct_values", close.alias("distinct_close"), middle.alias("median_close"))
