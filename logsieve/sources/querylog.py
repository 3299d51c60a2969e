"""Query-log sources: reading, cleaning, dialects, and a log derived from an events table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Dialect name, double quotes hold strings, backslash escapes a quote, [name].
DIALECTS = [
    ("generic", False, False, False),
    ("ansi", False, False, False),
    ("postgresql", False, False, False),
    ("mysql", True, True, False),
    ("mssql", False, False, True),
    ("bigquery", True, True, False),
    ("sqlite", False, False, True),
]


def dialect_dim(spark: SparkSession) -> DataFrame:
    """Seven rows: how each dialect quotes names and strings."""
    return spark.createDataFrame(
        DIALECTS,
        "dialect string, dq_is_string boolean, backslash_escapes boolean, brackets boolean",
    )


def resolve_dialect(name: Column) -> Column:
    """Known dialect name in any case, else generic."""
    known = F.lower(name).isin([d[0] for d in DIALECTS])
    return F.when(known, F.lower(name)).otherwise("generic")


def read_log(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Log stored as parquet or JSON with the columns of ``query_log``."""
    schema = "query_id bigint, ts timestamp, user_id bigint, dialect string, sql string"
    if fmt == "parquet":
        return spark.read.parquet(path)
    return spark.read.schema(schema).format(fmt).load(path)


def read_text_files(spark: SparkSession, path: str, dialect: str = "generic") -> DataFrame:
    """One query per file; the file path is the user key, the id is derived from it."""
    files = spark.read.text(path, wholetext=True)
    return files.select(
        F.xxhash64(F.input_file_name(), "value").alias("query_id"),
        F.lit(None).cast("timestamp").alias("ts"),
        F.lit(None).cast("bigint").alias("user_id"),
        F.lit(dialect).alias("dialect"),
        F.col("value").alias("sql"),
    )


def clean_log(log: DataFrame) -> DataFrame:
    """Trim texts, drop blank ones, resolve the dialect."""
    trimmed = F.regexp_replace("sql", r"^[ \t\r\n\f\x0B]+|[ \t\r\n\f\x0B]+$", "")
    return (
        log.withColumn("sql", trimmed)
        .filter(F.col("sql") != "")
        .withColumn("dialect", resolve_dialect(F.col("dialect")))
    )


def with_text_key(log: DataFrame) -> DataFrame:
    """``text_id``: the SHA-256 of (dialect, sql), so later joins carry 32 bytes and not the text.

    It is the identity of a text whatever the query ids are: they may repeat or be null.
    """
    return log.withColumn("text_id", F.unhex(F.sha2(F.concat_ws("\n", "dialect", "sql"), 256)))


def distinct_texts(log: DataFrame) -> DataFrame:
    """One row per distinct (dialect, sql) with its number of uses; combined before the shuffle.

    ``first_query`` is the smallest query id using the text, null if none of them has an id.
    """
    grouped = log.groupBy("dialect", "sql").agg(
        F.min("query_id").alias("first_query"), F.count(F.lit(1)).alias("uses")
    )
    dims = F.broadcast(dialect_dim(log.sparkSession))  # seven rows
    return with_text_key(grouped).join(dims, "dialect")
