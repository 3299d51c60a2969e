"""Linting a stream of queries, and counting findings per rule and time window."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logsieve.plans import lint

ISSUE_COLUMNS = ["query_id", "ts", "user_id", "stmt", "pos", "rule_id", "severity"]


def work_folder(spark: SparkSession) -> str:
    """A new folder for stream state and results, in the shared folder the session names."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None and not spark.sparkContext.master.startswith("local["):
        raise ValueError("name a folder, or set spark.checkpoint.dir to one that driver and executors share")
    if shared is None:
        return tempfile.mkdtemp(prefix="logsieve-")
    return f"{shared.rstrip('/')}/logsieve-{uuid.uuid4().hex}"


def lint_batch(log: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    work = lint.prepare(log)
    found = lint.outputs.with_severity(lint.findings(work, catalog))
    return work.per_query(found, "ts", "user_id").select(*ISSUE_COLUMNS)


def lint_stream(log: DataFrame, out: str, state: str, catalog: DataFrame | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Lint a streaming log, one micro-batch at a time, into parquet under ``out``.

    A query's findings depend on nothing but its text, so no state is held. Each batch overwrites
    its own folder: a batch repeated after a failure leaves no duplicates.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        lint_batch(batch, catalog).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    writer = log.writeStream.foreachBatch(write).option("checkpointLocation", state)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def rule_windows(issues: DataFrame, width: str = "10 minutes", delay: str = "10 minutes") -> DataFrame:
    """Findings per rule and window of event time; rows later than ``delay`` are dropped."""
    return (
        issues.withWatermark("ts", delay)
        .groupBy(F.window("ts", width), "rule_id")
        .agg(F.count(F.lit(1)).alias("findings"))
        .select(
            F.col("window.start").cast("timestamp_ntz").alias("window_start"),
            F.col("window.end").cast("timestamp_ntz").alias("window_end"),
            "rule_id",
            "findings",
        )
    )


def run_rule_windows(spark: SparkSession, log: DataFrame, folder: str | None = None, catalog: DataFrame | None = None) -> DataFrame:
    """Process all of a streaming log that is there now; the windows closed so far."""
    base = folder or work_folder(spark)
    lint_stream(log, f"{base}/issues", f"{base}/lint-state", catalog).awaitTermination()
    stored = spark.read.parquet(f"{base}/issues")
    issues = spark.readStream.schema(stored.schema).parquet(f"{base}/issues")
    query = (
        rule_windows(issues)
        .writeStream.format("parquet")
        .option("path", f"{base}/windows")
        .option("checkpointLocation", f"{base}/window-state")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.parquet(f"{base}/windows")
