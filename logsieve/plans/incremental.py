"""Linting a log as it grows: a ledger of texts already linted, so that each text is looked at once.

A ledger is a folder of two tables. ``seen(text_id, version)`` names the texts that were linted and under
which rules, ``found`` holds their findings; both are partitioned by the batch that wrote them. Findings
are written first: they count only once ``seen`` names their text in the same batch. So a batch that
died half-way leaves nothing behind, and one that is repeated overwrites its own rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsieve.operators.skew import attach_to_log
from logsieve.operators.tokens import annotate
from logsieve.plans import lint

RULES_VERSION = "1"  # change it with any rule: texts are then linted anew
SEEN = "text_id binary, version string, batch_id bigint"
FOUND = (
    "text_id binary, rule_id string, variant string, stmt int, pos int, visible boolean, quirk boolean, "
    "p1 string, p2 string, version string, batch_id bigint"
)
START = -1  # the batch of the empty tables


def open_ledger(spark, folder: str) -> None:
    """Make the tables if they are not there; does no harm if they are."""
    for name, schema in (("seen", SEEN), ("found", FOUND)):
        rows = spark.createDataFrame([], schema).drop("batch_id")
        rows.write.mode("overwrite").parquet(f"{folder}/{name}/batch_id={START}")


def _table(spark, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SEEN if name == "seen" else FOUND).option("basePath", f"{folder}/{name}").parquet(f"{folder}/{name}")


def version_of(catalog: DataFrame | None) -> str:
    """Rules and catalog as one name; a catalog is summed up by its rows' hashes, in any order."""
    if catalog is None:
        return RULES_VERSION
    row = catalog.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*catalog.columns).cast("decimal(38,0)"))).first()
    return f"{RULES_VERSION}-{row[0]}-{row[1]}"


def unseen(texts: DataFrame, folder: str, version: str, batch_id: int) -> DataFrame:
    """Texts that no other batch has linted under this version.

    The ledger is cut to the texts at hand first, so where those are few it is read but not shuffled.
    """
    seen = _table(texts.sparkSession, folder, "seen").filter((F.col("version") == version) & (F.col("batch_id") != batch_id))
    met = seen.select("text_id").join(texts.select("text_id"), "text_id", "left_semi")
    return texts.join(met.distinct(), "text_id", "left_anti")


def update(log: DataFrame, folder: str, batch_id: int, catalog: DataFrame | None = None) -> None:
    """Lint the texts of a batch that the ledger does not know. ``batch_id`` (from 0) names the batch for good."""
    spark = log.sparkSession
    work = lint.prepare(log)
    open_ledger(spark, folder)
    version = version_of(catalog)
    part = f"batch_id={batch_id}"
    new_texts = unseen(work.texts, folder, version, batch_id)
    new_texts.select("text_id", F.lit(version).alias("version")).write.mode("overwrite").parquet(f"{folder}/next/{part}")
    names = spark.read.schema("text_id binary, version string").parquet(f"{folder}/next/{part}")
    texts = work.texts.join(names, "text_id", "left_semi")
    found = lint.every_finding(annotate(texts.filter("uses > 0")), catalog)
    columns = {c.name: c.dataType for c in _table(spark, folder, "found").schema.fields if c.name not in ("version", "batch_id")}
    shaped = found.select(*[(F.col(c) if c in found.columns else F.lit(None)).cast(t).alias(c) for c, t in columns.items()])
    shaped.withColumn("version", F.lit(version)).write.mode("overwrite").parquet(f"{folder}/found/{part}")
    names.write.mode("overwrite").parquet(f"{folder}/seen/{part}")


def known_findings(spark, folder: str, version: str = RULES_VERSION, parity: bool = False) -> DataFrame:
    """Findings per text, of all batches that ended. Two batches at once may lint a text twice; one of them counts."""
    seen = _table(spark, folder, "seen").filter(F.col("version") == version)
    first = seen.groupBy("text_id").agg(F.min("batch_id").alias("batch_id"))
    found = _table(spark, folder, "found").filter(F.col("version") == version).drop("version")
    each = found.join(first, ["text_id", "batch_id"]).drop("batch_id")
    return each.filter("visible") if parity else each.filter(~F.col("quirk"))


def batches(spark, folder: str) -> DataFrame:
    """(batch_id, texts): how many texts each batch had to lint."""
    return _table(spark, folder, "seen").groupBy("batch_id").agg(F.count(F.lit(1)).alias("texts"))


def findings_of(log: DataFrame, folder: str, catalog: DataFrame | None = None, parity: bool = False) -> DataFrame:
    """One row per finding and logged query, from the ledger; nothing is tokenised."""
    cleaned = lint.clean_log(log)
    texts = lint.distinct_texts(cleaned)
    found = known_findings(log.sparkSession, folder, version_of(catalog), parity)
    return attach_to_log(lint.with_text_key(cleaned), texts, lint.outputs.with_severity(found))
