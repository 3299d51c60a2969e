"""Secret scans over every version of a file, with a ledger of what has been scanned.

A version's content is a blob, named by its SHA-256. The ledger holds one row per blob and run: the rules
(with their versions) that were applied and the spans they found. A scan reads only blobs for which some
rule version is missing, applies only the missing ones, appends to the ledger, and joins the findings back
to all paths that ever had the blob.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsieve.llm.runtime import ship

SPANS = "array<struct<rule string, at int, until int>>"


@dataclass(frozen=True)
class Rule:
    """Matches of `pattern`, leftmost and without overlap; those that miss the length are dropped."""

    kind: str
    version: int
    pattern: str
    group: int = 0  # the group whose length counts
    least: int = 1
    flags: int = re.ASCII

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


#: Patterns fixed by the contract of the scan. A run of hex digits is matched only where 24 of them follow
#: the start of the run: the same spans as all runs with the short ones dropped.
BASE_RULES = (
    Rule("assign", 1, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, re.ASCII | re.IGNORECASE),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", 1, r"(?<![0-9a-f])[0-9a-f]{24,}", 0, 24),
)
#: Public formats of credentials.
MORE_RULES = (
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    # begins where a run of its characters begins, and never gives one back: linear in any text
    Rule("jwt", 2, r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]++"),
    Rule("forge", 1, r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", 1, r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("url", 1, r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,64}:[^\s/@]{3,128}@"),
)
RULES = BASE_RULES + MORE_RULES


def spans(text: str, rules: tuple[Rule, ...]) -> list[tuple[str, int, int]]:
    """(rule, start, end) in code points, by start, then in the order of the rules."""
    found = []
    for order, rule in enumerate(rules):
        for m in re.compile(rule.pattern, rule.flags).finditer(text):
            if len(m.group(rule.group)) >= rule.least:
                found.append((m.start(), order, m.end(), rule.name))
    return [(name, at, until) for at, _, until, name in sorted(found)]


def _scanner(rules: tuple[Rule, ...]):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pending = [set(x) for x in batch.column("pending").to_pylist()]
            texts = batch.column("content").to_pylist()
            rows = [[dict(rule=r, at=a, until=u) for r, a, u in spans(t, tuple(x for x in rules if x.name in p))] for t, p in zip(texts, pending, strict=True)]
            kind = pa.list_(pa.struct([("rule", pa.string()), ("at", pa.int32()), ("until", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column("blob"), batch.column("pending"), pa.array(rows, kind)], ["blob", "rules", "spans"])

    return scan


def read_ledger(spark, ledger: str) -> DataFrame:
    """(blob, rules, spans) of all runs; no rows where nothing has been scanned yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    schema = f"blob string, rules array<string>, spans {SPANS}"
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(ledger)


def update(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scan what the ledger lacks of `versions` (a column `content`) and return the ledger.

    A null content is an empty blob. Equal contents are one blob, combined before the shuffle, so a blob
    with a third of all versions is no hot key. A run writes to a folder of its own: a failed run leaves
    no half-written rows, and two runs at once scan a blob twice at worst.
    """
    spark = versions.sparkSession
    ship(spark)
    content = F.coalesce(F.col("content"), F.lit(""))
    blobs = versions.select(F.sha2(content, 256).alias("blob"), content.alias("content")).groupBy("blob").agg(F.first("content").alias("content"))
    wanted = F.array(*(F.lit(r.name) for r in rules))
    known = read_ledger(spark, ledger)
    if known.isEmpty():
        todo = blobs.withColumn("pending", wanted)
    else:
        seen = known.select("blob", F.explode("rules").alias("rule")).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        left = blobs.join(seen, "blob", "left").withColumn("pending", F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>"))))
        todo = left.where(F.size("pending") > 0)
    scanned = todo.select("blob", "pending", "content").mapInArrow(_scanner(rules), f"blob string, rules array<string>, spans {SPANS}")
    scanned.write.parquet(f"{ledger}/run-{uuid.uuid4().hex}")
    return read_ledger(spark, ledger)


def findings(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All columns of versions but the content, and `spans` of the current rule versions, in order.

    Blobs without a finding are not joined: their versions get an empty array. The order is by start, then by rule as listed.
    """
    names = F.array(*(F.lit(r.name) for r in rules))
    found = ledger.select("blob", F.explode("spans").alias("span")).where(F.array_contains(names, F.col("span.rule")))
    ordered = F.struct("span.at", F.array_position(names, F.col("span.rule")).alias("rank"), "span.until", "span.rule")
    per_blob = found.groupBy("blob").agg(F.sort_array(F.collect_set(ordered)).alias("spans"))  # bounded by one text
    keyed = versions.withColumn("blob", F.sha2(F.coalesce("content", F.lit("")), 256)).drop("content")
    return keyed.join(per_blob, "blob", "left").withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<at:int,rank:bigint,until:int,rule:string>>")))
