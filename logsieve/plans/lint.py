"""The jobs: a query log in, tables of findings and statistics out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsieve.operators import outputs, relations
from logsieve.operators.catalog_rules import CATALOG_RULES, all_findings
from logsieve.operators.rules import ILL_FORMED, TOKEN_RULES, ill_formed, may_find, token_findings, token_hits
from logsieve.operators.skew import attach_to_log
from logsieve.operators.tokens import annotate
from logsieve.session import free_shuffles
from logsieve.sources.querylog import clean_log, distinct_texts, with_text_key


TEXTS_AT_ONCE = 500_000  # see ``analysed``


@dataclass(frozen=True)
class Workload:
    """A cleaned log, its distinct texts, and their tokens. All lazy."""

    log: DataFrame
    texts: DataFrame
    tokens: DataFrame

    def per_query(self, per_text: DataFrame, *log_columns: str) -> DataFrame:
        """Rows per text spread to the queries that use the text."""
        log = self.log.select("query_id", *log_columns, "text_id")
        return attach_to_log(log, self.texts, per_text).drop("text_id")

    def by_first_query(self, per_text: DataFrame) -> DataFrame:
        """Rows per text, with the least query id that uses the text in place of its hash."""
        first = self.texts.select("text_id", F.col("first_query"))
        rest = [c for c in per_text.columns if c != "text_id"]
        return per_text.join(first, "text_id").select(F.col("first_query").alias("text_id"), *rest)


def prepare(log: DataFrame, only: list[str] | None = None) -> Workload:
    """Clean the log and set up its token relation; each distinct text is tokenised once.

    Where nothing but the rules in ``only`` is asked for, texts in which these cannot find anything are not tokenised.
    """
    # generated methods longer than 8000 bytes are never compiled by the JVM; splitting them is
    # several times faster on the wide token rows
    log.sparkSession.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    # a union that claims its children's partitioning cannot be read by adaptive execution when
    # it coalesces one of them ("can't zip RDDs with unequal numbers of partitions")
    log.sparkSession.conf.set("spark.sql.unionOutputPartitioning", "false")
    cleaned = clean_log(log)
    texts = distinct_texts(cleaned)
    # asking for ``uses`` here keeps this aggregate equal to the one behind the join to the log,
    # so that the shuffle of distinct texts is made once and reused
    return Workload(with_text_key(cleaned), texts, annotate(texts.filter("uses > 0").filter(may_find(only))))


def findings(work: Workload, catalog: DataFrame | None = None, parity: bool = False,
             only: list[str] | None = None, summary: Column | None = None) -> DataFrame:
    """Findings per distinct text.

    By default every query in a text is looked at. ``parity`` keeps what a walker reports that
    skips derived tables, CTEs, EXISTS, join conditions and operands it does not descend into,
    and that knows no CTE names or outer aliases.
    """
    found = every_finding(work.tokens, catalog, only, summary)
    return found.filter("visible") if parity else found.filter(~F.col("quirk"))


def every_finding(tokens: DataFrame, catalog: DataFrame | None = None, only: list[str] | None = None,
                  summary: Column | None = None) -> DataFrame:
    """Findings of both modes."""
    if catalog is not None and (only is None or set(only) & set(CATALOG_RULES)):
        return all_findings(tokens, catalog, only, summary=summary)
    if only is None or set(only) & set(TOKEN_RULES):
        return token_findings(tokens, only, summary=summary)
    raise ValueError("catalog rules need a catalog")


def lint(log: DataFrame, catalog: DataFrame | None = None, parity: bool = False,
         only: list[str] | None = None) -> DataFrame:
    """One row per finding and logged query."""
    work = prepare(log, only)
    found = outputs.with_severity(findings(work, catalog, parity, only))
    return work.per_query(found)


def stats(log: DataFrame) -> DataFrame:
    """One row of counters and flags per logged query."""
    work = prepare(log)
    sizes = work.texts.select(
        "text_id",
        F.size(F.split("sql", "\n")).alias("line_count"),
        F.char_length("sql").alias("char_count"),
    )
    return work.per_query(relations.text_stats(work.tokens).join(sizes, "text_id"))


def analyse(log: DataFrame, catalog: DataFrame | None = None, parity: bool = False) -> DataFrame:
    """One record per distinct text with findings, statistics and formatted text; the tokens are made once."""
    work = prepare(log)
    return outputs.assembled(work.texts, findings(work, catalog, parity, summary=outputs.summary()))


def analysed(log: DataFrame, folder: str, catalog: DataFrame | None = None, parity: bool = False,
             most: int = TEXTS_AT_ONCE) -> DataFrame:
    """The records of ``analyse``, written under ``folder`` some ``most`` texts at a time.

    The token step writes several kB a text to local disks; after each turn Spark deletes its shuffle files.
    """
    spark, texts = log.sparkSession, prepare(log).texts
    schema = texts.schema
    texts.write.mode("overwrite").parquet(f"{folder}/texts")
    texts = spark.read.schema(schema).parquet(f"{folder}/texts")
    turns = max(1, -(-texts.count() // most))
    places = [f"{folder}/records/{turn:05d}" for turn in range(turns)]
    for turn, place in enumerate(places):
        some = texts.filter(F.pmod(F.xxhash64("text_id"), F.lit(turns)) == turn)
        work = Workload(log, some, annotate(some.filter("uses > 0")))
        records = outputs.assembled(some, findings(work, catalog, parity, summary=outputs.summary()))
        schema = records.schema
        records.write.mode("overwrite").parquet(place)
        del work, records
        free_shuffles(spark)
    return spark.read.schema(schema).parquet(*places)


def outcomes(log: DataFrame) -> DataFrame:
    """Per logged query the error of its text, or the token rules found in it; one pass over the tokens."""
    work = prepare(log)
    found = F.flatten(F.collect_list(F.transform(token_hits(), lambda h: h["rule_id"])))
    per_text = work.tokens.groupBy("text_id").agg(
        F.max("error").alias("error"), F.array_join(F.array_sort(found), ",").alias("rules")
    )
    return work.per_query(per_text, "dialect")


def clean_queries(log: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """Logged queries that are well formed and have no error and no warning, with a catalog also none on names.

    An ill-formed text counts as one with a finding, so the tokens are made once.
    """
    work = prepare(log)
    failed = ill_formed()
    found = token_findings(work.tokens, more=failed) if catalog is None else all_findings(work.tokens, catalog, more=failed)
    severity = F.broadcast(outputs.rule_dim(log.sparkSession).select("rule_id", "severity"))  # 26 rows
    graded = found.filter(~F.col("quirk")).join(severity, "rule_id", "left")
    bad = graded.filter((F.col("rule_id") == ILL_FORMED) | (F.col("severity") != "info")).select("text_id").distinct()
    return work.per_query(work.texts.filter("uses > 0").select("text_id").join(bad, "text_id", "left_anti"))
