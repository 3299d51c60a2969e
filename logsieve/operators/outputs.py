"""Outputs built from findings, statistics and the log."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logsieve.operators import relations
from logsieve.operators.rules import SUMMARY, finding
from logsieve.sources.dims import label_dim, message_dim, rule_dim

_RANK = {"error": 3, "warning": 2, "info": 1}


def with_severity(findings: DataFrame, how: str = "inner") -> DataFrame:
    dims = rule_dim(findings.sparkSession)
    return findings.join(F.broadcast(dims), "rule_id", how)  # 26 rows


def severity_counts(findings: DataFrame, key: str = "text_id") -> DataFrame:
    """Errors, warnings, infos and the worst severity per key."""
    rank = F.coalesce(*[F.when(F.col("severity") == s, n) for s, n in _RANK.items()])
    count = lambda s: F.count_if(F.col("severity") == s).alias(f"{s}s")
    return (
        with_severity(findings)
        .groupBy(key)
        .agg(
            count("error"),
            count("warning"),
            count("info"),
            F.count(F.lit(1)).alias("total"),
            F.max_by("severity", rank).alias("worst"),
        )
        .withColumn("badge", F.when(F.col("worst") == "info", "none").otherwise(F.col("worst")))
    )


def localised(findings: DataFrame, lang: str, how: str = "inner") -> DataFrame:
    """Findings with message, advice and labels in one language. ``how``: "left" also keeps findings that have none."""
    spark = findings.sparkSession
    messages = message_dim(spark).filter(F.col("lang") == lang).drop("lang")
    labels = label_dim(spark).filter(F.col("lang") == lang)
    severity = labels.filter("kind = 'severity'").select(
        F.col("code").alias("severity"), F.col("label").alias("severity_label")
    )
    category = labels.filter("kind = 'category'").select(
        F.col("code").alias("category"), F.col("label").alias("category_label")
    )

    def fill(tpl: str):
        out = F.col(tpl)
        for i in (1, 2):
            out = F.replace(out, F.lit(f"{{{i}}}"), F.coalesce(f"p{i}", F.lit("")))
        return out

    joined = with_severity(findings, how)
    for dim, key in ((messages, ["rule_id", "variant"]), (severity, ["severity"]), (category, ["category"])):
        joined = joined.join(F.broadcast(dim), key, how)  # fixed dims of at most 40 rows
    return joined.withColumns({"message": fill("message_tpl"), "advice": fill("advice_tpl")}).drop(
        "message_tpl", "advice_tpl"
    )


def summary() -> Column:
    """Error, formatted text and counters of a text, as one finding that goes with its others; see ``rules.kept_rows``."""
    counts = F.concat_ws(",", *[c.cast("string") for c in relations.counters().values()])
    return finding(SUMMARY, F.max("error"), -1, True, relations.printed(), counts, False)


def assembled(texts: DataFrame, findings: DataFrame) -> DataFrame:
    """One record per text: success, error, formatted text, findings, statistics. ``findings`` hold the summary of each text."""
    issue = F.struct("pos", "rule_id", "variant", "severity", "category", "message", "advice")
    is_summary = F.col("rule_id") == SUMMARY
    graded = localised(findings, "en", "left")
    known = reduce(and_, [F.col(c).isNotNull() for c in ("severity", "message", "severity_label", "category_label")])
    lists = graded.groupBy("text_id").agg(
        F.array_sort(F.collect_list(F.when(known & ~is_summary, issue))).alias("lint_issues"),
        F.max(F.when(is_summary, F.struct(F.col("variant").alias("error"), F.col("p1").alias("formatted"), F.col("p2").alias("counts")))).alias("s"),
    )
    counts = F.split("s.counts", ",")
    stats = [F.get(counts, F.lit(i)).cast("boolean" if n.startswith("has_") else "bigint").alias(n) for i, n in enumerate(relations.counters())]
    return (
        texts.select("text_id", "first_query", "dialect", "sql", "uses")
        .join(lists, "text_id", "left")
        .select(
            "text_id",
            "first_query",
            "dialect",
            "uses",
            F.col("s.error").isNull().alias("success"),
            F.col("s.error").alias("error"),
            F.coalesce("s.formatted", F.lit("")).alias("formatted_sql"),
            F.coalesce("lint_issues", F.array().cast(lists.schema["lint_issues"].dataType)).alias(
                "lint_issues"
            ),
            F.struct(*stats).alias("stats"),
        )
    )


def as_json(records: DataFrame) -> DataFrame:
    return records.select("text_id", F.to_json(F.struct(*records.columns)).alias("result"))


def write_records(records: DataFrame, folder: str, batch: str) -> None:
    """Records as JSON lines, compressed, one folder a batch; a batch written again replaces its own lines only."""
    lines = as_json(records).select(F.col("result").alias("value"), F.lit(batch).alias("batch"))
    writer = lines.write.partitionBy("batch").mode("overwrite")
    writer.option("partitionOverwriteMode", "dynamic").option("compression", "gzip").text(folder)


def read_records(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """The records of all batches with their ``batch``; ``bad_line`` holds a line that is no record."""
    wanted = T.StructType([*schema.fields, T.StructField("bad_line", T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad_line"}
    parsed = F.from_json("value", wanted, options).alias("r")
    return spark.read.option("basePath", folder).text(folder).select("batch", parsed).select("batch", "r.*")


def weighted_rules(log: DataFrame, findings: DataFrame, *by) -> DataFrame:
    """Findings per rule over the log, grouped by columns of the log.

    Both sides are reduced before they meet: the log to uses per text and group, the findings to
    a count per text and rule, so a frequent text costs no more than a rare one.
    """
    names = [c if isinstance(c, str) else c[0] for c in by]
    cols = [F.col(c) if isinstance(c, str) else c[1].alias(c[0]) for c in by]
    uses = log.groupBy("text_id", *cols).agg(F.count(F.lit(1)).alias("n"))
    rules = findings.groupBy("text_id", "rule_id").agg(F.count(F.lit(1)).alias("per_text"))
    return (
        uses.join(rules, "text_id")
        .groupBy(*names, "rule_id")
        .agg(F.sum(F.col("n") * F.col("per_text")).alias("findings"), F.sum("n").alias("queries"))
    )


def top_rules(counts: DataFrame, k: int, *by: str) -> DataFrame:
    """The k most frequent rules in each group; ties go to the lower rule id."""
    order = [F.col("findings").desc(), F.col("rule_id")]
    ranked = counts.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order)))
    return ranked.filter(F.col("rank") <= k)
