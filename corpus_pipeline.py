"""A corpus pipeline: documents without toxicity, repeated lines, near-duplicates and personal data, packed.

Each stage takes (spark, docs, sf_dir) and is written as Parquet before the next reads it.
"""

from __future__ import annotations

import gc
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsieve.llm import fuzzy_lines, golay, packing, surrogates, toxicity
from logsieve.llm.queries import SURROGATE_KEY, TOXIC_CHAIN, chain_labels
from logsieve.llm.runtime import Scratch, fresh_name

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


_LEFT: dict[str, list[Scratch]] = {}  # of each application: tables of a stage whose output the next one reads


def _input_is_written(spark: SparkSession) -> None:
    """Delete what the stage before wrote on the way; Spark deletes the shuffle files of plans that are collected."""
    left = _LEFT.setdefault(spark.sparkContext.applicationId, [])
    while left:
        left.pop().clear()
    gc.collect()
    spark._jvm.System.gc()


def _scratch(spark: SparkSession, name: str) -> Scratch:
    """A place for a stage's tables, until the next stage begins."""
    _input_is_written(spark)
    place = Scratch(spark, name)
    _LEFT[spark.sparkContext.applicationId].append(place)
    return place


def _recounted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not call toxic, all columns as they are."""
    chain = toxicity.train(docs, chain_labels(spark, sf_dir), TOXIC_CHAIN)
    scored = toxicity.score(docs, chain)
    return scored.where(~F.col(f"`{scored.columns[-1]}`.is_toxic")).select(*docs.columns)


def distinct_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with each group of equal or similar lines left in one place only."""
    return _recounted(fuzzy_lines.dedup_lines(docs, _scratch(spark, "lines")).select(*docs.columns))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the least id, ids before none.

    Near copies have SimHash fingerprints of four-word shingles that differ in at most four bits. Documents without
    a word have fingerprint 0 and are near copies of each other. Of rows that repeat an id and a text one stays.
    """
    scratch = _scratch(spark, "documents")
    found = golay.near_components(docs, scratch, shingle=4, radius=4)
    first = found.groupBy("label").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h")).alias("r"))
    kept = scratch.save(first.select(F.col("r.id").alias("id"), F.col("r.h").alias("h")), "kept")
    ident, text = fresh_name(docs.columns, "ident"), fresh_name(docs.columns, "text_hash")
    keyed = docs.withColumn(ident, F.col("doc_id").cast("long")).withColumn(text, F.xxhash64("text"))
    one = keyed.join(kept, keyed[ident].eqNullSafe(kept.id) & (keyed[text] == kept.h), "left_semi")
    return one.dropDuplicates([ident, text]).select(*docs.columns)


def without_persons(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with surrogates for personal data."""
    return _recounted(surrogates.replace_entities(docs, _scratch(spark, "surrogates"), SURROGATE_KEY).select(*docs.columns))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of every document and their places in sequences of 2048 tokens."""
    _input_is_written(spark)
    return packing.pack(docs, Scratch(spark, "packing"), public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", not_toxic),
    ("lines", distinct_lines),
    ("near_duplicates", distinct_documents),
    ("surrogates", without_persons),
    ("packing", packed),
]

#: Models, hashes and tokenizers have no SQL form; the operators are tested one by one against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, over documents; what lies between is written to the shared folder."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        made = scratch.save(stage(spark, docs, sf_dir), name)
        if i:
            scratch.drop(docs)
        docs = made
    return STAGES[-1][1](spark, docs, sf_dir)
