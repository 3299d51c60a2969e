"""The named queries of this subpackage: thin calls of the operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsieve.llm import (
    byte_bpe, filter_audit, fuzzy_lines, golay, hyperplanes, langid, lexical_search, neighbours, packing, pstable, secret_ledger, simhash_tables, surrogates, toxicity,
)
from logsieve.llm.runtime import Scratch

TOXIC_CHAIN = ("low_quality", "toxic")
SURROGATE_KEY = "logsieve"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def chain_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, p_low_quality, p_toxic, is_toxic of every document."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.train(docs, chain_labels(spark, sf_dir), TOXIC_CHAIN))
    return scored.select("doc_id", "verdict.p_low_quality", "verdict.p_toxic", "verdict.is_toxic")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    net = langid.train(docs.where(~held_out & F.col("lang").isNotNull()))
    return langid.identify(docs, net, F.col("text"), doc_id=F.col("doc_id"), held_out=held_out)


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document is the one version of a path of its own; the ledger starts empty."""
    versions = documents(spark, sf_dir).select("doc_id", F.col("text").alias("content"))
    ledger = secret_ledger.update(versions, f"{Scratch(spark, 'secrets').path}/ledger")
    found = secret_ledger.findings(versions, ledger)
    kind = lambda s: F.substring_index(s["rule"], "@", 1)
    shown = lambda s: F.concat_ws(":", kind(s), s["at"], s["until"])
    count = lambda k: F.size(F.filter("spans", lambda s: kind(s) == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: kind(s).isin("assign", "access", "hex"))
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(F.array_join(F.transform(base, shown), ","), 256).alias("base_sha256"), F.array_join(F.transform("spans", shown), ",").alias("spans"),
    )


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = byte_bpe.encode(documents(spark, sf_dir), path, public_tokenizers.PATTERN, F.col("text"), doc_id=F.col("doc_id"))
    return byte_bpe.digests(byte_bpe.decode(encoded, path, public_tokenizers.PATTERN))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With n_near: for ids divisible by 100, how many other documents have a fingerprint within 3 bits."""
    scratch = Scratch(spark, "fingerprints")
    docs = documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ordered = neighbours.with_next(neighbours.in_descending_order(docs, "doc_id"), "text", "next_text")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    both = ordered.select("bucket", "at", "doc_id", n.cast("long").alias("n_chars"), "text", edited.alias("edited"))
    sides = both.select("bucket", "at", "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("text").alias("t")), F.struct(F.lit(1).alias("side"), F.col("edited").alias("t")))).alias("s"))
    keys = ["bucket", "at", "doc_id", "n_chars", "edited_sha256", "side"]
    made = simhash_tables.fingerprints(sides.select("*", "s.side", "s.t"), F.col("t"), *keys)
    own = F.max(F.when(F.col("side") == 0, F.col("fingerprint"))).alias("own")
    rows = scratch.save(made.groupBy(*keys[:-1]).agg(own, F.max(F.when(F.col("side") == 1, F.col("fingerprint"))).alias("other")), "prints")
    followed = neighbours.with_next(rows, "own", "following")
    prints = rows.select(F.col("own").alias("fingerprint"))
    asked = rows.where(F.col("doc_id") % 100 == 0).select(F.col("own").alias("fingerprint"))
    counts = simhash_tables.near(asked, prints).groupBy(F.col("fingerprint").alias("own")).agg((F.sum("n") - 1).alias("n_near"))
    text = lambda c: F.lpad(F.lower(F.hex(c)), 16, "0")
    return followed.join(scratch.save(counts, "near"), "own", "left").select(
        "doc_id", "n_chars", "edited_sha256", text("own").alias("fingerprint"), text("other").alias("edited_fingerprint"),
        simhash_tables.likeness(F.col("own"), F.col("other")).alias("near_edited"), simhash_tables.likeness(F.col("own"), F.col("following")).alias("near_next"),
        F.when(F.col("doc_id") % 100 == 0, F.col("n_near")).alias("n_near"),
    )


def op6_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = golay.near_components(documents(spark, sf_dir), Scratch(spark, "golay"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the text that is left, and the number of lines that were cut."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return fuzzy_lines.dedup_lines(docs, Scratch(spark, "lines")).select("doc_id", "text", "lines_cut")


def op8_hyperplanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hyperplanes.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), Scratch(spark, "vectors"))
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")


def op9_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the text with surrogates, and how many entities were replaced."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return surrogates.replace_entities(docs, Scratch(spark, "surrogates"), SURROGATE_KEY)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), Scratch(spark, "packing"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "search")
    lists = scratch.save(lexical_search.index(documents(spark, sf_dir)), "index")
    return lexical_search.search(lists, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), scratch)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    masks = filter_audit.document_masks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return filter_audit.audit(masks, "ABCDE", ("good", "toxic"))


def op13_pstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return pstable.nearest(vectors, F.col("id") % 20 == 0, Scratch(spark, "nearest"))


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [op1_toxicity, op2_language, op3_secrets, op4_byte_bpe, op5_fingerprints, op6_golay, op7_lines, op8_hyperplanes, op9_surrogates, op10_packing, op11_search, op12_filter_audit, op13_pstable]
    return {f.__name__: f for f in named}


def llm_oracles() -> dict[str, str]:
    """Queries that SQL can express at whole-table cost; the others are tested against brute force."""
    return {"op11_search": lexical_search.SEARCH_SQL, "op12_filter_audit": filter_audit.AUDIT_SQL}
