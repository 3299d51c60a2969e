"""Document fingerprints: SimHash over weighted terms, and permuted block tables to find near ones.

Only DataFrame functions. Terms are the lower-cased words and the pairs of neighbouring words; each
occurrence adds its weight to, or takes it from, every bit of the fingerprint by the bits of the term's
hash. A bit is set where the sum is positive. For the search, the fingerprint's bits are cut into blocks;
every choice of `blocks - radius` blocks, moved to the front, is the key of one table. Two fingerprints
within the radius differ in at most `radius` blocks, so they meet in at least one table.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LANE = 0x0000000100000001  # two counters of 32 bits in a long
WORD_WEIGHT, PAIR_WEIGHT = 1, 2


def terms(text: Column) -> Column:
    """array<struct<h long, w int>> of the words and neighbouring pairs of a text, repeats included."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    singles = F.transform(words, lambda w: F.struct(F.xxhash64(w).alias("h"), F.lit(WORD_WEIGHT).alias("w")))
    pairs = F.zip_with(
        F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words), F.lit(1))),
        lambda a, b: F.struct(F.xxhash64(a, b).alias("h"), F.lit(PAIR_WEIGHT).alias("w")),
    )
    return F.concat(singles, pairs)


def fingerprints(rows: DataFrame, text: Column, *keys: str) -> DataFrame:
    """(keys, fingerprint long) per key; rows of one key add up. Null texts and texts without a word give 0.

    Sums run over exploded terms: 32 longs hold two bits' counters each, so a row of sums is all that
    is shuffled, and nothing if the rows are already distributed by some of the keys.
    """
    voted = rows.select(*keys, F.explode_outer(terms(F.coalesce(text, F.lit("")))).alias("t")).select(*keys, "t.h", "t.w")
    hits = [F.sum(F.shiftrightunsigned("h", b).bitwiseAND(F.lit(LANE)) * F.col("w")).alias(f"s{b}") for b in range(32)]
    sums = voted.groupBy(*keys).agg(F.sum("w").alias("total"), *hits)

    def bit(b: int) -> Column:
        count = F.col(f"s{b % 32}").bitwiseAND(F.lit(0xFFFFFFFF)) if b < 32 else F.shiftrightunsigned(f"s{b % 32}", 32)
        return F.when(count * 2 > F.col("total"), F.shiftleft(F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))

    parts = [bit(b) for b in range(64)]
    while len(parts) > 1:  # a balanced tree, not a chain of 64
        parts = [a.bitwiseOR(b) for a, b in zip(parts[::2], parts[1::2], strict=True)]
    return sums.select(*keys, parts[0].alias("fingerprint"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits, 0 to 1."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / 64


def block_keys(fingerprint: Column, radius: int, blocks: int) -> Column:
    """One long per table: the table's number and the chosen blocks' bits at its front."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    keys = []
    for table, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        kept = sum(((1 << edges[i + 1]) - (1 << edges[i])) for i in chosen)
        kept -= 1 << 64 if kept >= 1 << 63 else 0
        keys.append(F.xxhash64(F.lit(table), fingerprint.bitwiseAND(F.lit(kept).cast("long"))))
    return F.array(*keys)


def near(queries: DataFrame, all_prints: DataFrame, radius: int = 3, blocks: int = 5) -> DataFrame:
    """(fingerprint, other, n): each distinct query fingerprint, those within the radius, and their rows.

    Both sides have a column `fingerprint`. Equal fingerprints are one row of the tables (with their
    number), so copies do not multiply. A pair that meets in several tables is reported once.
    """
    if not 0 < radius < blocks:
        raise ValueError("the radius must be above 0 and below the number of blocks")
    stored = all_prints.groupBy("fingerprint").agg(F.count("*").alias("n"))
    tables = stored.select(F.explode(block_keys(F.col("fingerprint"), radius, blocks)).alias("key"), F.col("fingerprint").alias("other"), "n")
    asked = queries.select("fingerprint").distinct().select("fingerprint", F.explode(block_keys(F.col("fingerprint"), radius, blocks)).alias("key"))
    close = F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("other"))) <= radius
    met = asked.join(tables, "key").where(close)
    return met.groupBy("fingerprint", "other").agg(F.first("n").alias("n"))
