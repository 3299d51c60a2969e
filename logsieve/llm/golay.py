"""SimHash near-duplicates through Golay-code fuzzy hashing.

The binary Golay code of length 23 is perfect: every word is within three bits of exactly one codeword. A
fingerprint is cut into three segments, each padded to a word. The codewords that a segment, or the segment
with one bit changed, decodes to are its keys (one to six). Two segments within two bits share a key:
some word is within one bit of both. With at most five differing bits in all, two of the three segments
have at most two each, so keys of two segments together find every pair; the pair is then verified.
Those keys have 24 bits, and chance meetings grow with the square of the table. With at most four differing bits, longer
keys do (33 to 36 bits). Either some segment is equal, and one of the other two has at most two differing bits: the key is that
segment itself with a codeword shared in the other one. Or each segment differs, two of them in one bit and
the third in one or two: the key is a codeword of all three. There it is enough to make those keys in which one codeword is the
segment's own: (one shared, the own one of the one text, the own one of the other) is among the keys of both.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsieve.llm.components import components
from logsieve.llm.runtime import Scratch, ship

SEGMENTS = (22, 21, 21)  # bits, from the lowest
GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
TOGETHER = 1 << 16  # shingles whose bits are held at once
SMALL = 48  # members of a bucket that are compared in one expression
BLOCK = 2048  # members of a larger bucket's part; parts are compared two by two


@lru_cache(maxsize=1)
def _decoder() -> tuple[np.ndarray, np.ndarray]:
    """(check bits of each 12-bit message, message change of each syndrome)."""
    parity = np.zeros(4096, np.int64)
    for message in range(4096):
        rest = message << 11
        for bit in range(22, 10, -1):
            if rest >> bit & 1:
                rest ^= GENERATOR << (bit - 11)
        parity[message] = rest
    flips = [0, *(1 << a for a in range(23)), *(1 << a | 1 << b for a in range(23) for b in range(a)), *(1 << a | 1 << b | 1 << c for a in range(23) for b in range(a) for c in range(b))]
    errors = np.array(flips, np.int64)
    change = np.zeros(2048, np.int64)
    change[parity[errors >> 11] ^ errors & 2047] = errors >> 11
    return parity, change


def decode(words: np.ndarray) -> np.ndarray:
    """Index (12 bits) of the codeword nearest to each 23-bit word."""
    parity, change = _decoder()
    return words >> 11 ^ change[parity[words >> 11] ^ words & 2047]


def segment_keys(words: np.ndarray, bits: int) -> np.ndarray:
    """(n, 6) indices of the codewords within reach of one changed bit, -1 where there are fewer."""
    ball = np.concatenate([words[:, None], words[:, None] ^ (1 << np.arange(bits))[None]], axis=1)
    found = np.sort(decode(ball), axis=1)
    new = np.concatenate([np.ones((len(words), 1), bool), found[:, 1:] != found[:, :-1]], axis=1)
    keys = np.full((len(words), 6), -1, np.int64)
    rows, columns = np.nonzero(new)
    keys[rows, (np.cumsum(new, axis=1) - 1)[rows, columns]] = found[rows, columns]
    return keys


def bucket_keys(prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): all keys of unsigned 64-bit fingerprints; two within the radius have one in common."""
    words, near, own, low = [], [], [], 0
    for bits in SEGMENTS:
        part = (prints >> np.uint64(low) & np.uint64((1 << bits) - 1)).astype(np.int64)
        words.append(part)
        near.append(segment_keys(part, bits))
        own.append(near[-1] == decode(part)[:, None])
        low += bits
    made = []
    if radius > 4:
        for kind, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
            a, b = near[i][:, :, None], near[j][:, None, :]
            made.append(np.where((a >= 0) & (b >= 0), kind << 40 | a << 12 | b, -1))
    else:
        for kind, (i, j) in enumerate((i, j) for i in range(3) for j in range(3) if i != j):
            made.append(np.where(near[j] >= 0, kind << 40 | words[i][:, None] << 12 | near[j], -1))
        x, y, z = near[0][:, :, None, None], near[1][:, None, :, None], near[2][:, None, None, :]
        some_own = own[0][:, :, None, None] | own[1][:, None, :, None] | own[2][:, None, None, :]
        made.append(np.where((x >= 0) & (y >= 0) & (z >= 0) & some_own, 6 << 40 | x << 24 | y << 12 | z, -1))
    table = np.concatenate([m.reshape(len(prints), -1) for m in made], axis=1)
    rows, columns = np.nonzero(table >= 0)
    return rows, table[rows, columns]


def simhash(text: str | None, shingle: int) -> int:
    """64 bits, each set in over half the XXH64 (seed 42) of the shingles of words; 0 without words.

    Words are runs without ASCII white space, A-Z lower-cased; fewer words than a shingle are one shingle.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(1, len(words) - shingle + 1)
    starts, stops = [0, *(ends[: n - 1] + 1).tolist()], ends[-n:].tolist()
    votes = np.zeros(64, np.int64)
    for i in range(0, n, TOGETHER):
        some = [xxhash.xxh64_intdigest(line[a:b], 42) for a, b in zip(starts[i : i + TOGETHER], stops[i : i + TOGETHER], strict=True)]
        raw = np.array(some, "<u8").view(np.uint8).reshape(len(some), 8)
        votes += np.unpackbits(raw, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view("<i8")[0])


def _simhashes(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = pa.array([simhash(t, shingle) for t in batch.column("text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in batch.schema.names if n != "text"), prints], [*(n for n in batch.schema.names if n != "text"), "fingerprint"])

    return run


def fingerprints(docs: DataFrame, text: Column, shingle: int = 4, **keep: Column) -> DataFrame:
    """The columns in `keep` and `fingerprint`; a null text counts as empty and gets 0."""
    ship(docs.sparkSession)
    rows = docs.select(*(c.alias(n) for n, c in keep.items()), text.alias("text"))
    schema = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.schema if f.name != "text")
    return rows.mapInArrow(_simhashes(shingle), f"{schema}fingerprint long")


def _keyed(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column("fingerprint").to_numpy()
            for i in range(0, len(prints), 4096):
                rows, keys = bucket_keys(prints[i : i + 4096].view(np.uint64), radius)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(prints[i : i + 4096][rows])], ["key", "fingerprint"])

    return run


def _block_links(radius: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        prints = np.unique(group["fingerprint"].to_numpy(np.int64))
        label = np.arange(len(prints))
        unsigned = prints.view(np.uint64)
        for i in range(len(prints)):
            close = np.flatnonzero(np.bitwise_count(unsigned[i:] ^ unsigned[i]) <= radius) + i
            labels = np.unique(label[close])
            if len(labels) > 1:
                label[np.isin(label, labels[1:])] = labels[0]
        return pd.DataFrame({"a": prints, "b": prints[label]}).query("a != b")

    return run


def links(prints: DataFrame, scratch: Scratch, radius: int = 4) -> DataFrame:
    """(a, b) links between distinct fingerprints whose closure connects all pairs within the radius.

    Buckets of up to SMALL members give every verified pair. Larger ones are cut into parts; each two
    parts meet in a task that compares them and gives a spanning forest, so a crowded bucket neither lands
    in one task nor yields all its pairs.
    """
    if radius > 5:
        raise ValueError("two segments have at most two differing bits each only up to a radius of 5")
    ship(prints.sparkSession)
    tasks = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a small table yields very many keys
    keys = prints.select("fingerprint").repartition(tasks).mapInArrow(_keyed(radius), "key long, fingerprint long")
    sizes = scratch.save(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    near = lambda a, b: F.bit_count(a.bitwiseXOR(b)) <= radius
    # the shared keys grow with the table, so they are never broadcast; both joins read one shuffle of the keys
    small = keys.join(sizes.where(F.col("n") <= SMALL).hint("merge"), "key").groupBy("key").agg(F.collect_list("fingerprint").alias("f"))
    found = F.flatten(F.transform("f", lambda a: F.transform(F.filter("f", lambda b: (b > a) & near(a, b)), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    pairs = small.select(F.explode(found).alias("p")).select("p.a", "p.b")
    parts = F.ceil(F.col("n") / BLOCK).cast("int")
    part = F.pmod(F.xxhash64("fingerprint"), F.col("parts")).cast("int")
    crowded = keys.join(sizes.where(F.col("n") > SMALL).hint("merge"), "key").withColumn("parts", parts).withColumn("part", part)
    meet = crowded.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    blocks = meet.select("key", "fingerprint", F.least("part", "with").alias("i"), F.greatest("part", "with").alias("j"))
    forest = blocks.groupBy("key", "i", "j").applyInPandas(_block_links(radius), "a long, b long")
    return pairs.union(forest).distinct()


def near_components(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """(id, h, fingerprint, label, component) per row; component: the least id that links within the radius reach.

    h is a hash of the text, label names the component also where no row of it has an id.

    Nulls: a null text counts as empty; rows with a null id take part and count as no id (a component of
    such rows alone has a null id). Empty texts have fingerprint 0 and are linked like any other.
    Rows with equal fingerprints are one node from the start, so copies cost nothing further.
    """
    rows = scratch.save(fingerprints(docs, F.col(text_col), shingle, id=F.col(id_col).cast("long"), h=F.xxhash64(text_col)), "rows")
    prints = scratch.save(rows.groupBy("fingerprint").agg(F.min("id").alias("least")), "prints")
    pairs = scratch.save(links(prints, scratch, radius), "pairs")
    found = components(pairs, scratch)
    labelled = scratch.save(prints.join(found, prints.fingerprint == found.node, "left").select("fingerprint", "least", F.coalesce("component", "fingerprint").alias("label")), "labelled")
    names = labelled.groupBy("label").agg(F.min("least").alias("component"))
    named = scratch.save(labelled.join(names, "label").select(F.col("fingerprint").alias("print"), "label", "component"), "named")
    scratch.drop(prints, pairs, labelled)
    return rows.join(named, rows.fingerprint == named.print).select("id", "h", "fingerprint", "label", "component")
