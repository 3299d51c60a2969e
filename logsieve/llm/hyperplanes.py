"""Near-duplicate vectors: random-hyperplane signs in several tables, exact cosines, components.

Vectors that agree on the signs of all hyperplanes of some table share its bucket. Inside a bucket exact
cosines are matrix products in double precision. A pair that meets in several tables counts in the first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsieve.llm.components import components
from logsieve.llm.runtime import Scratch, ship

TABLES, BITS = 16, 10
BLOCK = 1024  # vectors of a bucket's part; parts are compared two by two
TEAM = 2048  # rows of the buckets that one call of the comparison gets, on average


def planes(width: int, tables: int, bits: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, width]).normal(size=(tables * bits, width))


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _bucketed(tables: int, bits: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            lists = batch.column("v")
            width = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.cumsum(width)])
            for w in np.unique(width):
                rows = np.flatnonzero(width == w)
                x = flat[starts[rows][:, None] + np.arange(w)].astype(np.float64)
                known.setdefault(int(w), planes(int(w), tables, bits, seed))
                signs = (unit(x) @ known[int(w)].T > 0).reshape(len(rows), tables, bits)
                sig = (signs * (1 << np.arange(bits))).sum(axis=2).astype(np.int32)
                sigs = pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * tables, pa.array(sig.ravel()))
                some = batch.take(pa.array(rows))
                for t in range(tables):
                    n = len(rows)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, w, np.int32)), pa.array(np.full(n, t, np.int32)), pa.array(sig[:, t]), some.column("rep"), some.column("copies"), sigs, some.column("v")], ["width", "tab", "bucket", "rep", "copies", "sig", "v"])

    return run


def _block(threshold: float):
    def links(x, sig, part, copies, tab, cross) -> tuple[np.ndarray, np.ndarray]:
        """(other vectors linked first in this table, least position that such links reach)."""
        close = np.triu(x @ x.T >= threshold, 1)
        if cross:  # two parts of a bucket: pairs inside a part are another block's
            close &= part[:, None] != part[None]
        a, b = np.nonzero(close)
        new = np.ones(len(a), bool)
        for t in range(tab):
            new &= sig[a, t] != sig[b, t]
        a, b = a[new], b[new]
        near = np.zeros(len(x), np.int64)
        np.add.at(near, a, copies[b])
        np.add.at(near, b, copies[a])
        label = np.arange(len(x))
        while len(a):  # least label around, until nothing moves
            before = label.copy()
            least = np.minimum(label[a], label[b])
            np.minimum.at(label, a, least)
            np.minimum.at(label, b, least)
            label = label[label]
            if (label == before).all():
                break
        return near, label

    def run(team: pd.DataFrame) -> pd.DataFrame:
        near, other = np.zeros(len(team), np.int64), team["rep"].to_numpy(object).copy()
        columns = [team[c].to_numpy() for c in ("rep", "copies", "part")]
        sigs = np.stack(team["sig"].to_numpy())
        for (_, tab, _, i, j), rows in team.groupby(["width", "tab", "bucket", "i", "j"]).indices.items():
            rep, copies, part = (c[rows] for c in columns)
            x = unit(np.stack(team["v"].to_numpy()[rows]).astype(np.float64))
            near[rows], label = links(x, sigs[rows], part, copies, int(tab), i != j)
            other[rows] = rep[label]
        return pd.DataFrame({"rep": columns[0], "near": near, "other": other})[near > 0]

    return run


def near_vectors(vectors: DataFrame, scratch: Scratch, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, tables: int = TABLES, bits: int = BITS, seed: int = 7) -> DataFrame:
    """(id, n_links, component, kept) per row of vectors.

    n_links counts the other vectors found with a cosine of at least `threshold`; component is the least id
    that links reach, the own one without links. Vectors that are null, empty, zero, or hold a null or a
    non-finite number link with nothing, and so do vectors of different widths with each other. Rows with
    equal id and vector are one vector, and get the same result; several vectors of one id are each linked
    on their own; rows with a null id are compared with nothing, get no links, a null component, and are not kept. A pair at the threshold is found with
    probability 1-(1-p**bits)**tables, p = 1-acos(threshold)/pi: 0.98 with the defaults at 0.9. Equal vectors
    are one node with a count. Parts of a crowded bucket meet two by two; no task holds a bucket whole.
    """
    ship(vectors.sparkSession)
    numbers = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), numbers.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(F.col("id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0), F.lit(False))
    named = rows.withColumn("usable", usable).withColumn("name", F.when(F.col("usable"), F.unhex(F.sha2(F.col("v").cast("string"), 256))))
    classes = named.where("usable").groupBy("name").agg(F.min("id").alias("least"), F.count_distinct("id").alias("copies"), F.first("v").alias("v"))
    classes = scratch.save(classes, "classes")
    # a node is a vector, named by its hash: an id may have several vectors, which are not linked by that
    buckets = classes.select(F.col("name").alias("rep"), "copies", "v").mapInArrow(_bucketed(tables, bits, seed), "width int, tab int, bucket int, rep binary, copies long, sig array<int>, v array<double>")
    sizes = buckets.groupBy("width", "tab", "bucket").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"), F.count("*").alias("n")).where("n > 1")
    sizes = scratch.save(sizes, "sizes")
    teams = sizes.agg((F.sum(F.col("n") * F.col("parts")) / TEAM).alias("t")).first()["t"] or 0
    cut = buckets.join(F.broadcast(sizes), ["width", "tab", "bucket"])  # at most tables * 2**bits rows a width
    cut = cut.withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    meet = cut.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    blocks = meet.select("width", "tab", "bucket", F.least("part", "with").alias("i"), F.greatest("part", "with").alias("j"), "part", "rep", "copies", "sig", "v")
    dealt = blocks.withColumn("team", F.pmod(F.xxhash64("width", "tab", "bucket", "i", "j"), F.lit(int(teams) + 1)))
    found = scratch.save(dealt.groupBy("team").applyInPandas(_block(threshold), "rep binary, near long, other binary"), "found")
    counts = found.groupBy("rep").agg(F.sum("near").alias("near"))
    reached = components(found.select(F.col("rep").alias("a"), F.col("other").alias("b")), scratch).withColumnRenamed("node", "rep")
    nodes = classes.select(F.col("name").alias("rep"), "least", "copies").join(reached, "rep", "left")
    nodes = scratch.save(nodes.withColumn("cluster", F.coalesce("component", "rep")).drop("component"), "nodes")
    ids = nodes.groupBy("cluster").agg(F.min("least").alias("component"))
    known = nodes.join(ids, "cluster").join(counts, "rep", "left")
    links = (F.coalesce("near", F.lit(0)) + F.col("copies") - 1).alias("links")
    known = scratch.save(known.select(F.col("rep").alias("name"), links, "component"), "known")
    out = named.select("id", "name").join(known, "name", "left")
    component = F.coalesce("component", "id")
    return out.select("id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
