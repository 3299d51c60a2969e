"""Nearest neighbours by largest inner product: multiprobe p-stable hashing, exact reranking.

Vectors of one width and of similar norm form a band. With M the band's largest norm, a vector x becomes
(x / M, sqrt(1 - |x|^2 / M^2)), a query q becomes (q / |q|, 0): both have length 1 and their distance falls as
the inner product grows, so the nearest neighbours are those wanted. Each table hashes them by floor((a.x + b) / WIDTH) for
several normal vectors a; the numbers together name a bucket.

Given a query's projection, that of a neighbour at cosine c is normal with mean c times it and
variance 1 - c^2. This gives the probability of each value of each hash, and by their product the estimated success of a
bucket, the query's own or one perturbed in any number of hashes. Buckets are visited in the order of estimated success until
those visited hold a neighbour with a probability of HIT in a table; where that point lies follows from the
distribution of the logarithm's sum, so no list of buckets is made: a bucket is visited if its
estimate is high enough. c is measured: the inner product at rank k of a bounded sample of queries.

Buckets live in regions, named by their first hashes, which a query meets whole or not at all. A task holds
part of a region and some of its queries, visits buckets by matrix products, and keeps the k best.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logsieve.llm.runtime import Scratch, ship

VALUES = 8  # of a hash, -4 to 3; the outer ones reach to infinity
WIDTH = 1.0  # of a hash's value, in standard deviations of the projections
BITS = 2.0  # that a hash tells, about
BUCKET = 64  # vectors in a bucket, on average
REGION = 1 << 18  # vectors in a region, on average
LEAST_REGIONS = 8  # for parallel work on small tables
PART = 1 << 18  # vectors of a region that one task holds
TEAM = 1 << 15  # queries that one task holds
WHOLE = 4096  # bands of fewer vectors are compared whole
SAMPLE = 128  # queries from which the nearness of neighbours is measured
LOW = 0.1  # share of the sample whose neighbours may be further
BINS, GRAIN = 400, 0.1  # of the logarithm of an estimate
HELD = 1 << 21  # candidates that are held before they are reduced
TABLE = np.linspace(-6, 6, 4097)
NORMAL = np.array([0.5 * (1 + math.erf(x / math.sqrt(2))) for x in TABLE])


@dataclass(frozen=True)
class Search:
    k: int = 20
    tables: int = 2
    found: float = 0.96  # probability that a neighbour at the measured cosine is found in some table
    seed: int = 13


def hashes(count: int) -> int:
    """Hashes of a table for so many vectors."""
    return max(2, round(math.log2(max(2, count / BUCKET)) / BITS))


def prefix(count: int) -> int:
    """How many of them name a region."""
    regions = max(LEAST_REGIONS, count / REGION)
    return min(hashes(count), max(1, math.ceil(math.log2(4 * regions) / BITS)))


def projections(x: np.ndarray, rest: np.ndarray, width: int, many: int, opt: Search) -> tuple[np.ndarray, np.ndarray]:
    """((n, tables, hashes) of unit vectors (x, rest), shifted and in units of WIDTH; the shifts)."""
    drawn = np.random.default_rng([opt.seed, width])
    axes, shift = drawn.normal(size=(opt.tables * 32, width + 1)), drawn.random(opt.tables * 32)
    use = (np.arange(opt.tables)[:, None] * 32 + np.arange(many)).ravel()
    flat = x @ axes[use, :width].T + rest[:, None] * axes[use, width] + WIDTH * shift[use]
    return (flat / WIDTH).reshape(len(x), opt.tables, many), shift[use].reshape(opt.tables, many)


def cells(flat: np.ndarray) -> np.ndarray:
    """Values of the hashes, 0 to VALUES - 1."""
    return np.clip(np.floor(flat).astype(np.int64) + VALUES // 2, 0, VALUES - 1)


def costs(flat: np.ndarray, shift: np.ndarray, cosine: float) -> np.ndarray:
    """(n, hashes, VALUES): minus the logarithm of each value's probability for a neighbour, in GRAIN."""
    spread = math.sqrt(1 - cosine**2)
    mean = cosine * (flat - shift) + shift
    edges = np.concatenate([[-np.inf], np.arange(1, VALUES) - VALUES // 2, [np.inf]])
    upto = np.interp((edges - mean[..., None]) * WIDTH / spread, TABLE, NORMAL)
    with np.errstate(divide="ignore"):
        cost = -np.log(np.diff(upto, axis=-1)) / GRAIN
    return np.minimum(np.rint(cost), BINS).astype(np.int16)


def limits(cost: np.ndarray, share: float) -> np.ndarray:
    """The cost up to which buckets must be visited, so that they hold a neighbour with probability `share`."""
    n, many, _ = cost.shape
    mass = np.zeros((n, BINS + 1))
    mass[:, 0] = 1
    at = np.arange(BINS + 1)
    for h in range(many):
        after = np.zeros_like(mass)
        for v in range(VALUES):
            c = cost[:, h, v].astype(np.int64)[:, None]
            moved = np.take_along_axis(mass, np.maximum(at - c, 0), axis=1)
            after += np.where(at >= c, moved, 0) * np.exp(-GRAIN * c)
        mass = after
    reached = np.cumsum(mass, axis=1)
    return (reached < share * reached[:, -1:]).sum(axis=1)


def code(values: np.ndarray) -> np.ndarray:
    out = np.zeros(values.shape[:-1], np.int64)
    for h in range(values.shape[-1]):
        out = out * VALUES + values[..., h]
    return out


def region(codes: np.ndarray, count: int) -> np.ndarray:
    mixed = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(33)) % np.uint64(max(LEAST_REGIONS, -(-count // REGION)))).astype(np.int64)


def regions_met(cost: np.ndarray, limit: np.ndarray, count: int) -> list[np.ndarray]:
    """Regions that hold a bucket whose cost is within each query's limit."""
    head = prefix(count)
    least = cost[:, head:].min(axis=2).sum(axis=1, dtype=np.int64)
    total = np.zeros((len(cost), 1), np.int64)
    for h in range(head):
        total = (total[:, :, None] + cost[:, None, h]).reshape(len(cost), -1)
    names = region(np.arange(VALUES**head), count)
    return [np.unique(names[row]) for row in total + least[:, None] <= limit[:, None]]


def _matrix(lists: pa.Array) -> np.ndarray:
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(lists), -1)


def _by_width(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    widths = np.diff(batch.column("v").offsets.to_numpy())
    for w in np.unique(widths):
        yield int(w), batch.take(pa.array(np.flatnonzero(widths == w)))


def unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors, logarithm of the norms to base 2); squares neither overflow nor vanish."""
    x = x.astype(np.float64)
    top = np.abs(x).max(axis=1)
    x = x / top[:, None]
    norm = np.linalg.norm(x, axis=1)
    return x / norm[:, None], np.log2(norm) + np.log2(top)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for w, some in _by_width(batch):
            x = _matrix(some.column("v"))
            plain = x.astype(np.float64) + 0.0  # no negative zero
            names = [hashlib.blake2b(r.tobytes(), digest_size=16).digest() for r in plain]
            size = unit(plain)[1]
            made = [pa.array(names, pa.binary()), pa.array(np.full(len(x), w, np.int32)), pa.array(np.rint(size).astype(np.int32)), pa.array(size)]
            yield pa.RecordBatch.from_arrays([*some.columns, *made], ["id", "v", "name", "width", "band", "size"])


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v, name, width, band, size) of the rows that take part; name: 128 bits of the vector's components."""
    field = vectors.schema[vector_col].dataType.simpleString()
    v = F.col(vector_col) if field in ("array<float>", "array<double>") else F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.coalesce(finite & F.exists("v", lambda x: x != 0), F.lit(False)))
    kind = rows.schema["v"].dataType.simpleString()
    return rows.mapInArrow(_measured, f"id long, v {kind}, name binary, width int, band int, size double")


def _near_sample(sample: dict[int, np.ndarray], k: int):
    """Per batch and sampled query the k + 1 largest inner products with its unit vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w, some in _by_width(batch):
                if w not in sample:
                    continue
                scores = np.sort(sample[w] @ _matrix(some.column("v")).astype(np.float64).T, axis=1)[:, -k - 1 :]
                queries = np.repeat(np.arange(len(scores)), scores.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(queries), w, np.int32)), pa.array(queries.astype(np.int32)), pa.array(scores.ravel())], ["width", "query", "score"])

    return run


def nearness(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(width, near): an inner product that all but LOW of the sampled queries' k neighbours reach, for a unit query."""
    drawn = queries.dropDuplicates(["name"]).orderBy("name").limit(SAMPLE).select("v").collect()
    sample: dict[int, list] = {}
    for r in drawn:
        sample.setdefault(len(r.v), []).append(r.v)
    units = {w: unit(np.array(x))[0] for w, x in sample.items()}
    scores = rows.select("v").mapInArrow(_near_sample(units, k), "width int, query int, score double")
    rank = F.row_number().over(Window.partitionBy("width", "query").orderBy(F.desc("score")))
    last = scores.withColumn("rank", rank).where(F.col("rank") <= k + 1).groupBy("width", "query").agg(F.min("score").alias("last"))
    return last.groupBy("width").agg(F.percentile("last", LOW).alias("near"))


def _placed(opt: Search):
    """Each vector class in its region of every table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count, top = batch.column("count").to_numpy(), batch.column("top").to_numpy()
            widths = np.diff(batch.column("v").offsets.to_numpy())
            for w, n in set(zip(widths.tolist(), count.tolist(), strict=True)):
                at = np.flatnonzero((widths == w) & (count == n))
                some = batch.take(pa.array(at))
                x, size = unit(_matrix(some.column("v")))
                share = np.minimum(np.exp2(size - top[at]), 1)
                flat, _ = projections(x * share[:, None], np.sqrt(1 - share**2), w, hashes(n), opt)
                found = cells(flat)
                for t in range(opt.tables):
                    named = region(code(found[:, t, : prefix(n)]), n)
                    yield pa.RecordBatch.from_arrays([
                        *(some.column(c) for c in ("width", "band", "count")), pa.array(np.full(len(x), t, np.int32)), pa.array(named),
                        pa.array(code(found[:, t])), *(some.column(c) for c in ("name", "least", "more", "v")),
                    ], ["width", "band", "count", "tab", "region", "code", "name", "least", "more", "v"])

    return run


def query_costs(x: np.ndarray, count: int, cosine: float, opt: Search) -> np.ndarray:
    """(n, tables, hashes, VALUES)"""
    flat, shift = projections(x, np.zeros(len(x)), x.shape[1], hashes(count), opt)
    return np.stack([costs(flat[:, t], shift[t], cosine) for t in range(opt.tables)], axis=1)


def _sent(opt: Search):
    """Each query to every region that it meets, with the cost up to which it visits buckets there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share = 1 - (1 - opt.found) ** (1 / opt.tables)
        for batch in batches:
            keys = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("width", "band", "count", "cosine")]
            for w, band, n, cosine in set(zip(*(k.tolist() for k in keys), strict=True)):
                at = np.flatnonzero((keys[0] == w) & (keys[1] == band) & (keys[2] == n) & (keys[3] == cosine))
                some = batch.take(pa.array(at))
                cost = query_costs(unit(_matrix(some.column("v")))[0], n, cosine, opt)
                for t in range(opt.tables):
                    whole = cosine <= 0  # nothing is known of the neighbours: every bucket of the first table, and no other
                    if whole and t:
                        continue
                    limit = np.full(len(at), np.iinfo(np.int32).max) if whole else limits(cost[:, t], share)
                    met = regions_met(cost[:, t], limit, n)
                    row = np.repeat(np.arange(len(at)), [len(m) for m in met])
                    take = some.take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([
                        *(take.column(c) for c in ("width", "band", "count")), pa.array(np.full(len(row), t, np.int32)),
                        pa.array(np.concatenate(met)), pa.array(limit[row].astype(np.int32)), *(take.column(c) for c in ("cosine", "query", "v")),
                    ], ["width", "band", "count", "tab", "region", "limit", "cosine", "query", "v"])

    return run


class _Best:
    """The k best candidates of each query, ties by the least id of the candidate's class."""

    def __init__(self, q: np.ndarray, x: np.ndarray, least: np.ndarray, k: int):
        self.q, self.x, self.least, self.k = q, x, least, k
        self.worst = np.full(len(q), -np.inf)
        self.rows, self.found, self.held = [], [], 0

    def add(self, rows: np.ndarray, found: np.ndarray) -> None:
        self.rows.append(rows)
        self.found.append(found)
        self.held += len(rows)
        if self.held > HELD:
            self.reduce()

    def reduce(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, candidate, score): one summation for all, wherever a product was made."""
        rows, found = np.concatenate([*self.rows, np.zeros(0, np.int64)]), np.concatenate([*self.found, np.zeros(0, np.int64)])
        score = np.zeros(len(rows))
        for i in range(0, len(rows), 1 << 16):
            some = slice(i, i + (1 << 16))
            score[some] = (self.q[rows[some]].astype(np.float64) * self.x[found[some]].astype(np.float64)).sum(axis=1)
        order = np.lexsort((self.least[found], -score, rows))
        rows, found, score = rows[order], found[order], score[order]
        nth = np.arange(len(rows)) - np.searchsorted(rows, rows)
        keep = nth < self.k
        last = nth == self.k - 1
        self.worst[rows[last]] = score[last]
        rows, found, score = rows[keep], found[keep], score[keep]
        self.rows, self.found, self.held = [rows], [found], 0
        return rows, found, score


def _visit(opt: Search):
    def run(key: tuple, vectors: pa.Table, queries: pa.Table) -> pa.Table:
        kinds = [("query", pa.binary()), ("name", pa.binary()), ("least", pa.int64()), ("more", pa.list_(pa.int64())), ("score", pa.float64())]
        schema = pa.schema(kinds)
        if not len(vectors) or not len(queries):
            return schema.empty_table()
        count, tab = key[2].as_py(), key[3].as_py()
        x, q = _matrix(vectors["v"]), _matrix(queries["v"])
        codes, limit = vectors["code"].to_numpy(), queries["limit"].to_numpy()
        cosine = queries["cosine"].to_numpy()
        cost = np.zeros((len(q), hashes(count), VALUES), np.int16)
        for c in np.unique(cosine):
            some = cosine == c
            cost[some] = query_costs(unit(q[some])[0], count, float(c), opt)[:, tab]
        order = np.argsort(codes, kind="stable")
        starts = np.flatnonzero(np.diff(codes[order], prepend=-1))
        best = _Best(q, x, vectors["least"].to_numpy(), opt.k + 1)
        size = np.linalg.norm(q.astype(np.float64), axis=1)
        for at, until in zip(starts.tolist(), [*starts[1:].tolist(), len(order)], strict=True):
            bucket, total = int(codes[order[at]]), np.zeros(len(q), np.int64)
            for h in range(cost.shape[1] - 1, -1, -1):
                total += cost[:, h, bucket % VALUES]
                bucket //= VALUES
            visiting = np.flatnonzero(total <= limit)
            for a in range(at, until, 1 << 12):
                some = order[a : min(until, a + (1 << 12))]
                block = x[some].astype(np.float64)
                slack = 1e-9 * size * np.linalg.norm(block, axis=1).max()
                for i in range(0, len(visiting), 1 << 10):
                    rows = visiting[i : i + (1 << 10)]
                    near = q[rows].astype(np.float64) @ block.T >= (best.worst - slack)[rows][:, None]
                    r, c = np.nonzero(near)
                    best.add(rows[r], some[c])
            if at == 0:
                best.reduce()  # a first bound
        rows, found, score = best.reduce()
        named = vectors.select(["name", "least", "more"]).take(pa.array(found))
        return pa.Table.from_arrays([queries["query"].take(pa.array(rows)), *named.columns, pa.array(score)], schema=schema)

    return run


def nearest(vectors: DataFrame, asked: Column, scratch: Scratch, id_col: str = "vec_id", vector_col: str = "embedding", opt: Search = Search()) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows with the largest inner products found, for each row where `asked` holds.

    `asked` is a condition on the long column `id`. The scores are exact, in double precision; equal ones are
    ranked by ascending id. Rows with a null id, and vectors that are null, empty, zero or hold a null or a
    non-finite number take no part; vectors of other widths are no candidates. A query's own row is no candidate of it, and
    rows that repeat an id and a vector are one; an id with two vectors is two rows, each searched for
    itself. Bands of fewer than WHOLE vectors are compared whole; elsewhere a neighbour is found with a probability of about
    `opt.found`. Equal vectors are searched, and are candidates, once, with the k + 1 least ids of
    theirs: more can never be among the k best.
    """
    ship(vectors.sparkSession)
    rows = usable(vectors, id_col, vector_col)
    bands = rows.groupBy("width", "band").agg(F.count("*").alias("count"), F.max("size").alias("top"))
    bands = scratch.save(bands, "bands")
    queries = rows.where(asked)

    nth = F.dense_rank().over(Window.partitionBy("name").orderBy("id"))
    first = rows.withColumn("nth", nth).where(F.col("nth") <= opt.k + 1)
    classes = first.groupBy("name", "width", "band").agg(F.first("v").alias("v"), F.min("id").alias("least"), F.collect_set("id").alias("ids"))
    more = F.when(F.size("ids") > 1, F.array_sort("ids"))
    kind = rows.schema["v"].dataType.simpleString()
    where = "width int, band int, count long, tab int, region long"
    held = classes.join(bands, ["width", "band"]).select("width", "band", "count", "top", "name", "least", more.alias("more"), "v")
    placed = held.mapInArrow(_placed(opt), f"{where}, code long, name binary, least long, more array<long>, v {kind}")

    cosine = F.coalesce(F.col("near") / F.pow(F.lit(2.0), "top"), F.lit(0.0))
    known = bands.join(nearness(rows, queries, opt.k), "width", "left")
    known = known.withColumn("cosine", F.when(F.col("count") < WHOLE, 0.0).otherwise(F.greatest(F.least(cosine, F.lit(0.99)), F.lit(0.0))))
    known = scratch.save(known.select("width", "band", "count", "cosine"), "known")
    distinct = queries.groupBy(F.col("name").alias("query"), "width").agg(F.first("v").alias("v"))
    sent = distinct.join(known, "width").select("width", "band", "count", "cosine", "query", "v").mapInArrow(
        _sent(opt), f"{where}, limit int, cosine double, query binary, v {kind}"
    )

    keys = ["width", "band", "count", "tab", "region"]
    placed, sent = scratch.save(placed, "placed"), scratch.save(sent, "sent")
    parts = placed.groupBy(*keys).agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    teams = sent.groupBy(*keys).agg(F.ceil(F.count("*") / TEAM).cast("int").alias("teams"))
    cut = scratch.save(parts.join(teams, keys), "cut")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    share = lambda column, n: F.pmod(F.xxhash64(column), F.col(n)).cast("int")
    left = placed.join(cut, keys).withColumn("part", share("name", "parts")).withColumn("team", every("teams")).drop("parts", "teams")
    right = sent.join(cut, keys).withColumn("team", share("query", "teams")).withColumn("part", every("parts")).drop("parts", "teams")
    block = [*keys, "part", "team"]
    found = left.groupBy(*block).cogroup(right.groupBy(*block)).applyInArrow(
        _visit(opt), "query binary, name binary, least long, more array<long>, score double"
    )

    # a class comes at most once from each table
    order = Window.partitionBy("query").orderBy(F.desc("score"), "least", "name")
    some = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= opt.tables * (opt.k + 1)).dropDuplicates(["query", "name"])
    each = some.select("query", (F.col("query") == F.col("name")).alias("same"), "score", F.explode(F.coalesce("more", F.array("least"))).alias("vec_id"))
    by_score = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    best = scratch.save(each.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= opt.k + 1).drop("rank"), "best")
    scratch.drop(placed, sent)
    ids = queries.select(F.col("id").alias("query_id"), F.col("name").alias("query")).distinct()
    others = ids.join(best, "query").where(~(F.col("same") & (F.col("vec_id") == F.col("query_id"))))
    rank = F.row_number().over(Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id"))
    return others.withColumn("rank", rank).where(F.col("rank") <= opt.k).select("query_id", "rank", "vec_id", "score")
