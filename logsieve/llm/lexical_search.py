"""Ranked lexical search: a sharded inverted index, searched by Block-Max MaxScore.

Documents are dealt into shards, each with its own inverted lists: postings in blocks of BLOCK, compressed,
beside each block its first and last document, its largest frequency and its shortest document. Those
bound the score of any posting in the block, whatever the statistics of the whole table are, so shards can
be added to an index without touching the others.

A query is searched in every shard. The lists whose bounds together cannot beat the k-th score found so far
are not essential: only documents of the other lists are candidates. A candidate's bound
adds the block maxima of the lists that are not essential; if that cannot beat the k-th score, it is
rejected before any of their blocks is decompressed. What remains is looked up list by list, the list with the
largest bound first, and checked again after each. The shards' heaps are merged by rank.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logsieve.llm.runtime import Scratch, ship

BLOCK = 128  # postings
SHARD_TERMS = 1 << 21  # occurrences after which a shard is closed
WINDOW = 2048  # documents of a shard that are scored together
ITEMS = 256  # queries that meet a shard together, on average
SLICE = 1 << 20  # bytes of a text that are cut into terms at once
#: A-Z become a-z; digits, a-z and all beyond ASCII stay; the rest parts terms.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or chr(b).isalnum() else 32 for b in range(256))
TYPES = {0: None, 1: "u1", 2: "<u2", 4: "<u4"}
INDEX = (
    "shard long, term binary, count long, firsts array<int>, lasts array<int>, sizes array<int>, shapes array<int>, "
    "most array<int>, shortest array<int>, payload binary, ids array<long>, lengths array<int>"
)


def terms(data: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, in order, a slice at a time."""
    clean, at = data.translate(LETTERS), 0
    while len(clean) - at > SLICE and (end := clean.find(b" ", at + SLICE)) >= 0:
        yield clean[at:end].split()
        at = end + 1
    yield (clean[at:] if at else clean).split()


class _Numbers(dict):
    def __missing__(self, term: bytes) -> int:
        found = self[term] = len(self)
        return found


def compress(gaps: np.ndarray, tfs: np.ndarray, block: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, shape of each block, where each begins): gaps, then frequencies less one, in as few bytes as a block needs."""
    sizes = np.diff(np.append(starts, len(gaps)))
    width = lambda x: np.digitize(np.maximum.reduceat(x, starts), [1, 1 << 8, 1 << 16])
    widths = np.array([0, 1, 2, 4])
    wide_gap, wide_tf = widths[width(gaps)], widths[width(tfs - 1)]
    begins = np.concatenate([[0], np.cumsum(sizes * (wide_gap + wide_tf))])
    out = np.zeros(begins[-1], np.uint8)
    place = np.arange(len(gaps)) - starts[block]
    for values, wide, base in ((gaps, wide_gap, begins[:-1]), (tfs - 1, wide_tf, begins[:-1] + sizes * wide_gap)):
        at, own = base[block] + place * wide[block], wide[block]
        for k in range(4):
            some = own > k
            out[at[some] + k] = values[some] >> (8 * k) & 255
    return out, wide_gap * 8 + wide_tf, begins


def expand(payload: memoryview, at: int, size: int, shape: int, first: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents, frequencies) of a block."""
    wide_gap, wide_tf = shape >> 3, shape & 7
    part = lambda wide, at: np.frombuffer(payload, TYPES[wide], size, at).astype(np.int64) if wide else np.zeros(size, np.int64)
    return first + np.cumsum(part(wide_gap, at)), part(wide_tf, at + size * wide_gap) + 1


class _Shard:
    def __init__(self):
        self.ids: list[int | None] = []
        self.lengths: list[int] = []
        self.numbers, self.words, self.held = _Numbers(), [], 0

    def add(self, ident: int | None, text: bytes) -> None:
        n = 0
        for some in terms(text):
            self.words.append(np.fromiter(map(self.numbers.__getitem__, some), np.int64, len(some)))
            n += len(some)
        if n:
            self.ids.append(ident)
            self.lengths.append(n)
            self.held += n

    def table(self, name: int) -> pa.RecordBatch:
        """The shard's lists by term, and first one row with the ids and lengths of its documents, by id."""
        order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is None, self.ids[i] or 0))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        lengths = np.array(self.lengths, np.int64)
        codes = np.concatenate(self.words) << 32 | np.repeat(place, lengths)
        codes, tfs = np.unique(codes, return_counts=True)
        term, doc = codes >> 32, codes & 0xFFFFFFFF
        heads = np.flatnonzero(np.diff(term, prepend=-1))
        nth = np.arange(len(term)) - np.repeat(heads, np.diff(np.append(heads, len(term))))
        starts = np.flatnonzero(nth % BLOCK == 0)
        block = np.cumsum(nth % BLOCK == 0) - 1
        gaps = np.diff(doc, prepend=0)
        gaps[starts] = 0
        data, shapes, begins = compress(gaps, tfs, block, starts)
        sizes = np.diff(np.append(starts, len(term)))
        by_block = [doc[starts], doc[starts + sizes - 1], sizes, shapes, np.maximum.reduceat(tfs, starts), np.minimum.reduceat(lengths[order][doc], starts)]
        lists = np.append(np.searchsorted(starts, heads), len(starts)).astype(np.int32)
        rows = len(heads) + 1
        offsets = np.concatenate([[0], lists]).astype(np.int32)  # the first row has no block
        array = lambda x: pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.astype(np.int32)))
        parts = [data[a:b].tobytes() for a, b in zip(begins[lists[:-1]].tolist(), begins[lists[1:]].tolist(), strict=True)]
        only_first = lambda x, kind: pa.array([x, *[None] * (rows - 1)], kind)
        return pa.RecordBatch.from_arrays([
            pa.array(np.full(rows, name)), pa.array([b"", *self.numbers], pa.binary()), pa.array(np.append(len(order), np.diff(np.append(heads, len(term))))),
            *map(array, by_block), pa.array([b"", *parts], pa.binary()),
            only_first([self.ids[i] for i in order], pa.list_(pa.int64())), only_first(lengths[order], pa.list_(pa.int32())),
        ], [c.split()[0] for c in INDEX.split(", ")])


def _indexed(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, name = _Shard(), TaskContext.get().partitionId() << 32
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            for ident, text in zip(batch.column("id").to_pylist(), texts, strict=True):
                shard.add(ident, text.as_py() or b"")
                if shard.held >= most:
                    yield shard.table(name)
                    shard, name = _Shard(), name + 1
        if shard.held:
            yield shard.table(name)

    return run


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_terms: int = SHARD_TERMS) -> DataFrame:
    """The inverted lists of all terms of whole texts (columns INDEX), shard by shard; store it before it is searched.

    A null text has no term, and documents without a term are in no shard. Ids may be null or repeat; each row
    is a document of its own. A shard is closed after `shard_terms` occurrences, so only a text that is
    longer makes it larger.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_indexed(shard_terms), INDEX)


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for number, text in zip(batch.column("number").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
            found = list({t for some in terms(text.as_py() or b"") for t in some})
            yield pa.RecordBatch.from_arrays([pa.array([number] * len(found), pa.int64()), pa.array(found, pa.binary())], ["number", "term"])


class _List:
    """One term's postings in a shard; blocks are expanded when they are first looked into."""

    def __init__(self, row, lengths: np.ndarray, impact):
        self.weight = int(row.weight)
        self.firsts, self.lasts, self.sizes, self.shapes = (np.asarray(x, np.int64) for x in (row.firsts, row.lasts, row.sizes, row.shapes))
        self.bounds = self.weight * impact(np.asarray(row.most, np.int64), np.asarray(row.shortest, np.int64))
        self.bound = int(self.bounds.max())
        self.payload, self.lengths, self.impact = memoryview(row.payload), lengths, impact
        self.begins = np.concatenate([[0], np.cumsum(self.sizes * ((self.shapes >> 3) + (self.shapes & 7)))])
        self.expanded: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def block(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores)"""
        if b not in self.expanded:
            docs, tfs = expand(self.payload, int(self.begins[b]), int(self.sizes[b]), int(self.shapes[b]), int(self.firsts[b]))
            self.expanded[b] = docs, self.weight * self.impact(tfs, self.lengths[docs])
        return self.expanded[b]

    def between(self, low: int, high: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for b in range(int(np.searchsorted(self.lasts, low)), int(np.searchsorted(self.firsts, high))):
            docs, scores = self.block(b)
            if docs[0] < low or docs[-1] >= high:
                some = slice(*np.searchsorted(docs, (low, high)))
                docs, scores = docs[some], scores[some]
            yield docs, scores

    def block_bounds(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(block, most that the list can add) for each document; block -1 where it holds none."""
        b = np.searchsorted(self.lasts, docs)
        inside = b < len(self.lasts)
        inside[inside] = self.firsts[b[inside]] <= docs[inside]
        return np.where(inside, b, -1), np.where(inside, self.bounds[np.minimum(b, len(self.lasts) - 1)], 0)

    def look_up(self, docs: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        found = np.zeros(len(docs), np.int64)
        for b in np.unique(blocks[blocks >= 0]).tolist():
            here = np.flatnonzero(blocks == b)
            known, scores = self.block(b)
            at = np.searchsorted(known, docs[here])
            hit = known[at] == docs[here]  # the block's last document is not less
            found[here[hit]] = scores[at[hit]]
        return found


def best(lists: list[_List], documents: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of the k highest scores above 0, highest first, equal ones by document.

    Documents are visited in ascending order, so a later one must have a higher score to replace another.
    """
    lists = sorted((x for x in lists if x.bound > 0), key=lambda x: x.bound)
    reach = np.cumsum([x.bound for x in lists])  # what the first lists can give together
    top_docs, top_scores, least = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    low, width = 0, max(k, WINDOW // 16)
    while low < documents:
        high = min(documents, low + width)
        width = min(WINDOW, width * 4)
        optional = int(np.searchsorted(reach, least, side="right")) if least else 0
        if optional == len(lists):
            break  # no document can still enter
        sums = np.zeros(high - low, np.int64)
        for one in lists[optional:]:
            for docs, scores in one.between(low, high):
                sums[docs - low] += scores
        docs = np.flatnonzero(sums) + low
        scores = sums[docs - low]
        rest = [one.block_bounds(docs) for one in lists[:optional]]
        hope = sum((bounds for _, bounds in rest), np.zeros(len(docs), np.int64))
        for turn in range(optional, -1, -1):  # turn lists are left to be looked up
            alive = scores + hope > least
            docs, scores, hope = docs[alive], scores[alive], hope[alive]
            rest = [(blocks[alive], bounds[alive]) for blocks, bounds in rest[:turn]]
            if turn and len(docs):
                blocks, bounds = rest[-1]
                scores, hope = scores + lists[turn - 1].look_up(docs, blocks), hope - bounds
        top_docs, top_scores = np.append(top_docs, docs), np.append(top_scores, scores)
        order = np.lexsort((top_docs, -top_scores))[:k]
        top_docs, top_scores = top_docs[order], top_scores[order]
        least = int(top_scores[-1]) if len(order) == k else 0
        low = high
    return top_docs, top_scores


def _searcher(documents: int, occurrences: int, k: int):
    def impact(tf: np.ndarray, n: np.ndarray) -> np.ndarray:
        if 90 * int(n.max(initial=0)) * documents < 1 << 63:
            m = 10 + 90 * n * documents // occurrences
        else:
            m = np.array([10 + 90 * x * documents // occurrences for x in n.tolist()], np.int64)
        return 1_000_000_000 * tf // (1000 * tf + 8 * m)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        """One shard and one block of queries: the lists of their terms, and the row with the documents."""
        lengths = ids = None
        by_item: dict[int, list[_List]] = {}
        for row in group.sort_values("term").itertuples():  # the documents' row has the empty term
            if not row.term:
                ids, lengths = row.ids, np.asarray(row.lengths, np.int64)
                continue
            one = _List(row, lengths, impact)
            for item in row.items:
                by_item.setdefault(int(item), []).append(one)
        items, found, scores = [], [], []
        for item, lists in by_item.items():
            docs, points = best(lists, len(lengths), k)
            items += [item] * len(docs)
            found += [ids[d] for d in docs.tolist()]
            scores += points.tolist()
        named = pd.array([None if x is None or x != x else int(x) for x in found], "Int64")
        return pd.DataFrame({"number": np.array(items, np.int64), "doc_id": named, "score": np.array(scores, np.int64)})

    return run


def search(lists: DataFrame, items: DataFrame, scratch: Scratch, k: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k highest-scoring documents of each row of items, scores above 0 only.

    `lists` is a stored index. Equal scores are ranked by ascending id, null ids last. Rows of items with
    equal texts are searched once and each get the ranking, also where ids repeat or are null; null and empty
    texts, and those whose terms no document has, get no row. Queries are dealt into groups of about ITEMS; a
    task holds a shard's lists for the terms of one group. Of a query's documents only
    the k best of a shard, then of a map task, are shuffled.
    """
    spark = lists.sparkSession
    ship(spark)
    heads = lists.where(F.col("term") == F.lit(b""))
    whole = heads.agg(F.sum("count"), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, n: a + n))).first()
    documents, occurrences = whole[0] or 0, whole[1] or 0
    rows = items.select(F.col(id_col).alias("item_id"), F.col(text_col).cast("string").alias("text"))
    texts = rows.where("text IS NOT NULL").select("text").distinct().select("text", F.monotonically_increasing_id().alias("number"))
    texts = scratch.save(texts, "texts")
    groups = max(1, -(-texts.count() // ITEMS))
    wanted = texts.mapInArrow(_item_terms, "number long, term binary").withColumn("group", F.pmod(F.xxhash64("number"), F.lit(groups)).cast("int"))
    asked = scratch.save(wanted.groupBy("term", "group").agg(F.collect_list("number").alias("items")), "terms")

    frequency = lists.where(F.col("term") != F.lit(b"")).join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("count").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(documents) + 2) / (2 * F.col("df") + 1))).cast("long")
    weighed = scratch.save(asked.join(frequency.select("term", weight.alias("weight")), "term"), "weights")
    hits = lists.drop("ids", "lengths").join(weighed, "term")
    every = heads.select("shard", "term", "ids", "lengths", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))
    met = hits.unionByName(every, allowMissingColumns=True)
    found = met.groupBy("shard", "group").applyInPandas(_searcher(documents, occurrences, k), "number long, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    ranked = scratch.save(found.withColumn("rank", rank).where(F.col("rank") <= k), "ranked")
    return rows.join(texts, "text").join(ranked, "number").select("item_id", "rank", "doc_id", "score")


#: The same for documents and benchmark in DuckDB's SQL, every document scored.
SEARCH_SQL = r"""
WITH pattern AS (SELECT '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+' AS p),
lowered AS (SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
d AS (SELECT doc_id, regexp_extract_all(text, p) AS terms FROM lowered, pattern),
whole AS (SELECT count(*) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS occurrences FROM d WHERE len(terms) > 0),
tf AS (SELECT doc_id, term, count(*) AS tf, any_value(n) AS n FROM (SELECT doc_id, len(terms) AS n, unnest(terms) AS term FROM d) GROUP BY doc_id, term),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), p)) AS term
  FROM benchmark, pattern),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w, n_docs, occurrences FROM df, whole),
s AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // occurrences)))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN tf USING (term) GROUP BY item_id, doc_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""
