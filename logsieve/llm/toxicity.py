"""Toxicity by a chain of linear classifiers over word and word-stem presence.

Category k sees the words of a text, a few style numbers, and the scores of categories 0..k-1. For
training, those earlier scores come from models that did not see the document (out of fold), so the
later model learns how far it can trust them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsieve.llm.runtime import fresh_name, ship

WORD = re.compile(r"[^\W\d_]+")
STEMS = (4, 5)
STYLE = 4
FOLDS = 4
KNOWN_WORDS = 100_000  # entries of a worker's word cache before it is emptied


@dataclass
class Link:
    """One category of the chain: columns of hashed features, weights, and the threshold of a yes."""

    category: str
    columns: dict[int, int]
    weights: np.ndarray
    threshold: float


def word_features(word: str) -> list[int]:
    """Hashed features of a lower-case word: the word itself and its stems."""
    names = [word, *(f"{word[:n]}~" for n in STEMS if len(word) > n)]
    return [xxhash.xxh32_intdigest(n) for n in names]


def style(text: str, words: list[str], kinds: set[str]) -> list[float]:
    n = max(1, len(text))
    return [
        np.log1p(len(words)) / 10,
        len(kinds) / max(1, len(words)),
        sum(map(len, words)) / n,
        sum(map(str.isupper, text)) / n if not text.islower() else 0.0,
    ]


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        terms, styles = [], []
        for text in batch.column("text").to_pylist():
            words = WORD.findall((text or "").lower())
            kinds = set(words)
            terms.append(sorted({f for w in kinds for f in word_features(w)}))
            styles.append(style(text or "", words, kinds))
        columns = [batch.column("labels"), pa.array(terms, pa.list_(pa.int64())), pa.array(styles, pa.list_(pa.float32()))]
        yield pa.RecordBatch.from_arrays([batch.column("fold"), *columns], ["fold", "labels", "terms", "style"])


def train(docs: DataFrame, labels: DataFrame, categories: Sequence[str], sample: int = 6000, id_col: str = "doc_id", text_col: str = "text") -> list[Link]:
    """Fit the chain, in the order of `categories` (0/1 columns of `labels`).

    At most `sample` labelled documents are used: those with the least hashes of their ids. Their ids
    are broadcast (bounded by `sample`), so the texts are not shuffled. Documents whose labels are null
    or disagree with themselves count by their largest label; rows without text or id are left out.
    Without usable labels the chain says no with score 0.
    """
    spark = docs.sparkSession
    ship(spark)
    known = labels.select(F.col(id_col).alias("id"), *(F.col(c).cast("int").alias(f"y{k}") for k, c in enumerate(categories))).dropna()
    known = known.groupBy("id").agg(F.array(*(F.max(f"y{k}") for k in range(len(categories)))).alias("labels"))
    known = known.orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).dropna().join(F.broadcast(known), "id")
    # of repeated ids one text each, so that the rows are bounded as the ids are; in the same order at every run
    rows = rows.groupBy("id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("labels").alias("labels"))
    rows = rows.orderBy(F.xxhash64("id"), "id")
    fold = F.pmod(F.xxhash64(F.lit("fold"), "id"), F.lit(FOLDS)).cast("int").alias("fold")
    found = rows.select(fold, "labels", "text").mapInArrow(_features, "fold int, labels array<int>, terms array<long>, style array<float>")
    table = found.toArrow()
    if not table.num_rows:
        return [Link(c, {}, np.zeros(STYLE + 1 + k), 1.0) for k, c in enumerate(categories)]
    y = np.array(table["labels"].to_pylist(), float)
    folds = table["fold"].to_numpy()
    dense = np.array(table["style"].to_pylist(), np.float32)
    terms = table["terms"].combine_chunks()
    starts = terms.offsets.to_numpy()
    names, flat = np.unique(terms.flatten().to_numpy(), return_inverse=True)
    row_of = np.repeat(np.arange(len(y)), np.diff(starts))
    chain, earlier = [], np.zeros((len(y), 0), np.float32)
    data = _Sparse(row_of, flat.ravel(), len(names))
    for k, category in enumerate(categories):
        base = np.hstack([dense, earlier, np.ones((len(y), 1), np.float32)])
        held = np.zeros(len(y))
        for f in range(FOLDS):
            picked, weights = _fit(data, base, y[:, k], folds != f)
            held[folds == f] = _logits(data.part(picked), base, weights)[folds == f]
        picked, weights = _fit(data, base, y[:, k], np.ones(len(y), bool))
        columns = {int(names[j]): i for i, j in enumerate(picked)}
        chain.append(Link(category, columns, weights, _threshold(_sigmoid(held), y[:, k])))
        earlier = np.hstack([earlier, _sigmoid(held)[:, None].astype(np.float32)])
    return chain


@dataclass
class _Sparse:
    """Places of the ones in a matrix of presences."""

    rows: np.ndarray
    columns: np.ndarray
    width: int

    def part(self, picked: np.ndarray) -> _Sparse:
        where = np.full(self.width, -1, np.int32)
        where[picked] = np.arange(len(picked))
        column = where[self.columns]
        return _Sparse(self.rows[column >= 0], column[column >= 0], len(picked))

    def times(self, w: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(self.rows, w[self.columns], n)

    def turned(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.columns, r[self.rows], self.width)


def _fit(data: _Sparse, base: np.ndarray, y: np.ndarray, inside: np.ndarray, most: int = 1000, rounds: int = 120):
    """Logistic regression with ridge on the features that lean most towards either label."""
    here = inside[data.rows]
    n = np.bincount(data.columns[here], minlength=data.width)
    hits = np.bincount(data.columns[here], weights=y[data.rows[here]], minlength=data.width)
    share = y[inside].mean() if inside.any() else 0.0
    if not 0 < share < 1:
        return np.zeros(0, int), np.r_[np.zeros(base.shape[1] - 1), -20.0 if share == 0 else 20.0]
    lean = np.where(n >= 2, np.abs(hits - n * share) / np.sqrt(np.maximum(n, 1) * share * (1 - share)), 0)
    picked = np.argsort(-lean, kind="stable")[:most]
    picked = picked[lean[picked] >= 3]
    x, width = data.part(picked), len(picked)
    weigh = inside * np.where(y == 1, 0.5 / share, 0.5 / (1 - share)) / inside.sum()
    ridge = np.full(width + base.shape[1], 1.0 / inside.sum())
    ridge[-1] = 0
    apply = lambda w: x.times(w[:width], len(y)) + base @ w[width:]
    back = lambda r: np.concatenate([x.turned(r), r @ base])
    v = np.ones(len(ridge))
    for _ in range(8):  # largest curvature, for the step width
        v = back(weigh * apply(v)) / 4
        size = float(np.linalg.norm(v))
        v /= max(size, 1e-12)
    w = ahead = np.zeros(len(ridge))
    step = 1 / (size * 1.1 + float(ridge.max()))
    for t in range(rounds):  # Nesterov's gradient descent
        after = ahead - step * (back(weigh * (_sigmoid(apply(ahead)) - y)) + ridge * ahead)
        ahead, w = after + t / (t + 3) * (after - w), after
    return picked, w


def _logits(x: _Sparse, base: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return x.times(weights[: x.width], len(base)) + base @ weights[x.width :]


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The cut with the best F1 of the out-of-fold scores, half way to the next score."""
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    if not hits.size or not hits[-1]:
        return 1.0
    best = int(np.argmax(2 * hits / (np.arange(1, len(y) + 1) + hits[-1])))
    after = p[order[best + 1]] if best + 1 < len(y) else 0.0
    return float((p[order[best]] + after) / 2)


class _Columns(dict):
    """word -> columns of a model, filled as words are met."""

    def __init__(self, columns: dict[int, int]):
        self.columns = columns

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        found = self[word] = tuple(self.columns[f] for f in word_features(word) if f in self.columns)
        return found


def _scorer(chain: list[Link], text_at: int):
    names = [f"p{k}" for k in range(len(chain))]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [_Columns(c.columns) for c in chain]
        for batch in batches:
            out: list[list[float]] = []
            for text in batch.column(text_at).to_pylist():
                words = WORD.findall((text or "").lower())
                kinds = set(words)
                base, row = style(text or "", words, kinds), []
                for link, columns in zip(chain, known, strict=True):
                    present = list(set().union(*map(columns.__getitem__, kinds)))
                    n = len(columns.columns)
                    z = link.weights[present].sum() + np.dot(link.weights[n:], [*base, *row, 1.0])
                    row.append(float(_sigmoid(z)) if text is not None else 0.0)
                out.append(row)
            scores = np.array(out, np.float64).reshape(-1, len(chain))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(scores[:, k]) for k in range(len(chain)))], [*batch.schema.names, *names])

    return score


def score(docs: DataFrame, chain: list[Link], text_col: str = "text") -> DataFrame:
    """All columns of docs, and a struct of p_<category> and is_<category> under a name that is free.

    The struct's column is the last one. A null text scores 0 everywhere; an empty one by its style.
    """
    ship(docs.sparkSession)
    renamed = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    schema = ", ".join(f"{n} {renamed.schema[n].dataType.simpleString()}" for n in renamed.columns)
    made = renamed.mapInArrow(_scorer(chain, docs.columns.index(text_col)), schema + "".join(f", p{k} double" for k in range(len(chain))))
    fields = [f for k, c in enumerate(chain) for f in (F.col(f"p{k}").alias(f"p_{c.category}"), ((F.col(f"p{k}") >= c.threshold) & (F.col(f"p{k}") > 0)).alias(f"is_{c.category}"))]
    verdict = fresh_name(docs.columns, "verdict")
    return made.select(*(F.col(f"c{i}").alias(n) for i, n in enumerate(docs.columns)), F.struct(*fields).alias(verdict))
