"""Language identification by a convolutional network over bytes, in numpy.

Lower-cased UTF-8 bytes are embedded, filters of several widths slide over windows of fixed length, the
largest answer of each filter goes through ReLU into a softmax. A text's verdict is the mean over all its
windows; neighbouring windows share width-1 bytes, so no byte sequence of filter length is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsieve.llm.runtime import ship

WINDOW = 256
WIDTHS = (2, 3, 4)
AT_ONCE = 64  # windows in one matrix product


@dataclass
class Net:
    languages: list[str]
    embed: np.ndarray  # (256, e); byte 0 pads and stays zero
    filters: np.ndarray  # (max width * e, filters); rows beyond a filter's width are zero
    mask: np.ndarray
    bias: np.ndarray
    out: np.ndarray  # (filters, languages)
    out_bias: np.ndarray


def windows(text: str) -> np.ndarray:
    """(n, WINDOW) bytes that cover the whole text."""
    data = np.frombuffer(text.lower().encode("utf-8", "ignore"), np.uint8)
    step = WINDOW - max(WIDTHS) + 1
    n = max(1, -(-(len(data) - max(WIDTHS) + 1) // step))
    padded = np.zeros(n * step + max(WIDTHS) - 1, np.uint8)
    padded[: len(data)] = data
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::step]


def _slices(net: Net, batch: np.ndarray) -> np.ndarray:
    """(windows, positions, max width * e): the embedded bytes under the filters."""
    e = net.embed.shape[1]
    x = net.embed[batch].reshape(len(batch), -1)
    return np.lib.stride_tricks.sliding_window_view(x, max(WIDTHS) * e, axis=1)[:, ::e]


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def predict(net: Net, batch: np.ndarray) -> np.ndarray:
    """Probabilities of each window."""
    out = []
    for i in range(0, len(batch), AT_ONCE):
        x = _slices(net, batch[i : i + AT_ONCE])
        n, p, k = x.shape
        answer = (x.reshape(n * p, k) @ net.filters).reshape(n, p, -1).max(axis=1)
        out.append(_softmax(np.maximum(answer + net.bias, 0) @ net.out + net.out_bias))
    return np.concatenate(out)


def fit(batch: np.ndarray, y: np.ndarray, languages: list[str], e: int = 8, per_width: int = 12, epochs: int = 4, seed: int = 0) -> Net:
    """Adam on the cross entropy, classes weighted alike; gradients flow through each filter's best place."""
    rng = np.random.default_rng(seed)
    mask = np.zeros((max(WIDTHS) * e, per_width * len(WIDTHS)), np.float32)
    for i, w in enumerate(WIDTHS):
        mask[: w * e, i * per_width : (i + 1) * per_width] = 1
    f = mask.shape[1]
    net = Net(languages, rng.normal(0, 0.5, (256, e)).astype(np.float32), (rng.normal(0, 0.3, mask.shape) * mask).astype(np.float32), mask, np.zeros(f, np.float32), rng.normal(0, 0.2, (f, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32))
    net.embed[0] = 0
    weigh = (len(y) / np.maximum(np.bincount(y, minlength=len(languages)), 1) / len(languages)).astype(np.float32)
    names = ("embed", "filters", "bias", "out", "out_bias")
    moments = {n: (np.zeros_like(getattr(net, n)), np.zeros_like(getattr(net, n))) for n in names}
    t, size = 0, 64
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for i in range(0, len(order), size):
            rows, t = order[i : i + size], t + 1
            x = _slices(net, batch[rows])
            n, p, k = x.shape
            answer = (x.reshape(n * p, k) @ net.filters).reshape(n, p, f)
            best = answer.argmax(axis=1)
            pooled = np.take_along_axis(answer, best[:, None], axis=1)[:, 0] + net.bias
            hidden = np.maximum(pooled, 0)
            probs = _softmax(hidden @ net.out + net.out_bias)
            d = probs.copy()
            d[np.arange(n), y[rows]] -= 1
            d *= weigh[y[rows], None] / n
            back = (d @ net.out.T) * (pooled > 0)
            at = x[np.arange(n)[:, None], best]  # (n, f, k)
            below = (back[:, :, None] * net.filters.T[None]).reshape(n, f, max(WIDTHS), e)
            places = batch[rows][np.arange(n)[:, None, None], best[:, :, None] + np.arange(max(WIDTHS))]
            g_embed = np.zeros_like(net.embed)
            np.add.at(g_embed, places, below)
            g_embed[0] = 0
            slopes = {"embed": g_embed, "filters": np.einsum("nf,nfk->kf", back, at) * mask, "bias": back.sum(0), "out": hidden.T @ d, "out_bias": d.sum(0)}
            rate = 0.01 * (1 - 0.8 * epoch / epochs)
            for name in names:
                m, v = moments[name]
                m += 0.1 * (slopes[name] - m)
                v += 0.01 * (slopes[name] ** 2 - v)
                getattr(net, name)[...] -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return net


def _some_windows(most: int):
    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, rows = [], []
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                w = windows(text)
                for i in np.unique(np.linspace(0, len(w) - 1, most).astype(int)):
                    langs.append(lang)
                    rows.append(w[i].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(rows, pa.binary())], ["lang", "bytes"])

    return take


def train(labelled: DataFrame, sample: int = 4000, per_text: int = 3, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Net | None:
    """Fit on at most `sample` rows with text and language (the least hashes of id), `per_text` windows of each.

    The ids of the sample are broadcast, bounded by `sample`. Without such rows there is no network (None).
    """
    ship(labelled.sparkSession)
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(F.col("text").rlike(r"\p{L}")).dropna()
    ids = rows.select("id", "lang").distinct().orderBy(F.xxhash64("id"), "id", "lang").limit(sample)
    found = rows.join(F.broadcast(ids), ["id", "lang"], "left_semi")
    # of repeated ids one text each, so that the rows are bounded as the ids are
    found = found.groupBy("id", "lang").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("lang", "text")
    found = found.mapInArrow(_some_windows(per_text), "lang string, bytes binary").toArrow()
    if not found.num_rows:
        return None
    raw, names = found["bytes"].to_pylist(), found["lang"].to_pylist()
    order = sorted(range(len(raw)), key=lambda i: (raw[i], names[i]))  # rows arrive in any order
    batch = np.frombuffer(b"".join(raw[i] for i in order), np.uint8).reshape(len(raw), WINDOW)
    languages = sorted(set(names))
    return fit(batch, np.array([languages.index(names[i]) for i in order]), languages)


def _identify(net: Net | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = [], []
            for text in batch.column("text").to_pylist():
                if net is None or text is None or not any(map(str.isalpha, text)):
                    langs.append("und")
                    scores.append(0.0)
                    continue
                w, total = windows(text), 0
                for i in range(0, len(w), 16 * AT_ONCE):
                    total = total + predict(net, w[i : i + 16 * AT_ONCE]).sum(axis=0, dtype=np.float64)
                langs.append(net.languages[int(total.argmax())])
                scores.append(float(min(1.0, total.max() / len(w))))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in batch.schema.names if n != "text"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*(n for n in batch.schema.names if n != "text"), "lang_pred", "score"])

    return run


def identify(docs: DataFrame, net: Net | None, text: Column, **keep: Column) -> DataFrame:
    """The columns in `keep`, with lang_pred and score (0 to 1, the mean probability over all windows).

    A text that is null or without any letter gets `und` with score 0; so does every text if there is no net.
    """
    ship(docs.sparkSession)
    rows = docs.select(*(c.alias(n) for n, c in keep.items()), text.alias("text"))
    schema = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.schema if f.name != "text")
    return rows.mapInArrow(_identify(net), f"{schema}lang_pred string, score double")
