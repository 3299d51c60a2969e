"""Byte-level BPE: encode and decode with a queue of merge ranks held in a hierarchical bitmap.

The symbols of many pre-tokens form one linked list (with gaps that nothing merges across). Every rank has a
bucket of positions in it. Words of 256 bits, and one word over them, say which buckets hold something;
find-first-set on each level gives the least rank. A merge adds what its two new neighbours may do next and
leaves the old entries behind; an entry whose pair has changed is skipped when it comes up. Bytes cost a
bounded number of steps each, however long a pre-token is.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import cached_property
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsieve.llm.runtime import ship, small_parts

KNOWN_PIECES = 400_000  # entries of a worker's cache of short pre-tokens before it is emptied
SHORT = 64  # characters of a pre-token that is worth keeping
TOGETHER = 1 << 22  # characters whose pre-tokens are held at once


def read_ranks(path: str) -> dict[bytes, int]:
    """token bytes -> rank, from lines of base64 and rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class RankQueue:
    """Buckets of positions by rank; gives the bucket of the least rank."""

    def __init__(self, ranks: int):
        self.words = [0] * ((ranks >> 8) + 1)
        self.top = 0
        self.buckets: dict[int, list[np.ndarray]] = {}

    def push(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        """Put each position into the bucket of its rank."""
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order]
        cuts = np.flatnonzero(np.diff(ranks, prepend=-1))
        for rank, start, stop in zip(ranks[cuts].tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(ranks)], strict=False):
            bucket = self.buckets.get(rank)
            if bucket is not None:
                bucket.append(positions[start:stop])
                continue
            self.buckets[rank] = [positions[start:stop]]
            self.words[rank >> 8] |= 1 << (rank & 255)
            self.top |= 1 << (rank >> 8)

    def pop(self) -> tuple[int, np.ndarray]:
        """(rank, its positions in order), or rank -1 if nothing is left."""
        if not self.top:
            return -1, np.zeros(0, int)
        high = (self.top & -self.top).bit_length() - 1
        word = self.words[high]
        lowest = word & -word
        self.words[high] = word ^ lowest
        if word == lowest:
            self.top ^= 1 << high
        rank = high << 8 | lowest.bit_length() - 1
        return rank, np.unique(np.concatenate(self.buckets.pop(rank)))


class Codec:
    """Ranks and pattern; encodes a text as little-endian unsigned 32-bit ids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.gap = max(ranks.values()) + 1  # the symbol between pre-tokens; no pair holds it
        self.tokens = [b""] * self.gap
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.queue = RankQueue(self.gap)
        self.known: dict[str, bytes] = {}

    @cached_property
    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Left and right symbol as one number, in order, and the rank of both together. A worker that only decodes has none."""
        found = []
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    found.append((left * (self.gap + 1) + right, rank))
        keys, ranks = np.array(sorted(found), np.int64).T.copy()
        return keys, ranks

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of each pre-token; a pre-token that is a token itself is that token."""
        whole = [self.ranks.get(p) for p in pieces]
        data = b"".join(p + b"\0" for p, rank in zip(pieces, whole, strict=True) if rank is None)
        lengths = np.array([len(p) + 1 for p, rank in zip(pieces, whole, strict=True) if rank is None], np.int64)
        ends = np.cumsum(lengths)
        symbol = self.bytes[np.frombuffer(data, np.uint8)]
        symbol[ends - 1] = self.gap
        if len(symbol):
            self._run(symbol)
        left = (symbol >= 0) & (symbol < self.gap)
        packed = symbol[left].astype("<u4").tobytes()
        stops = (np.cumsum(left)[ends - 1] * 4).tolist() if len(ends) else []
        out, at, k = [], 0, 0
        for rank in whole:
            if rank is None:
                out.append(packed[at : stops[k]])
                at, k = stops[k], k + 1
            else:
                out.append(rank.to_bytes(4, "little"))
        return out

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * (self.gap + 1) + right
        pairs, ranks = self.pairs
        at = np.minimum(np.searchsorted(pairs, key), len(pairs) - 1)
        return np.where(pairs[at] == key, ranks[at], -1)

    def _run(self, symbol: np.ndarray) -> None:
        """Merge in place; what a symbol has swallowed becomes -1.

        A bucket is worked off at once. That equals going from left to right one merge at a time unless a
        merge makes a pair of a lower rank; the pre-tokens where it does merge once and wait.
        """
        n, queue = len(symbol), self.queue
        after, before, piece = np.arange(1, n + 1), np.arange(-1, n - 1), np.cumsum(symbol == self.gap)
        pair = np.append(self._rank(symbol[:-1], symbol[1:]), -1)
        some = np.flatnonzero(pair >= 0)
        queue.push(pair[some], some)
        while True:
            rank, at = queue.pop()
            if rank < 0:
                return
            valid = at = at[pair[at] == rank]  # the others are stale
            if not at.size:
                continue
            follows = np.append(False, at[1:] == after[at[:-1]])
            if follows.any():  # pairs that overlap, as in "aaa": every other one of a run
                index = np.arange(len(at))
                at = at[(index - np.maximum.accumulate(np.where(follows, 0, index))) % 2 == 0]
            middle, old = after[at], (symbol[at].copy(), symbol[after[at]].copy())
            last, left, right, symbol[at], symbol[middle] = self._around(symbol, rank, at, middle, after, before)
            lower = ((right >= 0) & (right < rank)) | ((left >= 0) & (left < rank))
            if lower.any():
                first = np.append(True, piece[at[1:]] != piece[at[:-1]])
                halted = piece[at[lower]]
                keep = first | ~np.isin(piece[at], halted)
                if not keep.all():
                    symbol[at], symbol[middle] = old
                    at, middle = at[keep], middle[keep]
                    wait = np.setdiff1d(valid[np.isin(piece[valid], halted)], at)
                    queue.push(np.full(len(wait), rank), wait)
                    last, left, right, symbol[at], symbol[middle] = self._around(symbol, rank, at, middle, after, before)
            symbol[middle], pair[middle] = -1, -1
            after[at], before[last] = last, at
            pair[at] = right
            behind = before[at]
            there = behind >= 0
            behind, left = behind[there], left[there]
            pair[behind] = left
            places, ranks = np.concatenate([at, behind]), np.concatenate([right, left])
            fresh = ranks >= 0
            if fresh.any():
                queue.push(ranks[fresh], places[fresh])

    def _around(self, symbol, rank, at, middle, after, before):
        """What follows, and the ranks that the merged symbols would have with their neighbours."""
        symbol[at] = symbol[middle] = rank
        last, behind = after[middle], before[at]
        left = np.where(behind >= 0, self._rank(symbol[behind], np.full(len(at), rank)), -1)
        return last, left, self._rank(np.full(len(at), rank), symbol[last]), rank, rank

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Packed ids of each text. Pre-tokens new to this worker are merged together."""
        group: list[str] = []
        size = 0
        for text in texts:
            if len(text) > TOGETHER:
                yield from self._encode([self.pattern.findall(t) for t in group])
                found, parts = (m.group() for m in self.pattern.finditer(text)), []
                while some := list(islice(found, TOGETHER // 4)):
                    parts.extend(self._encode([some]))
                yield b"".join(parts)
                group, size = [], 0
                continue
            group.append(text)
            size += len(text)
            if size >= TOGETHER:
                yield from self._encode([self.pattern.findall(t) for t in group])
                group, size = [], 0
        yield from self._encode([self.pattern.findall(t) for t in group])

    def _encode(self, found: list[list[str]]) -> Iterator[bytes]:
        fresh = set().union(*found).difference(self.known)
        if len(self.known) + len(fresh) > KNOWN_PIECES:
            self.known.clear()
            fresh = set().union(*found)
        names = sorted(fresh)
        known = self.known
        known.update(zip(names, self.merge([n.encode("utf-8") for n in names]), strict=True))
        out = [b"".join(map(known.__getitem__, pieces)) for pieces in found]
        for name in names:
            if len(name) > SHORT:
                del known[name]
        return iter(out)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_CODECS: dict[tuple[str, str], Codec] = {}  # of this worker


def codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(read_ranks(path), pattern)
    return _CODECS[path, pattern]


def _encode(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in (part for whole in batches for part in small_parts(whole, "text", TOGETHER)):
            packed = list(own.encode(t or "" for t in batch.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in batch.schema.names if n != "text"), pa.array(packed, pa.binary())], [*(n for n in batch.schema.names if n != "text"), "ids"])

    return run


def _decode(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in (part for whole in batches for part in small_parts(whole, "ids", TOGETHER)):
            data = [own.decode(i or b"") for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(data, pa.binary())], [*batch.schema.names, "bytes"])

    return run


def encode(docs: DataFrame, path: str, pattern: str, text: Column, **keep: Column) -> DataFrame:
    """The columns in `keep` and `ids`, little-endian unsigned 32-bit; a null text is empty.

    path: a file of ranks that every executor has (a public vocabulary). Pre-tokens are the matches of pattern.
    """
    ship(docs.sparkSession)
    rows = docs.select(*(c.alias(n) for n, c in keep.items()), text.alias("text"))
    schema = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.schema if f.name != "text")
    return rows.mapInArrow(_encode(path, pattern), f"{schema}ids binary")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """All columns and `bytes`, decoded from the column ids (null: empty)."""
    ship(encoded.sparkSession)
    schema = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in encoded.schema)
    return encoded.mapInArrow(_decode(path, pattern), f"{schema}bytes binary")


def digests(decoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return decoded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))
