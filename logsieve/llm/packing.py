"""Best-fit packing of token sequences under several capacities (vector bin packing).

A sequence has room for tokens, for documents, and for attention cost (the sum of squared lengths). Pieces
go from long to short; each goes to the open sequence, among those with room in every respect, whose
weighted residual is smallest afterwards ("norm"), or whose residual points most in the piece's direction
("dot"). Pieces are dealt into groups of a few thousand; a group packs on its own.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsieve.llm.runtime import Scratch, ship, small_parts

SPACE = "\u0120"  # how a byte-level vocabulary writes the space
LINE, LINES = 256, 32  # chunks that are encoded as one text, and such texts at a time
TOGETHER = 1 << 22  # characters whose chunks are held at once
KEPT = 600_000  # names whose ids a worker remembers from group to group, about 200 bytes each
GROUP = 4096  # pieces that are packed together
#: No pre-token reaches from a visible character over a following space: a text may be cut there.
CUT = re.compile(r"(?<=\S) (?=\S)")
#: A space within a text that is none of these cuts.
UNEVEN = re.compile(r" (?:(?=\s)|(?<=\s ))")


@dataclass(frozen=True)
class Capacity:
    tokens: int = 2048
    documents: int = 2048
    attention: float = 2048.0**2
    weights: tuple[float, float, float] = (1.0, 1e-4, 1e-4)
    rule: str = "norm"


class Seen:
    """Ids of names met before; past ``most`` names, only those met more than once stay."""

    def __init__(self, most: int):
        self.most = most
        self._fill([], np.zeros(0, "<u4"), np.zeros(0, np.int64))

    def _fill(self, names: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        self.at = {name: i for i, name in enumerate(names)}
        self.ids, self.sizes = ids, sizes
        self.again = np.zeros(len(names), bool)

    def look_up(self, names: list[str]) -> np.ndarray:
        """The place of each name, -1 where it is new; names are different."""
        if len(self.at) > self.most:
            stay = np.flatnonzero(self.again)
            if len(stay) > self.most // 2:
                stay = stay[:0]
            known, begins = list(self.at), np.cumsum(self.sizes) - self.sizes
            sizes = self.sizes[stay]
            self._fill([known[i] for i in stay], _runs(self.ids, begins[stay], sizes), sizes)
        at = np.fromiter(map(self.at.get, names, repeat(-1)), np.int64, len(names))
        self.again[at[at >= 0]] = True
        return at

    def add(self, names: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        self.at.update(zip(names, range(len(self.at), len(self.at) + len(names)), strict=True))
        self.ids, self.sizes = np.concatenate([self.ids, ids]), np.concatenate([self.sizes, sizes])
        self.again = np.concatenate([self.again, np.zeros(len(names), bool)])


def _runs(ids: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of ids one after another."""
    ends = np.cumsum(sizes)
    return ids[np.repeat(begins - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


class Encoder:
    """Ids of whole texts by a tokenizer file; in a group of texts, what lies between two cuts is encoded once.

    Names met in earlier groups are remembered, a bounded number of them.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.after_space = np.zeros(self.tokenizer.get_vocab_size(), bool)  # of each id: its token begins with a space
        for token, i in self.tokenizer.get_vocab().items():
            self.after_space[i] = token.startswith(SPACE)
        self.seen = Seen(KEPT)

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(array("I", e.ids), "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        group: list[str | list[str]] = []
        size = 0
        for text in texts:
            parts, at = [], 0
            while len(text) - at > TOGETHER and (cut := CUT.search(text, at + TOGETHER)):
                parts.append(text[at : cut.start()])
                at = cut.start() + 1
            if parts:
                yield from self._group(group)
                group, size = [], 0
                some = [next(self._group([self._chunks(parts[0])]))]
                for part in [*parts[1:], text[at:]]:
                    some.append(next(self._group([["", *CUT.split(part)]])))
                yield b"".join(some)
                continue
            group.append(self._chunks(text))
            size += len(text)
            if size >= TOGETHER:
                yield from self._group(group)
                group, size = [], 0
        yield from self._group(group)

    @staticmethod
    def _chunks(text: str) -> str | list[str]:
        """The text itself where each of its spaces is a cut."""
        uneven = text[:1] == " " or text[-1:] == " " or UNEVEN.search(text)
        return CUT.split(text) if uneven else text

    def _group(self, group: list[str | list[str]]) -> Iterator[bytes]:
        """group: texts to be cut at every space, or chunks of a text; all chunks but the first follow a space."""
        turn = sorted(range(len(group)), key=lambda i: isinstance(group[i], list))
        whole = pc.split_pattern(pa.array([g for g in group if isinstance(g, str)], pa.string()), " ")
        lists = pa.concat_arrays([whole, pa.array([g for g in group if isinstance(g, list)], whole.type)])
        chunks, starts = lists.flatten(), lists.offsets.to_numpy()
        follows = np.ones(len(chunks), bool)
        follows[starts[:-1]] = False
        heads = self._ids(chunks.take(pa.array(starts[:-1])).to_pylist())
        coded = chunks.filter(pa.array(follows)).dictionary_encode()
        ids, begins, sizes = self._remembered(coded.dictionary.to_pylist())
        which = coded.indices.to_numpy()
        lengths = sizes[which]
        ends = np.append(0, np.cumsum(lengths))
        found = _runs(ids, begins[which], lengths)
        stops = ends[starts - np.arange(len(starts))]  # each text before has a head, which is not among them
        out: list[bytes] = [b""] * len(group)
        for i, head, start, stop in zip(turn, heads, stops[:-1].tolist(), stops[1:].tolist(), strict=True):
            out[i] = head.tobytes() + found[start:stop].tobytes()
        return iter(out)

    def _remembered(self, names: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As ``_after_a_space``, but only names that are not remembered are encoded."""
        at = self.seen.look_up(names)
        new = np.flatnonzero(at < 0)
        fresh = [names[i] for i in new]
        ids, begins, sizes = self._after_a_space(fresh)
        at[new] = len(self.seen.at) + np.arange(len(new))
        self.seen.add(fresh, _runs(ids, begins, sizes), sizes)
        begins = np.cumsum(self.seen.sizes) - self.seen.sizes
        return self.seen.ids, begins[at], self.seen.sizes[at]

    def _after_a_space(self, names: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all names, each behind a space; where each name's ids begin, and how many it has.

        Names are encoded many in a line: a token that begins with a space begins a name, as names in lines hold none.
        Where that does not come out even, as with spaces that are no tokens' beginning, each name is encoded by itself.
        """
        odd = np.array([" " in n or n[-1:].isspace() for n in names], bool)
        plain, alone = np.flatnonzero(~odd), [np.flatnonzero(odd)]
        sizes, made, order = np.zeros(len(names), np.int64), [np.zeros(0, "<u4")], []
        for k in range(0, len(plain), LINE * LINES):
            lines = [plain[m : m + LINE] for m in range(k, min(k + LINE * LINES, len(plain)), LINE)]
            for line, ids in zip(lines, self._ids(["".join([f" {names[i]}" for i in line]) for line in lines]), strict=True):
                first = np.flatnonzero(self.after_space[ids])
                if len(first) != len(line) or first[0]:
                    alone.append(line)
                    continue
                sizes[line] = np.diff(first, append=len(ids))
                made.append(ids)
                order.append(line)
        order.append(np.concatenate(alone))
        one_by_one = self._ids([f" {names[i]}" for i in order[-1]])
        sizes[order[-1]] = [len(ids) for ids in one_by_one]
        places, begins = np.concatenate(order), np.zeros(len(names), np.int64)
        begins[places] = np.cumsum(sizes[places]) - sizes[places]
        return np.concatenate([*made, *one_by_one]), begins, sizes


_ENCODERS: dict[str, Encoder] = {}  # of this worker


def cut(length: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces: one, or full ones after a first that takes the rest."""
    first = length % most or min(length, most)
    return [(0, first), *((s, most) for s in range(first, length, most))]


def _pieces(path: str, end_id: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = _ENCODERS.setdefault(path, None) or Encoder(path)
        _ENCODERS[path] = encoder
        end = np.array([end_id], "<u4").tobytes()
        for batch in (part for whole in batches for part in small_parts(whole, "text", TOGETHER)):
            rows, numbers, starts, lengths, sums = [], [], [], [], []
            for row, ids in enumerate(encoder.encode(t or "" for t in batch.column("text").to_pylist())):
                ids += end
                for number, (start, length) in enumerate(cut(len(ids) // 4, most)):
                    rows.append(row)
                    numbers.append(number)
                    starts.append(start)
                    lengths.append(length)
                    sums.append(zlib.crc32(ids[start * 4 : (start + length) * 4]))
            doc = batch.column("doc_id").take(pa.array(rows, pa.int64()))
            columns = [doc, pa.array(numbers, pa.int32()), *(pa.array(x, pa.int64()) for x in (starts, lengths, sums))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pieces(docs: DataFrame, path: str, end_id: int, most: int, doc_id: Column, text: Column) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): the text's ids and end_id, cut where longer than `most`."""
    ship(docs.sparkSession)
    rows = docs.select(doc_id.cast("long").alias("doc_id"), text.alias("text"))
    return rows.mapInArrow(_pieces(path, end_id, most), "doc_id long, piece int, start long, length long, ids_crc32 long")


def assign(lengths: np.ndarray, room: Capacity) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece; lengths of at most room.tokens, in any order.

    A piece that alone exceeds another capacity gets a sequence of its own.
    """
    limit = np.array([room.tokens, room.documents, room.attention], float)
    weight = np.array(room.weights, float)
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    left = np.zeros((3, len(lengths)))  # residuals as shares of the limits
    filled = np.zeros(len(lengths), np.int64)
    numbers = np.zeros(len(lengths), np.int64)
    count = opened = 0
    order = np.argsort(-lengths, kind="stable")
    shortest = lengths.min(initial=0)
    for turn, i in enumerate(order):
        n = int(lengths[i])
        need = np.array([n, 1, float(n) * n]) / limit
        after = left[:, :count] - need[:, None]
        fits = (after >= -1e-12).all(axis=0)
        if fits.any():
            if room.rule == "dot":
                score = -(weight * need) @ left[:, :count]
            else:
                score = weight @ (after * after)
            b = int(np.where(fits, score, np.inf).argmin())
        else:
            b, count = count, count + 1
            left[:, b], filled[b], numbers[b] = 1.0, 0, opened
            opened += 1
        sequence[i], offset[i] = numbers[b], filled[b]
        left[:, b] -= need
        filled[b] += n
        if turn % 256 == 255:  # forget the sequences that nothing fits any more
            open_ = np.flatnonzero(room.tokens - filled[:count] >= shortest)
            left[:, : len(open_)], filled[: len(open_)], numbers[: len(open_)] = left[:, open_], filled[open_], numbers[open_]
            count = len(open_)
    return sequence, offset


def _packer(room: Capacity):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        sequence, offset = assign(group["length"].to_numpy(), room)
        return group.assign(sequence_id=group["team"].to_numpy() * (1 << 32) + sequence, offset=offset).drop(columns="team")

    return run


def pack(docs: DataFrame, scratch: Scratch, path: str, end_id: int = 0, room: Capacity = Capacity(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) per piece; nothing is left out.

    A null text is empty and still has its end_id; a null id stays null; repeated rows are packed each.
    Groups are dealt by row, not by id or source, so they have the same size whatever is frequent.
    """
    cut_up = scratch.save(pieces(docs, path, end_id, room.tokens, F.col(id_col), F.col(text_col)), "pieces")
    teams = max(1, -(-cut_up.count() // GROUP))
    dealt = cut_up.withColumn("team", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(teams)))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return dealt.groupBy("team").applyInPandas(_packer(room), schema)
