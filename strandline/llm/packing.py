"""Bounded-space online packing of token ids into sequences of one length.

Every partition keeps a fixed number of open windows. What a document has left
after its full sequences goes into the window that it fills best; when none
has room, the fullest window is filled with the start of the piece and given
out. At the end a partition merges its open windows, and the one sequence that
stays short meets those of its neighbours, a bounded number at a time. The
last short one of such a group is laid into sequences of powers of two, which
need no padding.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, texts
from .tokens import ranks_decide, text_encoder

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, tail boolean"
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("tail", pa.bool_())])


class Packer:
    """Pieces are (doc_id, start, packed ids, doc_tokens), four bytes an id."""

    def __init__(self, length: int, windows: int, first_sequence: int):
        self.length, self.windows, self.next = length, windows, first_sequence
        self.open: list[tuple[int, int]] = []  # (room, key), sorted
        self.held: dict[int, list[tuple]] = {}
        self.made = 0
        self.rows: list[tuple] = []

    def give(self, pieces: list[tuple], tail: bool = False) -> None:
        offset = 0
        for doc_id, start, ids, total in pieces:
            n = len(ids) // 4
            self.rows.append((doc_id, start, n, ids, total, self.next, offset, tail))
            offset += n
        self.next += 1

    def add(self, doc_id, ids: bytes) -> None:
        total = len(ids) // 4
        at = 0
        while total - at >= self.length:
            self.give([(doc_id, at, ids[4 * at : 4 * (at + self.length)], total)])
            at += self.length
        if at < total:
            self.place((doc_id, at, ids[4 * at :], total))

    def place(self, piece: tuple) -> None:
        n = len(piece[2]) // 4
        k = bisect.bisect_left(self.open, (n, -1))
        if k < len(self.open):
            room, key = self.open.pop(k)
            self.held[key].append(piece)
            if room == n:
                self.give(self.held.pop(key))
            else:
                bisect.insort(self.open, (room - n, key))
        elif len(self.open) < self.windows:
            self.made += 1
            self.held[self.made] = [piece]
            bisect.insort(self.open, (self.length - n, self.made))
        else:
            room, key = self.open.pop(0)
            self.give(self.held.pop(key) + [(*piece[:2], piece[2][: 4 * room], piece[3])])
            self.place((piece[0], piece[1] + room, piece[2][4 * room :], piece[3]))

    def finish(self) -> list[tuple]:
        """Merge the open windows; returns the pieces of the one that stays short."""
        left = [x for _, key in self.open for x in self.held[key]]
        self.open, self.held = [], {}
        return self.merge(left)

    def merge(self, left: list[tuple]) -> list[tuple]:
        now, room = [], self.length
        for doc_id, start, ids, total in left:
            while len(ids) // 4 >= room:
                self.give([*now, (doc_id, start, ids[: 4 * room], total)])
                start, ids, now, room = start + room, ids[4 * room :], [], self.length
            if ids:
                now.append((doc_id, start, ids, total))
                room -= len(ids) // 4
        return now

    def powers(self, left: list[tuple]) -> None:
        """Lay pieces into sequences whose lengths are powers of two, the longest first."""
        n = sum(len(x[2]) // 4 for x in left)
        length = self.length
        for bit in reversed(range(n.bit_length())):
            if n >> bit & 1:
                self.length = 1 << bit
                left = self.merge(left)
        self.length = length

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) or [[]] * len(_ARROW)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(x, y.type) for x, y in zip(columns, _ARROW, strict=True)], schema=_ARROW)


def pack(docs: DataFrame, path: str, length: int = 1024, end_id: int = 0, windows: int = 48, fan_in: int = 256) -> DataFrame:
    """Pack all ``docs`` (doc_id, text) into sequences of at most ``length`` ids.

    Returns a row for each piece: doc_id, start (the document's ids before
    it), length, ids (little-endian unsigned 32-bit), doc_tokens (with the end
    id), sequence_id, offset (in the sequence, without gaps). A null or empty
    text is the end id alone; a null doc_id stays null; a repeated row is
    packed again; an empty table gives no rows; extra columns change nothing. A
    very long text is encoded whole, and its pieces are given out as sequences
    fill. ``windows`` bounds what a
    partition keeps open, ``fan_in`` how many partitions' last sequences meet.
    """

    by_rank = ranks_decide(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = text_encoder(path, True, "I", by_rank)
        end = np.array([end_id], dtype="<u4").tobytes()
        packer = Packer(length, windows, TaskContext.get().partitionId() << 32)
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for doc_id, packed in zip(ids, encoder.packed(texts(batch)), strict=True):
                packer.add(doc_id, packed + end)
            yield packer.batch()
        if left := packer.finish():
            packer.give(left, tail=True)
        yield packer.batch()

    def join(frame):
        import pandas as pd

        frame = frame.sort_values(["sequence_id", "offset"])
        first = int(frame["sequence_id"].iloc[0])
        packer = Packer(length, windows, (1 << 62) + ((first >> 32) // fan_in << 32))
        ids = frame["doc_id"].astype("object").where(frame["doc_id"].notna(), None)
        packer.powers(packer.merge(list(zip(ids, frame["start"], frame["ids"], frame["doc_tokens"], strict=True))))
        return pd.DataFrame(packer.batch().to_pandas())

    pieces = stage(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA), "pieces")
    group = F.shiftright("sequence_id", 32) / F.lit(fan_in)
    merged = pieces.filter("tail").groupBy(F.floor(group).alias("neighbours")).applyInPandas(join, SCHEMA)
    return pieces.filter("not tail").unionByName(merged).drop("tail")
