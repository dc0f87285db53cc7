"""Token files in a static range asymmetric numeral system.

All blocks share one frequency table, counted over all ids. A block holds
whole documents; its ids run through ``lanes`` interleaved coders, which numpy
steps together. Each block stands alone, has a checksum, and has checkpoints
(coder states and place in its words) from which its parts decode in parallel.

A token file set is a folder of two Parquet tables, so that writing is atomic
and any store works that Spark can write: ``table`` (the frequencies) and
``blocks`` (in ascending doc_id order by part and by the ids before a block).
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir, stage, texts
from .tokens import ranks_decide, text_encoder

BITS = 20
LOW = np.uint64(1 << 31)
MAGIC = b"SRA1"
_HEAD = struct.Struct("<4sIIIIIQ")  # magic, ids, lanes, steps between checkpoints, checkpoints, words, crc32 of the rest


def quantized(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to 2**BITS, at least 1 for what occurs."""
    if len(counts) > 1 << (BITS - 1):
        raise ValueError("too many symbols for the table")
    total = int(counts.sum())
    if not total:
        return np.zeros(len(counts), np.int64)
    room = (1 << BITS) - int((counts > 0).sum())
    out = np.where(counts > 0, 1 + counts.astype(object) * room // total, 0).astype(np.int64)
    out[int(np.argmax(out))] += (1 << BITS) - int(out.sum())
    return out


class Coder:
    def __init__(self, freq: np.ndarray, lanes: int = 512, every: int = 128):
        self.lanes, self.every = lanes, every
        self.freq = freq.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64) if len(freq) else self.freq
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)

    def encode(self, ids: np.ndarray) -> bytes:
        n, lanes = len(ids), max(1, min(self.lanes, len(ids)))
        steps = -(-n // lanes)
        freq, start = self.freq[ids], self.start[ids]
        limit = freq << np.uint64(63 - BITS)
        state = np.full(lanes, LOW, np.uint64)
        words, marks, used = [], [], 0
        for step in reversed(range(steps)):
            at = slice(step * lanes, min(n, (step + 1) * lanes))
            x = state[: at.stop - at.start]
            full = x >= limit[at]
            if full.any():
                low = x[full]
                words.append((low & np.uint64(0xFFFFFFFF)).astype("<u4"))
                used += len(low)
                x[full] = low >> np.uint64(32)
            f = freq[at]
            q = x // f
            x[:] = (q << np.uint64(BITS)) + (x - q * f) + start[at]
            if step % self.every == 0:
                marks.append((used, state.copy()))
        stream = np.concatenate(words[::-1]) if words else np.empty(0, "<u4")
        body = b"".join(struct.pack("<I", len(stream) - used) + x.astype("<u8").tobytes() for used, x in reversed(marks)) + stream.tobytes()
        return _HEAD.pack(MAGIC, n, lanes, self.every, len(marks), len(stream), zlib.crc32(body)) + body

    def parts(self, block: bytes) -> int:
        return _HEAD.unpack_from(block)[4]

    def opened(self, block: bytes) -> tuple[int, int, int, int, memoryview, np.ndarray]:
        """ids, lanes, steps between checkpoints, checkpoints, the checkpoints' bytes and the words, all verified."""
        magic, n, lanes, every, marks, words, crc = _HEAD.unpack_from(block)
        body = memoryview(block)[_HEAD.size :]
        size = marks * (4 + 8 * lanes)
        if magic != MAGIC or len(body) != size + 4 * words or zlib.crc32(body) != crc:
            raise ValueError("damaged block")
        return n, lanes, every, marks, body, np.frombuffer(body, "<u4", words, size).astype(np.uint64)

    def decode(self, block: bytes, part: int | None = None) -> np.ndarray:
        """All ids of a block, or those from one checkpoint to the next. Parts of one length are decoded side by side."""
        n, lanes, every, marks, body, stream = self.opened(block)
        if part is not None:
            return self.steps(n, lanes, every, body, stream, part)
        whole = n // (lanes * every)
        found = [self.together(lanes, every, body, stream, whole)] if whole else []
        return np.concatenate([*found, *(self.steps(n, lanes, every, body, stream, k) for k in range(whole, marks)), np.empty(0, np.uint32)])

    def checkpoint(self, lanes: int, body: memoryview, part: int) -> tuple[int, np.ndarray]:
        at = part * (4 + 8 * lanes)
        return struct.unpack_from("<I", body, at)[0], np.frombuffer(body, "<u8", lanes, at + 4).astype(np.uint64)

    def together(self, lanes: int, every: int, body: memoryview, stream: np.ndarray, parts: int) -> np.ndarray:
        """The ids of the first ``parts`` parts, which are whole, a row of states for each."""
        marks = [self.checkpoint(lanes, body, k) for k in range(parts)]
        at, state = np.array([x[0] for x in marks], np.int64), np.stack([x[1] for x in marks])
        mask, out = np.uint64((1 << BITS) - 1), np.empty((parts, every, lanes), np.uint32)
        for step in range(every):
            slot = state & mask
            ids = self.symbol[slot]
            out[:, step] = ids
            state = self.freq[ids] * (state >> np.uint64(BITS)) + slot - self.start[ids]
            low = state < LOW
            row, column = np.nonzero(low)
            used = np.count_nonzero(low, axis=1)
            first = np.cumsum(used) - used
            state[row, column] = (state[row, column] << np.uint64(32)) | stream[np.arange(len(row)) + (at - first)[row]]
            at += used
        return out.ravel()

    def steps(self, n: int, lanes: int, every: int, body: memoryview, stream: np.ndarray, part: int) -> np.ndarray:
        first, last = part * every, min(-(-n // lanes), (part + 1) * every)
        at, state = self.checkpoint(lanes, body, part)
        mask, out = np.uint64((1 << BITS) - 1), np.empty(min(n, last * lanes) - first * lanes, np.uint32)
        for step in range(first, last):
            width = min(lanes, n - step * lanes)
            x = state[:width]
            slot = x & mask
            ids = self.symbol[slot]
            out[(step - first) * lanes : (step - first) * lanes + width] = ids
            x[:] = self.freq[ids] * (x >> np.uint64(BITS)) + slot - self.start[ids]
            low = x < LOW
            k = int(np.count_nonzero(low))
            if k:
                x[low] = (x[low] << np.uint64(32)) | stream[at : at + k]
                at += k
        return out


@lru_cache(maxsize=2)
def coder(table: bytes) -> Coder:
    return Coder(np.frombuffer(table, "<i8"))


def encode_texts(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """doc_id and ids (little-endian unsigned 16-bit, which the vocabulary must fit, with the end id) of every whole text."""
    by_rank = ranks_decide(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = text_encoder(path, False, "H", by_rank), struct.pack("<H", end_id)
        for batch in batches:
            ids = [x + end for x in encoder.packed(texts(batch))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids binary")


def counted(rows: DataFrame) -> DataFrame:
    """symbol, n over all ids of all rows; each task sums up before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for ids in batch.column("ids").to_pylist():
                more = np.bincount(np.frombuffer(ids, "<u2"), minlength=len(total))
                more[: len(total)] += total
                total = more
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["symbol", "n"])

    return rows.select("ids").mapInArrow(run, "symbol long, n long").groupBy("symbol").agg(F.sum("n").alias("n"))


def write_token_files(docs: DataFrame, path: str, end_id: int = 1, folder: str | None = None, block_ids: int = 1 << 19) -> str:
    """Encode all ``docs`` (doc_id, text), write a token file set, return its folder.

    A null or empty text is the end id alone. Rows are in ascending doc_id
    order, null first; repeated rows follow one another; extra columns change
    nothing, and an empty table makes files without rows. ``block_ids`` is the
    size from which a block is closed, so a very long text is one block; only the frequencies, at most one row
    for each id of the vocabulary, come to the driver.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    rows = stage(encode_texts(docs, path, end_id), "ids")
    seen = counted(rows).collect()
    counts = np.zeros(1 + max((x.symbol for x in seen), default=0), np.int64)
    for x in seen:
        counts[x.symbol] = x.n
    table = quantized(counts).astype("<i8").tobytes()
    spark.createDataFrame([(bytearray(table),)], "frequencies binary").coalesce(1).write.parquet(f"{folder}/table")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, code, before = TaskContext.get().partitionId(), coder(table), 0
        ids, held, size = [], [], 0

        def close() -> pa.RecordBatch:
            values = [[part], [before], [size], [ids], [[len(x) // 2 for x in held]], [code.encode(np.frombuffer(b"".join(held), "<u2"))]]
            types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(x, y) for x, y in zip(values, types, strict=True)], ["part", "before", "n_tokens", "doc_ids", "lengths", "payload"])

        for batch in batches:
            for doc_id, packed in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                ids.append(doc_id)
                held.append(packed)
                size += len(packed) // 2
                if size >= block_ids:
                    yield close()
                    before += size
                    ids, held, size = [], [], 0
        if held:
            yield close()

    # rows of one id may go to several parts
    named = rows.select("doc_id", F.monotonically_increasing_id().alias("row"), "ids")
    ordered = named.repartitionByRange("doc_id", "row").sortWithinPartitions("doc_id", "row")
    blocks = ordered.select("doc_id", "ids").mapInArrow(run, "part long, before long, n_tokens long, doc_ids array<long>, lengths array<long>, payload binary")
    blocks.write.option("compression", "none").parquet(f"{folder}/blocks")
    return folder


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids of every document in the files."""
    table = bytes(spark.read.schema("frequencies binary").parquet(f"{folder}/table").head()[0])
    blocks = spark.read.schema("part long, before long, n_tokens long, doc_ids array<long>, lengths array<long>, payload binary").parquet(f"{folder}/blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(table)
        for batch in batches:
            for row in batch.to_pylist():
                ids = code.decode(row["payload"]).astype("<u4").tobytes()
                ends = np.cumsum(row["lengths"])
                starts = ends - row["lengths"]
                yield pa.RecordBatch.from_arrays([pa.array([row["part"]] * len(ends), pa.int64()), pa.array(row["doc_ids"], pa.int64()), pa.array(row["before"] + starts, pa.int64()), pa.array(row["lengths"], pa.int64()), pa.array([ids[4 * a : 4 * b] for a, b in zip(starts, ends, strict=True)], pa.binary())], ["part", "doc_id", "start", "n_tokens", "ids"])

    # the ids before a part; there is one row for each task that wrote, which bounds what is broadcast
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    rows = blocks.mapInArrow(run, "part long, doc_id long, start long, n_tokens long, ids binary")
    return rows.join(F.broadcast(parts), "part").select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids")
