"""Quality by nearest-neighbour voting in a latent-semantic space.

A text has two bags of terms. Topic: its words. Style: the shapes of its words
(``Abc!!`` is ``Aa!!``), how many words follow themselves or stand in the text
already, and the order of its length. Terms are hashed into a fixed number of
places, so that any vocabulary fits; their weights follow their counts in the
text and the rarity of the place over all documents. A random projection to a
few hundred dimensions, then the principal axes of all documents in these,
make the latent space.

The labelled vectors, a bounded number, are broadcast. Every document's cosines
with all of them are computed exactly, block by block, and its nearest
neighbours vote, each with a weight that follows its cosine. Projected vectors
are rounded to integers before anything is summed or compared, so that sums
and cosines don't depend on the order of the rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from operator import eq
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release, stage, texts

#: Words have the places under ``TOPIC``, style the others.
PLACES, TOPIC = 1 << 15, (1 << 15) - (1 << 12)
WIDTH = 256
#: Vectors of length one are rounded to this fraction.
UNIT = 1 << 11
#: Letters by case, digits, bytes of other characters, and blanks as in ``bytes.split``; the rest as it is.
_KINDS = bytes(97 if 97 <= x <= 122 else 65 if 65 <= x <= 90 else 48 if 48 <= x <= 57 else 117 if x >= 128 else x for x in range(256))
_RUN = re.compile(rb"([aA0u])\1+|(.)\2+")


@lru_cache(maxsize=1 << 16)
def shape_place(kinds: bytes) -> int:
    """The place of a word's shape: a run of one kind counts once, a run of another character twice."""
    short = _RUN.sub(lambda x: x[1] or x[2] * 2, kinds[:200])
    return TOPIC + crc32(short) % (PLACES - TOPIC)


def style_place(name: str, level: int) -> int:
    return TOPIC + crc32(f"{name} {level}".encode()) % (PLACES - TOPIC)


def terms(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The places of a text's terms, each once and in ascending order, and weights by their counts."""
    data = text.encode("utf-8", "replace")
    words = data.lower().split()
    n, count = len(words), Counter(words)
    topic: dict[int, float] = {}
    for word, x in count.items():
        at = crc32(word) % TOPIC
        topic[at] = topic.get(at, 0) + x
    style: Counter[int] = Counter()
    for kinds, x in Counter(data.translate(_KINDS).split()).items():
        style[shape_place(kinds)] += x
    again = sum(map(eq, words, words[1:]))
    for name, x in (("again", again), ("known", n - len(count))):
        if x:
            style[style_place(name, 16 * x // n)] += x
            style[style_place(name, -1)] += x
    style[style_place("length", n.bit_length())] += max(1, n // 8)
    at = np.fromiter((*topic, *style), np.int64, len(topic) + len(style))
    weight = np.fromiter((*topic.values(), *style.values()), np.float64, len(at))
    weight[: len(topic)] = 1 + np.log(weight[: len(topic)])
    weight[len(topic) :] = np.sqrt(weight[len(topic) :] / max(1, n))
    order = np.argsort(at)
    return at[order], weight[order]


@lru_cache(maxsize=1)
def signs() -> np.ndarray:
    """The random projection: a row of signs for each place."""
    return (np.random.default_rng(17).integers(0, 2, (PLACES, WIDTH), dtype=np.int8) * 2 - 1).astype(np.float32)


def projected(at: np.ndarray, weight: np.ndarray, basis: np.ndarray, rarity: np.ndarray, style: float) -> np.ndarray:
    """A vector over ``basis`` (a row for each place), rounded to integers; its length is about ``UNIT``.

    The bags count ``style`` to one.
    """
    weight = weight * rarity[at]
    split = np.searchsorted(at, TOPIC)
    for part, share in ((weight[:split], 1.0), (weight[split:], style)):
        part *= share / max(np.sqrt(part @ part), 1e-9)
    found = weight.astype(np.float32) @ basis[at]
    size = np.linalg.norm(found)
    return np.rint(found * (UNIT / size)) if size else np.zeros(basis.shape[1])


def featured(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, at, weight: each text's terms as 16-bit places and 16-bit floats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [terms(x) for x in texts(batch)]
            packed = [pa.array([x[k].astype(kind).tobytes() for x in found], pa.binary()) for k, kind in ((0, np.uint16), (1, np.float16))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), *packed], ["doc_id", "held_out", "at", "weight"])

    return docs.mapInArrow(run, "doc_id long, held_out boolean, at binary, weight binary")


def unpacked(batch: pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray]]:
    pairs = zip(batch.column("at").to_pylist(), batch.column("weight").to_pylist(), strict=True)
    return [(np.frombuffer(x, np.uint16).astype(np.int64), np.frombuffer(y, np.float16).astype(np.float64)) for x, y in pairs]


def place_rarity(features: DataFrame) -> np.ndarray:
    """Logarithmic rarity of each place over all documents: ``PLACES`` numbers at most come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, n = np.zeros(PLACES, np.int64), 0
        for batch in batches:
            rows = batch.column("at").to_pylist()
            n += len(rows)
            count += np.bincount(np.frombuffer(b"".join(rows), np.uint16), minlength=PLACES)
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(count[at], n))], ["place", "n"])

    found = features.select("at").mapInArrow(run, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).toPandas()
    count = dict(zip(found["place"], found["n"], strict=True))
    n = count.pop(-1, 0)
    rarity = np.full(PLACES, np.log(1.0 + n))
    if count:
        rarity[list(count)] = np.log((1.0 + n) / np.array(list(count.values()), float))
    return np.maximum(rarity, 0.02)


def principal_axes(features: DataFrame, rarity: np.ndarray, k: int, style: float) -> np.ndarray:
    """``WIDTH`` x ``k``: the principal axes of the projected vectors of all documents.

    Each task sums the products of its vectors' components. They are integers,
    so the sums are exact; ``WIDTH`` * (``WIDTH`` + 1) / 2 come to the driver.
    """
    upper = np.triu_indices(WIDTH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((WIDTH, WIDTH))
        for batch in batches:
            if batch.num_rows:
                block = np.stack([projected(*x, signs(), rarity, style) for x in unpacked(batch)])
                total += block.T @ block
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(upper[0]), dtype=np.int32)), pa.array(total[upper].astype(np.int64))], ["cell", "product"])

    found = features.select("at", "weight").mapInArrow(run, "cell int, product long").groupBy("cell").agg(F.sum(F.col("product").cast("decimal(38,0)")).cast("double").alias("product")).toPandas()
    products = np.zeros(len(upper[0]))
    products[found["cell"].to_numpy()] = found["product"].to_numpy()
    square = np.zeros((WIDTH, WIDTH))
    square[upper] = products
    square += np.triu(square, 1).T
    _, axes = np.linalg.eigh(square)
    axes = axes[:, ::-1][:, :k]
    return axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])] < 0, -1.0, 1.0)


class Space:
    """Vectors of texts: ``rarity`` of the places, principal ``axes`` and the weight of ``style``."""

    def __init__(self, rarity: np.ndarray, axes: np.ndarray, style: float):
        self.rarity, self.basis, self.style = rarity, signs() @ axes.astype(np.float32), style

    def vectors(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        return np.stack([projected(*x, self.basis, self.rarity, self.style) for x in rows]) if rows else np.zeros((0, self.basis.shape[1]))


@lru_cache(maxsize=1)
def _space(rarity: bytes, axes: bytes, style: float) -> Space:
    return Space(np.frombuffer(rarity), np.frombuffer(axes).reshape(WIDTH, -1), style)


def labelled_vectors(features: DataFrame, labels: DataFrame, space: tuple[bytes, bytes, float], most: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors and labels of at most ``most`` labelled documents, those that come first by a hash of their id.

    A document that has no id teaches nothing, nor does an id labelled both 0
    and 1. Texts are reached through at most ``most`` ids that both tables
    have, and of their rows, however often an id is repeated, the first
    ``most`` are taken.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _space(*space).vectors(unpacked(batch)).astype(np.int16)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array([x.tobytes() for x in rows], pa.binary())], ["doc_id", "quality", "vector"])

    sure = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"), F.max("quality").cast("int").alias("high")).filter("doc_id is not null and quality = high and quality in (0, 1)").drop("high")
    own = features.filter("doc_id is not null and not held_out")
    order = F.xxhash64("doc_id", F.lit(9))
    chosen = sure.join(own.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(order, "doc_id").limit(most)
    rows = own.join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "at", "weight")
    found = rows.mapInArrow(run, "doc_id long, quality int, vector binary").orderBy(order, "doc_id", "vector").limit(most).select("quality", "vector").toPandas()
    if not len(found):
        return np.zeros((0, len(space[1]) // 8 // WIDTH)), np.zeros(0)
    return np.stack([np.frombuffer(x, np.int16) for x in found["vector"]]).astype(float), found["quality"].to_numpy(float)


def votes(vectors: np.ndarray, known: np.ndarray, labels: np.ndarray, neighbours: int, power: float) -> np.ndarray:
    """The weighted share of label 1 among the nearest of ``known`` for each of ``vectors``.

    Neighbours as near as the last one vote, too, so no order of ``known``
    matters. The weight is a power of the cosine; negative cosines have none.
    """
    if not len(known):
        return np.full(len(vectors), 0.5)
    cosine = (vectors @ known.T) / np.maximum(np.linalg.norm(vectors, axis=1)[:, None] * np.linalg.norm(known, axis=1)[None, :], 1e-300)
    n = min(neighbours, len(known))
    last = np.partition(cosine, -n, axis=1)[:, -n]
    row, column = np.nonzero(cosine >= last[:, None] - 1e-9)
    weight = np.maximum(cosine[row, column], 0.0) ** power
    total = np.bincount(row, weight, len(vectors))
    good = np.bincount(row, weight * labels[column], len(vectors))
    return np.where(total > 0, np.minimum(1.0, good / np.where(total > 0, total, 1.0)), labels.mean())


def score(docs: DataFrame, labels: DataFrame, held_out: Column, k: int = 64, most: int = 8192, neighbours: int = 15, power: float = 8.0, style: float = 1.0, block: int = 256) -> DataFrame:
    """doc_id, held_out, score of every whole text of ``docs`` (doc_id, text): how likely its label in ``labels`` (doc_id, quality) is 1.

    Labels of documents that ``held_out`` chooses are never learned from (a
    null choice is none). The labelled sample is bounded by ``most``; rarity
    and axes come from all documents. A null text counts as empty, and an
    empty one has its length as its only term, so that short texts are its
    neighbours. Null ids are scored and teach nothing; repeated rows give
    repeated rows with equal scores. Without labelled rows each score is 0.5,
    with one label only all are that label. An empty table gives no rows,
    extra columns change nothing. A text of any length is one row, and all
    its terms are in memory at once.

    The terms are staged, read for rarity, axes and votes, and deleted once
    the scores are staged.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    features = stage(featured(rows), "terms")
    rarity = place_rarity(features)
    axes = np.ascontiguousarray(principal_axes(features, rarity, k, style))
    space = (rarity.tobytes(), axes.tobytes(), style)
    known, marks = labelled_vectors(features, labels, space, most)
    shared = rows.sparkSession.sparkContext.broadcast((space, known.astype(np.int16), marks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, known, marks = shared.value
        latent, known = _space(*space), known.astype(float)
        for whole in batches:
            for first in range(0, whole.num_rows, block):
                batch = whole.slice(first, block)
                found = votes(latent.vectors(unpacked(batch)), known, marks, neighbours, power)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(found)], ["doc_id", "held_out", "score"])

    scored = stage(features.mapInArrow(run, "doc_id long, held_out boolean, score double"), "votes")
    release(features)
    return scored
