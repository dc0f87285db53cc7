"""Near-duplicates by the Jaccard similarity of word shingles.

Texts with one set of shingles are one. The others get ``BANDS`` keys of
``ROWS`` MinHash values each; two sets with a similarity of 0.8 have a key in
common but for two or three pairs in 100,000. Of the texts under a key each is
compared, by the whole texts, with the least one; where that leaves several
components, each is compared again with one that is drawn for the key, and the
keys draw differently. So work and rows grow with the texts under a key, not
with their pairs, and what is linked is always similar.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage, texts
from .simhash_dedup import components, near_duplicates, without


def shingles(text: str, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` lower-cased words; a shorter text is one, a blank one has none."""
    words = text.encode().lower().split()
    digest = xxhash.xxh64_intdigest
    if not words:
        return np.empty(0, np.int64)
    line = b" ".join(words)
    if len(words) < size:
        hashes = [digest(line)]
    else:
        ends = np.cumsum([len(x) + 1 for x in words])
        begins = [0, *ends[: len(words) - size].tolist()]
        hashes = [digest(line[a:b]) for a, b in zip(begins, (ends[size - 1 :] - 1).tolist(), strict=True)]
    return np.unique(np.array(hashes, np.uint64).view(np.int64))


ROWS, BANDS = 4, 20
_FACTORS = np.random.default_rng(17).integers(1, 1 << 62, ROWS * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def band_keys(found: np.ndarray) -> np.ndarray:
    """A key for each band of a set; texts whose values in the band are equal share it."""
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    values = found.view(np.uint64)
    for at in range(0, len(values), 2048):
        np.minimum(least, (values[at : at + 2048, None] * _FACTORS).min(axis=0), out=least)
    return np.array([xxhash.xxh3_64_intdigest(x.tobytes(), seed=k) for k, x in enumerate(least.reshape(BANDS, ROWS))], np.uint64).view(np.int64)


def filed(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n (the shingles of its set), a hash of the set, and its keys; a blank text is not filed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, counts, wholes, keys = [], [], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts(batch), strict=True):
                found = shingles(text, size)
                if len(found):
                    ids.append(doc_id)
                    counts.append(len(found))
                    wholes.append(xxhash.xxh128_digest(found.tobytes()))
                    keys.append(band_keys(found))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), pa.array(wholes, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "n", "whole", "keys"])

    return docs.mapInArrow(run, "doc_id long, n long, whole binary, keys array<long>")


def only(docs: DataFrame, ids: DataFrame, most: int = 1 << 21) -> DataFrame:
    """The rows of ``docs`` whose doc_id is in ``ids`` (distinct): by broadcast up to ``most`` of them, so that no other text moves."""
    return docs.join(F.broadcast(ids) if ids.limit(most + 1).count() <= most else ids, "doc_id", "left_semi")


def similar(pairs: DataFrame, docs: DataFrame, size: int, least: float) -> DataFrame:
    """The pairs (a, b) whose texts are similar. The texts of b move to that of a."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, x = None, np.empty(0, np.int64)
        for batch in batches:
            good = []
            for left, right in zip(texts(batch, "left"), texts(batch, "right"), strict=True):
                if left != last:
                    last, x = left, shingles(left, size)
                y = shingles(right, size)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(both >= least * (len(x) + len(y) - both) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    pairs = stage(pairs, "pairs")
    ends = [only(docs, pairs.select(F.col(x).alias("doc_id")).distinct()).select(F.col("doc_id").alias(x), F.col("text").alias(name)) for x, name in (("a", "left"), ("b", "right"))]
    return pairs.join(ends[1], "b").join(ends[0], "a").select("a", "b", "left", "right").mapInArrow(run, "a long, b long")


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of so few rows, as each holds two whole texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, was)


def links(docs: DataFrame, known: DataFrame, size: int = 5, least: float = 0.8) -> DataFrame:
    """Edges (a, b) of doc_id that, with those of ``known``, connect documents with a similarity of ``least`` or more."""
    spark = docs.sparkSession
    docs = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = stage(filed(docs, size), "filed")
    firsts = stage(rows.groupBy("whole").agg(F.min("doc_id").alias("a"), F.count("*").alias("rows")), "firsts")
    same = rows.select("doc_id", "whole").join(firsts.filter("rows > 1"), "whole").filter("doc_id > a").select("a", F.col("doc_id").alias("b"))
    # a repeated id may have several texts, and its rows repeat
    single = rows.join(firsts.select("whole", F.col("a").alias("doc_id")), ["whole", "doc_id"], "left_semi").dropDuplicates(["doc_id", "whole"])
    under = single.select("doc_id", "n", F.explode("keys").alias("key"))
    pivots = stage(under.groupBy("key").agg(F.min(F.struct("doc_id", "n")).alias("pivot"), F.count("*").alias("rows")).filter("rows > 1").select("key", "pivot"), "pivots")
    under = stage(under.join(pivots, "key"), "under")
    able = (F.least("n", "pivot.n") >= F.lit(least) * F.greatest("n", "pivot.n") - 1e-9) & (F.col("doc_id") != F.col("pivot.doc_id"))
    ends = [F.least("doc_id", "pivot.doc_id").alias("a"), F.greatest("doc_id", "pivot.doc_id").alias("b")]
    edges = known.unionByName(same)
    with small_batches(spark, 64):
        edges = stage(edges.unionByName(similar(under.filter(able).select(*ends).distinct(), docs, size, least)), "links")
        rooted = under.select("key", "doc_id", "n").join(components(edges).withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
        rooted = stage(rooted, "rooted")
        drawn = F.min(F.struct(F.xxhash64("doc_id", "key").alias("order"), "doc_id", "n", "root")).alias("pivot")
        apart = stage(rooted.groupBy("key").agg(drawn, F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("key", "pivot"), "apart")
        again = rooted.join(apart, "key").filter(able & (F.col("root") != F.col("pivot.root")))
        return edges.unionByName(stage(similar(again.select(*ends).distinct(), docs, size, least), "links"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The columns and rows of ``docs``, of each component only the row with the least doc_id.

    Documents link as in ``near_duplicates`` and, by MinHash keys, at a Jaccard
    similarity of 0.8 or more of five-word shingles. Rows equal in id and text
    stay once. An id with several texts names none of them, so its rows all
    stay, and rows without doc_id stay as they are.
    """
    known = near_duplicates(docs).filter("doc_id > component_id").select(F.col("component_id").alias("a"), F.col("doc_id").alias("b")).distinct()
    gone = components(links(docs, stage(known, "known"))).filter("root < node").select(F.col("node").alias("doc_id"))
    return without(docs, gone)
