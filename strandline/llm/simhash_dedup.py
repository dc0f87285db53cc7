"""Near-duplicates by SimHash and covering locality-sensitive hashing.

Bits of a fingerprint get vectors of ``radius + 1`` bits. For every non-zero
vector there is a table whose mask keeps the bits that have an odd product with
it. Any ``radius`` differing bits leave a vector orthogonal to all of theirs,
so each pair within the radius agrees in some table: nothing is missed.

Only distinct fingerprints are compared, and only with what shares a bucket. A
bucket of two is one comparison. In a larger one each fingerprint meets those
within two bits at a common neighbour one bit away, so the work grows with the
bucket, not with its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, texts

BITS = 64


def fingerprint(text: str, size: int = 3, seed: int = 42) -> int:
    """A bit is 1 if it is set in over half of the shingles' hashes; without words all are 0."""
    words = text.encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) < size:
        hashes = [xxhash.xxh64_intdigest(line, seed)]
    else:
        ends = np.cumsum([len(x) + 1 for x in words])
        begins = [0, *ends[: len(words) - size].tolist()]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[a:b], seed) for a, b in zip(begins, (ends[size - 1 :] - 1).tolist(), strict=True)]
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    over = 2 * bits.sum(axis=0, dtype=np.int64) > len(hashes)
    return int(np.packbits(over, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = 3, seed: int = 42) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every whole text; a null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x, size, seed) for x in texts(batch)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def covering_masks(radius: int = 2) -> list[int]:
    """Masks such that any two words of 64 bits within ``radius`` agree under one of them."""
    vectors = (1 << radius + 1) - 1
    return [sum(1 << i for i in range(BITS) if ((1 + i % vectors) & v).bit_count() % 2) for v in range(1, vectors + 1)]


def signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def links(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) of fp values, a < b, that connect all that differ in two bits or fewer."""
    masks = covering_masks(2)
    tables = F.array(*(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for t, m in enumerate(masks)))
    rows = distinct.select("fp", F.inline(tables))
    buckets = stage(rows.groupBy("t", "key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).filter("n > 1"), "buckets")
    pairs = buckets.filter("n = 2").filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2).select("a", "b")
    # the bits that a table's mask leaves free, in which alone members of a bucket differ
    free = F.element_at(F.array(*(F.array(F.lit(0).cast("long"), *(F.lit(signed(1 << i)) for i in range(BITS) if not m >> i & 1)) for m in masks)), F.col("t") + 1)
    larger = rows.join(buckets.filter("n > 2").select("t", "key"), ["t", "key"], "left_semi")
    near = larger.select("t", "fp", F.explode(free).alias("bit")).select("t", "fp", F.col("fp").bitwiseXOR(F.col("bit")).alias("z"))
    meet = near.groupBy("t", "z").agg(F.min("fp").alias("a"), F.max("fp").alias("b"), F.count("*").alias("n")).filter("n > 1")
    # most meeting points have two members; the others are joined to find all
    two = meet.filter("n = 2").select("a", "b")
    more = near.join(meet.filter("n > 2").select("t", "z", "a"), ["t", "z"]).filter("fp > a").select("a", F.col("fp").alias("b"))
    return pairs.unionByName(two).unionByName(more).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node that it reaches) of the nodes of ``edges`` (a, b).

    Large-star and small-star steps in turn until nothing changes; each ends
    in a table in the shared folder.
    """
    now = stage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), "edges")
    mark = lambda df: df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).head()
    was = mark(now)
    while was[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # all neighbours of a node are smaller now
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u > v").distinct()
        now = stage(small, "edges")
        if (is_now := mark(now)) == was:
            break
        was = is_now
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the least doc_id reachable by links) of every document.

    Documents link if their fingerprints differ in two bits or fewer; a null
    or blank text has fingerprint zero and links like any other. A null doc_id
    gives no component its name: among such alone it is null. Repeated rows
    give repeated rows, an empty table none; extra columns change nothing. A
    very long text takes memory for its words and their hashes.
    """
    rows = stage(fingerprints(docs), "fingerprints")
    distinct = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    rooted = distinct.join(components(links(distinct.select("fp"))).withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the ids in ``gone``, but for ids that have several texts; of rows equal in id and text one."""
    named = docs.filter("doc_id is not null")
    digest = F.xxhash64("text", F.lit(3))
    forms = named.select("doc_id", digest.alias("digest")).groupBy("doc_id").agg(F.min("digest").alias("low"), F.max("digest").alias("high"), F.count("*").alias("rows"))
    repeated = stage(forms.filter("rows > 1").select("doc_id", (F.col("low") < F.col("high")).alias("several")), "repeated")
    gone = gone.join(repeated.filter("several").select("doc_id"), "doc_id", "left_anti")
    left = named.join(gone, "doc_id", "left_anti")
    # only ids that repeat are sorted for equal rows
    again = left.join(repeated.select("doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return left.join(repeated.select("doc_id"), "doc_id", "left_anti").unionByName(again).unionByName(docs.filter("doc_id is null"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The columns and rows of ``docs``, of each component only the row whose doc_id names it.

    Rows equal in id and text stay once. An id with several texts names none of
    them, so its rows all stay, and rows without doc_id stay as they are.
    """
    return without(docs, near_duplicates(docs).filter("doc_id > component_id").select("doc_id").distinct())
