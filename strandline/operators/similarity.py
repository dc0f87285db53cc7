"""Exact cosine searches over sparse vectors, with bounds that keep most pairs from being summed.

Terms have one order, from common to rare. Of a vector x of length one, x[t]
are the terms up to t, the common ones. Whatever two vectors share there adds
at most |x[t]| * |y[t]| to their cosine.

Pairs: a vector's entries are its rarest terms, so many that the rest is
shorter than the least similarity; among them, its short entries are so many
that the rest is shorter than its square root. A similar pair shares a term
that is an entry of both and a short one of one of them: of x and y let x be the
one whose short entries reach to the more common term s. If they share nothing
rarer than s, both rests are under the root, and the cosine under their
product. If y's entries end before s, at e, and nothing is shared rarer than
e, y's rest alone is too short. So entries meet short entries only; where they
do, a pair's sum so far and its rests give an upper bound. Pairs whose bound is
high enough get a closer one from all their entries, and only where that is high
enough, too, whole vectors are compared.

A term of many entries is dealt into a grid of cells, so that no task has all
of its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .checkpoints import saved

SLACK = 1e-9


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of so few rows, as each may hold long arrays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, was)


def packed(weights: DataFrame, item: str) -> DataFrame:
    """i, terms (64-bit numbers, from common to rare), weights (of length one), dfs: a row for each item of ``weights`` (item, term, weight and perhaps df)."""
    if "df" not in weights.columns:
        weights = weights.join(weights.groupBy("term").agg(F.count("*").alias("df")), "term")
    number = F.col("term") if weights.schema["term"].dataType.simpleString() == "bigint" else F.xxhash64("term")
    entry = F.struct((-F.col("df")).alias("order"), "number", "weight")
    rows = weights.select(F.col(item).alias("i"), "df", number.alias("number"), F.col("weight").cast("double").alias("weight"))
    sorted_ = rows.groupBy("i").agg(F.sort_array(F.collect_list(entry)).alias("e"))
    return sorted_.select("i", F.col("e.number").alias("terms"), F.col("e.weight").alias("weights"), F.transform("e.order", lambda x: -x).alias("dfs"))


def entries(vectors: DataFrame, least: float) -> DataFrame:
    """term, i, w, before, after (lengths of the more common and of the rarer terms), short: the entries that can meet another."""
    kind = vectors.schema["i"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[np.ndarray]] = [[] for _ in range(6)]
            columns = [batch.column(x) for x in ("terms", "weights", "dfs")]
            for k in range(batch.num_rows):
                terms, weight, df = (np.asarray(x[k].values) for x in columns)
                upto = np.cumsum(weight * weight)
                before = np.sqrt(np.maximum(upto - weight * weight, 0.0))
                keep = (np.sqrt(upto) >= least - SLACK) & (df > 1)
                found = (terms, np.full(len(terms), k), weight, before, np.sqrt(np.maximum(upto[-1:] - upto, 0.0)), np.sqrt(upto) >= least**0.5 - SLACK)
                for column, x in zip(out, found, strict=True):
                    column.append(x[keep])
            flat = [np.concatenate(x) if x else np.empty(0) for x in out]
            arrays = [pa.array(flat[0].astype(np.int64)), batch.column("i").take(pa.array(flat[1].astype(np.int64))), *(pa.array(x.astype(float)) for x in flat[2:5]), pa.array(flat[5].astype(bool))]
            yield pa.RecordBatch.from_arrays(arrays, ["term", "i", "w", "before", "after", "short"])

    return vectors.mapInArrow(run, f"term long, i {kind}, w double, before double, after double, short boolean")


def meetings(found: DataFrame, least: float, cell: int = 1024) -> DataFrame:
    """term, x, y (its cell), a < b, part (what the term adds), rest (what more common ones can): where an entry meets a short one."""
    sizes = found.groupBy("term").agg(F.count_if("short").alias("s"), F.count("*").alias("l")).filter("s > 0 and l > 1")
    cells = lambda n: F.ceil(F.col(n) / cell).cast("int")
    dealt = found.join(sizes.select("term", cells("s").alias("ns"), cells("l").alias("nl")), "term")
    own = lambda n, seed: F.pmod(F.xxhash64("i", F.lit(seed)), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["term", "x", "y", "i", "w", "before", "after", "short"]
    left = dealt.filter("short").withColumn("x", own("ns", 1)).withColumn("y", each("nl")).select(*columns)
    right = dealt.withColumn("y", own("nl", 2)).withColumn("x", each("ns")).select(*columns)
    left, right = left.toDF(*columns[:3], *(f"{c}_l" for c in columns[3:])), right.toDF(*columns[:3], *(f"{c}_r" for c in columns[3:]))
    once = (F.col("i_l") != F.col("i_r")) & (~F.col("short_r") | (F.col("i_l") < F.col("i_r")))
    product = lambda c: F.col(f"{c}_l") * F.col(f"{c}_r")
    can = product("w") + product("before") + product("after") >= least - SLACK
    ends = [F.least("i_l", "i_r").alias("a"), F.greatest("i_l", "i_r").alias("b")]
    return left.join(right, ["term", "x", "y"]).filter(once & can).select("term", "x", "y", *ends, product("w").alias("part"), product("before").alias("rest"))


def candidates(found: DataFrame, least: float, cell: int = 1024) -> DataFrame:
    """a < b of the pairs of ``entries`` whose upper bound reaches ``least``."""
    sums = meetings(found, least, cell).groupBy("a", "b").agg(F.sum("part").alias("sum"), F.min("rest").alias("rest"))
    return sums.filter(F.col("sum") + F.col("rest") >= least - SLACK).select("a", "b")


def heads(vectors: DataFrame, least: float) -> DataFrame:
    """i, t, w, d, before: the entries of each item as arrays, from common to rare; the length of what is more common than each."""
    kind = vectors.schema["i"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[np.ndarray]] = [[], [], [], []]
            columns = [batch.column(x) for x in ("terms", "weights", "dfs")]
            for k in range(batch.num_rows):
                terms, weight, df = (np.asarray(x[k].values) for x in columns)
                upto = np.cumsum(weight * weight)
                first = int(np.searchsorted(np.sqrt(upto), least - SLACK))
                for column, x in zip(out, (terms, weight, df, np.sqrt(np.maximum(upto - weight * weight, 0.0))), strict=True):
                    column.append(x[first:])
            arrays = [pa.array(x, pa.list_(t)) for x, t in zip(out, (pa.int64(), pa.float64(), pa.int64(), pa.float64()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("i"), *arrays], ["i", "t", "w", "d", "before"])

    return vectors.mapInArrow(run, f"i {kind}, t array<long>, w array<double>, d array<long>, before array<double>")


def promising(pairs: DataFrame, own: DataFrame, least: float) -> DataFrame:
    """a, b of the pairs whose bound from all their entries reaches ``least``.

    What two items share among the entries is summed; the terms more common
    than the entries of the one whose entries end first are bounded by lengths.
    """
    kind = own.schema["i"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [[batch.column(f"{x}{side}") for x in ("t", "w", "d", "before")] for side in "ab"]
            keep = np.zeros(batch.num_rows, bool)
            for k in range(batch.num_rows):
                (ta, wa, da, ba), (tb, wb, db, bb) = ([np.asarray(x[k].values) for x in side] for side in columns)
                _, x, y = np.intersect1d(ta, tb, assume_unique=True, return_indices=True)
                if (da[0], -ta[0]) > (db[0], -tb[0]):  # b's entries end first: at a rarer term
                    ta, da, ba, tb, db, bb = tb, db, bb, ta, da, ba
                rarer = np.flatnonzero((db < da[0]) | ((db == da[0]) & (tb >= ta[0])))
                rest = ba[0] * (bb[rarer[0]] if len(rarer) else 1.0)
                keep[k] = shared(wa, wb, x, y) + rest >= least - SLACK
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    side = lambda c: own.select(F.col("i").alias(c), *(F.col(x).alias(f"{x}{c}") for x in ("t", "w", "d", "before")))
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(run, f"a {kind}, b {kind}")


def shared(wa: np.ndarray, wb: np.ndarray, x: np.ndarray, y: np.ndarray) -> float:
    return float(wa[x] @ wb[y])


def compared(pairs: DataFrame, vectors: DataFrame, least: float) -> DataFrame:
    """a, b, similarity of the pairs with a cosine of ``least`` or more, from whole vectors."""
    kind = vectors.schema["i"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(x) for x in ("ta", "wa", "tb", "wb")]
            cosine = np.zeros(batch.num_rows)
            for k in range(batch.num_rows):
                ta, wa, tb, wb = (np.asarray(x[k].values) for x in columns)
                _, x, y = np.intersect1d(ta, tb, assume_unique=True, return_indices=True)
                cosine[k] = shared(wa, wb, x, y)
            near = batch.select(["a", "b"]).append_column("similarity", pa.array(cosine))
            yield near.filter(pa.array(cosine >= least - 1e-12))

    side = lambda c: vectors.select(F.col("i").alias(c), F.col("terms").alias(f"t{c}"), F.col("weights").alias(f"w{c}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ta", "wa", "tb", "wb").mapInArrow(run, f"a {kind}, b {kind}, similarity double")


def similar_pairs(weights: DataFrame, item: str, least: float, cell: int = 1024) -> DataFrame:
    """a < b, similarity of all pairs of items with a cosine of ``least`` or more; exact.

    ``weights``: item, term, weight, each item of length one, each of its
    terms once; ``df`` too where it is known. ``least`` is over 0. An item's
    terms are one row. An empty table gives no pairs.
    """
    spark = weights.sparkSession
    vectors = saved(packed(weights, item))
    with small_batches(spark, 256):
        met = saved(candidates(entries(vectors, least), least, cell))
        return saved(compared(saved(promising(met, heads(vectors, least), least)), vectors, least))


def greatest_similarity(queries: DataFrame, item: str, label: str, others: DataFrame, other_label: str) -> DataFrame:
    """Of each query: its largest cosine with any of ``others``, and with those of its own label; 0 where no term is shared.

    Both sides: item, label, term, weight, of length one; none negative. Exact,
    by a search for the best one that ends early: the query's rarest terms,
    half of its length, are summed first, and the best that they find is
    scored in whole. From then on a document counts only if it can reach that:
    the query's most common terms, which all together can't, find none, and of
    those found only the ones whose sum so far and bounds of the rest (the
    length of the query's rest, and its weights times the terms' largest
    weights in ``others``) reach it are scored.
    """
    return searched(queries, item, label, others, other_label)[0]


def searched(queries: DataFrame, item: str, label: str, others: DataFrame, other_label: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``greatest_similarity``, and the pairs (i, other) found and scored in whole."""
    asked = queries.select(F.col(item).alias("i"), F.col(label).alias("own"), "term", F.col("weight").alias("wa"))
    there = others.join(asked.select("term").distinct(), "term", "left_semi").select(F.col(item).alias("other"), F.col(other_label).alias("theirs"), "term", F.col("weight").alias("wb"))
    there = saved(there)
    about = there.groupBy("term").agg(F.count("*").alias("df"), F.max("wb").alias("most"))
    order = Window.partitionBy("i").orderBy(F.desc("df"), "term").rowsBetween(Window.unboundedPreceding, 0)
    # terms that no document has take no part; length and bound of a query's terms up to each, from common to rare
    asked = saved(asked.join(about, "term").withColumn("upto", F.sqrt(F.sum(F.col("wa") * F.col("wa")).over(order))).withColumn("bound", F.sum(F.col("wa") * F.col("most")).over(order)))
    same = F.col("own").eqNullSafe(F.col("theirs"))

    def sums(terms: DataFrame, docs: DataFrame) -> DataFrame:
        return terms.join(docs, "term").groupBy("i", "own", "other", "theirs").agg(F.sum(F.col("wa") * F.col("wb")).alias("s"))

    def scored(pairs: DataFrame) -> DataFrame:
        chosen = pairs.select("i", "other").distinct()
        docs = there.join(chosen, "other")
        return asked.join(docs, ["i", "term"]).groupBy("i", "own", "other", "theirs").agg(F.sum(F.col("wa") * F.col("wb")).alias("s"))

    def best(scores: DataFrame, suffix: str) -> DataFrame:
        return scores.groupBy("i").agg(F.max("s").alias(f"any{suffix}"), F.max(F.when(same, F.col("s"))).alias(f"same{suffix}"))

    first = sums(asked.withColumn("all", F.max("upto").over(Window.partitionBy("i"))).filter(F.col("upto") * F.col("upto") >= F.col("all") * F.col("all") / 2), there)
    tops = first.groupBy("i").agg(F.max_by("other", "s").alias("x"), F.max_by(F.when(same, F.col("other")), F.when(same, F.col("s"))).alias("y"))
    tops = saved(tops.select("i", F.explode(F.array("x", "y")).alias("other")).filter("other is not null").distinct())
    reach = saved(best(scored(tops), "_low"))
    low = asked.join(reach, "i", "left").withColumn("any_low", F.coalesce("any_low", F.lit(0.0))).withColumn("same_low", F.coalesce("same_low", F.lit(0.0)))
    # same_low is never over any_low, and nothing is left out where it is 0; documents of other labels need fewer terms
    most = F.least("upto", "bound")
    low = low.withColumn("no_other", most < F.col("any_low") - SLACK).withColumn("no_own", most < F.col("same_low") - SLACK)
    rest = low.groupBy("i").agg(*(F.coalesce(F.max(F.when(F.col(x), most)), F.lit(0.0)).alias(f"rest_{x}") for x in ("no_other", "no_own")))
    met = low.filter("not no_own").join(there, "term").filter(same | ~F.col("no_other"))
    found = saved(met.groupBy("i", "own", "other", "theirs").agg(F.sum(F.col("wa") * F.col("wb")).alias("s")))
    able = found.join(rest, "i").join(reach, "i", "left")
    high = F.col("s") + F.when(same, F.col("rest_no_own")).otherwise(F.col("rest_no_other")) + SLACK
    able = saved(able.filter((high >= F.coalesce("any_low", F.lit(0.0))) | (same & (high >= F.coalesce("same_low", F.lit(0.0))))).select("i", "other"))
    final = best(scored(able), "")
    result = queries.select(item).distinct().join(final.withColumnRenamed("i", item), item, "left")
    return result.select(item, F.coalesce("any", F.lit(0.0)).alias("max_any"), F.coalesce("same", F.lit(0.0)).alias("max_same")), found, able
