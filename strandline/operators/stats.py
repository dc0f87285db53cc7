"""Statistics as relational operators; small-sample p-values in numpy."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.prng import uniform
from .ranks import placed, running


def with_rank(rows: DataFrame, value: str, name: str, *by: str) -> DataFrame:
    """``rows`` with the rank of a value from 1 in its class; equal values get the mean of theirs.

    Ranks come from how often each value occurs and running sums over ranges
    of the values, so that no class is sorted by one task.
    """
    keys = {c: F.col(c) for c in (*by, value)}
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_t"))
    ranks = running(counts, list(by), value, "_t")
    ranks = ranks.select(*(F.col(c).alias(f"_{c}_") for c in keys), (F.col("before") + (F.col("_t") + 1) / 2).alias(name))
    same = F.lit(True)
    for c in keys:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}_"))
    return rows.join(ranks, same).drop(*(f"_{c}_" for c in keys))


def spearman(rows: DataFrame, x: str, y: str, *by: str) -> DataFrame:
    """Rank correlation over complete pairs; null below three."""
    ranked = with_rank(with_rank(rows.dropna(subset=[x, y]).select(*by, x, y), x, "_rx", *by), y, "_ry", *by)
    return ranked.groupBy(*by).agg(F.count("*").alias("n"), F.when(F.count("*") >= 3, F.corr("_rx", "_ry")).alias("rho"))


def partial_spearman(rows: DataFrame, x: str, y: str, z: str, *by: str) -> DataFrame:
    """Rank correlation of x and y given z; null below four pairs or without variance."""
    ranked = rows.dropna(subset=[x, y, z]).select(*by, x, y, z)
    for name in (x, y, z):
        ranked = with_rank(ranked, name, f"r_{name}", *by)
    c = lambda a, b: F.corr(f"r_{a}", f"r_{b}")
    sums = ranked.groupBy(*by).agg(F.count("*").alias("n"), c(x, y).alias("xy"), c(x, z).alias("xz"), c(y, z).alias("yz"))
    left = (1 - F.col("xz") * F.col("xz")) * (1 - F.col("yz") * F.col("yz"))
    value = F.when((F.col("n") >= 4) & (left > 1e-12), (F.col("xy") - F.col("xz") * F.col("yz")) / F.sqrt(left))
    return sums.select(*by, "n", value.alias("rho"))


def ols(rows: DataFrame, x: str, y: str, *by: str) -> DataFrame:
    """Regression on standardised variables: beta, its error and R squared; null below three pairs."""
    sums = rows.dropna(subset=[x, y]).groupBy(*by).agg(F.count("*").alias("n"), F.corr(x, y).alias("beta"))
    enough = F.col("n") >= 3
    error = F.sqrt(F.greatest(1 - F.col("beta") * F.col("beta"), F.lit(0.0)) / F.greatest(F.col("n") - 2, F.lit(1)))
    return sums.select(*by, "n", F.when(enough, F.col("beta")).alias("beta"), F.when(enough, error).alias("se"), F.when(enough, F.col("beta") * F.col("beta")).alias("r2"))


def cohens_d(rows: DataFrame, value: str, first: Column, *by: str) -> DataFrame:
    """Difference of two groups' means over their pooled deviation; 0 for under two rows in either or no deviation."""
    one, two = F.when(first, F.col(value)), F.when(~first, F.col(value))
    sums = rows.dropna(subset=[value]).groupBy(*by).agg(F.count(one).alias("n1"), F.count(two).alias("n2"), F.avg(one).alias("m1"), F.avg(two).alias("m2"), F.var_samp(one).alias("v1"), F.var_samp(two).alias("v2"))
    pooled = F.sqrt(F.try_divide((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2"), F.col("n1") + F.col("n2") - 2))
    return sums.select(*by, "n1", "n2", F.when((F.col("n1") < 2) | (F.col("n2") < 2) | (pooled <= 1e-12), 0.0).otherwise((F.col("m1") - F.col("m2")) / pooled).alias("d"))


def paired(rows: DataFrame, x: str, y: str, *by: str) -> DataFrame:
    """Of pairs: dz (mean difference over its deviation, 0 if undefined) and t."""
    sums = rows.dropna(subset=[x, y]).withColumn("diff", F.col(x) - F.col(y)).groupBy(*by).agg(F.count("*").alias("n"), F.avg("diff").alias("m"), F.stddev_samp("diff").alias("s"))
    usable = (F.col("n") >= 2) & (F.col("s") > 1e-12)
    return sums.select(*by, "n", F.when(usable, F.col("m") / F.col("s")).otherwise(0.0).alias("dz"), F.when(usable, F.col("m") / (F.col("s") / F.sqrt("n"))).alias("t"))


def mann_whitney(rows: DataFrame, value: str, first: Column, *by: str) -> DataFrame:
    """U of the first group, and its two-sided p: exact for small samples without ties, else normal, with ties and continuity.

    Small: ``FEW`` values at most in either sample, and as many pairs at most
    as ``PAIRS``.
    """
    base = rows.dropna(subset=[value]).withColumn("first", first)
    counts = base.groupBy(*by, value).agg(F.count("*").alias("t"), F.count_if("first").alias("t1"))
    ranked = running(counts, list(by), value, "t").withColumn("rank", F.col("before") + (F.col("t") + 1) / 2)
    sums = ranked.groupBy(*by).agg(F.sum("t").alias("n"), F.sum("t1").alias("n1"), F.sum(F.col("rank") * F.col("t1")).alias("r1"), F.sum(F.pow(F.col("t").cast("double"), F.lit(3)) - F.col("t")).alias("ties"))
    n1, n = F.col("n1").cast("double"), F.col("n").cast("double")
    u = F.col("r1") - n1 * (n1 + 1) / 2
    deviation = F.sqrt(n1 * (n - n1) / 12 * ((n + 1) - F.try_divide(F.col("ties"), n * (n - 1))))
    z = F.try_divide(F.greatest(F.abs(u - n1 * (n - n1) / 2) - 0.5, F.lit(0.0)), deviation)
    return sums.select(*by, "n1", (F.col("n") - F.col("n1")).alias("n2"), u.alias("u"), rank_sum_p(u, F.col("n1"), F.col("n") - F.col("n1"), F.col("ties"), z).alias("p"))


FEW, PAIRS = 8, 10_000


@F.pandas_udf(DoubleType())
def rank_sum_p(u: pd.Series, n1: pd.Series, n2: pd.Series, ties: pd.Series, z: pd.Series) -> pd.Series:
    def one(u: float, a: int, b: int, ties: float, z: float) -> float | None:
        if not ties and 0 < min(a, b) <= FEW and a * b <= PAIRS:
            ways = ways_of_u(min(a, b), max(a, b))
            tail = ways[int(max(u, a * b - u)) :].sum() / ways.sum()
            return float(min(1.0, 2 * tail))
        return None if pd.isna(z) else math.erfc(abs(z) / math.sqrt(2))

    return pd.Series([one(*x) for x in zip(u, n1, n2, ties, z, strict=True)], dtype=float)


@lru_cache(maxsize=256)
def ways_of_u(few: int, many: int) -> np.ndarray:
    """How many orders of two samples have each U: sums of ``few`` numbers from 0 to ``many`` in ascending order."""
    ways = np.zeros((few + 1, few * many + 1))
    ways[0, 0] = 1
    for size in range(1, many + 1):
        for k in range(1, few + 1):
            ways[k, size:] += ways[k - 1, :-size]
    return ways.sum(axis=0)


def wilcoxon(rows: DataFrame, x: str, y: str, *by: str) -> DataFrame:
    """Signed-rank W (the smaller sum) over non-zero differences, and its two-sided p: exact up to 25 without ties, else normal."""
    diff = rows.dropna(subset=[x, y]).withColumn("diff", F.col(x) - F.col(y)).filter(F.abs("diff") > 1e-12).withColumn("size", F.abs("diff"))
    counts = diff.groupBy(*by, "size").agg(F.count("*").alias("t"), F.count_if(F.col("diff") > 0).alias("t1"))
    ranked = running(counts, list(by), "size", "t").withColumn("rank", F.col("before") + (F.col("t") + 1) / 2)
    sums = ranked.groupBy(*by).agg(F.sum("t").alias("n"), F.sum(F.col("rank") * F.col("t1")).alias("plus"), F.sum(F.col("rank") * (F.col("t") - F.col("t1"))).alias("minus"), F.sum(F.pow(F.col("t").cast("double"), F.lit(3)) - F.col("t")).alias("ties"))
    w = F.least("plus", "minus")
    return sums.select(*by, "n", F.when(F.col("n") >= 2, w).alias("w"), F.when(F.col("n") >= 2, signed_rank_p(w, F.col("n"), F.col("ties"))).alias("p"))


@F.pandas_udf(DoubleType())
def signed_rank_p(w: pd.Series, n: pd.Series, ties: pd.Series) -> pd.Series:
    def one(w: float, n: int, ties: float) -> float:
        if n <= 25 and not ties:
            ways = np.zeros(n * (n + 1) // 2 + 1)
            ways[0] = 1
            for k in range(1, n + 1):
                ways[k:] += ways[:-k].copy()
            return float(min(1.0, 2 * ways[: int(w) + 1].sum() / 2.0**n))
        deviation = math.sqrt(max(n * (n + 1) * (2 * n + 1) / 24 - ties / 48, 1e-300))
        return math.erfc(abs(w - n * (n + 1) / 4) / deviation / math.sqrt(2))

    return pd.Series([None if pd.isna(a) else one(a, int(b), c) for a, b, c in zip(w, n, ties, strict=True)])


def student_p(t: float, df: float) -> float:
    """Two-sided p of Student's t, by the incomplete beta function's continued fraction."""
    x = df / (df + t * t)
    a, b = df / 2, 0.5
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))

    def fraction(a: float, b: float, x: float) -> float:
        c, d = 1.0, 1 - (a + b) * x / (a + 1)
        d = 1 / (d or 1e-30)
        h = d
        for m in range(1, 400):
            for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 / ((1 + top * d) or 1e-30)
                c = (1 + top / c) or 1e-30
                h *= d * c
            if abs(d * c - 1) < 1e-14:
                break
        return h

    return front * fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(b, a, 1 - x) / b


@F.pandas_udf(DoubleType())
def t_test_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) or pd.isna(b) or b < 1 else student_p(a, b) for a, b in zip(t, df, strict=True)])


@F.pandas_udf(DoubleType())
def t_bound(df: pd.Series, alpha: pd.Series) -> pd.Series:
    """The t that |t| exceeds with probability ``alpha``, by bisection."""

    def found(n: float, p: float) -> float | None:
        if pd.isna(n) or n < 1:
            return None
        low, high = 0.0, 1.0
        while student_p(high, n) > p and high < 1e12:
            low, high = high, high * 2
        for _ in range(80):
            middle = (low + high) / 2
            low, high = (middle, high) if student_p(middle, n) > p else (low, middle)
        return (low + high) / 2

    return pd.Series([found(n, p) for n, p in zip(df, alpha, strict=True)])


def ols_interval(fits: DataFrame, alpha: float = 0.05) -> DataFrame:
    """The rows of ``ols`` with the interval of beta and its p."""
    bound = t_bound((F.col("n") - 2).cast("double"), F.lit(alpha))
    return fits.withColumn("low", F.col("beta") - bound * F.col("se")).withColumn("high", F.col("beta") + bound * F.col("se")).withColumn("p", correlation_p(F.col("beta"), F.col("n")))


def correlation_p(rho: Column, n: Column) -> Column:
    """Two-sided p of a correlation with n - 2 degrees of freedom."""
    t = rho * F.sqrt(F.try_divide(n - 2, 1 - rho * rho))
    return F.when(F.abs(rho) >= 1, 0.0).otherwise(t_test_p(t, (n - 2).cast("double")))


def adjusted(rows: DataFrame, p: str, order: str, *by: str) -> DataFrame:
    """Benjamini-Hochberg: ``q`` beside ``p``; nulls stay null and don't count."""
    known = rows.filter(F.col(p).isNotNull() & ~F.isnan(p))
    ranks = known.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(p, order))).withColumn("_m", F.count("*").over(Window.partitionBy(*by)))
    backward = Window.partitionBy(*by).orderBy(F.desc("_k"))
    q = ranks.withColumn("q", F.least(F.min(F.col(p) * F.col("_m") / F.col("_k")).over(backward), F.lit(1.0))).drop("_k", "_m")
    return q.unionByName(rows.filter(F.col(p).isNull() | F.isnan(p)).withColumn("q", F.lit(None).cast("double")))


def bootstrap(rows: DataFrame, value: str, order: str, *by: str, replicates: int = 2000, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """Percentile interval of the mean.

    Replicate b draws for place i the row with index floor(u(seed, b, i) * n),
    so resamples are the same in any group of a size. The work is rows times
    replicates, spread over tasks; places come by ranges, so no group is
    sorted by one.
    """
    ranked = placed(rows.dropna(subset=[value]).select(*by, value, order), list(by), [F.col(order)], "i").withColumn("i", F.col("i") - 1)
    draws = ranked.select(*by, "i", "n", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("b"))
    drawn = draws.select(*by, "b", F.floor(uniform(seed, F.col("b"), F.col("i")) * F.col("n")).alias("i"))
    means = drawn.join(ranked.select(*by, "i", F.col(value).alias("v")), [*by, "i"]).groupBy(*by, "b").agg(F.avg("v").alias("mean"))
    bounds = means.groupBy(*by).agg(F.percentile("mean", F.lit(alpha / 2)).alias("low"), F.percentile("mean", F.lit(1 - alpha / 2)).alias("high"))
    return bounds.join(ranked.groupBy(*by).agg(F.avg(value).alias("mean"), F.count("*").alias("n")), list(by)) if by else bounds.crossJoin(ranked.agg(F.avg(value).alias("mean"), F.count("*").alias("n")))


def kendall(ranks: DataFrame, item: str, ranking: str, place: str) -> DataFrame:
    """tau between all rankings a < b of the same few items."""
    left = ranks.select(F.col(item).alias("item"), F.col(ranking).alias("a"), F.col(place).alias("pa"))
    right = ranks.select(F.col(item).alias("item"), F.col(ranking).alias("b"), F.col(place).alias("pb"))
    both = left.join(right, "item").filter("a < b")
    other = both.select("a", "b", F.col("item").alias("item2"), F.col("pa").alias("pa2"), F.col("pb").alias("pb2"))
    pairs = both.join(other, ["a", "b"]).filter("item < item2")
    sign = F.signum(F.col("pa") - F.col("pa2")) * F.signum(F.col("pb") - F.col("pb2"))
    tied = lambda x: F.sum(F.when(F.col(x) != F.col(f"{x}2"), 1).otherwise(0))
    return pairs.groupBy("a", "b").agg(F.try_divide(F.sum(sign), F.sqrt(tied("pa").cast("double") * tied("pb"))).alias("tau"))


def min_max(value: str, *by: str) -> Column:
    window = Window.partitionBy(*by)
    low = F.min(value).over(window)
    return (F.col(value) - low) / (F.max(value).over(window) - low + 1e-9)


def printed(digits: int):
    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda x: None if pd.isna(x) else f"{x:.{digits}f}").astype(object)

    return run


def shown(value: Column, digits: int = 3, is_p: bool = False) -> Column:
    """As tables show numbers: ``--`` if undefined, small p-values as a bound.

    A double is rounded by its exact value, ties to even, as C's printf does;
    Java's format rounds its shortest decimal form half up.
    """
    text = printed(digits)(value.cast("double"))
    return F.when(value.isNull() | F.isnan(value), "--").when(F.lit(is_p) & (value < 0.001), "<0.001").otherwise(text)
