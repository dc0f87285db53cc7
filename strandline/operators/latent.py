"""Profiles of vectors: extremes, curves over layers, covariance spectra."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V


def extremes(rows: DataFrame, *by: str, low: str, high: tuple[str, ...]) -> DataFrame:
    return rows.groupBy(*by).agg(F.min(low).alias(f"min_{low}"), *(F.max(c).alias(f"max_{c}") for c in high))


def mean_curve(rows: DataFrame, by: str, values: str) -> DataFrame:
    """Element-wise mean of arrays, position from 0, over rows of each group's most common length (the shorter of equals)."""
    sized = rows.select(by, values, F.size(values).alias("size")).filter("size > 0")
    order = Window.partitionBy(by).orderBy(F.desc("count"), "size")
    common = sized.groupBy(by, "size").count().withColumn("k", F.row_number().over(order)).filter("k = 1").select(by, "size")
    long = sized.join(common, [by, "size"], "left_semi").select(by, "size", F.posexplode(values).alias("position", "value"))
    depth = F.try_divide(F.col("position").cast("double"), (F.first("size") - 1).cast("double"))
    return long.groupBy(by, "position").agg(F.avg("value").alias("mean"), depth.alias("depth"))


def curve_hourglass(curve: DataFrame, by: str) -> DataFrame:
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("position", "mean"))), lambda x: x["mean"])
    return curve.groupBy(by).agg(V.hourglass(ordered).alias("hourglass"))


def map_means(rows: DataFrame, by: str, values: str) -> DataFrame:
    """Mean by integer key of maps whose keys are text."""
    long = rows.select(by, F.explode(values).alias("key", "value")).select(by, F.col("key").cast("int").alias("length"), "value")
    return long.groupBy(by, "length").agg(F.avg("value").alias("mean"))


def prefix_measure(rows: DataFrame, values: str, lengths: list[int], measure) -> DataFrame:
    """A measure of each array's prefixes; lengths beyond the array are left out."""
    each = rows.withColumn("length", F.explode(F.array(*map(F.lit, lengths)))).filter(F.col("length") <= F.size(values))
    return each.withColumn("value", measure(F.slice(values, F.lit(1), F.col("length"))))


def prefix_summary(measured: DataFrame, *by: str) -> DataFrame:
    """Floor and mean over the schedule."""
    return measured.groupBy(*by).agg(F.min("value").alias("floor"), F.avg("value").alias("mean"))


def sample_size_means(rows: DataFrame, by: list[str], order: str, value: str, sizes: list[int]) -> DataFrame:
    """Means of each group's first s rows for the sizes that it has, else of all of them.

    A row counts for the sizes that its rank is within, so each size is one
    partial aggregate; only ranks are computed over the ordered group.
    """
    ranked = rows.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy(order)))
    wide = ranked.groupBy(*by).agg(F.count("*").alias("n"), F.avg(value).alias("all"), *(F.avg(F.when(F.col("k") <= s, F.col(value))).alias(f"m{s}") for s in sizes))
    each = F.array(*(F.when(F.col("n") >= s, F.struct(F.lit(s).cast("long").alias("size"), F.col(f"m{s}").alias("mean"))) for s in sizes))
    own = F.array(F.struct(F.col("n").alias("size"), F.col("all").alias("mean")))
    there = F.array_compact(each)
    return wide.select(*by, F.inline(F.when(F.size(there) > 0, there).otherwise(own)))


def covariance(rows: DataFrame, by: str, vector: str) -> DataFrame:
    """Covariance entries (i <= j) of vectors by group, divisor max(n - 1, 1).

    Each task keeps count, means and centred products of its groups and merges
    batches into them; what is shuffled is a matrix for each task and group,
    whatever the number of rows, and is merged in the same way. No square of a
    mean is ever taken away, so vectors far from zero lose nothing.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        moments: dict = {}
        for batch in batches:
            for key, group in batch.groupby(by):
                x = np.stack(group[vector].to_numpy()).astype(float)
                mean = x[0] + (x - x[0]).mean(axis=0)
                own = (len(x), mean, (x - mean).T @ (x - mean))
                moments[key] = merged(moments[key], own) if key in moments else own
        for key, (n, mean, products) in moments.items():
            i, j = np.triu_indices(len(mean))
            yield pd.DataFrame({by: key, "i": i, "j": j, "n": n, "mi": mean[i], "mj": mean[j], "p": products[i, j]})

    kind = rows.schema[by].dataType.simpleString()
    parts = rows.select(by, vector).dropna().mapInPandas(run, f"{by} {kind}, i int, j int, n long, mi double, mj double, p double")
    # as many entries as there are tasks
    lists = parts.groupBy(by, "i", "j").agg(F.sort_array(F.collect_list(F.struct("n", "mi", "mj", "p"))).alias("x"))

    def add(a: Column, b: Column) -> Column:
        n, di, dj = a["n"] + b["n"], b["mi"] - a["mi"], b["mj"] - a["mj"]
        share = b["n"] / n
        return F.struct(n.alias("n"), (a["mi"] + di * share).alias("mi"), (a["mj"] + dj * share).alias("mj"), (a["p"] + b["p"] + di * dj * a["n"] * share).alias("p"))

    total = lists.withColumn("t", F.aggregate(F.slice("x", 2, F.greatest(F.size("x") - 1, F.lit(1))), F.element_at("x", 1), add))
    return total.select(by, "i", "j", F.col("t.n").alias("n"), (F.col("t.p") / F.greatest(F.col("t.n") - 1, F.lit(1))).alias("c"))


def merged(a: tuple, b: tuple) -> tuple:
    """Count, means and centred products of two parts together."""
    n, apart = a[0] + b[0], b[1] - a[1]
    return n, a[1] + apart * (b[0] / n), a[2] + b[2] + np.outer(apart, apart) * (a[0] * b[0] / n)


def participation_ratio(cov: DataFrame, by: str) -> DataFrame:
    """(sum of eigenvalues) squared over the sum of their squares, from the trace and the norm alone."""
    trace = F.sum(F.when(F.col("i") == F.col("j"), F.col("c")))
    square = F.sum(F.col("c") * F.col("c") * F.when(F.col("i") == F.col("j"), 1).otherwise(2))
    return cov.groupBy(by).agg(F.when((F.first("n") < 2) | (trace <= 1e-12), 0.0).otherwise(trace * trace / square).alias("participation_ratio"))


def effective_rank(cov: DataFrame, by: str) -> DataFrame:
    """exp of the entropy of the normalised eigenvalues. A group is one matrix of the vectors' dimension."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        d = int(group["j"].max()) + 1
        c = np.zeros((d, d))
        c[group["i"], group["j"]] = c[group["j"], group["i"]] = group["c"]
        values = np.maximum(np.linalg.eigvalsh(c), 0)
        total = values.sum()
        p = values / total if total > 1e-12 else np.zeros(0)
        p = p[p > 1e-12]
        rank = float(np.exp(-(p * np.log(p)).sum())) if len(p) and group["n"].iloc[0] > 1 else 0.0
        return pd.DataFrame({by: [group[by].iloc[0]], "effective_rank": [rank]})

    kind = cov.schema[by].dataType.simpleString()
    return cov.groupBy(by).applyInPandas(run, f"{by} {kind}, effective_rank double")


def pooled(tokens: DataFrame, by: list[str], order: str, vector: str, selected: Column, how: str = "mean") -> DataFrame:
    """mean, max, sum or last of the selected rows' vectors, of all if none is selected."""
    marked = tokens.withColumn("_own", F.coalesce(selected, F.lit(False)))
    marked = marked.withColumn("_any", F.max("_own").over(Window.partitionBy(*by))).filter("_own or not _any")
    long = marked.select(*by, order, F.posexplode(vector).alias("d", "x"))
    value = {"mean": F.avg("x"), "max": F.max("x"), "sum": F.sum("x"), "last": F.max_by("x", order)}[how]
    points = long.groupBy(*by, "d").agg(value.alias("x"))
    return points.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda p: p["x"]).alias(vector))


def layer_profiles(rows: DataFrame, model: str, layer: str, vector: str) -> DataFrame:
    """model, and by layer the effective ranks and participation ratios, with their greatest and last; a layer of under two rows has 0."""
    keyed = rows.withColumn("_key", F.concat_ws("|", F.lpad(F.col(layer).cast("string"), 6, "0"), F.col(model).cast("string")))
    cov = covariance(keyed, "_key", vector)
    found = participation_ratio(cov, "_key").join(effective_rank(cov, "_key"), "_key")
    named = keyed.groupBy(F.col(model).alias("model"), F.col(layer).alias("layer"), "_key").agg(F.count("*").alias("n")).join(found, "_key", "left").na.fill(0.0, ["participation_ratio", "effective_rank"])
    ordered = F.array_sort(F.collect_list(F.struct("layer", "effective_rank", "participation_ratio"))).alias("x")
    profiles = named.groupBy("model").agg(ordered).select("model", F.col("x.effective_rank").alias("er_by_layer"), F.col("x.participation_ratio").alias("pr_by_layer"))
    ends = [f(F.col(f"{x}_by_layer")).alias(f"{name}_{x}") for x in ("er", "pr") for name, f in (("max", F.array_max), ("last", lambda c: F.element_at(c, -1)))]
    return profiles.select("*", *ends)
