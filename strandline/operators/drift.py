"""Drift over ordered levels: alignment, levels, detection and lead.

Observations: level (0 is the baseline), sample, and a value.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def last_written(rows: DataFrame, order: str) -> DataFrame:
    """Of rows with the same level and sample the last by ``order``."""
    window = Window.partitionBy("level", "sample").orderBy(F.desc(order))
    return rows.withColumn("_k", F.row_number().over(window)).filter("_k = 1").drop("_k")


def aligned(rows: DataFrame, value: str = "value") -> DataFrame:
    """level, sample, value and base of samples that are there on all levels."""
    levels = rows.agg(F.countDistinct("level").alias("n_levels"))
    common = rows.groupBy("sample").agg(F.countDistinct("level").alias("n"))
    common = common.join(F.broadcast(levels), common["n"] == levels["n_levels"]).select("sample")
    kept = rows.join(common, "sample", "left_semi")
    return kept.withColumn("base", F.max(F.when(F.col("level") == 0, F.col(value))).over(Window.partitionBy("sample"))).select("level", "sample", F.col(value).alias("value"), "base")


def correct_at_baseline(rows: DataFrame, correct: str = "correct") -> DataFrame:
    base = F.max(F.when(F.col("level") == 0, F.col(correct))).over(Window.partitionBy("sample"))
    return rows.withColumn("correct_at_baseline", base)


def level_means(rows: DataFrame, value: str = "value") -> DataFrame:
    """Mean by level, and its z-score in deviations of the baseline (1 if it has none)."""
    sums = rows.groupBy("level").agg(F.avg(value).alias("mean"), F.count(value).alias("n"), F.stddev_pop(value).alias("sd"))
    base = sums.filter("level = 0").select(F.col("mean").alias("mean0"), F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0).alias("sd0"))
    return sums.join(F.broadcast(base), how="left").select("level", "n", "mean", ((F.col("mean") - F.col("mean0")) / F.col("sd0")).alias("z"))


def bootstrap_levels(pairs: DataFrame, replicates: int = 2000, alpha: float = 0.05, seed: int = 0, cell_rows: int = 2048) -> DataFrame:
    """level, n, mean difference to the baseline, and its percentile interval over resamples of the level's pairs.

    Each replicate draws as many pairs as there are, with replacement. Pairs
    are dealt to cells by a hash of their sample, about ``cell_rows`` to each;
    how many draws fall into each cell is multinomial, and a cell's task then
    draws its own pairs. Draws come from counters of seed, level and cell, and
    a cell's pairs are sorted, so results are the same on any partitioning.
    A level has 4,096 cells at most, so from eight million pairs on they grow.
    """
    rows = pairs.dropna(subset=["value", "base"]).select(F.col("level").cast("long").alias("level"), F.xxhash64("sample").alias("key"), (F.col("value") - F.col("base")).cast("double").alias("diff"))
    sizes = rows.groupBy("level").agg(F.count("*").alias("size"))
    cells = F.least(F.lit(4096), F.greatest(F.lit(1), F.ceil(F.col("size") / cell_rows))).cast("int")
    dealt = rows.join(sizes.select("level", cells.alias("cells")), "level").withColumn("cell", F.pmod(F.col("key"), F.col("cells")).cast("int"))

    def shares(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("cell")
        n = group["n"].to_numpy()
        draws = generator(seed, int(group["level"].iloc[0]), -1).multinomial(n.sum(), n / n.sum(), size=replicates)
        return pd.DataFrame({"level": group["level"], "cell": group["cell"], "draws": list(draws.T.astype(np.int64))})

    def drawn(group: pd.DataFrame, share: pd.DataFrame) -> pd.DataFrame:
        diff = group.sort_values(["key", "diff"])["diff"].to_numpy()
        draws = np.asarray(share["draws"].iloc[0])
        random = generator(seed, int(group["level"].iloc[0]), int(group["cell"].iloc[0]))
        sums = np.zeros(len(draws))
        step = max(1, (1 << 22) // max(1, int(draws.max())))
        for at in range(0, len(draws), step):
            part = draws[at : at + step]
            some = np.append(diff[random.integers(0, len(diff), part.sum())], 0.0)
            total = np.add.reduceat(some, np.minimum(np.cumsum(part) - part, len(some) - 1))
            sums[at : at + step] = np.where(part > 0, total, 0.0)
        return pd.DataFrame({"level": [group["level"].iloc[0]], "cell": [group["cell"].iloc[0]], "n": [len(diff)], "total": [diff.sum()], "drawn": [draws], "sums": [sums]})

    def joined(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("cell")
        n, drawn = group["n"].sum(), np.sum(np.stack(group["drawn"]), axis=0)
        low, high = np.quantile(np.sum(np.stack(group["sums"]), axis=0) / n, [alpha / 2, 1 - alpha / 2])
        return pd.DataFrame({"level": [group["level"].iloc[0]], "n": [n], "diff": [group["total"].sum() / n], "low": [low], "high": [high], "drawn": [[drawn.min(), drawn.max()]]})

    # a row for each cell of a level
    share = dealt.groupBy("level", "cell").agg(F.count("*").alias("n")).groupBy("level").applyInPandas(shares, "level long, cell int, draws array<long>")
    keys = ["level", "cell"]
    parts = dealt.groupBy(*keys).cogroup(share.groupBy(*keys)).applyInPandas(drawn, "level long, cell int, n long, total double, drawn array<long>, sums array<double>")
    return parts.groupBy("level").applyInPandas(joined, "level long, n long, diff double, low double, high double, drawn array<long>")


def generator(seed: int, *counter: int) -> np.random.Generator:
    """Random numbers that depend on the seed and the counters alone."""
    return np.random.Generator(np.random.Philox(np.random.SeedSequence([seed & 0xFFFFFFFFFFFFFFFF, *(x & 0xFFFFFFFFFFFFFFFF for x in counter)])))


def detection_level(intervals: DataFrame, direction: str) -> DataFrame:
    """The first level over 0 whose interval excludes 0 in the direction; null if none."""
    seen = F.col("low") > 0 if direction == "up" else F.col("high") < 0
    return intervals.agg(F.min(F.when(seen & (F.col("level") > 0), F.col("level"))).alias("detected"))


def lead(levels: DataFrame, reference: str) -> DataFrame:
    """metric, detected -> how many levels each metric is before the reference; null if either has none."""
    base = levels.filter(F.col("metric") == reference).select(F.col("detected").alias("at"))
    return levels.filter(F.col("metric") != reference).join(F.broadcast(base), how="left").select("metric", "detected", (F.col("at") - F.col("detected")).alias("lead"))
