"""Result tables: statistics by group with adjusted p-values, in the form they are shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import stats as S


def separability(values: DataFrame, pairs: DataFrame) -> DataFrame:
    """dimension, test, effect, p, q: independent groups by Cohen's d and Mann-Whitney, paired ones by dz and Wilcoxon, adjusted together.

    values: dimension, positive (boolean), value. pairs: dimension, x, y.
    """
    positive = F.col("positive")
    independent = S.cohens_d(values, "value", positive, "dimension").join(S.mann_whitney(values, "value", positive, "dimension").select("dimension", "p"), "dimension")
    paired = S.paired(pairs, "x", "y", "dimension").join(S.wilcoxon(pairs, "x", "y", "dimension").select("dimension", "p"), "dimension", "left")
    rows = independent.select("dimension", F.lit("mann_whitney").alias("test"), F.col("d").alias("effect"), "p").unionByName(paired.select("dimension", F.lit("wilcoxon").alias("test"), F.col("dz").alias("effect"), "p"))
    return S.adjusted(rows.withColumn("_all", F.lit(1)), "p", "dimension", "_all").drop("_all")


def emergence(pairs: DataFrame) -> DataFrame:
    """Of (dimension, x, y): n, mean difference, dz and p; a paired t stands in where Wilcoxon is undefined."""
    base = S.paired(pairs, "x", "y", "dimension").join(pairs.groupBy("dimension").agg(F.avg(F.col("x") - F.col("y")).alias("difference")), "dimension")
    ranked = S.wilcoxon(pairs, "x", "y", "dimension").select("dimension", "p")
    p = F.coalesce("p", S.t_test_p(F.col("t"), (F.col("n") - 1).cast("double")))
    return base.join(ranked, "dimension", "left").select("dimension", "n", "difference", "dz", p.alias("p"))


def association(scores: DataFrame, given: str | None = None) -> DataFrame:
    """metric, task, n, rho, p, q: rank correlation of every metric with every task over models, adjusted over all.

    scores: model, metric, task, m, t and, where ``given`` names it, what the
    correlation is freed of.
    """
    if given is None:
        rows = S.spearman(scores, "m", "t", "metric", "task")
    else:
        rows = S.partial_spearman(scores, "m", "t", given, "metric", "task")
    rows = rows.withColumn("p", S.correlation_p(F.col("rho"), F.col("n")))
    return S.adjusted(rows.withColumn("_all", F.lit(1)).withColumn("_key", F.concat_ws("|", "metric", "task")), "p", "_key", "_all").drop("_all", "_key")


def best_predictors(table: DataFrame, metrics: tuple[str, ...] = ("SRS", "CFS", "DFBS")) -> DataFrame:
    """The metric of the largest absolute correlation with each task; ``--`` if none has one. Of equals the first of ``metrics``, then by name."""
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, metrics)), F.col("metric")), F.lit(0)), F.lit(len(metrics) + 1))
    order = Window.partitionBy("task").orderBy(F.abs("rho").desc_nulls_last(), place, "metric")
    best = table.withColumn("k", F.row_number().over(order)).filter("k = 1")
    return best.select("task", F.when(F.col("rho").isNull(), "--").otherwise(F.col("metric")).alias("metric"), "rho")


def shown(table: DataFrame, **digits: int) -> DataFrame:
    """Numbers as text: ``--`` for what is undefined, p and q as bounds where they are small."""
    columns: list[Column] = [S.shown(F.col(c), digits[c], c in ("p", "q")).alias(c) if c in digits else F.col(c) for c in table.columns]
    return table.select(*columns)
