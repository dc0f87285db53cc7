"""Accuracy, consistency and degradation over controlled variants.

Observations: model, family, kind, answer, correct (boolean).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def explode_variants(families: DataFrame, generated: Column | None = None) -> DataFrame:
    """A row for each variant of a family; generated ones carry the first variant's answer where they have none."""
    variants = F.col("variants") if generated is None else F.concat(F.col("variants"), generated)
    base = F.try_element_at(F.col("variants"), F.lit(1))["answer"]
    return families.select(F.col("id").alias("family"), "capability", "answer_type", base.alias("base"), F.explode(variants).alias("v")).select("family", "capability", "answer_type", F.col("v.kind").alias("kind"), F.col("v.prompt").alias("prompt"), F.coalesce("v.answer", "base").alias("gold"))


def accuracy_by_kind(observations: DataFrame) -> DataFrame:
    return observations.groupBy("model", "kind").agg(F.avg(F.col("correct").cast("double")).alias("accuracy"), F.count("*").alias("n"))


def degradation(accuracy: DataFrame, baseline: str = "baseline") -> DataFrame:
    """Points lost against the baseline kind; null for itself and where there is none."""
    base = F.max(F.when(F.col("kind") == baseline, F.col("accuracy"))).over(Window.partitionBy("model"))
    return accuracy.withColumn("degradation_pts", F.when(F.col("kind") != baseline, 100 * (base - F.col("accuracy"))))


def consistency(observations: DataFrame) -> DataFrame:
    """Mean over families of the share of the most common answer; a missing answer is an answer."""
    counted = observations.groupBy("model", "family", F.coalesce(F.col("answer").cast("string"), F.lit("None")).alias("answer")).count()
    families = counted.groupBy("model", "family").agg((F.max("count") / F.sum("count")).alias("share"))
    return families.groupBy("model").agg(F.avg("share").alias("consistency"))


def summarize(observations: DataFrame) -> DataFrame:
    """A row for each model and kind: accuracy, degradation_pts, and the model's consistency and sizes."""
    sizes = observations.groupBy("model").agg(F.count("*").alias("n_records"), F.countDistinct("family").alias("n_families"))
    return degradation(accuracy_by_kind(observations)).drop("n").join(consistency(observations), "model").join(sizes, "model")


def wide_summary(observations: DataFrame, kinds: list[str], extremes: DataFrame) -> DataFrame:
    """A row for each model of either side: accuracy and degradation by kind, and the latent extremes."""
    long = degradation(accuracy_by_kind(observations))
    wide = long.groupBy("model").pivot("kind", kinds).agg(F.first("accuracy").alias("accuracy"), F.first("degradation_pts").alias("degradation_pts"))
    wide = wide.select("model", *[F.col(f"{k}_accuracy").alias(f"accuracy_{k}") for k in kinds], *[F.col(f"{k}_degradation_pts").alias(f"degradation_pts_{k}") for k in kinds if k != "baseline"])
    return wide.join(extremes, "model", "full")


def graded(scores: DataFrame, *by: str, columns: tuple[str, ...]) -> DataFrame:
    """n and the mean of each score by group, and over all (null group); 0 over no rows."""
    means = [F.coalesce(F.avg(c), F.lit(0.0)).alias(f"mean_{c}") for c in columns]
    return scores.rollup(*by).agg(F.count("*").alias("n"), *means)
