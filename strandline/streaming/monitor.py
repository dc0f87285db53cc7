"""Drift monitor over a stream: an extension beyond batch analysis of fixed levels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_means(events: DataFrame, time: str, value: str, size: str = "1 day", late: str = "1 day", *by: str) -> DataFrame:
    """n and mean of tumbling windows; rows later than ``late`` are dropped. Works on batches and streams."""
    stamped = events.withColumn("_t", F.col(time).cast("timestamp"))
    if events.isStreaming:
        stamped = stamped.withWatermark("_t", late)
    sums = stamped.groupBy(F.window("_t", size), *by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"))
    return sums.select(F.col("window.start").alias("start"), *by, "n", "mean")


def watch(windows: DataFrame, baseline: float, deviation: float, path: str, checkpoint: str, limit: float = 3.0):
    """Append windows whose mean is ``limit`` standard errors from the baseline to a table."""
    z = (F.col("mean") - baseline) / (deviation / F.sqrt("n"))
    found = windows.withColumn("z", z).filter(F.abs("z") > limit)
    return found.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
