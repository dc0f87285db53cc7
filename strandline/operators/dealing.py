"""Rows dealt to tasks before work that makes much of little input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` by a hash of ``keys`` in as many partitions as the session shuffles to, however few files they come from.

    The number is given, so that adaptive execution doesn't join partitions
    that are small before that work and large after it.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


#: Rows and bytes of a batch of texts, where the session has Spark's own 10,000 and 64 MB.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8388608b")}


def text_batches(spark: SparkSession) -> None:
    """See that Arrow batches of texts are small, unless the session says how large they are: Python holds one on either side."""
    for name, (usual, small) in BATCH.items():
        if spark.conf.get(name) == usual:
            spark.conf.set(name, small)
