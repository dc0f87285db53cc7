"""Where lineage is cut."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> None:
    """See that checkpoints go to the folder that the session names; only a local session without one gets a temporary one."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        named = tempfile.mkdtemp(prefix="strandline-")
    context.setCheckpointDir(named)


def saved(df: DataFrame) -> DataFrame:
    """``df`` computed once and checkpointed in the shared folder: what follows reads it, and a lost executor costs nothing."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a compressed table in the folder of the checkpoints: for texts and other wide rows, which ``saved`` keeps as they are."""
    spark = df.sparkSession
    checkpoint_folder(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
