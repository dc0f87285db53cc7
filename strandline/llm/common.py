"""Helpers that all operators of this subpackage use."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are separated by the ASCII blanks that ``bytes.split`` knows.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, named by the session.

    Only a local session that names none, as in tests, gets a temporary
    folder; elsewhere executors would write to their own disks.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir()
    if not isinstance(named, str):
        named = named.get() if named.isDefined() else None
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="strandline-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back.

    The lineage ends there, and what comes later reads only the columns it
    needs. A lost executor costs nothing, as the files are committed.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.staged_at = path
    return found


def release(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more: what was made of them is staged itself."""
    for x in tables:
        jvm, conf = x.sparkSession._jvm, x.sparkSession.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(x.staged_at)
        path.getFileSystem(conf).delete(path, True)


#: Rows and bytes of a batch of texts, where the session has Spark's own 10,000 and 64 MB: two tasks of an executor, each with
#: a batch on either side, then need a few dozen MB and not hundreds.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8388608b")}


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each Spark context, and see that batches of texts are small."""
    for name, (usual, small) in BATCH.items():
        if spark.conf.get(name) == usual:
            spark.conf.set(name, small)
    context = spark.sparkContext
    if getattr(context, "_strandline_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    path = os.path.join(tempfile.mkdtemp(prefix="strandline-zip-"), "strandline_shipped.zip")
    with zipfile.ZipFile(path, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, f"{root.name}/{file.relative_to(root)}")
    context.addPyFile(path)
    context._strandline_shipped = True


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bucket(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``: the folds of the held-out sets."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def texts(batch, column: str = "text") -> list[str]:
    """The texts of an Arrow batch; null is the empty text."""
    return [x or "" for x in batch.column(column).to_pylist()]
