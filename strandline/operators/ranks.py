"""Places in an order, found by ranges of it and not by sorting a class in one task.

Rows are dealt to partitions by ranges of the order and sorted in each; a count
for each partition and class, summed over the partitions before, turns places
in a partition into places in a class. Rows that are equal in the whole order
are in one partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .checkpoints import saved


def _earlier(counts: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """counts (pid, by, n, first): of each the sum of n over the class's partitions before it, and over all. A row for each class holds one entry for each partition it is in."""
    entry = F.struct("_pid", "_n", "_first")
    lists = counts.groupBy(*columns).agg(F.sort_array(F.collect_list(entry)).alias("_e"))
    sums = lists.withColumn("_total", F.aggregate("_e", F.lit(0).cast("long"), lambda a, e: a + e["_n"]))
    at = F.transform("_e", lambda e, i: F.struct(e["_pid"].alias("_pid"), e["_first"].alias("_first"), F.aggregate(F.slice("_e", 1, i), F.lit(0).cast("long"), lambda a, x: a + x["_n"]).alias("_before")))
    return sums.select(*columns, "_total", F.inline(at))


def placed(rows: DataFrame, by: list[str], order: list[Column], k: str = "k", n: str = "n") -> DataFrame:
    """``rows`` with ``k``, the place from 1 in its class (equal ``by``, null too) by ``order``, and ``n``, the size of the class."""
    keys = {f"_by{i}": F.col(c) for i, c in enumerate(by)} | {f"_o{i}": c for i, c in enumerate(order)}
    names = list(keys)
    dealt = rows.withColumns(keys).repartitionByRange(*names).sortWithinPartitions(*names)
    # below 33 bits is the place in the partition
    numbered = saved(dealt.withColumn("_pid", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    classes = {c: F.col(c) for c in names[: len(by)]}
    counts = numbered.groupBy("_pid", *classes).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    sums = _earlier(counts, classes).withColumnsRenamed({c: f"{c}_" for c in classes} | {"_pid": "_pid_"})
    same = F.col("_pid") == F.col("_pid_")
    for c in classes:
        same &= F.col(c).eqNullSafe(F.col(f"{c}_"))
    # a row for each partition and class that it has
    joined = numbered.join(sums, same)
    return joined.select(*rows.columns, (F.col("_at") - F.col("_first") + F.col("_before") + 1).alias(k), F.col("_total").alias(n))


def running(counts: DataFrame, by: list[str], value: str, n: str = "n") -> DataFrame:
    """``counts`` (by, value, n; each value once in a class) with before, the sum of n over smaller values, and total, that of the class."""
    dealt = saved(counts.repartitionByRange(*by, value).withColumn("_pid", F.spark_partition_id()))
    columns = {c: F.col(c) for c in by}
    sums = _earlier(dealt.groupBy("_pid", *columns).agg(F.sum(n).alias("_n"), F.lit(0).alias("_first")), columns).withColumnsRenamed({c: f"{c}__" for c in by} | {"_pid": "_pid_"})
    same = F.col("_pid") == F.col("_pid_")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"{c}__"))
    # a window over a range of the values of a class
    window = Window.partitionBy("_pid", *by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    inside = dealt.withColumn("_inside", F.coalesce(F.sum(n).over(window), F.lit(0)))
    return inside.join(sums, same).select(*counts.columns, (F.col("_before") + F.col("_inside")).alias("before"), F.col("_total").alias("total"))
