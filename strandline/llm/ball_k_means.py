"""K-means with clusters as balls, in exact integers.

A cluster's ball has its centroid as centre and reaches as far as its farthest
member. A centroid farther from the centre than twice that can't be nearer to
any member, so only the others are the cluster's neighbours. A member nearer to
its centroid than half the way to the closest neighbour is in the stable core
and stays. The others lie in annuli: one between half the ways to the t-th and
the next neighbour is compared with the first t of them only.

Components are integers, so distances and sums are exact, and ties don't
depend on rounding. A round is one pass over the vectors, which carry their
cluster, and one aggregate with a row for each cluster.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release, stage

#: The largest integer component; up to that a distance of 64 components fits a long.
MOST = 1 << 27


def squared(rows: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Exact squared distances of int64 rows to one centre."""
    apart = rows - centre
    return np.einsum("ij,ij->i", apart, apart)


def nearest_of_all(rows: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row, of equals the first, and the distance."""
    best, at = squared(rows, centres[0]), np.zeros(len(rows), np.int32)
    for k in range(1, len(centres)):
        far = squared(rows, centres[k])
        nearer = far < best
        best[nearer], at[nearer] = far[nearer], k
    return at, best


class Balls:
    """Centres with the neighbours of each: those that its radius lets be nearest to a member, the closest first."""

    def __init__(self, centres: np.ndarray, radii: list[float]):
        self.centres = centres
        self.neighbours: list[np.ndarray] = []
        self.ways: list[np.ndarray] = []
        for k, radius in enumerate(radii):
            way = squared(centres, centres[k])
            near = np.flatnonzero(way <= 4 * radius * radius * (1 + 1e-9) + 1)
            near = near[near != k]
            near = near[np.argsort(way[near], kind="stable")]
            self.neighbours.append(near)
            self.ways.append(way[near])
        self.compared = 0

    def reassign(self, rows: np.ndarray, cluster: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centre of each row and the distance, given the cluster it had."""
        at, best = cluster.copy(), np.zeros(len(rows), np.int64)
        for k in np.unique(cluster):
            members = np.flatnonzero(cluster == k)
            own = squared(rows[members], self.centres[k])
            self.compared += len(members)
            near, far = np.full(len(members), k, np.int32), own.copy()
            # a centre at up to twice the way to the own one can be as near
            relevant = np.searchsorted(self.ways[k], 4 * own, side="right")
            for t, other in enumerate(self.neighbours[k][: relevant.max(initial=0)]):
                some = np.flatnonzero(relevant > t)
                self.compared += len(some)
                way = squared(rows[members[some]], self.centres[other])
                nearer = (way < far[some]) | ((way == far[some]) & (other < near[some]))
                far[some[nearer]], near[some[nearer]] = way[nearer], other
            at[members], best[members] = near, far
        return at, best


def integers(embedding: Column, scale: int) -> Column:
    """floor(``scale`` * x) of each component as an int."""
    whole = lambda x: F.floor(x * F.lit(float(scale)))
    fits = lambda x: F.abs(x) < F.lit(MOST / scale)
    return F.transform(embedding, lambda x: F.when(fits(x), whole(x)).otherwise(F.raise_error(F.lit(f"a component of {MOST // scale} or more: distances would not fit a long"))).cast("int"))


def digest(centre: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centre)).encode()).hexdigest()


def _rows(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, dims)


def _assigned(spark: SparkSession, vectors: DataFrame, balls: Balls, dims: int, known: bool) -> DataFrame:
    """vec_id, v, cluster, distance: all centres compared in the first round, relevant neighbours in the others."""
    shared = spark.sparkContext.broadcast(balls)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, own = _rows(batch, dims), shared.value
            at, far = own.reassign(rows, batch.column("cluster").to_numpy()) if known else nearest_of_all(rows, own.centres)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(at, pa.int32()), pa.array(far)], ["vec_id", "v", "cluster", "distance"])

    return vectors.mapInArrow(run, "vec_id long, v array<int>, cluster int, distance long")


def ball_k_means(vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, salt: str = "2:") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of ``vectors`` (vec_id, embedding).

    Vectors with exactly ``dims`` components, none null or non-finite, are
    kept; each component x becomes floor(``scale`` * x). The kept vectors with
    the ``k`` smallest sha256 of ``salt`` and the id are the first centroids,
    equal hashes in the order of the vectors; fewer vectors make fewer
    centroids. In each of ``rounds`` every vector goes to its nearest centroid
    (ties: the smaller number), and each centroid with members becomes their
    mean, rounded down. Then vectors are assigned once more. ``distance`` is
    squared. A null id hashes as an empty one; repeated rows count each time
    and give equal rows, an empty table none; extra columns change nothing. A
    component of 524,288 or more (scale 256) is an error, as no long holds its
    distances.

    What comes to the driver and is broadcast are ``k`` centroids and their
    balls. A round's vectors are staged with their clusters, and those of the
    round before are deleted.
    """
    spark = vectors.sparkSession
    number = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), number.alias("embedding"))
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    rows = rows.filter(F.coalesce((F.size("embedding") == dims) & whole, F.lit(False))).select("vec_id", integers(F.col("embedding"), scale).alias("v"))
    held = stage(rows, "vectors")
    order = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    centres = [list(x["v"]) for x in held.orderBy(order, "v").limit(k).select("v").collect()]
    if not centres:
        return held.select("vec_id", F.lit(0).alias("cluster"), *(F.lit(0).cast("long").alias(x) for x in ("distance", "cluster_inertia", "inertia")), F.lit("").alias("centroid_sha256"))
    radii = [math.inf] * len(centres)
    for step in range(rounds):
        before, held = held, stage(_assigned(spark, held, Balls(np.array(centres, np.int64), radii), dims, step > 0), "assigned")
        release(before)
        sums = held.groupBy("cluster").agg(F.count("*").alias("n"), F.max("distance").alias("far"), F.array(*(F.sum(F.col("v")[i]) for i in range(dims))).alias("sums")).collect()
        radii = [0.0] * len(centres)
        for x in sums:
            mean = [y // x["n"] for y in x["sums"]]
            # the old ball about the new centre: as much wider as the centre has moved
            radii[x["cluster"]] = math.sqrt(x["far"]) + math.dist(mean, centres[x["cluster"]])
            centres[x["cluster"]] = mean
    before, held = held, stage(_assigned(spark, held, Balls(np.array(centres, np.int64), radii), dims, rounds > 0).drop("v"), "clustered")
    release(before)
    inertia = {x["cluster"]: x["inertia"] for x in held.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}
    total = sum(inertia.values())
    about = spark.createDataFrame([(i, inertia.get(i, 0), total, digest(x)) for i, x in enumerate(centres)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return held.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
