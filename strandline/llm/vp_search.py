"""Approximate nearest neighbours with a vantage-point tree for each shard.

Vectors of length one have chord distances that order them as the cosine does
and obey the triangle inequality. A tree splits its rows at the median distance
from a vantage point. A side is left out if the inequality puts it beyond the
query's k-th best so far, times ``factor``: 1 is exact search, less is faster.

A bounded sample of the rows makes a small tree whose leaves are the shards;
every row goes down it. The sample also gives each query a distance within
which its k nearest lie, so a query goes only to the shards that are within
that, times ``factor``. A shard's rows come first and its queries after them, so
that its tree is built once, where it is searched, and is never moved.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

SLACK = 1e-9


@dataclass
class Tree:
    """Rows in an order in which each node's are together. nodes: (vantage row or -1, median, first, last, child, child)."""

    ids: np.ndarray
    vectors: np.ndarray
    nodes: list[tuple[int, float, int, int, int, int]]


def grow(ids: np.ndarray, vectors: np.ndarray, leaf: int, seed: int = 3) -> Tree:
    random = np.random.default_rng(seed)
    order = np.argsort(ids, kind="stable")
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    nodes: list = [None]
    todo = [(0, 0, len(ids))]
    while todo:
        node, first, last = todo.pop()
        rows = order[first:last]
        nodes[node] = (-1, 0.0, first, last, -1, -1)
        if last - first <= leaf:
            order[first:last] = rows[np.argsort(ids[rows], kind="stable")]
            continue
        vantage = int(rows[random.integers(len(rows))])
        far = chord(unit[rows] @ unit[vantage])
        median = float(np.median(far))
        near = far < median
        if not near.any():  # most are equally far: equal rows can't be told apart
            continue
        order[first:last] = np.concatenate([rows[near], rows[~near]])
        middle = first + int(near.sum())
        nodes[node] = (vantage, median, first, last, len(nodes), len(nodes) + 1)
        todo += [(len(nodes), first, middle), (len(nodes) + 1, middle, last)]
        nodes += [None, None]
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    nodes = [(int(place[v]) if v >= 0 else -1, *rest) for v, *rest in nodes]
    return Tree(ids[order], vectors[order], nodes)


def chord(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * cosine))


class Search:
    """The k best of one tree for a batch of queries: the largest cosine, ties to the smaller id."""

    def __init__(self, tree: Tree, query_ids: np.ndarray, queries: np.ndarray, k: int, factor: float, within: np.ndarray | None = None):
        self.within = np.full(len(queries), np.inf) if within is None else within
        self.tree, self.k, self.factor = tree, k, factor
        self.query_ids, self.queries = query_ids, queries
        self.query_norm = np.sqrt((queries * queries).sum(axis=1))
        self.norm = np.sqrt((tree.vectors * tree.vectors).sum(axis=1))
        self.unit_queries = queries / self.query_norm[:, None]
        self.unit = tree.vectors / self.norm[:, None]
        self.score = np.full((len(queries), k), -np.inf)
        self.id = np.full((len(queries), k), np.iinfo(np.int64).max)
        self.looked_at = 0
        self.visit(0, np.arange(len(queries)))

    def visit(self, node: int, active: np.ndarray) -> None:
        if not len(active):
            return
        vantage, median, first, last, inside, outside = self.tree.nodes[node]
        if vantage < 0:
            for at in range(first, last, 4096):
                self.compare(active, at, min(last, at + 4096))
            return
        far = chord(self.unit_queries[active] @ self.unit[vantage])
        near = far < median
        self.visit(inside, active[near])
        self.visit(outside, active[~near])
        # without k results the score's chord is infinite
        reach = self.factor * np.minimum(chord(self.score[active, -1]), self.within[active]) + SLACK
        self.visit(outside, active[near & (median - far <= reach)])
        self.visit(inside, active[~near & (far - median <= reach)])

    def compare(self, active: np.ndarray, first: int, last: int) -> None:
        ids = self.tree.ids[first:last]
        close = self.unit_queries[active] @ self.unit[first:last].T
        close[self.query_ids[active][:, None] == ids[None, :]] = -np.inf
        self.looked_at += close.size
        worst = self.score[active, -1]
        if last - first > self.k:
            worst = np.maximum(worst, np.partition(close, -self.k, axis=1)[:, -self.k])
        row, column = np.nonzero((close >= worst[:, None] - SLACK) & (close > -np.inf))
        # the score of a pair doesn't depend on where it stands in a matrix
        a, b = active[row], first + column
        score = (self.queries[a] * self.tree.vectors[b]).sum(axis=1) / (self.query_norm[a] * self.norm[b])
        merged = np.full((len(active), self.k + last - first), -np.inf)
        merged[:, : self.k] = self.score[active]
        merged[row, self.k + column] = score
        names = np.concatenate([self.id[active], np.broadcast_to(ids, (len(active), len(ids)))], axis=1)
        best = np.lexsort((names, -merged), axis=-1)[:, : self.k]
        self.score[active] = np.take_along_axis(merged, best, axis=1)
        self.id[active] = np.where(np.isfinite(self.score[active]), np.take_along_axis(names, best, axis=1), np.iinfo(np.int64).max)


def usable(vector: Column) -> Column:
    """Not null, not empty, not zero, all components finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


@dataclass
class Router:
    """A small vantage-point tree over a sample of the rows of one length. nodes: (vantage or None, median, child or leaf, child)."""

    nodes: list[tuple[np.ndarray | None, float, int, int]]
    leaves: int
    sample_ids: np.ndarray
    sample: np.ndarray

    @classmethod
    def of(cls, ids: np.ndarray, vectors: np.ndarray, leaves: int, seed: int = 5) -> Router:
        random, unit = np.random.default_rng(seed), vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        order = np.argsort(ids, kind="stable")
        nodes: list = [None]
        todo, last, least = [(0, order)], 0, max(2, len(ids) // max(1, leaves))
        while todo:
            node, rows = todo.pop()
            far = near = np.zeros(0, bool)
            if len(rows) >= 2 * least:
                vantage = unit[rows[random.integers(len(rows))]]
                far = chord(unit[rows] @ vantage)
                near = far < np.median(far)
            if not near.any():
                nodes[node], last = (None, 0.0, last, last), last + 1
                continue
            nodes[node] = (vantage, float(np.median(far)), len(nodes), len(nodes) + 1)
            todo += [(len(nodes), rows[near]), (len(nodes) + 1, rows[~near])]
            nodes += [None, None]
        return cls(nodes, last, ids[order], unit[order])

    def leaf_of(self, unit: np.ndarray) -> np.ndarray:
        found, todo = np.zeros(len(unit), np.int32), [(0, np.arange(len(unit)))]
        while todo:
            node, rows = todo.pop()
            vantage, median, a, b = self.nodes[node]
            if vantage is None:
                found[rows] = a
            elif len(rows):
                near = chord(unit[rows] @ vantage) < median
                todo += [(a, rows[near]), (b, rows[~near])]
        return found

    def within(self, ids: np.ndarray, unit: np.ndarray, k: int) -> np.ndarray:
        """A distance within which each query has k rows of the sample, its own left out; infinite if there are too few."""
        out = np.full(len(unit), np.inf)
        for first in range(0, len(unit), 256):
            part = slice(first, first + 256)
            close = unit[part] @ self.sample.T
            close[ids[part][:, None] == self.sample_ids[None, :]] = -np.inf
            if close.shape[1] >= k:
                out[part] = chord(np.partition(close, -k, axis=1)[:, -k])
        return out

    def reached(self, unit: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, leaf): the leaves that may hold a row within each query's reach."""
        queries, leaves, todo = [], [], [(0, np.arange(len(unit)))]
        while todo:
            node, rows = todo.pop()
            vantage, median, a, b = self.nodes[node]
            if vantage is None:
                queries.append(rows)
                leaves.append(np.full(len(rows), a, np.int32))
            elif len(rows):
                far = chord(unit[rows] @ vantage)
                todo += [(a, rows[far - median <= reach[rows] + SLACK]), (b, rows[median - far <= reach[rows] + SLACK])]
        return np.concatenate(queries), np.concatenate(leaves)


def routers(rows: DataFrame, sample: int, shard_rows: int) -> dict[int, Router]:
    """A router for each length of vectors in a sample of at most ``sample`` rows, those that come first by a hash."""
    sizes = {x["dim"]: x["count"] for x in rows.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(64).collect()}
    place = F.xxhash64("vec_id", F.lit(11))
    # a bound on the hash leaves about four times the sample, so that no more than that is sorted or comes near the driver
    near = place / F.lit(2.0**64) + 0.5 <= 4 * sample / max(1, sum(sizes.values()))
    chosen = rows.filter(near).orderBy(place, "vec_id", "embedding").limit(sample).select("vec_id", "dim", "embedding").toPandas()
    found = {}
    for dim, group in chosen.groupby("dim"):
        # two thirds of a shard on average, and eight rows of the sample for each
        leaves = min(-(-3 * sizes.get(dim, 0) // (2 * shard_rows)), max(1, len(group) // 8))
        found[int(dim)] = Router.of(group["vec_id"].to_numpy(), np.stack(group["embedding"].to_numpy()).astype(float), leaves)
    return found


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, factor: float = 0.25, shard_rows: int = 8192, leaf: int = 64, block: int = 1024, sample: int = 8192) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of every row that ``is_query`` chooses.

    ``vectors``: vec_id, embedding. All rows are candidates but those with the
    query's own vec_id; a query that is repeated is searched once, with the
    first of its vectors, and a repeated candidate counts each time. Vectors null, empty, zero or with null
    or non-finite components take no part, nor does a null vec_id; vectors of
    another length are no candidates. Fewer candidates than ``k`` are all
    returned; an empty table gives no rows. Extra columns change nothing.

    The tree that deals rows to shards is fitted on ``sample`` rows; lengths
    that no row of it has are one shard. A shard with more than ``shard_rows``
    rows, as many equal ones make, is dealt into several by a hash.
    """
    return searched(vectors, is_query, k, factor, shard_rows, leaf, block, sample)[0]


def searched(vectors: DataFrame, is_query: Column, k: int, factor: float, shard_rows: int, leaf: int, block: int, sample: int) -> tuple[DataFrame, DataFrame]:
    """``nearest``, and query_id, shards, compared: the shards that each query went to, and the rows it was compared with."""
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    rows = rows.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).withColumn("dim", F.size("embedding"))
    shared = rows.sparkSession.sparkContext.broadcast(routers(rows, sample, shard_rows))

    def dims(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Of a batch by length: the length, the places of its rows and their vectors."""
        sizes, flat = batch.column("dim").to_numpy(), batch.column("embedding").flatten().to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        for dim in np.unique(sizes):
            at = np.flatnonzero(sizes == dim)
            yield int(dim), at, flat[(ends[at] - dim)[:, None] + np.arange(dim)]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves = np.zeros(batch.num_rows, np.int32)
            for dim, at, own in dims(batch):
                if dim in shared.value:
                    leaves[at] = shared.value[dim].leaf_of(own / np.linalg.norm(own, axis=1, keepdims=True))
            yield batch.append_column("leaf", pa.array(leaves))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("vec_id").to_numpy()
            for dim, at, own in dims(batch):
                unit, near = own / np.linalg.norm(own, axis=1, keepdims=True), np.full(len(at), np.inf)
                query, leaves = np.arange(len(at)), np.zeros(len(at), np.int32)
                if dim in shared.value:
                    near = shared.value[dim].within(ids[at], unit, k)
                    query, leaves = shared.value[dim].reached(unit, factor * near)
                for first in range(0, len(query), 4096):
                    part = slice(first, first + 4096)
                    taken = batch.take(pa.array(at[query[part]]))
                    yield pa.RecordBatch.from_arrays([*(taken.column(x) for x in ("vec_id", "embedding", "dim")), pa.array(leaves[part]), pa.array(near[query[part]])], ["vec_id", "embedding", "dim", "leaf", "within"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, built, waiting = None, None, []
        for batch in batches:
            keys = np.stack([batch.column(x).to_numpy() for x in ("dim", "leaf", "part", "kind")], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1), batch.num_rows]
            for first, last in zip(cuts[:-1], cuts[1:], strict=True):
                own, kind = tuple(keys[first, :3]), keys[first, 3]
                if own != shard:
                    shard, built, waiting = own, None, []
                piece = batch.slice(first, last - first)
                ids = piece.column("vec_id").to_numpy()
                values = piece.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
                if kind == 0:
                    waiting.append((ids, values))
                    continue
                if built is None and waiting:
                    built, waiting = grow(np.concatenate([x for x, _ in waiting]), np.concatenate([x for _, x in waiting]), leaf), []
                if built is None:
                    continue
                within = piece.column("within").to_numpy(zero_copy_only=False)
                for at in range(0, len(ids), block):
                    part = slice(at, at + block)
                    found = Search(built, ids[part], values[part], k, factor, within[part])
                    there = np.isfinite(found.score)
                    count = np.full(len(ids[part]), found.looked_at // max(1, len(ids[part])))
                    yield pa.RecordBatch.from_arrays([pa.array(np.append(np.repeat(ids[part], k)[there.ravel()], ids[part])), pa.array(np.append(found.id[there], np.zeros(len(count), np.int64))), pa.array(np.append(found.score[there], np.full(len(count), np.nan))), pa.array(np.append(np.zeros(there.sum(), np.int64), count))], ["query_id", "vec_id", "score", "compared"])

    routed = stage(rows.mapInArrow(route, "vec_id long, embedding array<double>, is_query boolean, dim int, leaf int"), "routed")
    parts = routed.groupBy("dim", "leaf").agg(F.ceil(F.count("*") / F.lit(shard_rows)).cast("int").alias("parts"))
    held = routed.join(parts, ["dim", "leaf"]).select("vec_id", "embedding", "dim", "leaf", F.pmod(F.xxhash64("vec_id", "embedding", F.lit(1)), F.col("parts")).cast("int").alias("part"), F.lit(0).alias("kind"), F.lit(None).cast("double").alias("within"))
    asked = routed.filter("is_query").groupBy("vec_id", "dim").agg(F.min("embedding").alias("embedding")).select("vec_id", "embedding", "dim").mapInArrow(ask, "vec_id long, embedding array<double>, dim int, leaf int, within double")
    sent = asked.join(parts, ["dim", "leaf"]).select("vec_id", "embedding", "dim", "leaf", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(1).alias("kind"), "within")
    order = ["dim", "leaf", "part"]
    met = held.unionByName(sent).repartition(*order).sortWithinPartitions(*order, "kind")
    found = stage(met.mapInArrow(search, "query_id long, vec_id long, score double, compared long"), "found")
    window = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = found.filter(~F.isnan("score")).withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    return best, found.filter(F.isnan("score")).groupBy("query_id").agg(F.count("*").alias("shards"), F.sum("compared").alias("compared"))
