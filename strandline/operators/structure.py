"""Structured records: as-of, band and overlap joins, layer profiles, program structure."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .dealing import dealt


def asof(rows: DataFrame, scope: list[str], order: list[str], is_definition: Column, value: str, fallback: list[str] | None = None) -> DataFrame:
    """Each use with the latest definition at or before it in its scope, definitions first at the same place.

    One sort by scope, no join. ``fallback`` is a wider scope for uses that
    have none in their own.
    """
    marked = rows.withColumn("_def", is_definition)
    found = F.when(F.col("_def"), F.col(value))
    latest = lambda by: F.last(found, ignorenulls=True).over(Window.partitionBy(*by).orderBy(*order, F.desc("_def")).rowsBetween(Window.unboundedPreceding, 0))
    bound = latest(scope) if fallback is None else F.coalesce(latest(scope), latest(fallback))
    return marked.withColumn("bound", bound).filter(~F.col("_def")).drop("_def")


def band_join(left: DataFrame, right: DataFrame, key: list[str], left_at: str, right_at: str, width: float, most: int | None = None, item: str = "id") -> DataFrame:
    """Pairs of equal keys whose places differ by ``width`` at most, optionally the first ``most`` of each left row.

    Places are filed in cells of the width; a row meets its own cell and the
    two beside it, so a key with many rows doesn't meet all of itself.
    """
    cell = lambda c: F.floor(F.col(c) / F.lit(float(width)))
    a = left.withColumn("_cell", F.explode(F.array(*(cell(left_at) + d for d in (-1, 0, 1)))))
    b = right.withColumn("_cell", cell(right_at))
    joined = a.join(b, [*key, "_cell"]).filter(F.abs(F.col(left_at) - F.col(right_at)) <= width).drop("_cell")
    if most is None:
        return joined
    first = Window.partitionBy(item).orderBy(right_at)
    return joined.withColumn("_k", F.row_number().over(first)).filter(F.col("_k") <= most).drop("_k")


def matched_negatives(positives: DataFrame, uses: DataFrame, key: list[str], width: float, most: int) -> DataFrame:
    """Of each positive the first ``most`` other uses about as far from its definition: key, id, other, at, apart.

    ``positives``: key, id, definition (where it is), use (where that is), and
    ``uses``: key, other, at, bound (where the definition is that it reads, or
    null). Negatives stand elsewhere, read another definition, and their
    distance from the positive's definition differs from the positive's by
    ``width`` at most. The first are those that come first in the text, ties
    by ``other``.

    Such places lie in two bands about the definition, one on either side,
    which are filed in cells of the width: a positive meets only the uses of
    the cells that its bands touch, each once. The first few are kept before
    anything is shuffled by positive.
    """
    own = F.abs(F.col("use") - F.col("definition"))
    cell = lambda x: F.floor(x / F.lit(2.0 * width + 1))
    touched = lambda centre: F.sequence(cell(centre - width), cell(centre + width))
    cells = F.array_distinct(F.concat(touched(F.col("definition") - own), touched(F.col("definition") + own)))
    a = positives.select(*key, "id", "definition", "use", own.alias("own"), F.explode(cells).alias("_cell"))
    b = uses.select(*key, "other", "at", "bound", cell(F.col("at")).alias("_cell"))
    apart = F.abs(F.col("at") - F.col("definition")) - F.col("own")
    free = (F.col("at") != F.col("use")) & ~F.col("bound").eqNullSafe(F.col("definition")) & (F.abs(apart) <= width)
    met = a.join(b, [*key, "_cell"]).filter(free).select(*key, "id", "other", "at", apart.alias("apart"))
    first = Window.partitionBy(*key, "id").orderBy("at", "other")
    return met.withColumn("_k", F.row_number().over(first)).filter(F.col("_k") <= most).drop("_k")


def overlap_join(points: DataFrame, spans: DataFrame, key: list[str], a: str, b: str, start: str, end: str, cell: float) -> DataFrame:
    """Rows of ``points`` [a, b) that overlap a span [start, end) of their key, each once; empty ones never do."""
    cells = lambda x, y: F.explode(F.sequence(F.floor(F.col(x) / cell), F.greatest(F.floor(F.col(x) / cell), F.ceil(F.col(y) / cell) - 1)))
    left = points.filter(F.col(a) < F.col(b)).withColumn("_cell", cells(a, b))
    right = spans.filter(F.col(start) < F.col(end)).select(*key, start, end).withColumn("_cell", cells(start, end))
    hit = left.join(right, [*key, "_cell"]).filter((F.col(a) < F.col(end)) & (F.col(b) > F.col(start)))
    return hit.select(*points.columns).distinct()


def layer_ratio(distances: DataFrame, positive: str = "positive", floor: float = 1e-8) -> DataFrame:
    """Of (model, layer, condition, dist): mean distance of the positive pairs over that of the controls; 0 without positives."""
    is_positive = F.col("condition") == positive
    top, below = F.avg(F.when(is_positive, F.col("dist"))), F.avg(F.when(~is_positive, F.col("dist")))
    return distances.groupBy("model", "layer").agg(F.coalesce(top / (F.coalesce(below, F.lit(0.0)) + floor), F.lit(0.0)).alias("value"))


def normalised_profile(distances: DataFrame, delta: str = "delta", floor: float = 1e-8) -> DataFrame:
    """Mean of distances over their pair's change; an unknown change is the mean one (1 if all are)."""
    usual = distances.groupBy(F.col("model").alias("_model")).agg(F.avg(delta).alias("_usual"))
    # a row for each model
    joined = distances.join(F.broadcast(usual), F.col("model").eqNullSafe(F.col("_model")))
    unit = F.coalesce(delta, "_usual", F.lit(1.0))
    return joined.withColumn("_d", F.col("dist") / (unit + floor)).groupBy("model", "layer").agg(F.avg("_d").alias("value"))


def binding_profile(bindings: DataFrame) -> DataFrame:
    """Of (model, layer, b, n): the mean of b - n."""
    return bindings.groupBy("model", "layer").agg(F.avg(F.col("b") - F.col("n")).alias("value"))


def peaks(profile: DataFrame) -> DataFrame:
    """The layer over 0 with the greatest value, the first of equals, and its depth."""
    order = Window.partitionBy("model").orderBy(F.desc("value"), "layer")
    last = F.max("layer").over(Window.partitionBy("model"))
    ranked = profile.withColumn("last", last).filter("layer > 0").withColumn("k", F.row_number().over(order)).filter("k = 1")
    return ranked.select("model", F.col("layer").alias("peak"), (F.col("layer") / F.col("last")).alias("depth"), "value")


STRATA = [("1-10", 1, 10), ("11-25", 11, 25), ("26-50", 26, 50), ("51-100", 51, 100), (">100", 101, 1 << 30)]


def strata(bindings: DataFrame) -> DataFrame:
    """Of (dist, b, n): rows and mean b - n by stratum of the distance; empty strata stay, 0 is in none."""
    names = bindings.sparkSession.createDataFrame([(i, *s) for i, s in enumerate(STRATA)], "place int, stratum string, lo int, hi int")
    name = F.lit(None).cast("string")
    for stratum, lo, hi in STRATA:
        name = F.when((F.col("dist") >= lo) & (F.col("dist") <= hi), stratum).otherwise(name)
    sums = bindings.withColumn("stratum", name).groupBy("stratum").agg(F.count("*").alias("count"), F.avg(F.col("b") - F.col("n")).alias("dfbs"))
    return names.join(sums, "stratum", "left").select("place", "stratum", F.coalesce("count", F.lit(0)).alias("count"), "dfbs")


def graph_features(edges: DataFrame, nodes: DataFrame, graph: str) -> DataFrame:
    """Of directed graphs (graph, a, b) over nodes (graph, node): sizes, branches, merges, back edges, cyclomatic number."""
    out = edges.groupBy(graph, F.col("a").alias("node")).agg(F.count("*").alias("o"), F.count_if(F.col("b") <= F.col("a")).alias("back"))
    into = edges.groupBy(graph, F.col("b").alias("node")).agg(F.count("*").alias("i"))
    degrees = nodes.select(graph, "node").join(out, [graph, "node"], "left").join(into, [graph, "node"], "left").na.fill(0)
    n, e = F.count("*"), F.sum("o")
    return degrees.groupBy(graph).agg(n.alias("nodes"), e.alias("edges"), F.count_if(F.col("o") > 1).alias("branches"), F.count_if(F.col("i") > 1).alias("merges"), F.sum("back").alias("back_edges"), (e - n + 2).alias("cyclomatic"))


def surprisal_by_line(tokens: DataFrame) -> DataFrame:
    """Of (program, line, nll): the mean of each line, and whether it is the program's greatest (the first of equals)."""
    lines = tokens.groupBy("program", "line").agg(F.avg("nll").alias("mean_nll"))
    top = lines.groupBy("program").agg(F.max(F.struct("mean_nll", (-F.col("line")).alias("l"))).alias("x"))
    return lines.join(top, "program").select("program", "line", "mean_nll", (F.col("line") == -F.col("x.l")).alias("is_top"))


NAMES = "program string, scope int, name string, start int, is_definition boolean"


def program_names(programs: DataFrame) -> DataFrame:
    """Names that Python sources (program, source) define and use, with their scope and place, ready for ``asof``.

    Parsing needs the language's own parser, one program at a time. A source
    that doesn't parse gives no rows.
    """
    import ast

    def visit(source: str) -> Iterator[tuple]:
        starts, lines = [0], source.splitlines(keepends=True)
        for line in lines:
            starts.append(starts[-1] + len(line))
        wide = [None if line.isascii() else line.encode() for line in lines]
        inside = lambda line, at: at if line is None else len(line[:at].decode(errors="ignore"))
        place = lambda node: starts[node.lineno - 1] + inside(wide[node.lineno - 1], node.col_offset)
        scopes = 0

        def walk(node, scope: int) -> Iterator[tuple]:
            nonlocal scopes
            if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                yield scope, node.name, place(node), True
                scopes += 1
                own = scopes
                if not isinstance(node, ast.ClassDef):
                    for arg in ast.walk(node.args):
                        if isinstance(arg, ast.arg):
                            yield own, arg.arg, place(arg), True
                for child in ast.iter_child_nodes(node):
                    if not isinstance(child, ast.arguments):
                        yield from walk(child, own)
                return
            if isinstance(node, ast.Name):
                yield scope, node.id, place(node), not isinstance(node.ctx, ast.Load)
            for child in ast.iter_child_nodes(node):
                yield from walk(child, scope)

        yield from walk(ast.parse(source), 0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for program, source in zip(batch["program"], batch["source"], strict=True):
                try:
                    rows += [(program, *x) for x in visit(source or "")]
                except SyntaxError:
                    continue
            yield pd.DataFrame(rows, columns=["program", "scope", "name", "start", "is_definition"])

    return dealt(programs.select("program", "source"), "program").mapInPandas(run, NAMES)


def program_graph(programs: DataFrame) -> DataFrame:
    """Control-flow edges (program, a, b) of Python sources: a node for each statement, loops closed, branches joined."""
    import ast

    def build(source: str) -> list[tuple[int, int]]:
        edges: list[tuple[int, int]] = []
        made = 0

        def node() -> int:
            nonlocal made
            made += 1
            return made

        def block(body: list, before: list[int], loops: list[list[int]]) -> list[int]:
            for statement in body:
                if not before:
                    break
                own = node()
                edges.extend((x, own) for x in before)
                if isinstance(statement, ast.If):
                    before = block(statement.body, [own], loops) + (block(statement.orelse, [own], loops) if statement.orelse else [own])
                elif isinstance(statement, ast.For | ast.While | ast.AsyncFor):
                    leaving: list[int] = []
                    edges.extend((x, own) for x in block(statement.body, [own], [*loops, leaving]))
                    before = block(statement.orelse, [own], loops) + leaving if statement.orelse else [own, *leaving]
                elif isinstance(statement, ast.Try):
                    done = block(statement.body, [own], loops)
                    before = block(statement.orelse, done, loops) + [x for h in statement.handlers for x in block(h.body, [own], loops)]
                    before = block(statement.finalbody, before, loops) if statement.finalbody else before
                elif isinstance(statement, ast.With | ast.AsyncWith):
                    before = block(statement.body, [own], loops)
                elif isinstance(statement, ast.Break) and loops:
                    loops[-1].append(own)
                    before = []
                elif isinstance(statement, ast.Return | ast.Raise | ast.Continue):
                    before = []
                else:
                    before = [own]
            return before

        block(ast.parse(source).body, [0], [])
        return edges

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for program, source in zip(batch["program"], batch["source"], strict=True):
                try:
                    rows += [(program, *x) for x in build(source or "")]
                except SyntaxError:
                    continue
            yield pd.DataFrame(rows, columns=["program", "a", "b"])

    return dealt(programs.select("program", "source"), "program").mapInPandas(run, "program string, a int, b int")


def structural_profile(syntax: DataFrame, control: DataFrame, bindings: DataFrame, delta: str = "delta") -> tuple[DataFrame, DataFrame]:
    """The profiles of all three metrics as (metric, model, layer, value), and the peak of each."""
    parts = {"SRS": layer_ratio(syntax), "CFS": layer_ratio(control), "CFS_norm": normalised_profile(control, delta), "DFBS": binding_profile(bindings)}
    named = [x.select(F.lit(k).alias("metric"), "model", "layer", "value") for k, x in parts.items()]
    tops = [peaks(x).select(F.lit(k).alias("metric"), "model", "peak", "depth", "value") for k, x in parts.items()]
    from functools import reduce

    return reduce(DataFrame.unionByName, named), reduce(DataFrame.unionByName, tops)
