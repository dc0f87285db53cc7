"""As-of, band and overlap joins, layer profiles, graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import structure as X
from .registry import query, table


@query("""SELECT event_id, user_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_type = 'purchase' DESC, event_id ROWS UNBOUNDED PRECEDING) AS bound
FROM events QUALIFY event_type <> 'purchase'""")
def defuse_asof(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type").withColumn("first", (F.col("event_type") != "purchase").cast("int"))
    return X.asof(rows, ["user_id"], ["ts", "first", "event_id"], F.col("event_type") == "purchase", "event_id").select("event_id", "user_id", "bound")


@query("""SELECT a.vec_id AS id, b.vec_id AS other, a.vec_id - b.vec_id AS gap FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id AND abs(a.vec_id - b.vec_id) <= 24
QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY b.vec_id) <= 2""")
def neg_band_join(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    left, right = rows.withColumnRenamed("vec_id", "id"), rows.withColumnRenamed("vec_id", "other")
    pairs = X.band_join(left, right, ["label"], "id", "other", 24).filter("id <> other")
    from pyspark.sql import Window

    first = pairs.withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy("other"))).filter("k <= 2")
    return first.select("id", "other", (F.col("id") - F.col("other")).alias("gap"))


@query("""WITH u AS (SELECT label, vec_id AS at, vec_id // 50 * 50 AS d FROM embeddings)
SELECT a.at AS id, b.at AS other, abs(b.at - a.d) - abs(a.at - a.d) AS apart FROM u a JOIN u b ON a.label = b.label AND a.at <> b.at AND a.d <> b.d AND abs(abs(b.at - a.d) - abs(a.at - a.d)) <= 24
QUALIFY row_number() OVER (PARTITION BY a.at ORDER BY b.at) <= 4""")
def matched_negatives(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("label", F.col("vec_id").alias("id"), (F.floor(F.col("vec_id") / 50) * 50).alias("definition"))
    uses = rows.select("label", F.col("id").alias("other"), F.col("id").alias("at"), F.col("definition").alias("bound"))
    return X.matched_negatives(rows.withColumn("use", F.col("id")), uses, ["label"], 24, 4).select("id", "other", "apart")


@query("""WITH o AS (SELECT o_orderkey, o_custkey AS k, datediff('day', DATE '1970-01-01', o_orderdate::DATE) AS a FROM orders), l AS (SELECT l_suppkey AS k, datediff('day', DATE '1970-01-01', l_shipdate::DATE) AS s FROM lineitem)
SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey FROM o WHERE EXISTS (SELECT 1 FROM l WHERE l.k = o.k AND o.a < l.s + 2 AND o.a + 3 > l.s)""")
def span_overlap(spark, sf_dir):
    day = lambda c: F.datediff(F.col(c).cast("date"), F.lit("1970-01-01").cast("date"))
    points = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("k"), day("o_orderdate").alias("a")).withColumn("b", F.col("a") + 3)
    spans = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k"), day("l_shipdate").alias("s")).withColumn("e", F.col("s") + 2).distinct()
    return X.overlap_join(points, spans, ["k"], "a", "b", "s", "e", 8).select("o_orderkey")


_DIST = """d AS (SELECT a.label AS model, layer, CASE WHEN a.label = b.label THEN 'positive' ELSE 'control' END AS condition, sqrt(sum((x - y) * (x - y))) AS dist, a.vec_id FROM
(SELECT vec_id, label, unnest(range(0, len(embedding))) AS p, unnest(embedding)::DOUBLE AS x FROM embeddings) a JOIN (SELECT vec_id, label, unnest(range(0, len(embedding))) AS p, unnest(embedding)::DOUBLE AS y FROM embeddings) b
ON b.vec_id = a.vec_id + 1 AND a.p = b.p, (SELECT 0) z, LATERAL (SELECT a.p // 8 AS layer) l GROUP BY ALL)"""


def distances(spark, sf_dir):
    """Distances of neighbouring vectors by blocks of eight dimensions."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode(F.col("embedding").cast("array<double>")).alias("p", "x"))
    other = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("label").alias("l2"), "p", F.col("x").alias("y"))
    pairs = rows.join(other, ["vec_id", "p"]).withColumn("layer", F.floor(F.col("p") / 8))
    condition = F.when(F.col("label") == F.col("l2"), "positive").otherwise("control")
    return pairs.groupBy(F.col("label").alias("model"), "layer", condition.alias("condition"), "vec_id").agg(F.sqrt(F.sum((F.col("x") - F.col("y")) * (F.col("x") - F.col("y")))).alias("dist"))


_RATIO = f"{_DIST}, r AS (SELECT model, CAST(layer AS BIGINT) AS layer, round(coalesce(avg(dist) FILTER (condition = 'positive') / (coalesce(avg(dist) FILTER (condition = 'control'), 0) + 1e-8), 0), 7) AS value FROM d GROUP BY ALL)"


def _profile(spark, sf_dir):
    return X.layer_ratio(distances(spark, sf_dir)).withColumn("value", F.round("value", 7))


@query(f"WITH {_RATIO} SELECT model, layer, value FROM r")
def pair_ratio_by_layer(spark, sf_dir):
    return _profile(spark, sf_dir)


@query(f"WITH {_RATIO}, k AS (SELECT *, max(layer) OVER (PARTITION BY model) AS last, row_number() OVER (PARTITION BY model ORDER BY layer = 0, value DESC, layer) AS k FROM r) SELECT model, layer AS peak, layer / last AS depth, value FROM k WHERE k = 1")
def peaks(spark, sf_dir):
    return X.peaks(_profile(spark, sf_dir))


@query("""WITH l AS (SELECT l_orderkey AS rec, l_linenumber * 17 - 17 AS dist, l_discount AS b, l_tax AS n FROM lineitem), s(place, stratum, lo, hi) AS (VALUES (0, '1-10', 1, 10), (1, '11-25', 11, 25), (2, '26-50', 26, 50), (3, '51-100', 51, 100), (4, '>100', 101, 1073741824))
SELECT place, stratum, count(dist) AS count, round(avg(b - n), 9) AS dfbs FROM s LEFT JOIN l ON dist BETWEEN lo AND hi GROUP BY ALL""")
def strata(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_linenumber") * 17 - 17).alias("dist"), F.col("l_discount").alias("b"), F.col("l_tax").alias("n"))
    return X.strata(rows).withColumn("dfbs", F.round("dfbs", 9))


@query("""WITH e AS (SELECT o_custkey % 20 AS g, o_custkey AS a, o_orderkey % 97 AS b FROM orders), n AS (SELECT g, a AS node FROM e UNION SELECT g, b FROM e), o AS (SELECT g, a AS node, count(*) AS o, count(*) FILTER (b <= a) AS back FROM e GROUP BY ALL), i AS (SELECT g, b AS node, count(*) AS i FROM e GROUP BY ALL)
SELECT g, count(*) AS nodes, CAST(sum(coalesce(o, 0)) AS BIGINT) AS edges, count(*) FILTER (o > 1) AS branches, count(*) FILTER (i > 1) AS merges, CAST(sum(coalesce(back, 0)) AS BIGINT) AS back_edges, CAST(sum(coalesce(o, 0)) - count(*) + 2 AS BIGINT) AS cyclomatic
FROM n LEFT JOIN o USING (g, node) LEFT JOIN i USING (g, node) GROUP BY g""")
def cfg_features(spark, sf_dir):
    edges = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 20).alias("g"), F.col("o_custkey").alias("a"), (F.col("o_orderkey") % 97).alias("b"))
    nodes = edges.select("g", F.col("a").alias("node")).union(edges.select("g", "b")).distinct()
    return X.graph_features(edges, nodes, "g")


@query("""WITH f AS (SELECT l_suppkey AS k, count(*)::DOUBLE AS a, sum(l_quantity) AS b, max(l_linenumber)::DOUBLE AS c FROM lineitem GROUP BY 1) SELECT x.k, round((abs(x.a - y.a) + abs(x.b - y.b) + abs(x.c - y.c)) / (x.a + y.a + x.b + y.b + x.c + y.c + 1e-9), 9) AS delta FROM f x JOIN f y ON y.k = x.k + 1""")
def delta_cf(spark, sf_dir):
    from ..functions.vectors import relative_difference

    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.array(F.count("*").cast("double"), F.sum("l_quantity"), F.max("l_linenumber").cast("double")).alias("f"))
    other = rows.select((F.col("k") - 1).alias("k"), F.col("f").alias("g"))
    return rows.join(other, "k").select("k", F.round(relative_difference(F.col("f"), F.col("g")), 9).alias("delta"))


@query("""WITH l AS (SELECT doc_id AS program, unnest(range(0, len(s))) AS line, unnest(s) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)), m AS (SELECT program, line, length(text)::DOUBLE AS nll FROM l)
SELECT program, CAST(line AS INTEGER) AS line, round(nll, 6) AS mean_nll, line = arg_min(line, (-nll, line)) OVER (PARTITION BY program) AS is_top FROM m""")
def surprisal_argmax(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("program"), F.posexplode(F.split("text", "\n")).alias("line", "t"))
    return X.surprisal_by_line(lines.select("program", "line", F.length("t").cast("double").alias("nll"))).withColumn("mean_nll", F.round("mean_nll", 6))


@query("SELECT date_trunc('day', ts)::VARCHAR AS day, event_type, count(value) AS n, round(avg(value), 8) AS mean FROM events GROUP BY ALL")
def monitor_windows(spark, sf_dir):
    from ..streaming.monitor import windowed_means

    out = windowed_means(table(spark, sf_dir, "events"), "ts", "value", "1 day", "1 day", "event_type")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("day"), "event_type", "n", F.round("mean", 8).alias("mean"))


_SIDES = "l AS (SELECT l_returnflag AS model, l_linenumber - 1 AS layer, l_linestatus = 'O' AS syn, l_discount > 0.05 AS con, l_quantity AS dist, l_extendedprice / 1000 AS far, nullif(l_tax, 0) AS delta, l_discount AS b, l_tax AS n FROM lineitem)"


@query(f"""WITH {_SIDES}, u AS (SELECT *, coalesce(delta, avg(delta) OVER (PARTITION BY model), 1) AS unit FROM l),
p AS (SELECT 'SRS' AS metric, model, layer, round(coalesce(avg(CASE WHEN syn THEN dist END) / (coalesce(avg(CASE WHEN NOT syn THEN dist END), 0) + 1e-8), 0), 8) AS value FROM l GROUP BY ALL
UNION ALL SELECT 'CFS', model, layer, round(coalesce(avg(CASE WHEN con THEN far END) / (coalesce(avg(CASE WHEN NOT con THEN far END), 0) + 1e-8), 0), 8) FROM l GROUP BY ALL
UNION ALL SELECT 'CFS_norm', model, layer, round(avg(far / (unit + 1e-8)), 4) FROM u GROUP BY ALL UNION ALL SELECT 'DFBS', model, layer, round(avg(b - n), 8) FROM l GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY metric, model ORDER BY value DESC, layer) AS k FROM p WHERE layer > 0)
SELECT metric, model, layer, value, coalesce(k = 1, false) AS is_peak FROM p LEFT JOIN (SELECT metric, model, layer, k FROM k WHERE k = 1) USING (metric, model, layer)""")
def structural_profiles(spark, sf_dir):
    """The profiles of all metrics by layer, and which layer over 0 has the greatest value."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("model"), (F.col("l_linenumber") - 1).alias("layer"), "*")
    side = lambda x: F.when(x, "positive").otherwise("control").alias("condition")
    syntax = rows.select("model", "layer", side(F.col("l_linestatus") == "O"), F.col("l_quantity").alias("dist"))
    control = rows.select("model", "layer", side(F.col("l_discount") > 0.05), (F.col("l_extendedprice") / 1000).alias("dist"), F.nullif("l_tax", F.lit(0.0)).alias("delta"))
    bindings = rows.select("model", "layer", F.col("l_discount").alias("b"), F.col("l_tax").alias("n"))
    profiles, tops = X.structural_profile(syntax, control, bindings)
    digits = F.when(F.col("metric") == "CFS_norm", F.round("value", 4)).otherwise(F.round("value", 8))
    peak = tops.select("metric", "model", F.col("peak").alias("layer"), F.lit(True).alias("top"))
    return profiles.join(peak, ["metric", "model", "layer"], "left").select("metric", "model", "layer", digits.alias("value"), F.coalesce("top", F.lit(False)).alias("is_peak"))
