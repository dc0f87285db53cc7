"""Classifier evaluation on a nearest-centroid prediction of the embeddings' labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import classify as C
from .registry import query, table

# Distances are rounded, so that both engines rank and bin alike.
_SQL = """e AS (SELECT vec_id, label, unnest(range(0, len(embedding))) AS d, unnest(embedding)::DOUBLE AS x FROM embeddings), c AS (SELECT label AS c, d, avg(x) AS m FROM e WHERE vec_id % 2 = 0 GROUP BY ALL),
dist AS (SELECT vec_id, label, c, round(-sum((x - m) * (x - m)), 6) AS s FROM e JOIN c USING (d) GROUP BY ALL),
p AS (SELECT *, exp(s - max(s) OVER (PARTITION BY vec_id)) / sum(exp(s)) OVER (PARTITION BY vec_id) * exp(max(s) OVER (PARTITION BY vec_id)) AS p FROM dist),
pred AS (SELECT vec_id AS id, label AS actual, arg_min(c, (-s, c)) AS predicted, round(max(p), 6) AS confidence FROM p GROUP BY ALL)"""


def scored(spark, sf_dir):
    """vec_id, label, and the scores (less squared distance to each label's centroid of the even rows) as an array."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    long = rows.select("vec_id", "label", F.posexplode("v").alias("d", "x"))
    means = long.filter("vec_id % 2 = 0").groupBy(F.col("label").alias("c"), "d").agg(F.avg("x").alias("m"))
    centroids = means.groupBy("c").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "m"))), lambda x: x["m"]).alias("m"))
    # as many rows as there are labels; the aggregate keeps the distances from being computed again at each use
    distance = F.round(-V.total(F.zip_with("v", "m", lambda a, b: (a - b) * (a - b))), 6)
    each = rows.join(F.broadcast(centroids)).select("vec_id", "label", "c", distance.alias("s"))
    found = each.groupBy("vec_id", "label").agg(F.array_sort(F.collect_list(F.struct("c", "s"))).alias("x"))
    return found.select("vec_id", "label", F.col("x.c").alias("names"), F.col("x.s").alias("scores"))


def predictions(spark, sf_dir):
    best = F.array_position("scores", F.array_max("scores"))
    rows = scored(spark, sf_dir).withColumn("p", V.softmax(F.col("scores")))
    return rows.select(F.col("vec_id").alias("id"), F.col("label").alias("actual"), F.element_at("names", best.cast("int")).alias("predicted"), F.round(F.array_max("p"), 6).alias("confidence"))


@query(f'WITH {_SQL} SELECT actual, predicted, n, round(n / sum(n) OVER (PARTITION BY actual), 8) AS share FROM (SELECT actual, predicted, count(*) AS n FROM pred GROUP BY 1, 2)')
def confusion(spark, sf_dir):
    return C.confusion_share(predictions(spark, sf_dir)).withColumn("share", F.round("share", 8))


_REPORT = """cells AS (SELECT actual AS t, predicted AS p, count(*) AS n FROM pred GROUP BY ALL), l AS (SELECT t AS label FROM cells UNION SELECT p FROM cells),
r AS (SELECT label, coalesce((SELECT sum(n) FROM cells WHERE t = label AND p = label), 0) AS tp, coalesce((SELECT sum(n) FROM cells WHERE t = label), 0) AS support, coalesce((SELECT sum(n) FROM cells WHERE p = label), 0) AS named FROM l),
q AS (SELECT label, CASE WHEN named = 0 THEN 0 ELSE tp / named END AS precision, CASE WHEN support = 0 THEN 0 ELSE tp / support END AS recall, CAST(support AS BIGINT) AS support FROM r),
rep AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM q)"""


@query(f"WITH {_SQL}, {_REPORT} SELECT label, round(precision, 8) AS precision, round(recall, 8) AS recall, round(f1, 8) AS f1, support FROM rep")
def classif_report(spark, sf_dir):
    return C.class_report(predictions(spark, sf_dir)).select("label", *(F.round(c, 8).alias(c) for c in ("precision", "recall", "f1")), "support")


@query(f"""WITH {_SQL}, {_REPORT} SELECT round(avg(precision), 8) AS macro_precision, round(avg(recall), 8) AS macro_recall, round(avg(f1), 8) AS macro_f1, round(sum(precision * support) / sum(support), 8) AS weighted_precision,
round(sum(recall * support) / sum(support), 8) AS weighted_recall, round(sum(f1 * support) / sum(support), 8) AS weighted_f1, (SELECT round(avg(CASE WHEN actual = predicted THEN 1.0 ELSE 0.0 END), 8) FROM pred) AS accuracy FROM rep""")
def classif_overall(spark, sf_dir):
    rows = predictions(spark, sf_dir)
    out = C.overall(C.class_report(rows), rows)
    return out.select(*(F.round(c, 8).alias(c) for c in out.columns))


@query(f'WITH {_SQL} SELECT least(actual, predicted) AS a, greatest(actual, predicted) AS b, count(*) AS n FROM pred WHERE actual <> predicted GROUP BY ALL ORDER BY n DESC, a, b LIMIT 10')
def top_confused(spark, sf_dir):
    return C.confused_pairs(predictions(spark, sf_dir))


@query(f"""WITH {_SQL}, b AS (SELECT CAST(ceil(confidence * 10) AS INTEGER) - 1 AS bin, count(*) AS n, avg(CASE WHEN actual = predicted THEN 1.0 ELSE 0.0 END) AS accuracy, avg(confidence) AS confidence FROM pred WHERE confidence > 0 GROUP BY 1)
SELECT CAST(g AS INTEGER) AS bin, coalesce(n, 0) AS n, round(accuracy, 7) AS accuracy, round(confidence, 5) AS confidence FROM range(10) t(g) LEFT JOIN b ON b.bin = g""")
def ece_bins(spark, sf_dir):
    return C.calibration_bins(predictions(spark, sf_dir)).select("bin", "n", F.round("accuracy", 7).alias("accuracy"), F.round("confidence", 5).alias("confidence"))


@query(f"""WITH {_SQL}, b AS (SELECT ceil(confidence * 10) AS bin, count(*) AS n, avg(CASE WHEN actual = predicted THEN 1.0 ELSE 0.0 END) AS accuracy, avg(confidence) AS confidence FROM pred WHERE confidence > 0 GROUP BY 1)
SELECT round(sum(n * abs(accuracy - confidence)) / (SELECT count(*) FROM pred), 6) AS ece FROM b""")
def calibration_error(spark, sf_dir):
    rows = predictions(spark, sf_dir)
    return C.calibration_error(C.calibration_bins(rows), rows.agg(F.count("*").alias("total"))).select(F.round("ece", 6).alias("ece"))


_CURVE = f"""{_SQL}, k AS (SELECT CAST(floor(confidence * 100 + 1e-9) AS INTEGER) AS k, actual = predicted AS ok, actual = 9 AS ood FROM pred), g AS (SELECT CAST(g AS INTEGER) AS t FROM range(101) t(g)),
x AS (SELECT t, count(*) FILTER (k >= t AND NOT ood) AS i, count(*) FILTER (k >= t AND NOT ood AND ok) AS c, count(*) FILTER (k >= t AND ood) AS o, count(*) FILTER (NOT ood) AS ni, count(*) FILTER (NOT ood AND ok) AS nc, count(*) FILTER (ood) AS no FROM g, k GROUP BY t),
curve AS (SELECT CASE WHEN nc = 0 THEN 0 ELSE c / nc END AS tpr, CASE WHEN ni - nc + no = 0 THEN 0 ELSE ((ni - nc) - (i - c) + no - o) / (ni - nc + no) END AS tnr, t / 100 AS threshold, CASE WHEN ni = 0 THEN 0 ELSE i / ni END AS coverage, CASE WHEN i = 0 THEN 1.0 ELSE c / i END AS selective_accuracy, CASE WHEN no = 0 THEN 0 ELSE o / no END AS ood_accept FROM x),
full_curve AS (SELECT *, (tpr + tnr) / 2 AS balanced FROM curve)"""


def _curve(spark, sf_dir):
    rows = predictions(spark, sf_dir)
    return C.threshold_curve(rows.filter("actual <> 9"), rows.filter("actual = 9"))


_COLUMNS = ("threshold", "coverage", "selective_accuracy", "ood_accept", "balanced")


@query(f"WITH {_CURVE} SELECT {', '.join(f'round({c}, 8) AS {c}' for c in _COLUMNS)} FROM full_curve")
def threshold_curve(spark, sf_dir):
    return _curve(spark, sf_dir).select(*(F.round(c, 8).alias(c) for c in _COLUMNS))


@query(f"WITH {_CURVE} SELECT {', '.join(f'round({c}, 8) AS {c}' for c in _COLUMNS)} FROM full_curve ORDER BY coverage >= 0.9 DESC, round(full_curve.balanced, 6) DESC, full_curve.coverage DESC, full_curve.threshold LIMIT 1")
def pick_threshold(spark, sf_dir):
    return C.pick_threshold(_curve(spark, sf_dir)).select(*(F.round(c, 8).alias(c) for c in _COLUMNS))


@query(f"WITH {_CURVE} SELECT round(coalesce(min(threshold) FILTER (threshold > 0 AND threshold <= 0.5 AND ood_accept <= 0.02), 0.5), 8) AS threshold FROM full_curve")
def emergency_threshold(spark, sf_dir):
    return C.emergency_threshold(_curve(spark, sf_dir).withColumnRenamed("ood_accept", "false_rate")).select(F.round("threshold", 8).alias("threshold"))


_GRID = [0.25, 0.5, 1.0, 2.0, 4.0]


@query(f"""WITH {_SQL}, t AS (SELECT unnest({_GRID})::DOUBLE AS temperature), z AS (SELECT temperature, vec_id, label, c, s, max(s) OVER (PARTITION BY vec_id, temperature) AS m FROM dist, t),
q AS (SELECT temperature, vec_id, sum(CASE WHEN c = label THEN exp((s - m) / temperature) END) / sum(exp((s - m) / temperature)) AS p FROM z GROUP BY ALL)
SELECT temperature, round(avg(-ln(greatest(p, 1e-12))), 6) AS nll FROM q GROUP BY temperature""")
def temperature_grid(spark, sf_dir):
    rows = scored(spark, sf_dir).withColumn("place", (F.array_position("names", F.col("label")) - 1).cast("int"))
    return C.temperature_losses(rows, "scores", "place", _GRID).withColumn("nll", F.round("nll", 6))


@query(f"WITH {_SQL} SELECT vec_id, CAST(k AS INTEGER) AS k, c AS label, round(s, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, c) AS k FROM dist) WHERE k <= 3")
def topk_labels(spark, sf_dir):
    rows = scored(spark, sf_dir).select("vec_id", "names", F.posexplode(V.top_k(F.col("scores"), 3)).alias("k", "x"))
    return rows.select("vec_id", (F.col("k") + 1).alias("k"), F.element_at("names", (F.col("x.label") + 1).cast("int")).alias("label"), F.round("x.p", 6).alias("score"))


@query(f'WITH {_SQL} SELECT id, actual, predicted, confidence FROM pred WHERE actual <> predicted')
def error_rows(spark, sf_dir):
    return C.errors(predictions(spark, sf_dir))


@query(f'WITH {_SQL} SELECT CAST(id AS BIGINT) AS id, CASE WHEN confidence >= 0.5 THEN CAST(predicted AS VARCHAR) END AS intent, confidence, CASE WHEN confidence >= 0.5 THEN \'accepted\' ELSE \'low_confidence\' END AS status FROM pred')
def batch_predictions(spark, sf_dir):
    from ..operators.routing import batch_predictions as run

    rows = scored(spark, sf_dir).select(F.col("vec_id").alias("id"), F.transform(V.softmax(F.col("scores")), lambda x: F.round(x, 6)).alias("p"))
    return run(rows, "p", [str(k) for k in range(10)], 0.5).select("id", "intent", "confidence", "status")
