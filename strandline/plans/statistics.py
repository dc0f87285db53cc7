"""Rank, effect-size, bootstrap and drift queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.prng import uniform, uniform_sql
from ..operators import drift as D
from ..operators import stats as S
from .registry import query, table


def _r(df, *columns, digits=8):
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes if not columns or c in columns))


_BRAND = """b AS (SELECT p_brand, avg(p_retailprice) AS price, avg(p_size) AS size, sum(l_quantity) AS qty FROM part JOIN lineitem ON p_partkey = l_partkey GROUP BY p_brand)"""


def brands(spark, sf_dir):
    # lineitem is reduced to its parts before the join
    sums = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("q"), F.count("*").alias("k"))
    rows = table(spark, sf_dir, "part").join(sums, F.col("p_partkey") == F.col("l_partkey"))
    mean = lambda c: (F.sum(F.col(c) * F.col("k")) / F.sum("k"))
    return rows.groupBy("p_brand").agg(F.round(mean("p_retailprice"), 6).alias("price"), F.round(mean("p_size"), 6).alias("size"), F.round(F.sum("q"), 6).alias("qty"))


_RB = _BRAND + ", c AS (SELECT p_brand, round(price, 6) AS price, round(size, 6) AS size, round(qty, 6) AS qty FROM b)"
_AVG = lambda c: f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0"
_RANKS = f"{_RB}, r AS (SELECT {_AVG('price')} AS x, {_AVG('size')} AS y, {_AVG('qty')} AS z FROM c)"


@query(f"WITH {_RANKS} SELECT 'price' AS x, 'size' AS y, count(*) AS n, round(corr(x, y), 8) AS rho FROM r UNION ALL SELECT 'price', 'qty', count(*), round(corr(x, z), 8) FROM r UNION ALL SELECT 'size', 'qty', count(*), round(corr(y, z), 8) FROM r")
def spearman_matrix(spark, sf_dir):
    rows = brands(spark, sf_dir)
    long = rows.select(F.inline(F.array(*(F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(a).alias("vx"), F.col(b).alias("vy")) for a, b in (("price", "size"), ("price", "qty"), ("size", "qty"))))))
    return _r(S.spearman(long, "vx", "vy", "x", "y"))


@query(f"WITH {_RANKS}, k AS (SELECT count(*) AS n, corr(x, y) AS xy, corr(x, z) AS xz, corr(y, z) AS yz FROM r) SELECT n, round((xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)), 8) AS rho FROM k")
def partial_spearman(spark, sf_dir):
    return _r(S.partial_spearman(brands(spark, sf_dir), "price", "size", "qty"))


@query(f"WITH {_RB}, k AS (SELECT count(*) AS n, corr(price, qty) AS beta FROM c) SELECT n, round(beta, 8) AS beta, round(sqrt((1 - beta * beta) / (n - 2)), 8) AS se, round(beta * beta, 8) AS r2 FROM k")
def ols_standardized(spark, sf_dir):
    return _r(S.ols(brands(spark, sf_dir), "price", "qty"))


@query()
def correlation_p_values(spark, sf_dir):
    rows = S.spearman(brands(spark, sf_dir), "price", "qty")
    return rows.withColumn("p", S.correlation_p(F.col("rho"), F.col("n")))


@query("""WITH k AS (SELECT event_type AS kind, count(*) FILTER (user_id % 2 = 0) AS n1, count(*) FILTER (user_id % 2 = 1) AS n2, avg(value) FILTER (user_id % 2 = 0) AS m1, avg(value) FILTER (user_id % 2 = 1) AS m2,
var_samp(value) FILTER (user_id % 2 = 0) AS v1, var_samp(value) FILTER (user_id % 2 = 1) AS v2 FROM events WHERE value IS NOT NULL GROUP BY 1)
SELECT kind, n1, n2, round((m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)), 8) AS d FROM k""")
def cohens_d(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), "value", "user_id")
    return _r(S.cohens_d(rows, "value", F.col("user_id") % 2 == 0, "kind"))




def halves(spark, sf_dir):
    from ..functions.vectors import total

    v = F.col("embedding").cast("array<double>")
    return table(spark, sf_dir, "embeddings").select("label", F.round(total(F.slice(v, 1, 32)), 6).alias("x"), F.round(total(F.slice(v, 33, 32)), 6).alias("y"))


_H = "h AS (SELECT label, round(list_sum(list_transform(embedding[1:32], lambda e: e::DOUBLE)), 6) AS x, round(list_sum(list_transform(embedding[33:64], lambda e: e::DOUBLE)), 6) AS y FROM embeddings)"


@query(f"WITH {_H} SELECT label, count(*) AS n, round(avg(x - y) / stddev_samp(x - y), 8) AS dz, round(avg(x - y) / (stddev_samp(x - y) / sqrt(count(*))), 8) AS t FROM h GROUP BY label")
def paired_t(spark, sf_dir):
    return _r(S.paired(halves(spark, sf_dir), "x", "y", "label"))


@query(f"""WITH {_H}, d AS (SELECT label, abs(x - y) AS size, x > y AS up FROM h WHERE abs(x - y) > 1e-12),
r AS (SELECT *, rank() OVER (PARTITION BY label ORDER BY size) + (count(*) OVER (PARTITION BY label, size) - 1) / 2.0 AS k FROM d)
SELECT label, count(*) AS n, round(least(sum(CASE WHEN up THEN k ELSE 0 END), sum(CASE WHEN up THEN 0 ELSE k END)), 6) AS w FROM r GROUP BY label""")
def wilcoxon_w(spark, sf_dir):
    return S.wilcoxon(halves(spark, sf_dir), "x", "y", "label").select("label", "n", F.round("w", 6).alias("w"))


@query("""WITH r AS (SELECT event_type AS kind, user_id % 2 = 0 AS own, rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0 AS k FROM events WHERE value IS NOT NULL)
SELECT kind, CAST(sum(own::INT) AS BIGINT) AS n1, CAST(sum((NOT own)::INT) AS BIGINT) AS n2, round(sum(CASE WHEN own THEN k ELSE 0 END) - sum(own::INT) * (sum(own::INT) + 1) / 2.0, 4) AS u FROM r GROUP BY kind""")
def mann_whitney_u(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), "value", "user_id")
    return S.mann_whitney(rows, "value", F.col("user_id") % 2 == 0, "kind").select("kind", "n1", "n2", F.round("u", 4).alias("u"))


@query()
def test_p_values(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), "value", "user_id")
    one = S.mann_whitney(rows, "value", F.col("user_id") % 2 == 0, "kind").select(F.lit("mann_whitney").alias("test"), "kind", "p")
    two = S.wilcoxon(halves(spark, sf_dir), "x", "y", "label").select(F.lit("wilcoxon").alias("test"), F.col("label").cast("string").alias("kind"), "p")
    return one.unionByName(two)


_P = uniform_sql("'bh'", "c_custkey")


@query(f"""WITH p AS (SELECT c_custkey AS id, c_nationkey AS grp, {_P} AS p FROM customer), k AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY p, id) AS k, count(*) OVER (PARTITION BY grp) AS m FROM p)
SELECT id, grp, round(p, 12) AS p, round(least(min(p * m / k) OVER (PARTITION BY grp ORDER BY k DESC), 1.0), 12) AS q FROM k""")
def bh_adjust(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("grp"), uniform("bh", F.col("c_custkey")).alias("p"))
    return _r(S.adjusted(rows, "p", "id", "grp"), digits=12)


_BOOT = 200


@query(f"""WITH r AS (SELECT l_returnflag AS flag, o_orderkey AS id, v, row_number() OVER (PARTITION BY l_returnflag ORDER BY o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY l_returnflag) AS n
FROM (SELECT l_returnflag, l_suppkey AS o_orderkey, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2)),
d AS (SELECT flag, b, CAST(floor({uniform_sql('42', 'b', 'i')} * n) AS BIGINT) AS i FROM r, (SELECT unnest(range({_BOOT})) AS b)),
m AS (SELECT d.flag, d.b, avg(r.v) AS m FROM d JOIN r ON d.flag = r.flag AND d.i = r.i GROUP BY ALL)
SELECT m.flag, round(quantile_cont(m, 0.025), 7) AS low, round(quantile_cont(m, 0.975), 7) AS high, round(max(a.mean), 7) AS mean, max(a.n) AS n FROM m JOIN (SELECT flag, avg(v) AS mean, count(*) AS n FROM r GROUP BY flag) a ON a.flag = m.flag GROUP BY m.flag""")
def bootstrap_ci(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("flag"), F.col("l_suppkey").alias("id")).agg(F.sum("l_quantity").alias("v"))
    return _r(S.bootstrap(rows, "v", "id", "flag", replicates=_BOOT), digits=7)


@query("SELECT n_nationkey AS nation, round((avg_bal - min(avg_bal) OVER ()) / (max(avg_bal) OVER () - min(avg_bal) OVER () + 1e-9), 8) AS scaled FROM (SELECT c_nationkey AS n_nationkey, avg(c_acctbal) AS avg_bal FROM customer GROUP BY 1)")
def min_max_scaled(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.avg("c_acctbal").alias("b"))
    return rows.select("nation", F.round(S.min_max("b"), 8).alias("scaled"))


_LEVEL = "floor(epoch(ts) / 604800)::BIGINT - (SELECT min(floor(epoch(ts) / 604800))::BIGINT FROM events)"
_WEEKS = f"w AS (SELECT {_LEVEL} AS level, user_id AS sample, avg(value) AS value, avg(CASE WHEN event_type <> 'error' THEN 1.0 ELSE 0.0 END) AS accuracy FROM events GROUP BY ALL)"


def weeks(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("week", F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 604800))
    first = rows.agg(F.min("week").alias("first"))
    sums = rows.groupBy("week", F.col("user_id").alias("sample")).agg(F.avg("value").alias("value"), F.avg((F.col("event_type") != "error").cast("double")).alias("accuracy"))
    return sums.join(F.broadcast(first)).select((F.col("week") - F.col("first")).alias("level"), "sample", "value", "accuracy")


@query(f"""WITH {_WEEKS}, c AS (SELECT sample FROM w GROUP BY sample HAVING count(DISTINCT level) = (SELECT count(DISTINCT level) FROM w))
SELECT level, sample, round(value, 8) AS value, round(max(CASE WHEN level = 0 THEN value END) OVER (PARTITION BY sample), 8) AS base FROM w WHERE sample IN (FROM c)""")
def drift_align(spark, sf_dir):
    return _r(D.aligned(weeks(spark, sf_dir)))


@query(f"""WITH {_WEEKS}, m AS (SELECT level, avg(value) AS mean, count(value) AS n, stddev_pop(value) AS sd FROM w GROUP BY level), z AS (SELECT mean AS m0, CASE WHEN sd > 0 THEN sd ELSE 1 END AS s0 FROM m WHERE level = 0)
SELECT level, n, round(mean, 8) AS mean, round((mean - m0) / s0, 8) AS z FROM m LEFT JOIN z ON true""")
def drift_levels(spark, sf_dir):
    return _r(D.level_means(weeks(spark, sf_dir)))


@query(f"WITH {_WEEKS} SELECT level, count(*) AS n, round(avg(accuracy), 8) AS accuracy FROM (SELECT *, max(CASE WHEN level = 0 THEN accuracy END) OVER (PARTITION BY sample) AS a0 FROM w) WHERE a0 >= 0.5 GROUP BY level")
def drift_baseline_correct(spark, sf_dir):
    rows = D.correct_at_baseline(weeks(spark, sf_dir), "accuracy").filter("correct_at_baseline >= 0.5")
    return _r(rows.groupBy("level").agg(F.count("*").alias("n"), F.avg("accuracy").alias("accuracy")))


def _intervals(spark, sf_dir, value):
    rows = weeks(spark, sf_dir)
    base = rows.filter("level = 0").select("sample", F.col(value).alias("base"))
    return D.bootstrap_levels(rows.join(base, "sample").select("level", "sample", F.col(value).alias("value"), "base"))


@query()
def drift_intervals(spark, sf_dir):
    return _intervals(spark, sf_dir, "value").select("level", "n", F.round("diff", 9).alias("diff"), F.round("low", 9).alias("low"), F.round("high", 9).alias("high"))


@query()
def drift_lead(spark, sf_dir):
    found = [D.detection_level(_intervals(spark, sf_dir, v), way).select(F.lit(v).alias("metric"), "detected") for v, way in (("accuracy", "down"), ("value", "up"))]
    return D.lead(found[0].unionByName(found[1]), "accuracy")


@query()
def separability_table(spark, sf_dir):
    from ..operators import tables

    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("dimension"), (F.col("user_id") % 2 == 0).alias("positive"), "value")
    pairs = halves(spark, sf_dir).select(F.lit("halves").alias("dimension"), "x", "y")
    return tables.separability(rows, pairs)


@query()
def emergence_table(spark, sf_dir):
    from ..operators import tables

    return tables.emergence(halves(spark, sf_dir).select(F.col("label").alias("dimension"), "x", "y"))


def _metric_scores(spark, sf_dir):
    rows = brands(spark, sf_dir).withColumnRenamed("p_brand", "model")
    cells = F.array(*(F.struct(F.lit(m).alias("metric"), F.lit(t).alias("task"), F.col(m).alias("m"), F.col(t).alias("t")) for m in ("price", "size") for t in ("qty", "size") if m != t))
    return rows.select("model", F.col("price").alias("z"), F.inline(cells))


@query()
def association_table(spark, sf_dir):
    from ..operators import tables

    return tables.shown(tables.association(_metric_scores(spark, sf_dir)), rho=2, p=3, q=3)


@query()
def best_predictor_table(spark, sf_dir):
    from ..operators import tables

    return tables.best_predictors(tables.association(_metric_scores(spark, sf_dir)))
