"""Vector profiles and distribution queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import latent
from .registry import query, table


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


_LONG = "long AS (SELECT vec_id, label, unnest(range(0, len(embedding))) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings)"
_ENTROPY = "SELECT vec_id, label, {g} ln(sum(exp(x - m))) - sum(exp(x - m) * (x - m)) / sum(exp(x - m)) AS e FROM (SELECT *, max(x) OVER (PARTITION BY vec_id{p}) AS m FROM {t}) GROUP BY ALL"


@query(f"WITH {_LONG}, n AS (SELECT vec_id, label, sqrt(sum(x * x)) AS norm, max(x) AS top FROM long GROUP BY ALL) SELECT label, round(min(norm), 9) AS min_norm, round(max(norm), 9) AS max_norm, round(max(top), 9) AS max_top FROM n GROUP BY label")
def latent_extremes(spark, sf_dir):
    rows = vectors(spark, sf_dir).select("label", V.norm(F.col("v")).alias("norm"), F.array_max("v").alias("top"))
    out = latent.extremes(rows, "label", low="norm", high=("norm", "top"))
    return out.select("label", *(F.round(c, 9).alias(c) for c in ("min_norm", "max_norm", "max_top")))


@query(f"WITH {_LONG}, e AS ({_ENTROPY.format(g='', p='', t='long')}) SELECT label, round(min(e), 8) AS min_entropy, round(avg(e), 8) AS mean_entropy FROM e GROUP BY label")
def entropy_floor(spark, sf_dir):
    rows = vectors(spark, sf_dir).select("label", V.entropy(F.col("v")).alias("e"))
    return rows.groupBy("label").agg(F.round(F.min("e"), 8).alias("min_entropy"), F.round(F.avg("e"), 8).alias("mean_entropy"))


@query(f"""WITH {_LONG}, c AS (SELECT a.label, a.pos AS i, b.pos AS j, covar_samp(a.x, b.x) AS c FROM long a JOIN long b ON a.vec_id = b.vec_id GROUP BY ALL)
SELECT label, round(pow(sum(CASE WHEN i = j THEN c ELSE 0 END), 2) / sum(c * c), 6) AS participation_ratio FROM c GROUP BY label""")
def participation_ratio(spark, sf_dir):
    out = latent.participation_ratio(latent.covariance(vectors(spark, sf_dir), "label", "v"), "label")
    return out.select("label", F.round("participation_ratio", 6).alias("participation_ratio"))


@query()
def effective_rank(spark, sf_dir):
    return latent.effective_rank(latent.covariance(vectors(spark, sf_dir), "label", "v"), "label")


@query(f"WITH {_LONG} SELECT label, CAST(pos AS INTEGER) AS position, round(avg(x), 9) AS mean, round(pos / (max(len) - 1), 9) AS depth FROM long JOIN (SELECT vec_id, len(embedding) AS len FROM embeddings) USING (vec_id) GROUP BY label, pos")
def layer_curve(spark, sf_dir):
    out = latent.mean_curve(vectors(spark, sf_dir), "label", "v")
    return out.select("label", "position", F.round("mean", 9).alias("mean"), F.round("depth", 9).alias("depth"))


@query(f"""WITH {_LONG}, m AS (SELECT label, pos, avg(x) AS x FROM long GROUP BY ALL), n AS (SELECT label, count(*) AS n FROM m GROUP BY label)
SELECT label, round((max(CASE WHEN pos = 0 THEN x END) + max(CASE WHEN pos = n - 1 THEN x END)) / 2 - min(CASE WHEN pos >= n // 3 AND pos < 2 * n // 3 THEN x END), 9) AS hourglass FROM m JOIN n USING (label) GROUP BY label""")
def hourglass(spark, sf_dir):
    out = latent.curve_hourglass(latent.mean_curve(vectors(spark, sf_dir), "label", "v"), "label")
    return out.select("label", F.round("hourglass", 9).alias("hourglass"))


LENGTHS = [10, 20, 30, 40, 50, 60]


@query(f"""WITH {_LONG}, p AS (SELECT vec_id, label, length, x FROM long, (SELECT unnest({LENGTHS}) AS length) WHERE pos < length), e AS ({_ENTROPY.format(g='length,', p=', length', t='p')})
SELECT label, length, round(min(e), 8) AS floor, round(avg(e), 8) AS mean FROM e GROUP BY label, length""")
def prefix_schedule(spark, sf_dir):
    rows = latent.prefix_measure(vectors(spark, sf_dir), "v", LENGTHS, V.entropy)
    out = latent.prefix_summary(rows, "label", "length")
    return out.select("label", "length", F.round("floor", 8).alias("floor"), F.round("mean", 8).alias("mean"))


@query(f"""WITH {_LONG}, e AS (SELECT vec_id, label, MAP {{'5': avg(CASE WHEN pos < 5 THEN x END), '9': avg(CASE WHEN pos < 9 THEN x END)}} AS m FROM long GROUP BY ALL)
SELECT label, k::INTEGER AS length, round(avg(v), 9) AS mean FROM (SELECT label, unnest(map_keys(m)) AS k, unnest(map_values(m)) AS v FROM e) GROUP BY ALL""")
def rolling_map_means(spark, sf_dir):
    maps = F.create_map(F.lit("5"), V.mean(F.slice("v", 1, 5)), F.lit("9"), V.mean(F.slice("v", 1, 9)))
    out = latent.map_means(vectors(spark, sf_dir).withColumn("m", maps), "label", "m")
    return out.select("label", "length", F.round("mean", 9).alias("mean"))


@query("""WITH r AS (SELECT label, list_max(embedding)::DOUBLE AS x, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k, count(*) OVER (PARTITION BY label) AS n FROM embeddings),
s AS (SELECT label, s AS size, avg(x) AS mean FROM r, (SELECT unnest([10::BIGINT, 100, 500, 1000]) AS s) WHERE k <= s AND n >= s GROUP BY ALL)
SELECT label, size, round(mean, 9) AS mean FROM s UNION ALL SELECT label, count(*), round(avg(x), 9) FROM r WHERE label NOT IN (SELECT label FROM s) GROUP BY label""")
def sample_size_curve(spark, sf_dir):
    rows = vectors(spark, sf_dir).select("label", "vec_id", F.array_max("v").alias("x"))
    out = latent.sample_size_means(rows, ["label"], "vec_id", "x", [10, 100, 500, 1000])
    return out.select("label", "size", F.round("mean", 9).alias("mean"))


@query(f"""WITH {_LONG}, p AS (SELECT vec_id, label, length, x FROM long, (SELECT unnest([8, 16, 32, 64]) AS length) WHERE pos < length)
SELECT label, length, round(min(x), 9) AS min_x, round(avg(x), 9) AS mean_x, round(max(x), 9) AS max_x FROM p GROUP BY ALL""")
def context_sensitivity(spark, sf_dir):
    rows = vectors(spark, sf_dir).select("label", F.explode(F.array(*map(F.lit, (8, 16, 32, 64)))).alias("length"), "v")
    cut = rows.filter(F.col("length") <= F.size("v")).select("label", "length", F.slice("v", F.lit(1), F.col("length")).alias("v"))
    return cut.groupBy("label", "length").agg(F.round(F.min(F.array_min("v")), 9).alias("min_x"), F.round(F.avg(V.mean(F.col("v"))), 9).alias("mean_x"), F.round(F.max(F.array_max("v")), 9).alias("max_x"))


@query("""SELECT source, round(avg(CASE WHEN lang = 'en' THEN n_chars END), 6) AS en, round(avg(CASE WHEN lang = 'de' THEN n_chars END), 6) AS de, round(avg(CASE WHEN lang = 'fr' THEN n_chars END), 6) AS fr, round(avg(CASE WHEN lang = 'es' THEN n_chars END), 6) AS es
FROM documents GROUP BY source HAVING count(DISTINCT lang) >= 2""")
def dataset_sensitivity(spark, sf_dir):
    langs = ["en", "de", "fr", "es"]
    wide = table(spark, sf_dir, "documents").groupBy("source").pivot("lang", langs).agg(F.avg("n_chars"))
    there = sum(F.col(x).isNotNull().cast("int") for x in langs)
    return wide.filter(there >= 2).select("source", *(F.round(x, 6).alias(x) for x in langs))


_SUPP = "SELECT CAST(l_suppkey % 12 AS BIGINT) AS model, unnest(['avg', 'max', 'min']) AS agg, unnest([avg(l_extendedprice), max(l_extendedprice), min(l_extendedprice)]) AS val FROM lineitem GROUP BY 1"


def _ranked(spark, sf_dir):
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 12).alias("model")).agg(F.avg("l_extendedprice").alias("avg"), F.max("l_extendedprice").alias("max"), F.min("l_extendedprice").alias("min"))
    long = rows.select("model", F.inline(F.array(*(F.struct(F.lit(x).alias("agg"), F.col(x).alias("val")) for x in ("avg", "max", "min")))))
    return long.withColumn("place", F.row_number().over(Window.partitionBy("agg").orderBy("val", "model")))


@query(f"WITH s AS ({_SUPP}) SELECT agg, model, row_number() OVER (PARTITION BY agg ORDER BY val, model) AS place FROM s")
def agg_ranking(spark, sf_dir):
    return _ranked(spark, sf_dir).select("agg", "model", F.col("place").cast("long").alias("place"))


@query(f"""WITH s AS ({_SUPP}), r AS (SELECT agg, model, row_number() OVER (PARTITION BY agg ORDER BY val, model) AS p FROM s),
x AS (SELECT a.agg AS a, b.agg AS b, a.model, a.p AS pa, b.p AS pb FROM r a JOIN r b ON a.model = b.model AND a.agg < b.agg)
SELECT x.a, x.b, round(sum(sign(x.pa - y.pa) * sign(x.pb - y.pb)) / count(*), 9) AS tau FROM x JOIN x y ON x.a = y.a AND x.b = y.b AND x.model < y.model GROUP BY 1, 2""")
def agg_invariance(spark, sf_dir):
    from ..operators.stats import kendall

    return kendall(_ranked(spark, sf_dir), "model", "agg", "place").withColumn("tau", F.round("tau", 9))
