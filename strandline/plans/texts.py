"""Text columns, pooled vectors, moods, templates and profiles over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..functions.prng import uniform_sql
from ..operators import classify, drift, generators, latent, robustness, routing, structure
from .classification import _SQL, scored
from .registry import query, table
from .robust import _KEY
from .statistics import _WEEKS, weeks

_ENDED = "rtrim(text) || CASE WHEN regexp_matches(rtrim(text), '[.?!]$') THEN ' ' ELSE '. ' END || 'Thank you.'"


@query(f"SELECT conv_id, turn, {_ENDED} AS text FROM conversations")
def appended_sentences(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.append_sentence(F.col("text"), "Thank you.").alias("text"))


@query(r"""SELECT p_partkey, regexp_replace(regexp_replace(p_name, '\bwidget\b', 'gad$1get', 'g'), '\bcold\b', 'warm', 'g') AS renamed, p_brand || ' of size ' || p_size || ' {unknown}' AS rendered,
array_to_string(list_transform(string_split(replace(p_name, ' ', '_'), '_'), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS title, CASE WHEN p_retailprice = floor(p_retailprice) THEN CAST(p_retailprice::BIGINT AS VARCHAR) ELSE CAST(p_retailprice AS VARCHAR) END AS price,
p_size * CASE p_partkey % 5 WHEN 0 THEN 1e3 WHEN 1 THEN 1e6 WHEN 2 THEN 1e9 WHEN 3 THEN 1e12 ELSE 1 END AS parameters FROM part""")
def text_edits(spark, sf_dir):
    rows = table(spark, sf_dir, "part")
    values = F.create_map(F.lit("brand"), "p_brand", F.lit("size"), F.col("p_size").cast("string"))
    unit = F.element_at(F.array(*map(F.lit, "KmBt ")), (F.col("p_partkey") % 5 + 1).cast("int"))
    return rows.select(
        "p_partkey",
        T.rename_words(F.col("p_name"), {"widget": "gad$1get", "cold": "warm"}).alias("renamed"),
        T.render(F.lit("{brand} of size {size} {unknown}"), values).alias("rendered"),
        T.title(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("title"),
        T.number_text(F.col("p_retailprice")).alias("price"),
        T.parameter_count(F.concat(F.col("p_size").cast("string"), unit)).alias("parameters"),
    )


@query("SELECT doc_id, CAST(1 + len(string_split(substring(text, 1, n_chars // 2), chr(10))) - 1 AS INTEGER) AS line FROM documents WHERE text IS NOT NULL")
def line_of_the_middle(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").filter("text is not null")
    return rows.select("doc_id", T.line_of(F.col("text"), F.floor(F.col("n_chars") / 2)).alias("line"))


@query()
def sentence_chunks(spark, sf_dir):
    """Pieces of whole sentences of at most 400 characters; a longer sentence is a piece."""
    rows = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", T.chunks(F.col("text"), 400).alias("x"))
    return rows.select("doc_id", F.size("x").alias("n"), F.array_max(F.transform("x", lambda c: F.length(c))).alias("longest"), F.md5(F.array_join("x", " ")).alias("joined_md5"))


@query("""WITH m AS (SELECT label, vec_id, unnest(range(0, len(embedding))) AS d, unnest(embedding)::DOUBLE AS x, vec_id % 3 = 0 AND label <> 9 AS own FROM embeddings), a AS (SELECT *, max(own::INT) OVER (PARTITION BY label) AS any_own FROM m), s AS (FROM a WHERE own OR any_own = 0),
p AS (SELECT label, d, avg(x) AS mean, max(x) AS max, sum(x) AS sum, arg_max(x, vec_id) AS last FROM s GROUP BY ALL)
SELECT label, round(sum(mean), 6) AS mean, round(sum(max), 6) AS max, round(sum(sum), 5) AS sum, round(sum(last), 6) AS last FROM p GROUP BY label""")
def pooled_vectors(spark, sf_dir):
    """Selected rows' vectors as one by each rule, all rows' where none is selected; shown by the sums of their components."""
    rows = table(spark, sf_dir, "embeddings").select("label", "vec_id", F.col("embedding").cast("array<double>").alias("v"))
    own = (F.col("vec_id") % 3 == 0) & (F.col("label") != 9)
    out = None
    for how in ("mean", "max", "sum", "last"):
        one = latent.pooled(rows, ["label"], "vec_id", "v", own, how).select("label", F.round(V.total(F.col("v")), 5 if how == "sum" else 6).alias(how))
        out = one if out is None else out.join(one, "label")
    return out


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS a FROM embeddings), p AS (SELECT x.vec_id, x.a AS a, y.a AS b FROM v x JOIN v y ON y.vec_id = x.vec_id + 1)
SELECT vec_id, round(list_dot_product(a, b) / greatest(sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b)), 1e-12), 8) AS cosine, round(sqrt(list_sum(list_transform(range(1, len(a) + 1), lambda i: (a[i] - b[i]) * (a[i] - b[i])))), 8) AS distance FROM p""")
def neighbouring_vectors(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    pairs = rows.join(rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")
    return pairs.select("vec_id", F.round(V.cosine(F.col("a"), F.col("b")), 8).alias("cosine"), F.round(V.euclidean(F.col("a"), F.col("b")), 8).alias("distance"))


_BAND = lambda c: f"(SELECT level, avg({c}) AS m, count({c}) AS n, stddev_pop({c}) AS s FROM w GROUP BY level)"


@query(f"""WITH {_WEEKS}, v AS (SELECT 'value' AS metric, l.level, (l.m - b.m) / b.s AS z, 1 / sqrt(l.n) AS e FROM {_BAND('value')} l, {_BAND('value')} b WHERE b.level = 0 UNION ALL SELECT 'accuracy', l.level, (l.m - b.m) / b.s, 1 / sqrt(l.n) FROM {_BAND('accuracy')} l, {_BAND('accuracy')} b WHERE b.level = 0),
d AS (SELECT metric, min(level) FILTER (level > 0 AND round(z - e, 8) > 0) AS detected FROM v GROUP BY metric)
SELECT metric, detected, (SELECT detected FROM d WHERE metric = 'accuracy') - detected AS lead FROM d WHERE metric <> 'accuracy'""")
def detected_levels(spark, sf_dir):
    """The first level whose interval about its z-score is over zero, and how far before accuracy's that is."""
    rows, found = weeks(spark, sf_dir), None
    for metric in ("value", "accuracy"):
        means = drift.level_means(rows, metric)
        band = means.select("level", F.round(F.col("z") - 1 / F.sqrt("n"), 8).alias("low"), F.round(F.col("z") + 1 / F.sqrt("n"), 8).alias("high"))
        one = drift.detection_level(band, "up").select(F.lit(metric).alias("metric"), "detected")
        found = one if found is None else found.unionByName(one)
    return drift.lead(found, "accuracy")


@query("""WITH m AS (SELECT p_brand AS model, round(avg(p_size) / 50, 6) AS f1, round(avg(p_retailprice), 6) AS latency FROM part GROUP BY 1) SELECT model, f1, latency FROM m WHERE f1 >= (SELECT max(f1) FROM m) - 0.05 ORDER BY latency, model LIMIT 1""")
def chosen_model(spark, sf_dir):
    rows = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("model")).agg(F.round(F.avg("p_size") / 50, 6).alias("f1"), F.round(F.avg("p_retailprice"), 6).alias("latency"))
    return classify.choose_model(rows, 0.05)


_L = "l AS (SELECT l_returnflag AS model, l_linenumber AS layer, l_quantity AS dist, nullif(l_discount, 0) AS delta, l_tax FROM lineitem)"


@query(f"WITH {_L}, u AS (SELECT *, coalesce(delta, avg(delta) OVER (PARTITION BY model), 1) AS unit FROM l) SELECT 'CFS_norm' AS metric, model, layer, round(avg(dist / (unit + 1e-8)), 5) AS value FROM u GROUP BY ALL UNION ALL SELECT 'DFBS', model, layer, round(avg(coalesce(delta, 0) - l_tax), 8) FROM l GROUP BY ALL")
def distance_profiles(spark, sf_dir):
    """Distances over their pair's change, the mean one where it is unknown, and the surplus of bindings, by layer."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("model"), F.col("l_linenumber").alias("layer"), F.col("l_quantity").alias("dist"), F.nullif("l_discount", F.lit(0.0)).alias("delta"), "l_tax")
    norm = structure.normalised_profile(rows).select(F.lit("CFS_norm").alias("metric"), "model", "layer", F.round("value", 5).alias("value"))
    bound = structure.binding_profile(rows.withColumn("b", F.coalesce("delta", F.lit(0.0))).withColumn("n", F.col("l_tax")))
    return norm.unionByName(bound.select(F.lit("DFBS").alias("metric"), "model", "layer", F.round("value", 8).alias("value")))


@query("""WITH t AS (SELECT n_name AS intent, r_name AS mood, CASE WHEN (n_nationkey + r_regionkey) % 6 = 1 THEN '  ' WHEN (n_nationkey * r_regionkey) % 5 = 1 THEN 'Hello ' || n_nationkey % 4 ELSE n_name || r_name END AS response FROM nation, region WHERE (n_nationkey + r_regionkey) % 6 <> 0), u AS (FROM t WHERE trim(response) <> '')
SELECT 'missing' AS "check", n_name AS intent, r_name AS mood FROM nation, region WHERE (n_name, r_name) NOT IN (SELECT (intent, mood) FROM u) UNION ALL SELECT 'reused', intent, mood FROM u WHERE response IN (SELECT response FROM u GROUP BY response HAVING count(*) > 1)""")
def template_matrix(spark, sf_dir):
    """Cells of a matrix of responses that are missing or blank, and responses that several cells share."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    n, r = F.col("n_nationkey"), F.col("r_regionkey")
    response = F.when((n + r) % 6 == 1, "  ").when((n * r) % 5 == 1, F.concat(F.lit("Hello "), (n % 4).cast("string"))).otherwise(F.concat("n_name", "r_name"))
    cells = nation.crossJoin(region).filter((n + r) % 6 != 0).select(F.col("n_name").alias("intent"), F.col("r_name").alias("mood"), response.alias("response"))
    names = lambda df, c: [x[0] for x in df.select(c).collect()]
    return routing.template_errors(cells, names(nation, "n_name"), names(region, "r_name"))


_MOOD = """g(label, grp, place) AS (VALUES ('click', 'engaged', 0), ('purchase', 'engaged', 0), ('view', 'neutral', 1), ('error', 'upset', 2)), s AS (SELECT user_id, event_type AS label, round(count(*) / sum(count(*)) OVER (PARTITION BY user_id), 8) AS score FROM events GROUP BY 1, 2),
k AS (SELECT user_id, grp, max(score) AS score, min(place) AS place FROM s JOIN g USING (label) GROUP BY ALL),
t AS (SELECT user_id, arg_min(grp, (-score, place)) AS top, max(score) AS best, arg_min(grp, (-score, place)) FILTER (grp <> 'neutral') AS other, max(score) FILTER (grp <> 'neutral') AS next FROM k GROUP BY user_id)"""


@query(f"""WITH {_MOOD} SELECT user_id, CASE WHEN best < 0.3 THEN 'neutral' WHEN top = 'neutral' AND next >= 0.25 THEN other ELSE top END AS mood, CASE WHEN best >= 0.3 AND top = 'neutral' AND next >= 0.25 THEN next ELSE best END AS score FROM t""")
def grouped_moods(spark, sf_dir):
    """The group of labels with the greatest score of each user; unmapped labels count for nothing, neutral gives way to a strong other."""
    counts = table(spark, sf_dir, "events").groupBy("user_id", F.col("event_type").alias("label")).agg(F.count("*").alias("n"))
    total = counts.groupBy("user_id").agg(F.sum("n").alias("all"))
    scores = counts.join(total, "user_id").select("user_id", "label", F.round(F.col("n") / F.col("all"), 8).alias("score"))
    groups = spark.createDataFrame([("click", "engaged", 0), ("purchase", "engaged", 0), ("view", "neutral", 1), ("error", "upset", 2)], "label string, group string, place int")
    return routing.grouped_mood(scores, groups, "user_id", least=0.3)


@query(f"""WITH {_SQL}, r AS (SELECT vec_id, 'label_' || c AS name, row_number() OVER (PARTITION BY vec_id ORDER BY round(s, 6) DESC, c) AS k FROM dist), n AS (SELECT vec_id, k, name, row_number() OVER (PARTITION BY vec_id ORDER BY k) AS j FROM r WHERE k <= 3 AND name NOT IN ('label_3', 'label_7'))
SELECT e.vec_id, coalesce(string_agg('Label ' || name[7:], ' or ' ORDER BY k) FILTER (j <= 2), '') AS choices FROM embeddings e LEFT JOIN n ON n.vec_id = e.vec_id GROUP BY e.vec_id""")
def clarifications(spark, sf_dir):
    """The two best of the three best labels that aren't small talk, as the choices of a question."""
    rows = scored(spark, sf_dir).select("vec_id", "names", V.top_k(F.col("scores"), 3).alias("t"))
    top = F.transform("t", lambda x: F.struct(F.concat(F.lit("label_"), F.element_at("names", (x["label"] + 1).cast("int")).cast("string")).alias("label"), x["p"].alias("p")))
    return rows.select("vec_id", "names", top.alias("top")).select("vec_id", routing.clarification(F.col("top"), ["label_3", "label_7"]).alias("choices"))


@query("""WITH v AS (SELECT conv_id AS family, turn, 'turn ' || turn AS kind, text AS prompt, CASE WHEN turn % 3 <> 1 THEN md5(text) END AS answer FROM conversations), b AS (SELECT family, arg_min(coalesce(answer, ''), turn) AS base FROM v GROUP BY family)
SELECT family, kind, md5(prompt) AS prompt_md5, coalesce(answer, nullif(base, '')) AS gold FROM v JOIN b USING (family)""")
def family_variants(spark, sf_dir):
    """A row for each variant of a family; one without an answer carries the first variant's."""
    rows = table(spark, sf_dir, "conversations")
    variant = F.struct("turn", F.concat(F.lit("turn "), F.col("turn").cast("string")).alias("kind"), F.col("text").alias("prompt"), F.when(F.col("turn") % 3 != 1, F.md5("text")).alias("answer"))
    families = rows.groupBy(F.col("conv_id").alias("id")).agg(F.sort_array(F.collect_list(variant)).alias("variants")).withColumn("capability", F.lit("talk")).withColumn("answer_type", F.lit("exact"))
    return robustness.explode_variants(families).select("family", "kind", F.md5("prompt").alias("prompt_md5"), "gold")


@query(f"""WITH k AS (SELECT lang, {_KEY} AS key, min(text) AS text FROM documents GROUP BY 1, 2) SELECT lang, md5(text) AS text_md5 FROM k QUALIFY row_number() OVER (PARTITION BY lang ORDER BY {uniform_sql("42", "key")}, key) <= 5""")
def unique_utterances(spark, sf_dir):
    """Five different texts of each language, in a hash order."""
    out = generators.unique_utterances(table(spark, sf_dir, "documents").select("lang", "text"), "lang", "text", 5)
    return out.select("lang", F.md5("text").alias("text_md5"))
