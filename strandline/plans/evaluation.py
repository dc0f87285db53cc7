"""Evaluation, routing and downstream queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..functions.prng import uniform, uniform_sql
from ..operators import classify as C
from ..operators import evaluation as E
from ..operators import routing as R
from .classification import _REPORT, _SQL, predictions, scored
from .registry import query, table
from .robust import _CLEAN

_OUT = "actual = 9"


def _watched(spark, sf_dir):
    rows = scored(spark, sf_dir).withColumn("p", V.softmax(F.col("scores")))
    best = F.array_position("scores", F.array_max("scores"))
    own = F.element_at("p", F.array_position("names", F.lit(3)).cast("int"))
    found = rows.select(F.col("vec_id").alias("id"), F.col("label").alias("actual"), F.element_at("names", best.cast("int")).alias("predicted"), F.round(F.array_max("p"), 6).alias("confidence"), F.round(own, 6).alias("p_label"))
    return found.withColumn("outside", F.expr(_OUT))


def _rounded(df, *columns):
    return df.select(*(F.round(c, 8).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes if not columns or c in columns))


@query(f"""WITH {_SQL} SELECT 0.5::DOUBLE AS threshold, round(avg(CASE WHEN actual <> 9 THEN (confidence >= 0.5)::INT END), 8) AS coverage, round(avg(CASE WHEN actual <> 9 AND confidence >= 0.5 THEN (actual = predicted)::INT END), 8) AS selective_accuracy,
count(*) FILTER (actual <> 9 AND confidence >= 0.5 AND actual <> predicted) AS confident_errors, count(*) FILTER (actual <> 9 AND actual <> predicted) AS errors, count(*) FILTER (actual = 9) AS outside, round(avg(CASE WHEN actual = 9 THEN (confidence >= 0.5)::INT END), 8) AS false_accept_rate FROM pred""")
def selective_rates(spark, sf_dir):
    return _rounded(E.selective_rates(_watched(spark, sf_dir), 0.5, "outside"))


@query(f"""WITH {_SQL}, w AS (SELECT vec_id AS id, round(max(p) FILTER (c = 3), 6) AS pl FROM p GROUP BY ALL), q AS (SELECT * FROM pred JOIN w USING (id))
SELECT 0.16::DOUBLE AS threshold, round(avg(CASE WHEN actual = 3 THEN (pl >= 0.16)::INT END), 8) AS recall, round(avg(CASE WHEN actual NOT IN (3, 9) THEN (pl >= 0.16)::INT END), 8) AS false_rate_inside, round(avg(CASE WHEN actual = 9 THEN (pl >= 0.16)::INT END), 8) AS false_rate_outside,
round(avg(CASE WHEN actual = 3 THEN (predicted = 3)::INT END), 8) AS recall_of_best_label FROM q""")
def watched_rates(spark, sf_dir):
    return _rounded(E.watched_rates(_watched(spark, sf_dir), F.lit(3), 0.16, "outside"))


@query(f"WITH {_SQL} SELECT count(*) AS n, round(avg(confidence), 7) AS mean_confidence, round(coalesce(avg(confidence) FILTER (actual <> predicted), 0), 7) AS mean_confidence_errors FROM pred")
def mean_confidence(spark, sf_dir):
    out = E.mean_confidence(predictions(spark, sf_dir))
    return out.select("n", *(F.round(c, 7).alias(c) for c in ("mean_confidence", "mean_confidence_errors")))


@query(f"WITH {_SQL}, {_REPORT} SELECT label, round(recall, 8) AS recall FROM rep ORDER BY rep.recall, label LIMIT 5")
def lowest_recall(spark, sf_dir):
    return _rounded(E.lowest_recall(C.class_report(predictions(spark, sf_dir))))


@query()
def full_evaluation(spark, sf_dir):
    rows = _watched(spark, sf_dir)
    return E.full_evaluation(rows.filter("id % 2 = 0"), rows.filter("id % 2 = 1"), "outside")


def _candidates(spark, sf_dir):
    """Two models: the nearest centroid, and one that names label 0 for every seventh row; both calibrated at a fixed temperature."""
    names = list(range(10))
    rows = E.calibrated(scored(spark, sf_dir), "scores", names, 3, 0.5).select("vec_id", F.col("label").alias("actual"), "predicted", *(F.round(c, 6).alias(c) for c in ("raw_confidence", "confidence", "p_label")), (F.col("label") == 9).alias("outside"))
    other = rows.withColumn("predicted", F.when(F.col("vec_id") % 7 == 0, 0).otherwise(F.col("predicted")))
    return rows.withColumn("model", F.lit("nearest")).unionByName(other.withColumn("model", F.lit("spoilt")))


_EVALUATED = f"""{_SQL}, z AS (SELECT vec_id, label, c, s, max(s) OVER (PARTITION BY vec_id) AS m FROM dist),
soft AS (SELECT vec_id, label, c, s, exp((s - m) / 0.5) / sum(exp((s - m) / 0.5)) OVER (PARTITION BY vec_id) AS p, exp(s - m) / sum(exp(s - m)) OVER (PARTITION BY vec_id) AS q FROM z),
one AS (SELECT vec_id, label AS actual, arg_min(c, (-s, c)) AS predicted, round(max(q), 6) AS raw, round(max(p), 6) AS conf, round(max(CASE WHEN c = 3 THEN p END), 6) AS pl, label = 9 AS outside FROM soft GROUP BY ALL),
r AS (SELECT 'nearest' AS model, * FROM one UNION ALL SELECT 'spoilt', vec_id, actual, CASE WHEN vec_id % 7 = 0 THEN 0 ELSE predicted END, raw, conf, pl, outside FROM one),
v AS (SELECT *, floor(conf * 100 + 1e-9) AS k, floor(pl * 100 + 1e-9) AS w, actual = predicted AS ok FROM r WHERE vec_id % 2 = 0), t AS (SELECT *, floor(conf * 100 + 1e-9) AS k, floor(pl * 100 + 1e-9) AS w, actual = predicted AS ok FROM r WHERE vec_id % 2 = 1),
g AS (SELECT unnest(range(101)) AS x),
c1 AS (SELECT model, x, count(*) FILTER (NOT outside AND k >= x) AS i, count(*) FILTER (NOT outside) AS ni, count(*) FILTER (NOT outside AND ok AND k >= x) AS c, count(*) FILTER (NOT outside AND ok) AS nc, count(*) FILTER (outside AND k >= x) AS o, count(*) FILTER (outside) AS no FROM v, g GROUP BY ALL),
c2 AS (SELECT model, x / 100 AS threshold, i / ni AS coverage, (c / nc + ((ni - nc) - (i - c) + no - o) / (ni - nc + no)) / 2 AS balanced FROM c1),
th AS (SELECT model, threshold FROM c2 QUALIFY row_number() OVER (PARTITION BY model ORDER BY coverage >= 0.9 DESC, round(balanced, 6) DESC, coverage DESC, threshold) = 1),
w1 AS (SELECT model, x / 100 AS lim, count(*) FILTER (w >= x AND NOT (actual = 3 AND NOT outside)) / count(*) FILTER (NOT (actual = 3 AND NOT outside)) AS rate FROM v, g GROUP BY ALL),
em AS (SELECT model, th.threshold, coalesce(min(lim) FILTER (lim > 0 AND lim <= th.threshold AND rate <= 0.02), any_value(th.threshold)) AS emergency FROM w1 JOIN th USING (model) GROUP BY ALL),
lab AS (SELECT 'v' AS part, * FROM v WHERE NOT outside UNION ALL SELECT 't', * FROM t WHERE NOT outside),
side AS (SELECT part, model, actual AS l, 1 AS own, ok::INT AS hit FROM lab UNION ALL SELECT part, model, predicted, 0, 0 FROM lab),
s1 AS (SELECT part, model, l, sum(own * hit) AS tp, sum(own) AS support, sum(1 - own) AS named FROM side GROUP BY ALL),
s2 AS (SELECT part, model, support, tp, CASE WHEN named = 0 THEN 0 ELSE tp / named END AS pr, CASE WHEN support = 0 THEN 0 ELSE tp / support END AS re FROM s1),
s3 AS (SELECT *, CASE WHEN pr + re = 0 THEN 0 ELSE 2 * pr * re / (pr + re) END AS f1 FROM s2),
av AS (SELECT part, model, avg(pr) AS macro_precision, avg(re) AS macro_recall, avg(f1) AS macro_f1, sum(f1 * support) / sum(support) AS weighted_f1, sum(tp) / sum(support) AS accuracy FROM s3 GROUP BY ALL),
lat AS (SELECT CASE event_type WHEN 'click' THEN 'nearest' ELSE 'spoilt' END AS model, avg(value) AS latency FROM events WHERE event_type IN ('click', 'view') GROUP BY 1),
ch AS (SELECT model FROM av JOIN lat USING (model) WHERE part = 'v' AND macro_f1 >= (SELECT max(macro_f1) FROM av WHERE part = 'v') - 0.005 ORDER BY latency, model LIMIT 1),
b1 AS (SELECT model, ceil(raw * 10) AS b, abs(sum(ok::INT) - sum(raw)) AS gap FROM t WHERE NOT outside AND raw > 0 GROUP BY ALL), b2 AS (SELECT model, ceil(conf * 10) AS b, abs(sum(ok::INT) - sum(conf)) AS gap FROM t WHERE NOT outside AND conf > 0 GROUP BY ALL),
ra AS (SELECT model, em.threshold, emergency AS emergency_threshold, avg((k >= round(em.threshold * 100))::INT) FILTER (NOT outside) AS coverage, avg(ok::INT) FILTER (NOT outside AND k >= round(em.threshold * 100)) AS selective_accuracy,
    count(*) FILTER (NOT outside AND k >= round(em.threshold * 100) AND NOT ok) AS confident_errors, count(*) FILTER (NOT outside AND NOT ok) AS errors, avg((k >= round(em.threshold * 100))::INT) FILTER (outside) AS false_accept_rate,
    avg((w >= round(emergency * 100))::INT) FILTER (NOT outside AND actual = 3) AS watched_recall, avg((w >= round(emergency * 100))::INT) FILTER (NOT outside AND actual <> 3) AS false_alarm_rate, avg((w >= round(emergency * 100))::INT) FILTER (outside) AS false_alarm_rate_outside,
    avg((predicted = 3)::INT) FILTER (NOT outside AND actual = 3) AS recall_of_best_label FROM t JOIN em USING (model) GROUP BY ALL),
wide AS (SELECT ra.*, a.* EXCLUDE (part, model), (SELECT macro_f1 FROM av x WHERE x.part = 'v' AND x.model = ra.model) AS validation_macro_f1, (SELECT latency FROM lat WHERE lat.model = ra.model) AS latency, (ra.model IN (FROM ch))::INT AS selected,
    (SELECT sum(gap) FROM b1 WHERE b1.model = ra.model) / n AS ece_before, (SELECT sum(gap) FROM b2 WHERE b2.model = ra.model) / n AS ece_after
    FROM ra JOIN av a ON a.model = ra.model AND a.part = 't' JOIN (SELECT model, count(*) AS n FROM t WHERE NOT outside GROUP BY model) z ON z.model = ra.model)"""
_METRICS = "validation_macro_f1 latency threshold emergency_threshold coverage selective_accuracy confident_errors errors false_accept_rate watched_recall false_alarm_rate false_alarm_rate_outside recall_of_best_label macro_precision macro_recall macro_f1 weighted_f1 accuracy ece_before ece_after selected".split()


@query(f"WITH {_EVALUATED} " + " UNION ALL ".join(f"SELECT model, '{m}' AS metric, round({m}::DOUBLE, 6) AS value FROM wide" for m in _METRICS))
def model_evaluation(spark, sf_dir):
    rows = _candidates(spark, sf_dir)
    events = table(spark, sf_dir, "events").filter("event_type in ('click', 'view')")
    times = events.groupBy(F.when(F.col("event_type") == "click", "nearest").otherwise("spoilt").alias("model")).agg(F.avg("value").alias("latency"))
    out = E.model_evaluation(rows.filter("vec_id % 2 = 0"), rows.filter("vec_id % 2 = 1"), times, F.lit(3))
    return out.select("model", "metric", F.round("value", 6).alias("value"))


@query()
def model_calibration(spark, sf_dir):
    rows = scored(spark, sf_dir).withColumn("outside", F.col("label") == 9)
    return _rounded(E.calibration(rows, "scores", "label", list(range(10)), 3, "outside"))


_SIGNS = ["***", "$$$", "&&&", "###", "%%%"]
_FLAG = "(" + " OR ".join(f"contains(lower({_CLEAN}), '{x}')" for x in _SIGNS) + ")"


def _flagged(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "text").join(table(spark, sf_dir, "labels").filter("quality is not null"), "doc_id")
    return rows.select("doc_id", (F.col("quality") == 0).alias("target"), R.has_keyword(F.col("text"), _SIGNS).alias("flagged"))


@query(f"""WITH f AS (SELECT doc_id, quality = 0 AS target, {_FLAG} AS flagged FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL)
SELECT round(avg(CASE WHEN target THEN flagged::INT END), 8) AS recall, count(*) FILTER (flagged AND target) AS caught, count(*) FILTER (target) AS targets, count(*) FILTER (flagged AND NOT target) AS false_flags, count(*) FILTER (NOT target) AS others FROM f""")
def flag_recall(spark, sf_dir):
    return _rounded(E.flag_recall(_flagged(spark, sf_dir), F.col("target"), F.col("flagged")))


@query(f"SELECT doc_id FROM documents JOIN labels USING (doc_id) WHERE quality = 0 AND NOT {_FLAG}")
def missed_rows(spark, sf_dir):
    return E.missed(_flagged(spark, sf_dir), F.col("target"), F.col("flagged")).select("doc_id")


@query(f"SELECT doc_id, {_FLAG} AS flagged FROM documents")
def keyword_flags(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", R.has_keyword(F.col("text"), _SIGNS).alias("flagged"))


@query("SELECT event_type, round(avg(value), 8) AS mean, round(quantile_cont(value, 0.95), 8) AS p95 FROM events GROUP BY event_type")
def latency(spark, sf_dir):
    return _rounded(E.latency(table(spark, sf_dir, "events"), "value", "event_type"))


@query("SELECT source, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'fr') AS fr, count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang = 'es') AS es FROM documents GROUP BY source")
def label_source_counts(spark, sf_dir):
    return E.crossed_counts(table(spark, sf_dir, "documents"), "source", "lang", ["en", "fr", "de", "es"])


_MOODS = ["calm", "glad", "sad", "angry", "afraid", "surprised", "bored", "proud", "ashamed", "curious"]


@query(f"""WITH {_SQL}, m AS (SELECT vec_id, max(p) AS best, {_MOODS}[arg_min(c, (-s, c)) + 1] AS raw FROM p GROUP BY ALL)
SELECT vec_id, CASE WHEN best >= 0.5 THEN raw ELSE 'neutral' END AS mood, round(best, 4) AS confidence, CASE WHEN best >= 0.5 THEN 'confident' ELSE 'fallback_neutral' END AS status, raw FROM m""")
def single_mood(spark, sf_dir):
    rows = scored(spark, sf_dir).select("vec_id", "names", V.softmax(F.col("scores")).alias("p"))
    return rows.select("vec_id", R.single_mood(F.col("p"), _MOODS).alias("m")).select("vec_id", "m.*")


_BLANK = f"{_CLEAN} = ''"


@query(f"""WITH c AS (SELECT conv_id, turn, text, CASE WHEN turn % 2 = 0 THEN 'booking' ELSE 'billing' END AS intent, round({uniform_sql("'c'", 'conv_id', 'turn')}, 6) AS confidence FROM conversations),
o AS (SELECT *, {_BLANK} AS blank, NOT ({_BLANK}) AND contains(lower({_CLEAN}), 'tionan') AS over FROM c)
SELECT conv_id, turn, CASE WHEN over THEN 'urgent' ELSE intent END AS intent, CASE WHEN over THEN 1.0 ELSE confidence END AS confidence, over AS safety_override, CASE WHEN blank THEN 'empty' WHEN over THEN 'override' WHEN confidence < 0.3 THEN 'low_confidence' ELSE 'answered' END AS status FROM o""")
def second_pipeline(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("intent", F.when(F.col("turn") % 2 == 0, "booking").otherwise("billing")).withColumn("confidence", F.round(uniform("c", F.col("conv_id"), F.col("turn")), 6))
    return R.overridden(rows, "text", "urgent", ["tionan"], 0.3).select("conv_id", "turn", "intent", "confidence", "safety_override", "status")


@query("""WITH o(r_name, o, s, u) AS (SELECT r_name, CASE WHEN r_regionkey > 0 THEN 'From ' || r_name || ':' ELSE '' END, 'Hello ' || r_name || '.', 'At once!' FROM region)
SELECT n_name AS intent, r_name AS mood, trim(CASE WHEN n_name = 'NATION_1' THEN u || ' ' WHEN n_name IN ('NATION_2', 'NATION_3') THEN s || ' ' WHEN o <> '' THEN o || ' ' ELSE '' END || 'About ' || n_name || '.') AS response FROM nation, o""")
def response_matrix(spark, sf_dir):
    intents = table(spark, sf_dir, "nation").select(F.col("n_name").alias("intent"), F.concat(F.lit("About "), "n_name", F.lit(".")).alias("body"))
    moods = table(spark, sf_dir, "region").select(F.col("r_name").alias("mood"), F.when(F.col("r_regionkey") > 0, F.concat(F.lit("From "), "r_name", F.lit(":"))).otherwise("").alias("opener"), F.concat(F.lit("Hello "), "r_name", F.lit(".")).alias("social_opener"), F.lit("At once!").alias("urgent_opener"))
    return R.response_matrix(intents, moods, "NATION_1", ["NATION_2", "NATION_3"])


@query("SELECT p_partkey, array_to_string(regexp_extract_all(lower(p_name), '[a-z]+'), ' ') AS words FROM part")
def name_summary(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.name_words(F.col("p_name")).alias("words"))


@query("SELECT strength, f1 FROM (SELECT l_tax AS strength, round(avg(l_discount), 4) AS f1 FROM lineitem GROUP BY 1) ORDER BY f1 DESC, strength LIMIT 1")
def grid_pick(spark, sf_dir):
    grid = table(spark, sf_dir, "lineitem").groupBy(F.col("l_tax").alias("strength")).agg(F.round(F.avg("l_discount"), 4).alias("f1"))
    return E.best_strength(grid)


@query("SELECT conv_id, turn FROM conversations WHERE text IS NOT NULL AND role = 'user' ORDER BY conv_id, turn LIMIT 100")
def gradable_head(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").filter("role = 'user'")
    return E.gradable(rows, "text", ["conv_id", "turn"], 100).select("conv_id", "turn")


@query(r"SELECT doc_id, md5(array_to_string(list_slice(regexp_split_to_array(trim(text), '\s+'), 1, 64), ' ')) AS head_md5 FROM documents WHERE text IS NOT NULL")
def first_tokens(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").filter("text is not null")
    return rows.select("doc_id", F.md5(E.first_tokens(F.col("text"), 64)).alias("head_md5"))


def _last_word(prompts):
    return "I think so.\nFinal answer: " + prompts.str.split(" ").str[-1] + " in all"


@query("SELECT o_orderkey, 'echo' AS model, 'I think so.' || chr(10) || 'Final answer: ' || o_orderkey || ' in all' AS raw_output, CAST(o_orderkey AS VARCHAR) AS extracted, o_orderkey % 3 <> 0 AS is_correct FROM orders")
def graded_run(spark, sf_dir):
    key = F.col("o_orderkey")
    prompts = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("what is the number "), key).alias("prompt"), F.when(key % 3 == 0, key + 1).otherwise(key).cast("string").alias("gold"), F.lit("numeric").alias("kind"))
    return E.graded_run(prompts, _last_word, "echo").select("o_orderkey", "model", "raw_output", "extracted", "is_correct")


@query("SELECT l_returnflag AS rule, count(*) AS n, round(avg(l_discount), 8) AS mean_score FROM lineitem GROUP BY ROLLUP (l_returnflag)")
def graded_by_rule(spark, sf_dir):
    return _rounded(E.graded_by_rule(table(spark, sf_dir, "lineitem").withColumnRenamed("l_returnflag", "rule"), "rule", "l_discount"))


_PASS = """o AS (SELECT 'm' || l_suppkey % 7 AS model, l_returnflag AS task, l_linenumber > 1 AS eligible, l_tax < 0.04 AS passed, CASE WHEN l_returnflag = 'R' THEN l_discount END AS overlap FROM lineitem),
s AS (SELECT model, task, avg(CASE WHEN eligible THEN coalesce(overlap, passed::INT::DOUBLE) END) AS score, count(*) FILTER (eligible) AS n FROM o GROUP BY ALL)"""


def _passes(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    model = F.concat(F.lit("m"), (F.col("l_suppkey") % 7).cast("string")).alias("model")
    return E.pass_rates(rows.select(model, F.col("l_returnflag").alias("task"), (F.col("l_linenumber") > 1).alias("eligible"), (F.col("l_tax") < 0.04).alias("passed"), F.when(F.col("l_returnflag") == "R", F.col("l_discount")).alias("overlap")))


@query(f"WITH {_PASS} SELECT model, task, round(score, 8) AS score, n FROM s")
def pass_rates(spark, sf_dir):
    return _rounded(_passes(spark, sf_dir))


@query(f"WITH {_PASS} SELECT model, round(max(score) FILTER (task = 'A'), 8) AS A, round(max(score) FILTER (task = 'N'), 8) AS N, round(max(score) FILTER (task = 'R'), 8) AS R FROM s GROUP BY model")
def suite_scores(spark, sf_dir):
    return _rounded(E.suite(_passes(spark, sf_dir), ["A", "N", "R"]))


_MODELS = """st AS (SELECT 'n' || s_nationkey AS model, max(s_acctbal) AS srs, min(s_acctbal) AS cfs, round(avg(s_acctbal), 6) AS dfbs FROM supplier GROUP BY 1), ds AS (SELECT 'n' || c_nationkey AS model, max(c_acctbal) AS score FROM customer WHERE c_nationkey < 18 GROUP BY 1),
pa AS (SELECT 'n' || n_nationkey AS model, n_nationkey * 1000::DOUBLE AS params FROM nation WHERE n_regionkey > 0)"""


def _structural(spark, sf_dir):
    model = F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("model")
    return table(spark, sf_dir, "supplier").groupBy(model).agg(F.max("s_acctbal").alias("srs"), F.min("s_acctbal").alias("cfs"), F.round(F.avg("s_acctbal"), 6).alias("dfbs"))


def _downstream(spark, sf_dir):
    return table(spark, sf_dir, "customer").filter("c_nationkey < 18").groupBy(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("model")).agg(F.max("c_acctbal").alias("score"))


@query(f"WITH {_MODELS} SELECT model, srs, cfs, dfbs, score, params FROM st JOIN ds USING (model) LEFT JOIN pa USING (model)")
def downstream_restricted(spark, sf_dir):
    parameters = table(spark, sf_dir, "nation").filter("n_regionkey > 0").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("model"), (F.col("n_nationkey") * 1000).cast("double").alias("params"))
    return E.restricted(_structural(spark, sf_dir), _downstream(spark, sf_dir), parameters)


@query(f"WITH {_MODELS} SELECT model, srs, cfs, dfbs, score FROM st LEFT JOIN ds USING (model)")
def latent_task_join(spark, sf_dir):
    return E.with_task_scores(_structural(spark, sf_dir), _downstream(spark, sf_dir))


_WEIGHTS = {"localization": (0.45, {"dfbs": 0.35}), "repair": (0.30, {"dfbs": 0.40, "cfs": 0.1}), "summaries": (0.25, {"srs": 0.45})}
_SCALED = "n AS (SELECT model, " + ", ".join(f"({m} - min({m}) OVER ()) / (max({m}) OVER () - min({m}) OVER () + 1e-9) AS {m}" for m in ("srs", "cfs", "dfbs")) + " FROM st)"


@query(f"WITH {_MODELS}, {_SCALED} SELECT model, " + ", ".join(f"round(least(greatest({b}::DOUBLE + ({uniform_sql('0', 'model', repr(t))} - 0.5) * 0.1 + " + " + ".join(f"{m} * {w}::DOUBLE" for m, w in own.items()) + f", 0), 1), 8) AS {t}" for t, (b, own) in _WEIGHTS.items()) + " FROM n")
def synthetic_scores(spark, sf_dir):
    return _rounded(E.synthetic_scores(_structural(spark, sf_dir), _WEIGHTS))


@query("SELECT (SELECT array_to_string(list_sort(list(DISTINCT source)), ',') FROM documents) AS models, (SELECT bool_or(regexp_matches(source, 'tiny|random')) FROM documents) AS random_weights, (SELECT bool_or(toxic = 1) FROM labels) AS synthetic_scores")
def provenance(spark, sf_dir):
    scores = table(spark, sf_dir, "labels").select((F.col("toxic") == 1).alias("synthetic"))
    return E.provenance(table(spark, sf_dir, "documents").select(F.col("source").alias("model")), scores).withColumn("models", F.array_join("models", ","))


@query("SELECT count(*) AS programs, count(*) FILTER (contains(text, chr(10))) AS syntactic_pairs, count(*) FILTER (contains(text, ' the ')) AS control_flow_pairs, CAST(sum(n_chars) AS BIGINT) AS definition_uses, count(DISTINCT source) AS repositories FROM documents")
def corpus_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "documents")
    return E.corpus_counts(rows.select(F.col("source").alias("repo"), F.contains("text", F.lit("\n")).alias("syntactic"), F.contains("text", F.lit(" the ")).alias("control"), F.col("n_chars").alias("n_uses")))


@query("""SELECT vec_id, 'Continue.' || chr(10) || 'Sequence: a' || chr(10) || 'Answer: b' || chr(10) || chr(10) || 'Sequence: ' || label || chr(10) || 'Answer:' AS prompt FROM embeddings""")
def answer_prompts(spark, sf_dir):
    from ..functions.grading import answer_prompt

    shots = F.array(F.struct(F.lit("a").alias("prefix"), F.lit("b").alias("answer")))
    return table(spark, sf_dir, "embeddings").select("vec_id", answer_prompt("Continue.", F.col("label").cast("string"), shots).alias("prompt"))


@query("""SELECT p_partkey, 'Which?' || chr(10) || 'Prefix: the bank, Options: A. river or B. money. Hint: water Your response: ambiguous status=AMBIGUOUS; answer=A' || chr(10) || chr(10) || chr(10) || 'Prefix: ' || p_name || ', Options: A. ' || p_brand || ' or B. ' || p_type || '. Hint: ' || p_size || ' Your response:' AS prompt FROM part""")
def sense_prompts(spark, sf_dir):
    from ..functions.grading import sense_prompt

    shot = F.struct(*(F.lit(v).alias(k) for k, v in {"prefix": "the bank", "option_a": "river", "option_b": "money", "hint": "water", "gold_status": "AMBIGUOUS", "gold_answer": "A"}.items()))
    item = F.struct(F.col("p_name").alias("prefix"), F.col("p_brand").alias("option_a"), F.col("p_type").alias("option_b"), F.col("p_size").cast("string").alias("hint"))
    return table(spark, sf_dir, "part").select("p_partkey", sense_prompt("Which?", item, F.array(shot)).alias("prompt"))


@query("SELECT conv_id, turn, kind, prompt FROM (SELECT conv_id, turn, unnest([{'kind': 'rename', 'prompt': regexp_replace(text, '\\bthe\\b', 'some', 'g')}, {'kind': 'noop', 'prompt': rtrim(text) || CASE WHEN regexp_matches(rtrim(text), '[.?!]$') THEN ' ' ELSE '. ' END || 'It rained.'}], recursive := true) FROM conversations WHERE text IS NOT NULL)")
def prompt_variants(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").filter("text is not null")
    return rows.select("conv_id", "turn", F.inline(T.variants(F.col("text"), {"the": "some"}, "It rained.")))


@query()
def layer_profiles(spark, sf_dir):
    from ..operators.latent import layer_profiles as run

    rows = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 4).alias("layer"), F.col("label").alias("model"), F.col("embedding").cast("array<double>").alias("v"))
    out = run(rows, "model", "layer", "v")
    return out.select("model", *(F.transform(c, lambda x: F.round(x, 6)).alias(c) for c in ("er_by_layer", "pr_by_layer")), *(F.round(c, 6).alias(c) for c in ("max_er", "last_er", "max_pr", "last_pr")))


@query()
def ols_interval(spark, sf_dir):
    from ..operators.stats import ols
    from ..operators.stats import ols_interval as run

    rows = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_suppkey").agg(F.avg("l_quantity").alias("q"), F.avg("l_extendedprice").alias("p"))
    out = run(ols(rows, "q", "p", "l_returnflag"))
    return out.select("l_returnflag", "n", *(F.round(c, 6).alias(c) for c in ("beta", "se", "r2", "low", "high", "p")))


@query()
def structural_profile(spark, sf_dir):
    from ..operators import structure as X
    from .structure import distances

    pairs = distances(spark, sf_dir).withColumn("delta", F.lit(0.5))
    bindings = pairs.select("model", "layer", F.col("dist").alias("b"), F.lit(1.0).alias("n"))
    profile, _ = X.structural_profile(pairs, pairs, bindings)
    return profile.withColumn("value", F.round("value", 7))
