"""Variants, grading and text queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import grading as G
from ..functions import text as T
from ..operators import generators, robustness, routing
from ..operators.dealing import text_batches
from ..functions.prng import uniform_sql
from .registry import query, table

_OBS = """obs AS (SELECT source AS model, doc_id % 50 AS family, CASE WHEN lang = 'en' THEN 'baseline' ELSE lang END AS kind,
  CAST(quality AS VARCHAR) AS answer, toxic = 0 AS correct FROM documents JOIN labels USING (doc_id)),
acc AS (SELECT model, kind, avg(CASE WHEN correct THEN 1.0 ELSE 0.0 END) AS accuracy FROM obs GROUP BY ALL),
deg AS (SELECT *, CASE WHEN kind <> 'baseline' THEN 100 * (max(CASE WHEN kind = 'baseline' THEN accuracy END) OVER (PARTITION BY model) - accuracy) END AS degradation FROM acc),
fam AS (SELECT model, family, max(n) / sum(n) AS share FROM (SELECT model, family, coalesce(answer, 'None') AS answer, count(*)::DOUBLE AS n FROM obs GROUP BY ALL) GROUP BY ALL),
con AS (SELECT model, avg(share) AS consistency FROM fam GROUP BY ALL),
siz AS (SELECT model, count(*) AS n_records, count(DISTINCT family) AS n_families FROM obs GROUP BY ALL)"""


def observations(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang").join(table(spark, sf_dir, "labels"), "doc_id")
    kind = F.when(F.col("lang") == "en", "baseline").otherwise(F.col("lang"))
    return docs.select(F.col("source").alias("model"), (F.col("doc_id") % 50).alias("family"), kind.alias("kind"), F.col("quality").cast("string").alias("answer"), (F.col("toxic") == 0).alias("correct"))


@query(f"""WITH {_OBS} SELECT d.model, d.kind, round(d.accuracy, 9) AS accuracy, round(d.degradation, 7) AS degradation_pts, round(c.consistency, 9) AS consistency,
s.n_records, s.n_families FROM deg d JOIN con c USING (model) JOIN siz s USING (model)""")
def robust_summary(spark, sf_dir):
    out = robustness.summarize(observations(spark, sf_dir))
    return out.select("model", "kind", F.round("accuracy", 9).alias("accuracy"), F.round("degradation_pts", 7).alias("degradation_pts"), F.round("consistency", 9).alias("consistency"), "n_records", "n_families")


@query(f"""WITH {_OBS}, w AS (SELECT model, max(CASE WHEN kind = 'baseline' THEN accuracy END) AS a0, max(CASE WHEN kind = 'de' THEN accuracy END) AS a1, max(CASE WHEN kind = 'fr' THEN accuracy END) AS a2,
max(CASE WHEN kind = 'de' THEN degradation END) AS d1, max(CASE WHEN kind = 'fr' THEN degradation END) AS d2 FROM deg GROUP BY model),
e AS (SELECT 'src' || label AS model, min(list_min(embedding))::DOUBLE AS lo, max(list_max(embedding))::DOUBLE AS hi FROM embeddings GROUP BY label)
SELECT coalesce(w.model, e.model) AS model, round(a0, 9) AS accuracy_baseline, round(a1, 9) AS accuracy_de, round(a2, 9) AS accuracy_fr, round(d1, 7) AS degradation_pts_de, round(d2, 7) AS degradation_pts_fr, lo AS min_low, hi AS max_high
FROM w FULL JOIN e ON w.model = e.model""")
def robust_wide(spark, sf_dir):
    from ..operators.latent import extremes

    vectors = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("src"), "label").alias("model"), F.array_min("embedding").cast("double").alias("low"), F.array_max("embedding").cast("double").alias("high"))
    wide = robustness.wide_summary(observations(spark, sf_dir), ["baseline", "de", "fr"], extremes(vectors, "model", low="low", high=("high",)))
    return wide.select("model", *(F.round(c, 9).alias(c) for c in wide.columns if c.startswith("acc")), *(F.round(c, 7).alias(c) for c in wide.columns if c.startswith("deg")), "min_low", "max_high")


@query("""SELECT model, round(avg(share), 9) AS consistency FROM (SELECT model, family, max(n) / sum(n) AS share FROM
(SELECT role AS model, conv_id AS family, coalesce(CAST(length(text) % 3 AS VARCHAR), 'None') AS answer, count(*)::DOUBLE AS n FROM conversations GROUP BY ALL) GROUP BY ALL) GROUP BY model""")
def consistency_by_group(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.col("role").alias("model"), F.col("conv_id").alias("family"), (F.length("text") % 3).alias("answer"))
    return robustness.consistency(rows).select("model", F.round("consistency", 9).alias("consistency"))


@query("""SELECT c_nationkey AS nation, count(*) AS customers, round(avg(c_acctbal), 6) AS balance, round(sum(n), 6) AS orders, round(avg(total), 4) AS mean_total FROM customer
LEFT JOIN (SELECT o_custkey, count(*)::DOUBLE AS n, sum(o_totalprice) AS total FROM orders GROUP BY 1) o ON o_custkey = c_custkey GROUP BY 1""")
def ext_scores_left_join(spark, sf_dir):
    scores = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").cast("double").alias("n"), F.sum("o_totalprice").alias("total"))
    rows = table(spark, sf_dir, "customer").join(scores, F.col("c_custkey") == F.col("o_custkey"), "left")
    return rows.groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("customers"), F.round(F.avg("c_acctbal"), 6).alias("balance"), F.round(F.sum("n"), 6).alias("orders"), F.round(F.avg("total"), 4).alias("mean_total"))


_CLEAN = r"trim(regexp_replace(translate(regexp_replace(coalesce(text, ''), '[\x00-\x1F\x7F-\x{9F}]', ' ', 'g'), '‘’“”', '''''' || chr(34) || chr(34)), '[\s\x{A0}]+', ' ', 'g'))"
_KEY = rf"trim(regexp_replace(regexp_replace(lower({_CLEAN}), '[^\p{{L}}\p{{M}}\p{{N}}_\s]', '', 'g'), '[\s\x{{A0}}]+', ' ', 'g'))"


@query(f"SELECT doc_id, md5({_CLEAN}) AS clean_md5, CAST(length({_CLEAN}) AS BIGINT) AS n_chars FROM documents")
def text_clean(spark, sf_dir):
    text = T.clean(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text).alias("clean_md5"), F.length(text).cast("long").alias("n_chars"))


@query(f"SELECT doc_id, md5({_KEY}) AS key_md5 FROM documents")
def dedup_key(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.dedup_key(F.col("text"))).alias("key_md5"))


@query()
def text_clean_composed(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.clean(F.col("text"))).alias("clean_md5"))


@query(r"""SELECT lang, source, min(n) AS min_words, round(avg(n), 6) AS mean_words, max(n) AS max_words FROM (SELECT lang, source,
CASE WHEN t = '' THEN 0 ELSE len(string_split(t, ' ')) END AS n FROM (SELECT lang, source, trim(regexp_replace(coalesce(text, ''), '[\s\x{A0}]+', ' ', 'g')) AS t FROM documents)) GROUP BY ALL""")
def word_stats(spark, sf_dir):
    from ..operators.curation import word_statistics

    out = word_statistics(table(spark, sf_dir, "documents"), "text", "lang", "source")
    return out.withColumn("mean_words", F.round("mean_words", 6))


_TYPED = "CASE turn % 3 WHEN 0 THEN 'numeric' WHEN 1 THEN 'mcq' ELSE 'exact' END"
_RAW = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"
_MARKED = rf"coalesce(trim(nullif(regexp_extract({_RAW}, '(?i)(?:final\s+answer|answer)\s*[:=]\s*(.+)', 1), '')), {_RAW})"
_LAST = lambda x: rf"replace(regexp_extract_all({x}, '-?\d{{1,3}}(?:,\d{{3}})+(?:\.\d+)?|-?\d+(?:\.\d+)?')[-1], ',', '')"
_LETTER = lambda x: rf"nullif(regexp_extract(upper({x}), '\b([A-D])\b', 1), '')"
_NORMAL = lambda x: rf"trim(regexp_replace(regexp_replace(lower(trim({x})), '[^\p{{L}}\p{{M}}\p{{N}}_\s]', '', 'g'), '\s+', ' ', 'g'))"
_ANSWER = rf"CASE {_TYPED} WHEN 'numeric' THEN coalesce({_LAST(_MARKED)}, {_LAST('text')}) WHEN 'mcq' THEN coalesce({_LETTER(_MARKED)}, {_LETTER('text')}) ELSE {_NORMAL(f"string_split({_MARKED}, chr(10))[1]")} END"


def _typed(spark, sf_dir):
    kind = F.when(F.col("turn") % 3 == 0, "numeric").when(F.col("turn") % 3 == 1, "mcq").otherwise("exact")
    return table(spark, sf_dir, "conversations").withColumn("kind", kind).withColumn("answer", G.extract_answer(F.col("text"), kind))


@query(f"SELECT conv_id, turn, {_TYPED} AS kind, {_ANSWER} AS answer FROM conversations")
def answer_extract(spark, sf_dir):
    return _typed(spark, sf_dir).select("conv_id", "turn", "kind", "answer")


@query(rf"""WITH a AS (SELECT conv_id, turn, {_TYPED} AS kind, {_ANSWER} AS answer FROM conversations), g AS (SELECT conv_id, {_TYPED} AS kind, max({_ANSWER}) AS gold FROM conversations GROUP BY ALL)
SELECT kind, count(*) AS n, round(avg(CASE WHEN coalesce(CASE kind WHEN 'numeric' THEN abs(TRY_CAST(trim(answer) AS DOUBLE) - TRY_CAST(trim(gold) AS DOUBLE)) < 1e-6 WHEN 'mcq' THEN upper(trim(answer)) = upper(trim(gold)) ELSE answer = gold END, false) THEN 1.0 ELSE 0.0 END), 9) AS accuracy
FROM a JOIN g USING (conv_id, kind) GROUP BY kind""")
def grade(spark, sf_dir):
    rows = _typed(spark, sf_dir)
    gold = rows.groupBy("conv_id", "kind").agg(F.max("answer").alias("gold"))
    right = G.grade(F.col("answer"), F.col("gold"), F.col("kind")).cast("double")
    return rows.join(gold, ["conv_id", "kind"]).groupBy("kind").agg(F.count("*").alias("n"), F.round(F.avg(right), 9).alias("accuracy"))


_PAIRS = "SELECT a.conv_id, a.turn, a.text AS x, b.text AS y FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1"


def _adjacent(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    after = rows.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("y"))
    return rows.select("conv_id", "turn", F.col("text").alias("x")).join(after, ["conv_id", "turn"])


def _overlap_sql(tokens: str) -> str:
    return f"""WITH p AS ({_PAIRS}), l AS (SELECT conv_id, turn, unnest({tokens.format('x')}) AS t FROM p), r AS (SELECT conv_id, turn, unnest({tokens.format('y')}) AS t FROM p),
lc AS (SELECT conv_id, turn, t, count(*) AS n FROM l GROUP BY ALL), rc AS (SELECT conv_id, turn, t, count(*) AS n FROM r GROUP BY ALL),
s AS (SELECT conv_id, turn, sum(least(lc.n, rc.n)) AS shared FROM lc JOIN rc USING (conv_id, turn, t) GROUP BY ALL)
SELECT conv_id, turn, round(CASE WHEN len({tokens.format('x')}) = 0 OR len({tokens.format('y')}) = 0 THEN 0.0 ELSE 2.0 * coalesce(shared, 0) / (len({tokens.format('x')}) + len({tokens.format('y')})) END, 9) AS f1 FROM p LEFT JOIN s USING (conv_id, turn)"""


@query(_overlap_sql("regexp_extract_all(coalesce({}, ''), '(?s).')"))
def char_f1(spark, sf_dir):
    text_batches(spark)
    return _adjacent(spark, sf_dir).select("conv_id", "turn", F.round(G.char_f1(F.col("x"), F.col("y")), 9).alias("f1"))


@query(_overlap_sql("regexp_extract_all(lower(coalesce({}, '')), '[a-z]+')"))
def rouge1(spark, sf_dir):
    return _adjacent(spark, sf_dir).select("conv_id", "turn", F.round(G.rouge1(F.col("x"), F.col("y")), 9).alias("f1"))


@query(r"SELECT conv_id, turn, regexp_extract(upper(regexp_replace(text, '\s+', '', 'g')), '^[^\p{L}]*([A-F]{0,3})', 1) AS letters FROM conversations")
def spc_parse(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", G.parse_letters(F.col("text")).alias("letters"))


@query(f"""WITH i AS (SELECT p_partkey AS item, ['alternation', 'mirror', 'progression', 'modular_increment', 'nested'][p_partkey % 5 + 1] AS rule, floor({uniform_sql('42', 'p_partkey', "'start'")} * 6)::INT AS a, floor({uniform_sql('42', 'p_partkey', "'step'")} * 2)::INT + 1 AS d FROM part),
f AS (SELECT item, rule, array_to_string(list_transform(range(0, 12), lambda k: substring('ABCDEF', (CASE rule WHEN 'alternation' THEN CASE WHEN k % 2 = 0 THEN a ELSE (a + d) % 6 END WHEN 'mirror' THEN (a + least(k, 11 - k)) % 6 WHEN 'progression' THEN (a + k // 2) % 6
WHEN 'modular_increment' THEN (a + k * d) % 6 ELSE (CASE WHEN (k // 3) % 2 = 0 THEN a ELSE (a + d) % 6 END + k % 3) % 6 END + 1)::INT, 1)), '') AS whole FROM i)
SELECT item, rule, substring(whole, 1, 9) AS sequence, substring(whole, 10, 3) AS gold FROM f""")
def spc_items(spark, sf_dir):
    return generators.letter_items(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item")))


_STATUS = r"CASE WHEN regexp_matches(upper(text), 'NOT[\s_]*AMBIGUOUS') THEN 'NOT_AMBIGUOUS' WHEN regexp_matches(upper(text), 'AMBIGUOUS') THEN 'AMBIGUOUS' END"
_CHOICE = r"coalesce(nullif(regexp_extract(upper(text), 'ANSWER\s*=\s*([AB])', 1), ''), nullif(regexp_extract(upper(text), '\b([AB])\b', 1), ''))"


@query(f"SELECT conv_id, turn, {_STATUS} AS status, {_CHOICE} AS answer FROM conversations")
def ar_parse(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", G.parse_status(F.col("text")).alias("status"), G.parse_choice(F.col("text")).alias("answer"))


@query(f"""SELECT role, count(*) AS n, round(avg(CASE WHEN coalesce({_STATUS}, 'NOT_AMBIGUOUS') = 'NOT_AMBIGUOUS' THEN 1.0 ELSE 0.0 END), 9) AS mean_status,
round(avg(CASE WHEN coalesce({_CHOICE} = 'A', false) THEN 1.0 ELSE 0.0 END), 9) AS mean_answer FROM conversations GROUP BY ROLLUP (role)""")
def ar_grade(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("role", (F.coalesce(G.parse_status(F.col("text")), F.lit("NOT_AMBIGUOUS")) == "NOT_AMBIGUOUS").cast("double").alias("status"), F.coalesce(G.parse_choice(F.col("text")) == "A", F.lit(False)).cast("double").alias("answer"))
    out = robustness.graded(rows, "role", columns=("status", "answer"))
    return out.select("role", "n", F.round("mean_status", 9).alias("mean_status"), F.round("mean_answer", 9).alias("mean_answer"))


@query(r"""SELECT doc_id, round(CASE WHEN length(l) = 0 THEN NULL ELSE length(regexp_replace(l, '[^\x{C0}-\x{24F}]', '', 'g'))::DOUBLE / length(l) END, 9) AS share,
CASE WHEN length(l) > 0 AND length(regexp_replace(l, '[^\x{C0}-\x{24F}]', '', 'g'))::DOUBLE / length(l) >= 0.02 THEN 'accented' ELSE 'plain' END AS script FROM (SELECT doc_id, regexp_replace(text, '[^\p{L}]', '', 'g') AS l FROM documents)""")
def lang_script_share(spark, sf_dir):
    accented = r"\x{00C0}-\x{024F}"
    return table(spark, sf_dir, "documents").select("doc_id", F.round(T.script_share(F.col("text"), accented), 9).alias("share"), T.script_language(F.col("text"), accented, "accented", "plain", 0.02).alias("script"))


_ROUTE = r"""CASE WHEN coalesce(text, '') = '' OR NOT regexp_matches(text, '[\p{L}\p{N}]') THEN 'invalid_input' WHEN regexp_matches(lower(text), '\bend it\b') THEN 'crisis'
WHEN regexp_matches(lower(text), '(error|alert|help)') AND NOT regexp_matches(lower(text), '\b(not|no)\b') THEN 'emergency' WHEN length(text) % 10 >= 4 THEN 'intent' ELSE 'clarification' END"""


def _routed(spark, sf_dir):
    text = F.col("text")
    flagged = F.size(T.flags(F.lower(text), {"trouble": "(error|alert|help)"}, r"\b(not|no)\b")) > 0
    route = routing.route(T.validate(text)["ok"], F.lower(text).rlike(r"\bend it\b"), flagged, F.length(text) % 10 >= 4)
    return table(spark, sf_dir, "conversations").withColumn("route", route)


@query(f"SELECT conv_id, turn, {_ROUTE} AS route FROM conversations")
def route_messages(spark, sf_dir):
    return _routed(spark, sf_dir).select("conv_id", "turn", "route")


TEMPLATES = [("intent", "user", 1, "Here is what I found."), ("intent", "neutral", 2, "Let me see."), ("clarification", "neutral", 1, "What do you mean?"), ("emergency", "assistant", 1, "Calling for help."), ("emergency", "user", 2, "Stay calm.")]


@query(f"""WITH r AS (SELECT conv_id, turn, role, {_ROUTE} AS route FROM conversations), t(intent, mood, ordinal, response) AS (VALUES {", ".join(str(x) for x in TEMPLATES)})
SELECT conv_id, turn, route, coalesce(a.response, b.response, (SELECT arg_min(response, ordinal) FROM t WHERE intent = route)) AS response FROM r LEFT JOIN t a ON a.intent = route AND a.mood = role LEFT JOIN t b ON b.intent = route AND b.mood = 'neutral'""")
def response_lookup(spark, sf_dir):
    templates = spark.createDataFrame(TEMPLATES, "intent string, mood string, ordinal int, response string")
    return routing.respond(_routed(spark, sf_dir), templates, "route", "role").select("conv_id", "turn", "route", "response")


def _perturbed(kind):
    def run(spark, sf_dir):
        from ..functions.perturb import SEVERITIES, perturb
        text_batches(spark)
        rows = table(spark, sf_dir, "documents").select("doc_id", "text", F.posexplode(F.array(*map(F.lit, SEVERITIES))).alias("level", "severity"))
        return rows.select("doc_id", "level", F.md5(perturb(F.col("text"), F.col("doc_id"), F.col("severity"), kind)).alias("text_md5"))

    run.__name__ = f"perturb_{kind}"
    return run


for _kind in ("char_noise", "word_dropout", "word_shuffle", "homoglyph", "append_gibberish"):
    query()(_perturbed(_kind))
