"""Duplicates, similarity joins, splits and contracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.prng import uniform_sql
from ..operators import curation as C
from ..operators.checkpoints import saved, stored
from ..operators.dealing import text_batches
from ..operators.nearest_texts import nearest_texts
from ..operators.similar_texts import similar_texts
from .registry import query, table
from .robust import _KEY


def keyed(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", F.md5(T.dedup_key(F.col("text"))).alias("key"))


def labelled(spark, sf_dir):
    """Documents that have a quality label, which is what is looked at."""
    return keyed(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id")


_ALL = f"d AS (SELECT doc_id, text, lang, source, md5({_KEY}) AS key FROM documents)"
_LAB = f"d AS (SELECT doc_id, text, lang, source, md5({_KEY}) AS key, quality FROM documents JOIN labels USING (doc_id))"


@query("SELECT md5(text) AS key, count(*) AS size, min(doc_id) AS first FROM documents GROUP BY text HAVING count(*) > 1")
def exact_dups(spark, sf_dir):
    return C.exact_groups(table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("key")), "key", "doc_id")


@query(f"SELECT min(doc_id) AS doc_id FROM documents GROUP BY md5({_KEY})")
def keep_first(spark, sf_dir):
    return C.keep_first(saved(keyed(spark, sf_dir).select("doc_id", "key")), ["key"], "doc_id").select("doc_id")


@query(f"WITH {_ALL} SELECT key, count(*) AS n FROM d GROUP BY key HAVING count(DISTINCT source) > 1")
def label_conflicts(spark, sf_dir):
    return C.conflicting_keys(keyed(spark, sf_dir), "key", "source")


@query(f"WITH {_ALL}, f AS (SELECT key, arg_min(source, doc_id) AS kept_label, min(doc_id) AS kept FROM d GROUP BY key) SELECT doc_id, key, source, kept, kept_label FROM d JOIN f USING (key) WHERE source <> kept_label")
def conflict_log(spark, sf_dir):
    return C.conflict_log(saved(keyed(spark, sf_dir).select("doc_id", "key", "source")), "key", "source", "doc_id")


@query(f"""WITH {_LAB}, bad AS (SELECT key FROM d GROUP BY key HAVING count(DISTINCT quality) > 1), g AS (SELECT key, count(*) AS n, count(DISTINCT (text, quality)) AS forms FROM d WHERE key NOT IN (FROM bad) GROUP BY key)
SELECT (SELECT count(*) FROM d WHERE key IN (FROM bad)) AS conflicts, CAST(coalesce(sum(n - forms), 0) AS BIGINT) AS exact, CAST(coalesce(sum(forms - 1), 0) AS BIGINT) AS near, count(*) AS kept FROM g""")
def dup_accounting(spark, sf_dir):
    # texts only count as equal or not, so their hashes do
    rows = saved(labelled(spark, sf_dir).select(F.md5("text").alias("text"), "quality", "key"))
    return C.duplicate_accounting(rows, "text", "quality", "key")


_WORDS = lambda c: f"regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}]+')"
_NORM = "w AS (SELECT id, term, (1 + ln(tf)) * (ln((1.0 + n) / (1 + df)) + 1) AS w FROM tf JOIN df USING (term), (SELECT count(*) AS n FROM docs)), v AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM w)"
_NEAR = f"""docs AS (SELECT item_id AS id, text FROM benchmark), t AS (SELECT id, unnest({_WORDS('text')}) AS term FROM docs), tf AS (SELECT id, term, count(*) AS tf FROM t GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), {_NORM},
pairs AS (SELECT x.id AS a, y.id AS b, sum(x.w * y.w) AS s FROM v x JOIN v y ON x.term = y.term AND x.id < y.id GROUP BY ALL)"""


def _benchmark_weights(spark, sf_dir):
    return C.tfidf(table(spark, sf_dir, "benchmark"), "item_id", C.words(F.col("text")))


@query(f"WITH {_NEAR} SELECT a, b, round(s, 8) AS similarity FROM pairs WHERE s >= 0.2")
def similar_benchmark_items(spark, sf_dir):
    return C.similar_pairs(_benchmark_weights(spark, sf_dir), "item_id", 0.2).withColumn("similarity", F.round("similarity", 8))


def _keys(spark, sf_dir):
    """doc_id and key of all documents, found once."""
    text_batches(spark)
    return stored(T.with_dedup_key(table(spark, sf_dir, "documents").select("doc_id", "text"), "text").select("doc_id", F.md5("key").alias("key")))


def _forms(spark, sf_dir, keys):
    """Of each text that differs by more than its form the first document."""
    if keys.groupBy("doc_id").count().filter("count > 1 or doc_id is null").head(1):
        return keyed(spark, sf_dir).groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.min_by(F.coalesce("text", F.lit("")), "doc_id").alias("text"))
    first = keys.groupBy("key").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", "text").join(first, "doc_id", "left_semi")


def _near(spark, sf_dir, keys):
    return similar_texts(_forms(spark, sf_dir, keys), "doc_id", "text", 0.90)


def _edges(spark, sf_dir):
    """Near-duplicates, and each other document of a form with its first."""
    keys = _keys(spark, sf_dir)
    copies = keys.join(keys.groupBy("key").agg(F.min("doc_id").alias("a")), "key").filter("doc_id > a").select("a", F.col("doc_id").alias("b"), F.lit(1.0).alias("similarity"))
    return _near(spark, sf_dir, keys).unionByName(copies)


def _gram_sql(n):
    each = f"list_transform(range(1, greatest(length(w) - {n - 1}, 1) + 1), lambda i: substring(w, i, {n}))"
    return each if n == 3 else f"CASE WHEN length(w) >= {n} THEN {each} ELSE [] END"


_GRAMS = f"""k AS (SELECT doc_id, coalesce(text, '') AS text, {_KEY} AS key FROM documents), docs AS (SELECT min(doc_id) AS id, arg_min(text, doc_id) AS text FROM k GROUP BY key),
v0 AS (SELECT id, list_transform(list_filter(string_split(trim(regexp_replace(lower(text), '[\\s\\x{{A0}}]+', ' ', 'g')), ' '), lambda w: w <> ''), lambda w: ' ' || w || ' ') AS words FROM docs),
t AS (SELECT id, unnest(flatten(list_transform(words, lambda w: flatten([{', '.join(_gram_sql(n) for n in (3, 4, 5))}])))) AS term FROM v0),
tf AS (SELECT id, term, count(*) AS tf FROM t GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), {_NORM}, g AS (SELECT v.id, term, v.w FROM v JOIN df USING (term) WHERE df > 1),
near AS (SELECT x.id AS a, y.id AS b, sum(x.w * y.w) AS s FROM g x JOIN g y ON x.term = y.term AND x.id < y.id GROUP BY ALL HAVING sum(x.w * y.w) >= 0.9 - 1e-12)"""


@query(f"WITH {_GRAMS} SELECT a, b, round(s, 8) AS similarity FROM near")
def near_dups(spark, sf_dir):
    return _near(spark, sf_dir, _keys(spark, sf_dir)).withColumn("similarity", F.round("similarity", 8))


@query(f"""WITH RECURSIVE {_GRAMS}, f AS (SELECT key, min(doc_id) AS first FROM k GROUP BY key), o AS (SELECT a, b FROM near UNION ALL SELECT first, doc_id FROM k JOIN f USING (key) WHERE doc_id > first),
e AS (SELECT a, b FROM o UNION SELECT b, a FROM o), r(node, seen) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen)
SELECT node AS doc_id, min(seen) AS component FROM r GROUP BY node""")
def dup_components(spark, sf_dir):
    return C.components(table(spark, sf_dir, "documents").select("doc_id"), _edges(spark, sf_dir), "doc_id")


@query()
def near_dup_victims(spark, sf_dir):
    nodes = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 2 == 0).alias("is_original"))
    return C.greedy_victims(_edges(spark, sf_dir), "doc_id", nodes)


_LEAK = f"""docs AS (SELECT doc_id AS id, text FROM documents), t AS (SELECT id, unnest({_WORDS('text')}) AS term FROM docs), tf AS (SELECT id, term, count(*) AS tf FROM t GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), {_NORM},
qt AS (SELECT item_id AS id, unnest({_WORDS('text')}) AS term FROM benchmark), qf AS (SELECT id, term, count(*) AS tf FROM qt GROUP BY ALL), qw AS (SELECT id, term, (1 + ln(tf)) * (ln((1.0 + n) / (1 + df)) + 1) AS w FROM qf JOIN df USING (term), (SELECT count(*) AS n FROM docs)),
q AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM qw), s AS (SELECT q.id AS q, v.id AS d, sum(q.w * v.w) AS s FROM q JOIN v USING (term) GROUP BY ALL)"""


@query(f"WITH {_LEAK} SELECT item_id, round(coalesce(max(s), 0), 8) AS max_any, round(coalesce(max(CASE WHEN d % 4 = item_id % 4 THEN s END), 0), 8) AS max_same FROM benchmark LEFT JOIN s ON q = item_id GROUP BY item_id")
def leakage_report(spark, sf_dir):
    label = lambda rows, item: rows.select(item, "text", (F.col(item) % 4).alias("label"))
    docs, items = label(table(spark, sf_dir, "documents"), "doc_id"), label(table(spark, sf_dir, "benchmark"), "item_id")
    out = nearest_texts(items, "item_id", "label", docs, "doc_id", "label", "text", C.words(F.col("text")))
    return out.select("item_id", F.round("max_any", 8).alias("max_any"), F.round("max_same", 8).alias("max_same"))


_ORDER = uniform_sql("42", "doc_id")


@query(f"""WITH k AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {_ORDER}, doc_id) AS k, count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT doc_id, lang, CASE WHEN k <= round_even(n * 0.7, 0) THEN 'train' WHEN k <= round_even(n * (0.7 + 0.15), 0) THEN 'validation' ELSE 'test' END AS split FROM k""")
def stratified_split(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return C.split_exact(rows, "doc_id", "lang", [("train", 0.7), ("validation", 0.15), ("test", 0.15)])


@query(f"""WITH g AS (SELECT DISTINCT source FROM documents), k AS (SELECT source, row_number() OVER (ORDER BY {uniform_sql('42', 'source')}, source) AS k, count(*) OVER () AS n FROM g)
SELECT doc_id, source, CASE WHEN k <= round_even(n * 0.4, 0) THEN 'train' WHEN k <= round_even(n * (0.4 + 0.3), 0) THEN 'validation' ELSE 'test' END AS split FROM documents JOIN k USING (source)""")
def group_split(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "source")
    return C.split_groups(rows, "source", [("train", 0.4), ("validation", 0.3), ("test", 0.3)]).select("doc_id", "source", "split")


@query(f"SELECT item_id, CASE WHEN row_number() OVER (ORDER BY {uniform_sql('42', 'item_id')}, item_id) <= round_even(count(*) OVER () * 0.5, 0) THEN 'validation' ELSE 'test' END AS split FROM benchmark")
def ood_split(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.lit(1).alias("all"))
    return C.split_exact(rows, "item_id", "all", [("validation", 0.5), ("test", 0.5)]).select("item_id", "split")


@query(f"""WITH k AS (SELECT doc_id, lang, quality, row_number() OVER (PARTITION BY lang ORDER BY quality DESC, {_ORDER}, doc_id) AS k FROM documents JOIN labels USING (doc_id)) SELECT doc_id, lang FROM k WHERE k <= 60 OR quality = 1""")
def cap_per_group(spark, sf_dir):
    rows = labelled(spark, sf_dir).select("doc_id", "lang", "quality")
    return C.capped(rows, "lang", 60, "doc_id", F.col("quality") == 1).select("doc_id", "lang")


@query()
def leakage_safe_split(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return C.leakage_safe_split(C.linked_within(rows, "text", "lang", "doc_id", 0.75), "component", "lang", "doc_id").select("doc_id", "split")


@query(f"""WITH k AS (SELECT md5(text) AS key, row_number() OVER (PARTITION BY lang ORDER BY {_ORDER}, doc_id) AS k, count(*) OVER (PARTITION BY lang) AS n FROM documents),
s AS (SELECT DISTINCT key, CASE WHEN k <= round_even(n * 0.7, 0) THEN 'train' WHEN k <= round_even(n * (0.7 + 0.15), 0) THEN 'validation' ELSE 'test' END AS split FROM k)
SELECT x.split AS a, y.split AS b, count(*) AS shared FROM s x JOIN s y ON x.key = y.key AND x.split < y.split GROUP BY ALL""")
def split_overlap(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", F.md5("text").alias("key"))
    return C.split_overlap(C.split_exact(rows, "doc_id", "lang", [("train", 0.7), ("validation", 0.15), ("test", 0.15)]), "key", "split")


@query("SELECT lang, n, round(max(n) OVER () / min(n) OVER (), 8) AS ratio, round(CASE WHEN max(n) OVER () / min(n) OVER () > 1.5 THEN sum(n) OVER () / (count(*) OVER () * n) ELSE 1.0 END, 8) AS weight FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang)")
def class_balance(spark, sf_dir):
    return C.class_balance(table(spark, sf_dir, "documents"), "lang").select("lang", "n", F.round("ratio", 8).alias("ratio"), F.round("weight", 8).alias("weight"))


@query(f"""WITH c AS (SELECT lang AS label, count(*) AS n FROM documents GROUP BY 1), a(label) AS (VALUES ('en'), ('de'), ('fr'), ('it'))
SELECT 'unknown_label' AS "check", label, n FROM c WHERE label NOT IN (FROM a) UNION ALL SELECT 'missing_label', label, 0 FROM a WHERE label NOT IN (SELECT label FROM c)
UNION ALL SELECT 'too_few', label, n FROM c WHERE label IN (FROM a) AND n < 140 UNION ALL SELECT 'too_many', label, n FROM c WHERE label IN (FROM a) AND n > 200
UNION ALL SELECT 'empty', NULL, count(*) FROM documents WHERE trim(coalesce(text, '')) = '' HAVING count(*) > 0
UNION ALL SELECT 'duplicate', NULL, CAST(sum(c - 1) AS BIGINT) FROM (SELECT count(*) AS c FROM documents GROUP BY {_KEY} HAVING count(*) > 1) HAVING sum(c - 1) > 0""")
def dataset_contract(spark, sf_dir):
    return C.contract_errors(table(spark, sf_dir, "documents"), "text", "lang", ["en", "de", "fr", "it"], 140, 200)


@query("SELECT unnest(['text', 'url', 'html']) AS \"column\", unnest([(SELECT count(*) FROM documents WHERE trim(coalesce(text, '')) = ''), (SELECT count(*) FROM pages WHERE trim(coalesce(url, '')) = ''), (SELECT count(*) FROM pages WHERE trim(coalesce(html, '')) = '')]) AS missing")
def missing_values(spark, sf_dir):
    return C.missing_counts(table(spark, sf_dir, "documents"), "text").unionByName(C.missing_counts(table(spark, sf_dir, "pages"), "url", "html"))


@query("SELECT doc_id, CASE WHEN lang = 'es' AND doc_id % 7 = 0 THEN 'pt' ELSE lang END AS lang FROM documents")
def corrected_labels(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", (F.col("doc_id") % 7).cast("int").alias("rest"))
    fixes = spark.createDataFrame([(0, "es", "pt")], "rest int, old string, new string")
    return C.corrected(rows, fixes, "rest", "lang").select("doc_id", "lang")


@query(f"SELECT doc_id FROM documents ORDER BY {uniform_sql('7', 'doc_id')}, doc_id LIMIT 100")
def hash_sample(spark, sf_dir):
    return C.hash_sample(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 100, 7)


@query()
def curation_audit(spark, sf_dir):
    from ..operators.pipelines import curated

    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), "text", F.col("lang").alias("label"), F.when(F.col("doc_id") % 4 == 0, "original").otherwise("expansion").alias("source"))
    return curated(rows, spark.createDataFrame([], "key string, old string, new string"), 100)[1]


@query(f"""WITH r AS (SELECT text, CAST(quality AS VARCHAR) AS label, {_KEY} AS key FROM documents JOIN labels USING (doc_id)), t AS (FROM r WHERE trim(coalesce(text, '')) <> '' AND label IS NOT NULL),
c AS (SELECT key FROM t GROUP BY key HAVING count(DISTINCT label) > 1), a AS (FROM t WHERE key NOT IN (FROM c))
SELECT 'read' AS "check", count(*) AS n FROM r UNION ALL SELECT 'with_values', count(*) FROM t UNION ALL SELECT 'known_label', count(*) FROM t UNION ALL SELECT 'without_conflicts', count(*) FROM a UNION ALL SELECT 'kept', count(DISTINCT key) FROM a""")
def cleaning_report(spark, sf_dir):
    from ..operators.pipelines import cleaned

    return cleaned(labelled(spark, sf_dir).select("doc_id", "text", F.col("quality").cast("string").alias("label")), ["0", "1"], "doc_id")[1]


_FULL = f"""r AS (SELECT doc_id, text, CAST(quality AS VARCHAR) AS label, {_KEY} AS key FROM documents JOIN labels USING (doc_id)), t AS (FROM r WHERE trim(coalesce(text, '')) <> '' AND label IS NOT NULL),
c AS (SELECT key FROM t GROUP BY key HAVING count(DISTINCT label) > 1), a AS (FROM t WHERE key NOT IN (FROM c)), x AS (SELECT min(doc_id) AS doc_id, arg_min(text, doc_id) AS text, min(label) AS label FROM a GROUP BY key),
o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {_ORDER}, doc_id) AS k, count(*) OVER (PARTITION BY label) AS n FROM x),
s AS (SELECT *, CASE WHEN k <= round_even(n * 0.7, 0) THEN 'train' WHEN k <= round_even(n * (0.7 + 0.15), 0) THEN 'validation' ELSE 'test' END AS split, len(string_split(trim(regexp_replace(text, '[\\s\\x{{A0}}]+', ' ', 'g')), ' ')) AS w FROM o),
b AS (SELECT label, count(*) AS n FROM s GROUP BY label), m AS (SELECT *, max(n) OVER () / min(n) OVER () AS ratio, sum(n) OVER () / (count(*) OVER () * n) AS weight FROM b)"""


@query(f"""WITH {_FULL} SELECT 'check' AS section, 'read' AS name, count(*)::DOUBLE AS value FROM r UNION ALL SELECT 'check', 'with_values', count(*) FROM t UNION ALL SELECT 'check', 'known_label', count(*) FROM t UNION ALL SELECT 'check', 'without_conflicts', count(*) FROM a UNION ALL SELECT 'check', 'kept', count(*) FROM x
UNION ALL SELECT 'class', label, n FROM m UNION ALL SELECT DISTINCT 'ratio', 'largest to smallest', round(ratio, 8) FROM m UNION ALL SELECT 'weight', label, round(CASE WHEN ratio > 1.5 THEN weight ELSE 1 END, 8) FROM m
UNION ALL SELECT 'words', 'min_words', min(w) FROM s UNION ALL SELECT 'words', 'mean_words', round(avg(w), 8) FROM s UNION ALL SELECT 'words', 'max_words', max(w) FROM s UNION ALL SELECT 'split', split, count(*) FROM s GROUP BY split""")
def cleaning_in_full(spark, sf_dir):
    from ..operators.pipelines import cleaned_in_full

    rows = labelled(spark, sf_dir).select("doc_id", "text", F.col("quality").cast("string").alias("label"))
    report = cleaned_in_full(rows, ["0", "1"], "doc_id", [("train", 0.7), ("validation", 0.15), ("test", 0.15)])[1]
    return report.withColumn("value", F.round("value", 8))
