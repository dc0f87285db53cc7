"""Whole runs: curation with an audit, cleaning with a report, out-of-fold checks, replies."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import curation as C
from . import routing
from .checkpoints import saved, stored
from .dealing import text_batches
from .similar_texts import similar_texts


def curated(rows: DataFrame, corrections: DataFrame, most: int, seed: int = 42, near: float = 0.9) -> tuple[DataFrame, DataFrame]:
    """Texts (ord, text, label, source) corrected, deduplicated, freed of near-duplicates and capped, and the audit: step, rows.

    The first row of a key stays; conflicts are in the audit. Of two texts
    with a cosine of ``near`` or more over character grams the later or
    non-original goes. Originals are never capped away.
    """
    text_batches(rows.sparkSession)
    fixed = C.corrected(T.with_dedup_key(rows, "text"), corrections, "key", "label").withColumn("key", F.md5("key"))
    marks = saved(fixed.select("ord", "key", "label", "source"))
    # where a place names one row, texts are only read where they are compared or given out
    once = not marks.groupBy("ord").count().filter("count > 1 or ord is null").head(1)
    first = stored(C.keep_first(marks if once else fixed, ["key"], "ord"))
    own = F.col("source") == "original"
    texts = rows.select("ord", "text").join(first.select("ord"), "ord", "left_semi") if once else first
    pairs = similar_texts(texts, "ord", "text", near)
    apart = saved(first.join(C.greedy_victims(pairs, "ord", first.select("ord", own.alias("is_original"))), "ord", "left_anti"))
    last = C.capped(apart, "label", most, "ord", own, seed)
    count = lambda name, df: df.agg(F.lit(name).alias("step"), F.count("*").alias("rows"))
    steps = [count("read", rows), count("conflicts", C.conflict_log(marks, "key", "label", "ord")), count("first_of_key", first), count("near_duplicates", apart), count("capped", last)]
    audit = steps[0]
    for step in steps[1:]:
        audit = audit.unionByName(step)
    whole = last.join(rows.select("ord", "text"), "ord") if once else last
    return whole.select("ord", "text", "label", "source"), audit


def cleaned(rows: DataFrame, allowed: list[str], order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Texts (text, label) with blanks, unknown labels, all rows of conflicting keys and later duplicates dropped, and the report: check, n.

    The first row of a key by ``order`` stays, with its place as ``kept``;
    without an order, the one of the least hash.
    """
    rows = rows.withColumn("ord", F.col(order) if order else F.xxhash64("text", "label"))
    there = (F.coalesce(F.trim("text"), F.lit("")) != "") & F.col("label").isNotNull()
    named = there & F.col("label").isin(allowed)
    known = rows.filter(named).select("text", "label", "ord", F.md5(T.dedup_key(F.col("text"))).alias("key"))
    # what is counted are hashes, read from the texts once; only the rows that stay bring their texts
    agreed = C.without_conflicts(saved(known.select("key", "label", "ord")), "key", "label")
    first = saved(agreed.groupBy("key").agg(F.first("label").alias("label"), F.min("ord").alias("ord")))
    own = first.select(F.col("key").alias("_key"), F.col("ord").alias("_ord"), F.col("label").alias("_label"))
    found = known.join(own, (F.col("key") == F.col("_key")) & F.col("ord").eqNullSafe(F.col("_ord")))
    last = found.groupBy("_key", "_ord").agg(F.first("text").alias("text"), F.first("_label").alias("label"), F.first("ord").alias("kept"))
    sizes = rows.agg(F.count("*").alias("read"), F.count_if(there).alias("with_values"), F.count_if(named).alias("known_label"))
    line = lambda df, *names: df.select(F.inline(F.array(*(F.struct(F.lit(x).alias("check"), F.col(x).alias("n")) for x in names))))
    report = line(sizes, "read", "with_values", "known_label")
    for name, df in (("without_conflicts", agreed), ("kept", first)):
        report = report.unionByName(line(df.agg(F.count("*").alias(name)), name))
    return last.select("text", "label", *(["kept"] if order else [])), report


def cleaned_in_full(rows: DataFrame, allowed: list[str], order: str, fractions: list[tuple[str, float]], seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """``cleaned`` rows (text, label, ord, split) with a side for each, and the whole report: section, name, value.

    Sections: ``check`` (rows left by each step), ``class`` (rows), ``ratio``
    (of the largest class to the smallest) and ``weight`` of each class,
    ``words`` (least, mean, most), ``split`` (rows) and ``shared`` (keys that
    two sides have in common; a clean split has none).
    """
    texts, checks = cleaned(rows, allowed, order)
    kept = saved(C.split_exact(texts.withColumnRenamed("kept", "ord"), "ord", "label", fractions, seed))
    balance = C.class_balance(kept, "label")
    words = C.word_statistics(kept, "text")
    overlap = C.split_overlap(kept.select(F.md5(T.dedup_key(F.col("text"))).alias("_key"), "split"), "_key", "split")
    line = lambda df, section, name, value: df.select(F.lit(section).alias("section"), name.cast("string").alias("name"), value.cast("double").alias("value"))
    parts = [
        line(checks, "check", F.col("check"), F.col("n")),
        line(balance, "class", F.col("label"), F.col("n")),
        line(balance.limit(1), "ratio", F.lit("largest to smallest"), F.col("ratio")),
        line(balance, "weight", F.col("label"), F.col("weight")),
        words.select(F.lit("words").alias("section"), F.inline(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in ("min_words", "mean_words", "max_words"))))),
        line(kept.groupBy("split").count(), "split", F.col("split"), F.col("count")),
        line(overlap, "shared", F.concat_ws(" ", "a", "b"), F.col("shared")),
    ]
    report = parts[0]
    for part in parts[1:]:
        report = report.unionByName(part)
    return kept, report


def out_of_fold(rows: DataFrame, text: str, label: str, item: str, folds: int = 5, least: float = 0.5, seed: int = 42) -> DataFrame:
    """item, label, predicted, confidence of rows that a classifier fitted on the other folds labels otherwise, with confidence.

    One fit for each fold; the folds are classes' shares in a hash order.
    """
    from pyspark.ml.functions import vector_to_array

    from .classify import fit_text_classifier

    names = [str(k) for k in range(folds)]
    split = C.split_exact(rows, item, label, [(k, 1 / folds) for k in names], seed)
    out = None
    for name in names:
        model = fit_text_classifier(split.filter(F.col("split") != name), text, label)
        labels = F.array(*map(F.lit, model.stages[0].labels))
        scored = model.transform(split.filter(F.col("split") == name)).withColumn("p", vector_to_array("probability"))
        found = scored.select(item, label, F.try_element_at(labels, (F.col("prediction") + 1).cast("int")).alias("predicted"), F.array_max("p").alias("confidence"))
        out = found if out is None else out.unionByName(found)
    return out.filter((F.col("predicted") != F.col(label)) & (F.col("confidence") >= least))


def replies(messages: DataFrame, labels: list[str], templates: DataFrame, crisis: str, emergency: dict[str, str], veto: str, threshold: float, emergency_threshold: float) -> DataFrame:
    """Messages (id, text, mood, p: probabilities by label) with their route, intent and response."""
    text = F.lower(F.col("text"))
    urgent = F.element_at("p", labels.index("emergency") + 1) if "emergency" in labels else F.lit(0.0)
    flagged = F.size(T.flags(text, emergency, veto)) > 0
    rows = routing.batch_predictions(messages, "p", labels, threshold)
    route = routing.route(T.validate(F.col("text"))["ok"], text.rlike(crisis), (urgent >= emergency_threshold) | flagged, F.col("intent").isNotNull())
    rows = rows.withColumn("route", route).withColumn("name", F.when(F.col("route") == "intent", F.col("intent")).otherwise(F.col("route")))
    return routing.respond(rows, templates, "name", "mood").select("id", "route", "intent", "confidence", "response")


def helpdesk(messages: DataFrame, text: str, predict: Column, mood: Column, templates: DataFrame, urgent: str, keywords: list[str], least: float, to_english: Callable | None = None, from_english: Callable | None = None, language: str | None = None) -> DataFrame:
    """``messages`` answered by the second pipeline: normalised, brought into English, classified, overridden, answered, brought back.

    New columns: language (the one that the column ``language`` names, where it
    is not null, else by script), english, intent, confidence, mood,
    safety_override, status and response. ``predict`` and ``mood`` read the
    column ``english``: a struct of intent and confidence, and a name.
    ``to_english`` and ``from_english`` are functions from two pandas series,
    texts and languages, to one; without them texts stay as they are. Only
    texts in another language go to them. A blank text has no answer, and a
    weak intent that of ``fallback`` in ``templates`` (intent, mood, ordinal,
    response).
    """
    rows = messages.withColumn("_text", T.clean(F.col(text)))
    given = F.col(language) if language else F.lit(None).cast("string")
    rows = rows.withColumn("language", F.coalesce(given, T.script_language(F.col("_text"))))
    rows = rows.withColumn("english", _elsewhere(to_english, F.col("_text"), F.col("language")))
    rows = saved(rows.withColumn("_p", predict).withColumn("mood", mood))
    rows = rows.withColumn("intent", F.col("_p.intent")).withColumn("confidence", F.col("_p.confidence")).drop("_p")
    rows = routing.overridden(rows, "english", urgent, keywords, least)
    rows = rows.withColumn("_name", F.when(F.col("status") == "low_confidence", "fallback").when(F.col("status") != "empty", F.col("intent")))
    answered = routing.respond(rows, templates, "_name", "mood")
    return answered.withColumn("response", _elsewhere(from_english, F.col("response"), F.col("language"))).drop("_text", "_name")


def _elsewhere(hook: Callable | None, text: Column, language: Column) -> Column:
    """What the hook makes of texts that aren't English; others, blank and null ones never reach it."""
    if hook is None:
        return text
    foreign = (language != "en") & (text != "")
    changed = F.pandas_udf(hook, "string")(F.when(foreign, text), language)
    return F.when(foreign, changed).otherwise(text)
