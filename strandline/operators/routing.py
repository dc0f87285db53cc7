"""Rule routing of messages and lookup of responses."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def batch_predictions(rows: DataFrame, probabilities: str, labels: list[str], threshold: float) -> DataFrame:
    """intent (null below the threshold), confidence, status and the three best labels, from a probability array."""
    from ..functions.vectors import top_k

    names = F.array(*map(F.lit, labels))
    best = F.transform(top_k(F.col(probabilities), 3), lambda x: F.struct(F.element_at(names, x["label"] + 1).alias("label"), x["p"].alias("p")))
    first = F.try_element_at(best, F.lit(1))
    sure = first["p"] >= threshold
    return rows.withColumns({"intent": F.when(sure, first["label"]), "confidence": first["p"], "status": F.when(sure, "accepted").otherwise("low_confidence"), "top": best})


def route(valid: Column, crisis: Column, emergency: Column, confident: Column) -> Column:
    """The first that holds: invalid input, crisis, emergency, a confident intent; else clarification."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return F.when(~yes(valid), "invalid_input").when(yes(crisis), "crisis").when(yes(emergency), "emergency").when(yes(confident), "intent").otherwise("clarification")


def clarification(top: Column, social: list[str]) -> Column:
    """The two best labels that aren't small talk, joined to a question's choices."""
    from ..functions.text import title

    named = F.filter(F.transform(top, lambda x: x["label"]), lambda x: ~x.isin(social))
    return F.array_join(F.transform(F.slice(named, 1, 2), title), " or ")


def respond(rows: DataFrame, templates: DataFrame, intent: str, mood: str, neutral: str = "neutral") -> DataFrame:
    """The template of the intent and mood, else of the neutral mood, else the intent's first. templates: intent, mood, ordinal, response.

    One small aggregate of the templates gives each intent a map, so a message
    meets one row.
    """
    table = templates.groupBy(F.col("intent").alias("_i")).agg(F.map_from_entries(F.collect_list(F.struct("mood", "response"))).alias("_by"), F.min_by("response", "ordinal").alias("_first"))
    chosen = F.coalesce(F.try_element_at("_by", F.col(mood)), F.try_element_at("_by", F.lit(neutral)), F.col("_first"))
    return rows.join(table, rows[intent] == table["_i"], "left").withColumn("response", chosen).drop("_i", "_by", "_first")


def grouped_mood(scores: DataFrame, groups: DataFrame, item: str, how: str = "max", neutral: str = "neutral", override: float = 0.25, least: float = 0.10) -> DataFrame:
    """Label scores (item, label, score) to one mood group (label, group, place) for each item.

    Groups take the greatest or summed score (1 at most). Neutral gives way to
    another group that reaches ``override``; below ``least`` it is neutral.
    Ties go to the group that comes first.
    """
    named = scores.join(groups, "label").groupBy(item, "group").agg((F.max("score") if how == "max" else F.least(F.sum("score"), F.lit(1.0))).alias("score"), F.min("place").alias("place"))
    order = Window.partitionBy(item).orderBy(F.desc("score"), "place")
    others = Window.partitionBy(item).orderBy((F.col("group") == neutral), F.desc("score"), "place")
    marked = named.withColumn("k", F.row_number().over(order)).withColumn("o", F.row_number().over(others))
    top = F.max_by("group", F.when(F.col("k") == 1, 1).otherwise(0))
    top_score = F.max("score")
    other = F.max_by("group", F.when((F.col("o") == 1) & (F.col("group") != neutral), 1).otherwise(0))
    other_score = F.max(F.when(F.col("group") != neutral, F.col("score")))
    mood = F.when(top_score < least, neutral).when((top == neutral) & (other_score >= override), other).otherwise(top)
    return marked.groupBy(item).agg(mood.alias("mood"), F.when((top_score >= least) & (top == neutral) & (other_score >= override), other_score).otherwise(top_score).alias("score"))


def template_errors(templates: DataFrame, intents: list[str], moods: list[str]) -> DataFrame:
    """check, intent, mood of cells that are missing or blank, and of texts that several cells share."""
    spark = templates.sparkSession
    grid = spark.createDataFrame([(i, m) for i in intents for m in moods], "intent string, mood string")
    usable = templates.filter(F.trim("response") != "")
    missing = grid.join(usable, ["intent", "mood"], "left_anti").select(F.lit("missing").alias("check"), "intent", "mood")
    shared = usable.groupBy("response").agg(F.count("*").alias("n"), F.collect_list(F.struct("intent", "mood")).alias("cells")).filter("n > 1").select(F.lit("reused").alias("check"), F.inline("cells"))
    return missing.unionByName(shared)


def has_keyword(text: Column, keywords: list[str]) -> Column:
    """Whether the cleaned, lower-cased text holds any of the keywords, as substrings; a null text holds none."""
    from ..functions.text import clean

    # as the element of an array the text is cleaned once and not once for each keyword
    found = F.transform(F.array(F.lower(clean(text))), lambda x: reduce(or_, (F.contains(x, F.lit(k)) for k in keywords), F.lit(False)))
    return F.get(found, F.lit(0))


def single_mood(scores: Column, labels: list[str], least: float = 0.5, neutral: str = "neutral") -> Column:
    """struct(mood, confidence, status, raw): the label of the greatest score, neutral below ``least``; ties to the first."""
    best = F.array_max(scores)
    raw = F.element_at(F.array(*map(F.lit, labels)), F.array_position(scores, best).cast("int"))
    sure = best >= least
    return F.struct(F.when(sure, raw).otherwise(neutral).alias("mood"), F.round(best, 4).alias("confidence"), F.when(sure, "confident").otherwise("fallback_neutral").alias("status"), raw.alias("raw"))


def response_matrix(intents: DataFrame, moods: DataFrame, urgent: str, social: list[str]) -> DataFrame:
    """intent, mood, response: opener and body, trimmed.

    ``intents``: intent, body. ``moods``: mood, opener, social_opener,
    urgent_opener. A grid of two bounded lists.
    """
    grid = intents.crossJoin(moods)
    opener = F.when(F.col("intent") == urgent, F.col("urgent_opener")).when(F.col("intent").isin(social), F.col("social_opener")).otherwise(F.col("opener"))
    return grid.select("intent", "mood", F.trim(F.concat_ws(" ", F.nullif(opener, F.lit("")), "body")).alias("response"))


def overridden(rows: DataFrame, text: str, urgent: str, keywords: list[str], least: float) -> DataFrame:
    """The second pipeline after the models have spoken: keywords override the intent, a weak intent falls back.

    ``rows``: the text, intent, confidence. A blank text gives no answer
    (status ``empty``). New: safety_override, and status ``override``,
    ``answered`` or ``low_confidence``.
    """
    from ..functions.text import clean

    blank = clean(F.col(text)) == ""
    override = ~blank & has_keyword(F.col(text), keywords) & (F.coalesce(F.col("intent"), F.lit("")) != urgent)
    weak = F.coalesce(F.col("confidence"), F.lit(0.0)) < least
    status = F.when(blank, "empty").when(F.col("safety_override"), "override").when(weak, "low_confidence").otherwise("answered")
    marked = rows.withColumn("safety_override", override)
    marked = marked.withColumn("intent", F.when(F.col("safety_override"), urgent).otherwise(F.col("intent"))).withColumn("confidence", F.when(F.col("safety_override"), 1.0).otherwise(F.col("confidence")))
    return marked.withColumn("status", status)
