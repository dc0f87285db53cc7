"""The text classifier's work: how often texts are cut, and what moves when tables score them."""

import re

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from strandline.operators.classify import fit_text_classifier
from strandline.sources import sinks

DATA = [(1, "red red blue", "a"), (2, "blue sky, blue sea", "b"), (3, "red", "a"), (4, "", "b"), (5, "sea sky red", "b"), (6, "red blue red blue", "a"), (7, "...", "a")]


def test_texts_are_cut_twice(spark):
    """For the vocabulary and for the counts; idf and regression read the counts."""
    seen = spark.sparkContext.accumulator(0)

    def said(x):
        seen.add(1)
        return x

    rows = spark.createDataFrame(DATA, "id long, text string, label string").withColumn("text", F.udf(said, "string").asNondeterministic()("text"))
    fit_text_classifier(rows, "text", "label")
    assert 0 < seen.value <= 2 * len(DATA)


def test_tables_score_without_moving_terms(spark, tmp_path):
    rows = spark.createDataFrame(DATA, "id long, text string, label string")
    model = fit_text_classifier(rows, "text", "label")
    sinks.write_model(model, str(tmp_path))
    asked = spark.createDataFrame([*DATA, (8, "red unknown red red", "a"), (9, "unknown", "b")], "id long, text string, label string")
    out = sinks.scored_by_tables(asked, "id", "text", str(tmp_path))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Exchange hashpartitioning\(id#\d+L?, term#", plan)
    names = [*model.stages[0].labels, ""]
    want = {(x["id"], name): raw for x in model.transform(asked).select("id", vector_to_array("rawPrediction").alias("raw")).collect() for name, raw in zip(names, x["raw"], strict=True)}
    got = {(x["id"], x["name"]): x["logit"] for x in out.collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)
