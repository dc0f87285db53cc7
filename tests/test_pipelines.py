"""Whole runs and result tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import pipelines, routing, tables


def test_curated(spark):
    rows = spark.createDataFrame([(1, "Book a doctor", "a", "original"), (2, "book a doctor!", "a", "expansion"), (3, "Bye", "b", "original"), (4, "bye", "a", "expansion"), (5, "See you", "b", "expansion"), (6, "Later", "b", "expansion")], "ord long, text string, label string, source string")
    fixes = spark.createDataFrame([("later", "b", "c")], "key string, old string, new string")
    out, audit = pipelines.curated(rows, fixes, 1)
    assert {tuple(x)[:3:2] for x in out.collect()} == {(1, "a"), (3, "b"), (6, "c")}
    assert {x["step"]: x["rows"] for x in audit.collect()} == {"read": 6, "conflicts": 1, "first_of_key": 4, "near_duplicates": 4, "capped": 3}


def test_cleaned(spark):
    rows = spark.createDataFrame([("Hi", "a"), ("hi", "b"), ("Book a doctor", "a"), ("book a doctor", "a"), ("Bye", "b"), (None, "b"), ("x", "made_up")], "text string, label string")
    out, report = pipelines.cleaned(rows, ["a", "b"])
    assert {x["text"].lower() for x in out.collect()} == {"book a doctor", "bye"}
    assert {x["check"]: x["n"] for x in report.collect()} == {"read": 7, "with_values": 6, "known_label": 5, "without_conflicts": 3, "kept": 2}


def test_replies(spark):
    messages = spark.createDataFrame([(1, "where is the desk", "neutral", [0.9, 0.1]), (2, "he is not breathing", "sad", [0.2, 0.1]), (3, "", "sad", [0.9, 0.0]), (4, "hm", "sad", [0.5, 0.1])], "id long, text string, mood string, p array<double>")
    templates = spark.createDataFrame([("desk", "neutral", 1, "There."), ("emergency", "neutral", 1, "Help comes."), ("clarification", "sad", 1, "Sorry?")], "intent string, mood string, ordinal int, response string")
    out = pipelines.replies(messages, ["desk", "emergency"], templates, "end it", {"breath": "not breathing"}, "no emergency", 0.6, 0.5)
    assert {x["id"]: (x["route"], x["response"]) for x in out.collect()} == {1: ("intent", "There."), 2: ("emergency", "Help comes."), 3: ("invalid_input", None), 4: ("clarification", "Sorry?")}
    assert {tuple(x) for x in routing.template_errors(templates, ["desk"], ["neutral", "sad"]).collect()} == {("missing", "desk", "sad")}


def test_out_of_fold(spark):
    words = {"a": "apple pear plum", "b": "car bus train"}
    rows = [(k, f"{words['ab'[k % 2]]} {k % 7}", "ab"[k % 2]) for k in range(60)] + [(99, "apple pear plum", "b")]
    out = pipelines.out_of_fold(spark.createDataFrame(rows, "id long, text string, label string"), "text", "label", "id", folds=2)
    assert [x["id"] for x in out.collect()] == [99]


def test_tables(spark):
    random = np.random.default_rng(9)
    values = spark.createDataFrame([("d", bool(k % 2), float(random.normal() + 2 * (k % 2))) for k in range(60)], "dimension string, positive boolean, value double")
    pairs = spark.createDataFrame([("p", float(random.normal()), float(random.normal())) for _ in range(20)] + [("same", 1.0, 1.0)] * 3, "dimension string, x double, y double")
    out = {x["dimension"]: x for x in tables.separability(values, pairs).collect()}
    assert out["d"]["effect"] > 1 and out["d"]["p"] < out["d"]["q"] < 0.01 and out["same"]["p"] is None
    shown = {x["dimension"]: x for x in tables.shown(tables.separability(values, pairs), effect=2, p=3).collect()}
    assert shown["d"]["p"] == "<0.001" and shown["same"]["p"] == "--"
    scores = spark.createDataFrame([(f"m{k}", a, "t", float(k * (1 if a == "x" else -1) + (k % 3) * (a == "y") * 4), float(k)) for k in range(8) for a in ("x", "y")], "model string, metric string, task string, m double, t double")
    table = tables.association(scores)
    assert {x["metric"]: x["rho"] for x in table.collect()}["x"] == pytest.approx(1)
    assert [x["metric"] for x in tables.best_predictors(table).collect()] == ["x"]
    assert tables.best_predictors(table.withColumn("rho", F.lit(None).cast("double"))).head()["metric"] == "--"
