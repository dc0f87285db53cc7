"""Evaluation operators on small tables with expected values."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandline.functions.grading import extract_answer, grade
from strandline.functions.text import name_words
from strandline.operators import classify, curation, evaluation, routing


@pytest.mark.parametrize(
    ("raw", "kind", "want"),
    [
        ("The answers are 3,4", "numeric", "4"),
        ("It costs 1,234.50 in all", "numeric", "1234.50"),
        ("answer: 12,345 and then", "numeric", "12345"),
        ("I get 7. Answer: none", "numeric", "7"),
        ("minus -3", "numeric", "-3"),
        ("nothing", "numeric", None),
        ("Answer: see below\nB is right", "mcq", "B"),
        ("Final answer = (c)", "mcq", "C"),
        ("D", "mcq", "D"),
        ("none of them", "mcq", None),
        ("\n  Answer:  The Sea, \nwhat else", "exact", "the sea"),
        ("First line\nsecond", "exact", "first line"),
        (None, "exact", None),
        ("Answer: ...!", "exact", ""),
        ("", "exact", ""),
        ("7", None, None),
    ],
)
def test_extract_answer(spark, raw, kind, want):
    row = spark.createDataFrame([(raw, kind)], "raw string, kind string").select(extract_answer(F.col("raw"), F.col("kind"))).head()
    assert row[0] == want


def test_an_unknown_type_is_an_error(spark):
    with pytest.raises(Exception, match="unknown answer type"):
        spark.createDataFrame([("7", "essay")], "raw string, kind string").select(extract_answer(F.col("raw"), F.col("kind"))).collect()


def test_grade(spark):
    rows = [("3.0000001", "3", "numeric", True), ("1,000", "1000", "numeric", True), ("x", "1", "numeric", False), (" b", "B", "mcq", True), ("The  sea!", "the sea", "exact", True), (None, "a", "exact", False)]
    found = spark.createDataFrame(rows, "a string, g string, k string, want boolean")
    assert found.filter(grade(F.col("a"), F.col("g"), F.col("k")) != F.col("want")).count() == 0


def test_greedy_victims(spark):
    """Two originals stay; an original wins; else the earlier row; a row that is gone removes nothing."""
    pairs = spark.createDataFrame([(1, 2, 0.99), (2, 3, 0.98), (3, 4, 0.97), (4, 5, 0.96), (5, 6, 0.95), (8, 9, 0.9)], "a long, b long, similarity double")
    original = {1: True, 2: True, 3: False, 4: True, 5: False, 6: False, 8: False, 9: True}
    kinds = spark.createDataFrame(list(original.items()), "id long, is_original boolean")
    assert sorted(x["id"] for x in curation.greedy_victims(pairs, "id", kinds).collect()) == [3, 5, 8]


PREDICTIONS = [(1, "a", "a", 0.9, 0.9, False), (2, "a", "b", 0.8, 0.1, False), (3, "b", "b", 0.3, 0.2, False), (4, "b", "a", 0.4, 0.7, False), (5, "x", "a", 0.95, 0.95, True), (6, "x", "b", 0.2, 0.0, True)]
SCHEMA = "id long, actual string, predicted string, confidence double, p_label double, outside boolean"


def test_rates(spark):
    rows = spark.createDataFrame(PREDICTIONS, SCHEMA)
    assert tuple(evaluation.selective_rates(rows, 0.5, "outside").head()) == (0.5, 0.5, 0.5, 1, 2, 2, 0.5)
    assert tuple(evaluation.watched_rates(rows, F.lit("a"), 0.5, "outside").head()) == (0.5, 0.5, 0.5, 0.5, 0.5)
    assert tuple(evaluation.selective_rates(rows.limit(0), 0.5, "outside").head()) == (0.5, None, None, 0, 0, 0, None)
    assert tuple(evaluation.mean_confidence(rows.filter("not outside")).head())[0::2] == pytest.approx((4, 0.6))
    assert evaluation.mean_confidence(rows.filter("id = 1")).head()["mean_confidence_errors"] == 0
    flags = evaluation.flag_recall(rows, F.col("actual") == "a", F.col("confidence") > 0.85)
    assert tuple(flags.head()) == (0.5, 1, 2, 1, 4)
    assert [x["id"] for x in evaluation.missed(rows, F.col("actual") == "a", F.col("confidence") > 0.85).collect()] == [2]


def test_full_evaluation_is_made_of_its_parts(spark):
    rows = spark.createDataFrame(PREDICTIONS, SCHEMA)
    out = {x["metric"]: x["value"] for x in evaluation.full_evaluation(rows, rows, "outside").collect()}
    inside = rows.filter("not outside")
    threshold = classify.pick_threshold(classify.threshold_curve(inside, rows.filter("outside"))).head()["threshold"]
    assert out["threshold"] == threshold and out["accuracy"] == 0.5 and out["recall_of_a"] == out["recall_of_b"] == 0.5
    assert out["coverage"] == evaluation.selective_rates(rows, threshold, "outside").head()["coverage"]
    assert out["ece"] == pytest.approx((0.1 + 0.8 + 0.7 + 0.4) / 4)
    bundle = evaluation.calibration_bundle(rows, "outside")
    assert bundle["curve"].count() == 101 and {k: x.count() for k, x in bundle.items() if k != "curve"} == {"threshold": 1, "emergency_threshold": 1, "ece": 1}


def test_grid_search_and_pick(spark):
    train = spark.createDataFrame([(f"{w} {k}", w) for w in ("red", "green") for k in range(20)], "text string, label string")
    grid = evaluation.grid_search(train, train, "text", "label", [0.1, 10.0])
    assert evaluation.best_strength(grid).head()["strength"] == 0.1 and grid.count() == 2
    ties = spark.createDataFrame([(2.0, 0.9), (1.0, 0.9), (0.5, 0.8)], "strength double, f1 double")
    assert evaluation.best_strength(ties).head()["strength"] == 1.0


def test_runs_with_hooks(spark):
    prompts = spark.createDataFrame([("2 + 2", "4", "numeric"), ("best?", "B", "mcq")], "prompt string, gold string, kind string")
    out = evaluation.graded_run(prompts, lambda s: s.map({"2 + 2": "Answer: 4", "best?": "C"}), "m").orderBy("prompt").collect()
    assert [(x["model"], x["extracted"], x["is_correct"]) for x in out] == [("m", "4", True), ("m", "C", False)]

    def model(frames):
        for x in frames:
            yield pd.DataFrame({"prompt": x["prompt"], "n": x["prompt"].str.len()})

    assert sorted(x["n"] for x in evaluation.predicted_by(prompts, model, "prompt string, n long").collect()) == [5, 5]


def test_moods_and_keywords(spark):
    rows = spark.createDataFrame([([0.5, 0.5],), ([0.1, 0.4],)], "s array<double>")
    assert [tuple(x[0]) for x in rows.select(routing.single_mood(F.col("s"), ["a", "b"])).collect()] == [("a", 0.5, "confident", "a"), ("neutral", 0.4, "fallback_neutral", "b")]
    texts = spark.createDataFrame([("I can’t Breathe!",), ("fine",), (None,)], "t string")
    assert [x[0] for x in texts.select(routing.has_keyword(F.col("t"), ["can't breathe"])).collect()] == [True, False, False]
    assert texts.select(name_words(F.lit("sum_of2_Squares"))).head()[0] == "sum of squares"


def test_second_pipeline(spark):
    rows = spark.createDataFrame([("chest pain", "greeting", 0.2), ("chest pain", "urgent", 0.2), ("hi", "greeting", 0.9), ("  ", "greeting", 0.9), (None, None, None)], "text string, intent string, confidence double")
    out = routing.overridden(rows, "text", "urgent", ["chest pain"], 0.5).collect()
    assert [(x["intent"], x["confidence"], x["safety_override"], x["status"]) for x in out] == [("urgent", 1.0, True, "override"), ("urgent", 0.2, False, "low_confidence"), ("greeting", 0.9, False, "answered"), ("greeting", 0.9, False, "empty"), (None, None, False, "empty")]


def test_no_rows(spark):
    none = spark.createDataFrame([], "model string, task string, eligible boolean, passed boolean, overlap double")
    assert evaluation.pass_rates(none).count() == 0
    assert tuple(evaluation.provenance(none, none.withColumn("synthetic", F.lit(True))).head()) == ([], False, False)
    assert [tuple(x) for x in evaluation.graded_by_rule(none, "task", "overlap").collect()] in ([], [(None, 0, 0.0)])


def test_profile_of_layers(spark):
    import numpy as np

    from strandline.operators import latent

    pick = np.random.default_rng(2)
    rows = [("m", layer, pick.normal(size=3).tolist()) for layer in (0, 1) for _ in range(9)] + [("m", 2, [1.0, 2.0, 3.0])]
    out = latent.layer_profiles(spark.createDataFrame(rows, "model string, layer long, v array<double>"), "model", "layer", "v").head()
    want_er, want_pr = [], []
    for layer in (0, 1):
        values = np.linalg.eigvalsh(np.cov(np.array([v for _, k, v in rows if k == layer]).T))
        p = values / values.sum()
        want_er.append(float(np.exp(-(p * np.log(p)).sum())))
        want_pr.append(float(values.sum() ** 2 / (values**2).sum()))
    assert out["er_by_layer"] == pytest.approx([*want_er, 0]) and out["pr_by_layer"] == pytest.approx([*want_pr, 0])
    assert out["last_er"] == out["last_pr"] == 0 and out["max_pr"] == pytest.approx(max(want_pr))


def test_interval_of_a_slope(spark):
    from strandline.operators import stats

    fits = spark.createDataFrame([(12, 0.5, 0.2), (2, 0.5, 0.2)], "n long, beta double, se double")
    out = stats.ols_interval(fits).orderBy("n").collect()
    assert out[0]["low"] is None
    assert (out[1]["low"], out[1]["high"]) == pytest.approx((0.5 - 2.228139 * 0.2, 0.5 + 2.228139 * 0.2), abs=1e-5)


def test_overlap_counts_as_multisets(spark):
    from collections import Counter

    from strandline.functions.grading import overlap_f1

    rows = [("aab", "abb"), ("", "a"), ("abc", "xyz"), ("ééa", "éa"), ("aaaa", "aa")]
    out = spark.createDataFrame(rows, "l string, r string").select(overlap_f1(F.split("l", ""), F.split("r", ""))).collect()
    for (a, b), x in zip(rows, out, strict=True):
        shared = sum((Counter(a) & Counter(b)).values())
        if a and b:
            assert x[0] == pytest.approx(2 * shared / (len(a) + len(b)))


def test_bundles_and_documents(spark, tmp_path):
    import json

    from strandline.sources import files, sinks

    rows = spark.createDataFrame([("a<b", 0.5), ("c\\d~^", None)], "name string, x double")
    sinks.write_bundle({"one": rows}, str(tmp_path / "out"), ["made up"])
    text = "\n".join(x["value"] for x in spark.read.text(str(tmp_path / "out/one.tex")).collect())
    assert r"a\textless{}b" in text and r"c\textbackslash{}d\textasciitilde{}\textasciicircum{}" in text
    assert "> made up" in "\n".join(x["value"] for x in spark.read.text(str(tmp_path / "out/report.md")).collect())
    with pytest.raises(ValueError, match="more than 1"):
        sinks.write_document(rows, str(tmp_path / "doc"), most=1)
    for name, content in {"struct_a.json": {"model": "m1", "layers": 3}, "struct_b.json": {"model": "m2", "layers": 4}, "info_a.json": {"model_id": "m1", "params": "0.5B"}, "down_a.json": {"model": "m1", "scores": {"t": 0.5}, "synthetic": True}}.items():
        (tmp_path / name).write_text(json.dumps(content, indent=1))
    found = files.named_documents(spark, f"{tmp_path}/struct_*.json", "model string, layers int", r"struct_(.*)\.json", f"{tmp_path}/info_*.json", "params string", r"info_(.*)\.json")
    assert sorted((x["model"], x["params"]) for x in found.collect()) == [("m1", "0.5B"), ("m2", None)]
    both = files.downstream_documents(spark, found.select("model", "layers"), f"{tmp_path}/down_*.json", f"{tmp_path}/info_*.json").collect()
    assert [(x["model"], x["scores"], x["params"]) for x in both] == [("m1", {"t": 0.5}, 5e8)]
    (tmp_path / "conf.json").write_text('{"paths": {"test": "data/test.csv", "abs": "/x", "far": "s3://b/x"}}')
    conf = files.configuration(str(tmp_path / "conf.json"))
    assert [files.configured_path(conf, k, "/root/") for k in ("test", "abs", "far")] == ["/root/data/test.csv", "/x", "s3://b/x"]


def test_models_as_tables(spark, tmp_path):
    from strandline.sources import sinks

    train = spark.createDataFrame([(k, f"{w} {o} {k % 3}", w) for w, o in (("red", "one"), ("green", "two"), ("blue", "one")) for k in range(12)], "id long, text string, label string")
    model = classify.fit_text_classifier(train, "text", "label")
    sinks.write_model(model, str(tmp_path))
    texts = spark.createDataFrame([(1, "red one 2"), (2, "Green, two!"), (3, "")], "id long, text string")
    raw = {x["id"]: list(x["rawPrediction"]) for x in model.transform(texts.withColumn("label", F.lit("red"))).collect()}
    names = model.stages[0].labels
    for x in sinks.scored_by_tables(texts, "id", "text", str(tmp_path)).filter("name <> ''").collect():
        assert x["logit"] == pytest.approx(raw[x["id"]][names.index(x["name"])], abs=1e-6)
