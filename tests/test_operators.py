"""Operators on small fixtures with known results."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.functions import grading as G
from strandline.functions import perturb as P
from strandline.functions import text as T
from strandline.functions import vectors as V
from strandline.operators import classify, curation, drift, generators, latent, robustness, routing, stats, structure


def values(frame, column):
    return [x[column] for x in frame.collect()]


def test_summarize(spark):
    rows = spark.createDataFrame([("m", "f", "baseline", "14", True), ("m", "f", "numeric", "22", True), ("m", "f", "noop", "18", False)], "model string, family string, kind string, answer string, correct boolean")
    out = {x["kind"]: x for x in robustness.summarize(rows).collect()}
    assert out["baseline"]["accuracy"] == 1 and out["noop"]["degradation_pts"] == 100 and out["baseline"]["degradation_pts"] is None
    assert out["noop"]["consistency"] == pytest.approx(1 / 3)


def test_summarize_without_baseline_and_answers(spark):
    rows = spark.createDataFrame([("m", "f", "noop", None, True), ("m", "f", "noop", None, False)], "model string, family string, kind string, answer string, correct boolean")
    (out,) = robustness.summarize(rows).collect()
    assert out["consistency"] == 1 and out["degradation_pts"] is None
    assert robustness.summarize(rows.limit(0)).collect() == []


@pytest.mark.parametrize(
    ("raw", "kind", "answer"),
    [("The total is 14 apples. Answer: 14", "numeric", "14"), ("so it comes to 1,250 in the end", "numeric", "1250"), ("I think the answer=B because of the river", "mcq", "B"), ("nothing here", "numeric", None), (None, "exact", None)],
)
def test_extract(spark, raw, kind, answer):
    rows = spark.createDataFrame([(raw, kind)], "raw string, kind string")
    assert values(rows.select(G.extract_answer(F.col("raw"), F.col("kind")).alias("x")), "x") == [answer]


def test_grade(spark):
    rows = spark.createDataFrame([("green", "Green.", "exact"), ("1250", "1,250", "numeric"), ("x", "1", "numeric"), (None, "A", "mcq"), (" b", "B", "mcq")], "a string, g string, k string")
    assert values(rows.select(G.grade(F.col("a"), F.col("g"), F.col("k")).alias("x")), "x") == [True, True, False, False, True]


def test_overlap_scores(spark):
    rows = spark.createDataFrame([("AB", "ABC"), ("ABC", "ABC"), ("", "ABC"), ("XYZ", "ABC")], "a string, b string")
    assert values(rows.select(G.char_f1(F.col("a"), F.col("b")).alias("x")), "x") == pytest.approx([0.8, 1, 0, 0])


def test_parses(spark):
    rows = spark.createDataFrame([("ABCDEF",), (" abc ",), (":ABC",), ("xyz",), ("123 %%%",)], "t string")
    assert values(rows.select(G.parse_letters(F.col("t")).alias("x")), "x") == ["ABC", "ABC", "ABC", "", ""]
    rows = spark.createDataFrame([("status=AMBIGUOUS\nanswer=B",), ("I think status = NOT AMBIGUOUS and answer=A",), ("completely unparseable",)], "t string")
    assert [tuple(x) for x in rows.select(G.parse_status(F.col("t")), G.parse_choice(F.col("t"))).collect()] == [("AMBIGUOUS", "B"), ("NOT_AMBIGUOUS", "A"), (None, None)]


def test_hourglass_and_entropy(spark):
    rows = spark.createDataFrame([([10.0, 5.0, 1.0, 5.0, 10.0],), ([5.0] * 5,), ([1.0, 5.0, 10.0, 5.0, 1.0],), ([],)], "v array<double>")
    assert values(rows.select(V.hourglass(F.col("v")).alias("x")), "x") == [9, 0, -4, 0]
    rows = spark.createDataFrame([([0.5] * 100,)], "v array<double>")
    assert values(rows.select(V.entropy(F.col("v")).alias("x")), "x") == pytest.approx([math.log(100)])


def test_spectrum(spark):
    random = np.random.default_rng(0)
    line = np.outer(random.normal(size=60), np.ones(8))
    round_ = random.normal(size=(400, 8))
    rows = spark.createDataFrame([("line", x.tolist()) for x in line] + [("round", x.tolist()) for x in round_] + [("one", [1.0, 2.0])], "g string, v array<double>")
    cov = latent.covariance(rows, "g", "v")
    ratio = {x["g"]: x["participation_ratio"] for x in latent.participation_ratio(cov, "g").collect()}
    rank = {x["g"]: x["effective_rank"] for x in latent.effective_rank(cov, "g").collect()}
    assert ratio["line"] < 1.5 < 4.8 < ratio["round"] and rank["line"] < 1.5 < 4.8 < rank["round"]
    assert ratio["one"] == rank["one"] == 0
    exact = np.linalg.eigvalsh(np.cov(round_.T))
    assert ratio["round"] == pytest.approx(exact.sum() ** 2 / (exact**2).sum())


@pytest.mark.parametrize("kind", sorted(P.KINDS))
def test_perturb(kind):
    text, run = "The quick brown fox jumps over the lazy dog again", P.KINDS[kind]
    assert run(text, 0.0, 1, 2) == text
    assert run(text, 0.5, 1, 2) == run(text, 0.5, 1, 2) != text
    assert run(text, 1.0, 1, 2).strip()
    if kind == "word_shuffle":
        assert sorted(run(text, 0.6, 1, 2).split()) == sorted(text.split())


def test_perturb_is_monotone():
    text = "some words to corrupt " * 30
    changed = [sum(a != b for a, b in zip(text, P.char_noise(text, s, 3, 4), strict=True)) for s in P.SEVERITIES]
    assert changed == sorted(changed)


def test_alignment(spark):
    rows = spark.createDataFrame([(0, "a", 1.0), (0, "b", 2.0), (1, "a", 3.0)], "level int, sample string, value double")
    assert sorted(map(tuple, drift.aligned(rows).collect())) == [(0, "a", 1.0, 1.0), (1, "a", 3.0, 1.0)]


def test_detection_and_lead(spark):
    random = np.random.default_rng(1)
    rows = [(m, lv, s, float(1.5 * (lv >= at) + 0.2 * random.normal())) for m, at in (("accuracy", 4), ("entropy", 2)) for lv in range(6) for s in range(40)]
    found = []
    for metric in ("accuracy", "entropy"):
        own = spark.createDataFrame([x[1:] for x in rows if x[0] == metric], "level long, sample long, value double")
        found.append(drift.detection_level(drift.bootstrap_levels(drift.aligned(own).filter("level > 0")), "up").select(F.lit(metric).alias("metric"), "detected"))
    out = drift.lead(found[0].unionByName(found[1]), "accuracy").collect()
    assert [tuple(x) for x in out] == [("entropy", 2, 2)]


def test_adjusted(spark):
    rows = spark.createDataFrame([(1, 0.001), (2, 0.5), (3, 0.9), (4, None)], "id int, p double")
    out = {x["id"]: x["q"] for x in stats.adjusted(rows.withColumn("g", F.lit(1)), "p", "id", "g").collect()}
    assert out[1] == pytest.approx(0.003) and out[2] == pytest.approx(0.75) and out[3] == pytest.approx(0.9) and out[4] is None


def test_rank_statistics(spark):
    rows = spark.createDataFrame([(1, float(x), float(y)) for x, y in zip(range(1, 6), [2, 4, 5, 4, 6], strict=True)], "g int, x double, y double")
    assert stats.spearman(rows, "x", "y", "g").head()["rho"] > 0.5
    assert stats.spearman(rows.limit(2), "x", "y", "g").head()["rho"] is None
    pairs = spark.createDataFrame([(1, float(k), 0.0) for k in range(1, 8)], "g int, x double, y double")
    out = stats.wilcoxon(pairs, "x", "y", "g").head()
    assert out["w"] == 0 and out["p"] == pytest.approx(2 / 2**7)
    assert stats.student_p(2.228, 10) == pytest.approx(0.05, abs=1e-3)


def test_similarity_join_is_exact(spark):
    random = np.random.default_rng(2)
    words = [f"w{k}" for k in range(40)]
    texts = [" ".join(random.choice(words, 12)) for _ in range(60)]
    texts += [x + " extra" for x in texts[:10]]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    weights = curation.tfidf(rows, "id", curation.words(F.col("text"))).cache()
    by_id = {}
    for x in weights.collect():
        by_id.setdefault(x["id"], {})[x["term"]] = x["weight"]
    want = {(a, b) for a in by_id for b in by_id if a < b and sum(w * by_id[b].get(t, 0) for t, w in by_id[a].items()) >= 0.8}
    assert {(x["a"], x["b"]) for x in curation.similar_pairs(weights, "id", 0.8).collect()} == want and want


def test_components_and_victims(spark):
    nodes = spark.createDataFrame([(k,) for k in range(8)], "id long")
    edges = spark.createDataFrame([(3, 2, 0.9), (2, 5, 0.8), (6, 7, 0.95)], "a long, b long, similarity double")
    found = curation.components(nodes, edges, "id")
    assert {x["id"]: x["component"] for x in found.collect()} == {0: 0, 1: 1, 2: 2, 3: 2, 4: 4, 5: 2, 6: 6, 7: 6}
    victims = curation.greedy_victims(edges, "id", nodes.withColumn("is_original", F.col("id") == 7))
    assert sorted(values(victims, "id")) == [2, 6]


def test_char_grams(spark):
    rows = spark.createDataFrame([("ab",)], "t string")
    assert values(rows.select(curation.char_grams(F.col("t"), 3, 5).alias("g")), "g") == [[" ab", "ab ", " ab "]]


def test_splits(spark):
    rows = spark.createDataFrame([(k, k % 3, k % 11) for k in range(200)], "id long, label long, component long")
    out = curation.split_exact(rows, "id", "label", [("train", 0.7), ("test", 0.3)])
    assert {(x["label"], x["split"]): x["count"] for x in out.groupBy("label", "split").count().collect()}[(0, "train")] == round(67 * 0.7)
    safe = curation.leakage_safe_split(rows, "component", "label", "id")
    assert safe.groupBy("label", "component").agg(F.count_distinct("split").alias("n")).filter("n > 1").count() == 0 and safe.count() == 200


def test_split_keeps_similar_texts_together(spark, tmp_path):
    from strandline.plans.curation import leakage_safe_split

    random = np.random.default_rng(4)
    words = ["".join(random.choice(list("abcdefghijklmnop"), 6)) for _ in range(400)]
    texts = [" ".join(random.choice(words, 20)) for _ in range(24)]
    rows = [(k, x, "en" if k % 2 else "de") for k, x in enumerate(texts)]
    rows += [(100 + k, f"{x.upper()}!", label) for k, x, label in rows[:6]] + [(200 + k, x.replace(x.split()[3], "qrstuv"), label) for k, x, label in rows]
    rows += [(300, None, "en"), (301, "", "en")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    split = {x["doc_id"]: x["split"] for x in leakage_safe_split(spark, str(tmp_path)).collect()}
    assert sorted(split) == sorted(x[0] for x in rows) and len(set(split.values())) == 3
    assert all(split[k] == split[200 + k] for k in range(24)) and all(split[k] == split[100 + k] for k in range(6))

def test_contract(spark):
    rows = spark.createDataFrame([("Hi", "a"), ("hi!", "a"), ("", "a"), ("x", "made_up")], "text string, label string")
    found = {x["check"] for x in curation.contract_errors(rows, "text", "label", ["a", "b"], 1, 10).collect()}
    assert found == {"unknown_label", "empty", "duplicate", "missing_label"}


def test_text_functions(spark):
    rows = spark.createDataFrame([("When is the OPD open?",), ("ओपीडी कब खुलती है?",), ("मुझे Dr. Sharma से मिलना है",), ("123",)], "t string")
    assert values(rows.select(T.script_language(F.col("t")).alias("x")), "x") == ["en", "hi", "hi", "en"]
    rows = spark.createDataFrame([("One. Two! Three? Four.",)], "t string")
    mixed = values(rows.select(T.shuffle_sentences(F.col("t"), 1).alias("x")), "x")[0]
    assert sorted(mixed.split()) == sorted("One. Two! Three? Four.".split()) and mixed.endswith("Four.")
    assert values(rows.select(T.chunks(F.col("t"), 10).alias("x")), "x") == [["One. Two!", "Three?", "Four."]]
    rows = spark.createDataFrame([("0.5B",), ("7b",), ("x",)], "t string")
    assert values(rows.select(T.parameter_count(F.col("t")).alias("x")), "x") == [5e8, 7e9, None]
    rows = spark.createDataFrame([("Tom gave $5 to Tommy",)], "t string")
    assert values(rows.select(T.rename_words(F.col("t"), {"Tom": "A$1"}).alias("x")), "x") == ["A$1 gave $5 to Tommy"]
    rows = spark.createDataFrame([("ﬁne “x”\t é",), (None,)], "t string")
    assert values(rows.select(T.clean(F.col("t")).alias("x")), "x") == ['fine "x" é', ""]


def test_routing(spark):
    rows = spark.createDataFrame([("I want to end it",), ("he is not breathing",), ("",), (None,), ("???",), ("hello",)], "t string")
    text = F.col("t")
    way = routing.route(T.validate(text)["ok"], text.rlike("end it"), text.rlike("breathing"), F.length(text) > 100)
    assert values(rows.select(way.alias("x")), "x") == ["crisis", "emergency", "invalid_input", "invalid_input", "invalid_input", "clarification"]


def test_moods(spark):
    groups = spark.createDataFrame([("neutral", "neutral", 0), ("sadness", "sadness", 1), ("annoyance", "anger", 2), ("anger", "anger", 2)], "label string, group string, place int")
    scores = spark.createDataFrame([(1, "neutral", 0.01), (1, "sadness", 0.01), (2, "neutral", 0.7), (2, "sadness", 0.35), (3, "neutral", 0.7), (3, "sadness", 0.05), (3, "unknown", 0.9)], "id int, label string, score double")
    assert {x["id"]: x["mood"] for x in routing.grouped_mood(scores, groups, "id").collect()} == {1: "neutral", 2: "sadness", 3: "neutral"}
    summed = spark.createDataFrame([(1, "neutral", 0.5), (1, "annoyance", 0.3), (1, "anger", 0.32)], "id int, label string, score double")
    assert routing.grouped_mood(summed, groups, "id", how="sum").head()["mood"] == "anger"


def test_threshold(spark):
    inside = spark.createDataFrame([(float(c), 1, 1 if c > 0.5 else 0) for c in np.linspace(0.3, 1, 100)], "confidence double, actual int, predicted int")
    outside = spark.createDataFrame([(float(c),) for c in np.linspace(0.1, 0.6, 50)], "confidence double")
    best = classify.pick_threshold(classify.threshold_curve(inside, outside), 0.6).head()
    assert best["coverage"] >= 0.6 and 0.3 < best["threshold"] < 0.7


def test_temperature(spark):
    random = np.random.default_rng(3)
    rows = []
    for _ in range(300):
        logits = random.normal(size=4)
        p = np.exp(logits) / np.exp(logits).sum()
        rows.append(((3 * logits).tolist(), int(random.choice(4, p=p))))
    frame = spark.createDataFrame(rows, "logits array<double>, label int")
    assert 2 < classify.fitted_temperature(frame, "logits", "label", rounds=2) < 5


def test_joins_against_brute_force(spark):
    random = np.random.default_rng(4)
    rows = [(k, int(random.integers(3)), int(random.integers(60)), int(random.integers(1, 9))) for k in range(80)]
    frame = spark.createDataFrame(rows, "id long, key long, at long, size long")
    right = frame.select("key", F.col("id").alias("other"), F.col("at").alias("there"))
    got = {(x["id"], x["other"]) for x in structure.band_join(frame, right, ["key"], "at", "there", 5).collect()}
    assert got == {(a[0], b[0]) for a in rows for b in rows if a[1] == b[1] and abs(a[2] - b[2]) <= 5}
    spans = frame.select("key", F.col("at").alias("s"), (F.col("at") + F.col("size")).alias("e")).filter("id % 5 = 0")
    points = frame.withColumn("a", F.col("at")).withColumn("b", F.col("at") + F.col("size") - 3)
    got = {x["id"] for x in structure.overlap_join(points, spans, ["key"], "a", "b", "s", "e", 4).collect()}
    assert got == {a[0] for a in rows if a[3] > 3 and any(a[1] == b[1] and b[0] % 5 == 0 and a[2] < b[2] + b[3] and a[2] + a[3] - 3 > b[2] for b in rows)}


def test_program_structure(spark):
    rows = spark.createDataFrame([("p", "x = 1\nx = x + 1\nprint(x)\n"), ("bad", "def ("), ("none", None)], "program string, source string")
    names = structure.program_names(rows).withColumn("use", (~F.col("is_definition")).cast("int"))
    bound = structure.asof(names, ["program", "scope", "name"], ["start", "use"], F.col("is_definition"), "start")
    assert {(x["name"], x["start"]): x["bound"] for x in bound.collect()} == {("x", 10): 6, ("print", 16): None, ("x", 22): 6}


def test_expressions(spark):
    rows = spark.createDataFrame([(7, 2), (-7, 2)], "a int, b int")
    columns = {"a": F.col("a"), "b": F.col("b")}
    assert values(rows.select(generators.expression("a // b + a % b", columns).cast("int").alias("x")), "x") == [4, -3]
    assert values(rows.select(generators.expression("0 < a <= 7 and b == 2", columns).alias("x")), "x") == [True, False]
    with pytest.raises(ValueError, match="not allowed"):
        generators.expression("__import__('os')", columns)


def test_same_on_any_partitioning(spark):
    rows = spark.range(100).select(F.col("id"), (F.col("id") % 3).alias("label"), (F.col("id") * 7 % 13).cast("double").alias("v"))
    seen = {tuple(sorted(map(tuple, curation.split_exact(rows.repartition(n), "id", "label", [("a", 0.5), ("b", 0.5)]).select("id", "split").collect()))) for n in (1, 4, 9)}
    assert len(seen) == 1


def test_curated_keeps_texts_out_of_what_it_stores(spark, tmp_path, monkeypatch):
    """The rows that steps are counted from have no texts, also where a place is repeated the audit is the same."""
    from strandline.operators import pipelines

    texts = ["One and two, three.", "one and two three", "quite another text here", "quite another text here now", "something else", None]
    rows = spark.createDataFrame([(k, x, "a" if k % 2 else "b", "original" if k == 0 else "expansion") for k, x in enumerate(texts)], "ord long, text string, label string, source string")
    kept = []
    monkeypatch.setattr(pipelines, "saved", lambda df, own=pipelines.saved: kept.append(df.columns) or own(df))
    monkeypatch.setattr(pipelines, "stored", lambda df, own=pipelines.stored: kept.append(df.columns) or own(df))
    out, audit = pipelines.curated(rows, spark.createDataFrame([], "key string, old string, new string"), 100)
    assert kept and not any("text" in x for x in kept)
    counts = {x["step"]: x["rows"] for x in audit.collect()}
    assert counts["read"] == 6 and counts["conflicts"] == 1 and counts["first_of_key"] == 5 and sorted(x["ord"] for x in out.select("ord").collect()) == sorted({0, 2, 3, 4, 5} - ({3} if counts["near_duplicates"] == 4 else set()))
    assert {x["ord"]: x["text"] for x in out.collect()}[0] == texts[0]
    again = pipelines.curated(rows.union(rows), spark.createDataFrame([], "key string, old string, new string"), 100)[1]
    assert {x["step"]: x["rows"] for x in again.collect()}["read"] == 12


def test_linked_rows_of_repeated_items(spark):
    """An item with two texts links both of its forms' rows, and an item by itself brings its text once."""
    text = "the same long sentence about harbours and boats"
    rows = [(1, "x", text), (2, "x", text.upper() + "!"), (3, "x", "nothing like it at all, really"), (4, "y", text)]
    found = curation.linked_within(spark.createDataFrame(rows, "id long, kind string, text string"), "text", "kind", "id", 0.75)
    assert {x["id"]: x["component"] for x in found.collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    twice = curation.linked_within(spark.createDataFrame([*rows, (3, "x", text)], "id long, kind string, text string"), "text", "kind", "id", 0.75)
    assert twice.count() == 5
