"""Statistics, composition and evaluation against plain versions and values worked by hand."""

import itertools
import math
import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.functions import text as T
from strandline.operators import classify, curation, drift, evaluation, latent, pipelines, stats, tables


# --- composition


def test_closed_characters_are_not_changed(spark):
    """Whatever doesn't go to Python is the same after composition, alone and beside any other such character."""
    rows = spark.range(0x20, 0x3000).select(F.chr(F.col("id")).alias("c"), F.chr(F.col("id")).rlike(T.OPEN).alias("open"))
    closed = [x["c"] for x in rows.collect() if not x["open"]]
    assert len(closed) > 250 and "é" in closed and "ß" in closed and "́" not in closed and "ﬁ" not in closed
    for c in closed:
        assert unicodedata.normalize("NFKC", c) == c and not unicodedata.combining(c)
    pick = random.Random(1)
    text = "".join(pick.choice(closed) for _ in range(20_000))
    assert unicodedata.normalize("NFKC", text) == text


def test_composition_everywhere(spark):
    texts = ["ﬁne Ｔｅｘｔ", "fine Text", "fine text!", "Café", "café", "x²", None]
    rows = spark.createDataFrame([(k, t, "a") for k, t in enumerate(texts)], "id long, text string, label string")
    keys = {x["id"]: x["k"] for x in rows.select("id", T.dedup_key(F.col("text")).alias("k")).collect()}
    assert keys[0] == keys[1] == keys[2] == "fine text" and keys[3] == keys[4] == "café" and keys[5] == "x2" and keys[6] == ""
    keyed = rows.filter("text is not null").withColumn("key", T.dedup_key(F.col("text")))
    assert tuple(curation.duplicate_accounting(keyed, "text", "label", "key").head()) == (0, 0, 3, 3)
    errors = {x["check"]: x["n"] for x in curation.contract_errors(rows, "text", "label", ["a"], 1, 100).collect()}
    assert errors["duplicate"] == 3 and errors["empty"] == 1
    assert rows.filter("id = 0").select(T.validate(F.col("text"))["text"]).head()[0] == "fine Text"
    left, report = pipelines.cleaned(rows, ["a"], "id")
    assert sorted(x["text"] for x in left.collect()) == sorted(["ﬁne Ｔｅｘｔ", "Café", "x²"]) and {x["check"]: x["n"] for x in report.collect()}["kept"] == 3


def test_near_duplicates_go_before_the_cap(spark):
    long = "please book an appointment with the doctor for the coming week"
    rows = [(1, long, "book", "original"), (2, long + " ok", "book", "expansion"), (3, "is the ward open on sundays", "visit", "expansion"), (4, long + " yes", "book", "original")]
    frame = spark.createDataFrame(rows, "ord long, text string, label string, source string")
    left, audit = pipelines.curated(frame, spark.createDataFrame([], "key string, old string, new string"), 100)
    assert sorted(x["ord"] for x in left.collect()) == [1, 3, 4]
    assert {x["step"]: x["rows"] for x in audit.collect()} == {"read": 4, "conflicts": 0, "first_of_key": 4, "near_duplicates": 3, "capped": 3}


# --- ranks, p values, covariance, resampling


def average_ranks(values):
    return [sum(y < x for y in values) + (sum(y == x for y in values) + 1) / 2 for x in values]


def test_average_ranks(spark):
    pick = random.Random(2)
    rows = [(pick.choice(["a", "b", None]), float(pick.randint(0, 30)), pick.choice([None, pick.gauss(0, 1)])) for _ in range(400)]
    frame = spark.createDataFrame(rows, "g string, x double, y double")
    ranked = stats.with_rank(frame, "x", "r", "g")
    assert not [x for x in ranked._jdf.queryExecution().executedPlan().toString().split("\n") if "Window [" in x and "_pid" not in x]
    got = sorted((str(x["g"]), x["x"], x["r"]) for x in ranked.collect())
    want = []
    for g in ("a", "b", None):
        own = [x for h, x, _ in rows if h == g]
        want += [(str(g), x, r) for x, r in zip(own, average_ranks(own), strict=True)]
    assert got == sorted(want)
    rho = {x["g"]: x["rho"] for x in stats.spearman(frame, "x", "y", "g").collect()}
    for g in ("a", "b", None):
        own = [(x, y) for h, x, y in rows if h == g and y is not None]
        assert rho[g] == pytest.approx(np.corrcoef(*(average_ranks(v) for v in zip(*own, strict=True)))[0, 1])


@pytest.mark.parametrize("sizes", [(1, 4), (3, 5), (4, 4), (8, 3)])
def test_rank_sum_p_by_enumeration(spark, sizes):
    pick = random.Random(sizes[0] * 9 + sizes[1])
    values = [pick.random() for _ in range(sum(sizes))]
    u = lambda first: sum((x > y) + (x == y) / 2 for x in (values[i] for i in first) for y in (v for j, v in enumerate(values) if j not in first))
    middle = sizes[0] * sizes[1] / 2
    own = u(range(sizes[0]))
    all_ = [u(c) for c in itertools.combinations(range(len(values)), sizes[0])]
    want = min(1.0, 2 * sum(x >= max(own, 2 * middle - own) for x in all_) / len(all_))
    frame = spark.createDataFrame([(float(v), k < sizes[0]) for k, v in enumerate(values)], "v double, first boolean")
    got = stats.mann_whitney(frame, "v", F.col("first")).head()
    assert got["u"] == own and got["p"] == pytest.approx(want)


def test_rank_sum_p_of_larger_samples_and_ties(spark):
    frame = spark.createDataFrame([(float(k % 7), k % 2 == 0) for k in range(12)] + [(100.0 + k, k % 3 == 0) for k in range(30)], "v double, first boolean")
    assert 0 < stats.mann_whitney(frame, "v", F.col("first")).head()["p"] <= 1
    ways = stats.ways_of_u(3, 4)
    assert ways.sum() == math.comb(7, 3) and list(ways) == list(ways[::-1])
    one_sided = spark.createDataFrame([(1.0, True), (2.0, True)], "v double, first boolean")
    assert stats.mann_whitney(one_sided, "v", F.col("first")).head()["p"] is None


@pytest.mark.parametrize("offset", [0.0, 1e8, -1e8])
def test_covariance_far_from_zero(spark, offset):
    random_ = np.random.default_rng(3)
    x = random_.normal(size=(500, 4)) * [1, 2, 0.5, 1] + offset
    frame = spark.createDataFrame([("g", v.tolist()) for v in x] + [("one", [1.0, 2.0, 3.0, 4.0])], "g string, v array<double>").repartition(6)
    cov = latent.covariance(frame, "g", "v")
    want = np.cov(x.T)
    got = {(r["i"], r["j"]): r["c"] for r in cov.filter("g = 'g'").collect()}
    assert all(got[i, j] == pytest.approx(want[i, j], abs=1e-6) for i in range(4) for j in range(i, 4))
    values = np.linalg.eigvalsh(want)
    ratio = {r["g"]: r["participation_ratio"] for r in latent.participation_ratio(cov, "g").collect()}
    assert ratio["g"] == pytest.approx(values.sum() ** 2 / (values**2).sum(), rel=1e-6) and ratio["one"] == 0
    p = values / values.sum()
    rank = {r["g"]: r["effective_rank"] for r in latent.effective_rank(cov, "g").collect()}
    assert rank["g"] == pytest.approx(float(np.exp(-(p * np.log(p)).sum())), rel=1e-6)


def test_resamples_have_the_size_of_the_sample(spark):
    random_ = np.random.default_rng(4)
    rows = [(level, s, float(random_.normal(level * 0.1)), 0.0) for level in (1, 2) for s in range(700)] + [(3, 1, 5.0, 1.0), (3, 2, None, 1.0)]
    frame = spark.createDataFrame(rows, "level long, sample long, value double, base double")
    seen = []
    for n in (1, 5):
        out = drift.bootstrap_levels(frame.repartition(n), replicates=300, cell_rows=100).orderBy("level").collect()
        assert [list(x["drawn"]) for x in out] == [[700, 700], [700, 700], [1, 1]] and [x["n"] for x in out] == [700, 700, 1]
        seen.append([tuple(x)[:5] for x in out])
    assert seen[0] == seen[1] and seen[0][2][2:] == (4.0, 4.0, 4.0)
    for level in (1, 2):
        own = np.array([v for k, _, v, _ in rows if k == level])
        _, _, diff, low, high = seen[0][level - 1]
        assert diff == pytest.approx(own.mean()) and low < diff < high
        # the width of a normal interval
        assert (high - low) / (2 * 1.96 * own.std() / math.sqrt(700)) == pytest.approx(1, abs=0.2)


def test_best_predictors_ties(spark):
    rows = [("t", "DFBS", 0.5), ("t", "CFS", -0.5), ("t", "AAA", 0.5), ("u", "AAA", 0.9), ("u", "SRS", 0.8), ("v", "SRS", None)]
    frame = spark.createDataFrame(rows, "task string, metric string, rho double")
    assert {x["task"]: x["metric"] for x in tables.best_predictors(frame).collect()} == {"t": "CFS", "u": "AAA", "v": "--"}


# --- evaluation


def test_balanced_accuracy_by_hand(spark):
    """0.9 is right, 0.8 wrong: at 0.85 what is accepted is all that should be."""
    inside = spark.createDataFrame([(0.9, 1, 1), (0.8, 1, 2)], "confidence double, actual int, predicted int")
    outside = spark.createDataFrame([(0.3,), (0.95,)], "confidence double")
    at = lambda curve: {round(x["threshold"], 2): x["balanced"] for x in curve.collect()}
    alone = at(classify.threshold_curve(inside, outside.limit(0)))
    assert alone[0.85] == 1.0 and alone[0.5] == 0.5 and alone[0.95] == 0.5
    both = at(classify.threshold_curve(inside, outside))
    # of one right row and three others: 0.85 refuses 0.8 and 0.3, 1.0 all
    assert both[0.85] == pytest.approx((1 + 2 / 3) / 2) and both[1.0] == 0.5 and both[0.0] == 0.5
    assert at(classify.threshold_curve(inside.limit(0), outside))[1.0] == 0.5
    assert set(at(classify.threshold_curve(inside.limit(0), outside.limit(0))).values()) == {0.0}


def plain_evaluation(rows, label, threshold, emergency):
    """coverage, selective accuracy, false accepts, recall and alarms of (outside, actual, predicted, confidence, p)."""
    inside = [r for r in rows if not r[0]]
    out = [r for r in rows if r[0]]
    share = lambda f, among: sum(map(f, among)) / len(among) if among else None
    accepted = [r for r in inside if r[3] >= threshold]
    return {
        "coverage": share(lambda r: r[3] >= threshold, inside),
        "selective_accuracy": share(lambda r: r[1] == r[2], accepted),
        "false_accept_rate": share(lambda r: r[3] >= threshold, out),
        "watched_recall": share(lambda r: r[4] >= emergency, [r for r in inside if r[1] == label]),
        "false_alarm_rate": share(lambda r: r[4] >= emergency, [r for r in inside if r[1] != label]),
        "false_alarm_rate_outside": share(lambda r: r[4] >= emergency, out),
    }


def plain_thresholds(rows, label, least_coverage=0.9, most=0.02):
    inside, out = [r for r in rows if not r[0]], [r for r in rows if r[0]]
    best = None
    for k in range(101):
        t = k / 100
        right = [r for r in inside if r[1] == r[2]]
        bad = [r for r in inside if r[1] != r[2]] + out
        tpr = sum(r[3] >= t for r in right) / len(right) if right else 0
        tnr = sum(r[3] < t for r in bad) / len(bad) if bad else 0
        coverage = sum(r[3] >= t for r in inside) / len(inside)
        key = (coverage >= least_coverage, round((tpr + tnr) / 2, 6), coverage)
        if best is None or key > best[0]:
            best = (key, t)
    negative = [r for r in rows if r[0] or r[1] != label]
    emergency = next((k / 100 for k in range(1, 101) if k / 100 <= best[1] and sum(r[4] >= k / 100 for r in negative) / len(negative) <= most), best[1])
    return best[1], emergency


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_model_evaluation_by_formulas(spark, seed):
    pick = random.Random(seed)

    def rows(n):
        made = []
        for _ in range(n):
            actual = pick.choice("abc")
            right = pick.random() < 0.7
            confidence = round(min(1.0, max(0.0, pick.gauss(0.7 if right else 0.45, 0.15))), 2)
            made.append((pick.random() < 0.2, actual, actual if right else pick.choice("abc"), confidence, round(pick.random() ** (1 if actual == "a" else 4), 2)))
        return made

    schema = "model string, outside boolean, actual string, predicted string, confidence double, p_label double"
    tests = {m: rows(150) for m in "xy"}
    seen = {m: rows(150) for m in "xy"}
    frame = lambda of: spark.createDataFrame([(m, *r) for m in of for r in of[m]], schema)
    times = spark.createDataFrame([("x", 2.0), ("y", 1.0)], "model string, latency double")
    out = {(x["model"], x["metric"]): x["value"] for x in evaluation.model_evaluation(frame(seen), frame(tests), times, F.lit("a")).collect()}
    for m in "xy":
        threshold, emergency = plain_thresholds(seen[m], "a")
        assert (out[m, "threshold"], out[m, "emergency_threshold"]) == (threshold, emergency)
        for name, value in plain_evaluation(tests[m], "a", threshold, emergency).items():
            assert out[m, name] == pytest.approx(value), name
        inside = [r for r in tests[m] if not r[0]]
        assert out[m, "accuracy"] == pytest.approx(sum(r[1] == r[2] for r in inside) / len(inside))
        gap = 0.0
        for k in range(10):
            own = [r for r in inside if k / 10 < r[3] <= (k + 1) / 10 + 1e-12]
            gap += abs(sum(r[1] == r[2] for r in own) - sum(r[3] for r in own))
        assert out[m, "ece_after"] == pytest.approx(gap / len(inside), abs=0.02) and out[m, "ece_before"] == out[m, "ece_after"]
    f1 = {m: out[m, "validation_macro_f1"] for m in "xy"}
    best = min((m for m in "xy" if f1[m] >= max(f1.values()) - 0.005), key={"x": 2, "y": 1}.get)
    assert [m for m in "xy" if out[m, "selected"] == 1] == [best]


def test_calibration_of_logits(spark):
    random_ = np.random.default_rng(5)
    rows = []
    for k in range(400):
        logits = random_.normal(size=3)
        p = np.exp(logits) / np.exp(logits).sum()
        rows.append(((4 * logits).tolist(), "abc"[int(random_.choice(3, p=p))], k % 10 == 0))
    frame = spark.createDataFrame(rows, "z array<double>, label string, outside boolean")
    got = evaluation.calibration(frame, "z", "label", ["a", "b", "c"], "a", "outside").head()
    assert 3 < got["temperature"] < 5.5 and got["ece_after"] < got["ece_before"] and 0 < got["emergency_threshold"] <= got["threshold"]
