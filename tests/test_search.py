"""Similarity searches, victims and places against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import curation, ranks, similarity


def vectors(spark, items):
    """(item, {term: weight}) as rows of length one."""
    rows = []
    for i, own in items:
        size = sum(w * w for w in own.values()) ** 0.5
        rows += [(i, t, w / size) for t, w in own.items()]
    return spark.createDataFrame(rows, "id long, term string, weight double"), rows


def cosines(rows):
    by: dict = {}
    for i, t, w in rows:
        by.setdefault(i, {})[t] = w
    return {(a, b): sum(w * by[b].get(t, 0.0) for t, w in by[a].items()) for a in by for b in by if a < b}


def hot_items(pick, n, hot=True):
    items = []
    for i in range(n):
        own = {f"t{min(int(pick.paretovariate(0.7)), 400)}": pick.random() + 0.1 for _ in range(pick.randint(1, 14))}
        if hot:
            own["everywhere"] = pick.random() * 2 + 0.5
        items.append((i, own))
    for i in range(n // 4):
        base = dict(pick.choice(items)[1])
        base[f"t{pick.randint(1, 400)}"] = 0.2 * pick.random()
        items.append((1000 + i, base))
    return items + [(5000, {"alone": 1.0}), (5001, dict(items[0][1])), (5002, dict(items[0][1]))]


@pytest.mark.parametrize("least", [0.3, 0.75, 0.9, 1.0])
@pytest.mark.parametrize("cell", [1024, 7])
def test_similar_pairs_with_a_term_that_all_have(spark, least, cell):
    frame, rows = vectors(spark, hot_items(random.Random(3), 150))
    got = {(x["a"], x["b"]): x["similarity"] for x in similarity.similar_pairs(frame, "id", least, cell).collect()}
    want = {k: v for k, v in cosines(rows).items() if v >= least - 1e-12}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert similarity.similar_pairs(frame.limit(0), "id", least).count() == 0


def test_a_term_that_all_have(spark):
    """With most of everyone's weight it still makes no candidates, as long as it alone makes no pair similar."""
    items = []
    for i, own in hot_items(random.Random(4), 900, hot=False):
        items.append((i, own | {"everywhere": 1.3 * sum(w * w for w in own.values()) ** 0.5}))
    frame, rows = vectors(spark, items)
    found = similarity.entries(similarity.packed(frame, "id"), 0.75).cache()
    hot = found.filter(F.col("term") == F.xxhash64(F.lit("everywhere"))).agg(F.count_if("short").alias("s"), F.count("*").alias("l")).head()
    assert hot["l"] > 1000 and hot["s"] == 0
    near = sum(v >= 0.75 for v in cosines(rows).values())
    assert near <= similarity.candidates(found, 0.75).count() <= 1.5 * near


def test_no_cell_has_many_candidates(spark):
    """Where a hot term makes pairs, no cell, and so no task, has over 5 % of them."""
    pick = random.Random(8)
    frame, _ = vectors(spark, [(i, {"everywhere": 3.0, f"t{i % 40}": 1 + pick.random(), f"s{i}": 0.3}) for i in range(800)])
    found = similarity.entries(similarity.packed(frame, "id"), 0.75)
    cells = [x["count"] for x in similarity.meetings(found, 0.75, 100).groupBy("term", "x", "y").count().collect()]
    assert sum(cells) > 100_000 and max(cells) <= 0.05 * sum(cells)


@pytest.mark.parametrize("seed", [1, 2])
def test_greatest_similarity(spark, seed):
    pick = random.Random(seed)
    docs, doc_rows = vectors(spark, hot_items(pick, 200))
    asked, asked_rows = vectors(spark, [(10_000 + k, v) for k, (_, v) in enumerate(hot_items(pick, 30))] + [(20_000, {"nowhere": 1.0, "everywhere": 0.01}), (20_001, {"nowhere": 1.0})])
    label = lambda df: df.withColumn("label", F.when(F.col("id") % 5 < 3, F.col("id") % 5))
    result, found, scored = similarity.searched(label(asked), "id", "label", label(docs), "label")
    name = lambda i: i % 5 if i % 5 < 3 else None
    by: dict = {}
    for i, t, w in [*doc_rows, *asked_rows]:
        by.setdefault(i, {})[t] = w
    want = {}
    for q in {i for i, _, _ in asked_rows}:
        all_ = [(sum(w * by[d].get(t, 0.0) for t, w in by[q].items()), name(d) == name(q)) for d in by if d < 10_000]
        want[q] = (max(s for s, _ in all_), max([s for s, same in all_ if same], default=0.0))
    got = {x["id"]: (x["max_any"], x["max_same"]) for x in result.collect()}
    assert set(got) == set(want) and all(got[q] == pytest.approx(want[q], abs=1e-12) for q in want)
    assert scored.count() < 0.5 * len(want) * len({i for i, _, _ in doc_rows})


def one_by_one(pairs, original):
    gone = set()
    for a, b, _ in sorted(pairs, key=lambda x: (-x[2], x[0], x[1])):
        if a not in gone and b not in gone and not (original[a] and original[b]):
            gone.add(a if original[b] and not original[a] else b)
    return gone


@pytest.mark.parametrize("seed", range(4))
def test_victims_equal_the_sequential_ones(spark, seed):
    pick = random.Random(seed)
    n = 60
    original = {k: pick.random() < 0.3 for k in range(n)}
    pairs = {(a, b): round(pick.uniform(0.9, 1), 1 if seed == 1 else 3) for a, b in (sorted(pick.sample(range(n), 2)) for _ in range(150))}
    rows = [(a, b, s) for (a, b), s in pairs.items()]
    if seed == 2:  # all alike
        rows = [(a, b, 0.95) for a in range(25) for b in range(a + 1, 25)]
    frame = spark.createDataFrame(rows, "a long, b long, similarity double")
    kinds = spark.createDataFrame(list(original.items()), "id long, is_original boolean")
    got = [x["id"] for x in curation.greedy_victims(frame, "id", kinds).collect()]
    assert len(got) == len(set(got)) and set(got) == one_by_one(rows, original)
    assert curation.greedy_victims(frame.limit(0), "id", kinds).count() == 0


def test_victims_of_a_large_component(spark):
    """A component of 100,000 nodes: each is tied to an earlier one."""
    n = 100_000
    pick = random.Random(9)
    rows = [(pick.randrange(max(1, k // 2)), k, 0.9 + (k * 7919 % 1000) / 10_000) for k in range(1, n)]
    kinds = spark.range(n).select("id", (F.col("id") % 11 == 0).alias("is_original"))
    frame = spark.createDataFrame(__import__("pandas").DataFrame(rows, columns=["a", "b", "similarity"]))
    got = {x["id"] for x in curation.greedy_victims(frame, "id", kinds).collect()}
    assert got == one_by_one(rows, {k: k % 11 == 0 for k in range(n)})


def test_places(spark):
    pick = random.Random(5)
    rows = [(k, pick.choice(["a", "b", None]) if k % 3 else "a", pick.randint(0, 50)) for k in range(3000)] + [(9000, "only", 1)]
    frame = spark.createDataFrame(rows, "id long, label string, v long").repartition(7)
    out = ranks.placed(frame, ["label"], [F.col("v"), F.col("id")])
    assert not [x for x in out._jdf.queryExecution().executedPlan().toString().split("\n") if "Window" in x]
    got = {x["id"]: (x["k"], x["n"]) for x in out.collect()}
    for label in ("a", "b", None, "only"):
        own = sorted((v, i) for i, y, v in rows if y == label)
        assert all(got[i] == (k + 1, len(own)) for k, (_, i) in enumerate(own))
    assert len(got) == len(rows)
    assert ranks.placed(frame.limit(0), ["label"], [F.col("v")]).count() == 0
    everything = ranks.placed(frame, [], [F.col("v"), F.col("id")]).collect()
    assert [x["k"] for x in sorted(everything, key=lambda x: (x["v"], x["id"]))] == list(range(1, 3002))


def test_running_sums(spark):
    pick = random.Random(6)
    rows = list({(pick.choice("xyz"), float(pick.randint(0, 400))): None for _ in range(900)})
    frame = spark.createDataFrame([(g, v, k % 5 + 1) for k, (g, v) in enumerate(rows)], "g string, v double, n long")
    own = {(x["g"], x["v"]): x["n"] for x in frame.collect()}
    for x in ranks.running(frame, ["g"], "v").collect():
        assert x["before"] == sum(n for (g, v), n in own.items() if g == x["g"] and v < x["v"]) and x["total"] == sum(n for (g, _), n in own.items() if g == x["g"])


def test_caps_and_splits_on_a_hot_class(spark):
    frame = spark.range(5000).select("id", F.when(F.col("id") % 10 < 8, "hot").otherwise("cold").alias("label"), (F.col("id") % 100 == 0).alias("keep"))
    out = curation.capped(frame, "label", 30, "id", F.col("keep")).collect()
    by = {label: [x for x in out if x["label"] == label] for label in ("hot", "cold")}
    assert len(by["hot"]) == 50 and all(x["keep"] for x in by["hot"]) and len(by["cold"]) == 30
    split = curation.split_exact(frame, "id", "label", [("x", 0.5), ("y", 0.25), ("z", 0.25)])
    assert {(x["label"], x["split"]): x["count"] for x in split.groupBy("label", "split").count().collect()} == {(a, b): n for a, m in (("hot", 4000), ("cold", 1000)) for b, n in (("x", m // 2), ("y", m // 4), ("z", m // 4))}
    assert np.isclose(split.count(), 5000)


@pytest.mark.parametrize("width", [0, 3, 10])
def test_matched_negatives(spark, width):
    from strandline.operators import structure

    pick = random.Random(width)
    uses = [(g, k, pick.randint(0, 60), pick.choice([None, 0, 10, 20, 30])) for g in "xy" for k in range(60)]
    positives = [(g, k, bound, at) for g, k, at, bound in uses if bound is not None]
    a = spark.createDataFrame(positives, "g string, id long, definition long, use long")
    b = spark.createDataFrame(uses, "g string, other long, at long, bound long")
    got = sorted((x["g"], x["id"], x["at"], x["other"], x["apart"]) for x in structure.matched_negatives(a, b, ["g"], width, 5).collect())
    want = []
    for g, i, d, u in positives:
        own = [(at, k, abs(at - d) - abs(u - d)) for h, k, at, bound in uses if h == g and at != u and bound != d and abs(abs(at - d) - abs(u - d)) <= width]
        want += [(g, i, at, k, apart) for at, k, apart in sorted(own)[:5]]
    assert got == sorted(want) and want
