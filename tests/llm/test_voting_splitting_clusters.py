"""Latent voting, fill-in-the-middle and ball k-means against plain versions, and on odd tables."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import ball_k_means as B
from strandline.llm import fill_in_middle as M
from strandline.llm import latent_voting as V
from strandline.llm.language_id import held_out

TEXT = "doc_id long, text string"
LABEL = "doc_id long, quality int"


# --- voting


def plain_scores(rows, labels, k=64, neighbours=15, power=8.0, style=1.0):
    """All by loops: rarity, axes, cosines one at a time, votes."""
    bags = [V.terms(t or "") for _, t in rows]
    seen = np.zeros(V.PLACES)
    for at, _ in bags:
        seen[at] += 1
    n = len(bags)
    rarity = np.array([max(0.02, math.log((1 + n) / x) if x else math.log(1 + n)) for x in seen])
    halves = [(at, w.astype(np.float16).astype(float)) for at, w in bags]
    wide = np.stack([V.projected(at, w, V.signs(), rarity, style) for at, w in halves])
    _, axes = np.linalg.eigh(wide.T @ wide)
    space = V.Space(rarity, axes[:, ::-1][:, :k], style)
    own = space.vectors(halves)
    by_id: dict = {}
    for i, q in labels:
        by_id.setdefault(i, set()).add(q)
    known = [(own[j], by_id[i].copy().pop()) for j, (i, _) in enumerate(rows) if i is not None and zlib.crc32(str(i).encode()) % 4 != 2 and len(by_id.get(i, ())) == 1]
    found = []
    for x in own:
        near = sorted((-(x @ y) / max(np.linalg.norm(x) * np.linalg.norm(y), 1e-300), q) for y, q in known)
        last = near[min(neighbours, len(near)) - 1][0]
        votes = [(max(-c, 0.0) ** power, q) for c, q in near if c <= last + 1e-9]
        total = sum(w for w, _ in votes)
        found.append(sum(w * q for w, q in votes) / total if total else np.mean([q for _, q in known]))
    return found


def sentences(pick, n):
    words = ["river", "stone", "Green", "walk", "house", "seven", "of", "the", "and", "light", "Water", "bread"]
    return " ".join(pick.choice(words) for _ in range(n)) + "."


def voting_rows():
    pick = random.Random(4)
    rows = [(i, sentences(pick, pick.randint(5, 60))) for i in range(150)]
    rows += [(200 + i, " ".join([pick.choice(["Ha!!", "LOUD!!", "NOW***"])] * pick.randint(6, 40))) for i in range(60)]
    labels = [(i, 1) for i in range(0, 150, 2)] + [(200 + i, 0) for i in range(0, 60, 2)] + [(1, 0), (1, 1), (None, 0), (3, None), (9999, 1)]
    odd = [(None, rows[3][1]), (-1, None), (-2, ""), (-3, " \n"), (-4, "é ñ 你 😀!!"), (-5, sentences(pick, 30000)), (5, rows[5][1]), (5, rows[5][1]), (5, "NOW*** NOW***")]
    return rows + odd, labels


def test_scores_equal_a_plain_version(spark):
    rows, labels = voting_rows()
    docs = spark.createDataFrame(rows, TEXT).withColumn("at", F.lit("x")).withColumn("quality", F.lit(0)).repartition(5)
    got = V.score(docs, spark.createDataFrame(labels, LABEL).withColumn("text", F.lit("x")), held_out(F.col("doc_id"))).collect()
    want = sorted((str(i), round(s, 6)) for (i, _), s in zip(rows, plain_scores(rows, [x for x in labels if x[0] is not None and x[1] is not None]), strict=True))
    assert sorted((str(x["doc_id"]), round(x["score"], 6)) for x in got) == want
    scores = {x["doc_id"]: x["score"] for x in got}
    assert scores[201] < 0.5 < scores[7] and all(0 <= x <= 1 for x in scores.values())


def test_bounded_and_missing_labels(spark):
    rows, labels = voting_rows()
    docs = spark.createDataFrame(rows, TEXT)
    few = V.score(docs, spark.createDataFrame(labels, LABEL), held_out(F.col("doc_id")), most=30)
    assert few.count() == len(rows)
    none = V.score(docs, spark.createDataFrame([], LABEL), held_out(F.col("doc_id")))
    assert {x["score"] for x in none.collect()} == {0.5}
    one = V.score(docs, spark.createDataFrame([(0, 1)], LABEL), held_out(F.col("doc_id")))
    assert {x["score"] for x in one.collect()} == {1.0}
    assert V.score(docs.limit(0), spark.createDataFrame(labels, LABEL), held_out(F.col("doc_id"))).count() == 0


def test_an_id_with_many_texts_stays_bounded(spark):
    docs = spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("text"))
    features = V.stage(V.featured(docs.withColumn("held_out", F.lit(False))), "terms")
    rarity = V.place_rarity(features)
    space = (rarity.tobytes(), np.ascontiguousarray(V.principal_axes(features, rarity, 8, 1.0)).tobytes(), 1.0)
    known, marks = V.labelled_vectors(features, spark.createDataFrame([(7, 1), (None, 0)], LABEL), space, 50)
    assert len(known) == len(marks) == 50
    V.release(features)


def test_held_out_accuracy(spark, sf_dir):
    folder = sf_dir.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{folder}/{x}.parquet") for x in ("documents", "labels"))
    found = V.score(docs, labels, held_out(F.col("doc_id"))).filter("held_out").join(labels, "doc_id").collect()
    right = [(x["score"] >= 0.7) == (x["quality"] == 1) for x in found]
    assert len(right) > 60 and np.mean(right) > 0.95
    assert np.mean([x["score"] >= 0.7 for x in found if x["quality"] == 1]) > 0.95


# --- fill in the middle


def test_units_keep_every_character(spark):
    text = "Ab c_9  + é😀👍z.\n\n Was? Ja!  Gut.\r\nx"
    rows = [(1, text), (2, ""), (3, "\n"), (4, "😀"), (5, "a")]
    docs = spark.createDataFrame(rows, TEXT)
    for name, grammar in M.UNITS.items():
        got = {x["doc_id"]: x["u"] for x in docs.select("doc_id", M.units(F.col("text"), grammar).alias("u")).collect()}
        assert all("".join(got[i]) == t for i, t in rows) and all(all(x) for x in got.values()), name
    cut = lambda name: docs.filter("doc_id = 1").select(M.units(F.col("text"), M.UNITS[name])).head()[0]
    assert cut("character") == list(text)
    assert cut("line") == ["Ab c_9  + é😀👍z.\n", "\n", " Was? Ja!  Gut.\r\n", "x"]
    assert cut("word")[:4] == ["Ab ", "c_9  ", "+ ", "é😀👍z.\n\n "]
    assert cut("sentence") == ["Ab c_9  + é😀👍z.", "\n", "\n", " Was?", " Ja!", "  Gut.", "\r\n", "x"]
    assert cut("token")[:8] == ["Ab", " ", "c_9", "  ", "+", " ", "é", "😀"]


def plain_fim(i, text):
    text = text or ""
    h = [int(x, 16) for x in (lambda s: [s[k : k + 8] for k in range(0, 32, 8)])(hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest())]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(x in text for x in M.MARKS) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return n, "spm", p, m, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", p, m, f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle_equals_a_plain_version(spark):
    pick = random.Random(1)
    alphabet = "abc <>PSM\n\r\t.é你😀 \x00"
    rows = [(i, "".join(pick.choice(alphabet) for _ in range(pick.randint(0, 40)))) for i in range(-20, 300)]
    rows += [(None, "no id"), (None, None), (400, None), (401, ""), (402, "x" * 200_000), (403, "a<P>b"), (404, "<S"), (404, "<S"), (405, "<M>")]
    docs = spark.createDataFrame(rows, TEXT).withColumn("n", F.lit("clash")).withColumn("form", F.lit(1))
    out = M.fill_in_middle(docs).withColumn("back", M.restored(F.col("output"), F.col("form")))
    got = sorted(((x["doc_id"] is None, x["doc_id"] or 0, x["back"]), (x["n"], x["form"], x["prefix"], x["middle"], x["output"])) for x in out.collect())
    assert got == sorted(((i is None, i or 0, t or ""), plain_fim(i, t)) for i, t in rows)
    assert {x[1][1] for x in got} == {"plain", "psm", "spm"}
    assert M.fill_in_middle(docs.limit(0)).count() == 0


@pytest.mark.parametrize("grammar", list(M.UNITS))
def test_other_grammars_give_the_text_back(spark, grammar):
    docs = spark.createDataFrame([(i, f"def f{i}(x):\n    return x + {i}  # Why? So. Done!\n\n") for i in range(60)], TEXT)
    out = M.fill_in_middle(docs, grammar).withColumn("back", M.restored(F.col("output"), F.col("form")))
    assert {(x["doc_id"], x["back"]) for x in out.collect()} == {(x["doc_id"], x["text"]) for x in docs.collect()}
    assert out.filter("form <> 'plain' and concat(prefix, middle, suffix) = back").count() == out.filter("form <> 'plain'").count() > 40


# --- clusters


def plain_k_means(rows, k, rounds, dims):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)
    centres = [v for _, v in order[:k]]
    away = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v: min((away(v, c), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        at = [nearest(v)[1] for _, v in kept]
        for j in range(len(centres)):
            own = [v for (_, v), a in zip(kept, at, strict=True) if a == j]
            if own:
                centres[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    last = [nearest(v) for _, v in kept]
    total = sum(d for d, _ in last)
    return sorted((str(i), j, d, sum(x for x, y in last if y == j), total, B.digest(centres[j])) for (i, _), (d, j) in zip(kept, last, strict=True))


def clusters(df):
    return sorted((str(x["vec_id"]), x["cluster"], x["distance"], x["cluster_inertia"], x["inertia"], x["centroid_sha256"]) for x in df.collect())


@pytest.mark.parametrize("rounds", [0, 1, 5])
def test_k_means_equals_a_plain_version(spark, rounds):
    pick = random.Random(rounds)
    spots = [[pick.uniform(-3, 3) for _ in range(8)] for _ in range(9)]
    rows = [(i, [x + pick.gauss(0, 0.15) for x in pick.choice(spots)]) for i in range(400)]
    rows += [(1000 + i, [0.25] * 8) for i in range(50)]  # copies
    rows += [(2000 + i, [float(pick.randint(-1, 1)) for _ in range(8)]) for i in range(120)]  # ties
    rows += [(3000, None), (3001, []), (3002, [1.0] * 7), (3003, [None] * 8), (3004, [math.nan] * 8), (3005, [math.inf] * 8), (None, [0.5] * 8), (7, rows[7][1]), (7, spots[0]), (3006, [0.0] * 8), (3007, [-0.0] * 8), (3008, [500000.0] * 8)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cluster", F.lit("x")).withColumn("v", F.lit(1)).repartition(3)
    assert clusters(B.ball_k_means(table, k=12, rounds=rounds, dims=8)) == plain_k_means(rows, 12, rounds, 8)


def test_few_and_no_vectors(spark):
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [-4.0, 0.5])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert clusters(B.ball_k_means(table, k=40, dims=2)) == plain_k_means(rows, 40, 5, 2)
    empty = B.ball_k_means(table.limit(0), dims=2)
    assert empty.count() == 0 and empty.columns == B.ball_k_means(table, dims=2).columns
    with pytest.raises(Exception, match="would not fit a long"):
        B.ball_k_means(spark.createDataFrame([(1, [6e5, 0.0])], "vec_id long, embedding array<double>"), dims=2).count()


def test_balls_compare_few_neighbours():
    """Well separated clusters: members compare little more than their own centre, and get what a full search gets."""
    random_ = np.random.default_rng(2)
    centres = random_.integers(-4000, 4000, (40, 16))
    at = random_.integers(0, 40, 5000).astype(np.int32)
    rows = centres[at] + random_.integers(-300, 300, (5000, 16))
    radii = [float(np.sqrt(B.squared(rows[at == k], centres[k]).max())) for k in range(40)]
    balls = B.Balls(centres, radii)
    got = balls.reassign(rows, at)
    want = B.nearest_of_all(rows, centres)
    assert np.array_equal(got[0], want[0]) and np.array_equal(got[1], want[1])
    assert balls.compared < 2 * len(rows) < 40 * len(rows)
    assert max(len(x) for x in balls.neighbours) < 39
