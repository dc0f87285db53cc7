"""The search for the nearest text against a plain version, and the leakage query against its SQL."""

import math
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from strandline.operators import curation as C
from strandline.operators.nearest_texts import nearest_texts
from strandline.plans import catalog


def plain(items, docs):
    """{item: (any, same)} by whole vectors; the label is the id's remainder by 3."""
    words = lambda x: re.findall(r"[^\W_]+", (x or "").lower())
    texts, asked, df = {}, {}, {}
    for into, rows in ((texts, docs), (asked, items)):
        for i, text in rows:
            for w in words(text):
                own = into.setdefault(i, {})
                own[w] = own.get(w, 0) + 1
    for own in texts.values():
        for w in own:
            df[w] = df.get(w, 0) + 1

    def vector(own):
        weights = {w: (1 + math.log(tf)) * (math.log((1 + len(docs)) / (1 + df[w])) + 1) for w, tf in own.items() if w in df}
        size = math.sqrt(sum(x * x for x in weights.values()))
        return {w: x / size for w, x in weights.items()}

    vectors = {i: vector(own) for i, own in texts.items()}
    out = {}
    for i in {i for i, _ in items}:
        own = vector(asked.get(i, {})) if i is not None else {}
        all_ = {d: sum(x * v.get(w, 0.0) for w, x in own.items()) for d, v in vectors.items()}
        out[i] = (max(all_.values(), default=0.0), max((s for d, s in all_.items() if d is not None and i is not None and d % 3 == i % 3), default=0.0))
    return out


def tables(seed):
    pick = random.Random(seed)
    text = lambda: " ".join(f"w{min(int(pick.paretovariate(0.6)), 300)}{pick.choice(['', '', '.', ' É1'])}" for _ in range(pick.randint(0, 25)))
    docs = [(k, text() if k != 7 else "W1 alike É1, w1") for k in range(120)] + [(5, text()), (5, None), (None, text()), (None, text()), (200, None), (201, "")]
    items = [(1000 + k, text()) for k in range(15)] + [(1003, text()), (None, text()), (1100, "nowhere at-all"), (1101, "..."), (1102, None), (1103, docs[7][1])]
    return items, docs


@pytest.mark.parametrize(("known", "entries"), [(2_000_000, 2_000_000), (5, 40), (1, 2_000_000)])
def test_nearest_texts(spark, known, entries):
    items, docs = tables(known)
    frame = lambda rows: spark.createDataFrame(rows, "id long, text string").withColumn("label", F.col("id") % 3).repartition(3)
    search = lambda a, b: {x["id"]: (x["max_any"], x["max_same"]) for x in nearest_texts(a, "id", "label", b, "id", "label", "text", C.words(F.col("text")), known, entries).collect()}
    got, want = search(frame(items), frame(docs)), plain(items, docs)
    assert set(got) == set(want) and all(got[i] == pytest.approx(want[i], abs=1e-12) for i in want)
    assert got[1103] == pytest.approx((1.0, want[1103][1])) and got[1100] == got[1101] == got[None] == (0.0, 0.0)
    none = frame(docs).limit(0)
    assert set(search(frame(items), none).values()) == {(0.0, 0.0)} and search(none, frame(docs)) == {}


def test_leakage_report_is_its_sql(spark, tmp_path):
    """Items without a word, or with none that a document has, have a row, too."""
    items, docs = tables(3)
    for name, rows, kind in (("documents", [x for x in docs if x[0] is not None], "doc_id long, text string"), ("benchmark", [x for x in items if x[0] is not None], "item_id long, text string")):
        spark.createDataFrame(rows, kind).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = {x[0]: x[1:] for x in con.execute(catalog.SQL["leakage_report"]).fetchall()}
    got = {x["item_id"]: (x["max_any"], x["max_same"]) for x in catalog.QUERIES["leakage_report"](spark, str(tmp_path)).collect()}
    assert {1100, 1101, 1102} <= set(got) == set(want)
    assert all(got[i] == pytest.approx(want[i], abs=2e-8) for i in want)
