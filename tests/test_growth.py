"""Work that grows with the input and no faster: what plans hold, and results beside it."""

from pyspark.sql import functions as F


def plan(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_keys_are_read_once(spark):
    from strandline.functions import text as T
    from strandline.operators.pipelines import cleaned

    rows = spark.createDataFrame([(1, "A  b.", "x"), (2, "a B", "x"), (2, "a B", "x"), (3, "c", "x"), (4, "C!", "y"), (5, " ", "x"), (6, None, "y"), (None, "d", "y"), (7, "e", "z")], "id long, text string, label string")
    kept, report = cleaned(rows, ["x", "y"], "id")
    assert "lower(" not in plan(report)
    assert {tuple(x) for x in report.collect()} == {("read", 9), ("with_values", 7), ("known_label", 6), ("without_conflicts", 4), ("kept", 2)}
    assert {tuple(x) for x in kept.collect()} == {("A  b.", "x", 1), ("d", "y", None)}
    assert plan(rows.select(T.dedup_key(F.col("text")).alias("key"))).count("RLIKE") == 1


def test_keys_of_odd_texts(spark):
    from strandline.functions import text as T

    texts = ["A\x01b", "a\xa0b", "a -  b", "ΑΣ’ΑΣ ‘x”", "ﬁ—é", "\x85", "a_b9", None, "don’t", "😀 b", "é‍b"]
    rows = spark.createDataFrame([(x,) for x in texts], "text string")
    steps = T.collapse(F.regexp_replace(F.lower(T.clean(F.col("text"))), r"[^\p{L}\p{M}\p{N}_\s]", ""))
    for key, by_steps in rows.select(T.dedup_key(F.col("text")), steps).collect():
        assert key == by_steps


def test_programs_are_dealt(spark):
    """A small file of many programs isn't one task's work, and each rewrite is what it is by itself."""
    from strandline.operators import rewrites, structure
    from strandline.plans.generated import PROGRAMS

    sources = [(p, s) for _, p, s in PROGRAMS] + [("bad", "def ("), ("none", None), ("u", "def f(x):\n    é = [a for a in x]\n    é += [1]\n    return é, 1.0, 'q', x.b\n")]
    rows = spark.createDataFrame(sources, "program string, source string").coalesce(1)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for frame in (rewrites.contrast_pairs(rows), rewrites.injected_bugs(rows), structure.program_names(rows), structure.program_graph(rows)):
        assert frame.rdd.getNumPartitions() == parts
    expected = set()
    for program, source in sources:
        for kind in rewrites.REWRITES:
            new = rewrites.rewritten(source, kind)
            if new is not None and (rewrites.shape(source) == rewrites.shape(new)) == (kind == "rename"):
                expected.add((program, kind, new))
    assert {(x["program"], x["kind"], x["rewritten"]) for x in rewrites.contrast_pairs(rows).collect()} == expected
    starts = {x["start"] for x in structure.program_names(rows).filter("program = 'u' and name = 'é'").collect()}
    assert starts == {14, 37, 57}


def test_printed_as_c_does(spark):
    from strandline.operators.stats import shown

    rows = spark.createDataFrame([(4456.25,), (4456.75,), (0.15,), (2.5,), (-0.05,), (None,), (float("nan"),)], "x double")
    assert [x[0] for x in rows.select(shown(F.col("x"), 1)).collect()] == ["4456.2", "4456.8", "0.1", "2.5", "-0.1", "--", "--"]


def test_quoted_csv_is_read_by_many_tasks(spark, tmp_path):
    from strandline.sources import files, sinks

    rows = spark.range(100).select("id", F.concat(F.lit('a\n"'), F.col("id").cast("string")).alias("text")).coalesce(1)
    sinks.write_csv(rows, f"{tmp_path}/x", quote_all=True, rows_a_file=10)
    assert len(list((tmp_path / "x").glob("part-*"))) == 10
    assert {tuple(x) for x in files.csv_literal(spark, f"{tmp_path}/x", "id long, text string").collect()} == {(k, f'a\n"{k}') for k in range(100)}


def test_first_texts_without_sorting_a_class(spark):
    import pytest

    from strandline.operators.generators import unique_utterances

    words = [f"w{k}" for k in range(50)]
    data = [(x, w.upper() + "!") for x in ("a", "b") for w in words] + [("a", w) for w in words] + [(None, "x"), (None, "y"), (None, "z")]
    rows = spark.createDataFrame(data, "kind string, text string")
    out = unique_utterances(rows, "kind", "text", 3)
    # no window has all of a class's texts: what is ranked are those that were chosen
    assert plan(out).count("Window [") == 1 and "Join" in plan(out)
    from strandline.functions.prng import uniform

    keys = [x[0] for x in spark.createDataFrame([(w,) for w in words], "w string").orderBy(uniform(42, F.col("w")), "w").limit(3).collect()]
    found = {tuple(x) for x in out.collect()}
    assert found == {(x, w.upper() + "!") for x in ("a", "b") for w in keys} | {(None, "x"), (None, "y"), (None, "z")}
    with pytest.raises(Exception, match="too few different texts"):
        unique_utterances(rows, "kind", "text", 4).collect()


def test_usual_change_is_no_window(spark):
    from strandline.operators.structure import normalised_profile

    rows = spark.createDataFrame([("a", 0, 1.0, 2.0), ("a", 0, 3.0, None), ("a", 1, 4.0, 4.0), ("b", 0, 5.0, None), (None, 0, 1.0, None), (None, 0, 2.0, 0.5)], "model string, layer int, dist double, delta double")
    out = normalised_profile(rows)
    assert "Window" not in plan(out)
    found = {(x[0], x[1]): round(x[2], 6) for x in out.collect()}
    assert found == {("a", 0): 0.75, ("a", 1): 1.0, ("b", 0): 5.0, (None, 0): 3.0}


def test_candidates_of_families_are_dealt(spark):
    from strandline.operators.generators import template_variants

    families = spark.range(20).select(F.col("id").alias("family")).coalesce(1)
    out = template_variants(families, "{a} and {b}", {"a": (1, 5), "b": (1, 5)}, "a + b", n=2, tries=30)
    assert "RepartitionByExpression [family" in plan(out)
    assert out.groupBy("family").count().filter("count = 2").count() == 20


def test_blanks_and_numbers_of_noise(spark):
    import numpy as np

    from strandline.functions import perturb as P
    from strandline.operators.dealing import text_batches

    text = "a\u3000b \x85c\u2003d\U0001f600e"
    noisy = P.char_noise(text, 1.0, 3, 42)
    assert [k for k, c in enumerate(noisy) if c.isspace()] == [k for k, c in enumerate(text) if c.isspace()]
    assert P.numbers(1, 2, 5) is P.numbers(1, 2, 5) and np.array_equal(P.numbers(1, 2, 5), P.numbers(1, 2, 9)[:5])
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(name)
    try:
        spark.conf.set(name, "10000")
        text_batches(spark)
        assert spark.conf.get(name) == "2000"
        spark.conf.set(name, "77")
        text_batches(spark)
        assert spark.conf.get(name) == "77"
    finally:
        spark.conf.set(name, was)


def test_keywords_clean_a_text_once(spark):
    from strandline.operators.routing import has_keyword

    rows = spark.createDataFrame([("a ***",), ("B\x01$$",), (None,), ("ﬁ",), ("none",)], "text string")
    out = rows.select(has_keyword(F.col("text"), ["***", "b $$", "fi"]).alias("flagged"))
    assert plan(out).count("translate(") == 1
    assert [x[0] for x in out.collect()] == [True, True, False, True, False]
    assert [x[0] for x in rows.select(has_keyword(F.col("text"), [])).collect()] == [False] * 5


def test_characters_are_counted_without_arrays(spark):
    from strandline.functions import grading as G

    data = [("aab\n", "ba\nc"), ("😀é", "é😀x"), (None, "a"), ("", ""), ("abc", "xyz")]
    rows = spark.createDataFrame(data, "a string, b string")
    out = rows.select(G.char_f1(F.col("a"), F.col("b")).alias("f"), G.overlap_f1(G.characters(F.col("a")), G.characters(F.col("b"))).alias("g"))
    assert "array_sort" not in plan(out.select("f")) and "regexp_extract_all" not in plan(out.select("f"))
    assert [round(x[0], 9) for x in out.collect()] == [round(x[1], 9) for x in out.collect()] == [0.75, 0.8, 0.0, 0.0, 0.0]
