"""Tasks on programs, the second pipeline, the full cleaning report and styles."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandline.functions import noise, perturb
from strandline.operators import downstream, pipelines

SUM = "def total(xs):\n    t = 0\n    for x in xs:\n        t = t + x\n    return t\n"
FLAT = "def flat(a):\n    return a\n"
PROGRAMS = [("p", "total", SUM, SUM.replace("t + x", "t - x"), 4), ("q", "flat", FLAT, None, None)]
SCHEMA = "program string, entry string, source string, buggy string, buggy_line int"


def test_prompts_of_tasks(spark):
    rows = {(x["program"], x["task"]): x for x in downstream.task_prompts(spark.createDataFrame(PROGRAMS, SCHEMA)).collect()}
    assert {t for p, t in rows if p == "p"} == {"program_repair", "code_completion", "code_summarization", "code_translation"} and {t for p, t in rows if p == "q"} == {"code_summarization"}
    assert rows["p", "code_completion"]["shown"] == SUM.replace("    return t\n", "") and rows["p", "program_repair"]["shown"] == PROGRAMS[0][3]
    assert all(x["prompt"].startswith(downstream.INSTRUCTIONS[x["task"]] + "\n\n" + x["shown"]) for x in rows.values())


@pytest.mark.parametrize(
    ("answer", "want"),
    [
        (f"Sure:\n```python\n{SUM}```\nThat is it.", SUM.rstrip()),
        ("def other():\n    pass\n" + SUM + "print(total([1]))\n", SUM.rstrip()),
        ("no code here", None),
        ("def total_of(x):\n    return 1", None),
        ("def total(x): return 1", "def total(x): return 1"),
        (None, None),
    ],
)
def test_function_text(spark, answer, want):
    row = spark.createDataFrame([(answer, "total")], "a string, e string").select(downstream.function_text(F.col("a"), F.col("e"))).head()
    assert row[0] == want


def test_suite_of_tasks(spark):
    def answer(prompts: pd.Series) -> pd.Series:
        def one(p):
            if p.startswith(downstream.INSTRUCTIONS["program_repair"]):
                return f"```\n{SUM}```"
            if p.startswith(downstream.INSTRUCTIONS["code_completion"]):
                return "    return t\n"
            if p.startswith(downstream.INSTRUCTIONS["code_summarization"]):
                return "the total" if "total" in p else "nothing"
            return "I can't"

        return prompts.map(one)

    def tests(entries: pd.Series, sources: pd.Series) -> pd.Series:
        return pd.Series([bool(s) and s.rstrip() == SUM.rstrip() for s in sources])

    surprisals = spark.createDataFrame([("p", 1, 0.1), ("p", 4, 2.0), ("p", 4, 3.0), ("p", 5, 2.5), ("q", 1, 9.0)], "program string, line int, nll double")
    out = {x["task"]: (x["score"], x["n"]) for x in downstream.suite_scores(spark.createDataFrame(PROGRAMS, SCHEMA), surprisals, answer, tests, "m").collect()}
    assert out == {"bug_localization": (1.0, 1), "program_repair": (1.0, 1), "code_completion": (1.0, 1), "code_summarization": (pytest.approx((2 * 0.5 * 1 / 1.5) / 2), 2), "code_translation": (0.0, 1)}


def test_helpdesk(spark):
    rows = [(1, "Where is the desk?", None), (2, "डेस्क कहाँ है?", None), (3, " \n", None), (4, None, None), (5, "chest pain", None), (6, "hm", None), (7, "wo ist es", "de")]
    messages = spark.createDataFrame(rows, "id long, text string, lang string")
    seen = []

    def to_english(texts: pd.Series, languages: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else "where is the desk" for t in texts])

    def from_english(texts: pd.Series, languages: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else f"[{x}] {t}" for t, x in zip(texts, languages, strict=True)])

    predict = F.struct(F.when(F.contains("english", F.lit("desk")), "desk").otherwise("other").alias("intent"), F.when(F.contains("english", F.lit("desk")), 0.9).otherwise(0.2).alias("confidence"))
    templates = spark.createDataFrame([("desk", "neutral", 1, "There."), ("urgent", "neutral", 1, "Help comes."), ("fallback", "neutral", 1, "Sorry?")], "intent string, mood string, ordinal int, response string")
    out = pipelines.helpdesk(messages, "text", predict, F.lit("sad"), templates, "urgent", ["chest pain"], 0.5, to_english, from_english, "lang")
    got = {x["id"]: (x["language"], x["status"], x["response"]) for x in out.collect()}
    assert got == {1: ("en", "answered", "There."), 2: ("hi", "answered", "[hi] There."), 3: ("en", "empty", None), 4: ("en", "empty", None), 5: ("en", "override", "Help comes."), 6: ("en", "low_confidence", "Sorry?"), 7: ("de", "answered", "[de] There.")}
    plain = pipelines.helpdesk(messages, "text", predict, F.lit("sad"), templates, "urgent", [], 0.5)
    assert {x["id"]: x["response"] for x in plain.collect()}[2] == "Sorry?" and seen == []


def test_cleaned_in_full(spark):
    rows = spark.createDataFrame([(k, f"text number {k // 2}", "ab"[k % 8 // 4]) for k in range(160)] + [(900, "text number 1", "b"), (901, None, "a"), (902, "x", "made_up")], "id long, text string, label string")
    kept, report = pipelines.cleaned_in_full(rows, ["a", "b"], "id", [("train", 0.7), ("validation", 0.15), ("test", 0.15)])
    out = {(x["section"], x["name"]): x["value"] for x in report.collect()}
    assert out["check", "read"] == 163 and out["check", "kept"] == 79 == kept.count()
    assert out["class", "a"] == 39 and out["class", "b"] == 40 and out["ratio", "largest to smallest"] == 40 / 39 and out["weight", "a"] == 1
    assert out["words", "mean_words"] == 3 and sum(v for (s, _), v in out.items() if s == "split") == 79 and not [k for k in out if k[0] == "shared"]
    assert kept.filter("ord % 2 = 1").count() == 0


def test_styles_by_label(spark):
    assert len(noise.STYLES) == 9
    rows = spark.range(300).select("id", F.lit("Can you help because I want to leave?").alias("t"), F.when(F.col("id") % 2 == 0, "social").otherwise("urgent").alias("label"))
    weights = dict.fromkeys(noise.STYLES, 1.0)
    factors = {"social": {"urgent": 0, "long": 0, "short": 0}, "urgent": {"urgent": 30}}
    out = [(x["label"], x["s"]) for x in rows.select("label", noise.style(F.col("t"), F.col("id"), weights, 1, F.col("label"), factors).alias("s")).collect()]
    hasty = lambda s: any(s.startswith(x) for x in noise.URGENT[0]) or any(s.endswith(x) for x in noise.URGENT[1])
    told = lambda s: any(s.startswith(x) for x in noise.LONG[0])
    assert not [s for x, s in out if x == "social" and (hasty(s) or told(s))] and sum(hasty(s) for x, s in out if x == "urgent") > 90
    assert any("u help cuz i wanna" in s for _, s in out)
    with pytest.raises(ValueError, match="unknown"):
        noise.style(F.col("t"), F.col("id"), weights, 1, F.col("label"), {"x": {"none": 1}})


def test_code_points():
    text = "aé😀 \t x\ud800"
    assert perturb.from_points(perturb.code_points(text)) == text
    assert perturb.char_noise("ab cd\n😀", 1.0, 1, 2)[2] == " " and perturb.char_noise("ab cd\n😀", 1.0, 1, 2)[5] == "\n"
    assert perturb.homoglyph("ace 1é", 1.0, 1, 2) == "асе 1é" and perturb.homoglyph("", 1.0, 1, 2) == ""
