"""Rewrites keep meaning, bugs don't; noise is deterministic."""

import pytest

from strandline.functions import noise
from strandline.operators import rewrites
from strandline.plans.generated import PROGRAMS

SOURCE = "def f(xs, n):\n    out = [x * 2 for x in xs if x > 1]\n    for k in range(n):\n        n2 = k\n        out.append(k)\n    total = 0\n    for x in out:\n        total += x\n    return total\n"


def value(source):
    names: dict = {}
    exec(source, names)  # our own fixture
    return names["f"]([1, 2, 3], 4)


@pytest.mark.parametrize("kind", sorted(rewrites.REWRITES))
def test_meaning_is_kept(kind):
    new = rewrites.rewritten(SOURCE, kind)
    assert new != SOURCE and value(new) == value(SOURCE)
    assert (rewrites.shape(new) == rewrites.shape(SOURCE)) == (kind == "rename")
    assert rewrites.rewritten("def (", kind) is None and rewrites.rewritten(None, kind) is None


def test_bug_and_body():
    broken, line = rewrites.with_bug(SOURCE)
    assert line == 2 and value(broken) != value(SOURCE)
    assert rewrites.with_bug("x") is None
    assert rewrites.function_body("Sure:\n    a = 1\n    return a\nDone") == "    a = 1\n    return a"
    assert rewrites.function_body("none") is None and rewrites.function_body("    a = (\nx") is None


def test_pairs(spark):
    rows = spark.createDataFrame([(p, s) for _, p, s in PROGRAMS] + [("bad", "def ("), ("none", None)], "program string, source string")
    kinds = {(x["program"], x["kind"]) for x in rewrites.contrast_pairs(rows).collect()}
    assert ("vowels", "expand") in kinds and ("straight", "rename") in kinds and not any(p in ("bad", "none") for p, _ in kinds)


def test_noise():
    assert noise.misspelled("the doctor is in", {"doctor": "docter"}, 1.0, 1, 2) == "the docter is in"
    assert noise.misspelled("the doctor is in", {"doctor": "docter"}, 0.0, 1, 2) == "the doctor is in"
    assert noise.slip("appointment", 1, 2) == noise.slip("appointment", 1, 2) != "appointment" and noise.slip("hi", 1, 2) == "hi"
    for style in noise.STYLES:
        assert noise.styled("Where is the desk?", style, 3, 4)
