"""Fill-in-the-middle texts by lookaround splitting.

A unit grammar says between which neighbouring characters a unit ends. It is
translated to a regex that matches the empty place between them, looking back
at one class and ahead at another; Spark's ``split`` at that regex gives the
units without losing a character. A text is cut before two units chosen by a
hash of its id into prefix, middle and suffix, which are put into another order
behind marks. Everything is a column expression.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ANY, BLANK, WORD, OTHER = r"\x{0}-\x{10FFFF}", r"\s", r"\w", r"\w\s"
#: Unit grammars: pairs of classes, the insides of brackets; a unit ends between a character of the first and one of
#: the second.
UNITS: dict[str, list[tuple[str, str]]] = {
    "character": [(ANY, ANY)],
    "word": [(BLANK, "^" + BLANK)],
    "line": [(r"\n", ANY)],
    # blanks open the next sentence
    "sentence": [(".!?", BLANK), ("。！？", "^。！？"), (r"\n", ANY)],
    # a word, a run of blanks, or any other character
    "token": [(WORD, "^" + WORD), ("^" + WORD, WORD), (BLANK, "^" + BLANK), ("^" + BLANK, BLANK), ("^" + OTHER, "^" + OTHER)],
}
MARKS = ("<P>", "<S>", "<M>")


def boundary(grammar: Sequence[tuple[str, str]]) -> str:
    """The zero-width regex of a grammar. Start and end of a text are no boundaries, as nothing stands there."""
    return "|".join(f"(?<=[{left}])(?=[{right}])" for left, right in grammar)


def units(text: Column, grammar: Sequence[tuple[str, str]]) -> Column:
    """The units of a text, which joined give the text; of an empty text none."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, boundary(grammar), -1))


def draw(seed: Column, k: int) -> Column:
    """The k-th of the 32-bit numbers in a hexadecimal digest."""
    return F.conv(F.substring(seed, 8 * k + 1, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, grammar: str = "character", salt: str = "1:", plain_percent: int = 10, spm_percent: int = 20, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """doc_id, n, form, prefix, middle, suffix, output of every whole text of ``docs`` (doc_id, text).

    ``n`` counts the units. The smaller of two numbers drawn from 0 to n is
    the number of units before the middle, the larger those before the
    suffix; the draws follow from sha256 of ``salt`` and the id. Form
    ``plain``: the output is the text, and prefix, middle and suffix are null;
    so are empty texts, texts that hold a mark, and ``plain_percent`` of the
    others by a third draw. ``spm_percent`` of the rest by a fourth have the
    suffix first. A null text counts as empty, a null id as the empty id;
    repeated rows give equal rows, an empty table none, extra columns change
    nothing. A row's units are one array in memory, of 16 to 24 bytes each
    besides the text.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    seed = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    cut = rows.select("doc_id", "text", seed.alias("seed"), units(F.col("text"), UNITS[grammar]).alias("units")).withColumn("n", F.size("units").cast("long"))
    first, second = (draw(F.col("seed"), k) % (F.col("n") + 1) for k in (0, 1))
    plain = (F.col("text") == "") | (draw(F.col("seed"), 2) % 100 >= 100 - plain_percent)
    for mark in marks:
        plain |= F.contains(F.col("text"), F.lit(mark))
    form = F.when(plain, "plain").when(draw(F.col("seed"), 3) % 100 < spm_percent, "spm").otherwise("psm")
    cut = cut.select("doc_id", "text", "units", "n", form.alias("form"), F.least(first, second).cast("int").alias("a"), F.greatest(first, second).cast("int").alias("b"))
    piece = lambda start, length: F.when(F.col("form") != "plain", F.concat_ws("", F.slice("units", start, length)))
    cut = cut.select("doc_id", "text", "n", "form", piece(F.lit(1), F.col("a")).alias("prefix"), piece(F.col("a") + 1, F.col("b") - F.col("a")).alias("middle"), piece(F.col("b") + 1, F.col("n").cast("int") - F.col("b")).alias("suffix"))
    p, s, m = (F.lit(x) for x in marks)
    psm = F.concat(p, "prefix", s, "suffix", m, "middle")
    spm = F.concat(s, "suffix", p, "prefix", m, "middle")
    return cut.select("doc_id", "n", "form", "prefix", "middle", "suffix", F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", psm).otherwise(spm).alias("output"))


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output was made of, from output and form alone.

    No text with a mark has the form ``psm`` or ``spm``, so the output has each
    mark once: a mark can't arise where text meets a mark, provided that no
    mark ends as another begins.
    """
    parts = F.split(output, "|".join(re.escape(x) for x in marks), -1)
    at = lambda k: F.get(parts, F.lit(k))
    return F.when(form == "plain", output).when(form == "psm", F.concat(at(1), at(3), at(2))).otherwise(F.concat(at(2), at(3), at(1)))
