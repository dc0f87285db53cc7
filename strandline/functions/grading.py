"""Answers: extraction from free text, grading, and overlap scores."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: What marks an answer, and numbers with and without thousands marks.
MARKER = r"(?i)(?:final\s+answer|answer)\s*[:=]\s*(.+)"
NUMBER = r"-?\d{1,3}(?:,\d{3})+(?:\.\d+)?|-?\d+(?:\.\d+)?"


def normal_answer(text: Column) -> Column:
    text = F.regexp_replace(F.lower(F.trim(text)), r"[^\p{L}\p{M}\p{N}_\s]", "")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def extract_answer(raw: Column, kind: Column) -> Column:
    """The answer in a text by type: the last number, the first lone letter A to D, or the first line.

    It is looked for after a marker if there is one, to that line's end; a
    number or letter that isn't there, in the whole text. A comma is part of a
    number only as a thousands mark. Null where nothing is found; a first line
    of punctuation alone is an empty answer. An unknown type is an error.
    """
    raw = F.trim(F.regexp_replace(raw, r"^\s+|\s+$", ""))
    marked = F.trim(F.nullif(F.regexp_extract(raw, MARKER, 1), F.lit("")))
    region = F.coalesce(marked, raw)
    last = lambda text: F.replace(F.try_element_at(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)), F.lit(-1)), F.lit(","), F.lit(""))
    letter = lambda text: F.nullif(F.regexp_extract(F.upper(text), r"\b([A-D])\b", 1), F.lit(""))
    line = normal_answer(F.split(region, "\n")[0])
    return F.when(kind == "numeric", F.coalesce(last(region), last(raw))).when(kind == "mcq", F.coalesce(letter(region), letter(raw))).when(kind == "exact", line).when(kind.isNotNull(), F.raise_error(F.concat(F.lit("unknown answer type: "), kind)).cast("string"))


def grade(answer: Column, gold: Column, kind: Column, tolerance: float = 1e-6) -> Column:
    """Whether an answer is right; null or unreadable is wrong."""
    number = lambda x: F.replace(F.trim(x), F.lit(","), F.lit("")).try_cast("double")
    numeric = F.abs(number(answer) - number(gold)) < tolerance
    right = F.when(kind == "numeric", numeric).when(kind == "mcq", F.upper(F.trim(answer)) == F.upper(F.trim(gold))).otherwise(normal_answer(answer) == normal_answer(gold))
    return F.coalesce(right, F.lit(False))


def parse_letters(raw: Column) -> Column:
    """Up to three letters A to F that a text begins with, after what are no letters."""
    return F.regexp_extract(F.upper(F.regexp_replace(raw, r"\s+", "")), r"^[^\p{L}]*([A-F]{0,3})", 1)


def parse_status(raw: Column) -> Column:
    text = F.upper(raw)
    return F.when(text.rlike(r"NOT[\s_]*AMBIGUOUS"), "NOT_AMBIGUOUS").when(text.rlike("AMBIGUOUS"), "AMBIGUOUS")


def parse_choice(raw: Column) -> Column:
    """A or B after ``answer =``, else the first that stands alone (an article counts too)."""
    text = F.upper(raw)
    return F.coalesce(F.nullif(F.regexp_extract(text, r"ANSWER\s*=\s*([AB])", 1), F.lit("")), F.nullif(F.regexp_extract(text, r"\b([AB])\b", 1), F.lit("")))


def overlap_f1(left: Column, right: Column) -> Column:
    """F1 of two arrays as multisets; 0 if either is empty or they share nothing.

    Both are sorted together and counted in one pass, so the work grows with
    their length and not with their pairs.
    """
    tagged = lambda array, side: F.transform(array, lambda x: F.struct(x.alias("x"), F.lit(side).alias("side")))
    state = lambda x, l, r, s: F.struct(x.alias("x"), l.alias("l"), r.alias("r"), s.alias("s"))  # noqa: E731, E741
    zero = F.lit(0)

    def add(done: Column, e: Column) -> Column:
        left, right = F.when(e["side"] == 0, 1).otherwise(0), F.when(e["side"] == 1, 1).otherwise(0)
        same = done["x"] == e["x"]
        return F.when(same, state(done["x"], done["l"] + left, done["r"] + right, done["s"])).otherwise(state(e["x"], left, right, done["s"] + F.least(done["l"], done["r"])))

    start = state(F.lit("").cast("string"), zero, zero, zero)
    shared = F.aggregate(F.array_sort(F.concat(tagged(left, 0), tagged(right, 1))), start, add, lambda done: done["s"] + F.least(done["l"], done["r"]))
    return F.when((F.size(left) == 0) | (F.size(right) == 0), 0.0).otherwise(F.lit(2.0) * shared / (F.size(left) + F.size(right)))


def characters(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?s)."), F.lit(0))


@F.pandas_udf(LongType())
def shared_characters(a: pd.Series, b: pd.Series) -> pd.Series:
    """Characters that two texts share as multisets, counted without an array of them."""
    return pd.Series([(Counter(x) & Counter(y)).total() for x, y in zip(a, b, strict=True)], dtype="int64")


def char_f1(prediction: Column, gold: Column) -> Column:
    x, y = (F.coalesce(c, F.lit("")) for c in (prediction, gold))
    lengths = F.length(x) + F.length(y)
    return F.when((x == "") | (y == ""), 0.0).otherwise(F.lit(2.0) * shared_characters(x, y) / lengths)


def rouge1(prediction: Column, gold: Column) -> Column:
    words = lambda x: F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit("[a-z]+"), F.lit(0))
    return overlap_f1(words(prediction), words(gold))


def letters_prompt(sequence: Column, shots: Column) -> Column:
    """Shots, then the sequence whose end is asked for."""
    return F.concat_ws("\n", shots, F.concat(F.lit("Sequence: "), sequence, F.lit("\nNext: ")))


def answer_prompt(header: str, prefix: Column, shots: Column) -> Column:
    """A header, shots (an array of structs prefix and answer) with their answers, then the sequence that is asked for."""
    shown = F.array_join(F.transform(shots, lambda x: F.concat(F.lit("Sequence: "), x["prefix"], F.lit("\nAnswer: "), x["answer"], F.lit("\n\n"))), "")
    return F.concat(F.lit(header + "\n"), shown, F.lit("Sequence: "), prefix, F.lit("\nAnswer:"))


def sense_block(item: Column) -> Column:
    """What is asked of an item (a struct prefix, option_a, option_b, hint)."""
    return F.concat(F.lit("Prefix: "), item["prefix"], F.lit(", Options: A. "), item["option_a"], F.lit(" or B. "), item["option_b"], F.lit(". Hint: "), item["hint"], F.lit(" Your response:"))


def sense_prompt(header: str, item: Column, shots: Column) -> Column:
    """A header, shots (items with gold_status and gold_answer) with their responses, then the item."""
    status = lambda x: F.when(x["gold_status"] == "AMBIGUOUS", "AMBIGUOUS").otherwise("NOT AMBIGUOUS")
    shown = F.array_join(F.transform(shots, lambda x: F.concat(sense_block(x), F.lit(" ambiguous status="), status(x), F.lit("; answer="), x["gold_answer"], F.lit("\n"))), "\n\n")
    return F.concat(F.lit(header + "\n"), shown, F.lit("\n\n"), sense_block(item))
