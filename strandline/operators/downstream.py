"""Tasks on programs: what a model is asked, what is read from its answer, and how tasks are scored.

Programs: program, entry (the function's name), source, buggy (the source with
a bug, or null) and buggy_line. A model and the running of tests are hooks;
nothing here runs a program.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.grading import rouge1
from ..functions.text import name_words
from .evaluation import pass_rates

TASKS = ["bug_localization", "program_repair", "code_completion", "code_summarization", "code_translation"]
#: What each task says before the program's text.
INSTRUCTIONS = {
    "program_repair": "This Python function contains one bug. Answer with the function, mended, and nothing else.",
    "code_completion": "The last line of this Python function is missing. Answer with the whole function.",
    "code_summarization": "Say in a few words what this Python function is for.",
    "code_translation": "Write this Python function with while loops in place of its for loops; it must do the same. Answer with the function alone.",
}


def without_last_line(source: Column) -> Column:
    """The lines but the last one, each with its end; trailing blanks count for nothing."""
    lines = F.split(F.rtrim(F.regexp_replace(source, r"\s+$", "")), "\n")
    return F.concat(F.array_join(F.slice(lines, 1, F.size(lines) - 1), "\n"), F.lit("\n"))


def task_prompts(programs: DataFrame, instructions: dict[str, str] | None = None) -> DataFrame:
    """program, entry, source, task, shown, prompt: a row for each task that a program is fit for.

    Repair needs a buggy text, completion three lines, translation a ``for``.
    """
    say = {**INSTRUCTIONS, **(instructions or {})}
    lines = F.size(F.split(F.regexp_replace("source", r"\s+$", ""), "\n"))
    shown = {
        "program_repair": F.col("buggy"),
        "code_completion": F.when(lines >= 3, without_last_line(F.col("source"))),
        "code_summarization": F.col("source"),
        "code_translation": F.when(F.contains("source", F.lit("for ")), F.col("source")),
    }
    tasks = F.array(*(F.struct(F.lit(t).alias("task"), x.alias("shown")) for t, x in shown.items()))
    rows = programs.select("program", "entry", "source", F.inline(tasks)).filter("shown is not null")
    words = F.create_map(*(F.lit(x) for pair in say.items() for x in pair))
    return rows.withColumn("prompt", F.concat(F.element_at(words, F.col("task")), F.lit("\n\n"), F.col("shown"), F.lit("\n")))


def function_text(answer: Column, entry: Column) -> Column:
    """The definition of ``entry`` in an answer: from its line to the next line that isn't indented, or null. Code fences count for nothing."""
    fenced = F.regexp_replace(answer, r"(?m)^[ \t]*```.*$", "")
    # entry is a name, so it has no character of a pattern
    found = F.regexp_extract(F.concat(entry, F.lit("\x01"), fenced), r"(?s)^(\w+)\x01(?:.*?\n|)(def \1\(.*?)(?=\n\S|\z)", 2)
    return F.nullif(F.regexp_replace(found, r"\s+$", ""), F.lit(""))


def candidates(answers: DataFrame) -> DataFrame:
    """``answers`` (entry, task, shown, answer) with candidate: the program to be tested.

    Completion takes the function from what was shown together with the
    answer, else from the answer alone, else none; the others take it from the
    answer, else the answer itself. A summary has none.
    """
    own = function_text(F.col("answer"), F.col("entry"))
    joined = function_text(F.concat("shown", "answer"), F.col("entry"))
    completed = F.coalesce(F.when(~joined.eqNullSafe(function_text(F.col("shown"), F.col("entry"))), joined), own)
    candidate = F.when(F.col("task") == "code_completion", completed).when(F.col("task") != "code_summarization", F.coalesce(own, F.col("answer")))
    return answers.withColumn("candidate", candidate)


def localised(surprisals: DataFrame, programs: DataFrame) -> DataFrame:
    """program, passed: whether the line of the greatest mean surprisal, the first of equals, is the buggy one. ``surprisals``: program, line, nll."""
    means = surprisals.groupBy("program", "line").agg(F.avg("nll").alias("nll"))
    best = means.groupBy("program").agg(F.max(F.struct("nll", (-F.col("line")).alias("line"))).alias("x")).select("program", (-F.col("x.line")).alias("line"))
    return programs.filter("buggy is not null").join(best, "program").select("program", (F.col("line") == F.col("buggy_line")).alias("passed"))


def suite_scores(programs: DataFrame, surprisals: DataFrame, answer: Callable, tests: Callable, model: str) -> DataFrame:
    """model, task, score, n of the five tasks.

    ``answer``: a function from a pandas series of prompts to one of texts.
    ``tests``: one from series of entries and candidates to one of booleans; a
    missing candidate has failed. A summary's score is its rouge-1 with the
    words of the function's name.
    """
    asked = task_prompts(programs).withColumn("answer", F.pandas_udf(answer, "string")(F.col("prompt")))
    read = candidates(asked)
    passed = F.coalesce(F.when(F.col("candidate").isNotNull(), F.pandas_udf(tests, "boolean")(F.col("entry"), F.col("candidate"))), F.lit(False))
    overlap = F.when(F.col("task") == "code_summarization", rouge1(F.col("answer"), name_words(F.col("entry"))))
    outcomes = read.select(F.lit(model).alias("model"), "task", F.lit(True).alias("eligible"), passed.alias("passed"), overlap.alias("overlap"))
    found = localised(surprisals, programs).select(F.lit(model).alias("model"), F.lit("bug_localization").alias("task"), F.lit(True).alias("eligible"), "passed", F.lit(None).cast("double").alias("overlap"))
    return pass_rates(outcomes.unionByName(found))
