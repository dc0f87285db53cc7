"""Writers: JSON lines, CSV, and the text forms of small tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_csv(rows: DataFrame, path: str, digits: int | None = None, quote_all: bool = False, one_file: bool = False, rows_a_file: int = 0) -> None:
    """``digits`` fixes the decimals of floating columns; a missing value is written as None then. ``rows_a_file`` starts a new file after so many rows."""
    if digits is not None:
        rows = rows.select(*(F.when(F.col(c).isNull(), "None").otherwise(F.format_string(f"%.{digits}f", c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in rows.dtypes))
    (rows.coalesce(1) if one_file else rows).write.mode("overwrite").option("maxRecordsPerFile", rows_a_file).option("header", True).option("quoteAll", quote_all).option("escape", '"').csv(path)


def write_document(rows: DataFrame, path: str, shape: str = "array", most: int | None = None) -> None:
    """All rows in one file: a JSON array, JSON lines (``json``) or lines of the first column (``text``); tasks write its parts, and a failed one leaves nothing.

    With ``most``, more rows than that are an error.
    """
    from .lines import register

    if most is not None and rows.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows")
    register(rows.sparkSession)
    rows.write.format("strandline_document").option("shape", shape).mode("append").save(path)


_LATEX = {**{c: "\\" + c for c in "&%$#_{}"}, "\\": r"\textbackslash{}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}", "<": r"\textless{}", ">": r"\textgreater{}"}


def few(rows: DataFrame, most: int) -> list:
    """The rows of a small table; more than ``most`` is an error."""
    found = rows.take(most + 1)
    if len(found) > most:
        raise ValueError(f"more than {most} rows")
    return found


def latex(rows: DataFrame, caption: str, most: int = 200) -> str:
    """A booktabs table of at most ``most`` rows; more is an error."""
    return latex_of(rows.columns, few(rows, most), caption)


def latex_of(columns: list[str], found: list, caption: str) -> str:
    escape = lambda x: "".join(_LATEX.get(c, c) for c in ("--" if x is None else str(x)))
    lines = [" & ".join(escape(x) for x in row) + r" \\" for row in [columns, *map(list, found)]]
    return "\n".join([r"\begin{table}", rf"\caption{{{escape(caption)}}}", rf"\begin{{tabular}}{{{'l' * len(columns)}}}", r"\toprule", lines[0], r"\midrule", *lines[1:], r"\bottomrule", r"\end{tabular}", r"\end{table}"])


def markdown(rows: DataFrame, title: str, notice: str = "", most: int = 200) -> str:
    return markdown_of(rows.columns, few(rows, most), title, notice)


def markdown_of(columns: list[str], found: list, title: str, notice: str = "") -> str:
    line = lambda row: "| " + " | ".join("--" if x is None else str(x) for x in row) + " |"
    return "\n".join([f"## {title}", *([f"> {notice}"] if notice else []), "", line(columns), line(["---"] * len(columns)), *map(line, found)])


def report(title: str, notices: list[str], sections: list[tuple[str, DataFrame]]) -> str:
    """A Markdown document: a title, what must be known of the data, and a table for each section."""
    return "\n\n".join([f"# {title}", *(f"> {x}" for x in notices), *(markdown(rows, name) for name, rows in sections)]) + "\n"


def write_bundle(tables: dict[str, DataFrame], path: str, notices: list[str] | None = None, most: int = 200) -> None:
    """Each table as CSV, LaTeX and Markdown under ``path``, by name, and a report of all. A table's plan runs once."""
    sections = []
    for name, rows in tables.items():
        spark, columns, found = rows.sparkSession, rows.columns, few(rows, most)
        write_csv(spark.createDataFrame(found, rows.schema), f"{path}/{name}.csv", one_file=True)
        write_text(spark, latex_of(columns, found, name.replace("_", " ")), f"{path}/{name}.tex")
        sections.append(markdown_of(columns, found, name))
        write_text(spark, sections[-1], f"{path}/{name}.md")
    if tables:
        text = "\n\n".join(["# Tables", *(f"> {x}" for x in notices or []), *sections]) + "\n"
        write_text(next(iter(tables.values())).sparkSession, text, f"{path}/report.md")


def write_text(spark, text: str, path: str) -> None:
    """One text at a path, in whatever store it is."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_model(model, path: str) -> None:
    """A fitted text classifier (``fit_text_classifier``) as tables: terms with their weight, coefficients, intercepts."""
    spark = SparkSession.getActiveSession()
    labels, terms, idf, fitted = model.stages[0].labels, model.stages[4].vocabulary, model.stages[5].idf.toArray(), model.stages[6]
    weights, base = fitted.coefficientMatrix.toArray(), fitted.interceptVector.toArray()
    spark.createDataFrame([(k, x, float(idf[k])) for k, x in enumerate(terms)], "place int, term string, idf double").write.mode("overwrite").parquet(f"{path}/terms")
    spark.createDataFrame([(i, k, float(w)) for i, row in enumerate(weights) for k, w in enumerate(row) if w], "label int, place int, weight double").write.mode("overwrite").parquet(f"{path}/weights")
    spark.createDataFrame([(i, labels[i] if i < len(labels) else "", float(x)) for i, x in enumerate(base)], "label int, name string, intercept double").write.mode("overwrite").parquet(f"{path}/labels")


def scored_by_tables(rows: DataFrame, item: str, text: str, path: str) -> DataFrame:
    """item, name, logit: what a model written by ``write_model`` says of texts, by joins alone.

    A term counts as often as it occurs, so what each occurrence adds is
    summed where the text is: a text's terms don't move one by one where the
    table of terms is broadcast.
    """
    spark = rows.sparkSession
    terms, weights, labels = (spark.read.parquet(f"{path}/{x}") for x in ("terms", "weights", "labels"))
    adds = terms.join(weights, "place").groupBy("term").agg(F.collect_list(F.struct("label", (F.col("idf") * F.col("weight")).alias("add"))).alias("_adds"))
    one = F.filter(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    two = F.when(F.size("_one") > 1, F.zip_with(F.slice("_one", 1, F.greatest(F.size("_one") - 1, F.lit(1))), F.slice("_one", 2, F.greatest(F.size("_one") - 1, F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))
    each = rows.select(item, one.alias("_one")).select(item, F.explode(F.concat("_one", two)).alias("term"))
    # a model has a vocabulary of bounded size
    sums = each.join(F.broadcast(adds), "term").select(item, F.inline("_adds")).groupBy(item, "label").agg(F.sum("add").alias("sum"))
    return rows.select(item).join(labels).join(sums, [item, "label"], "left").select(item, "name", (F.col("intercept") + F.coalesce("sum", F.lit(0.0))).alias("logit"))
