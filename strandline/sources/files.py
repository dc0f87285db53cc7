"""Scans: JSON lines, tables named by their files, CSV with literal text, line files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def exists(spark: SparkSession, path: str) -> bool:
    """Whether any file matches, asked of the path's own file system."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(hadoop)
    return found is not None and len(found) > 0


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str, comments: bool = False) -> DataFrame:
    """Rows of JSON lines; blank lines and, if asked for, ``//`` lines are skipped; no file, no rows."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    if not comments:
        return spark.read.schema(schema).json(path)
    lines = spark.read.text(path).filter((F.trim("value") != "") & ~F.ltrim("value").startswith("//"))
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("row")).select("row.*")


def named_json_lines(spark: SparkSession, pattern: str, schema: T.StructType | str, name: str) -> DataFrame:
    """JSON lines of many files, with what the groups of ``name`` match in the file's name.

    ``name`` is a regular expression with named groups, which become columns.
    """
    import re

    groups = re.compile(name).groupindex
    plain = re.sub(r"\(\?P<\w+>", "(", name)
    rows = spark.read.schema(schema).json(pattern).withColumn("_file", F.col("_metadata.file_name")) if exists(spark, pattern) else spark.createDataFrame([], schema).withColumn("_file", F.lit(None).cast("string"))
    for column, k in groups.items():
        rows = rows.withColumn(column, F.nullif(F.regexp_extract("_file", plain, k), F.lit("")))
    return rows.drop("_file")


def with_arrays(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows that have all of these arrays or maps."""
    for c in columns:
        rows = rows.filter(F.size(c) > 0)
    return rows


def with_curves(rows: DataFrame, arrays: list[str], maps: list[str]) -> DataFrame:
    """Rows of two families of files as one: those that have all of the arrays, and those that have all of the maps (by position) in their place.

    A map's values become an array in the order of its keys as numbers, under
    the array's name: ``maps`` belong to ``arrays`` one by one. ``family`` says
    where a row comes from; one that has both is in both.
    """
    rest = [c for c in rows.columns if c not in {*arrays, *maps}]

    def values(c: str):
        ordered = F.array_sort(F.transform(F.map_entries(c), lambda e: F.struct(e["key"].cast("double").alias("k"), e["value"].alias("v"))))
        return F.transform(ordered, lambda e: e["v"])

    whole = with_arrays(rows, *arrays).select(*rest, *arrays, F.lit("layers").alias("family"))
    rolling = with_arrays(rows, *maps).select(*rest, *(values(m).alias(a) for a, m in zip(arrays, maps, strict=True)), F.lit("rolling").alias("family"))
    return whole.unionByName(rolling)


def csv_literal(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """CSV in which empty fields and ``NA`` are text."""
    rows = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option("nullValue", "\u0001").option("emptyValue", "").csv(path)
    return rows.select(*(F.coalesce(F.col(f"`{x.name}`"), F.lit("")).alias(x.name) if isinstance(x.dataType, T.StringType) else F.col(f"`{x.name}`") for x in rows.schema.fields))


def csv_complete(spark: SparkSession, path: str, schema: T.StructType | str, *required: str) -> DataFrame:
    """CSV rows that have all required fields."""
    return spark.read.schema(schema).option("header", True).csv(path).dropna(subset=list(required) or None)


def line_files(spark: SparkSession, path: str) -> DataFrame:
    """label (the file's name), line (from 1) and text; blank and ``#`` lines are skipped.

    Files are read a batch of lines at a time; in stores that only Spark's own
    readers know, whole, one row each.
    """
    from . import lines

    if lines.known(path):
        lines.register(spark)
        rows = spark.read.format("strandline_lines").load(path)
    else:
        name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.[^.]*)?$", 1)
        whole = spark.read.text(path, wholetext=True).select(name.alias("label"), F.posexplode(F.split("value", r"\r?\n")).alias("k", "text"))
        rows = whole.select("label", (F.col("k") + 1).alias("line"), "text")
    return rows.withColumn("text", F.trim("text")).filter((F.col("text") != "") & ~F.col("text").startswith("#"))


def instruction_text(instruction: str, extra: str):
    """An instruction with what it is about, where there is any."""
    return F.concat_ws("\n", F.nullif(F.trim(F.col(instruction)), F.lit("")), F.nullif(F.trim(F.col(extra)), F.lit("")))


def readable(text: str, least: int = 64):
    """Long enough and no heading."""
    trimmed = F.trim(F.col(text))
    return (F.length(trimmed) >= least) & ~trimmed.startswith("=")


def cached_sample(rows: DataFrame, item: str, n: int, seed: int, path: str) -> DataFrame:
    """n rows by a hash order, kept in a table that later calls read."""
    from ..operators.curation import hash_sample

    spark = rows.sparkSession
    if not exists(spark, path):
        hash_sample(rows, item, n, seed).write.parquet(path)
    return spark.read.parquet(path)


def named_documents(spark: SparkSession, pattern: str, schema: T.StructType | str, name: str, siblings: str | None = None, sibling_schema: T.StructType | str | None = None, sibling_name: str | None = None) -> DataFrame:
    """One row for each JSON document, with ``key``, the first group that ``name`` matches in the file's name.

    With ``siblings``, documents of another pattern, their columns come with
    those of the same key; null where there is none.
    """
    read = lambda files, kind, regex: spark.read.schema(kind).option("multiLine", True).json(files).withColumn("key", F.regexp_extract(F.col("_metadata.file_name"), regex, 1)) if exists(spark, files) else spark.createDataFrame([], kind).withColumn("key", F.lit(""))
    rows = read(pattern, schema, name)
    if siblings is None:
        return rows
    return rows.join(read(siblings, sibling_schema, sibling_name), "key", "left")


def downstream_documents(spark: SparkSession, structural: DataFrame, scores: str, info: str) -> DataFrame:
    """The rows of ``structural`` (model, ...) whose model has a document of task scores, with those and its parameter count.

    Score documents: model, scores (a map), synthetic. Info documents:
    model_id, params (such as 0.5B).
    """
    from ..functions.text import parameter_count

    own = spark.read.schema("model string, scores map<string,double>, synthetic boolean").option("multiLine", True).json(scores) if exists(spark, scores) else spark.createDataFrame([], "model string, scores map<string,double>, synthetic boolean")
    sizes = spark.read.schema("model_id string, params string").option("multiLine", True).json(info) if exists(spark, info) else spark.createDataFrame([], "model_id string, params string")
    known = sizes.groupBy(F.col("model_id").alias("model")).agg(F.min(parameter_count(F.col("params"))).alias("params"))
    return structural.join(own, "model").join(known, "model", "left")


def configuration(path: str | None = None, variable: str = "STRANDLINE_CONFIG") -> dict:
    """A configuration file, JSON or, where that package is installed, YAML; ``variable`` names it if ``path`` doesn't.

    Read by the driver alone, from any store that Arrow's file systems know.
    """
    import json
    import os

    from .lines import opened

    chosen = path or os.environ.get(variable)
    if not chosen:
        raise ValueError(f"no configuration: give a path or set {variable}")
    store, at = opened(chosen)
    with store.open_input_stream(at) as file:
        if chosen.endswith((".yaml", ".yml")):
            import yaml

            return yaml.safe_load(file)
        return json.load(file)


def configured_path(config: dict, name: str, root: str) -> str:
    """A path of the configuration's ``paths``; relative ones, without a scheme, start from ``root``."""
    found = str(config["paths"][name])
    return found if found.startswith("/") or "://" in found else f"{root.rstrip('/')}/{found}"
