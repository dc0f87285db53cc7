"""Tables written by a sink and read again by a source: what comes back is what was there."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.checkpoints import checkpoint_folder
from ..operators.stats import shown
from ..sources import files, sinks
from .registry import query, table


def folder(spark) -> str:
    """A new folder beside the session's checkpoints."""
    checkpoint_folder(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/round-{uuid.uuid4().hex}"


@query("SELECT doc_id, md5(text) AS text_md5, lang FROM documents")
def json_lines_round_trip(spark, sf_dir):
    """JSON lines with comments and blank lines between them."""
    at = folder(spark)
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    sinks.write_json(rows, f"{at}/rows")
    spark.createDataFrame([("// a comment",), ("",), ("  // another",)], "value string").write.mode("append").text(f"{at}/rows")
    back = files.json_lines(spark, f"{at}/rows", "doc_id long, text string, lang string", comments=True)
    return back.select("doc_id", F.md5("text").alias("text_md5"), "lang")


@query("""WITH e AS (SELECT vec_id, label, embedding, label % 3 AS kind FROM embeddings)
SELECT vec_id, 'm' || kind AS model, CASE WHEN kind = 2 THEN 'rolling' ELSE 'layers' END AS family, len(embedding) AS n, round(embedding[1]::DOUBLE, 6) AS first, round(embedding[len(embedding)]::DOUBLE, 6) AS last FROM e""")
def named_files_round_trip(spark, sf_dir):
    """Two families of files, arrays by layer and maps by prefix, with the model in the file's name; rows of neither are left out."""
    at, rows = folder(spark), table(spark, sf_dir, "embeddings").select("vec_id", (F.col("label") % 3).alias("kind"), F.col("embedding").cast("array<double>").alias("er"))
    places = F.transform(F.sequence(F.lit(1), F.size("er")), lambda k: k.cast("string"))
    for kind in (0, 1):
        sinks.write_document(rows.filter(F.col("kind") == kind).select("vec_id", "er"), f"{at}/latent_m{kind}.jsonl", "json")
    rolling = rows.filter("kind = 2").select("vec_id", F.map_from_arrays(places, "er").alias("er_by_prefix"))
    sinks.write_document(rolling, f"{at}/latent_rolling_m2.jsonl", "json")
    sinks.write_document(rows.limit(1).select("vec_id", F.array().cast("array<double>").alias("er")), f"{at}/latent_none.jsonl", "json")
    back = files.named_json_lines(spark, f"{at}/latent_*.jsonl", "vec_id long, er array<double>, er_by_prefix map<string,double>", r"^latent_(?:rolling_)?(?P<model>\w+)\.jsonl$")
    both = files.with_curves(back, ["er"], ["er_by_prefix"])
    ends = [F.round(F.element_at("er", k), 6).alias(name) for k, name in ((1, "first"), (-1, "last"))]
    return both.select("vec_id", "model", "family", F.size("er").cast("long").alias("n"), *ends)


@query("SELECT doc_id, md5(coalesce(text, '')) AS text_md5, coalesce(lang, '') AS lang FROM documents")
def csv_round_trip(spark, sf_dir):
    """Quoted CSV with line feeds, quotes and texts such as NA; missing texts come back empty.

    A file whose fields have line feeds is read by one task, so files are kept small.
    """
    at = folder(spark)
    sinks.write_csv(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), f"{at}/rows.csv", quote_all=True, rows_a_file=5_000)
    return files.csv_literal(spark, f"{at}/rows.csv", "doc_id long, text string, lang string").select("doc_id", F.md5("text").alias("text_md5"), "lang")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey % 5 <> 0")
def complete_csv_rows(spark, sf_dir):
    """CSV rows that lack a required field are left out."""
    at, rows = folder(spark), table(spark, sf_dir, "customer")
    sinks.write_csv(rows.select("c_custkey", F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment")).alias("c_mktsegment")), f"{at}/rows.csv")
    return files.csv_complete(spark, f"{at}/rows.csv", "c_custkey long, c_mktsegment string", "c_mktsegment")


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'None' ELSE printf('%.4f', c_acctbal) END AS shown FROM customer")
def fixed_decimals_csv(spark, sf_dir):
    """Four decimals, and None for what is missing."""
    at, rows = folder(spark), table(spark, sf_dir, "customer")
    sinks.write_csv(rows.select("c_custkey", F.when(F.col("c_custkey") % 4 != 0, F.col("c_acctbal")).alias("shown")), f"{at}/rows.csv", digits=4)
    return files.csv_literal(spark, f"{at}/rows.csv", "c_custkey long, shown string")


@query("""WITH c AS (SELECT c_mktsegment AS label, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS k, c_name FROM customer)
SELECT label, (3 * k)::INT AS line, c_name AS text FROM c""")
def line_files_round_trip(spark, sf_dir):
    """Lines of a file for each segment, between comments and blank lines."""
    at, rows = folder(spark), table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_name")
    # the segments are a handful of fixed names
    for (segment,) in rows.select("c_mktsegment").distinct().orderBy("c_mktsegment").limit(1000).collect():
        own = rows.filter(F.col("c_mktsegment") == segment).repartitionByRange("c_custkey").sortWithinPartitions("c_custkey")
        sinks.write_document(own.select(F.concat(F.lit("# a note\n  \n  "), "c_name", F.lit(" "))), f"{at}/{segment}.txt", "text")
    return files.line_files(spark, at)


@query("""SELECT l_returnflag AS "key", l_linestatus AS status, count(*) AS n, round(sum(l_quantity), 2) AS quantity, 'flag ' || l_returnflag AS about FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def documents_round_trip(spark, sf_dir):
    """A JSON document for each flag, and a sibling document that says what it is about."""
    at, rows = folder(spark), table(spark, sf_dir, "lineitem")
    sums = rows.groupBy("l_returnflag", F.col("l_linestatus").alias("status")).agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))
    for (flag,) in sums.select("l_returnflag").distinct().orderBy("l_returnflag").limit(1000).collect():
        sinks.write_document(sums.filter(F.col("l_returnflag") == flag).select("status", "n", "quantity"), f"{at}/result_{flag}.json")
        sinks.write_document(spark.createDataFrame([(f"flag {flag}",)], "about string"), f"{at}/info_{flag}.json")
    return files.named_documents(spark, f"{at}/result_*.json", "status string, n long, quantity double", r"^result_(\w+)\.json$", f"{at}/info_*.json", "about string", r"^info_(\w+)\.json$")


@query("""WITH b AS (SELECT p_brand AS model, count(*) AS n, round(avg(p_size), 6) AS size, round(avg(p_retailprice), 6) AS price FROM part GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY model) AS k FROM b)
SELECT model, n, size, price, CASE WHEN k % 3 <> 0 THEN k * 0.5e9 END AS params FROM k WHERE k % 4 <> 0""")
def downstream_documents_join(spark, sf_dir):
    """Rows of the models that have a document of scores, with the parameter count where an information document states it."""
    from pyspark.sql import Window

    at, part = folder(spark), table(spark, sf_dir, "part")
    brands = part.groupBy(F.col("p_brand").alias("model")).agg(F.count("*").alias("n"), F.round(F.avg("p_size"), 6).alias("size"), F.round(F.avg("p_retailprice"), 6).alias("price"))
    # as many rows as there are brands
    ranked = brands.withColumn("k", F.row_number().over(Window.orderBy("model")))
    scores = ranked.filter("k % 4 <> 0").select("model", F.create_map(F.lit("size"), "size", F.lit("price"), "price").alias("scores"), F.lit(False).alias("synthetic"))
    sinks.write_document(scores, f"{at}/scores.json")
    sinks.write_document(ranked.filter("k % 3 <> 0").select(F.col("model").alias("model_id"), F.concat((F.col("k") * 0.5).cast("string"), F.lit("B")).alias("params")), f"{at}/info.json")
    out = files.downstream_documents(spark, brands.select("model", "n"), f"{at}/scores.json", f"{at}/info.json")
    return out.select("model", "n", F.col("scores")["size"].alias("size"), F.col("scores")["price"].alias("price"), "params")


_BRANDS = "b AS (SELECT p_brand, count(*) AS n, round(avg(p_retailprice), 2) AS price FROM part GROUP BY 1), l AS (SELECT *, row_number() OVER (ORDER BY p_brand) AS k, printf('%.2f', price) AS p FROM b)"


@query(rf"""WITH {_BRANDS}, t AS (SELECT 'md' AS kind, k + 4 AS line, '| ' || p_brand || ' | ' || n || ' | ' || p || ' |' AS text FROM l UNION ALL SELECT 'tex', k + 6, replace(p_brand, '#', '\#') || ' & ' || n || ' & ' || p || ' \\' FROM l)
SELECT kind, line::INT AS line, text FROM t""")
def table_bundle(spark, sf_dir):
    """The rows of a table in the Markdown and LaTeX files of a bundle, by their lines."""
    at = folder(spark)
    rows = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("n"), F.round(F.avg("p_retailprice"), 2).alias("price")).orderBy("p_brand").select("p_brand", "n", shown(F.col("price"), 2).alias("price"))
    sinks.write_bundle({"brands": rows}, at, ["From the given table."])
    parts = [files.line_files(spark, f"{at}/brands.{kind}").select(F.lit(kind).alias("kind"), "line", "text") for kind in ("md", "tex")]
    return parts[0].unionByName(parts[1]).filter(F.col("text").rlike(r"^(\| )?Brand\\?#"))


@query("SELECT conv_id, turn, concat_ws(chr(10), nullif(trim(role), ''), nullif(trim(text), '')) AS text FROM conversations WHERE length(trim(text)) >= 64 AND NOT starts_with(trim(text), '=')")
def readable_instructions(spark, sf_dir):
    """Texts of some length that are no heading, each after its instruction."""
    rows = table(spark, sf_dir, "conversations").filter(files.readable("text"))
    return rows.select("conv_id", "turn", files.instruction_text("role", "text").alias("text"))


@query(r"""WITH b AS (SELECT c_nationkey AS nation, count(*) AS n, avg(c_acctbal) AS mean, CASE WHEN c_nationkey % 5 = 0 THEN NULL ELSE count(*) / 1e6 END AS p FROM customer GROUP BY 1)
SELECT nation, printf('%.1f', round(mean, 3)) AS mean, CASE WHEN p IS NULL THEN '--' WHEN p < 0.001 THEN '<0.001' ELSE printf('%.3f', p) END AS p FROM b""")
def shown_numbers(spark, sf_dir):
    """Numbers as tables show them: fixed decimals, dashes for what is undefined, small p-values as a bound."""
    rows = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("n"), F.round(F.avg("c_acctbal"), 3).alias("mean"))
    p = F.when(F.col("nation") % 5 != 0, F.col("n") / 1e6)
    return rows.select("nation", shown(F.col("mean"), 1).alias("mean"), shown(p, 3, True).alias("p"))


@query()
def model_tables(spark, sf_dir):
    """A text classifier written as tables; what joins with them say of each text beside what the model says."""
    from pyspark.ml.functions import vector_to_array

    from ..operators.classify import fit_text_classifier

    at = folder(spark)
    rows = table(spark, sf_dir, "conversations").filter("text is not null").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text", "role")
    model = fit_text_classifier(rows, "text", "role")
    sinks.write_model(model, at)
    names = F.array(*map(F.lit, [*model.stages[0].labels, ""]))
    said = model.transform(rows).select("id", F.posexplode(vector_to_array("rawPrediction")).alias("k", "raw")).select("id", F.element_at(names, F.col("k") + 1).alias("name"), "raw")
    joined = sinks.scored_by_tables(rows, "id", "text", at).join(said, ["id", "name"])
    return joined.select("id", "name", F.round("logit", 4).alias("logit"), (F.abs(F.col("logit") - F.col("raw")) < 1e-6).alias("alike"))
