"""The pipeline's stages against plain versions, and on odd tables."""

import random
import zlib
from array import array

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strandline.llm import language_id, quality_rules, tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
BYTE = public_tokenizers.path("byte_bpe_50k.json")


def words(pick, n):
    return " ".join("".join(pick.choice("abcdefghijklmnop") for _ in range(pick.randint(2, 9))) for _ in range(n))


def frame(spark, rows):
    """An extra column, and one named like a new one of an operator."""
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)
    return docs.withColumn("kept", F.lit("k")).withColumn("r1", F.lit(1))


def texts(out):
    assert out.columns == corpus_pipeline.COLUMNS
    return {x["doc_id"]: x["text"] for x in out.collect()}


@pytest.fixture(scope="module")
def folder(spark, sf_dir, tmp_path_factory):
    """The smallest tables with null texts and ids, repeated rows and ids, blank and long texts, ties."""
    pick, made = random.Random(1), str(tmp_path_factory.mktemp("tables"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(corpus_pipeline.COLUMNS)
    long = " ".join(words(pick, 14) + "." for _ in range(3000))
    rows = [(None, None), (None, words(pick, 80)), (None, "bad"), (-1, ""), (-2, None), (-3, long), (-4, long), (-5, words(pick, 60)), (-6, "\n \t"), (-7, "1 2 3 4 5 6 7 8 9 10 11")]
    rows += [rows[7], rows[7], (-5, words(pick, 70))]
    more = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)
    docs.unionByName(more).withColumn("kept", F.lit(1)).write.parquet(f"{made}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/labels.parquet").write.parquet(f"{made}/labels.parquet")
    return made


def test_quality_and_language_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    kept = corpus_pipeline.quality_stage(spark, docs, folder)
    want = quality_rules.quality_rules(docs, labels).filter("kept").select("doc_id")
    assert kept.columns == corpus_pipeline.COLUMNS
    ids = lambda x: sorted(str(y["doc_id"]) for y in x.select("doc_id").collect())
    assert ids(kept) == ids(want) and {"None", "-5", "-3"} <= set(ids(kept)) and not {"-1", "-2", "-6"} & set(ids(kept))
    sure = corpus_pipeline.language_stage(spark, docs, folder)
    samples = language_id.training_samples(docs.filter(~language_id.held_out(F.col("doc_id"))))
    assert ids(sure) == ids(language_id.identify(docs, samples).filter("confident")) and "-7" not in ids(sure)


def test_substring_stage_cuts_passages_of_over_50_words(spark):
    pick = random.Random(2)
    passage, line = words(pick, 51), words(pick, 40)
    rows = [(k, f"{words(pick, 30)} {passage} {words(pick, 9)}") for k in range(3)]
    rows += [(10 + k, f"{words(pick, 30)} {line} {words(pick, 9)}") for k in range(3)] + [(20, None), (21, ""), (None, f"{passage} end"), (22, words(pick, 400))]
    got = texts(corpus_pipeline.substring_stage(spark, frame(spark, rows), ""))
    for i, text in rows:
        if text and passage in text:
            before, after = text.split(passage)
            assert got[i] == before + after.lstrip()
        else:
            assert got[i] == text
    cut = corpus_pipeline.substring_stage(spark, frame(spark, rows), "").filter("doc_id < 3")
    assert cut.filter("n_chars <> length(text)").count() == 0


def test_substring_stage_keeps_words_and_characters(spark):
    """No part of a word goes, words stay apart, and a replacement character of the input stays."""
    pick = random.Random(3)
    passage = words(pick, 60)
    rows = [(1, f"start {passage} e1"), (2, f"other {passage} e2"), (3, f"\ufffd first \ufffd {passage} last \ufffd\ufffd"), (4, f"{passage}é"), (5, f"ü{passage}")]
    got = texts(corpus_pipeline.substring_stage(spark, frame(spark, rows), ""))
    assert got[1] == "start e1" and got[2] == "other e2" and got[3] == "\ufffd first \ufffd last \ufffd\ufffd"
    assert got[4] == passage.split()[-1] + "é" and got[5] == "ü" + passage.split()[0] + " "


def test_run(spark, folder):
    """Every id of every document that the stages leave lies in one piece."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").select(corpus_pipeline.COLUMNS)
    for _, function in corpus_pipeline.STAGES[:-1]:
        docs = function(spark, docs, folder)
    left = [(x["doc_id"], x["text"]) for x in docs.collect()]
    library = tokens.library(BYTE)
    ids = [(i, [*library.encode(t or "", add_special_tokens=False).ids, 0]) for i, t in left]
    pieces = corpus_pipeline.run(spark, folder).collect()
    assert sum(x["length"] for x in pieces) == sum(len(x) for _, x in ids)
    for x in pieces:
        if x["doc_id"] is not None:
            own = [y for i, y in ids if i == x["doc_id"] and x["doc_tokens"] == len(y)]
            assert x["ids_crc32"] in {zlib.crc32(array("I", y[x["start"] : x["start"] + x["length"]]).tobytes()) for y in own}
    assert {x["doc_id"] for x in pieces} == {i for i, _ in left}


def test_empty_tables(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
