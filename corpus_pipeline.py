"""Documents to packed training sequences, stage by stage.

Each stage works on all that the one before it kept and returns the columns of
``documents``; the last returns the pieces of the packed sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import language_id, packing, quality_rules, shingle_dedup, substring_dedup
from strandline.llm.common import read, ship, stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: SQL can't express anomaly forests, compression or packing.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a base rule, or that a forest finds unusual, go.

    A null or empty text fails a rule. Ids may be null or repeat, equal rows
    are judged alike; extra columns go.
    """
    ship(spark)
    return quality_rules.good_documents(docs.select(COLUMNS), read(spark, sf_dir, "labels"))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or with no language clearly before the others, go; so do null and empty texts.

    Where nothing can be learned, no document is sure and all go. Equal rows
    are judged alike.
    """
    ship(spark)
    samples = language_id.training_samples(docs.filter(~language_id.held_out(F.col("doc_id"))))
    return language_id.confident_documents(docs.select(COLUMNS), samples)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, by SimHash or by shared five-word shingles, the document with the least id stays.

    Rows equal in id and text stay once; rows without an id, and those of an
    id with several texts, all stay.
    """
    ship(spark)
    return shingle_dedup.deduplicated(docs).select(COLUMNS)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of over 50 words that occur twice go from the texts, with the blanks behind them; no word is cut in part.

    51 words that have under 200 bytes in all are too short to be found. A
    null text stays null, an empty one empty; ids may be null or repeat, and
    equal rows lose the same.
    """
    ship(spark)
    cut = substring_dedup.without_repeats(docs.select(COLUMNS), length=200, least_words=51)
    text = F.when(F.col("n_removed") > 0, F.col("kept").cast("string")).otherwise(F.col("text"))
    return cut.withColumn("text", text).withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))).select(COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 ids, each document followed by id 0; a null or empty text is that id alone."""
    ship(spark)
    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), length=1024, end_id=0)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality rules", quality_stage),
    ("language id", language_stage),
    ("near-duplicates", near_duplicate_stage),
    ("suffix-array dedup", substring_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(COLUMNS)
    for k, (_, function) in enumerate(STAGES):
        docs = function(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stage(docs, "documents")
    return docs
