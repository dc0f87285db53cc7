"""Null ids, extra columns with clashing names, a very long text, equal rows and empty tables, for operators that work row by row."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from strandline.llm import bpe_stream, packing, ppm_scoring, rans_files, simhash_dedup, token_counts

BYTE, WORD, PIECE = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
pick = random.Random(3)
LONG = " ".join("".join(pick.choice("abcdefgh") for _ in range(pick.randint(1, 9))) for _ in range(60_000))
ROWS = [(None, None), (None, "no id"), (1, ""), (2, LONG), (3, "same"), (3, "same"), (4, "é 😀"), (-5, None)]
OPERATORS = {
    "packing": lambda df: packing.pack(df, BYTE).groupBy("doc_id", "doc_tokens").agg(F.sum("length").alias("n")),
    "token_counts": lambda df: token_counts.token_counts(df, PIECE),
    "bpe_stream": lambda df: bpe_stream.encode(df, BYTE).select("doc_id", "n_tokens", F.md5("decoded").alias("d")),
    "ppm_scoring": lambda df: ppm_scoring.score(df).select("doc_id", "n_tokens", "held_out", F.round("score", 6).alias("s")),
    "rans_files": lambda df: rans_files.read_token_files(df.sparkSession, rans_files.write_token_files(df, WORD)).select("doc_id", "n_tokens"),
    "simhash": lambda df: simhash_dedup.near_duplicates(df).select("doc_id", "fingerprint"),
}


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows(spark, name):
    run = OPERATORS[name]
    plain = spark.createDataFrame(ROWS, "doc_id long, text string")
    clashing = plain.withColumns({c: F.lit("x") for c in ("n_tokens", "ids", "start", "score", "fp", "held_out", "tail", "n", "word")}).repartition(3)
    got = rows(run(plain))
    assert got == rows(run(clashing))
    assert {x[0] for x in got} == {None, 1, 2, 3, 4, -5}
    if name != "packing":
        assert len(got) == len(ROWS) and [x[0] for x in got].count(None) == 2
    assert run(plain.limit(0)).count() == 0
