"""Language identification by compression.

Each language has a zstandard raw-content dictionary made of sample text. A
text is encoded with every dictionary; the smallest result names the language.
A narrow margin between the two smallest is a rejection.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import texts

_LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"


class Languages:
    """Compressors by language. ``samples``: language -> training text in UTF-8, the most common language first."""

    def __init__(self, samples: dict[str, bytes], level: int, block: int):
        self.names, self.block = list(samples), block
        self.coders = []
        for name in self.names:
            known = zstandard.ZstdCompressionDict(samples[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(level=level)
            self.coders.append(zstandard.ZstdCompressor(dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False))

    def sizes(self, text: str) -> np.ndarray:
        """Bytes that each language needs for the whole text, in blocks that stand alone.

        Blocks keep a long text from becoming its own dictionary.
        """
        data = " ".join(text.lower().split()).encode()
        blocks = [data[k : k + self.block] for k in range(0, len(data), self.block)]
        return np.array([sum(len(x.compress(y)) for y in blocks) for x in self.coders], float)


@lru_cache(maxsize=2)
def loaded(samples: tuple[tuple[str, bytes], ...], level: int, block: int) -> Languages:
    return Languages(dict(samples), level, block)


def training_samples(docs: DataFrame, rows: int = 80, chars: int = 1500, languages: int = 256) -> dict[str, bytes]:
    """Training text for each language of ``docs`` (doc_id, text, lang).

    The sample is bounded: of each of the ``languages`` most common languages
    the ``rows`` documents that come first by a hash of id and text, ``chars``
    characters from the middle of each. Rows without text, letter or language
    teach nothing; a null id is an id like any other. Of rows equal in id, text
    and language one is taken; an id with several texts has several places.
    The languages come in the order of their counts over all rows.
    """
    usable = docs.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", "text", F.xxhash64(F.lit(5), "doc_id", "text").alias("place"))
    common = usable.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("place").alias("places")).orderBy(F.desc("n"), "lang").limit(languages).collect()
    # the places below a bound that leaves four times as many as are taken; few rows are sorted
    bounds = docs.sparkSession.createDataFrame([(x["lang"], (rows + 40) * 4 / x["places"]) for x in common], "lang string, bound double")
    low = usable.join(F.broadcast(bounds), "lang").filter(F.col("place") / F.lit(2.0**64) + 0.5 <= F.col("bound"))
    order = Window.partitionBy("lang").orderBy("place")
    places = low.select("lang", "place").distinct().withColumn("k", F.row_number().over(order)).filter(F.col("k") <= rows)
    # at most ``rows`` places of each language, and one text for each
    text = F.substring("text", F.greatest(F.lit(1), (F.length("text") - chars) / 2).cast("int"), F.lit(chars))
    found = low.join(F.broadcast(places.select("lang", "place")), ["lang", "place"], "left_semi").groupBy("lang", "place").agg(F.min(text).alias("text")).orderBy("lang", "place").collect()
    samples: dict[str, list[str]] = {}
    for row in found:
        samples.setdefault(row["lang"], []).append(" ".join(row["text"].lower().split()))
    return {x["lang"]: " ".join(samples[x["lang"]]).encode() for x in common if x["lang"] in samples}


def verdict(languages: Languages, text: str, margin: float, least: int) -> tuple[str, float, bool]:
    """lang_pred, score and confident of a text."""
    if not languages.names or not _LETTER.search(text):
        return UNKNOWN, 0.0, False
    sizes = languages.sizes(text)
    best = int(np.argmin(sizes))
    second = np.min(np.delete(sizes, best), initial=np.inf)
    sure = second > sizes[best] and (sizes[best] < least or second - sizes[best] >= margin * sizes[best])
    return languages.names[best], float(1 / np.exp2(np.maximum(sizes[best] - sizes, -60)).sum()), bool(sure)


def identify(docs: DataFrame, samples: dict[str, bytes], level: int = 6, block: int = 1024, margin: float = 0.002, least: int = 200) -> DataFrame:
    """doc_id, lang_pred, score, confident of every whole text of ``docs`` (doc_id, text).

    ``und`` and score 0 where the text is null or has no letter, or nothing
    was learned. The score is the weight of the smallest result among all,
    halved with each byte that another is smaller by; equal sizes go to the
    language that comes first in ``samples``. Not confident: ``und``, or two
    results are equal, or the smallest is ``least`` bytes at least and the
    second larger by less than the share ``margin`` of it. Under ``least``
    bytes any margin over zero will do, as a byte is more than that share.
    A null id stays null; repeated rows give repeated rows, an empty table
    none; extra columns change nothing. A very long text is encoded block by
    block.
    """
    frozen = tuple(samples.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages = loaded(frozen, level, block)
        for batch in batches:
            found = [verdict(languages, x, margin, least) for x in texts(batch)]
            names, scores, sure = zip(*found, strict=True) if found else ([], [], [])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(sure, pa.bool_())], ["doc_id", "lang_pred", "score", "confident"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double, confident boolean")


def confident_documents(docs: DataFrame, samples: dict[str, bytes], level: int = 6, block: int = 1024, margin: float = 0.002, least: int = 200) -> DataFrame:
    """The rows and columns of ``docs`` of which ``identify`` is confident, without a join."""
    frozen = tuple(samples.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages = loaded(frozen, level, block)
        for batch in batches:
            yield batch.filter(pa.array([verdict(languages, x, margin, least)[2] for x in texts(batch)], pa.bool_()))

    typed = docs.withColumn("text", F.col("text").cast("string"))
    return typed.mapInArrow(run, typed.schema)


def held_out(doc_id: Column) -> Column:
    """The fold that is never learned from: crc32 of the id as text, modulo 4, is 2. A null id is in none."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
