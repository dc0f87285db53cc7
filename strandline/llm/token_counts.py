"""Token counts by the whole-token shortcut.

Offline it is proved which strings of the vocabulary encode alone as one
token; pre-tokens that are such strings count as one without any merge. Only
the rest is merged by the library, and a bounded cache keeps those counts.

A pre-token is a run of blanks with the word after it. No piece of the
vocabulary holds a blank after another character, so no merge crosses the
start of a pre-token, and a text's count is the sum over its pre-tokens. The
proof of that is part of ``whole_tokens``, which refuses other vocabularies.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts

BLANK = "▁"
_RUNS = re.compile(" +[^ ]*")


def whole_tokens(model) -> set[str]:
    """Pre-tokens, without the blank before them, that the model encodes as one token."""
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    if bad := [x for x in pieces if BLANK in x.lstrip(BLANK) or x.startswith(2 * BLANK) and x.strip(BLANK)]:
        raise ValueError(f"pieces hold a blank after another character: {bad[:3]}")
    words = [x[1:] for x in pieces if x.startswith(BLANK) and len(x) > 1 and BLANK not in x[1:]]
    return {x for x, ids in zip(words, model.encode(words, num_threads=1), strict=True) if len(ids) == 1}


class Counter:
    """Counts of whole texts; ``cap`` bounds the cache of merged pre-tokens."""

    def __init__(self, path: str, cap: int = 400_000):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        if "".join(self.model.encode("  a  a ", out_type=str)) != "▁▁▁a▁▁a▁":
            raise ValueError("the model drops blanks; pre-tokens would not be exact")
        self.whole = dict.fromkeys(whole_tokens(self.model), 1)
        self.cap = cap
        #: None is a single blank at the end of a text
        self.always: dict[str | None, int] = {**self.whole, "": 0, None: 1}
        self.known = dict(self.always)

    def counts(self, group: list[str]) -> list[int]:
        cut = []
        for text in group:
            if BLANK in text:
                text = text.replace(BLANK, " ")
            words = text.split(" ")
            # a blank that isn't before a word makes an empty word: such runs stay with the word after them
            cut.append([x[1:] or None for x in _RUNS.findall(" " + text)] if text and "" in words else words)
        need = {y for x in cut for y in x}.difference(self.known)
        if len(self.known) + len(need) > self.cap + len(self.always):
            self.known = dict(self.always)
            need = {y for x in cut for y in x}.difference(self.known)
        misses = list(need)
        self.known.update(zip(misses, map(len, self.model.encode(misses, num_threads=1)), strict=True))
        return [sum(map(self.known.__getitem__, x)) for x in cut]


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_bytes (UTF-8) and n_tokens of every whole text.

    A null or empty text has 0 of both; a null doc_id stays null; repeated
    rows give repeated rows, an empty table none; extra columns change nothing.
    A very long text is counted by itself, in memory of its size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            found, group, size = [], [], 0
            for text in texts(batch):
                group.append(text)
                size += len(text)
                if size > 2_000_000:
                    found += count.counts(group)
                    group, size = [], 0
            found += count.counts(group) if group else []
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(found, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long").alias("n_bytes"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
