"""Quality rules, and isolation forests over their statistics.

The base rules decide alone on what is certain. Forests isolate unusual
documents: random splits of a few statistics, a short path to a leaf means an
anomaly. One forest sees all five statistics, one those of symbols and word
length, which repetition would drown. From which score on a document goes is
calibrated for each on all labelled rows: as low as loses almost none of those
labelled good, and only where those labelled bad are much more frequent.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, stage, texts

SYMBOLS = re.compile(r"[#*$%&|<>]")
_WORDLESS = re.compile(rb"[^\x20\x09-\x0D]")
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Of each document, for the forests: rates, so that long documents aren't unusual for their length alone.
FEATURES = ["symbol_rate", "symbols_per_word", "word_length", "duplicate_lines_per_word", "repeated_words_per_word"]
#: The features of each forest, and the name of its score.
FORESTS = {"score": FEATURES[:3], "score_all": FEATURES}
#: So many words of the usual length are added to each document, so that short ones aren't unusual by chance.
USUAL = (40, 5.0)


def repeated_words(words: list[bytes], size: int = 5) -> int:
    """Words that lie in a window of ``size`` words found twice or more."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    windows = list(zip(*(words[k : k + n] for k in range(size)), strict=True))
    if len(set(windows)) == n:
        return 0
    first: dict[tuple, int] = {}
    cover = np.zeros(len(words) + 1, np.int64)
    for k, window in enumerate(windows):
        j = first.setdefault(window, k)
        if j != k:
            if j >= 0:
                cover[j] += 1
                cover[j + size] -= 1
                first[window] = -1
            cover[k] += 1
            cover[k + size] -= 1
    return int(np.count_nonzero(np.cumsum(cover)))


def rule_counts(text: str) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    data = text.encode()
    words = data.split()
    chars = len(text) - (len(data) - sum(map(len, words)))
    lines = [x for x in text.split("\n") if _WORDLESS.search(x.encode())]
    return len(words), chars, len(SYMBOLS.findall(text)), len(lines) - len(set(lines)), repeated_words(words)


def features(rows: np.ndarray) -> np.ndarray:
    """FEATURES of rows as ``rule_counts`` gives them."""
    n, chars, symbols, lines, repeats = rows.T.astype(float)
    words = n + USUAL[0]
    signs = chars + USUAL[0] * USUAL[1]
    return np.stack([symbols / signs, symbols / words, signs / words, lines / words, repeats / words], axis=1)


@dataclass
class Forest:
    """Trees as arrays: split feature (-1: leaf), threshold, left child (right is next), path length at a leaf."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    norm: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        """2 ** (-mean path / expected path), in (0, 1); the higher, the more unusual."""
        total = np.zeros(len(rows))
        for feature, threshold, child, path in self.trees:
            at = np.zeros(len(rows), np.int64)
            live = np.flatnonzero(feature[at] >= 0)
            while len(live):
                node = at[live]
                at[live] = child[node] + (rows[live, feature[node]] >= threshold[node])
                live = live[feature[at[live]] >= 0]
            total += path[at]
        return np.exp2(-total / (max(1, len(self.trees)) * self.norm))


def expected_path(n: int) -> float:
    """The mean depth of an unsuccessful search in a random tree of n rows."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def grow(sample: np.ndarray, trees: int, size: int, seed: int) -> Forest:
    random = np.random.default_rng(seed)
    size = min(size, len(sample))
    limit = math.ceil(math.log2(max(2, size)))
    grown = []
    for _ in range(trees if size else 0):
        feature, threshold, child, path = [-1], [0.0], [0], [0.0]
        todo = [(0, sample[random.choice(len(sample), size, replace=False)], 0)]
        while todo:
            node, rows, depth = todo.pop()
            low, high = rows.min(axis=0), rows.max(axis=0)
            usable = np.flatnonzero(high > low)
            if depth >= limit or not len(usable):
                path[node] = depth + expected_path(len(rows))
                continue
            feature[node] = int(random.choice(usable))
            threshold[node] = random.uniform(low[feature[node]], high[feature[node]])
            child[node] = len(feature)
            right = rows[:, feature[node]] >= threshold[node]
            for k, part in enumerate((rows[~right], rows[right])):
                feature.append(-1)
                threshold.append(0.0)
                child.append(0)
                path.append(depth + 1.0)
                if len(part):
                    todo.append((child[node] + k, part, depth + 1))
        grown.append((np.array(feature), np.array(threshold), np.array(child), np.array(path)))
    return Forest(grown, max(expected_path(size), 1.0))


def rule_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, and the counts of ``rule_counts``, of every whole text; a null text is the empty one."""
    names = COUNTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([rule_counts(x) for x in texts(batch)], np.int64).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x) for x in found.T)], ["doc_id", *names])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, " + ", ".join(f"{x} long" for x in names))


BASE_FAILED = "n_words < 10 or 100 * n_repeat_words > 20 * n_words"


def limit(steps: list[tuple[float, int, int]], lost: float, ratio: float, otherwise: float) -> float:
    """The score over which a document goes. ``steps``: score, rows labelled good, rows labelled bad.

    The least that at most the share ``lost`` of the good rows exceed, and
    that the bad rows exceed ``ratio`` times as often as the good. Without
    labels of either kind it is ``otherwise``; if no score separates, none goes.
    """
    good, bad = sum(x[1] for x in steps), sum(x[2] for x in steps)
    if not good or not bad:
        return otherwise
    found, over_good, over_bad = 1.0, 0, 0
    for score, is_good, is_bad in sorted(steps, reverse=True):
        if over_good > lost * good:
            break
        if over_bad and over_bad * good >= ratio * over_good * bad:
            found = score
        over_good += is_good
        over_bad += is_bad
    return found


@dataclass
class Judge:
    forests: dict[str, Forest]
    limits: dict[str, float]

    def scores(self, rows: np.ndarray) -> dict[str, np.ndarray]:
        """The score of each forest for rows as ``rule_counts`` gives them."""
        values = features(rows)
        # whole steps of 1/4096 make a score the same wherever it is computed
        return {k: np.round(x.score(values[:, [FEATURES.index(f) for f in FORESTS[k]]]) * 4096) / 4096 if len(rows) else np.zeros(0) for k, x in self.forests.items()}

    def kept(self, rows: np.ndarray) -> np.ndarray:
        good = ~((rows[:, 0] < 10) | (100 * rows[:, 4] > 20 * rows[:, 0]))
        for k, x in self.scores(rows).items():
            good &= x <= self.limits[k]
        return good


def scored(rows: DataFrame, judge: Judge) -> DataFrame:
    """``rows`` (doc_id and the rule counts) with the scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.stack([batch.column(x).to_numpy(zero_copy_only=False) for x in COUNTS], axis=1)
            found = judge.scores(values)
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, found.values())], [*batch.schema.names, *found])

    return rows.select("doc_id", *COUNTS).mapInArrow(run, "doc_id long, " + ", ".join(f"{x} long" for x in COUNTS) + ", " + ", ".join(f"{x} double" for x in judge.forests))


def fitted(rows: DataFrame, labels: DataFrame, trees: int = 100, size: int = 256, sample: int = 4096, lost: float = 0.002, ratio: float = 10.0, otherwise: float = 0.65, seed: int = 7) -> Judge:
    """Forests and limits for ``rows`` (doc_id and the rule counts of all documents).

    The forests are fitted on a bounded sample: of the labelled rows that pass
    the base rules, good and bad, or of all that pass if there are none, the
    ``sample`` that come first by a hash of their id. The limits come from all
    labelled rows that pass: see ``limit``.
    """
    passed = rows.filter(f"not ({BASE_FAILED})")
    known = labels.filter("quality in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
    labelled = passed.join(known, "doc_id")
    first = lambda x: x.orderBy(F.xxhash64("doc_id", F.lit(seed)), *COUNTS).limit(sample).select(COUNTS).toPandas().to_numpy(np.int64).reshape(-1, len(COUNTS))
    chosen = first(labelled)
    if not len(chosen):
        chosen = first(passed)
    values = features(chosen)
    forests = {k: grow(values[:, [FEATURES.index(f) for f in x]], trees, size, seed) if len(chosen) else Forest([], 1.0) for k, x in FORESTS.items()}
    judge = Judge(forests, {})
    judged = scored(labelled.drop("quality"), judge).join(known, "doc_id")
    # at most 4097 scores of each forest come to the driver
    kinds = F.inline(F.array(*(F.struct(F.lit(k).alias("forest"), F.col(k).alias("value")) for k in forests)))
    steps = judged.select("quality", kinds).groupBy("forest", "value").agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad")).collect()
    for k in forests:
        judge.limits[k] = limit([(x["value"], x["good"], x["bad"]) for x in steps if x["forest"] == k], lost, ratio, otherwise if k == "score" else 1.0)
    return judge


def quality_rules(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, the rule counts, base_failed, the scores, and kept of every document.

    ``labels``: doc_id, quality (1 good, 0 bad); ``options`` as in ``fitted``.
    Nulls: a null text has no words and fails the base rules, a null id or
    label calibrates nothing; an id with several labels counts as bad if one
    is. Repeated rows give repeated rows, empty tables none.
    """
    rows = stage(rule_statistics(docs), "rules")
    judge = fitted(rows, labels, **options)
    kept = F.expr(f"not ({BASE_FAILED})")
    for k, x in judge.limits.items():
        kept &= F.col(k) <= x
    return scored(rows, judge).withColumn("base_failed", F.expr(BASE_FAILED)).withColumn("kept", kept)


def good_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows and columns of ``docs`` that ``quality_rules`` keeps, each judged by its own text: no join, no shuffle of texts."""
    rows = stage(rule_statistics(docs), "rules")
    judge = fitted(rows, labels, **options)
    release(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([rule_counts(x) for x in texts(batch)], np.int64).reshape(-1, len(COUNTS))
            yield batch.filter(pa.array(judge.kept(found), pa.bool_()))

    typed = docs.withColumn("text", F.col("text").cast("string"))
    return typed.mapInArrow(run, typed.schema)
