"""Language-model scores by prediction with partial matching over bytes.

A text is modelled as its lower-cased words, each with a blank after it, then
a newline. The trie of byte contexts is learned from all training documents.
A byte that the longest known context has not seen costs an escape (method C:
as likely as the context has distinct bytes) to the next shorter context, in
which the bytes that the longer one has seen are excluded.

The trie is an array for each order. A byte's cost is found in it for many
bytes at once: the longest context first, the rest only for those that escape.

A byte's cost follows from it and the ORDER bytes before it. So costs are found
once for each gram that occurs, in shards: all contexts of two bytes and more
that a gram needs end in the same two bytes and meet there; the two shortest
orders go to every shard. Texts then look up frequent grams in a broadcast
table, and the others are joined: nothing that was counted is left out.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage, texts

ORDER = 4
END = b"\n"


def words_of(text: str) -> list[bytes]:
    return text.encode().lower().split()


def stream(words: list[bytes]) -> bytes:
    """What is modelled of a text: begins with the context of its first byte."""
    return END * ORDER + b" ".join([*words, END])


def grams(data: bytes | bytearray) -> np.ndarray:
    """The last ORDER + 1 bytes, the current one lowest, at each place of joined streams."""
    x = np.frombuffer(data, np.uint8).astype(np.int64)
    key = x[ORDER:].copy()
    for k in range(1, ORDER + 1):
        key |= x[ORDER - k : len(x) - k] << (8 * k)
    return key


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
    return key[first], np.add.reduceat(count, first) if len(key) else count


@dataclass
class Order:
    """Contexts of one length (sorted), and the bytes seen in them (sorted keys, the byte lowest)."""

    seen: np.ndarray
    log_count: np.ndarray
    context: np.ndarray
    log_total: np.ndarray  # of count + distinct
    log_escape: np.ndarray
    log_rest: np.ndarray  # the shorter context's count + distinct, without the bytes seen here
    log_rest_escape: np.ndarray


def _log(x: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.log10(x.astype(float))


class Trie:
    def __init__(self, tables: list[tuple[np.ndarray, np.ndarray]]):
        """tables: for each order from 0 the keys of order + 1 bytes, sorted, and their counts."""
        self.orders: list[Order] = []
        below: tuple | None = None
        for seen, count in tables:
            context, first, distinct = np.unique(seen >> 8, return_index=True, return_counts=True)
            total = np.add.reduceat(count, first) if len(first) else np.empty(0, np.int64)
            k = len(self.orders)
            if below is None:
                rest = np.full(len(context), 256) - distinct
                rest_distinct = rest
            else:
                # what the shorter context has counted of the bytes seen here
                shorter_seen, shorter_count, shorter_context, shorter_total, shorter_distinct = below
                parent = np.searchsorted(shorter_context, context & ((1 << (8 * (k - 1))) - 1))
                there = shorter_count[np.searchsorted(shorter_seen, seen & ((1 << (8 * k)) - 1))]
                rest_distinct = shorter_distinct[parent] - distinct
                rest = shorter_total[parent] - (np.add.reduceat(there, first) if len(first) else 0) + rest_distinct
            with np.errstate(divide="ignore", invalid="ignore"):
                # if nothing else was seen there, all goes on to the next shorter one
                escape = np.where(rest > 0, _log(rest_distinct) - _log(rest), 0.0)
            self.orders.append(Order(seen, _log(count), context, _log(total + distinct), _log(distinct) - _log(total + distinct), _log(rest), escape))
            below = (seen, count, context, total, distinct)

    def cost(self, key: np.ndarray) -> np.ndarray:
        """log10 of the probability of each place's byte in its context."""
        out = np.zeros(len(key))
        live = np.arange(len(key))
        from_longer = np.full(len(key), -1)  # the context that the place has escaped from
        for k in reversed(range(len(self.orders))):
            order = self.orders[k]
            if not len(live):
                break
            if not len(order.seen):
                continue
            own = key[live] & ((1 << (8 * (k + 1))) - 1)
            at = np.minimum(np.searchsorted(order.seen, own), len(order.seen) - 1)
            hit = order.seen[at] == own
            context = own >> 8
            c = np.minimum(np.searchsorted(order.context, context), len(order.context) - 1)
            known = order.context[c] == context
            longer = from_longer[live]
            escaped = longer >= 0
            above = self.orders[k + 1] if k + 1 < len(self.orders) else None
            total = order.log_total[c]
            escape = order.log_escape[c]
            if above is not None and escaped.any():
                total = np.where(escaped, above.log_rest[longer], total)
                escape = np.where(escaped, above.log_rest_escape[longer], escape)
            out[live] += np.where(hit, order.log_count[at] - total, np.where(known, escape, 0.0))
            from_longer[live] = np.where(known, c, -1)
            live = live[~hit]
        if len(live):
            order = self.orders[0] if self.orders and len(self.orders[0].seen) else None
            out[live] += -np.log10(256) if order is None else -order.log_rest[0]
        return out


def is_held_out(doc_id: Column) -> Column:
    """The fold that is never learned from: crc32 of the id as text, modulo 10, is 0. A null id is in none."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 10 == 0, F.lit(False))


def learn(docs: DataFrame) -> DataFrame:
    """Counts over whole training texts, summed up in each task: (word, null, n) and (null, gram, n).

    The grams of the held-out fold (``held_out``) come with them, counted as 0.
    """

    def rows(words: Counter, keys: list, counts: list) -> pa.RecordBatch:
        key, count = merged(keys, counts) if keys else (np.empty(0, np.int64), np.empty(0, np.int64))
        word = pa.concat_arrays([pa.array(words.keys(), pa.binary()), pa.nulls(len(key), pa.binary())])
        gram = pa.concat_arrays([pa.nulls(len(words), pa.int64()), pa.array(key, pa.int64())])
        n = pa.concat_arrays([pa.array(words.values(), pa.int64()), pa.array(count, pa.int64())])
        return pa.RecordBatch.from_arrays([word, gram, n], ["word", "gram", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        keys, counts, held = [], [], 0
        for batch in batches:
            own = list(map(words_of, texts(batch)))
            for only_seen in (False, True):
                data, starts = bytearray(), []
                found = [x for x, y in zip(own, batch.column("held_out").to_pylist(), strict=True) if y == only_seen]
                for k, x in enumerate(found):
                    if not only_seen:
                        words.update(x)
                        words[END] += 1
                    starts.append(len(data))
                    data += stream(x)
                    if len(data) > 4_000_000 or k + 1 == len(found):
                        key, count = np.unique(grams(data)[places(starts, len(data))], return_counts=True)
                        keys.append(key)
                        counts.append(count * (not only_seen))
                        held += len(key)
                        data, starts = bytearray(), []
            if held > 3_000_000:
                key, count = merged(keys, counts)
                keys, counts, held = [key], [count], len(key)
            if len(words) > 600_000 or held > 2_000_000:
                yield rows(words, keys, counts)
                words, keys, counts, held = Counter(), [], [], 0
        yield rows(words, keys, counts)

    return docs.select(F.col("text").cast("string"), "held_out").mapInArrow(run, "word binary, gram long, n long")


def places(starts: list[int], size: int) -> np.ndarray:
    """Which places of joined streams, from the ORDER-th on, belong to a text and not to the newlines before it."""
    own = np.ones(size, bool)
    for k in range(ORDER):
        own[np.array(starts) + k] = False
    return own[ORDER:]


def stream_costs(trie: Trie, data: bytes | bytearray, starts: list[int]) -> np.ndarray:
    """The cost of each of the joined streams that begin at ``starts``."""
    own = places(starts, len(data))
    cost = np.zeros(len(own))
    cost[own] = trie.cost(grams(data)[own])
    return np.add.reduceat(cost, starts)


def looked_up(often: np.ndarray, costs: np.ndarray, data: bytes | bytearray, starts: list[int]) -> tuple[np.ndarray, list, list]:
    """Of each of the joined streams: the costs of its grams that are in ``often`` (sorted), its other grams and how many times it has them."""
    own = places(starts, len(data))
    key = grams(data)[own]
    at = np.minimum(np.searchsorted(often, key), max(len(often) - 1, 0))
    hit = often[at] == key if len(often) else np.zeros(len(key), bool)
    cost = np.zeros(len(own))
    cost[own] = np.where(hit, costs[at], 0.0) if len(often) else 0.0
    text = np.searchsorted(starts, np.flatnonzero(own)[~hit], "right") - 1
    order = np.lexsort((key[~hit], text))
    text, key = text[order], key[~hit][order]
    first = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (key[1:] != key[:-1])]) if len(key) else np.empty(0, np.int64)
    times = np.diff(np.r_[first, len(key)])
    edges = np.searchsorted(text[first], np.arange(1, len(starts)))
    return np.add.reduceat(cost, starts), np.split(key[first], edges), np.split(times, edges)


def gram_costs(counted: DataFrame) -> DataFrame:
    """gram, n, cost of all rows of ``counted`` (gram, n) in the trie of those with an n over 0.

    A shard holds the grams whose context ends in the same two bytes, so 2^24
    at most.
    """
    spark = counted.sparkSession
    seen, short = counted.filter("n > 0"), []
    for k in range(2):
        # 256 and 65,536 keys at most
        found = seen.groupBy(F.col("gram").bitwiseAND(F.lit((1 << (8 * (k + 1))) - 1)).alias("key")).agg(F.sum("n").alias("n")).orderBy("key").toArrow()
        short.append((found.column("key").to_numpy(), found.column("n").to_numpy()))
    shared = spark.sparkContext.broadcast(short)

    def costs(key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        known, count = key[n > 0], n[n > 0]
        longer = [merged([known & ((1 << (8 * (k + 1))) - 1)], [count]) for k in range(2, ORDER + 1)]
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(n), pa.array(Trie([*shared.value, *longer]).cost(key))], ["gram", "n", "cost"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = [], [], 0
        for batch in batches:
            keys.append(batch.column("gram").to_numpy())
            counts.append(batch.column("n").to_numpy())
            held += len(keys[-1])
            if held < 500_000:
                continue
            # all but the last shard, which may go on
            key, n = np.concatenate(keys), np.concatenate(counts)
            shard = key >> 8 & 0xFFFF
            whole = int(np.searchsorted(shard, shard[-1]))
            if whole:
                yield costs(key[:whole], n[:whole])
            keys, counts = [key[whole:]], [n[whole:]]
            held = len(key) - whole if whole else 0
        if keys:
            yield costs(np.concatenate(keys), np.concatenate(counts))

    shard = F.shiftright("gram", 8).bitwiseAND(F.lit(0xFFFF))
    dealt = counted.select("gram", "n", shard.alias("shard")).repartition("shard").sortWithinPartitions("shard")
    return dealt.select("gram", "n").mapInArrow(run, "gram long, n long, cost double")


def at_most(rows: DataFrame, most: int) -> int:
    """The least power of two so that at most ``most`` rows have an n of it or more."""
    steps = rows.groupBy(F.floor(F.log2("n")).alias("power")).count().orderBy(F.desc("power")).collect()
    power, total = 0, 0
    for x in steps:
        total += x["count"]
        if total > most:
            power = int(x["power"]) + 1
            break
    return 1 << power


def score(docs: DataFrame, most_grams: int = 2_000_000, most_words: int = 250_000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every whole text.

    Learned from all rows but the held-out fold. Two bounds keep what the
    workers hold fixed, and neither drops a count: the costs of byte grams
    beyond the ``most_grams`` most frequent, and words beyond the
    ``most_words`` most frequent, are joined instead of broadcast. A
    null or empty text is its end alone; a null doc_id is in no held-out
    fold and stays null; repeated rows count and are scored again; an empty
    table gives no rows; extra columns change nothing. A very long text is
    scored by itself, in memory of its size.
    """
    spark = docs.sparkSession
    partial = stage(learn(docs.select("text", is_held_out(F.col("doc_id")).alias("held_out"))), "counts")
    words = stage(partial.filter("word is not null").groupBy("word").agg(F.sum("n").alias("n")), "words")
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).head()
    often = at_most(words, most_words)
    known = words.filter(F.col("n") >= often).select("word", "n").toArrow()
    logs = dict(zip(known.column("word").to_pylist(), np.log10(known.column("n").to_numpy().astype(float) + 0.1).tolist(), strict=True))
    counted = stage(partial.filter("gram is not null").groupBy("gram").agg(F.sum("n").alias("n")), "grams")
    costs = stage(gram_costs(counted), "costs")
    often_gram = at_most(counted.filter("n > 0"), most_grams)
    found = costs.filter(F.col("n") >= often_gram).select("gram", "cost").toArrow()
    order = np.argsort(found.column("gram").to_numpy())
    # at most ``most_words`` words and ``most_grams`` grams
    shared = spark.sparkContext.broadcast((logs, found.column("gram").to_numpy()[order], found.column("cost").to_numpy()[order]))
    del known, logs, found, order

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs, often_grams, often_costs = shared.value
        for batch in batches:
            out: dict[str, list] = {"n_tokens": [], "n_often": [], "sum_often": [], "rare": []}
            scores: dict[str, list] = {"score": [], "grams": [], "times": []}
            data, starts = bytearray(), []
            found = texts(batch)
            for k, text in enumerate(found):
                own = words_of(text)
                values = [logs.get(x) for x in own]
                values.append(logs.get(END))
                there = [x for x in values if x is not None]
                out["n_tokens"].append(len(values))
                out["n_often"].append(len(there))
                out["sum_often"].append(sum(there))
                out["rare"].append([x for x, y in zip([*own, END], values, strict=True) if y is None] if len(there) < len(values) else [])
                starts.append(len(data))
                data += stream(own)
                if len(data) > 2_000_000 or k + 1 == len(found):
                    for name, x in zip(scores, looked_up(often_grams, often_costs, data, starts), strict=True):
                        scores[name].extend(x)
                    data, starts = bytearray(), []
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(out["n_tokens"], pa.int64()), pa.array(out["n_often"], pa.int64()), pa.array(out["sum_often"], pa.float64()), pa.array(out["rare"], pa.list_(pa.binary())), pa.array(scores["score"], pa.float64()), pa.array(scores["grams"], pa.list_(pa.int64())), pa.array(scores["times"], pa.list_(pa.int64()))], ["doc_id", "held_out", "n_tokens", "n_often", "sum_often", "rare", "score", "grams", "times"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), is_held_out(F.col("doc_id")).alias("held_out"))
    scored = rows.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_often long, sum_often double, rare array<binary>, score double, grams array<long>, times array<long>")
    scored = stage(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    rare = scored.select("row", F.explode("rare").alias("word")).join(words.filter(F.col("n") < often), "word", "left")
    sums = rare.groupBy("row").agg(F.count("n").alias("n_rare"), F.sum(F.log10(F.coalesce("n", F.lit(0)) + F.lit(0.1))).alias("sum_rare"))
    missed = scored.select("row", F.explode(F.arrays_zip("grams", "times")).alias("x")).select("row", F.col("x.grams").alias("gram"), "x.times")
    rest = missed.join(costs.filter(F.col("n") < often_gram), "gram").groupBy("row").agg(F.sum(F.col("times") * F.col("cost")).alias("rest"))
    n_known = F.col("n_often") + F.coalesce("n_rare", F.lit(0))
    base = F.col("sum_often") + F.coalesce("sum_rare", F.lit(0.0)) - F.col("n_tokens") * F.lit(float(np.log10(total + 0.1 * (distinct + 1))))
    score = F.col("score") + F.coalesce("rest", F.lit(0.0))
    return scored.drop("rare", "grams", "times").join(sums, "row", "left").join(rest, "row", "left").select("doc_id", "held_out", "n_tokens", n_known.alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), score.alias("score"))
