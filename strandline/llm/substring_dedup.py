"""Removal of byte strings that occur twice, over a whole corpus.

Every window of ``length`` bytes is filed under its anchor: the place of the
least hash of a short gram in it, the rightmost of equals. The anchor follows
from the window's bytes alone, so equal windows meet under the same gram. The
windows of one anchor are neighbours and make one item.

Items meet by gram. Where all items of a gram are the same text, all their
windows are repeated; a gram that one item has repeats nothing. What is left
goes, each different text once, into shards of bounded size, whose repeated
windows come from interval expansion on a Burrows-Wheeler transform. A gram
with too many different texts is split by where in the window it stands: the
halves are filed under longer strings, again and again if need be, until the
string is the window itself. In a shard, texts that share no longer string
around their gram with another go before the expansion.

So what equal texts around a gram repeat is known from their equality, before
any transform; on the smallest tables that is 38 % of the windows under grams
that repeat. Only what different texts share comes from the expansion.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release, stage
from .interval_expansion import repeated_windows

GRAM = 32
_PIECE = 22  # bits of a place in a chunk of text
_TABLE = np.random.default_rng(11).integers(1, 1 << 62, 256, dtype=np.uint64)
#: Of an item: key (of the gram), s1 and s2 (of its text), the row's identity, its first and last window, its anchor.
ITEM = "key long, s1 long, s2 long, r1 long, r2 long, lo long, hi long, anchor long"


def row_identity(doc_id: Column, text: Column) -> list[Column]:
    """Two hashes of the id and the text; rows that are equal in both are the same document, twice."""
    return [F.xxhash64(doc_id, text).alias("r1"), F.xxhash64(F.lit(1), text, doc_id).alias("r2")]


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each place."""
    h, width = _TABLE[data], 1
    while width < GRAM:
        h = h[: len(h) - width] * np.uint64(0x9E3779B97F4A7C15) + h[width:]
        h ^= h >> np.uint64(29)
        width *= 2
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    n = len(values)
    rows = -(-n // width)
    padded = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    padded = padded.reshape(rows, width)
    forward = np.minimum.accumulate(padded, axis=1).ravel()
    backward = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    count = n - width + 1
    return np.minimum(backward[:count], forward[width - 1 : width - 1 + count])


def items(data: bytes, begins: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first and last window of each item of the texts data[begins:ends]."""
    none = np.empty(0, np.int64)
    if len(data) < length:
        return none, none, none
    hashes = gram_hashes(np.frombuffer(data, np.uint8))
    last_place = np.uint64((1 << _PIECE) - 1)
    hashes = (hashes & ~last_place) | (last_place - np.arange(len(hashes), dtype=np.uint64))
    anchor = (last_place - (window_minima(hashes, length - GRAM + 1) & last_place)).astype(np.int64)
    # windows that lie in one text
    step = np.zeros(len(data) + 1, np.int32)
    long = ends - begins >= length
    np.add.at(step, begins[long], 1)
    np.add.at(step, ends[long] - length + 1, -1)
    inside = np.flatnonzero(np.cumsum(step)[: len(anchor)])
    if not len(inside):
        return none, none, none
    anchor = anchor[inside]
    new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (inside[1:] != inside[:-1] + 1)])
    return anchor[new], inside[new], inside[np.r_[new[1:] - 1, len(inside) - 1]]


def _signed(digest: bytes) -> tuple[int, int]:
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def text_digest(text: bytes, before: int) -> tuple[int, int]:
    """Of an item's text and the bytes of it before the anchor."""
    return _signed(xxhash.xxh3_128_digest(text, seed=before))


def found_items(rows: DataFrame, length: int) -> DataFrame:
    """The items of all ``rows`` (r1, r2, text)."""
    most = (1 << _PIECE) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64()] * 8
        names = ["key", "s1", "s2", "r1", "r2", "lo", "hi", "anchor"]

        def emit(data: bytes, pieces: list[tuple]) -> pa.RecordBatch:
            begins = np.array([x[0] for x in pieces], np.int64)
            ends = np.array([x[1] for x in pieces], np.int64)
            anchor, lo, hi = items(data, begins, ends, length)
            owner = np.searchsorted(begins, lo, side="right") - 1
            shift = np.array([x[4] for x in pieces], np.int64)[owner] - begins[owner]
            gram, digest = xxhash.xxh3_64_intdigest, text_digest
            key = np.array([gram(data[a : a + GRAM]) for a in anchor.tolist()], np.uint64).view(np.int64)
            text = np.array([digest(data[a : b + length], c - a) for a, b, c in zip(lo.tolist(), hi.tolist(), anchor.tolist(), strict=True)], np.int64).reshape(-1, 2)
            r = np.array([x[2:4] for x in pieces], np.int64).reshape(-1, 2)[owner]
            columns = [key, text[:, 0], text[:, 1], r[:, 0], r[:, 1], lo + shift, hi + shift, anchor + shift]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], names)

        for batch in batches:
            data, pieces = bytearray(), []
            for r1, r2, text in zip(*(batch.column(x).to_pylist() for x in ("r1", "r2", "text")), strict=True):
                own = (text or "").encode()
                if len(own) < length:
                    continue
                # parts of a very long text overlap so that each window is in one of them
                for at in range(0, len(own) - length + 1, most - length + 1):
                    part = own[at : at + most]
                    if len(data) + len(part) > most:
                        yield emit(bytes(data), pieces)
                        data, pieces = bytearray(), []
                    pieces.append((len(data), len(data) + len(part), r1, r2, at))
                    data += part
            if pieces:
                yield emit(bytes(data), pieces)

    return rows.mapInArrow(run, ITEM)


#: A different text under a key: m rows have it; ``before`` bytes of it stand before the anchor. The origin names the
#: item that it is part of, ``base`` its first window there.
REGION = "key long, s1 long, s2 long, m long, before long, text binary, o_key long, o_s1 long, o_s2 long, base long"
_NAMES = [x.split()[0] for x in REGION.split(", ")]


def cut_out(rows: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """Regions of the texts: ``wanted`` has an array of structs for each row identity.

    The join sorts by it, so of equal rows only the first in a task is cut.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            for *own, text, asked in zip(*(batch.column(x).to_pylist() for x in ("r1", "r2", "text", "asked")), strict=True):
                if own == last:
                    continue
                last, data = own, text.encode()
                out = [(x["key"], x["s1"], x["s2"], x["m"], x["anchor"] - x["lo"], data[x["lo"] : x["hi"] + length], x["key"], x["s1"], x["s2"], 0) for x in asked]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary() if k == 5 else pa.int64()) for k, x in enumerate(zip(*out, strict=True))], _NAMES)

    return rows.join(wanted, ["r1", "r2"]).select("r1", "r2", "text", "asked").mapInArrow(run, REGION)


def halves(regions: DataFrame, size: int, length: int) -> DataFrame:
    """Regions cut where the anchor's distance into the window passes multiples of ``size``, with keys of what all windows of a part share."""

    def made(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.binary() if k == 5 else pa.int64()) for k, x in enumerate(zip(*out, strict=True))], _NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held = 0
        for batch in batches:
            for x in batch.to_pylist():
                text, before, windows = x["text"], x["before"], len(x["text"]) - length + 1
                # window k has the anchor at before - k
                for cell in range(max(0, before - windows + 1) // size, before // size + 1):
                    first, last = max(0, before - (cell + 1) * size + 1), min(windows - 1, before - cell * size)
                    if first > last:
                        continue
                    core = text[max(0, before - cell * size) : before - (cell + 1) * size + 1 + length]
                    part = text[first : last + length]
                    key = int.from_bytes(xxhash.xxh3_64_digest(core, seed=(x["key"] ^ cell) & (1 << 64) - 1), "little", signed=True)
                    out.append((key, *text_digest(part, before - first), x["m"], before - first, part, x["o_key"], x["o_s1"], x["o_s2"], x["base"] + first))
                    held += len(part)
                # near the end a region has as many parts as windows, each as long as a window
                if held > 1 << 22:
                    yield made(out)
                    out, held = [], 0
        if out:
            yield made(out)

    return regions.mapInArrow(run, REGION)


def groups(rows: DataFrame, m: Column) -> DataFrame:
    """key, alike (all texts under it are the same) of the keys that repeat."""
    return rows.groupBy("key").agg(F.sum(m).alias("total"), ((F.min("s1") == F.max("s1")) & (F.min("s2") == F.max("s2"))).alias("alike")).filter("total > 1").select("key", "alike")


RANGE = "o_key long, o_s1 long, o_s2 long, first long, last long"


def ranges(regions: DataFrame, length: int) -> DataFrame:
    """All windows of regions, as ranges of their origins."""
    return regions.select("o_key", "o_s1", "o_s2", F.col("base").alias("first"), (F.col("base") + F.octet_length("text") - length).alias("last"))


def may_repeat(regions: Iterable[tuple[int, int, bytes]], length: int, cells: int = 4) -> np.ndarray:
    """Which regions (key, before, text) have a window that may be another's, too.

    Windows are told apart by where the anchor stands in them, in ``cells``
    ranges. All windows of a range share a string; a region none of whose
    strings is under its key a second time repeats nothing.
    """
    size = -(-(length - GRAM + 1) // cells)
    digest, first, repeats = xxhash.xxh3_64_intdigest, {}, []
    for k, (key, before, text) in enumerate(regions):
        repeats.append(False)
        for cell in range(max(0, before - len(text) + length) // size, before // size + 1):
            core = text[max(0, before - cell * size) : before - (cell + 1) * size + 1 + length]
            j = first.setdefault((key, digest(core, seed=cell)), k)
            if j != k:
                repeats[j] = repeats[k] = True
    return np.array(repeats, bool)


def expanded(regions: DataFrame, shards: int, length: int) -> DataFrame:
    """The repeated windows of regions, shard by shard. A shard gets all regions of its keys."""

    def run(table: pa.Table) -> pa.Table:
        table = table.filter(pa.array(may_repeat(zip(*(table.column(x).to_pylist() for x in ("key", "before", "text")), strict=True), length)))
        texts = table.column("text").to_pylist()
        out = []
        origin = list(zip(*(table.column(x).to_pylist() for x in ("m", "o_key", "o_s1", "o_s2", "base")), strict=True))
        for (m, *name, base), windows in zip(origin, repeated_windows(texts, length), strict=True):
            if m > 1 or not windows.any():
                continue
            edge = np.flatnonzero(np.diff(np.r_[False, windows, False].astype(np.int8)))
            out += [(*name, base + int(a), base + int(b) - 1) for a, b in zip(edge[::2], edge[1::2], strict=True)]
        return pa.table([pa.array(x, pa.int64()) for x in (zip(*out, strict=True) if out else [[]] * 5)], names=["o_key", "o_s1", "o_s2", "first", "last"])

    shard = F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard")
    return regions.groupBy(shard).applyInArrow(run, RANGE)


def repeated_ranges(rows: DataFrame, length: int, shard_bytes: int, group_bytes: int) -> DataFrame:
    """r1, r2, cut (structs of begin and end) of all byte ranges of ``rows`` (r1, r2, text) that repeated windows cover; they may overlap.

    Keys that repeat are staged before they are joined. So both sides of such
    a join are plain exchanges, and Spark splits a key that has many rows.
    """
    found = stage(found_items(rows, length), "items")
    repeated = stage(groups(found, F.lit(1)), "groups")
    met = found.join(repeated, "key")
    span = [F.col("lo").alias("begin"), (F.col("hi") + length).alias("end")]
    result = met.filter("alike").select("r1", "r2", *span)

    # different texts under a gram: each once, with its count
    mixed = stage(met.filter("not alike").drop("alike"), "mixed")
    texts = mixed.groupBy("key", "s1", "s2").agg(F.count("*").alias("m"), F.min(F.struct("r1", "r2", "lo", "hi", "anchor")).alias("at"))
    asked = texts.groupBy("at.r1", "at.r2").agg(F.collect_list(F.struct("key", "s1", "s2", "m", "at.lo", "at.hi", "at.anchor")).alias("asked"))
    now = stage(cut_out(rows, asked, length), "regions")
    own = [found, repeated, mixed, now]
    repeats = now.filter("m > 1").transform(ranges, length)
    size = 1 << (length - GRAM).bit_length()
    while True:
        sizes = now.groupBy("key").agg(F.sum(F.octet_length("text")).alias("bytes"))
        total, hot = sizes.agg(F.coalesce(F.sum(F.when(F.col("bytes") <= group_bytes, F.col("bytes"))), F.lit(0)), F.count_if(F.col("bytes") > group_bytes)).head()
        small = now
        if hot:
            large = stage(sizes.filter(F.col("bytes") > group_bytes).select("key"), "hot")
            own.append(large)
            small = now.join(large, "key", "left_anti")
        if total:
            repeats = repeats.unionByName(expanded(small, -(-total // shard_bytes), length))
        if not hot:
            break
        size = max(1, size // 2)
        parts = stage(halves(now.join(large, "key", "left_semi"), size, length), "parts")
        repeated = stage(groups(parts, F.col("m")), "groups")
        met = parts.join(repeated, "key")
        repeats = repeats.unionByName(met.filter("alike").transform(ranges, length))
        mixed_parts = met.filter("not alike").drop("alike")
        once = mixed_parts.groupBy("key", "s1", "s2").agg(F.sum("m").alias("m"), F.min(F.struct("o_key", "o_s1", "o_s2", "base", "before", "text")).alias("x"))
        now = stage(once.select("key", "s1", "s2", "m", "x.before", "x.text", "x.o_key", "x.o_s1", "x.o_s2", "x.base"), "regions")
        own += [parts, repeated, now]
        # a part that several origins have is repeated in all of them
        shared = now.filter("m > 1").select("key", "s1", "s2")
        repeats = repeats.unionByName(mixed_parts.join(shared, ["key", "s1", "s2"], "left_semi").transform(ranges, length))
    repeats = repeats.select(F.col("o_key").alias("key"), F.col("o_s1").alias("s1"), F.col("o_s2").alias("s2"), "first", "last").distinct()
    more = mixed.join(repeats, ["key", "s1", "s2"]).select("r1", "r2", (F.col("lo") + F.col("first")).alias("begin"), (F.col("lo") + F.col("last") + length).alias("end"))
    cut = stage(result.unionByName(more).groupBy("r1", "r2").agg(F.collect_set(F.struct("begin", "end")).alias("cut")), "cuts")
    release(*own)
    return cut


def passages(data: bytes, cut: Iterable[dict], least_words: int) -> list[list[int]]:
    """Maximal runs [begin, end] of what is cut.

    With ``least_words`` a run is first trimmed to the whole words in it, so
    that no word loses a part, and goes only if it has that many. The blanks
    before and behind it stay but for those behind, of which none is needed
    where others stand before: neighbours are still apart.
    """
    runs: list[list[int]] = []
    for x in sorted((x["begin"], x["end"]) for x in cut):
        if runs and x[0] <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], x[1])
        else:
            runs.append(list(x))
    if not least_words:
        return runs
    return [x for x in (word_edges(data, *x) for x in runs) if len(data[x[0] : x[1]].split()) >= least_words]


def word_edges(data: bytes, begin: int, end: int) -> list[int]:
    """data[begin:end] without words that stand in it only in part, and without blanks at its start; those behind it go with it.

    A run at the start of a text may end behind its blanks, one at the end
    leaves those before it.
    """
    blank = lambda k: data[k : k + 1].isspace()
    if 0 < begin < len(data) and not blank(begin - 1):
        while begin < end and not blank(begin):
            begin += 1
    while begin < end and blank(begin):
        begin += 1
    if end < len(data) and not blank(end):
        while end > begin and not blank(end - 1):
            end -= 1
    else:
        while end < len(data) and blank(end):
            end += 1
    return [begin, end]


def without_repeats(docs: DataFrame, length: int = 400, least_words: int = 0, shard_bytes: int = 3 << 19, group_bytes: int = 1 << 20) -> DataFrame:
    """All rows of ``docs`` with kept (the bytes that stay), n_bytes, n_removed and n_spans (maximal removed runs).

    A byte goes if a string of ``length`` bytes that covers it starts at
    another place too, in the same row or another; strings are judged on the
    input. With ``least_words``, runs are trimmed to whole words, and those of
    fewer stay; words apart stay apart. A null or short text keeps all it has; a repeated row repeats its text. Columns of
    ``docs`` stay, whatever their names; the new ones come last and replace
    those that have their names.
    """
    if length <= GRAM:
        raise ValueError(f"length must be over {GRAM}")
    new = ("kept", "n_bytes", "n_removed", "n_spans")
    names = [x for x in docs.columns if x.lower() not in new]
    # columns go by their places, so that no name of theirs meets one used here
    placed = docs.select(*(F.col(f"`{x}`").cast("string" if x == "text" else docs.schema[x].dataType).alias(f"c{k}") for k, x in enumerate(names)))
    text, doc_id = f"c{names.index('text')}", f"c{names.index('doc_id')}"
    rows = placed.select(*row_identity(F.col(doc_id), F.col(text)), F.col(text).alias("text"))
    cut = repeated_ranges(rows.filter(F.octet_length("text") >= length), length, shard_bytes, group_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, removed, spans, sizes = [], [], [], []
            for own, cuts in zip(batch.column(text).to_pylist(), batch.column("cut").to_pylist(), strict=True):
                data = (own or "").encode()
                sizes.append(len(data))
                runs = passages(data, cuts or (), least_words)
                out, at = [], 0
                for a, b in runs:
                    out.append(data[at:a])
                    at = b
                out.append(data[at:])
                kept.append(b"".join(out))
                removed.append(len(data) - len(kept[-1]))
                spans.append(len(runs))
            found = [pa.array(kept, pa.binary()), *(pa.array(x, pa.int64()) for x in (sizes, removed, spans))]
            yield pa.RecordBatch.from_arrays([*(batch.column(f"c{k}") for k in range(len(names))), *found], [*(f"c{k}" for k in range(len(names))), *new])

    joined = placed.withColumns(dict(zip(("r1", "r2"), row_identity(F.col(doc_id), F.col(text)), strict=True))).join(cut, ["r1", "r2"], "left").select(*placed.columns, "cut")
    types = ", ".join(f"{x.name} {x.dataType.simpleString()}" for x in placed.schema.fields)
    return joined.mapInArrow(run, f"{types}, kept binary, n_bytes long, n_removed long, n_spans long").toDF(*names, *new)
