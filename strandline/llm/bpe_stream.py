"""Byte-pair encoding as a streaming transducer, and its inverse.

Two tokens are compatible if their joined bytes encode as just those two. A
token sequence is the encoding of its bytes exactly if all neighbours in it are
compatible, so the encoding of a prefix is known from its last token: the one
token ending there that is compatible with the last token of the prefix before
it. No token is longer than the vocabulary's longest one. The encoding of any
longer text therefore passes through one of the last so many prefixes, and
tokens on which all of these agree are stable and can go out. Memory is bound
by the lookahead that the merge list needs, not by the text.
"""

from __future__ import annotations

import codecs
import json
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts
from .tokens import Cache, chunks_of

PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def byte_names() -> dict[str, int]:
    """The printable characters that stand for bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            loaded = json.load(file)
        model, names = loaded["model"], byte_names()
        self.special = {x["content"]: x["id"] for x in loaded["added_tokens"]}
        as_bytes = lambda name: bytes(names[c] for c in name)
        self.ids = {as_bytes(k): v for k, v in model["vocab"].items() if k not in self.special}
        self.bytes: list[bytes] = [b""] * (1 + max([*self.ids.values(), *self.special.values()]))
        for k, v in self.ids.items():
            self.bytes[v] = k
        for k, v in self.special.items():
            self.bytes[v] = k.encode()
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = (as_bytes(x) for x in (pair if isinstance(pair, list) else pair.split(" ")))
            self.merges.setdefault((self.ids[left], self.ids[right]), (rank, self.ids[left + right]))
        self.single = [self.ids[bytes([b])] for b in range(256)]
        self.window = max(map(len, self.ids))
        # tokens by their bytes from the last to the first
        self.ending: dict = {}
        for token, i in self.ids.items():
            node = self.ending
            for b in reversed(token):
                node = node.setdefault(b, {})
            node[-1] = i
        self.pairs: dict[tuple[int, int], bool] = {}
        self.alone = {i for i in self.ids.values() if self.merged(self.bytes[i]) == [i]}
        self.lookahead = sufficient_lookahead(self)

    def merged(self, text: bytes) -> list[int]:
        """The encoding of a short string, by the definition: the best-ranked pair first, the leftmost of equals."""
        ids = [self.single[b] for b in text]
        while len(ids) > 1:
            best = min(zip(ids, ids[1:], strict=False), key=lambda p: self.merges.get(p, (1 << 60,))[0])
            if best not in self.merges:
                break
            made, out, k = self.merges[best][1], [], 0
            while k < len(ids):
                if k + 1 < len(ids) and (ids[k], ids[k + 1]) == best:
                    out.append(made)
                    k += 2
                else:
                    out.append(ids[k])
                    k += 1
            ids = out
        return ids

    def compatible(self, left: int, right: int) -> bool:
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) > 400_000:
                self.pairs.clear()
            known = self.pairs[left, right] = self.merged(self.bytes[left] + self.bytes[right]) == [left, right]
        return known


def sufficient_lookahead(vocabulary: Vocabulary) -> int:
    """Bytes after which a boundary can no longer change, for this merge list.

    A change travels to the left over one boundary only by a merge that ranks
    before the one that caused it, so it crosses at most as many boundaries as
    the merges can be chained with one's right part being another's result,
    each over at most the longest token.
    """
    depth: dict[int, int] = {}
    for (left, right), (_, made) in sorted(vocabulary.merges.items(), key=lambda x: x[1][0]):
        depth[made] = max(depth.get(made, 0), 1 + max(depth.get(left, 0), depth.get(right, 0)))
    return (1 + max(depth.values(), default=0)) * vocabulary.window


class Transducer:
    """Bytes of one pre-token in, its stable tokens out."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.reset()

    def reset(self) -> None:
        self.buffer = bytearray()
        self.last: list[int] = []  # of each prefix that isn't given out
        self.before = -1  # the token before the buffer

    def feed(self, data: bytes) -> Iterator[int]:
        v, buffer, last = self.v, self.buffer, self.last
        for b in data:
            buffer.append(b)
            node, i, found = v.ending, len(buffer), []
            k = i
            while k and (node := node.get(buffer[k - 1])) is not None:
                k -= 1
                if (token := node.get(-1)) is not None:
                    found.append((k, token))
            for k, token in reversed(found):
                left = last[k - 1] if k else self.before
                if token in v.alone if left < 0 else v.compatible(left, token):
                    last.append(token)
                    break
            if i >= v.lookahead + 2 * v.window:
                yield from self.stable()

    def chain(self, end: int) -> Iterator[int]:
        while end:
            yield end
            end -= len(self.v.bytes[self.last[end - 1]])

    def stable(self) -> list[int]:
        """The tokens before the last boundary that all live prefixes share."""
        n = len(self.buffer)
        shared = set(self.chain(n))
        for end in range(max(1, n - self.v.window + 1), n):
            shared &= set(self.chain(end))
        return self.give(max(shared, default=0))

    def give(self, end: int) -> list[int]:
        out = [self.last[k - 1] for k in self.chain(end)][::-1]
        if out:
            self.before = out[-1]
            del self.buffer[:end]
            del self.last[:end]
        return out

    def finish(self) -> list[int]:
        out = self.give(len(self.buffer))
        self.reset()
        return out


class Encoder:
    """Packed ids of whole texts; bounded caches keep pre-tokens and chunks."""

    def __init__(self, path: str):
        self.v = Vocabulary(path)
        self.transducer = Transducer(self.v)
        self.pretokens = Cache(self.transduced, 200_000)
        self.rest = Cache(lambda x: self.chunk(" " + x), 250_000)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.v.special, key=len, reverse=True))) + ")") if self.v.special else None

    def transduced(self, text: str) -> bytes:
        out = array("I", self.transducer.feed(text.encode()))
        out.extend(self.transducer.finish())
        return out.tobytes()

    def plain(self, text: str) -> bytes:
        return b"".join(map(self.pretokens.__getitem__, PATTERN.findall(text)))

    def chunk(self, text: str) -> bytes:
        if self.specials is None or not self.specials.search(text):
            return self.plain(text)
        parts = self.specials.split(text)
        return b"".join(array("I", [self.v.special[x]]).tobytes() if k % 2 else self.plain(x) for k, x in enumerate(parts))

    def packed(self, group: list[str]) -> list[bytes]:
        rest = self.rest.__getitem__
        return [self.chunk(x[0]) + b"".join(map(rest, x[1:])) for x in map(chunks_of, group)]


class ByteToText:
    """Tokens' bytes in, text out as soon as its characters are whole; bytes that are no UTF-8 become U+FFFD."""

    def __init__(self) -> None:
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, data: bytes) -> str:
        return self.machine.decode(data)

    def finish(self) -> str:
        return self.machine.decode(b"", True)


def decoded(ids: Iterable[int], vocabulary: Vocabulary, block: int = 65_536) -> str:
    machine, ids, out = ByteToText(), array("I", ids), []
    for at in range(0, len(ids), block):
        out.append(machine.feed(b"".join(map(vocabulary.bytes.__getitem__, ids[at : at + block]))))
    return "".join([*out, machine.finish()])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit) and what they decode to, of every whole text.

    A null text is the empty one and has no ids; a null doc_id stays null;
    repeated rows give repeated rows, an empty table none; extra columns change
    nothing. A very long text and its ids are one row; the coder's own memory
    doesn't grow with it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)

        def row_group(ids: list, group: list[str]) -> pa.RecordBatch:
            packed = coder.packed(group)
            back = [decoded(array("I", x), coder.v) for x in packed]
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(x) // 4 for x in packed], pa.int64()), pa.array(packed, pa.binary()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])

        for batch in batches:
            ids, group, size = [], [], 0
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts(batch), strict=True):
                ids.append(doc_id)
                group.append(text)
                size += len(text)
                if size > 2_000_000:
                    yield row_group(ids, group)
                    ids, group, size = [], [], 0
            if group:
                yield row_group(ids, group)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded string")
