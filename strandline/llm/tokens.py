"""Token ids of whole texts by way of chunks between blanks.

The pre-tokenizers of the vocabularies used here never join what stands on
both sides of certain blanks, so a text's ids are those of its chunks, one
after another. Chunks repeat; a bounded cache keeps what the library gave.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import regex
import tiktoken

#: A blank is no safe place to cut if white space stands on both sides of it, or before it at the end.
_UNSAFE = re.compile(r"\s (?:\s|\Z)")
_SAFE = re.compile(r"(?<!\s) | (?=\S)")


class Cache(dict):
    """What ``make`` gives, kept in two generations of at most ``cap`` entries each."""

    def __init__(self, make: Callable[[str], bytes], cap: int):
        super().__init__()
        self.make, self.cap, self.old = make, cap, {}

    def __missing__(self, key: str) -> bytes:
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        if len(key) <= 64:
            if len(self) >= self.cap:
                self.old = dict(self)
                self.clear()
            self[key] = found
        return found


def chunks_of(text: str) -> list[str]:
    """Chunks of a text for byte-level pre-tokenizers; all but the first lost the blank before them."""
    return _SAFE.split(text) if _UNSAFE.search(text) else text.split(" ")


@lru_cache(maxsize=4)
def library(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(path)
    loaded.no_padding()
    loaded.no_truncation()
    return loaded


def byte_letters() -> dict[int, str]:
    """The printable characters that stand for bytes in these vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


#: Stands for the end of a word in vocabularies that drop white space; their own token for that byte takes a value that UTF-8 never has.
END_OF_WORD = b" "
_FREED = bytes.maketrans(b" \xff", b"\xff ")


def token_bytes(path: str) -> tuple[dict[bytes, int], list[tuple[bytes, bytes]], bytes]:
    """A vocabulary's tokens as bytes with their ids, its merges in their order, and what ends each word."""
    model = json.loads(library(path).to_str())["model"]
    suffix = model["end_of_word_suffix"] or ""
    byte_of = {letter: b for b, letter in byte_letters().items()}

    def plain(token: str) -> bytes:
        ends = bool(suffix) and token.endswith(suffix)
        found = bytes(byte_of[x] for x in (token.removesuffix(suffix) if ends else token))
        return found.translate(_FREED) + END_OF_WORD * ends if suffix else found

    special = {x.content for x in library(path).get_added_tokens_decoder().values()}
    merges = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]]
    return {plain(x): k for x, k in model["vocab"].items() if x not in special}, [(plain(a), plain(b)) for a, b in merges], END_OF_WORD if suffix else b""


@lru_cache(maxsize=4)
def ranks_decide(path: str) -> bool:
    """Whether merging by the ids of what results is merging by the vocabulary's list of merges.

    It is if ids ascend with the merges and the list merges each token's own
    bytes to that token: then two neighbours that make up a token can only be
    the pair that the list has for it, as all that was merged within them
    before is what would have been merged in that token alone.
    """
    ids, merges, end = token_bytes(path)
    rank = {}
    for a, b in merges:
        rank.setdefault((a, b), len(rank))
    made = [ids.get(a + b, -1) for a, b in merges]
    first = {bytes([x]) for x in range(256)} | ({bytes([x]) + end for x in range(256)} if end else set())
    if sorted(made) != made or len(set(made)) != len(made) or not first <= ids.keys() or max(ids[x] for x in first) > min(made, default=len(ids)):
        return False
    far = len(rank)
    for a, b in merges:
        token = a + b
        parts = [token[k : k + 1] for k in range(len(token))]
        if end and parts[-1] == end:
            parts[-2:] = [parts[-2] + end]
        while len(parts) > 1:
            best, at = min((rank.get(pair, far), k) for k, pair in enumerate(zip(parts, parts[1:], strict=False)))
            if best == far:
                return False
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return True


class PreTokens:
    """Packed ids of chunks.

    Chunks of plain Latin text are cut here by the vocabulary's pattern, and
    each pre-token that a bounded cache doesn't hold is merged: by the ids of
    what results (``by_rank``, where ``ranks_decide`` holds) or by the library's
    model. Others (combining marks, other scripts, odd blanks, special strings)
    go through the whole library.
    """

    plain = re.compile("[!-~\n\r\t¡-įı-ɏ]*")

    def __init__(self, path: str, pattern: str, lower: bool, kind: str, by_rank: bool, cap: int = 150_000):
        self.library, self.kind = library(path), kind
        self.model, self.lower = self.library.model, lower
        self.cut = regex.compile(pattern).findall
        self.letters = byte_letters()
        if by_rank:
            ids, _, self.end = token_bytes(path)
            self.one = tiktoken.Encoding("by rank", pat_str=pattern, mergeable_ranks=ids, special_tokens={})._core_bpe.encode_single_piece
        self.merged = self.by_rank if by_rank else self.by_list
        self.known = Cache(self.merged, cap)

    def by_rank(self, pretoken: str) -> bytes:
        return array(self.kind, self.one(pretoken.encode() + self.end)).tobytes()

    def by_list(self, pretoken: str) -> bytes:
        name = pretoken.encode().decode("latin-1").translate(self.letters)
        return array(self.kind, [x.id for x in self.model.tokenize(name)]).tobytes()

    def encode(self, chunk: str, prefix: str = "") -> bytes:
        if self.plain.fullmatch(chunk) and "<|" not in chunk:
            text = prefix + (chunk.lower() if self.lower else chunk)
            if chunk.isalpha():  # a pre-token itself, which the chunk's own cache holds
                return self.merged(text)
            return b"".join(map(self.known.__getitem__, self.cut(text)))
        return array(self.kind, self.library.encode(prefix + chunk, add_special_tokens=False).ids).tobytes()


BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same cuts where no two blanks stand together; it needs no looking ahead.
SINGLE_BLANKS = BYTE_PATTERN.replace(r"|\s+(?!\S)", "")
STOPS = (",", ".")
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PLAIN_TEXT = re.compile("[ -~\n\r\t¡-įı-ɏ‐-‧]*")
_SIGNS, _NUMBERS = (re.escape("".join(regex.findall(x, "".join(map(chr, [*range(33, 127), *range(161, 592)]))))) for x in (r"[^\p{L}\p{N}]", r"\p{N}"))
#: What white space doesn't part from the pre-tokens of WORD_PATTERN beside it in a plain text.
_INNER = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{_NUMBERS}]|[{_SIGNS}‐-‧]+")
_TWO_BLANKS = re.compile(r"\s\s")
_BETWEEN_WORDS = re.compile(r"(?<=\S) (?=\S)")


def parts_of(text: str, size: int = 1 << 20) -> Iterator[str]:
    """A text cut before blanks between two words, about every ``size`` characters."""
    at = 0
    while len(text) - at > size and (cut := _BETWEEN_WORDS.search(text, at + size)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


class TextEncoder:
    """Packed ids (little-endian, unsigned, 32 or 16 bits) of whole texts, as the library gives them.

    ``blank_joins``: a blank belongs to the token after it (byte-level
    vocabularies); otherwise white space is dropped and case folded.
    ``by_rank``: what ``ranks_decide`` says of the vocabulary. Then plain texts
    are cut and merged in one call, without caches.
    """

    def __init__(self, path: str, blank_joins: bool, kind: str = "I", by_rank: bool = False):
        self.blank_joins, self.kind = blank_joins, kind
        if kind == "H" and library(path).get_vocab_size() > 1 << 16:
            raise ValueError("ids don't fit into 16 bits")
        pieces = PreTokens(path, BYTE_PATTERN if blank_joins else WORD_PATTERN, not blank_joins, kind, by_rank)
        prefix = " " if blank_joins else ""

        def chunk(x: str) -> bytes:
            # a stop after a word is a pre-token of its own, and most words are known without it
            if x[-1:] in STOPS and x[:-1].isalpha() and pieces.plain.fullmatch(x):
                return rest[x[:-1]] + pieces.known[x[-1]]
            return pieces.encode(x, prefix)

        self.first = pieces.encode
        self.rest = rest = Cache(chunk, 200_000)
        self.whole = None
        if by_rank and blank_joins:
            ids = token_bytes(path)[0]
            self.whole, self.single = (tiktoken.Encoding("whole", pat_str=x, mergeable_ranks=ids, special_tokens={})._core_bpe.encode_ordinary for x in (BYTE_PATTERN, SINGLE_BLANKS))
        elif by_rank:
            self.whole = tiktoken.Encoding("words", pat_str="[^ ]+ ", mergeable_ranks=token_bytes(path)[0], special_tokens={})._core_bpe.encode_ordinary

    def joined(self, text: str) -> bytes:
        """Ids of a text for a vocabulary in which a blank belongs to what follows it."""
        if self.whole and _PLAIN_TEXT.fullmatch(text) and "<|" not in text:
            return array(self.kind, (self.whole if _TWO_BLANKS.search(text) else self.single)(text)).tobytes()
        chunks = chunks_of(text)
        return self.first(chunks[0]) + b"".join(map(self.rest.__getitem__, chunks[1:]))

    def apart(self, text: str) -> bytes:
        """Ids of a text for a vocabulary that drops white space."""
        if self.whole and _PLAIN_TEXT.fullmatch(text) and "<|" not in text:
            spaced = _INNER.sub(r" \g<0> ", text.lower().replace("\n", " ").replace("\r", " ").replace("\t", " ")) + " "
            return array(self.kind, self.whole(spaced)).tobytes()
        return b"".join(map(self.rest.__getitem__, text.split(" ")))

    def packed(self, texts: list[str]) -> list[bytes]:
        return [b"".join(map(self.joined if self.blank_joins else self.apart, parts_of(x))) for x in texts]


@lru_cache(maxsize=4)
def text_encoder(path: str, blank_joins: bool, kind: str = "I", by_rank: bool = False) -> TextEncoder:
    """One encoder for each Python worker."""
    return TextEncoder(path, blank_joins, kind, by_rank)
