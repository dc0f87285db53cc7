"""Repeated windows of byte strings by interval expansion on a Burrows-Wheeler transform.

The intervals of all strings of one length are extended backwards by every
byte before them, breadth first. An interval whose right end is met for the
first time, by a string that became one byte longer than ``l``, shows that the
suffixes on both sides of that end have ``l`` bytes in common. Common prefixes
are found by increasing value, and the expansion stops at the minimum length:
ends that are still unknown have at least that many bytes in common.

Suffixes are sorted by keys that hold several symbols; the expansion begins
with the intervals of all strings of that many.
"""

from __future__ import annotations

import numpy as np


def starts_of(values: np.ndarray) -> np.ndarray:
    """Where a value differs from the one before it."""
    first = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=first[1:])
    return first


def still_open(first: np.ndarray) -> np.ndarray:
    """Places in groups of more than one."""
    alone = first.copy()
    alone[:-1] &= first[1:]
    return np.flatnonzero(~alone)


def sorted_suffixes(symbols: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Suffixes in the order of their first ``depth`` symbols at least; beyond the end there are zeros.

    Also which of them begin a string of the first symbols that the keys hold, and how many these are.
    """
    n = len(symbols)
    used = np.zeros(int(symbols.max()) + 1, bool)
    used[symbols] = used[0] = True
    dense = (np.cumsum(used) - 1)[symbols]
    bits = max(1, int(used.sum() - 1).bit_length())
    pack = max(1, min(63 // bits, depth))
    padded = np.zeros(n + pack, np.int64)
    padded[:n] = dense
    key = np.zeros(n, np.int64)
    for k in range(pack):
        key <<= bits
        key |= padded[k : k + n]
    order = np.argsort(key).astype(np.int32)
    edges = starts_of(key[order])
    del key, padded, dense
    # a suffix's rank is the first place of those it can't be told apart from, plus 1; beyond the end it is 0
    begins = np.flatnonzero(edges).astype(np.int32)
    rank = np.zeros(n + 1, np.int32)
    rank[order] = np.repeat(begins, np.diff(np.append(begins, n))) + 1
    places, done = still_open(edges), pack
    width = n.bit_length()
    steps = max(2, min(3, 63 // width))
    while done < depth and len(places):
        at = order[places]
        both = rank[at].astype(np.int64)
        for k in range(1, steps):
            both <<= width
            both |= rank[np.minimum(at.astype(np.int64) + k * done, n)]
        by = np.argsort(both)
        at, both = at[by], both[by]
        order[places] = at
        first = starts_of(both)
        begins = np.flatnonzero(first)
        rank[at] = np.repeat(places[begins], np.diff(np.append(begins, len(at)))) + 1
        places = places[still_open(first)]
        done *= steps
    return order, edges, pack


def unknown_ends(symbols: np.ndarray, order: np.ndarray, edges: np.ndarray, known: int, length: int) -> np.ndarray:
    """For each place of ``order``: whether its suffix has ``length`` symbols or more in common with the one before it.

    ``edges``: which places begin a string of ``known`` symbols.
    """
    n = len(symbols)
    before = symbols[order - 1]  # the transform; the text is taken as a ring
    real = before > 0
    by = np.argsort(before, kind="stable").astype(np.int32)
    to = np.empty(n, np.int32)  # the place of the suffix that is one symbol longer
    to[by] = np.arange(n, dtype=np.int32)
    same = ~starts_of(before[by])[1:]
    following = np.full(n, n, np.int32)  # the next place with the same symbol before it
    following[by[:-1][same]] = by[1:][same]
    preceding = np.full(n, -1, np.int32)
    preceding[by[1:][same]] = by[:-1][same]
    # a separator may end a string, but not stand within it
    following[~real], preceding[~real] = -1, n
    unknown = np.ones(n + 1, bool)
    low = np.flatnonzero(edges).astype(np.int32)
    high = np.append(low[1:], np.int32(n))
    unknown[high] = unknown[0] = False
    for _ in range(known, length):
        if not len(low):
            break
        sizes = high - low
        ends = np.cumsum(sizes)
        place = np.arange(ends[-1], dtype=np.int32) + np.repeat(low - (ends - sizes).astype(np.int32), sizes)
        first = to[place[preceding[place] < np.repeat(low, sizes)]]
        last = to[place[following[place] >= np.repeat(high, sizes)]]
        # intervals of one length are disjoint, so both ends sort alike
        first.sort()
        last.sort()
        last += 1
        fresh = unknown[last]
        low, high = first[fresh], last[fresh]
        unknown[high] = False
    return unknown[:n]


def repeated_windows(regions: list[bytes], length: int) -> list[np.ndarray]:
    """For each region, which of its windows of ``length`` bytes occur at another place of any region."""
    if not regions:
        return []
    sizes = np.array([len(x) + 1 for x in regions], np.int64)
    ends = np.cumsum(sizes)
    symbols = np.frombuffer(b"\0".join([*regions, b""]), np.uint8).astype(np.int16) + 1
    symbols[ends - 1] = 0
    order, edges, known = sorted_suffixes(symbols, length)
    alike = unknown_ends(symbols, order, edges, known, length)
    repeated = np.zeros(len(symbols), bool)
    repeated[order[alike]] = True
    repeated[order[np.flatnonzero(alike) - 1]] = True
    return [repeated[e - s : e - s + max(0, s - length)] for e, s in zip(ends, sizes, strict=True)]
