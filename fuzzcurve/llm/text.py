"""Words of texts and their hashes, for a step of many texts at once.

A word is a run of ``[^\\x20\\x09-\\x0D]``. The hash of a span of bytes takes
8 bytes at a time: each is mixed with its place, nonlinearly, and the mixed
values are summed. No two strings collide by their form. Windows of words are
hashed from the hashes of their words, two halves at a time, mixed again at
each step. ``lane`` 0 and 1 are two such hashes that share nothing but the
bytes: together they make 128 bits.
"""

from __future__ import annotations

from functools import lru_cache
from typing import NamedTuple

import numpy as np

U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: Of 8 bytes read, those that belong to a span with so many left.
_LEFT = np.array([(1 << 8 * n) - 1 for n in range(9)], U)
_FACTORS = (U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F))


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit values (the finaliser of splitmix64)."""
    x = x + U((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


@lru_cache(maxsize=2)
def _few_places(lane: int) -> np.ndarray:
    return mix(np.arange(1024, dtype=U), 40 + lane)


def _places(lane: int, n: int) -> np.ndarray:
    """A value for each place of 8 bytes in a span."""
    return _few_places(lane)[:n] if n <= 1024 else mix(np.arange(n, dtype=U), 40 + lane)


def lowered(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z lower-cased."""
    return _LOWER[data]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lanes: int = 1) -> list[np.ndarray]:
    """The hash of each span ``data[start:end]``, wherever it stands, in each lane."""
    if not len(starts):
        return [np.zeros(0, U)] * lanes
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    size = ends - starts
    head = eight[starts] & _LEFT[np.minimum(size, 8)]
    long = np.flatnonzero(size > 8)
    if len(long):
        parts = (size[long] - 1) >> 3
        begin = np.cumsum(parts) - parts
        place = np.arange(1, int(begin[-1] + parts[-1]) + 1) - np.repeat(begin, parts)
        at = np.repeat(starts[long], parts) + 8 * place
        rest = eight[at] & _LEFT[np.minimum(np.repeat(ends[long], parts) - at, 8)]
    out = []
    for lane in range(lanes):
        own = _places(lane, int(parts.max()) + 1 if len(long) else 1)
        x = mix((head * _FACTORS[lane]) ^ own[0], lane)
        if len(long):
            x[long] += np.add.reduceat(mix((rest * _FACTORS[lane]) ^ own[place], lane), begin)
        out.append(mix(x ^ (size.astype(U) * U(0xD6E8FEB86659FD93)), 2 + lane))
    return out


class Words(NamedTuple):
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray  #: text of each word, counted from the step's first
    first: np.ndarray  #: index of each text's first word; one more at the end


def words(data: np.ndarray, offsets: np.ndarray) -> Words:
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none, none, none, np.zeros(len(offsets), np.int64))
    space = _SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    start = ~space
    end = start.copy()
    start[1:] &= space[:-1] | edge[1:n]
    end[:-1] &= space[1:] | edge[1:n]
    starts = np.flatnonzero(start)
    first = np.searchsorted(starts, offsets)
    return Words(starts, np.flatnonzero(end) + 1, np.repeat(np.arange(len(offsets) - 1), np.diff(first)), first)


def word_hashes(data: np.ndarray, w: Words, lower: bool = False) -> np.ndarray:
    return span_hashes(lowered(data) if lower else data, w.starts, w.ends)[0]


def joined(a: np.ndarray, b: np.ndarray, lane: int = 0) -> np.ndarray:
    """The hash of two neighbours from their hashes."""
    return mix(a * _FACTORS[lane] + b, 4 + lane)


def windows(w: Words, h: np.ndarray, k: int, lane: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first word of each window of ``k`` words inside one text, and the window's hash.

    Windows of 1, 2, 4, ... words are joined to one of ``k``.
    """
    m = len(h) - k + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U)
    own, size, out, done = h, 1, None, 0
    by_size = {}
    while size <= k:
        by_size[size] = own
        if 2 * size <= k:
            own = joined(own[:-size], own[size:], lane)
        size *= 2
    for size in sorted(by_size, reverse=True):
        if k & size:
            part = by_size[size][done : done + m]
            out = part if out is None else joined(out, part, lane)
            done += size
    at = np.flatnonzero(w.doc[:m] == w.doc[k - 1 :])
    return at, mix(out[at], k)
