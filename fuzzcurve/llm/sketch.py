"""Count-min sketches of 64-bit hashes, merged from the sketches of partitions.

A hash is one counter in each of ``DEPTH`` rows. Only "none, one, more" is
kept of a counter, which is what a filter for repeated values needs. Every
partition counts its own hashes, sends the counters it touched in slices
(sorted, as compressed gaps), and one task a slice merges what it gets. The
result is a bitmap of the counters that reached two: of bounded size, at most
``DEPTH * 2**MOST_BITS`` bits, so it can be broadcast. A value that occurs
twice anywhere always finds all its counters at two: the filter
overestimates and loses none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from .common import mapped, steps
from .text import U

DEPTH = 2
MOST_BITS = 28
SLICE_BITS = 20
#: Hashes that a task holds before it sends what it counted.
FLUSH = 2_000_000


def bits_for(values: int) -> int:
    """Counters, as a power of two, for so many values: about 4 for 3 values at least, up to ``2**MOST_BITS``.

    Beyond that the sketch gets fuller and lets more through, so a caller's
    exact pass approaches one without a filter; it never loses a value.
    """
    return min(MOST_BITS, max(16, (max(1, values * 4 // 3) - 1).bit_length()))


def _places(h: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    mask = U((1 << bits) - 1)
    for d in range(DEPTH):
        yield ((h >> U(32 * d)) & mask).astype(np.uint32)


def _pack(x: np.ndarray) -> bytes:
    gaps = np.diff(x, prepend=np.uint32(0)).astype("<u4")
    return zstandard.ZstdCompressor(level=1).compress(gaps.view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpack(b: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    return np.cumsum(np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel(), dtype=np.uint32)


class Counter:
    """The sketch of one partition: counts hashes and hands out what it counted, in slices."""

    def __init__(self, bits: int):
        self.bits, self.own = bits, min(bits, SLICE_BITS)
        self.held: list[np.ndarray] = []
        self.count = 0

    def add(self, h: np.ndarray) -> list[tuple[int, bytes, bytes]]:
        if len(h):
            self.held.append(h)
            self.count += len(h)
        return self.close() if self.count >= FLUSH else []

    def close(self) -> list[tuple[int, bytes, bytes]]:
        """(slice, counters touched, counters touched twice or more) of what has been added since the last time."""
        if not self.held:
            return []
        h = np.concatenate(self.held)
        self.held, self.count, out = [], 0, []
        for d, place in enumerate(_places(h, self.bits)):
            place.sort()
            new = np.flatnonzero(np.diff(place, prepend=place[:1] ^ np.uint32(1)))
            at, more = place[new], np.diff(new, append=len(place)) > 1
            cuts = np.flatnonzero(np.diff(at >> np.uint32(self.own), prepend=np.uint32(0xFFFFFFFF)))
            for a, b in zip(cuts, [*cuts[1:], len(at)]):
                low = at[a:b] & np.uint32((1 << self.own) - 1)
                out.append((d << (self.bits - self.own) | int(at[a] >> np.uint32(self.own)), _pack(low), _pack(low[more[a:b]])))
        return out


def merged(sent: DataFrame, bits: int) -> np.ndarray:
    """The bitmap of counters that reached two, from the slices (slice int, once binary, more binary) of all partitions."""
    own = min(bits, SLICE_BITS)

    def merge(batches):
        key, once, more = -1, None, None

        def out():
            return pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([np.packbits(more, bitorder="little").tobytes()], pa.binary())], ["slice", "bits"])

        for b in batches:
            for k, one, two in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                if k != key:
                    if key >= 0:
                        yield out()
                    key, once, more = k, np.zeros(1 << own, bool), np.zeros(1 << own, bool)
                place = _unpack(one.as_py())
                more[place[once[place]]] = True
                more[_unpack(two.as_py())] = True
                once[place] = True
        if key >= 0:
            yield out()

    slices = DEPTH << (bits - own)
    dealt = sent.repartition(min(slices, _shuffles(sent)), "slice").sortWithinPartitions("slice")
    out = np.zeros((slices, (1 << own) // 8), np.uint8)
    for row in mapped(dealt, merge, "slice int, bits binary").toLocalIterator():
        out[row["slice"]] = np.frombuffer(row["bits"], np.uint8)
    return out.reshape(DEPTH, -1)


def slice_rows(sent: list[tuple[int, bytes, bytes]]) -> list[pa.Array]:
    keys, once, more = zip(*sent)
    return [pa.array(keys, pa.int32()), pa.array(once, pa.binary()), pa.array(more, pa.binary())]


def repeated(texts: DataFrame, hashes: Callable[[np.ndarray, np.ndarray], np.ndarray], bits: int) -> np.ndarray:
    """The merged bitmap for column ``text`` of ``texts``; ``hashes(bytes, offsets)`` gives the hashes of a step of texts."""

    def count(batches):
        counter, names = Counter(bits), ["slice", "once", "more"]
        for b in batches:
            for _, data, offsets in steps(b.column(0)):
                if sent := counter.add(hashes(data, offsets)):
                    yield pa.RecordBatch.from_arrays(slice_rows(sent), names)
        if sent := counter.close():
            yield pa.RecordBatch.from_arrays(slice_rows(sent), names)

    return merged(mapped(texts.select("text"), count, "slice int, once binary, more binary"), bits)


def _shuffles(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def estimated_repeated(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    """True where a hash may have been counted twice or more."""
    bits = (bitmap.shape[1] * 8 - 1).bit_length()
    out = np.ones(len(h), bool)
    for d, place in enumerate(_places(h, bits)):
        out &= (bitmap[d][place >> np.uint32(3)] >> (place & np.uint32(7)).astype(np.uint8)) & 1 == 1
    return out


def text_bytes(texts: DataFrame) -> int:
    return int(texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0)


def key_bitmap(df: DataFrame, key: str, bits: int = 24, hashed: bool = False) -> np.ndarray:
    """Bitmap of a long column: a filter of fixed size (``2**bits`` bits) for that column's values.

    The places are hashes of the values, or their low bits if they are
    hashes themselves (``hashed``); ``bitmap_places`` and ``hash_places``
    tell where to look.
    """
    own = min(bits, SLICE_BITS)

    def packed(key, held):
        return pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([np.packbits(held, bitorder="little").tobytes()], pa.binary())], ["slice", "bits"])

    def fill(batches):
        key, held = -1, None
        for b in batches:
            place = b.column(0).to_numpy()
            for k in np.unique(place >> own):
                if k != key:
                    if key >= 0:
                        yield packed(key, held)
                    key, held = int(k), np.zeros(1 << own, bool)
                held[place[place >> own == k] & ((1 << own) - 1)] = True
        if key >= 0:
            yield packed(key, held)

    place = F.col(key).cast("long").bitwiseAND((1 << bits) - 1).alias("place") if hashed else bitmap_places(key, bits)
    place = df.where(F.col(key).isNotNull()).select(place).distinct()
    dealt = place.withColumn("slice", F.shiftright("place", own)).repartition(min(1 << (bits - own), _shuffles(df)), "slice").sortWithinPartitions("slice")
    out = np.zeros((1 << (bits - own), (1 << own) // 8), np.uint8)
    for row in mapped(dealt.select("place"), fill, "slice int, bits binary").collect():  # the bitmap itself: 2 to 8 MB
        out[row["slice"]] = np.frombuffer(row["bits"], np.uint8)
    return out.ravel()


def bitmap_places(key: str, bits: int = 24) -> Column:
    """The column of places to look up in a ``key_bitmap``."""
    return F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(1 << bits)).alias("place")


def hash_places(h: np.ndarray, bits: int = 24) -> np.ndarray:
    """The same in a task, for values that are hashes."""
    return (h & U((1 << bits) - 1)).astype(np.int64)


def in_bitmap(bitmap: np.ndarray, place: np.ndarray) -> np.ndarray:
    return (bitmap[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
