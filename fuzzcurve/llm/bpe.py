"""Operator 4: byte-level BPE encoding and decoding.

``encode`` turns texts into token ids (packed little-endian unsigned 32-bit
integers, one binary column); ``decode`` concatenates the byte pieces of the
ids again. Ids are those of the public pre-tokenisation pattern and rank
file, without special tokens.

Nothing is shuffled: a task splits its texts, looks up the words that it has
met before, and folds the ranked merges over the byte arrays of the new
distinct words - all words of one length at once, one merge of each word a
step, with the ranks as literal lookup tables. Null texts are empty and have
no ids. Texts are whole; a word of any length is one piece. Every row is
encoded by itself, so repeated rows and rows without an id come back as often
as they are there; an empty table stays empty. The new columns ``ids`` and
``decoded`` replace columns of these names, all others are carried through.

Spark's higher-order functions can express the same fold (``fold_words``),
but interpret it element by element; see the README for the figures.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import unicodedata
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import from_rest, id_text, mapped, read, steps, with_rest

#: Longer words are folded one by one, with a heap of their pairs.
LONG = 96
#: Distinct words that a worker keeps between steps.
KEEP = 400_000
_NONE = np.int32(2**31 - 1)
#: The endings that the pattern splits off after an apostrophe.
_SHORT, _TWO = "stmd", ("re", "ve", "ll")


def rank_file(path: str | None = None) -> bytes:
    """The bytes of a rank file; by default the public 50k vocabulary."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        return f.read()


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """0 other, 1 letter, 2 number, 3 white space, for every code point."""
    out = np.zeros(0x110000, np.uint8)
    for cp in range(0x110000):
        kind = unicodedata.category(chr(cp))[0]
        if kind in "LN":
            out[cp] = 1 if kind == "L" else 2
    out[[*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = 3
    return out


def split(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte positions where the pieces of the pattern begin, and the end.

    The pattern is contractions, then an optional space with letters,
    numbers or other characters, then white space, of which the last
    character is left to what follows.
    """
    if not len(data):
        return np.zeros(1, np.int64)
    if data.max() < 128:
        ch, at = data, None
    else:
        ch = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        at = np.flatnonzero((data & 0xC0) != 0x80)
    kind, n = _classes()[ch], len(ch)
    begin = np.zeros(n + 1, bool)
    begin[offsets if at is None else np.searchsorted(at, offsets)] = True
    begin[n] = True
    run = np.empty(n, bool)
    run[0] = True
    np.not_equal(kind[1:], kind[:-1], out=run[1:])
    run |= begin[:n]
    space = kind == 3
    # the last white space before something else in the same text
    last = np.zeros(n, bool)
    last[:-1] = space[:-1] & ~space[1:] & ~begin[1:n]
    taken = np.zeros(n, bool)  # a plain space in front joins the run
    taken[1:] = last[:-1] & (ch[:-1] == 0x20)
    out = (run & ~taken) | last
    for k in np.flatnonzero(out & (ch == 0x27)):
        if k + 1 >= n or begin[k + 1]:
            continue
        two = k + 2 < n and not begin[k + 2] and chr(ch[k + 1]) + chr(ch[k + 2]) in _TWO
        if two or chr(ch[k + 1]) in _SHORT:
            out[k + 1] = False
            if (after := k + 2 + two) < n:
                out[after] = True
    found = np.flatnonzero(out)
    return np.append(found if at is None else at[found], len(data))


def _places(shift: np.ndarray, size: np.ndarray, n: int) -> np.ndarray:
    """0..n-1 with each run of ``size`` places shifted."""
    kind = np.int32 if n < 1 << 30 else np.int64
    out = np.arange(n, dtype=kind)
    out += np.repeat(shift.astype(kind), size)
    return out


class Vocabulary:
    """Ranks of one file as lookup tables."""

    def __init__(self, raw: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
        size = max(self.ranks.values()) + 1
        pairs = self.pairs = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a << 20 | b] = rank
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.keys = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k] for k in self.keys.tolist()], np.int32)
        self.first = self.pair(self.byte[:, None], self.byte[None, :])
        pieces = [b""] * size
        for token, rank in self.ranks.items():
            pieces[rank] = token
        self.length = np.array([len(p) for p in pieces], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.length)[:-1]])
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The token that two tokens merge to, which is also the rank of the merge."""
        key = a.astype(np.int64) << 20 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.merged[at], _NONE)

    def fold(self, words: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Words of one length, as a matrix of bytes; returns (rows, their ids) for each number of ids."""
        ids, ranks, rows, out = self.byte[words], self.first[words[:, :-1], words[:, 1:]], np.arange(len(words)), []
        while len(rows):
            if ids.shape[1] == 1:
                return [*out, (rows, ids)]
            i = ranks.argmin(axis=1)
            best = ranks[np.arange(len(rows)), i]
            live = best != _NONE
            if not live.all():
                out.append((rows[~live], ids[~live]))
                ids, ranks, rows, i, best = ids[live], ranks[live], rows[live], i[live], best[live]
                if not len(rows):
                    break
            m, r = ids.shape[1], np.arange(len(rows))
            ids[r, i] = best
            ids = ids[np.arange(m) != i[:, None] + 1].reshape(len(rows), m - 1)
            ranks = ranks[np.arange(m - 1) != i[:, None]].reshape(len(rows), m - 2)
            k = np.flatnonzero(i > 0)
            ranks[k, i[k] - 1] = self.pair(ids[k, i[k] - 1], best[k])
            k = np.flatnonzero(i < m - 2)
            ranks[k, i[k]] = self.pair(best[k], ids[k, i[k] + 1])
        return out

    def long(self, word: bytes) -> list[int]:
        """The ids of one word: the pair of least rank, leftmost first, merges until none has a rank."""
        ids, n = self.byte[np.frombuffer(word, np.uint8)].tolist(), len(word)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        ranks = self.first[np.frombuffer(word[:-1], np.uint8), np.frombuffer(word[1:], np.uint8)].tolist()
        queue = [(rank, i) for i, rank in enumerate(ranks) if rank != _NONE]
        heapq.heapify(queue)

        def push(i: int):
            rank = self.pairs.get(ids[i] << 20 | ids[after[i]])
            ranks[i] = _NONE if rank is None else rank
            if rank is not None:
                heapq.heappush(queue, (rank, i))

        while queue:
            rank, i = heapq.heappop(queue)
            if ids[i] is None or ranks[i] != rank:
                continue  # merged meanwhile
            gone = after[i]
            ids[i], ids[gone], after[i] = rank, None, after[gone]
            ranks[i] = _NONE
            if after[i] < n:
                before[after[i]] = i
                push(i)
            if before[i] >= 0:
                push(before[i])
        return [x for x in ids if x is not None]

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pieces of all ids one after another, and where each text (its ids end at ``ends``) ends."""
        size = self.length[ids]
        total = np.concatenate([[0], np.cumsum(size)])
        return self.bytes[_places(self.start[ids] - total[:-1], size, total[-1])], total[ends]


class Encoder:
    """Encodes steps of texts; remembers the ids of distinct words."""

    def __init__(self, raw: bytes):
        self.vocabulary = Vocabulary(raw)
        self._reset()

    def _reset(self):
        self.number: dict[bytes, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    def _room(self, words: int, ids: int):
        while len(self.start) < words:
            self.start, self.size = np.append(self.start, np.zeros_like(self.start)), np.append(self.size, np.zeros_like(self.size))
        while len(self.flat) < ids:
            self.flat = np.append(self.flat, np.zeros_like(self.flat))

    def _learn(self, new: list[bytes]):
        first = len(self.number)
        self.number.update(zip(new, range(first, first + len(new))))
        size = np.fromiter(map(len, new), np.int64, len(new))
        self._room(first + len(new), self.used + int(size.sum()))
        for n in np.unique(size):
            own = np.flatnonzero(size == n)
            if n > LONG:
                for j in own:
                    self._put(first + j, self.vocabulary.long(new[j]))
                continue
            got = np.frombuffer(b"".join([new[j] for j in own]), np.uint8).reshape(-1, n)
            for rows, ids in self.vocabulary.fold(got):
                m, to = ids.shape[1], self.used
                self.flat[to : to + ids.size] = ids.ravel()
                self.start[first + own[rows]] = to + np.arange(len(rows)) * m
                self.size[first + own[rows]] = m
                self.used += ids.size

    def _put(self, word: int, ids: list[int]):
        self._room(word + 1, self.used + len(ids))
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[word], self.size[word] = self.used, len(ids)
        self.used += len(ids)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a step, and where each text's ids begin (one more at the end)."""
        at = split(data, offsets)
        if len(at) == 1:
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        pieces = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        distinct = pieces.dictionary.to_pylist()
        if len(self.number) > KEEP:
            self._reset()
        if new := [w for w in distinct if w not in self.number]:
            self._learn(new)
        word = np.fromiter(map(self.number.__getitem__, distinct), np.int64, len(distinct))[pieces.indices.to_numpy()]
        size = self.size[word]
        total = np.concatenate([[0], np.cumsum(size)])
        return self.flat[_places(self.start[word] - total[:-1], size, total[-1])], total[np.searchsorted(at, offsets)]


_ENCODERS: dict[bytes, Encoder] = {}


def encoder(raw: bytes) -> Encoder:
    """One encoder for each rank file in a worker."""
    key = hashlib.sha256(raw).digest()
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(raw)
    return _ENCODERS[key]


def encode(docs: DataFrame, ranks: bytes | None = None) -> DataFrame:
    """``docs`` and ``ids`` (binary: ids as little-endian unsigned 32-bit integers)."""
    raw = docs.sparkSession.sparkContext.broadcast(ranks or rank_file())
    columns = [c for c in docs.columns if c != "ids"]
    whole = with_rest(docs.select(*[docs[f"`{c}`"] for c in columns])).select("text", "rest")

    def run(batches):
        own = encoder(raw.value)
        for b in batches:
            for at, data, offsets in steps(b.column(0)):
                ids, first = own.encode(data, offsets)
                packed = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(first * 4)), pa.py_buffer(ids.astype("<u4"))])
                yield pa.RecordBatch.from_arrays([b.column(1).slice(at, len(offsets) - 1), packed.cast(pa.binary())], ["rest", "ids"])
        own._reset()  # an idle worker shouldn't hold a task's words

    rest = whole.schema["rest"].dataType.simpleString()
    return mapped(whole, run, f"rest {rest}, ids binary").select(*from_rest(whole, columns), "ids")


def decode(coded: DataFrame, ranks: bytes | None = None) -> DataFrame:
    """``coded`` and ``decoded`` (binary: the pieces of ``ids``, concatenated)."""
    raw = coded.sparkSession.sparkContext.broadcast(ranks or rank_file())
    columns = [c for c in coded.columns if c != "decoded"]
    whole = coded.select("ids", F.struct(*[coded[f"`{c}`"] for c in columns]).alias("rest"))

    def run(batches):
        own = encoder(raw.value).vocabulary
        for b in batches:
            for at, data, offsets in _packed_steps(b.column(0)):
                out, ends = own.decode(data.view("<u4"), offsets // 4)
                texts = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(ends)), pa.py_buffer(out)])
                yield pa.RecordBatch.from_arrays([b.column(1).slice(at, len(offsets) - 1), texts.cast(pa.binary())], ["rest", "decoded"])

    rest = whole.schema["rest"].dataType.simpleString()
    return mapped(whole, run, f"rest {rest}, decoded binary").select(*from_rest(whole, columns), "decoded")


def _packed_steps(column: pa.Array):
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + (4 << 20), "right")) - 1)
        own = offsets[at : to + 1]
        yield at, np.ascontiguousarray(data[own[0] : own[-1]]), own - own[0]
        at = to


def fold_words(word: Column, ranks: bytes | None = None) -> Column:
    """The ids of one word as a Spark expression: ``aggregate`` folds the ranked merges.

    The state holds the ids between two guards and the rank of every
    neighbouring pair; a step merges the first pair of the least rank. The
    ranks are a literal array of small maps, picked by the pair's hash.
    """
    own = Vocabulary(ranks or rank_file())
    count = 1 << 16
    buckets: list[dict[str, int]] = [{} for _ in range(count)]
    for key, rank in zip(own.keys.tolist(), own.merged.tolist()):
        buckets[(key * 40503 >> 8) % count][str(key)] = rank
    table = F.from_json(F.lit(json.dumps(buckets)), "array<map<string,int>>").cast("array<map<bigint,int>>")
    of_crc = [0] * 256
    for b in range(256):
        of_crc[zlib.crc32(bytes([b])) >> 24] = int(own.byte[b])
    byte_ids = F.split(F.lit(",".join(map(str, of_crc))), ",").cast("array<bigint>")

    def rank(a, b):
        key = a * (1 << 20) + b
        return F.element_at(F.get(table, (F.shiftrightunsigned(key * 40503, 8) % count).cast("int")), key).cast("bigint")

    def let(value, body):
        return F.element_at(F.transform(F.array(value), body), 1)

    raw, none, guard = word.cast("binary"), F.lit(None).cast("bigint"), F.lit(-1).cast("bigint")
    n, rest = F.length(raw), F.lit(1 << 30)
    ids = F.transform(F.sequence(F.lit(1), n), lambda i: F.get(byte_ids, F.shiftright(F.crc32(F.substring(raw, i, F.lit(1))), 24).cast("int")))

    def merge(p, r, best):
        return let(F.array_position(r, best).cast("int"), lambda i: F.struct(F.concat(F.slice(p, F.lit(1), i - 1), F.array(best), F.slice(p, i + 2, rest)).alias("p"), F.concat(F.slice(r, F.lit(1), i - 2), F.array(rank(F.get(p, i - 2), best), rank(best, F.get(p, i + 1))), F.slice(r, i + 2, rest)).alias("r")))

    def folded(p):
        start = F.struct(F.concat(F.array(guard), p, F.array(guard)).alias("p"), F.concat(F.array(none), F.transform(F.sequence(F.lit(1), n), lambda i: F.when(i < n, rank(F.get(p, i - 1), F.get(p, i))))).alias("r"))
        step = lambda a, _: let(F.array_min(a["r"]), lambda best: F.when(best.isNull(), a).otherwise(merge(a["p"], a["r"], best)))
        return F.aggregate(F.sequence(F.lit(2), F.greatest(n, F.lit(2))), start, step, lambda a: F.slice(a["p"], F.lit(2), F.size(a["p"]) - 2))

    return F.when(n > 0, let(ids, folded)).otherwise(F.array().cast("array<bigint>"))


def op4_bpe(spark, sf_dir: str) -> DataFrame:
    coded = decode(encode(id_text(read(spark, sf_dir, "documents"))))
    return coded.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
