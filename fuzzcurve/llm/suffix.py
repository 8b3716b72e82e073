"""Operator 8: suffix-array dedup with two-stage sorting.

A byte goes if it is covered by a string of ``length`` bytes that also
starts earlier: in a document with a smaller id, or earlier in the same one.
Strings never cross documents and are judged on the input.

Suffixes are dealt so that equal strings meet and each task sorts its own:

1. Every string picks an anchor, the least hash of its ``GRAM``-byte
   substrings: equal strings pick the same. A merged count-min sketch of
   anchors leaves out what occurs once (it overestimates and loses none).
2. An anchor's strings are one stretch of text, its context. A task sends
   each distinct context once, with its earliest place; later copies in the
   task lose all their strings at once. So a passage of a third of all
   documents sends one row a task. Anchors with very many distinct contexts
   (told by a sample) are hot: their strings are dealt one by one, by all
   their bytes, and only those that the sketch holds for repeated. Equal
   strings have one anchor, so they still meet; no task holds a hot anchor.
3. Tasks get the contexts by anchor, drop copies of a context likewise, and
   build the suffix array of the rest: only suffixes smaller than their
   successors are sorted directly; bucket scans from the least byte up
   induce the others, each from its successor. Neighbours whose common
   prefix reaches ``length`` are equal strings, of which the earliest stays.

Null texts are empty. Documents without an id are passed on whole and not
compared. Rows that share an id count as one document: repeated rows are one
place, and several texts of an id stand one after another in the order of a
hash. Places tell which text they are in, so each loses its own bytes only.
Very long texts are whole; an empty table gives an empty result; columns of
other names travel in a struct and cannot clash.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import sketch
from .common import from_rest, id_text, mapped, read, signed, steps, write_table
from .marks import own_places, reused_ids, rewrite, text_bases
from .text import U, mix

GRAM = 32
#: Contexts that a task holds while it drops copies; suffixes of one array.
HELD, SUFFIXES = 60_000, 600_000
#: An anchor is hot from so many distinct contexts in one of ``SAMPLE`` documents on (some 4096 in all).
SAMPLE, HOT = 16, 256
HOT_BITS = 24
_BASE = 0x9E3779B97F4A7C15


@lru_cache(maxsize=2)
def _few_powers(base: int) -> np.ndarray:
    out = np.full(1 << 21, U(base))
    out[0] = 1
    return np.multiply.accumulate(out)


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1)."""
    if n <= 1 << 21:
        return _few_powers(base)[:n]
    out = np.full(n, U(base))
    out[0] = 1
    return np.multiply.accumulate(out)


def prefix_sums(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, U)
    np.cumsum(mix(np.arange(256, dtype=U), 7)[data] * _powers(_BASE, len(data)), out=out[1:])
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A rolling hash of the bytes of each span, wherever it stands.

    It only brings strings together: what meets is compared by its bytes.
    """
    inverse = _powers(pow(_BASE, -1, 2**64), len(sums))
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each anchor: its hash, the first and last string that picked it, and the prefix sums used."""
    n, width = len(data), length - GRAM + 1
    if n < length:
        none = np.zeros(0, np.int64)
        return np.zeros(0, U), none, none, np.zeros(1, U)
    sums = prefix_sums(data)
    at = np.arange(n - GRAM + 1)
    grams = span_hash(sums, at, at + GRAM)
    least = (grams & ~U(0xFFFFFFFF)) | at.astype(U)
    reach = 1
    while 2 * reach <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if width > reach:
        least = np.minimum(least[: -(width - reach)], least[width - reach :])
    inside = np.zeros(n - length + 2, np.int32)
    for a, z in zip(offsets[:-1], offsets[1:]):
        if z - a >= length:
            inside[a] += 1
            inside[z - length + 1] -= 1
    first = np.flatnonzero(np.cumsum(inside)[:-1])
    pick = (least[first] & U(0xFFFFFFFF)).astype(np.int64)
    cut = np.flatnonzero(np.diff(pick, prepend=-1) != 0)
    last = first[np.append(cut[1:], len(first)) - 1] if len(first) else first
    return grams[pick[cut]], first[cut], last, sums


def _hot(texts: DataFrame, length: int) -> np.ndarray:
    """Bitmap of the hot anchors. Any content keeps the result exact: it only says how an anchor's strings are dealt."""

    def run(batches):
        for b in batches:
            for _, data, offsets in steps(b.column(0)):
                g, first, last, sums = anchors(data, offsets, length)
                yield pa.RecordBatch.from_arrays([pa.array(signed(g)), pa.array(signed(span_hash(sums, first, last + length)) if len(g) else np.zeros(0, np.int64))], ["g", "key"])

    sample = texts.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0).select("text")
    distinct = mapped(sample, run, "g long, key long").distinct()
    return sketch.key_bitmap(distinct.groupBy("g").count().where(F.col("count") >= HOT), "g", HOT_BITS, hashed=True)


def pieces(data: np.ndarray, offsets: np.ndarray, length: int, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``anchors``, but with one entry for each string of a hot anchor: the string's own hash, and the string as first and last."""
    g, first, last, sums = anchors(data, offsets, length)
    is_hot = sketch.in_bitmap(hot, sketch.hash_places(g, HOT_BITS))
    if not is_hot.any():
        return g, first, last, sums
    n = np.where(is_hot, last - first + 1, 1)
    of = np.repeat(np.arange(len(g)), n)
    at = first[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    to = np.where(is_hot[of], at, last[of])
    return np.where(is_hot[of], mix(span_hash(sums, at, at + length), 9), g[of]), at, to, sums


def _contexts(texts: DataFrame, bitmap, hot, length: int, reused: bool) -> DataFrame:
    """Rows (g, doc_id, start, n, context): n strings from byte ``start``; a null context marks strings that are all lost already."""

    def emit(batches):
        held, count = [], 0

        def flush():
            g, key, doc, start, n = (np.concatenate(x) for x in list(zip(*held))[:5])
            raw = [c for h in held for c in h[5]]
            held.clear()
            order = np.lexsort((start, doc, key))
            new = np.ones(len(order), bool)
            new[1:] = key[order][1:] != key[order][:-1]
            lead = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
            for i in np.flatnonzero(~new).tolist():  # equal hashes of different bytes: each goes on its own
                if raw[order[i]] != raw[lead[i]]:
                    new[i], lead[i] = True, order[i]
            own = np.zeros(len(order), bool)
            own[order[new]] = True
            stays = np.zeros(len(order), bool)  # a repeated row is the same place, not a copy
            stays[order] = new | (doc[order] != doc[lead]) | (start[order] != start[lead])
            sent, gone = np.flatnonzero(own), np.flatnonzero(stays & ~own)
            if len(gone):  # lost strings side by side go as one
                gone = gone[np.lexsort((start[gone], doc[gone]))]
                new = np.append(True, (doc[gone][1:] != doc[gone][:-1]) | (start[gone][1:] != start[gone][:-1] + n[gone][:-1]))
                many = np.add.reduceat(n[gone], np.flatnonzero(new))
                gone = gone[new]
            else:
                many = n[gone]
            at = np.concatenate([sent, gone])
            g = np.concatenate([g[sent], mix(doc[gone].view(U) ^ mix(start[gone].astype(U)))])
            return pa.RecordBatch.from_arrays([pa.array(signed(g)), pa.array(doc[at]), pa.array(start[at]), pa.array(np.concatenate([n[sent], many]).astype(np.int32)), pa.array([raw[i] for i in sent.tolist()] + [None] * len(gone), pa.binary())], ["g", "doc_id", "start", "n", "context"])

        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for at, data, offsets in steps(b.column(1)):
                of, starts, ends, sums = pieces(data, offsets, length, hot.value)
                keep = np.flatnonzero(sketch.estimated_repeated(bitmap.value, of))
                raw, base = data.tobytes(), text_bases(data, offsets, reused)
                for cut in range(0, len(keep), HELD):
                    own = keep[cut : cut + HELD]
                    g, first, last = of[own], starts[own], ends[own]
                    doc = np.searchsorted(offsets, first, "right") - 1
                    key = span_hash(sums, first, last + length)
                    held.append((g, key, ids[at + doc].astype(np.int64), first - offsets[doc] + base[doc], last - first + 1, [raw[a:z] for a, z in zip(first.tolist(), (last + length).tolist())]))
                    count += len(g)
                    if count >= HELD:
                        yield flush()
                        count = 0
        if count:
            yield flush()

    return mapped(texts, emit, "g long, doc_id long, start long, n int, context binary")


def suffix_array(text: np.ndarray, begin: np.ndarray, count: np.ndarray, end: np.ndarray, depth: int) -> np.ndarray:
    """Order of the first ``count`` suffixes of each stretch ``text[begin:end]``, by ``depth`` bytes at least.

    Two stages. A suffix's kind is told by the first byte that differs from
    its own first: a larger one makes it smaller than its successor. Those
    are sorted directly, by 8 bytes at a time, going on only with ties. The
    others follow from their successors, which the scan of buckets meets in
    order. A stretch's suffixes go on past ``count`` up to the first that is
    sorted directly, or to its end, where the empty suffix comes first.
    """
    n = len(text)
    change = np.append(np.flatnonzero(text[1:] != text[:-1]) + 1, n)
    place = np.arange(n)
    differs = change[np.searchsorted(change, place, "right").clip(max=len(change) - 1)]
    stretch_end = np.repeat(end, end - begin)
    smaller = (differs < stretch_end) & (text[np.minimum(differs, n - 1)] > text)
    # suffixes that take part: up to the first directly sorted one from the last wanted on
    ahead = np.where(smaller, place, n)
    ahead = np.minimum.accumulate(ahead[::-1])[::-1]
    last = np.minimum(ahead[begin + count - 1], end - 1)
    part = np.zeros(n + 1, np.int32)
    np.add.at(part, begin, 1)
    np.add.at(part, last + 1, -1)
    part = np.cumsum(part[:-1]) > 0
    induced = part & ~smaller
    head = np.zeros(n, bool)
    head[begin] = True

    words = _eight(text)
    direct = np.flatnonzero(part & smaller)
    order = np.argsort(words[direct], kind="stable")
    direct = direct[order]
    tied = np.zeros(len(direct), bool)
    same = words[direct][1:] == words[direct][:-1]
    tied[1:] |= same
    tied[:-1] |= same
    group = np.cumsum(np.append(True, ~same)) if len(direct) else np.zeros(0, np.int64)
    for level in range(8, depth, 8):
        at = np.flatnonzero(tied)
        if not len(at):
            break
        own, key = direct[at], words[np.minimum(direct[at] + level, n)]
        if depth - level < 8:
            key = key >> U(8 * (8 - depth + level))
        by = np.lexsort((key, group[at]))
        own, key, g = own[by], key[by], group[at][by]
        direct[at] = own
        same = (key[1:] == key[:-1]) & (g[1:] == g[:-1])
        more = np.zeros(len(at), bool)
        more[1:] |= same
        more[:-1] |= same
        tied[:] = False
        tied[at[more]] = True
        group[at] = at[0] + np.maximum.accumulate(np.where(np.append(True, ~same), at - at[0], 0))

    lists: list[list[np.ndarray]] = [[] for _ in range(256)]

    def arrive(found: np.ndarray):
        """Suffixes met in order: those before them that are induced go to their buckets."""
        before = found[~head[found]] - 1
        put(before[induced[before]])

    def put(found: np.ndarray):
        if len(found):
            first = text[found]
            by = np.argsort(first, kind="stable")
            found, first = found[by], first[by]
            cuts = np.flatnonzero(np.diff(first)) + 1
            for piece in np.split(found, cuts):
                lists[text[piece[0]]].append(piece)

    at_end = end[last == end - 1] - 1
    put(at_end[induced[at_end]])
    out = []
    starts = np.searchsorted(text[direct], np.arange(257))
    for c in range(256):
        while lists[c]:
            wave = np.concatenate(lists[c])
            lists[c] = []
            out.append(wave)
            arrive(wave)
        own = direct[starts[c] : starts[c + 1]]
        if len(own):
            out.append(own)
            arrive(own)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _eight(text: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on, as a number in the order of strings; one more for the end."""
    n = len(text)
    padded = np.append(text, np.zeros(8, np.uint8)).astype(U)
    out = np.zeros(n + 1, U)
    for j in range(8):
        out |= padded[j : j + n + 1] << U(56 - 8 * j)
    return out


def equal_strings(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """True where a suffix of ``order`` shares ``length`` bytes with the one before it."""
    words, n = _eight(text), len(text)
    out = np.zeros(len(order), bool)
    live = np.arange(1, len(order))
    for level in range(0, length, 8):
        a, b = words[np.minimum(order[live] + level, n)], words[np.minimum(order[live - 1] + level, n)]
        if length - level < 8:
            a, b = a >> U(8 * (8 - length + level)), b >> U(8 * (8 - length + level))
        live = live[a == b]
    out[live] = True
    return out


def _lost(contexts: DataFrame, length: int) -> DataFrame:
    """(doc_id, start, n): n strings from ``start`` on that also start earlier."""

    def solve(doc, start, n, raw):
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        end = np.cumsum(size)
        text = np.frombuffer(b"".join(raw), np.uint8)
        order = suffix_array(text, end - size, n, end, length)
        of = np.repeat(np.arange(len(raw)), size)[order]
        wanted = order - (end - size)[of] < n[of]
        order, of = order[wanted], of[wanted]
        begin = start[of] + order - (end - size)[of]
        rank = np.empty(len(order), np.int64)
        rank[np.lexsort((begin, doc[of]))] = np.arange(len(order))
        heads = np.flatnonzero(~equal_strings(text, order, length))
        least = np.repeat(np.minimum.reduceat(rank, heads), np.diff(np.append(heads, len(order))))
        gone = rank != least
        return doc[of[gone]], begin[gone]

    def scan(batches):
        groups, suffixes, last, lost = [], 0, None, []
        seen: dict[bytes, tuple] = {}
        current: list = []

        def close():
            nonlocal suffixes
            if len(current) > 1:
                groups.extend(current)
                suffixes += sum(x[2] for x in current)
            current.clear()
            seen.clear()

        def send(force=False):
            nonlocal suffixes
            out = [(np.array([d for d, _, _ in lost], np.int64), np.array([s for _, s, _ in lost], np.int64), np.array([n for _, _, n in lost], np.int64))] if lost else []
            lost.clear()
            if groups:
                doc, start = solve(np.array([x[0] for x in groups]), np.array([x[1] for x in groups]), np.array([x[2] for x in groups]), [x[3] for x in groups])
                by = np.lexsort((start, doc))
                doc, start = doc[by], start[by]
                cut = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1))) if len(doc) else np.zeros(0, np.int64)
                out.append((doc[cut], start[cut], np.diff(np.append(cut, len(doc)))))
                groups.clear()
                suffixes = 0
            if out:
                doc, start, n = (np.concatenate(x) for x in zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(start), pa.array(n.astype(np.int32))], ["doc_id", "start", "n"])

        for b in batches:
            for g, doc, start, n, raw in zip(*(b.column(i).to_pylist() for i in range(5))):
                if raw is None:
                    lost.append((doc, start, n))
                    continue
                if g != last:
                    close()
                    last = g
                    if suffixes >= SUFFIXES:
                        yield from send()
                if raw not in seen:
                    seen[raw] = (doc, start)
                    current.append((doc, start, n, raw))
                elif seen[raw] != (doc, start):
                    lost.append((doc, start, n))
            if len(lost) > 200_000:
                yield from send()
        close()
        yield from send()

    parts = int(contexts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return mapped(contexts.repartition(parts, "g").sortWithinPartitions("g", "doc_id", "start"), scan, "doc_id long, start long, n int")


def _remove(length: int, reused: bool):
    def run(batches):
        for b in batches:
            rows = []
            starts, runs = (b.column(2), b.column(3)) if b.num_columns > 2 else (None, None)
            for at, data, offsets in steps(b.column(1)):
                base = text_bases(data, offsets, reused)
                for i in range(len(offsets) - 1):
                    own = data[offsets[i] : offsets[i + 1]]
                    size = len(own)
                    if starts is None or not starts[at + i].is_valid:
                        rows.append((own.tobytes(), size, 0, 0))
                        continue
                    s, n = own_places(starts[at + i].values.to_numpy(), runs[at + i].values.to_numpy(), base[i])
                    ok = (s >= 0) & (s + n - 1 + length <= size)
                    s, n = s[ok], n[ok]
                    gone = np.zeros(size + 1, np.int32)
                    np.add.at(gone, s, 1)
                    np.add.at(gone, s + n - 1 + length, -1)
                    gone = np.cumsum(gone[:-1]) > 0
                    rows.append((own[~gone].tobytes(), size, int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())))
            kept, *counts = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kept, pa.binary()), *(pa.array(c, pa.int64()) for c in counts)], ["rest", "kept", "n_bytes", "n_removed", "n_spans"])

    return run


def suffix_dedup(docs: DataFrame, length: int = 100) -> DataFrame:
    """``docs``, then kept (binary: the remaining bytes), n_bytes, n_removed and n_spans (long), which replace columns of these names."""
    new = ("kept", "n_bytes", "n_removed", "n_spans")
    texts, reused = id_text(docs).where("doc_id is not null"), reused_ids(docs)
    bits = sketch.bits_for(sketch.text_bytes(texts) // 30)
    hot = docs.sparkSession.sparkContext.broadcast(_hot(texts, length))
    bitmap = docs.sparkSession.sparkContext.broadcast(sketch.repeated(texts, lambda data, offsets: pieces(data, offsets, length, hot.value)[0], bits))
    lost = _lost(_contexts(texts, bitmap, hot, length, reused), length)
    marks = lost.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("x")).select("doc_id", F.col("x.start").alias("starts"), F.col("x.n").alias("runs"))
    out = rewrite(docs, write_table(marks, "lost"), _remove(length, reused), "kept binary, n_bytes long, n_removed long, n_spans long")
    return out.select(*from_rest(out, [c for c in docs.columns if c not in new]), *new)


def op8_suffix(spark, sf_dir: str) -> DataFrame:
    out = suffix_dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
