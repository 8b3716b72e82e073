"""Operator 6: benchmark decontamination with spaced seeds.

A mask keeps some words of a window and ignores the others; hashing what it
keeps finds test passages of which single words were replaced. Words are
compared with A-Z lower-cased.

1. All windows of the test items are hashed under every mask. A bitmap of
   fixed size over these hashes lets training windows through that may hit;
   they join the test hashes exactly. Seeds meet as bare numbers, and what
   they name is made distinct before any item's words are fetched.
2. Seeds that more than ``OFTEN`` items have (a phrase that a template puts
   into all of them) would pair each of these items with every document that
   has the phrase. They are not joined as they are: both sides add two more
   words near the window and their places (one word for items of 15 words
   or 6, none where the window alone decides), which an overlap that counts
   has in common too. So such a seed meets where the texts go on alike, not
   where they share the phrase alone.
3. A hit names a diagonal: how far an item is shifted against a document.
   Around it the whole item is laid over the document, and the stretch that
   scores best (+1 for an equal word, -3 for another; of equal scores the
   shortest) is the overlap. It counts from ``min(13, 80 % of the item's
   words)`` equal words on.

The masks hit every stretch that counts, of any length, with two more equal
words within ``NEAR`` words of the window: a test searches all states that a
stretch without such a hit can be in, and finds none that counts. Items of
fewer than 15 words hit by any 4 words in a row instead: the best stretch ends
in 4 equal words at least, so none that counts is missed. Items of 1 to 3
words hit by their whole sequence; those of fewer than ``shortest`` words (3
unless told otherwise) are not looked for, since they would meet clean text.

Null texts have no words. Documents without an id pass as clean. Rows that
share an id are each judged by their own text; rows of ``benchmark`` that
share an id are separate items that report one id. Without items, or without
documents, nothing is contaminated. Very long texts are whole: one that is
longer than a step of work is a step of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import sketch
from .common import from_rest, id_text, mapped, read, signed, steps, write_table
from .marks import rewrite
from .text import U, Words, mix, word_hashes, words

#: The masks; 1 keeps a word. They serve items of ``LONG`` words and more.
MASKS = ("11010010111", "11101011001", "1011100111")
LONG = 15
#: Masks for shorter items of so many words: at least, at most.
SHORT = {"1111": (4, LONG - 1), "111": (3, 3), "11": (2, 2), "1": (1, 1)}
BITS = 24
#: Seeds of more items than ``OFTEN`` take further words along, which lie within ``NEAR`` words of the window.
OFTEN, NEAR = 16, 5
#: Hits whose further words are hashed at once.
HITS = 20_000


def further(size: np.ndarray, mask: np.ndarray, long_masks: int) -> np.ndarray:
    """How many words beyond a window of this mask an overlap with an item of ``size`` words has at least, up to 2."""
    need = np.minimum(13, -(-size * 4 // 5))
    width = np.array([11] * long_masks + [len(m) for m in SHORT])[mask]  # no mask keeps or covers more
    return np.clip(need - width, 0, 2)


def with_further(w: Words, h: np.ndarray, first: np.ndarray, seed: np.ndarray, width: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray]:
    """Seeds with ``need`` (1 or 2) further words each: which of the hits, and the hash."""
    which, out = [], []
    for a in range(0, len(first), HITS):
        own, s, size = first[a : a + HITS], seed[a : a + HITS], width[a : a + HITS]
        at = np.concatenate([own[:, None] - np.arange(NEAR, 0, -1), (own + size)[:, None] + np.arange(NEAR)], 1)
        inside = np.clip(at, 0, len(h) - 1)
        ok = (at == inside) & (w.doc[inside] == w.doc[own][:, None])
        word = mix(h[inside] + np.arange(1, 2 * NEAR + 1, dtype=U) * U(0x9E3779B97F4A7C15), 31)
        for i in range(2 * NEAR):
            one = mix(s ^ word[:, i], 32)
            for j in [None] if need == 1 else range(i + 1, 2 * NEAR):
                hit = np.flatnonzero(ok[:, i] if j is None else ok[:, i] & ok[:, j])
                which.append(a + hit)
                out.append(one[hit] if j is None else mix(one[hit] + word[hit, j], 33))
    return (np.concatenate(which), np.concatenate(out)) if out else (np.zeros(0, np.int64), np.zeros(0, U))


def seeds(w: Words, h: np.ndarray, masks=MASKS, used=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, hash and mask of each window under each mask (of those whose number is in ``used``, if given)."""
    starts, out, of = [], [], []
    for k, mask in enumerate(masks):
        m = len(h) - len(mask) + 1
        if m <= 0 or used is not None and k not in used:
            continue
        acc = np.full(m, U(k + 1))
        for j, bit in enumerate(mask):
            if bit == "1":
                acc = acc * U(0xFF51AFD7ED558CCD) + h[j : j + m]
        at = np.flatnonzero(w.doc[:m] == w.doc[len(mask) - 1 :])
        starts.append(at)
        out.append(mix(acc[at], 20 + k))
        of.append(np.full(len(at), k))
    return (np.concatenate(starts), np.concatenate(out), np.concatenate(of)) if out else (np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, np.int64))


def _items(benchmark: DataFrame) -> DataFrame:
    """(item, item_id, words): a number for each row of ``benchmark``, and the hashes of its words."""

    def run(batches):
        for b in batches:
            for at, data, offsets in steps(b.column(2)):
                w = words(data, offsets)
                h = word_hashes(data, w, lower=True)
                own = [h[a:z].tobytes() for a, z in zip(w.first[:-1], w.first[1:])]
                yield pa.RecordBatch.from_arrays([*(b.column(i).slice(at, len(own)) for i in (0, 1)), pa.array(own, pa.binary())], ["item", "item_id", "words"])

    rows = id_text(benchmark, "item_id").where("doc_id is not null")
    return mapped(rows.select(F.monotonically_increasing_id().alias("item"), F.col("doc_id").alias("item_id"), "text"), run, "item long, item_id long, words binary")


def _item_seeds(items: DataFrame, masks, shortest: int, often=None) -> DataFrame:
    """(h, item, at, mask): every seed of every item; the masks of ``SHORT`` follow ``masks``.

    With ``often``, a bitmap of seeds, those in it take further words along.
    """
    low, high = np.array([(LONG, 2**31)] * len(masks) + list(SHORT.values())).T
    width = np.array([len(m) for m in (*masks, *SHORT)])

    def run(batches):
        for b in batches:
            h = [np.frombuffer(x.as_buffer(), U) for x in b.column(1)]
            first = np.concatenate([[0], np.cumsum([len(x) for x in h])]).astype(np.int64)
            doc = np.repeat(np.arange(len(h)), np.diff(first))
            flat = np.concatenate(h) if h else np.zeros(0, U)
            w = Words(doc, doc, doc, first)
            at, seed, mask = seeds(w, flat, (*masks, *SHORT))
            size = np.diff(first)[doc[at]]
            keep = (size >= np.maximum(low[mask], shortest)) & (size <= high[mask])
            at, seed, mask, size = at[keep], seed[keep], mask[keep], size[keep]
            if often is not None:
                need = np.where(sketch.in_bitmap(often.value, sketch.hash_places(seed, BITS)), further(size, mask, len(masks)), 0)
                own = [np.flatnonzero(need == k) for k in range(3)]
                more = [with_further(w, flat, at[own[k]], seed[own[k]], width[mask[own[k]]], k) for k in (1, 2)]
                which = np.concatenate([own[0], *(own[k][x] for k, (x, _) in zip((1, 2), more))])
                seed = np.concatenate([seed[own[0]], *(x for _, x in more)])
                at, mask = at[which], mask[which]
            yield pa.RecordBatch.from_arrays([pa.array(signed(seed)), b.column(0).take(pa.array(doc[at])), pa.array((at - first[doc[at]]).astype(np.int32)), pa.array(mask.astype(np.int32))], ["h", "item", "at", "mask"])

    return mapped(items.select("item", "words"), run, "h long, item long, at int, mask int")


def _document_seeds(texts: DataFrame, bitmap, often, masks, used) -> DataFrame:
    """(h, doc_id, at) of windows that may hit; windows in ``often`` are asked for with further words as well."""
    width = np.array([len(m) for m in masks])

    def run(batches):
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for at, data, offsets in steps(b.column(1)):
                w = words(data, offsets)
                h = word_hashes(data, w, lower=True)
                first, seed, mask = seeds(w, h, masks, used)
                place = sketch.hash_places(seed, BITS)
                plain, many = sketch.in_bitmap(bitmap.value, place), np.flatnonzero(sketch.in_bitmap(often.value, place))
                found = [(first[plain], seed[plain])]
                for a in range(0, len(many), HITS):
                    own = many[a : a + HITS]
                    for need in (1, 2):
                        which, more = with_further(w, h, first[own], seed[own], width[mask[own]], need)
                        hit = sketch.in_bitmap(bitmap.value, sketch.hash_places(more, BITS))
                        found.append((first[own[which[hit]]], more[hit]))
                first, seed = (np.concatenate(x) for x in zip(*found))
                doc = w.doc[first]
                yield pa.RecordBatch.from_arrays([pa.array(signed(seed)), pa.array(ids[at + doc].astype(np.int64)), pa.array((first - w.first[doc]).astype(np.int32))], ["h", "doc_id", "at"])

    return mapped(texts, run, "h long, doc_id long, at int")


def overlap(doc: np.ndarray, item: np.ndarray, shift: int) -> int:
    """Equal words of the best stretch when the item's first word lies on word ``shift`` of the document; of equal scores the shortest counts."""
    a, z = max(0, -shift), min(len(item), len(doc) - shift)
    if z <= a:
        return 0
    equal = doc[a + shift : z + shift] == item[a:z]
    total = np.concatenate([[0], np.cumsum(np.where(equal, 1, -3))])
    low = np.minimum.accumulate(total)
    end = int(np.argmax(total - low))
    start = end - int(np.argmin(total[end::-1]))  # the last of the least
    return int(equal[start:end].sum())


def _verify(batches):
    for b in batches:
        flags, hits, best = [], [], []
        marked = b.num_columns > 2
        for at, data, offsets in steps(b.column(1)):
            n = len(offsets) - 1
            todo = [i for i in range(n) if marked and b.column(2)[at + i].is_valid]
            if todo:
                w = words(data, offsets)
                h = word_hashes(data, w, lower=True)
            for i in range(n):
                found, most = set(), 0
                if marked and b.column(2)[at + i].is_valid:
                    own = h[w.first[i] : w.first[i + 1]]
                    for m in b.column(2)[at + i].as_py():
                        item = np.frombuffer(m["words"], np.uint64)
                        got = max(overlap(own, item, shift) for shift in m["shifts"])
                        most = max(most, got)
                        if got >= min(13, -(-len(item) * 4 // 5)):
                            found.add(m["item_id"])
                flags.append(bool(found))
                hits.append(sorted(found))
                best.append(most)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(flags, pa.bool_()), pa.array(hits, pa.list_(pa.int64())), pa.array(best, pa.int64())], ["rest", "contaminated", "items", "overlap_words"])


def _diagonals(docs: DataFrame, items: DataFrame, masks, shortest: int) -> DataFrame:
    """(doc_id, item, shift), each once: where an item may lie on a document."""
    texts = id_text(docs).where("doc_id is not null")
    spark = docs.sparkSession.sparkContext
    plain = _item_seeds(items, masks, shortest).groupBy("h").agg(F.count_distinct("item").alias("c")).where(F.col("c") > OFTEN)
    often = spark.broadcast(sketch.key_bitmap(plain, "h", BITS, hashed=True))
    own = write_table(_item_seeds(items, masks, shortest, often), "seeds")
    bitmap = spark.broadcast(sketch.key_bitmap(own, "h", BITS, hashed=True))
    used = {r["mask"] for r in own.select("mask").distinct().collect()}
    hits = _document_seeds(texts, bitmap, often, (*masks, *SHORT), used).join(own.withColumnRenamed("at", "item_at"), "h")
    return hits.select("doc_id", "item", (F.col("at") - F.col("item_at")).alias("shift")).distinct()


def _judged(docs: DataFrame, benchmark: DataFrame, masks, shortest: int) -> DataFrame:
    items = write_table(_items(benchmark), "items")
    hits = _diagonals(docs, items, masks, shortest).groupBy("doc_id", "item").agg(F.collect_list("shift").alias("shifts")).join(items, "item")
    marks = hits.groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "shifts", "words")).alias("marks"))
    return rewrite(docs, write_table(marks, "hits"), _verify, "contaminated boolean, items array<long>, overlap_words long")


def find_contamination(docs: DataFrame, benchmark: DataFrame, masks=MASKS, shortest: int = 3) -> DataFrame:
    """``docs``, then contaminated (boolean), items (the item_ids it has) and overlap_words (long, of the best stretch), which replace columns of these names."""
    new, out = ("contaminated", "items", "overlap_words"), _judged(docs, benchmark, masks, shortest)
    return out.select(*from_rest(out, [c for c in docs.columns if c not in new]), *new)


def decontaminated(docs: DataFrame, benchmark: DataFrame, masks=MASKS, shortest: int = 3) -> DataFrame:
    """The columns of ``docs``, for documents without a benchmark passage."""
    out = _judged(docs, benchmark, masks, shortest).where("not contaminated")
    return out.select(*from_rest(out, docs.columns))


def op6_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return find_contamination(docs, read(spark, sf_dir, "benchmark")).drop("text")
