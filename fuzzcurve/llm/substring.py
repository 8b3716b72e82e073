"""Operator 9: substring dedup with a count-min prefilter.

A window is ``k`` consecutive words of one document. A word goes if some
window that covers it also starts in a document with a smaller id; windows
are judged on the input.

1. Every partition sketches the hashes of its windows, each once a text (no text
   loses a window to itself), and the sketches are
   merged (``sketch.repeated``): a bitmap of bounded size that overestimates.
2. A second pass sends only windows estimated as repeated to their exact
   group, by 128 bits of their bytes. Before that, each task keeps a window's
   rows of its smallest document only - the rest are known to repeat already,
   and go as runs of windows - so that a window of a third of all documents
   sends as many rows as there are tasks.
3. The groups are read in order of (window, document): all but the first
   document lose the window. Texts that lose nothing are never shuffled.

Once the corpus has far more windows than the largest sketch has counters,
the sketch passes most of them and the second pass approaches an exact
grouping of all windows: the shuffle then grows with the input, nothing is
read again and nothing is lost.

Documents without an id are passed on unchanged. Rows that share an id count
as one document: no window is lost to another text of its own id. Places tell
which of an id's texts they are in, so each text loses its own words only;
repeated rows lose the same. Null texts are empty, an empty table gives an
empty result. Very long texts are whole: one that is longer than a step of
work is a step of its own. Columns of other names travel in a struct and
cannot clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import sketch
from .common import batch, from_rest, id_text, mapped, read, signed, steps, write_table
from .marks import own_places, reused_ids, rewrite, text_bases
from .text import mix, span_hashes, windows, words

#: Candidate rows that a task holds for its own comparison.
HELD = 800_000


def _window_hashes(k: int):
    """Hashes to sketch: each window once a text, since no text loses a window to itself."""

    def hashes(data, offsets):
        w = words(data, offsets)
        first, h = windows(w, span_hashes(data, w.starts, w.ends)[0], k)
        doc = w.doc[first]
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        return h[new]

    return hashes


def _candidates(texts: DataFrame, bitmap, k: int, reused: bool) -> DataFrame:
    """Rows (h, h2, doc_id, start, known) of windows estimated as repeated; ``known``: so many windows from ``start`` on that a smaller document of the same task has."""

    def emit(batches):
        held, n = [], 0

        def flush():
            h, h2, doc, start = (np.concatenate(x) for x in zip(*held))
            held.clear()
            order = np.lexsort((doc, h2, h))
            new = np.append(True, (h[order][1:] != h[order][:-1]) | (h2[order][1:] != h2[order][:-1]))
            first = doc[order[np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))]]
            lost = np.zeros(len(h), bool)
            lost[order] = doc[order] != first
            asks, known = np.flatnonzero(~lost), np.flatnonzero(lost)
            cut = np.flatnonzero(np.append(True, (doc[known][1:] != doc[known][:-1]) | (start[known][1:] != start[known][:-1] + 1))) if len(known) else known
            many = np.diff(np.append(cut, len(known)))
            known = known[cut]
            at = np.concatenate([asks, known])
            h[known], h2[known] = mix(doc[known].view(np.uint64) ^ mix(start[known].astype(np.uint64))), 0
            return batch(h=signed(h[at]), h2=signed(h2[at]), doc_id=doc[at], start=start[at], known=np.concatenate([np.zeros(len(asks), np.int32), many.astype(np.int32)]))

        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for at, data, offsets in steps(b.column(1)):
                w = words(data, offsets)
                h, h2 = span_hashes(data, w.starts, w.ends, 2)
                first, h = windows(w, h, k)
                keep = np.flatnonzero(sketch.estimated_repeated(bitmap.value, h))
                h2 = windows(w, h2, k, lane=1)[1][keep]
                first, h = first[keep], h[keep]
                doc = w.doc[first]
                held.append((h, h2, ids[at + doc].astype(np.int64), first - w.first[doc] + text_bases(data, offsets, reused)[doc]))
                n += len(h)
                if n >= HELD:
                    yield flush()
                    n = 0
        if n:
            yield flush()

    return mapped(texts, emit, "h long, h2 long, doc_id long, start long, known int")


def _losers(candidates: DataFrame) -> DataFrame:
    """(doc_id, start, n): n windows from ``start`` on that a smaller document has too."""

    def scan(batches):
        last = None
        for b in batches:
            h, h2, doc, start, known = (b.column(i).to_numpy() for i in range(5))
            if not len(h):
                continue
            new = np.append(True, (h[1:] != h[:-1]) | (h2[1:] != h2[:-1]))
            new[0] = last is None or (h[0], h2[0]) != last[:2]
            at = np.maximum.accumulate(np.where(new, np.arange(len(h)), -1))
            first = np.where(at >= 0, doc[at], last[2] if last else 0)
            last = h[-1], h2[-1], first[-1]
            lose = (known > 0) | (doc != first)
            yield batch(doc_id=doc[lose], start=start[lose], n=np.maximum(known[lose], 1))

    parts = int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return mapped(candidates.repartition(parts, "h", "h2").sortWithinPartitions("h", "h2", "doc_id"), scan, "doc_id long, start long, n int")


def _cut(data: np.ndarray, w, first: int, last: int, begin: int, end: int, starts, runs, k: int) -> tuple[bytes, int]:
    """The text without the words of the given windows, and how many words that were.

    A run of removed words takes the white space after it along.
    """
    n = last - first
    gone = np.zeros(n + 1, np.int32)
    s, to = np.asarray(starts, np.int64), np.asarray(starts, np.int64) + runs - 1 + k
    inside = (s >= 0) & (to <= n)
    np.add.at(gone, s[inside], 1)
    np.add.at(gone, to[inside], -1)
    gone = np.cumsum(gone[:-1]) > 0
    keep = np.flatnonzero(~gone)
    if len(keep) == n:
        return data[begin:end].tobytes(), 0
    after = np.append(w.starts[first + 1 : last], end)
    parts = [data[begin : w.starts[first]]] if n else []
    cuts = np.flatnonzero(np.diff(keep, prepend=-2) != 1)
    for a, b in zip(cuts, [*cuts[1:], len(keep)]):
        parts.append(data[w.starts[first + keep[a]] : after[keep[b - 1]]])
    return b"".join(p.tobytes() for p in parts), int(n - len(keep))


def _rewrite(k: int, reused: bool):
    def run(batches):
        for b in batches:
            texts, n_words, n_removed = [], [], []
            starts, runs = (b.column(2), b.column(3)) if b.num_columns > 2 else (None, None)
            for at, data, offsets in steps(b.column(1)):
                w, base = words(data, offsets), text_bases(data, offsets, reused)
                for i in range(len(offsets) - 1):
                    text, gone = data[offsets[i] : offsets[i + 1]].tobytes(), 0
                    if starts is not None and starts[at + i].is_valid:
                        text, gone = _cut(data, w, w.first[i], w.first[i + 1], offsets[i], offsets[i + 1], *own_places(starts[at + i].values.to_numpy(), runs[at + i].values.to_numpy(), base[i]), k)
                    texts.append(text)
                    n_words.append(w.first[i + 1] - w.first[i])
                    n_removed.append(gone)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())], ["rest", "kept", "n_words", "n_removed"])

    return run


def find_repeats(docs: DataFrame, k: int = 13, reused: bool = True) -> DataFrame:
    """(doc_id, starts, runs): the windows that each document loses, as runs of so many from each start; written to the shared folder.

    With ``reused`` the starts hold a hash of their text (``marks.text_bases``).
    """
    texts = id_text(docs).where("doc_id is not null")
    bits = sketch.bits_for(sketch.text_bytes(texts) // 6)
    bitmap = docs.sparkSession.sparkContext.broadcast(sketch.repeated(texts, _window_hashes(k), bits))
    lost = _losers(_candidates(texts, bitmap, k, reused)).groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("x"))
    return write_table(lost.select("doc_id", F.col("x.start").alias("starts"), F.col("x.n").alias("runs")), "repeats")


def _deduped(docs: DataFrame, k: int) -> DataFrame:
    reused = reused_ids(docs)
    return rewrite(docs, find_repeats(docs, k, reused), _rewrite(k, reused), "kept string, n_words long, n_removed long", keep_text=False)


def substring_dedup(docs: DataFrame, k: int = 13) -> DataFrame:
    """``docs`` with the repeated words cut out of ``text``, then n_words and n_removed (long, of the input), which replace columns of these names."""
    new, out = ("n_words", "n_removed"), _deduped(docs, k)
    return out.select(*from_rest(out, [c for c in docs.columns if c not in new], "kept"), *new)


def substring_filter(docs: DataFrame, k: int = 13) -> DataFrame:
    """The columns of ``docs``, repeated words cut out of ``text``; a text of which nothing stays goes."""
    out = _deduped(docs, k).where("n_removed = 0 or n_removed < n_words")
    return out.select(*from_rest(out, docs.columns, "kept"))


def op9_substring(spark, sf_dir: str) -> DataFrame:
    out = substring_dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = F.array_join(F.filter(F.split("text", "[ \\t-\\r]+"), lambda w: w != ""), " ")
    return out.select("doc_id", "n_words", "n_removed", F.sha2(kept.cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> '') AS w FROM documents
), g AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS win
  FROM (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM d WHERE len(w) >= 13)
), m AS (
  SELECT win, min(doc_id) AS first FROM g GROUP BY win
), x AS (
  SELECT DISTINCT doc_id, i + unnest(range(0, 13)) AS j FROM g JOIN m USING (win) WHERE doc_id > first
), e AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM d
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS t FROM e ANTI JOIN x USING (doc_id, j) GROUP BY doc_id
), gone AS (
  SELECT doc_id, count(*) AS n FROM x GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN gone USING (doc_id)
"""
