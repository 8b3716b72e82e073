"""Operator 1: quality rules with cross-document line frequency.

Base rules look at one text: its words, symbols, repeated lines and repeated
3-word windows. Then lines are compared across documents: normalised (A-Z
lower-cased, words joined by one space), hashed to 128 bits, and counted by
distinct documents of a host. A line is above the limit if more than
``max(min_docs, share * documents of the host)`` documents have it, or more
than ``most_docs``. It is removed from every document, but for the one with
the smallest id (``keep_first``): where thousands of copies of one clean text
stand in a host, its lines stay once. A document is depleted, and rejected,
if less than half of its words remain.

Counting combines on the map side, so a line of a third of all documents
sends one row a task. Null texts have no words and fail the base rules; a
null host is the host ''. Each row without an id counts as a document and is
judged, but is never the first to have a line. Rows that share an id count
as one document; each is judged by its own text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import bounded_batches, from_rest, mapped, read, signed, steps, write_table
from .marks import rewrite, text_key
from .text import U, Words, lowered, mix, span_hashes, windows, words

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def _line_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each \\n-split line, and the number of lines before each text."""
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    ends = np.sort(np.concatenate([offsets[1:], breaks]), kind="stable")
    count = np.searchsorted(breaks, offsets[1:]) - np.searchsorted(breaks, offsets[:-1]) + 1
    return starts, ends, np.concatenate([[0], np.cumsum(count)])


def _sum_by(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[first[1:]] - total[first[:-1]]


def _line_hashes(low: list[np.ndarray], first: np.ndarray, count: np.ndarray) -> list[np.ndarray]:
    """The hash of each line in both lanes, from the hashes of its words (``count`` of them from ``first`` on): each is mixed with its place in the line."""
    if not len(first):
        return [np.zeros(0, U)] * 2
    place = (np.arange(len(low[0])) - np.repeat(first, count)).astype(U)
    return [mix(np.add.reduceat(mix(h ^ mix(place, 60 + lane), 62 + lane), first) ^ count.astype(U), 64 + lane) for lane, h in enumerate(low)]


def _repeated_words(w: Words, lanes: list[np.ndarray]) -> np.ndarray:
    """True for words in 3-word windows that their text has twice or more."""
    at, h = windows(w, lanes[0], 3)
    h2 = windows(w, lanes[1], 3, lane=1)[1]
    doc = w.doc[at]
    order = np.lexsort((h2, h, doc))
    same = (h[order][1:] == h[order][:-1]) & (h2[order][1:] == h2[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(w.starts) + 3, np.int32)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + 3, -1)
    return np.cumsum(cover)[: len(w.starts)] > 0


def measure(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Counts of each text, and of its lines that have a word: number, hash of the normalised line, words."""
    n_texts = len(offsets) - 1
    w = words(data, offsets)
    repeated = _repeated_words(w, span_hashes(data, w.starts, w.ends, 2))
    inside = np.zeros(len(data) + 1, np.int8)
    inside[w.starts] += 1
    inside[w.ends] -= 1
    inside = np.cumsum(inside[:-1], dtype=np.int8) > 0

    starts, ends, first = _line_spans(data, offsets)
    doc = np.repeat(np.arange(n_texts), np.diff(first))
    a, z = np.searchsorted(w.starts, starts), np.searchsorted(w.starts, ends)
    full = np.flatnonzero(z > a)
    raw, raw2 = span_hashes(data, starts[full], ends[full], 2)
    of = doc[full]
    order = np.lexsort((raw2, raw, of))
    dup = np.zeros(len(full), bool)
    dup[order[1:]] = (raw[order][1:] == raw[order][:-1]) & (raw2[order][1:] == raw2[order][:-1]) & (of[order][1:] == of[order][:-1])
    line, line2 = _line_hashes(span_hashes(lowered(data), w.starts, w.ends, 2), a[full], (z - a)[full])
    line_first = np.searchsorted(full, first)
    return {
        "n_words": np.diff(w.first),
        "word_chars": _sum_by(inside & ((data & 0xC0) != 0x80), offsets),
        "n_symbols": _sum_by(_SYMBOL[data], offsets),
        "n_dup_lines": _sum_by(dup, line_first),
        "n_repeat_words": _sum_by(repeated, w.first),
        "line_first": line_first,
        "line": full - first[doc[full]],
        "line_hash": signed(line),
        "line_hash2": signed(line2),
        "line_words": (z - a)[full],
    }


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


_LINES = {"line": np.int32, "line_hash": np.int64, "line_hash2": np.int64, "line_words": np.int32}


def _measured(docs: DataFrame, host_col: str) -> DataFrame:
    bounded_batches(docs)
    host = F.coalesce(F.col(host_col).cast("string"), F.lit("")) if host_col in docs.columns else F.lit("")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), host.alias("host"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("key", text_key())

    def run(batches):
        for b in batches:
            for at, data, offsets in steps(b.column(2)):
                m, n = measure(data, offsets), len(offsets) - 1
                cut = pa.array(m["line_first"].astype(np.int32))
                lists = [pa.ListArray.from_arrays(cut, pa.array(m[k].astype(t))) for k, t in _LINES.items()]
                yield pa.RecordBatch.from_arrays([*(b.column(i).slice(at, n) for i in (0, 1, 3)), *(pa.array(m[k].astype(np.int64)) for k in _COUNTS), *lists], ["doc_id", "host", "key", *_COUNTS, *_LINES])

    counts = ", ".join(f"{c} long" for c in _COUNTS)
    return mapped(own, run, f"doc_id long, host string, key long, {counts}, line array<int>, line_hash array<long>, line_hash2 array<long>, line_words array<int>")


def quality_report(docs: DataFrame, host_col: str = "source", min_docs: int = 20, share: float = 0.01, most_docs: int = 1000, keep_first: bool = True) -> DataFrame:
    """One row for each row of ``docs``: doc_id, the counts, base_failed, n_removed_words, depleted, kept, removed_lines (array of line numbers), key (of id and text)."""
    rows = write_table(_measured(docs, host_col).withColumn("row", F.monotonically_increasing_id()), "measured")
    document = ("doc_id", F.when(F.col("doc_id").isNull(), F.col("row")).alias("orphan"))
    lines = rows.select("row", "host", *document, F.explode(F.arrays_zip(*_LINES)).alias("x")).select("row", "host", "doc_id", "orphan", "x.*")
    share_of = rows.select("host", *document).distinct().groupBy("host").agg(F.count("*").alias("n"))
    limits = share_of.select("host", F.least(F.greatest(F.lit(float(min_docs)), share * F.col("n")), F.lit(float(most_docs))).alias("limit"))
    line = ["host", "line_hash", "line_hash2"]
    often = lines.groupBy(*line, "doc_id", "orphan").agg(F.lit(1).alias("one")).groupBy(*line).agg(F.count("*").alias("c"), F.min("doc_id").alias("first")).where(F.col("c") > F.lit(min(min_docs, most_docs)))
    often = write_table(often.join(limits, "host").where("c > limit").select(*line, "first"), "often")
    lost = lines.join(often, line)
    if keep_first:
        lost = lost.where("first is null or doc_id is null or doc_id <> first")
    lost = lost.groupBy("row").agg(F.sum("line_words").cast("long").alias("n_removed_words"), F.sort_array(F.collect_list("line")).alias("removed_lines"))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    removed = F.coalesce("n_removed_words", F.lit(0).cast("long"))
    out = rows.select("row", "doc_id", "key", *_COUNTS).join(lost, "row", "left")
    out = out.withColumns({"n_removed_words": removed, "base_failed": base}).withColumn("depleted", 2 * (F.col("n_words") - F.col("n_removed_words")) < F.col("n_words"))
    return out.select("doc_id", *_COUNTS, "base_failed", "n_removed_words", "depleted", (~F.col("base_failed") & ~F.col("depleted")).alias("kept"), "removed_lines", "key")


def _without_lines(batches):
    for b in batches:
        text, ok = b.column(1), pa.array(np.ones(b.num_rows, bool))
        if b.num_columns > 2:
            gone, ok = b.column(2), b.column(3).fill_null(True)
            if any(map(len, gone.drop_null().to_pylist())):
                out = []
                for x, lines in zip(text, gone):
                    x = x.as_py()
                    if drop := set(lines.as_py() or ()):
                        x = "\n".join(line for j, line in enumerate(x.split("\n")) if j not in drop)
                    out.append(x)
                text = pa.array(out, pa.string())
        yield pa.RecordBatch.from_arrays([b.column(0), text, ok], ["rest", "cleaned", "ok"])


def quality_filter(docs: DataFrame, **limits) -> DataFrame:
    """``docs`` without rejected documents, and without lines above the limit in the texts that stay."""
    report = quality_report(docs, **limits)
    marked = report.where("not kept or removed_lines is not null")
    marks = marked.groupBy("doc_id", "key").agg(F.flatten(F.collect_set(F.coalesce("removed_lines", F.array().cast("array<int>")))).alias("lines"), F.max("kept").alias("kept"))
    out = rewrite(docs, write_table(marks, "rejected"), _without_lines, "cleaned string, ok boolean", keep_text=False)
    out = out.where("ok")
    return out.select(*from_rest(out, docs.columns, "cleaned"))


def op1_quality(spark, sf_dir: str) -> DataFrame:
    return quality_report(read(spark, sf_dir, "documents").select("doc_id", "text", "source")).drop("removed_lines", "key")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> '') AS w FROM documents
), g AS (
  SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS win
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)
), rep AS (
  SELECT doc_id, count(DISTINCT j) AS n FROM (
    SELECT doc_id, i + unnest(range(0, 3)) AS j FROM g JOIN (SELECT doc_id, win FROM g GROUP BY ALL HAVING count(*) > 1) USING (doc_id, win)
  ) GROUP BY doc_id
), l AS (
  SELECT doc_id, host, t, k, line, list_filter(regexp_split_to_array(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t-\r]+'), lambda x: x <> '') AS lw
  FROM (SELECT doc_id, host, t, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS k FROM d)
), f AS (
  SELECT doc_id, host, t, line, k, array_to_string(lw, ' ') AS norm, len(lw) AS nw FROM l WHERE len(lw) > 0
), dup AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM f GROUP BY doc_id
), lim AS (
  SELECT host, least(greatest(20.0, 0.01 * count(DISTINCT doc_id)), 1000.0) AS lim FROM d GROUP BY host
), often AS (
  SELECT host, norm, count(DISTINCT doc_id) AS c, min(doc_id) AS first FROM f GROUP BY host, norm
), lost AS (
  SELECT f.doc_id, sum(nw) AS n FROM f JOIN often USING (host, norm) JOIN lim USING (host) WHERE c > lim AND doc_id <> first GROUP BY f.doc_id
), x AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[ \t-\r]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(coalesce(lost.n, 0) AS BIGINT) AS n_removed_words
  FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN lost USING (doc_id)
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, 2 * (n_words - n_removed_words) < n_words AS depleted,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT 2 * (n_words - n_removed_words) < n_words AS kept FROM x
"""
