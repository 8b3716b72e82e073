"""Operator 12: periodic runs of words, from Lyndon roots found by Baier grouping.

A run is a stretch of consecutive words with smallest period q and a length of
``max(6, 4 q)`` or more that no neighbouring word extends with that period.

1. ``lyndon`` is the first phase of Baier's suffix sorter: suffixes begin in
   groups by their first word; the groups are taken from the highest to the
   lowest, and each moves, for every suffix in it, the nearest earlier suffix
   of a lower group to a new group right above its own. A group's suffixes
   share the longest Lyndon word that starts there, whose length is summed up
   as groups move: the phase gives the Lyndon array without a suffix array.
2. It runs under both orders of the words. Every run has a root that is the
   longest Lyndon word at its place under one of them, and which repeats at
   once; each such root is extended to both sides as far as words one period
   apart are equal (the longest common extension), which gives the run whole.
3. Only stretches that can hold a run are grouped. In a run, all words behind
   the first period have occurred within the last q words; so where a stretch
   of ``3 q`` such words is missing, no run of period q can be. Distances to the
   last occurrence are found for all texts of a step at once, for each power
   of two; a stretch and the period before it hold every run that they may
   have as a whole, so nothing is lost.

All work is on one text, in the task that reads it: nothing is shuffled. Words
are told apart by 64 bits of their hash. Null, empty and white texts have no
words and no run. Rows without an id are not damaged (see ``op12_periods``);
repeated rows and rows that share an id are each judged by their own text.
Very long texts are whole; their stretches alone take time beyond numpy's.
Other columns are not looked at. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_text, mapped, read, steps
from .text import word_hashes, words

#: A run has at least so many words and periods.
WORDS, PERIODS = 6, 4


def lyndon(x: np.ndarray) -> np.ndarray:
    """The length of the longest Lyndon word that starts at each place of ``x`` (ranks from 0)."""
    n, ranks = len(x), x.tolist()
    k = max(ranks) + 1
    members: list[list[int]] = [[] for _ in range(k)]
    for i, r in enumerate(ranks):
        members[r].append(i)
    group, size = ranks, [1] * k  # of each suffix its group; of each group the length of its Lyndon word
    below, above = list(range(-1, k - 1)), list(range(1, k + 1))
    above[-1] = -1
    left = list(range(n))  # the nearest suffix, from here to the left, whose group is still to come
    out = np.empty(n, np.int64)
    at = k - 1
    while at >= 0:
        own = [i for i in members[at] if group[i] == at]
        members[at] = []
        for i in own:
            left[i] = i - 1
        many: dict[int, int] = {}
        for i in own:
            out[i] = size[at]
            j = i - 1
            while j >= 0 and left[j] != j:
                if (up := left[j]) >= 0:
                    left[j] = left[up]
                j = up
            left[i] = j
            if j >= 0:
                many[j] = many.get(j, 0) + 1
        if many:
            made: dict[tuple[int, int], int] = {}
            for count in sorted(set(many.values()), reverse=True):
                for j, c in many.items():
                    if c == count:
                        old = group[j]
                        new = made.get((count, old))
                        if new is None:
                            new = made[count, old] = len(members)
                            members.append([])
                            size.append(size[old] + count * size[at])
                            up = above[old]
                            below.append(old)
                            above.append(up)
                            above[old] = new
                            if up >= 0:
                                below[up] = new
                        members[new].append(j)
                        group[j] = new
        at = below[at]
    return out


def _extent(x: np.ndarray, start: int, q: int) -> tuple[int, int]:
    """The longest stretch around ``start`` in which words ``q`` apart are equal, given that one is there."""
    n, step, end = len(x), 64, start
    while end + q < n:
        differ = np.flatnonzero(x[end : end + step][: n - q - end] != x[end + q : end + q + step])
        if len(differ):
            end += int(differ[0])
            break
        end = min(end + step, n - q)
        step *= 2
    begin, step = start, 64
    while begin > 0:
        low = max(0, begin - step)
        differ = np.flatnonzero(x[low:begin] != x[low + q : begin + q])
        if len(differ):
            begin = low + int(differ[-1]) + 1
            break
        begin, step = low, step * 2
    return begin, end + q


def runs_within(x: np.ndarray, a: int, z: int) -> set[tuple[int, int, int]]:
    """The runs (start, length, period) of ``x`` that lie in ``x[a:z]``."""
    ranks = np.unique(x[a:z], return_inverse=True)[1]
    out = set()
    for order in (ranks, ranks.max() - ranks):
        root = lyndon(order)
        at = np.arange(len(root))
        # a run of four periods has its first root three times in a row
        at = at[at + 2 * root < len(root)]
        q = root[at]
        at = at[(root[at + q] == q) & (root[at + 2 * q] == q)]
        known: dict[int, int] = {}  # where the last run of a period ends
        for i, p in zip(at.tolist(), root[at].tolist()):
            i += a
            if i + p <= known.get(p, 0):
                continue
            if np.array_equal(x[i : i + p], x[i + p : i + 2 * p]):
                begin, end = _extent(x, i, p)
                known[p] = end
                if end - begin >= max(WORDS, PERIODS * p):
                    out.add((begin, end - begin, p))
    return out


def stretches(h: np.ndarray, doc: np.ndarray) -> list[tuple[int, int]]:
    """The stretches (from, to) of the words ``h`` of many texts that can hold runs, none across texts."""
    n = len(h)
    if n < WORDS:
        return []
    order = np.lexsort((h, doc))
    same = (h[order[1:]] == h[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
    back = np.full(n, n, np.int64)
    back[order[1:][same]] = (order[1:] - order[:-1])[same]
    first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    ends = np.append(first[1:], n)
    found, reach = [], 1
    longest = int((ends - first).max())
    while reach // 2 * PERIODS < longest:
        near = np.concatenate([[False], back <= reach, [False]])
        near = np.flatnonzero(near[1:] != near[:-1])
        a, z = near[::2], near[1::2]
        least = max((PERIODS - 1) * (reach // 2 + 1), WORDS - reach)
        long = z - a >= least
        found += [(int(i), int(j), reach) for i, j in zip(a[long], z[long])]
        reach *= 2
    # one text's stretches, with the period before them; a stretch of near words cannot span two texts, since a text's first word is far
    which = np.searchsorted(first, [i for i, _, _ in found], "right") - 1 if found else []
    out: list[tuple[int, int]] = []
    for a, z in sorted((max(int(first[k]), i - reach), min(int(ends[k]), j)) for (i, j, reach), k in zip(found, which)):
        if out and a < out[-1][1] and doc[a] == doc[out[-1][0]]:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


FIELDS = "doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _report(h: np.ndarray, runs: list[tuple[int, int, int]]) -> tuple:
    """n_runs, the run of the greatest exponent (start, length, period, exponent), and a digest of all."""
    if not runs:
        return 0, None, None, None, None, hashlib.sha256().hexdigest()
    best = runs[0]
    for r in runs[1:]:
        if r[1] * best[2] > best[1] * r[2]:  # in order of start and period, so ties stay with the first
            best = r
    return len(runs), *best, 1000 * best[1] // best[2], hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()


def periodic_runs(docs: DataFrame, change: Callable | None = None) -> DataFrame:
    """``FIELDS`` for each row of ``docs`` (doc_id, text).

    ``change(doc_id, n)`` may give the places of a text's ``n`` words in the
    order in which they are to be judged.
    """

    def run(batches):
        for b in batches:
            ids, out = b.column(0).to_pylist(), []
            for at, data, offsets in steps(b.column(1)):
                w = words(data, offsets)
                h = word_hashes(data, w)
                places = np.arange(len(h))
                changed = set()
                for i in range(len(offsets) - 1) if change else ():
                    a, z = int(w.first[i]), int(w.first[i + 1])
                    if (new := change(ids[at + i], z - a)) is not None:
                        places[a:z] = a + new
                        changed.add(i)
                h = h[places]
                found: dict[int, set] = {}
                for a, z in stretches(h, w.doc):
                    i = int(w.doc[a])
                    begin = int(w.first[i])
                    found.setdefault(i, set()).update(runs_within(h[begin : int(w.first[i + 1])], a - begin, z - begin))
                for i in range(len(offsets) - 1):
                    a, z = int(w.first[i]), int(w.first[i + 1])
                    runs = sorted((s, n, q) for s, n, q in found.get(i, ()))
                    runs.sort(key=lambda r: (r[0], r[2]))
                    if runs or i in changed:
                        keep = np.ones(z - a, bool)
                        for s, n, q in runs:
                            keep[s + q : s + n] = False
                        kept = places[a:z][keep]
                        text = b" ".join(data[s:e].tobytes() for s, e in zip(w.starts[kept], w.ends[kept]))
                    else:
                        text = b" ".join(data[offsets[i] : offsets[i + 1]].tobytes().split())
                    out.append((ids[at + i], z - a, *_report(h[a:z], runs), hashlib.sha256(text).hexdigest()))
            if out:
                kinds = [pa.int64()] * 7 + [pa.string()] * 2
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], [f.split()[0] for f in FIELDS.split(", ")])

    return mapped(id_text(docs), run, FIELDS)


def looped(doc_id: int | None, n: int) -> np.ndarray | None:
    """The query's damage: one document in ten repeats some of its words to its end."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    out = np.arange(n)
    out[a:] = a + (out[a:] - a) % p
    return out


def op12_periods(spark, sf_dir: str) -> DataFrame:
    return periodic_runs(read(spark, sf_dir, "documents"), looped).drop("n_words")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> '') AS w FROM documents
), c AS (
  SELECT doc_id, w, len(w) AS n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), CAST(range(8) AS BIGINT[])), lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END)), 4294967295::BIGINT) AS h FROM d
), g AS (
  SELECT doc_id, w, n, h % 10 = 0 AND n > 0 AS hit, CASE WHEN n > 0 THEN (h // 10) % n ELSE 0 END AS a, 3 + (h // 10) % 8 AS e FROM c
), p AS (
  SELECT *, 1 + (n - a) // e AS p FROM g
), e AS MATERIALIZED (
  SELECT doc_id, n, CAST(j AS BIGINT) AS j, w[1 + CASE WHEN hit AND j >= a THEN a + (j - a) % p ELSE j END] AS word
  FROM (SELECT *, unnest(range(n)) AS j FROM p)
), m AS (
  SELECT x.doc_id, y.j - x.j AS q, x.j FROM e x JOIN e y ON x.doc_id = y.doc_id AND x.word = y.word AND y.j > x.j AND y.j - x.j <= x.n // 4
), i AS (
  SELECT doc_id, q, min(j) AS s, max(j) - min(j) + 1 + q AS l FROM (SELECT *, j - row_number() OVER (PARTITION BY doc_id, q ORDER BY j) AS k FROM m) GROUP BY doc_id, q, k
), r AS (
  SELECT doc_id, s, l, min(q) AS q FROM i WHERE l >= greatest(6, 4 * q) GROUP BY doc_id, s, l
), b AS (
  SELECT doc_id, s, l, q, row_number() OVER (PARTITION BY doc_id ORDER BY l / q DESC, s, q) AS k, count(*) OVER (PARTITION BY doc_id) AS n_runs FROM r
), t AS (
  SELECT doc_id, sha256(string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q)) AS t FROM r GROUP BY doc_id
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(s + q, s + l)) AS j FROM r
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS t FROM e ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(s AS BIGINT) AS start, CAST(l AS BIGINT) AS length, CAST(q AS BIGINT) AS period, CAST(1000 * l // q AS BIGINT) AS exponent_milli, coalesce(t.t, sha256('')) AS runs_sha256, sha256(coalesce(kept.t, '')) AS collapsed_sha256
FROM d LEFT JOIN b ON b.doc_id = d.doc_id AND b.k = 1 LEFT JOIN t ON t.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id
"""
