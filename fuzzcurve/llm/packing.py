"""Operator 10: token ids packed into rows of one length.

Each text is encoded and closed with an end-of-text id. What is longer than
a row is split, losing nothing; the segments are packed best-fit decreasing:
longest first, each into the fullest row that still has room. A segment tree
over the free capacities finds that row in logarithmic time. Every task
packs what it reads, in lots of bounded size, so nothing is shuffled or
gathered; only a lot's last rows stay partly empty.

A packed row holds its ids (``row_len`` little-endian integers, padded), the
cumulative lengths of its segments, and a bit for each place where positions
start again at 0. With them go, for every segment, the document's id, its
number among the texts of its task and the piece number, from which
``unpack`` restores the ids of each text. An empty or null text is its
end-of-text id alone. Rows without an id, and rows that repeat one, are
texts of their own throughout. An empty table gives no rows. Only the columns
``doc_id`` and ``text`` are looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .bpe import encoder, rank_file
from .common import id_text, mapped, read, steps

ROW = 2048
#: Tokens of one lot.
LOT = 6_000_000
SCHEMA = "part int, row long, n_ids int, ids binary, cu_seqlens array<int>, position_resets binary, doc_ids array<long>, doc_rows array<long>, pieces array<int>"


class Capacities:
    """Rows by free capacity 0..most; a segment tree tells which capacities have rows."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def _add(self, capacity: int, by: int):
        at = capacity + self.leaves
        while at:
            self.count[at] += by
            at >>= 1

    def push(self, capacity: int, row: int):
        self.rows[capacity].append(row)
        self._add(capacity, 1)

    def pop(self, least: int) -> tuple[int, int] | None:
        """Take a row with the least capacity that is at least ``least``."""
        at, count = least + self.leaves, self.count
        if not count[at]:
            while at > 1 and (at & 1 or not count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if count[2 * at] else 2 * at + 1
        capacity = at - self.leaves
        self._add(capacity, -1)
        return capacity, self.rows[capacity].pop()


def best_fit_decreasing(sizes: np.ndarray, most: int) -> list[list[int]]:
    """Rows of segments, as indices of ``sizes`` (each 1..most)."""
    free, rows = Capacities(most), []
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        found = free.pop(size)
        if found is None:
            found = most, len(rows)
            rows.append([])
        rows[found[1]].append(i)
        if found[0] > size:
            free.push(found[0] - size, found[1])
    return rows


def pack(docs: DataFrame, row_len: int = ROW, end_id: int = 50256, ranks: bytes | None = None) -> DataFrame:
    """Packed rows of the encoded texts of ``docs`` (doc_id, text); ``row_len`` is a multiple of 8."""
    if row_len < 8 or row_len % 8:
        raise ValueError("row_len must be a multiple of 8")
    raw = docs.sparkSession.sparkContext.broadcast(ranks or rank_file())

    def run(batches):
        own, part, row, lot, held, texts = encoder(raw.value), TaskContext.get().partitionId(), 0, [], 0, 0
        kind = "<u2" if max(end_id, len(own.vocabulary.length)) < 1 << 16 else "<u4"

        def send():
            nonlocal row
            segments = [(doc, number, ids[a : a + row_len], piece) for doc, number, ids in lot for piece, a in enumerate(range(0, len(ids), row_len))]
            sizes = np.fromiter((len(s[2]) for s in segments), np.int64, len(segments))
            out = []
            for picked in best_fit_decreasing(sizes, row_len):
                cuts = np.concatenate([[0], np.cumsum(sizes[picked])]).astype(np.int32)
                ids, resets = np.full(row_len, end_id, kind), np.zeros(row_len, np.uint8)
                ids[: cuts[-1]] = np.concatenate([segments[i][2] for i in picked])
                resets[cuts[:-1]] = 1
                out.append((part, row, int(cuts[-1]), ids.tobytes(), cuts.tolist(), np.packbits(resets, bitorder="little").tobytes(), *([segments[i][k] for i in picked] for k in (0, 1, 3))))
                row += 1
            types = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()))
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            for a in range(0, len(out), 1000):
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out[a : a + 1000]), types)], names)

        for b in batches:
            keys = b.column(0).to_pylist()
            for at, data, offsets in steps(b.column(1)):
                ids, first = own.encode(data, offsets)
                ids = ids.astype(kind)
                for i in range(len(offsets) - 1):
                    lot.append((keys[at + i], texts, np.append(ids[first[i] : first[i + 1]], np.array(end_id, kind))))
                    texts += 1
                held += len(ids) + len(offsets)
                if held >= LOT:
                    yield from send()
                    lot, held = [], 0
        if lot:
            yield from send()

    return mapped(id_text(docs), run, SCHEMA)


def unpack(packed: DataFrame) -> DataFrame:
    """(doc_id, ids): the ids of each packed text again, its end-of-text id included; one row for each row that was packed."""

    def run(batches):
        for b in batches:
            out = []
            for r in b.to_pylist():
                width = len(r["ids"]) // (len(r["position_resets"]) * 8)
                ids = np.frombuffer(r["ids"], f"<u{width}").astype(np.int32)
                out += [(r["part"], number, doc, piece, ids[a:z]) for number, doc, piece, a, z in zip(r["doc_rows"], r["doc_ids"], r["pieces"], r["cu_seqlens"], r["cu_seqlens"][1:])]
            if out:
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], ["part", "number", "doc_id", "piece", "ids"])

    parts = mapped(packed, run, "part int, number long, doc_id long, piece int, ids array<int>")
    whole = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("piece", "ids"))), lambda s: s["ids"]))
    return parts.groupBy("part", "number", "doc_id").agg(whole.alias("ids")).select("doc_id", "ids")


def write_packed(packed: DataFrame, path: str) -> None:
    """Write packed rows as Parquet; one file for each task that packed."""
    packed.write.parquet(path)


def op10_packing(spark, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))
