"""Documents that lose something meet their marks; the others are never shuffled."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import sketch
from .common import mapped, with_rest
from .text import span_hashes


def text_key() -> Column:
    """A key of columns ``doc_id`` and ``text``, for marks that belong to one of several texts of an id."""
    return F.xxhash64("doc_id", "text")


def reused_ids(docs: DataFrame) -> bool:
    """Whether any id stands in several rows, so that a place must also tell which text it is in."""
    return not docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty()


def text_bases(data: np.ndarray, offsets: np.ndarray, reused: bool) -> np.ndarray:
    """What is added to the places of each text: nothing, or 31 bits of its hash above their 32 bits.

    Several texts of one id so have places of their own, and repeated rows
    have the same.
    """
    if not reused:
        return np.zeros(len(offsets) - 1, np.int64)
    return (span_hashes(data, offsets[:-1], offsets[1:])[0] >> np.uint64(33)).astype(np.int64) << 32


def own_places(places: np.ndarray, runs: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the places of an id's texts, and the runs from there, those of the text with this base."""
    own = places >> 32 << 32 == base
    return places[own] - base, runs[own]


def rewrite(docs: DataFrame, marks: DataFrame, run: Callable, fields: str, keep_text: bool = True) -> DataFrame:
    """Apply ``run`` to every document of ``docs``, with its row of ``marks`` where there is one.

    ``marks`` has arrays by doc_id, or by doc_id and ``key`` (see
    ``text_key``), which also reaches documents without an id. ``run`` takes
    Arrow batches of (rest, text, the arrays of ``marks``) and yields (rest,
    the ``fields``), which is also the result; ``rest`` holds the columns of
    ``docs`` (see ``from_rest``), without the text if ``keep_text`` is false
    because a field replaces it: texts then travel once. A bitmap of fixed
    size over the marked documents keeps texts without marks out of the join.
    """
    by_text = "key" in marks.columns
    bitmap = docs.sparkSession.sparkContext.broadcast(sketch.key_bitmap(marks, "key" if by_text else "doc_id"))
    whole = with_rest(docs, keep_text=keep_text)
    rest = whole.schema["rest"].dataType.simpleString()
    arrays = [c for c in marks.columns if c not in ("doc_id", "key")]
    whole = whole.withColumn("key", text_key() if by_text else F.col("doc_id"))

    def of(hit: bool):
        def pick(batches):
            for b in batches:
                own = sketch.in_bitmap(bitmap.value, b.column(4).fill_null(0).to_numpy()) & ~np.asarray(b.column(3).is_null())
                got = b.filter(pa.array(own == hit)).select(["doc_id", "text", "rest", "key"])
                if got.num_rows:
                    yield got

        return pick

    placed, form = whole.select("doc_id", "text", "rest", "key", sketch.bitmap_places("key")), f"doc_id long, text string, rest {rest}, key long"
    shape = f"rest {rest}, {fields}"
    # one function, so that a task needs one worker
    clean = mapped(placed, lambda batches: run(b.select(["rest", "text"]) for b in of(False)(batches)), shape)
    own = mapped(placed, of(True), form)
    on = own["doc_id"].eqNullSafe(marks["doc_id"]) & (own["key"] == marks["key"]) if by_text else own["doc_id"] == marks["doc_id"]
    hit = mapped(own.join(marks, on, "left").select("rest", "text", *arrays), run, shape)
    return clean.unionByName(hit)
