"""Operator 5: language identification by compression.

Each language has a raw-content zstandard dictionary of sample texts. A text
is compressed with every dictionary, in blocks so that the dictionary keeps
telling, and gets the language of the smallest sum. The score is how much
smaller that is than the second; a score below ``margin`` is rejected as too
narrow (``rejected``; the prediction stays, for a caller to drop).

Dictionaries come from a bounded sample: of every language the
``sample_docs`` documents of least hash, ``sample_chars`` of each, up to
``dict_bytes``. Prediction sees the text alone, and all of it. A text that
is null or has no letter is ``und`` with score 0; without any labelled text
all are ``und``. Of languages that compress a text alike the first in
alphabetical order is taken, with score 0. Repeated rows are judged alike,
one result for each; a very long text is compressed block by block, so only
its normalised copy is held. An empty table gives an empty result, other
columns are not looked at. A worker holds ``TOGETHER`` prepared dictionaries
at a time.
"""

from __future__ import annotations

import unicodedata

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import bounded_batches, mapped, read

BLOCK = 4096
#: Prepared dictionaries that a worker holds at once.
TOGETHER = 64
_ASCII = {i: chr(i).lower() if chr(i).isalpha() else " " for i in range(128)}


def normalise(text: str) -> str:
    """Lower-cased; ASCII other than letters becomes spaces, and runs of white space one."""
    return " ".join(text.translate(_ASCII).lower().split())


def _has_letter(text: str) -> bool:
    return any(unicodedata.category(c)[0] == "L" for c in text)


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(labelled: DataFrame, sample_docs: int = 150, sample_chars: int = 4000, dict_bytes: int = 100_000) -> dict[str, bytes]:
    """A dictionary for each language from ``labelled`` (doc_id, text, lang); rows without text or language are passed over."""
    own = labelled.where("lang is not null and text is not null")
    hashed = own.select("lang", F.substring("text", 1, sample_chars).alias("text"), F.xxhash64("doc_id", "text").alias("h"))
    best = Window.partitionBy("lang").orderBy("h", "text")
    picked = hashed.withColumn("k", F.row_number().over(best)).where(F.col("k") <= sample_docs)
    out: dict[str, list[bytes]] = {}
    for r in picked.orderBy("lang", "k").toLocalIterator():
        own_texts = out.setdefault(r["lang"], [])
        if sum(map(len, own_texts)) < dict_bytes:
            own_texts.append(normalise(r["text"]).encode())
    return {lang: b" ".join(texts)[:dict_bytes] for lang, texts in out.items() if any(texts)}


def identify(docs: DataFrame, dictionaries: dict[str, bytes], margin: float = 0.02, level: int = 6) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) for each row of ``docs`` (doc_id, text)."""
    bounded_batches(docs)
    shared = docs.sparkSession.sparkContext.broadcast(sorted(dictionaries.items()))

    def prepared(part):
        tools = []
        for lang, raw in part:
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            tools.append((lang, zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_dict_id=False)))
        return tools

    def run(batches):
        parts = [shared.value[i : i + TOGETHER] for i in range(0, len(shared.value), TOGETHER)]
        tools = prepared(parts[0]) if len(parts) == 1 else []
        for b in batches:
            pred, score = [], []
            texts = b.column(1).to_pylist()
            judged = [text is not None and bool(parts) and _has_letter(text) for text in texts]
            sizes = [[] for _ in texts]
            for part in parts:
                if len(parts) > 1:
                    tools = prepared(part)
                for i, text in enumerate(texts):
                    if judged[i]:
                        raw = normalise(text).encode()
                        blocks = [raw[j : j + BLOCK] for j in range(0, len(raw), BLOCK)]
                        sizes[i] = sorted(sizes[i] + [(sum(len(t.compress(x)) for x in blocks), lang) for lang, t in tools])[:2]
            for ok, size in zip(judged, sizes):
                if not ok:
                    pred.append("und")
                    score.append(0.0)
                    continue
                pred.append(size[0][1])
                score.append(1.0 - size[0][0] / size[1][0] if len(size) > 1 else 1.0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    out = mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, lang_pred string, score double")
    return out.withColumn("rejected", F.col("score") < margin)


def op5_language(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    dictionaries = fit(docs.where(~held_out(F.col("doc_id"))))
    return identify(docs.select("doc_id", "text"), dictionaries).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
