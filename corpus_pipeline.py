"""A training-data pipeline over ``documents``: five stages, one operator each.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's docs. All but the last
return the columns of documents.

Rows without an id go through every stage: the first judges them by their
text, the others pass them on, the last encodes them. Repeated rows are one
document until the second stage, which keeps one of them. Texts that share an
id are each judged by themselves. Null texts fail the first stage; an empty
table stays empty; very long texts are whole; columns of other names are
carried through the first four stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fuzzcurve.llm import bpe, decontaminate, jaccard, quality, substring
from fuzzcurve.llm.common import read, write_table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop rejected documents and lines that too many documents of a host have."""
    return quality.quality_filter(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of smallest id of each group of linked documents.

    Documents without an id have no links and stay. Texts that share an id are
    judged one by one: each is a document of its own here, known by a hash of
    both, and only what is itself linked to a kept text goes. Of repeated rows
    one stays.
    """
    several = write_table(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "several")
    if several.isEmpty():
        found = jaccard.jaccard_components(docs.select("doc_id", "text"))
        others = found.where("doc_id <> component_id").select("doc_id").distinct()
        return docs.join(others, "doc_id", "left_anti").select(*docs.columns)
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    own = own.join(several.select(F.col("doc_id").cast("long").alias("id"), F.lit(True).alias("several")), "id", "left")
    own = write_table(own.select("row", "id", "several", F.when(F.col("several"), F.xxhash64("id", "text")).otherwise(F.col("id")).alias("key"), "text"), "keyed")
    found = jaccard.jaccard_components(own.select(F.col("key").alias("doc_id"), "text")).where("doc_id is not null").select(F.col("doc_id").alias("key"), "component_id").distinct()
    ids = found.join(own.select("key", "id").distinct(), "key")
    least = ids.groupBy("component_id").agg(F.min_by("key", F.struct("id", "key")).alias("key")).select("key")
    kept = own.where("several is null").join(least, "key", "left_semi").select("row").unionByName(own.where("id is null").select("row"))
    one = own.where("several").join(least, "key", "left_semi").groupBy("key").agg(F.min("row").alias("row")).select("row")
    return kept.unionByName(one).select("row.*")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut words of 13-word windows that an earlier document has; texts of which nothing stays go."""
    return substring.substring_filter(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark passage."""
    return decontaminate.decontaminated(docs, read(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text (packed), their number, and digests of ids and decoded text."""
    coded = bpe.decode(bpe.encode(docs.select("doc_id", "text")))
    return coded.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("benchmark decontamination", without_benchmark),
    ("byte-level BPE encoding and decoding", token_ids),
]
#: Token ids are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = write_table(stage(spark, docs, sf_dir), "stage")
    return docs
