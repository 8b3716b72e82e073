"""Scans: the long curve table, named tables, optional metadata, generated rows."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Sequence
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

#: The long table: one row for each curve and time. Everything but curve_id, t and r is constant in a curve.
CURVE_SCHEMA = T.StructType([T.StructField("curve_id", T.LongType()), T.StructField("t", T.DoubleType()), T.StructField("r", T.DoubleType())])


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN compares as the largest number in Spark; at the scan it becomes null."""
    floats = {f.name: F.when(~F.isnan(f.name), F.col(f.name)) for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.withColumns(floats) if floats else df


def load_curves(spark: SparkSession, path: str, schema: T.StructType | None = None, form: str = "parquet") -> DataFrame:
    """The whole long table, with an explicit schema where given, NaN as null."""
    reader = spark.read.schema(schema) if schema else spark.read
    return nan_to_null(reader.option("header", True).csv(path) if form == "csv" else reader.format(form).load(path))


def load_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    """One named table of a folder."""
    return spark.read.parquet(f"{path}/{table}.parquet")


def attach_metadata(df: DataFrame, meta: DataFrame | None, key: str, labels: Iterable[str] = (), order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Labels joined by key, first row of each key; without metadata, null labels.

    Returns the table, whose row count is unchanged, and a one-row table
    ``has_labels``: whether any label is known.
    """
    labels = list(labels) or [c for c in (meta.columns if meta is not None else []) if c != key]
    if meta is None:
        out = df.withColumns({c: F.lit(None).cast("string") for c in labels})
    else:
        from ..operators.profile import first_per_key

        out = df.join(first_per_key(meta.select(key, *labels, *([order] if order and order not in labels and order != key else [])), key, order or labels[0]).select(key, *labels), key, "left")
    known = F.coalesce(F.bool_or(F.greatest(*[F.col(c).isNotNull() for c in labels], F.lit(False))), F.lit(False)) if labels else F.lit(False)
    return out, out.agg(known.alias("has_labels"))


def linspace(spark: SparkSession, lo: float, hi: float, n: int) -> DataFrame:
    """(k, x): ``n`` evenly spaced points, both ends included."""
    return spark.range(n).select(F.col("id").alias("k"), (F.lit(float(lo)) + F.col("id") * (float(hi) - float(lo)) / max(n - 1, 1)).alias("x"))


def literal_rows(spark: SparkSession, values: Iterable[float]) -> DataFrame:
    return spark.createDataFrame([(float(v),) for v in values], "x double")


def write_result(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def save_curves(df: DataFrame, table: str, buckets: int, path: str | None = None, key: str = "curve_id", order: Sequence[str] = ("t",)) -> None:
    """Save a curve table dealt and sorted by curve, in ``buckets`` files, to ``path`` or else to the warehouse.

    What reads it again by ``saved_curves`` finds each curve's rows in one
    bucket: collapsing, neighbours, summaries and joins by curve of equally
    bucketed tables then need no exchange.
    """
    out = df.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key, *order).format("parquet")
    (out.option("path", path) if path else out).saveAsTable(table)


def saved_curves(spark: SparkSession, table: str) -> DataFrame:
    """A table of ``save_curves``; operators that take ``dealt`` may be told so."""
    return nan_to_null(spark.table(table))


@lru_cache(maxsize=1)
def _own_folder() -> str:
    folder = tempfile.mkdtemp(prefix="tables-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder of ``spark.checkpoint.dir``, which driver and executors share.

    Only a session of one process (``local[...]``) may leave the setting out;
    its own folder goes when it ends.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = _own_folder()
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def scratch(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder (``shared_path``) and read it back.

    What several passes read is computed once, and survives lost executors.
    The folder is the cluster's to clear, as it is for checkpoints.
    """
    spark = df.sparkSession
    path = shared_path(spark, "scratch")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scanned_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of what ``df`` scans; generated rows count as very many."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
