"""Small Spark helpers that several operators share."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Bytes of text that one numpy step works on.
STEP_BYTES = 1 << 20
#: Bytes of an Arrow batch between the JVM and a worker.
BATCH_BYTES = 8 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@lru_cache(maxsize=1)
def _local_folder() -> str:
    folder = tempfile.mkdtemp(prefix="tables-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def _own_folder(spark: SparkSession) -> str:
    """A folder for sessions without ``spark.checkpoint.dir``: only where driver and executors are one process; it goes when the process ends."""
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _local_folder()


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the cluster's shared folder and read it back.

    The folder is the one named by ``spark.checkpoint.dir``; the table cuts
    the lineage, survives lost executors and is read with column pruning.
    Tables that no result reads any more go by ``drop_tables``; those that a
    returned DataFrame reads stay until the folder is cleared.
    """
    spark = df.sparkSession
    shared = spark.conf.get("spark.checkpoint.dir", None) or _own_folder(spark)
    path = f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.table_path = path
    return out


def drop_tables(*tables: DataFrame) -> None:
    """Remove tables of ``write_table``."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.table_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def mapped(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``df.mapInArrow(run, schema)`` whose worker gives memory back at the end of a task.

    Workers are reused and idle between tasks; what they keep adds up over
    the stages of a job.
    """

    def tidy(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except AttributeError:  # a C library without it
                pass

    return df.mapInArrow(tidy, schema)


def bounded_batches(df: DataFrame) -> None:
    """Arrow batches of texts by bytes, not only by rows: what a worker holds then doesn't depend on the texts' length."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` long and ``text`` with nulls as empty texts; nothing else."""
    bounded_batches(docs)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def with_rest(docs: DataFrame, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """``doc_id``, ``text`` and every column of ``docs`` (but the text, if ``keep_text`` is false) in one struct ``rest``.

    Operators that hand whole documents on carry them this way, so that no
    other column of the input can clash with a name of theirs.
    """
    bounded_batches(docs)
    rest = F.struct(*[docs[f"`{c}`"] for c in docs.columns if keep_text or c != text_col])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), rest.alias("rest"))


def from_rest(df: DataFrame, columns: list[str], text: str | None = None) -> list[Column]:
    """The columns of ``docs`` again; ``text`` names the column that replaces the text."""
    return [F.col(text).alias(c) if text and c == "text" else F.col("rest")[c].alias(c) for c in columns]


def steps(column: pa.Array, most: int = STEP_BYTES):
    """Cut an Arrow text column into ``(first row, bytes, offsets)`` of about ``most`` bytes.

    A text is never cut: one that is longer makes a step of its own. Null
    texts count as empty.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = column.buffers()[2] if n else None
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        own = offsets[at : to + 1]
        yield at, data[own[0] : own[-1]], own - own[0]
        at = to


def batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()], list(columns))


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
