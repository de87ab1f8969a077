"""What the operators of this subpackage share: tables, folders, folds, batches."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the given folder, read by Spark."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is ``spark.checkpoint.dir``.  Where that is unset and Spark runs on this machine
    alone, as in tests, a temporary folder of this machine takes its place; on a
    cluster it has to be set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: it has to name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tallyweave-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def temporary(spark: SparkSession, path: str) -> None:
    """Have Spark delete a folder, which is there, when its driver ends."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write a frame to the shared folder and read it back.

    This cuts the lineage: what follows reads files that outlive executors.  The files
    go when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    temporary(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def planned_parts(df: DataFrame) -> int:
    """About how many tasks read a table, by its size; 0 for what Spark knows no size of, which is no table."""
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return 0 if size >= 1 << 60 else size // spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))


def spread(df: DataFrame) -> DataFrame:
    """Deal rows to all cores if the input is small and has fewer files than there are cores.

    A table whose bytes make enough tasks by themselves is left alone, whatever its
    files, so of a large table no text is shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if planned_parts(df) < cores and len(df.inputFiles()) < cores else df


def held_out(id_col: str, k: int, rest: int) -> Column:
    """Whether crc32 of the id as text leaves this rest modulo k; false for null ids."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % F.lit(k) == rest, F.lit(False))


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Give freed memory back to the system.

    Workers outlive their tasks, and allocators keep what a task has freed: about a
    hundred MB a worker, beside which the next stage needs its own.
    """
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def grouped_by_bytes(batches, column: int, most: int):
    """Arrow batches cut so that a string column has about ``most`` bytes at most.

    A single text above the bound stands alone.  What earlier batches took goes back to
    the system before each batch and at the end.
    """
    for batch in batches:
        sizes = np.cumsum(np.diff(offsets(batch.column(column))), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            before = sizes[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(sizes, before + most, side="right")))
            yield batch.slice(at, end - at)
            at = end
        del batch, sizes
        release()


def filter_texts(df: DataFrame, text_col: str, keep, most: int = 1 << 20) -> DataFrame:
    """The rows, with all their columns, of which ``keep`` says so.

    ``keep``: from an Arrow array of texts to an array of truth values.  Rows stay
    where they are, so nothing is shuffled.
    """
    at = df.columns.index(text_col)

    def run(batches):
        for batch in grouped_by_bytes(batches, at, most):
            yield batch.filter(pa.array(np.asarray(keep(batch.column(at)), bool)))

    return df.mapInArrow(run, df.schema)


def offsets(column: pa.Array) -> np.ndarray:
    """Byte offsets of a string or binary column, from its own start on."""
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    raw = column.buffers()[1]
    if raw is None or raw.size == 0:
        return np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(raw, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a string column and the offsets of its rows in them.

    Nulls count as empty.
    """
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    at = offsets(column)
    raw = column.buffers()[2]
    if raw is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(at), np.int64)
    return np.frombuffer(raw, np.uint8)[at[0] : at[-1]], at - at[0]
