"""Readers of raw files and of columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def spread(df: DataFrame) -> DataFrame:
    """Deal rows to all cores if the input is small and has fewer files than there are cores.

    One Parquet row group is one task, however many cores there are.  Tables whose
    bytes make enough tasks are left alone, whatever their files: no shuffle of text
    at scale.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    each = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    return df.repartition(cores) if size < cores * each and len(df.inputFiles()) < cores else df


def sizes(spark: SparkSession, path: str) -> DataFrame:
    """S3: ``path, length`` of files, without reading them."""
    return spark.read.format("binaryFile").load(path).select("path", "length")


def bytes_text(df: DataFrame, column: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """S1 over a binary column: rows ``text``, one char for each byte, and the columns to keep."""
    return df.select(*keep, F.decode(F.col(column), "ISO-8859-1").alias("text"))


def binary_text(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as rows ``path, length, text``; one char for each byte.

    A row must fit in an executor's memory; ``line_text`` has no such limit.
    """
    return spark.read.format("binaryFile").load(path).select("path", "length", F.decode("content", "ISO-8859-1").alias("text"))


def line_text(spark: SparkSession, path: str) -> DataFrame:
    """Lines of files as rows ``text``, in splits of a file; one char for each byte.

    A line break is never a letter, so no word crosses a row.
    """
    return spark.read.text(path).select(F.decode(F.col("value").cast("binary"), "ISO-8859-1").alias("text"))


def column_text(df: DataFrame, column: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """A text column and the columns to keep, dealt to all cores."""
    return spread(df.select(*keep, F.col(column).alias("text")))
