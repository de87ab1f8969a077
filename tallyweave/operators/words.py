"""Words, their counts and their ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import normal, result_checksum, runs
from ..options import DEFAULT_MAX_WORD, DEFAULT_TOP, clamp_max_word

ENTRY = "array<struct<word:string,count:bigint>>"


def words(df: DataFrame, column: str = "text", max_word: int = DEFAULT_MAX_WORD, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row ``word`` for each word, beside the columns to keep."""
    run = df.select(*keep, F.explode(runs(F.col(column))).alias("word"))
    return run.select(*keep, normal(F.col("word"), clamp_max_word(max_word)).alias("word"))


def counts(tokens: DataFrame) -> DataFrame:
    """A1: ``word, count``; counted within each task before the one shuffle."""
    return tokens.groupBy("word").agg(F.count("*").alias("count"))


def totals(counted: DataFrame) -> DataFrame:
    """A2 and A3: one row ``total, unique``; zeros for no words."""
    return counted.agg(F.coalesce(F.sum("count"), F.lit(0).cast("bigint")).alias("total"), F.count("*").alias("unique"))


def counts_by(tokens: DataFrame, *keys: str) -> DataFrame:
    """A2 and A3 for each group: counted by group and word, then summed, so no group's words meet in one task."""
    return (
        tokens.groupBy(*keys, "word").agg(F.count("*").alias("count"))
        .groupBy(*keys).agg(F.sum("count").alias("total"), F.count("*").alias("unique"))
    )


def top_words(counted: DataFrame, top: int = DEFAULT_TOP) -> DataFrame:
    """O1 to O3: the first entries by count, then by the word's bytes."""
    if top < 1:
        raise ValueError("top must be positive")
    return counted.orderBy(F.desc("count"), F.asc("word")).limit(top)


def report(tokens: DataFrame, top: int = DEFAULT_TOP) -> DataFrame:
    """One row ``total, unique, top``.

    Totals are over all words.  Spark reuses the counts' one shuffle for both sides.
    """
    counted = counts(tokens)
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("k"), "word", "count")))
    shown = F.transform(ranked, lambda e: F.struct(e["word"].alias("word"), e["count"].alias("count")))
    first = top_words(counted, top).agg(shown.cast(ENTRY).alias("top"))
    return totals(counted).crossJoin(first)


def checksum(reported: DataFrame) -> DataFrame:
    """A5 for each report row: ``checksum``."""
    return reported.select(result_checksum(F.col("total"), F.col("unique"), F.col("top")).alias("checksum"))
