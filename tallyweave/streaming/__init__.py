"""Word counts of a stream, an extension beyond batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import counts, words
from ..options import DEFAULT_MAX_WORD


def stream_counts(stream: DataFrame, column: str = "text", max_word: int = DEFAULT_MAX_WORD) -> DataFrame:
    """Counts over everything seen, for ``complete`` or ``update`` output; state grows with the vocabulary."""
    return counts(words(stream, column, max_word))


def windowed_counts(stream: DataFrame, time: str, width: str, delay: str, column: str = "text", max_word: int = DEFAULT_MAX_WORD) -> DataFrame:
    """Counts by time window, for ``append`` output; the watermark bounds the state."""
    late = stream.withWatermark(time, delay)
    tokens = words(late, column, max_word, keep=(time,))
    return tokens.groupBy(F.window(time, width), "word").agg(F.count("*").alias("count"))
