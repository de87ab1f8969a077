"""Frames to frames: tokens, counts, ranks, reports."""

from .harness import compare, expected, percentile, product, rank_nulls_last, required, rotated, sorted_list
from .words import checksum, counts, counts_by, report, top_words, totals, words

__all__ = [
    "checksum", "compare", "counts", "counts_by", "expected", "percentile", "product", "rank_nulls_last",
    "report", "required", "rotated", "sorted_list", "top_words", "totals", "words",
]
