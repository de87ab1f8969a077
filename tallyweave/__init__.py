"""Exact ASCII word statistics on Spark.

A word is a maximal run of the letters A-Z and a-z, lower-cased and cut to a
length.  Everything is DataFrame and SQL expressions; nothing is a UDF.
"""

from .operators import checksum, counts, report, top_words, totals
from .options import Options, UsageError, clamp_max_word, parse_number
from .render import to_json, to_text
from .sources import binary_text, column_text, line_text

__all__ = [
    "Options", "UsageError", "binary_text", "checksum", "clamp_max_word", "column_text", "counts",
    "line_text", "parse_number", "report", "to_json", "to_text", "top_words", "totals",
]
