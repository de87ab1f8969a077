"""Where text comes from (S1 to S6).  Every source gives a frame with a column ``text``."""

from .corpora import CASES, CORPORA, PROFILES, corpus, generated, write_corpus
from .readers import binary_text, bytes_text, column_text, line_text, sizes, spread

__all__ = ["CASES", "CORPORA", "PROFILES", "binary_text", "bytes_text", "column_text", "corpus", "generated", "line_text", "sizes", "spread", "write_corpus"]
