"""Text forms of reports (K1, K2, K7)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_json(reported: DataFrame) -> DataFrame:
    """K1: compact JSON with the keys in the contract's order."""
    return reported.select(F.to_json(F.struct("total", "unique", "top")).alias("json"))


def to_text(reported: DataFrame) -> DataFrame:
    """K2: header, entries, total and unique, a line each."""
    lines = F.transform("top", lambda e: F.concat(e["count"].cast("string"), F.lit(" "), e["word"]))
    last = F.array(F.concat(F.lit("total "), F.col("total").cast("string")), F.concat(F.lit("unique "), F.col("unique").cast("string")))
    return reported.select(F.concat_ws("\n", F.array(F.lit("count word")), lines, last).alias("text"))


def to_markdown(header: list[str], rows: list[list]) -> str:
    """K7: a Markdown table of a short list."""
    line = lambda cells: "| " + " | ".join(map(str, cells)) + " |"
    return "\n".join([line(header), line(["---"] * len(header)), *map(line, rows)])
