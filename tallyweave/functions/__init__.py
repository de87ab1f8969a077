"""Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..options import LEAST_MAX_WORD, MOST_MAX_WORD, ZERO_MAX_WORD

#: A word before it is lower-cased and cut.
RUN = "[A-Za-z]+"

# Fixed values of the 32-bit hash.
FNV_START, FNV_PRIME, MASK = 2166136261, 16777619, 4294967295


def has_letter(text: Column) -> Column:
    """Whether any ASCII letter occurs."""
    return text.rlike("[A-Za-z]")


def runs(text: Column) -> Column:
    """The maximal runs of letters, as an array."""
    return F.regexp_extract_all(text, F.lit(RUN), F.lit(0))


def normal(run: Column, max_word: int) -> Column:
    """A run cut to ``max_word`` letters, then lower-cased.

    Lower-casing comes after splitting: Unicode's lower would make letters of
    characters that separate.
    """
    return F.lower(F.substring(run, 1, max_word))


def clamp_column(n: Column) -> Column:
    """P7 over a column."""
    held = F.least(F.lit(MOST_MAX_WORD), F.greatest(F.lit(LEAST_MAX_WORD), n))
    return F.when(n.isNotNull(), F.when(n == 0, F.lit(ZERO_MAX_WORD)).otherwise(held))


def number_column(text: Column) -> Column:
    """P8 over a column: digits only, null where the text is no number or does not fit."""
    return F.when(text.rlike("^[0-9]+$"), text.try_cast("bigint"))


def after_prefix(text: Column, prefix: str) -> Column:
    """What follows a prefix, null where it is absent."""
    return F.when(text.startswith(prefix), F.substring(text, len(prefix) + 1, 2**31 - 1))


def word_bytes(word: Column) -> Column:
    """The bytes of an ASCII word."""
    return F.transform(F.filter(F.split(word, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("bigint"))


def little_endian(n: Column, width: int = 8) -> Column:
    """The bytes of an integer, the least significant first."""
    return F.array(*[F.shiftright(n, 8 * k).bitwiseAND(F.lit(255).cast("bigint")) for k in range(width)])


def fnv(bytes_: Column) -> Column:
    """The 32-bit FNV-1a fold of an array of bytes."""
    step = lambda h, b: (h.bitwiseXOR(b) * F.lit(FNV_PRIME)).bitwiseAND(F.lit(MASK))
    return F.aggregate(bytes_, F.lit(FNV_START).cast("bigint"), step)


def result_checksum(total: Column, unique: Column, top: Column) -> Column:
    """A5: the hash over total, unique, and word and count of every shown entry."""
    entries = F.flatten(F.transform(top, lambda e: F.concat(word_bytes(e["word"]), little_endian(e["count"]))))
    return fnv(F.concat(little_endian(total), little_endian(unique), entries))


def run_checksum(checksum: Column, runs_: int) -> Column:
    """A checksum's four bytes, folded once for each run."""
    return fnv(F.flatten(F.array_repeat(little_endian(checksum, 4), runs_)))


def adjusted(total_ms: Column, startup_ms: Column) -> Column:
    """A10: time without start-up, 0 at least."""
    return F.greatest(F.lit(0.0), total_ms - startup_ms)


def throughput(size: Column, ms: Column) -> Column:
    """MiB a second with one decimal; ``inf`` for no time."""
    return F.when(ms == 0, F.lit("inf")).otherwise(F.format_string("%.1f", size / F.lit(1048576.0) / (ms / F.lit(1000.0))))
