"""Generated corpora and literal edge cases.

The rules and sizes are the fixed values that FIXTURES.md records.
"""

from __future__ import annotations

from itertools import count
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Base words and the separators, in their order.
BASE = ("Alpha", "beta", "GAMMA", "delta", "epsilon", "zeta", "eta", "theta")
SEPARATORS = (" ", "\n", ",", "--", "123", "\t", "!!")

#: Profile and target size of each corpus.
CORPORA = {
    "tiny-mix": ("mixed", 4 << 10),
    "small-mix": ("mixed", 64 << 10),
    "medium-mix": ("mixed", 512 << 10),
    "unique-sort": ("unique", 512 << 10),
    "case-fold-mix": ("case-fold", 512 << 10),
    "repeated-scan": ("repeated", 1 << 20),
    "long-clamp": ("long", 256 << 10),
}

PROFILES = tuple(dict.fromkeys(profile for profile, _ in CORPORA.values()))


def synthetic(v: int) -> str:
    """Eight base-26 digits of v, the least significant first, then v mod 5 times x."""
    return "".join(chr(97 + v // 26**k % 26) for k in range(8)) + "x" * (v % 5)


def _cased(word: str, style: int) -> str:
    match style:
        case 0:
            return word.upper()
        case 1:
            return word.capitalize()
        case 2:
            return "".join(c.upper() if k % 2 == 0 else c for k, c in enumerate(word))
        case _:
            return word


def word(profile: str, i: int) -> str:
    """The i-th word of a profile."""
    base = BASE[i % 8]
    match profile:
        case "mixed":
            return base if i % 5 else synthetic(i)
        case "unique":
            return synthetic(i) + synthetic(i + 17)
        case "repeated":
            return base
        case "long":
            return base.lower() + synthetic(i) * 16
        case "case-fold":
            return _cased(synthetic(i // 4) if i % 6 else base.lower(), i % 4)
    raise ValueError(f"no such profile: {profile}")


def corpus(name: str) -> bytes:
    """The bytes of a generated corpus."""
    profile, target = CORPORA[name]
    parts, size = [], 0
    for i in count():
        if size >= target:
            break
        parts.append(word(profile, i) + SEPARATORS[i % 7])
        size += len(parts[-1])
    text = "".join(parts)
    return (text if text.endswith("\n") else text + "\n").encode("ascii")


def _synthetic_column(v: Column) -> Column:
    """``synthetic`` over a column."""
    digits = [F.chr(F.lit(97) + F.floor(v / F.lit(26**k)) % 26) for k in range(8)]
    return F.concat(*digits, F.repeat(F.lit("x"), (v % 5).cast("int")))


def generated(spark: SparkSession, profile: str, words: int) -> DataFrame:
    """S5 in tasks: the first so many words of a profile, each with its separator, as rows ``i, text`` of any number."""
    i = F.col("id")
    base = F.element_at(F.array(*map(F.lit, BASE)), (i % 8 + 1).cast("int"))
    match profile:
        case "mixed":
            made = F.when(i % 5 != 0, base).otherwise(_synthetic_column(i))
        case "unique":
            made = F.concat(_synthetic_column(i), _synthetic_column(i + 17))
        case "repeated":
            made = base
        case "long":
            made = F.concat(F.lower(base), F.repeat(_synthetic_column(i), F.lit(16)))
        case "case-fold":
            plain = F.when(i % 6 != 0, _synthetic_column(F.floor(i / 4))).otherwise(F.lower(base))
            mixed = F.array_join(F.transform(F.split(plain, ""), lambda c, k: F.when(k % 2 == 0, F.upper(c)).otherwise(c)), "")
            made = F.when(i % 4 == 0, F.upper(plain)).when(i % 4 == 1, F.initcap(plain)).when(i % 4 == 2, mixed).otherwise(plain)
        case _:
            raise ValueError(f"no such profile: {profile}")
    separator = F.element_at(F.array(*map(F.lit, SEPARATORS)), (i % 7 + 1).cast("int"))
    return spark.range(words).select(i.alias("i"), F.concat(made, separator).alias("text"))


def write_corpus(folder: str | Path, name: str, data: bytes) -> str:
    """Write bytes under a name and give the path."""
    path = Path(folder) / name
    path.write_bytes(data)
    return str(path)


#: Name, content, top, max_word and style of arguments of each edge case.
CASES = (
    ("empty", b"", 10, 1024, "separated"),
    ("separators", bytes([0, 9, 10, 32, 33, 45, 48, 57, 95, 255]), 10, 1024, "separated"),
    ("ascii-contract", b"Apple apple APPLE\nfoo-bar\n123abc456\nit's\nz b a\naaaaaaaaa aaaaaaaab aaaaaaaac\n", 20, 1024, "separated"),
    ("non-ascii-bytes", bytes([99, 97, 102, 195, 169, 32, 110, 97, 195, 175, 118, 101, 32, 0, 65, 90]), 10, 1024, "separated"),
    ("default-max-word", b"A" * 80 + b" " + b"a" * 64 + b" " + b"b" * 65 + b"\n", 10, 0, "separated"),
    ("min-word-clamp", b"alphabet alpha alphanumeric ALPHABET\n", 10, 1, "separated"),
    ("top-limit", b"b a c a b a d d d e\n", 3, 1024, "separated"),
    ("top-equals", b"b a c a b a d d d e\n", 3, 1024, "top-equals"),
    ("max-word-equals", b"alphabet abcde abcdef ABCDEF\n", 10, 5, "max-word-equals"),
    ("max-word-equals-default", b"A" * 80 + b" " + b"a" * 64 + b" " + b"b" * 65 + b"\n", 10, 0, "max-word-equals"),
    ("max-word-equals-min-clamp", b"alphabet alpha alphanumeric ALPHABET\n", 10, 1, "max-word-equals"),
    ("max-word-equals-max-clamp", b"A" * 1100 + b" " + b"a" * 1024 + b"\n", 10, 999999, "max-word-equals"),
)
