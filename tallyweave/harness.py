"""Validates every reader on every case and times them: ``python -m tallyweave.harness``.

A plain counter on the driver is the oracle.  Options come from the command line
or, as defaults, from the environment: ``--max-word=5`` or
``TALLYWEAVE_MAX_WORD=5``.
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time
from collections import Counter
from collections.abc import Mapping
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .operators import checksum, report, words
from .options import MOST_TOP, UsageError, clamp_max_word, parse_number
from .render import to_json, to_markdown
from .sources import CASES, CORPORA, binary_text, corpus, line_text, write_corpus
from .timing import fold_runs, percentile, timed

READERS = {"binary": binary_text, "lines": line_text}
#: Corpora that are timed unless others are named.
DEFAULT = ("tiny-mix", "small-mix", "medium-mix", "unique-sort", "case-fold-mix")
PRIMARY = "medium-mix"


@dataclass
class Settings:
    corpus: str = "default"  # default, stress or a name
    fixture: str = ""  # a file in place of corpora
    top: int = 10
    max_word: int = 1024
    samples: int = 5
    runs: int = 10
    warmups: int = 3
    validate: bool = False


def parse_settings(args: list[str], environment: Mapping[str, str]) -> Settings:
    found = Settings()
    given = [("--" + k.removeprefix("TALLYWEAVE_").lower().replace("_", "-"), v) for k, v in environment.items() if k.startswith("TALLYWEAVE_")]
    for name, value in given + [tuple(a.split("=", 1)) if "=" in a else (a, None) for a in args]:
        field = name.removeprefix("--").replace("-", "_")
        if name == "--validate" and value is None:
            found.validate = True
        elif not name.startswith("--") or value is None or field not in vars(found) or field == "validate":
            raise UsageError(f"unknown option: {name}")
        else:
            setattr(found, field, value if field in ("corpus", "fixture") else parse_number(value))
    if found.top > MOST_TOP:
        raise UsageError(f"top is at most {MOST_TOP}")
    if min(found.top, found.samples, found.runs) < 1:
        raise UsageError("top, samples and runs must be positive")
    if found.corpus not in ("default", "stress", *CORPORA):
        raise UsageError(f"no such corpus: {found.corpus}")
    return found


def plain_report(data: bytes, top: int, max_word: int) -> str:
    """The oracle: a report's JSON by a dictionary."""
    n = clamp_max_word(max_word)
    counted = Counter(w[:n].lower().decode() for w in re.findall(rb"[A-Za-z]+", data))
    first = sorted(counted.items(), key=lambda e: (-e[1], e[0]))[:top]
    shown = [{"word": w, "count": c} for w, c in first]
    return json.dumps({"total": sum(counted.values()), "unique": len(counted), "top": shown}, separators=(",", ":"))


def made(spark: SparkSession, reader: str, path: str, top: int, max_word: int) -> DataFrame:
    return report(words(READERS[reader](spark, path), max_word=max_word), top)


def fixtures(settings: Settings, folder: str) -> list[tuple[str, str, bytes, int, int]]:
    """Name, path, bytes, top and max_word of what is validated and timed."""
    if settings.fixture:
        path = Path(settings.fixture).resolve()
        return [(path.name, str(path), path.read_bytes(), settings.top, settings.max_word)]
    names = DEFAULT if settings.corpus == "default" else tuple(CORPORA) if settings.corpus == "stress" else (settings.corpus,)
    data = {n: corpus(n) for n in names}
    return [(n, write_corpus(folder, n, d), d, settings.top, settings.max_word) for n, d in data.items()]


def validate(spark: SparkSession, cases: list[tuple[str, str, bytes, int, int]]) -> list[str]:
    """Readers and cases, each with each, whose report differs from the oracle's."""
    return [
        f"{reader}: {name}"
        for reader in READERS
        for name, path, data, top, max_word in cases
        if to_json(made(spark, reader, path, top, max_word)).first()["json"] != plain_report(data, top, max_word)
    ]


def summary(spark: SparkSession, settings: Settings, timed_cases) -> str:
    """Median and worst of the samples, and MiB a second on the primary corpus, best first."""
    rows = []
    for reader in READERS:
        cells, primary = [reader], float("inf")
        for name, path, data, top, max_word in timed_cases:
            make = lambda: checksum(made(spark, reader, path, top, max_word))  # noqa: B023, E731
            want = fold_runs([make().first()["checksum"]] * settings.runs)
            samples = [timed(make, settings.runs, settings.warmups) for _ in range(settings.samples)]
            if any(s["checksum"] != want for s in samples):
                raise RuntimeError(f"checksums of {reader} on {name} differ")
            ms = [s["mean_ms"] for s in samples]
            middle = percentile(ms, 0.5)
            cells += [f"{middle:.1f}", f"{max(ms):.1f}", f"{len(data) / 2**20 / (middle / 1000):.2f}"]
            if name == PRIMARY or len(timed_cases) == 1:
                primary = middle
        rows.append((primary, cells))
    header = ["reader", *[f"{name} {what}" for name, *_ in timed_cases for what in ("median ms", "worst ms", "MiB/s")]]
    return to_markdown(header, [cells for _, cells in sorted(rows, key=lambda r: r[0])])


def main(args: list[str]) -> int:
    try:
        settings = parse_settings(args, os.environ)
    except UsageError as e:
        print(e, file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("tallyweave-harness").config("spark.ui.enabled", "false").getOrCreate()
    with tempfile.TemporaryDirectory() as folder:
        own = fixtures(settings, folder)
        edge = [(n, write_corpus(folder, f"case-{n}", d), d, top, m) for n, d, top, m, _ in CASES]
        began = time.perf_counter()
        if wrong := validate(spark, own + edge):
            print("\n".join(wrong), file=sys.stderr)
            return 1
        print(f"{len(READERS) * len(own + edge)} reports equal the oracle's ({time.perf_counter() - began:.1f} s)")
        if not settings.validate:
            print(summary(spark, settings, own))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
