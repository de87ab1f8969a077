"""Command line: ``python -m tallyweave [--json] [--top N] [--max-word N] FILE``.

Status 2 for a usage error, 1 for a file that cannot be read or output that cannot be
written, 0 otherwise.
"""

from __future__ import annotations

import json
import os
import sys

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from .operators import checksum, report, words
from .options import Options, UsageError, parse_args
from .render import to_json, to_text
from .sources import binary_text, line_text
from .timing import timed

USAGE = "usage: tallyweave [--json] [--top N] [--max-word N] [--bench-runs N] [--bench-warmups N] [--source=binary|lines] FILE"


def run(spark: SparkSession, options: Options) -> str:
    """What the command prints.  Timed runs win over ``--json``."""
    read = line_text if options.source == "lines" else binary_text
    made = lambda: report(words(read(spark, options.path), max_word=options.max_word), options.top)
    if options.bench_runs:
        return json.dumps(timed(lambda: checksum(made()), options.bench_runs, options.bench_warmups), separators=(",", ":"))
    return (to_json if options.json else to_text)(made()).first()[0]


def main(args: list[str]) -> int:
    try:
        options = parse_args(args)
    except UsageError as e:
        print(f"{e}\n{USAGE}", file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("tallyweave").config("spark.ui.enabled", "false").getOrCreate()
    try:
        said = run(spark, options)
    except PySparkException as e:
        print(f"cannot read {options.path}: {e.getCondition() or type(e).__name__}", file=sys.stderr)
        return 1
    except Py4JError as e:
        print(f"cannot read {options.path}: {type(e).__name__}", file=sys.stderr)
        return 1
    return written(said)


def written(text: str) -> int:
    """K5: print a text; 1 if it cannot be written to the end."""
    try:
        print(text, flush=True)
    except OSError as e:
        print(f"cannot write: {e.strerror}", file=sys.stderr)
        # What is left in the buffer is not tried again when Python ends.
        os.dup2(os.open(os.devnull, os.O_WRONLY), sys.stdout.fileno())
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
