"""All generated corpora and edge cases against the golden results of FIXTURES.md."""

import re
from pathlib import Path

import pytest

from tallyweave import Options, binary_text, checksum, line_text, report, to_json, to_text
from tallyweave.__main__ import run
from tallyweave.operators import words
from tallyweave.options import clamp_max_word
from tallyweave.sources import CASES, CORPORA, corpus, generated, write_corpus
from tallyweave.timing import fold_runs

CONTENT = {name: data for name, data, *_ in CASES}
FIXTURES = Path(__file__).resolve().parents[1] / "FIXTURES.md"


def goldens():
    """name -> bytes, top, max_word, total, unique, checksum, run checksum x1, x10."""
    found = {}
    for line in FIXTURES.read_text().splitlines():
        cells = [c.strip() for c in line.strip("| ").split("|")]
        if len(cells) == 10 and (m := re.fullmatch(r"`([a-z-]+)`", cells[0])):
            found[m[1]] = tuple(int(x) for x in cells[1:6] + cells[7:])
    return found


GOLDENS = goldens()
JSON = dict(line.split("\t") for line in FIXTURES.read_text().splitlines() if "\t{" in line)


def content(name):
    return corpus(name) if name in CORPORA else CONTENT[name]


def test_all_are_there():
    assert GOLDENS.keys() == CORPORA.keys() | CONTENT.keys()


@pytest.mark.parametrize("name", sorted(GOLDENS))
def test_golden(spark, tmp_path, name):
    size, top, max_word, total, unique, check, once, ten = GOLDENS[name]
    data = content(name)
    assert len(data) == size
    path = write_corpus(tmp_path, name, data)
    for read in (binary_text, line_text):
        made = report(words(read(spark, path), max_word=max_word), top)
        row = made.first()
        assert (row["total"], row["unique"], len(row["top"])) == (total, unique, min(unique, top))
        assert checksum(made).first()["checksum"] == check
        if name in JSON:
            assert to_json(made).first()["json"] == JSON[name]
    assert (fold_runs([check]), fold_runs([check] * 10)) == (once, ten)


@pytest.mark.parametrize("name", sorted(CORPORA))
def test_generated_in_tasks(spark, name):
    """Words of a corpus from a frame equal those of the driver's."""
    rows = generated(spark, CORPORA[name][0], 300).orderBy("i").collect()
    assert corpus(name).decode().startswith("".join(r["text"] for r in rows))


def test_text_of_nothing(spark, tmp_path):
    path = write_corpus(tmp_path, "empty", b"")
    assert to_text(report(words(binary_text(spark, path)))).first()["text"] == "count word\ntotal 0\nunique 0"


def test_bytes_that_are_no_text(spark, tmp_path):
    path = write_corpus(tmp_path, "malformed", bytes.fromhex("e2616220f0616263") + " \u212a \u0130x".encode())
    row = report(words(binary_text(spark, path)), 10).first()
    assert [(e["word"], e["count"]) for e in row["top"]] == [("ab", 1), ("abc", 1), ("x", 1)]


def test_command_output(spark, tmp_path):
    path = write_corpus(tmp_path, "t", CONTENT["top-limit"])
    assert run(spark, Options(path, top=3, json=True)) == JSON["top-limit"]
    assert run(spark, Options(path, top=1)) == "count word\n3 a\ntotal 10\nunique 5"
    assert '"checksum":3994777682' in run(spark, Options(path, top=3, bench_runs=1, json=True))
    assert clamp_max_word(0) == 64
