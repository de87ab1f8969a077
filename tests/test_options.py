import subprocess
import sys

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tallyweave.__main__ import main
from tallyweave.options import Options, UsageError, clamp_max_word, parse_args, parse_number


@pytest.mark.parametrize(
    "args",
    [["--top", "3", "f", "--max-word=5"], ["f", "--max-word", "5", "--top=3"], ["--top=3", "--max-word=5", "f"]],
)
def test_both_styles(args):
    assert parse_args(args) == Options("f", top=3, max_word=5)


def test_defaults():
    assert parse_args(["f"]) == Options("f", top=10, max_word=1024)
    assert parse_args(["f", "--max-word", "0", "--json", "--bench-runs=0"]) == Options("f", max_word=64, json=True)


@pytest.mark.parametrize("args", [[], ["a", "b"], ["--top", "0", "f"], ["--top", "x", "f"], ["--top"], ["--top=", "f"], ["--what", "f"], ["--json=x", "f"], ["--top=99999999999999999999", "f"], ["--top=2147483648", "f"], ["--top=+5", "f"]])
def test_usage_errors(args):
    with pytest.raises(UsageError):
        parse_args(args)
    assert main(args) == 2


def test_source_lines(spark, tmp_path, capsys):
    (tmp_path / "f").write_bytes(b"b a\nB\xff\n")
    assert main(["--source=lines", "--json", str(tmp_path / "f")]) == 0
    assert capsys.readouterr().out == '{"total":3,"unique":2,"top":[{"word":"b","count":2},{"word":"a","count":1}]}\n'


def test_output_that_cannot_be_written():
    code = "import sys; from tallyweave.__main__ import written; sys.exit(written('x' * 9))"
    with open("/dev/full", "w") as full:
        done = subprocess.run([sys.executable, "-c", code], stdout=full, stderr=subprocess.PIPE, text=True)
    assert done.returncode == 1 and "cannot write" in done.stderr


def test_missing_file(spark, tmp_path):
    assert main([str(tmp_path / "none")]) == 1


@given(st.integers(0, 10**6))
def test_clamp(n):
    assert clamp_max_word(n) == (64 if n == 0 else min(max(n, 4), 1024)) == clamp_max_word(clamp_max_word(n))


@given(st.text(max_size=25))
def test_numbers(text):
    try:
        n = parse_number(text)
    except UsageError:
        n = None
    fits = text != "" and all(c in "0123456789" for c in text) and int(text) < 2**63
    assert n == (int(text) if fits else None)
