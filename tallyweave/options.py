"""Options and their text forms."""

from __future__ import annotations

from dataclasses import dataclass, replace

#: Fixed values of the contract.
DEFAULT_TOP, DEFAULT_MAX_WORD, ZERO_MAX_WORD, LEAST_MAX_WORD, MOST_MAX_WORD = 10, 1024, 64, 4, 1024
MOST_NUMBER = 2**63 - 1
#: Entries of a ranking, at most.
MOST_TOP = 2**31 - 1


class UsageError(ValueError):
    """A command line that the contract rejects; exit status 2."""


@dataclass(frozen=True)
class Options:
    path: str
    top: int = DEFAULT_TOP
    max_word: int = DEFAULT_MAX_WORD
    json: bool = False
    bench_runs: int = 0
    bench_warmups: int = 0
    source: str = "binary"


def clamp_max_word(n: int) -> int:
    """0 means 64; all else is held between 4 and 1024."""
    return ZERO_MAX_WORD if n == 0 else max(LEAST_MAX_WORD, min(MOST_MAX_WORD, n))


def parse_number(text: str) -> int:
    """Decimal digits only; a number that does not fit is rejected."""
    if not text or not text.isascii() or not text.isdigit():
        raise UsageError(f"not a number: {text!r}")
    if (n := int(text)) > MOST_NUMBER:
        raise UsageError(f"number too large: {text}")
    return n


#: Option names and the fields they set.
NUMBERS = {"--top": "top", "--max-word": "max_word", "--bench-runs": "bench_runs", "--bench-warmups": "bench_warmups"}


def parse_args(args: list[str]) -> Options:
    """Options in either style, ``--top N`` or ``--top=N``, before or after the one operand."""
    found, rest = Options(path=""), list(args)
    operands: list[str] = []
    while rest:
        arg = rest.pop(0)
        name, eq, value = arg.partition("=")
        if name in NUMBERS:
            if not eq:
                if not rest:
                    raise UsageError(f"{name} needs a value")
                value = rest.pop(0)
            found = replace(found, **{NUMBERS[name]: parse_number(value)})
        elif arg == "--json":
            found = replace(found, json=True)
        elif arg in ("--source=binary", "--source=lines"):
            found = replace(found, source=value)
        elif arg.startswith("--"):
            raise UsageError(f"unknown option: {arg}")
        else:
            operands.append(arg)
    if len(operands) != 1:
        raise UsageError("exactly one file is needed")
    if found.top < 1:
        raise UsageError("--top must be positive")
    if found.top > MOST_TOP:
        raise UsageError(f"--top is at most {MOST_TOP}")
    return replace(found, path=operands[0], max_word=clamp_max_word(found.max_word))
