"""Words of many texts at once, in numpy: where they are and 64-bit hashes of them.

A word is a maximal run of bytes other than space and 9 to 13.  Hashes are of the
word with A-Z lower-cased: a polynomial of random values of its bytes, of which
prefix sums give every word's share, then mixed with the word's length.
"""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(20240607)
_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))

#: A byte's lower-case form, ASCII letters only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_LOWER_VALUE = _VALUE[LOWER]
#: Bytes that are part of words.
IN_WORD = np.ones(256, bool)
IN_WORD[[9, 10, 11, 12, 13, 32]] = False

_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n of them."""
    if not _powers or len(_powers["up"]) < n:
        n = max(n, 1 << 20)
        for name, x in (("up", _BASE), ("down", _INVERSE)):
            p = np.full(n, x, np.uint64)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads each bit of a 64-bit number over all bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_spans(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row of every word; ``raw``, ``at`` as of ``common.text_bytes``."""
    if not len(raw):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = np.concatenate((np.zeros(1, bool), IN_WORD[raw], np.zeros(1, bool)))
    first = np.zeros(len(raw) + 1, bool)
    first[at] = True  # a text's first byte, or the end of all
    here, before = inside[1:], inside[:-1]
    starts = np.flatnonzero(here[:-1] & (~before[:-1] | first[:-1]))
    ends = np.flatnonzero(before & (~here | first))
    rows = np.searchsorted(at, starts, side="right") - 1
    return starts, ends, rows


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A hash of the bytes of each span."""
    up, down = _power(len(raw) + 1)
    sums = np.empty(len(raw) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((_LOWER_VALUE if lower else _VALUE)[raw] * up[: len(raw)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingle_hashes(hashes: np.ndarray, rows: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every ``size`` words in a row, and their rows.

    ``counts``: words of each row.  A row with fewer words, but any, has one
    hash of all its words.
    """
    n = len(hashes)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    up, _ = _power(size + 1)
    total = np.zeros(max(0, n - size + 1), np.uint64)
    for k in range(size):
        total += hashes[k : k + len(total)] * up[size - k]
    whole = rows[: len(total)] == rows[size - 1 :] if len(total) else np.zeros(0, bool)
    out, of = mix(total[whole] + np.uint64(size)), rows[: len(total)][whole]
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        first = np.concatenate(([0], np.cumsum(counts)))[short]
        extra = np.zeros(len(short), np.uint64)
        for k in range(size - 1):
            has = counts[short] > k
            extra[has] = extra[has] * _BASE + hashes[first[has] + k]
        out = np.concatenate((out, mix(extra + counts[short].astype(np.uint64))))
        of = np.concatenate((of, short))
        order = np.argsort(of, kind="stable")
        out, of = out[order], of[order]
    return out, of
