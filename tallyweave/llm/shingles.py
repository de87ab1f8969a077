"""Sets of hashed word shingles, size bands, segment keys and bitmaps (for operator 6).

Two sets link when 100 * common >= PERCENT * union.  Linked sets of sizes a <= b
have b <= a * 100 / PERCENT, and differ in few elements: at most k.  A band holds
sizes within that ratio, so a linked pair lies in one band or in two neighbours.
For each band all elements are dealt by hash into n > k segments; each different
element spoils one segment, so linked sets agree on n - k segments at least.  A
segment's key is a hash of the elements that a set has in it.

Agreeing on empty segments means nothing, so empty segments have keys only in
sets with so many of them that no others might be left to agree on.  If a linked
pair agrees on empty segments only, both are such sets.  No link is lost.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from .hashing import mix, shingle_hashes, span_hashes, word_spans

#: Words of a shingle; least similarity in hundredths.
WORDS, PERCENT = 5, 80

#: Bits of a set's bitmap: the power of two that is so many times its size or more, and so many at least.
BITS, LEAST_BITS = 2, 256


def sets_of(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, one text after the other, and each text's end among them.

    ``raw``, ``at`` as of ``common.text_bytes``.
    """
    n = len(at) - 1
    starts, ends, rows = word_spans(raw, at)
    hashes, of = shingle_hashes(span_hashes(raw, starts, ends), rows, np.bincount(rows, minlength=n), WORDS)
    if not len(hashes):
        return hashes, np.zeros(n + 1, np.int64)
    order = np.lexsort((hashes, of))
    hashes, of = hashes[order], of[order]
    first = np.r_[True, (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1])]
    return hashes[first], np.r_[0, np.cumsum(np.bincount(of[first], minlength=n))]


def set_keys(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One 64-bit key for each set, as a signed number; sets with equal keys are taken as equal."""
    sums = np.r_[np.uint64(0), np.cumsum(mix(hashes + np.uint64(0x9E3779B97F4A7C15)))]
    return mix(sums[at[1:]] - sums[at[:-1]] + np.diff(at).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)


@lru_cache(maxsize=1)
def bands() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least size, differences k (-1 for none) and segments n of each band."""
    low, k, n = [], [], []
    lo = 1
    while lo < 2**40:
        hi = lo * 100 // PERCENT
        most = (hi + hi * 100 // PERCENT) * (100 - PERCENT) // (100 + PERCENT)
        segments = most + 1
        while True:
            empty = segments * np.exp(-lo / segments)
            more = most + 1 + int(np.ceil(empty + 3 * np.sqrt(empty)))
            if more <= segments or segments > 2 * most + 8:
                break
            segments = more
        low.append(lo)
        k.append(most if most else -1)
        n.append(segments)
        lo = hi + 1
    return np.array(low), np.array(k), np.array(n)


def segment_keys(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All segment keys of all sets, for each set's band and the band below, and their sets.

    Bands whose linked sets can only be equal have no keys.
    """
    low, most, segments = bands()
    sizes = np.diff(at)
    own = np.searchsorted(low, sizes, side="right") - 1
    where = (hashes >> np.uint64(32)).astype(np.int64)
    value = mix(hashes ^ np.uint64(0xA0761D6478BD642F))
    keys, owners = [], []
    for below in (0, 1):
        band = own - below
        # A set has partners in the band below if any size that it may link with lies there.
        use = (sizes > 0) & (band >= 0) & (most[np.maximum(band, 0)] >= 0)
        if below:
            use &= (sizes * PERCENT + 99) // 100 < low[np.maximum(own, 0)]
        rows = np.flatnonzero(use)
        if not len(rows):
            continue
        band = band[rows]
        count = segments[band]
        base = np.r_[0, np.cumsum(count)]
        taken = np.concatenate([np.arange(at[r], at[r + 1]) for r in rows]) if len(rows) < len(sizes) else np.arange(len(hashes))
        reps = sizes[rows]
        cell = np.repeat(base[:-1], reps) + where[taken] % np.repeat(count, reps)
        total = np.zeros(base[-1], np.uint64)
        np.add.at(total, cell, value[taken])
        filled = np.bincount(cell, minlength=base[-1])
        owner = np.repeat(rows, count)
        segment = np.arange(base[-1]) - np.repeat(base[:-1], count)
        name = (np.repeat(band, count).astype(np.uint64) << np.uint64(40)) + segment.astype(np.uint64)
        empties = np.add.reduceat(filled == 0, base[:-1])
        bare = count - empties <= most[band]
        emit = (filled > 0) | np.repeat(bare, count)
        keys.append(mix(total + mix(name + np.uint64(1)))[emit])
        owners.append(owner[emit])
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(keys).view(np.int64), np.concatenate(owners)


def bitmaps(hashes: np.ndarray, at: np.ndarray) -> list[bytes]:
    """A bitmap for each set; a larger set has a longer one."""
    sizes = np.diff(at)
    width = np.maximum(LEAST_BITS, 1 << np.ceil(np.log2(np.maximum(BITS * sizes, 1))).astype(np.int64))
    base = np.r_[0, np.cumsum(width)]
    out = np.zeros(base[-1], np.uint8)
    out[np.repeat(base[:-1], sizes) + (hashes & (np.repeat(width, sizes) - 1).astype(np.uint64)).astype(np.int64)] = 1
    packed = np.packbits(out, bitorder="little").tobytes()
    ends = (base // 8).tolist()
    return [packed[a:b] for a, b in zip(ends, ends[1:])]


def folded(raw: list[bytes]) -> np.ndarray:
    """Bitmaps as rows of 64-bit numbers, the longer ones folded to the shortest one's length."""
    width = min(map(len, raw)) // 8
    return np.stack([np.bitwise_or.reduce(np.frombuffer(b, np.uint64).reshape(-1, width), axis=0) for b in raw])


def overlap_bound(one: np.ndarray, size: int, many: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The most elements that a set can share with each of others, by bits.

    A bit that only one side has stands for an element that the other lacks, at least one.
    """
    only = np.bitwise_count(one & ~many).sum(axis=1, dtype=np.int64)
    theirs = np.bitwise_count(many & ~one).sum(axis=1, dtype=np.int64)
    return np.minimum(size - only, sizes - theirs)


def enough(common, a, b):
    """Whether so many common elements link sets of sizes a and b."""
    return (100 + PERCENT) * common >= PERCENT * (a + b)
