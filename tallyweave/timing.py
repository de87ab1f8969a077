"""Timed runs of a report."""

from __future__ import annotations

import time
from collections.abc import Callable
from math import ceil

from pyspark.sql import DataFrame

from .functions import FNV_PRIME, FNV_START, MASK


def fold_runs(checksums: list[int]) -> int:
    """A6 on the driver: four bytes of each run's checksum."""
    h = FNV_START
    for c in checksums:
        for b in c.to_bytes(4, "little"):
            h = (h ^ b) * FNV_PRIME & MASK
    return h


def percentile(samples: list[float], q: float) -> float:
    """A8 on the driver: nearest rank, lower middle."""
    ordered = sorted(samples)
    return ordered[max(0, ceil(q * len(ordered)) - 1)]


def timed(make: Callable[[], DataFrame], runs: int, warmups: int) -> dict:
    """Mean time and folded checksum of ``make().first()``.

    Each run builds a new frame: a frame that ran keeps its shuffle files.
    """
    for _ in range(warmups):
        make().first()
    spent, seen = 0.0, []
    for _ in range(runs):
        began = time.perf_counter()
        seen.append(make().first()["checksum"])
        spent += time.perf_counter() - began
    return {"mean_ms": spent * 1000 / runs, "checksum": fold_runs(seen)}
