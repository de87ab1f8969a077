"""Quality classifier (operator 2).

Statistics of every whole document are computed once.  Random Fourier features
of them approximate a Gaussian kernel; every partition sums its normal
equations, the sums are added, and ridge scores follow.  Isotonic regression on
a part of the training rows that the equations do not see calibrates them.

Defined results: null and empty texts have the statistics of no words and get a
score like any other; texts of any length are read whole.  Labels that are null, or
belong to no document, are ignored; several labels of a document all count.  Without
labels of both kinds every score is the labels' mean, or 0.5.  Repeated rows each get
a row; equal texts get equal scores but for the rounding of sums.  An empty table
gives no rows.  Only the named columns are read, so other columns never clash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filter_texts, grouped_by_bytes, held_out, planned_parts, spread, table, text_bytes, written
from .hashing import span_hashes, word_spans

#: Random Fourier features, ridge weight for each training row, and bins of the calibration.
FEATURES, RIDGE, BINS = 256, 1e-4, 512

#: Partial sums that reach the driver, at most, and that one task adds up, about.
SUMS, FAN_IN = 16, 64

#: Every so many-th training row calibrates.
CALIBRATES = 4

#: Bytes of text that a worker takes at a time.
BATCH_BYTES = 1 << 20

NAMES = (
    "log_bytes", "letters", "upper", "digits", "spaces", "lines", "stops", "commas", "pipes", "exclaims", "symbols", "beyond_ascii",
    "word_bytes", "capitalised", "no_letter", "same_as_last", "distinct", "distinct_lines",
)

# Kinds of bytes: 0 lower-case letter, 1 upper-case, 2 digit, 3 space, 4 line break, 5 stop, 6 comma, 7 pipe, 8 exclamation, 9 other symbol, 10 beyond ASCII.
_KINDS = 11
_KIND = np.full(256, 9, np.int64)
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 0, 1, 2, 10
_KIND[[9, 11, 12, 32]] = 3
_KIND[[10, 13]] = 4
for _c, _k in ((".", 5), (",", 6), ("|", 7), ("!", 8)):
    _KIND[ord(_c)] = _k


def _per(rows: np.ndarray, n: int, weights=None) -> np.ndarray:
    return np.bincount(rows, weights, n).astype(np.float64)


def _distinct(rows: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """Distinct hashes of each row; rows come in order."""
    if not len(rows):
        return np.zeros(n)
    order = np.lexsort((hashes, rows))
    h, r = hashes[order], rows[order]
    return _per(r[np.r_[True, (h[1:] != h[:-1]) | (r[1:] != r[:-1])]], n)


def statistics(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Statistics of texts, as of ``common.text_bytes``: one row for each, columns as in NAMES."""
    n = len(at) - 1
    size = np.diff(at).astype(np.float64)
    owner = np.repeat(np.arange(n), np.diff(at))
    kinds = np.bincount(owner * _KINDS + _KIND[raw], minlength=n * _KINDS).reshape(n, _KINDS).astype(np.float64)
    share = kinds / np.maximum(size, 1)[:, None]
    starts, ends, rows = word_spans(raw, at)
    words = _per(rows, n)
    each = np.maximum(words, 1)
    hashes = span_hashes(raw, starts, ends)
    again = (hashes[1:] == hashes[:-1]) & (rows[1:] == rows[:-1]) if len(hashes) else np.zeros(0, bool)
    first = _KIND[raw[starts]]
    letter = np.concatenate(([0], np.cumsum(np.isin(_KIND[raw], (0, 1, 10)))))
    bare = letter[ends] == letter[starts]
    breaks = np.flatnonzero(raw == 10)
    line_starts = np.unique(np.concatenate((at[:-1][size > 0], breaks + 1))) if n else np.zeros(0, np.int64)
    line_starts = line_starts[line_starts < len(raw)]
    line_ends = np.append(line_starts[1:], len(raw))
    line_rows = np.searchsorted(at, line_starts, side="right") - 1
    line_ends = np.minimum(line_ends, at[line_rows + 1]) if len(line_rows) else line_ends
    lines = np.maximum(_per(line_rows, n), 1)
    ratio = lambda x: x / each
    return np.column_stack((
        np.log1p(size), share[:, 0] + share[:, 1], kinds[:, 1] / np.maximum(kinds[:, 0] + kinds[:, 1], 1), share[:, 2], share[:, 3], share[:, 4],
        share[:, 5], share[:, 6], share[:, 7], share[:, 8], share[:, 9], share[:, 10],
        ratio(size - kinds[:, 3] - kinds[:, 4]), ratio(_per(rows[first == 1], n)), ratio(_per(rows[bare], n)), ratio(_per(rows[1:][again], n)),
        ratio(_distinct(rows, hashes, n)), _distinct(line_rows, span_hashes(raw, line_starts, line_ends), n) / lines,
    )).astype(np.float32)


def document_statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``x``, an array of the statistics in NAMES, of every row."""
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body"))
    kind, width = dict(rows.dtypes)["id"], len(NAMES)

    def run(batches):
        for batch in grouped_by_bytes(batches, 1, BATCH_BYTES):
            x = statistics(*text_bytes(batch.column(1)))
            ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * width)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(x.ravel()))], ["id", "x"])

    return rows.mapInArrow(run, f"id {kind}, x array<float>").withColumnRenamed("id", id_col)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, width) if len(column) else np.zeros((0, width))


def partition_sums(df: DataFrame, of, shape: tuple[int, ...]) -> np.ndarray:
    """The sum over all batches of what ``of`` gives for one, as an array of a fixed shape.

    Each task adds up its batches.  Tasks add up about FAN_IN of these sums each, in
    as many levels as the table's size asks for; SUMS of them reach the driver.
    """

    def run(batches):
        total = np.zeros(shape)
        for batch in batches:
            total += of(batch)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["k", "v"])

    def add(groups):
        total, k = np.zeros(shape), None
        for batch in groups:
            k = batch.column(0)[0].as_py() if batch.num_rows else k
            for v in batch.column(1).to_pylist():
                total += np.frombuffer(v).reshape(shape)
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["k", "v"])

    sums = df.mapInArrow(run, "k int, v binary")
    for n in levels(planned_parts(df)):
        sums = sums.select((F.col("k") % n).alias("k"), "v").groupBy("k").applyInArrow(lambda t: _one(add, t), "k int, v binary")
    return sum((np.frombuffer(r["v"]).reshape(shape) for r in sums.collect()), np.zeros(shape))


def levels(parts: int) -> list[int]:
    """Sums of each level that adds up those of so many parts; the last has SUMS."""
    found = []
    while (parts := parts // FAN_IN) > SUMS:
        found.append(parts)
    return [*found, SUMS]


def _one(add, t: pa.Table) -> pa.Table:
    return pa.Table.from_batches(list(add(t.to_batches())))


def isotonic(value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the rising values nearest to the given ones."""
    blocks: list[list[float]] = []
    for v, w in zip(value, weight):
        blocks.append([v * w, w, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, w, k = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + w, blocks[-1][2] + k]
    return np.concatenate([np.full(int(k), s / w) for s, w, k in blocks]) if blocks else np.zeros(0)


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    at: np.ndarray  # ridge scores of the calibration's points, rising
    to: np.ndarray  # probabilities there, rising

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.column_stack((np.cos(z @ self.directions + self.phases) * np.sqrt(2 / len(self.phases)), np.ones(len(x))))

    def ridge(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.ridge(x), self.at, self.to), 0, 1)


def fit_quality(rows: DataFrame, features: int = FEATURES, ridge: float = RIDGE, seed: int = 11) -> QualityModel:
    """A model from rows ``x`` (statistics), ``y`` (0 or 1) and ``part`` (0: calibrates)."""
    d, rng = len(NAMES), np.random.default_rng(seed)

    def moments(batch):
        x = _matrix(batch.column(0), d)
        y = np.asarray(batch.column(1), np.float64)
        return np.vstack((x.sum(0), (x**2).sum(0), np.r_[len(x), y.sum(), np.zeros(d - 2)]))

    total = partition_sums(rows.select("x", F.col("y").cast("double")), moments, (3, d))
    n, positive = total[2, :2]
    mean = total[0] / max(n, 1)
    scale = np.sqrt(np.maximum(total[1] / max(n, 1) - mean**2, 1e-8))
    model = QualityModel(mean, scale, rng.normal(size=(d, features)) / np.sqrt(d), rng.uniform(0, 2 * np.pi, features), np.zeros(features + 1), np.zeros(1), np.full(1, positive / n if n else 0.5))
    if not 0 < positive < n:
        return model

    def equations(batch):
        z = model.features(_matrix(batch.column(0), d))
        return np.column_stack((z.T @ z, z.T @ np.asarray(batch.column(1), np.float64)))

    fits = rows.where("part <> 0").select("x", F.col("y").cast("double"))
    sums = partition_sums(fits, equations, (features + 1, features + 2))
    model.weights = np.linalg.solve(sums[:, :-1] + (ridge * n + 1e-6) * np.eye(features + 1), sums[:, -1])

    def histogram(batch):
        s = np.clip((model.ridge(_matrix(batch.column(0), d)) + 0.5) / 2 * BINS, 0, BINS - 1).astype(int)
        return np.column_stack((np.bincount(s, minlength=BINS), np.bincount(s, np.asarray(batch.column(1), np.float64), BINS)))

    held = partition_sums(rows.where("part = 0").select("x", F.col("y").cast("double")), histogram, (BINS, 2))
    has = np.flatnonzero(held[:, 0])
    if len(has):
        model.at = (has + 0.5) / BINS * 2 - 0.5
        rising = isotonic(held[has, 1] / held[has, 0], held[has, 0])
        # One row more, of the labels' mean, keeps a level of few rows from certainty.
        level = np.cumsum(np.r_[0, np.diff(rising) > 0])
        weight = np.bincount(level, held[has, 0])[level]
        model.to = isotonic((rising * weight + positive / n) / (weight + 1), held[has, 0])
    return model


def score_quality(stats: DataFrame, model: QualityModel, id_col: str = "doc_id") -> DataFrame:
    """``id_col`` and ``score`` of every row of ``document_statistics``."""
    kind = dict(stats.dtypes)[id_col]

    def run(batches):
        for batch in batches:
            s = model.score(_matrix(batch.column(1), len(NAMES)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s)], ["id", "score"])

    return stats.select(F.col(id_col).alias("id"), "x").mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)


def learned(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> tuple[QualityModel, DataFrame]:
    """A model, and the statistics of all rows of ``docs``.

    Learns from labels of the rows where ``learn`` holds, an expression over the id.
    """
    stats = written(document_statistics(spread(docs.select(id_col, text_col)), id_col, text_col), "quality-statistics")
    known = labels.select(F.col(id_col), F.col(label_col).cast("int").alias("y")).where(F.col("y").isin(0, 1))
    rows = stats.where(learn).join(known, id_col).select("x", "y", F.pmod(F.xxhash64(id_col), F.lit(CALIBRATES)).alias("part"))
    return fit_quality(written(rows, "quality-training")), stats


def keep_quality(docs: DataFrame, model: QualityModel, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, that score ``least`` or more."""
    return filter_texts(docs, text_col, lambda texts: model.score(statistics(*text_bytes(texts))) >= least, BATCH_BYTES)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents."""
    held = held_out("doc_id", 3, 1)
    model, stats = learned(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held)
    out = score_quality(stats, model)
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op2_quality": op2_quality}
