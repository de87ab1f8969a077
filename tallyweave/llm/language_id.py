"""Language identification (operator 4).

A bidirectional gated recurrent network reads bytes in windows that overlap, labels
every position with the probabilities of the languages, in the window that has it
away from the borders, and a document's probabilities are the mean over all its
positions.  It is trained in numpy by backpropagation
through time, on windows of a bounded sample of documents with a language; every
language that a document to learn from has is learned.

Defined results: a text that is null or has no letter is ``und`` with score 0,
whatever the network says; a text of any length is read whole.  Rows without a
language are not learned from.  If no row has one, every text is ``und``.  Of equal
probabilities the first language by name counts.  Repeated rows each get a row; equal
texts get equal results but for the rounding of sums in 32 bits.  An empty table
gives no rows.  Only the named columns are read, so other columns never clash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filter_texts, grouped_by_bytes, held_out, spread, table, text_bytes
from .gru import Adam, backward, forward, glorot, softmax
from .hashing import mix, span_hashes

#: Documents of each language that are learned from, at most, and windows of all of them: any windows of theirs, wherever they are.
SAMPLE, SAMPLE_WINDOWS = 1000, 16_000

#: Bytes of a window that are labelled, bytes before and after them that are read too, state of each direction.
WINDOW, CONTEXT, HIDDEN = 96, 16, 8

#: Training: steps, windows in a batch, rate.
STEPS, BATCH, RATE = 400, 192, 0.02

#: Windows that a worker takes at a time; bytes of text that it takes from Arrow at a time.
AT_ONCE, BATCH_BYTES = 1024, 1 << 20

#: Score below which a filter takes a text to be in no language.
ACCEPTED = 0.3

UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")


@dataclass
class LanguageModel:
    names: list[str]
    params: dict[str, np.ndarray]

    def positions(self, windows: np.ndarray) -> np.ndarray:
        """Probabilities of the languages at every position: (T, languages, windows) for bytes (T, windows)."""
        p = self.params
        zero = np.zeros((HIDDEN, windows.shape[1]), np.float32)
        ahead = forward(_inputs(p["in_f"], windows), p["rec_f"], p["bias_f"], zero)[1:]
        back = forward(_inputs(p["in_b"], windows[::-1]), p["rec_b"], p["bias_b"], zero)[:0:-1]
        logits = np.matmul(p["out_f"], ahead)
        logits += np.matmul(p["out_b"], back)
        logits += p["out_bias"]
        return softmax(logits, axis=1)

    def documents(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Mean probabilities over all positions of each text; zeros for empty texts."""
        windows, sizes, rows = cut(raw, at)
        total = np.zeros((len(at) - 1, len(self.names)))
        for k in range(0, windows.shape[1], AT_ONCE):
            part = slice(k, k + AT_ONCE)
            probs = self.positions(windows[:, part])
            probs = probs[CONTEXT : CONTEXT + WINDOW]
            probs *= (np.arange(WINDOW)[:, None] < sizes[part])[:, None]
            np.add.at(total, rows[part], probs.sum(0).T)
        return total / np.maximum(np.diff(at), 1)[:, None]


def _inputs(table_: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Input gates of bytes: a row of the table for each, as (T, 3H, B)."""
    return np.ascontiguousarray(table_[windows].transpose(0, 2, 1))


def cut(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts in windows of WINDOW bytes between CONTEXT bytes, as columns; bytes to label and text of each window.

    What is beyond a text's ends is zero.
    """
    size = np.diff(at)
    count = -(-size // WINDOW)
    rows = np.repeat(np.arange(len(size)), count)
    first = np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count)
    starts = at[:-1][rows] + first * WINDOW
    sizes = np.minimum(WINDOW, at[1:][rows] - starts)
    place = starts + np.arange(-CONTEXT, WINDOW + CONTEXT)[:, None]
    inside = (place >= at[:-1][rows]) & (place < at[1:][rows])
    windows = np.where(inside, raw[np.clip(place, 0, max(0, len(raw) - 1))] if len(raw) else 0, 0)
    return windows.astype(np.uint8), sizes, rows


def train(windows: np.ndarray, sizes: np.ndarray, labels: np.ndarray, names: list[str], steps: int = STEPS, seed: int = 5) -> LanguageModel:
    """Every position of a window learns the window's language."""
    rng = np.random.default_rng(seed)
    h, n = HIDDEN, len(names)
    params = {
        "in_f": glorot(rng, 256, 3 * h), "in_b": glorot(rng, 256, 3 * h), "rec_f": glorot(rng, 3 * h, h), "rec_b": glorot(rng, 3 * h, h),
        "bias_f": np.zeros((h, 1), np.float32), "bias_b": np.zeros((h, 1), np.float32),
        "out_f": glorot(rng, n, h), "out_b": glorot(rng, n, h), "out_bias": np.zeros((n, 1), np.float32),
    }
    adam = Adam(params, RATE)
    zero = np.zeros((h, BATCH), np.float32)
    by = [np.flatnonzero(labels == k) for k in range(n)]
    for step in range(steps):
        # Languages take turns, so that a rare one is learned as well as a frequent one.
        own = np.arange(BATCH) % n
        pick = np.array([rng.choice(by[k]) for k in own])
        x = windows[:, pick]
        mask = np.zeros((len(x), BATCH), np.float32)
        mask[CONTEXT : CONTEXT + WINDOW] = np.arange(WINDOW)[:, None] < sizes[pick]
        ahead, kept_f = forward(_inputs(params["in_f"], x), params["rec_f"], params["bias_f"], zero, keep=True)
        back, kept_b = forward(_inputs(params["in_b"], x[::-1]), params["rec_b"], params["bias_b"], zero, keep=True)
        turned = back[:0:-1]
        d = softmax(np.matmul(params["out_f"], ahead[1:]) + np.matmul(params["out_b"], turned) + params["out_bias"], axis=1)
        d[:, own, np.arange(BATCH)] -= 1
        d *= mask[:, None] / mask.sum()
        grads = {
            "out_f": np.tensordot(d, ahead[1:], axes=((0, 2), (0, 2))), "out_b": np.tensordot(d, turned, axes=((0, 2), (0, 2))), "out_bias": d.sum((0, 2))[:, None],
        }
        d_f = np.matmul(params["out_f"].T, d)
        d_b = np.ascontiguousarray(np.matmul(params["out_b"].T, d)[::-1])
        for name, dh, states, kept, seen in (("f", d_f, ahead, kept_f, x), ("b", d_b, back, kept_b, x[::-1])):
            d_in, grads[f"rec_{name}"], grads[f"bias_{name}"] = backward(dh, states, kept, params[f"rec_{name}"])
            flat = np.zeros((256, 3 * h), np.float32)
            np.add.at(flat, seen.ravel(), d_in.transpose(0, 2, 1).reshape(-1, 3 * h))
            grads[f"in_{name}"] = flat
        adam.update(grads, RATE * min(1.0, 2 * (1 - step / steps)))
    return LanguageModel(names, params)


def fit_language(docs: DataFrame, learn: Column, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample: int = SAMPLE) -> LanguageModel:
    """A model of the rows where ``learn`` holds and the language is not null.

    The sample: of each language the documents whose ids have the least hashes,
    ``sample`` at most; of all their windows SAMPLE_WINDOWS at most, those with the
    least hashes of text, id and place, about as many as the training draws.
    """
    known = docs.where(learn).where(F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"))
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return LanguageModel([], {})
    # Least hashes by language in one pass of partial sums: a threshold for each language that passes about twice the sample.
    spark = docs.sparkSession
    limit = spark.createDataFrame([(k, min(1.0, (2 * sample + 100) / n)) for k, n in sorted(counts.items())], "lang string, limit double")
    unit = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rows = docs.where(learn).select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("body"))
    rows = rows.select("id", "lang", "body", unit.alias("u")).join(F.broadcast(limit), "lang").where("u < limit")
    # What is drawn: documents by their hashes, repeated ids and null ids as one document each; of theirs a share of all windows.
    size = F.octet_length("body").alias("size")
    drawn = rows.groupBy("lang", "u").agg(F.sum(F.ceil(size / WINDOW)).alias("windows"), F.count("*").alias("rows")).toPandas().sort_values(["lang", "u"], kind="stable")
    shares = []
    for lang, own in drawn.groupby("lang", sort=True):
        own = own[own["rows"].cumsum() - own["rows"] < sample]
        shares.append((lang, float(own["u"].max()), min(1.0, 1.2 * SAMPLE_WINDOWS / max(1.0, float(own["windows"].sum())))))
    share = spark.createDataFrame(shares, "lang string, last double, share double")
    rows = rows.drop("limit").join(F.broadcast(share), "lang").where("u <= last").select("lang", "body", "u", "share")

    def run(batches):
        for batch in batches:
            for piece in grouped_by_bytes([batch], 1, BATCH_BYTES):
                raw, at = text_bytes(piece.column(1))
                windows, sizes, of = cut(raw, at)
                if not len(of):
                    continue
                place = np.arange(len(of)) - np.searchsorted(of, of)
                text = span_hashes(raw, at[:-1], at[1:], lower=False)
                u, share = np.asarray(piece.column(2)), np.asarray(piece.column(3))
                drawn = mix(text[of] + mix(u[of].view(np.uint64) + place.astype(np.uint64))) / 2.0**64
                take = np.flatnonzero(drawn < share[of])
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0).take(pa.array(of[take])), pa.array(drawn[take]), pa.array(sizes[take]), pa.array([windows[:, k].tobytes() for k in take], pa.binary())],
                    ["lang", "u", "size", "window"],
                )

    got = rows.mapInArrow(run, "lang string, u double, size long, window binary").toArrow().to_pandas().sort_values(["u", "window"], kind="stable")
    got = got.groupby("lang", sort=True).head(SAMPLE_WINDOWS)
    names = sorted(set(got["lang"]))
    if not names:
        return LanguageModel([], {})
    windows = np.frombuffer(b"".join(got["window"]), np.uint8).reshape(-1, WINDOW + 2 * CONTEXT).T
    return train(windows, got["size"].to_numpy(), got["lang"].map(names.index).to_numpy(), names)


def predict(texts: pa.Array, model: LanguageModel) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    found = np.array([bool(t and _LETTER.search(t)) for t in texts.to_pylist()], bool)
    if not model.names:
        return [UNKNOWN] * len(found), np.zeros(len(found))
    probs = model.documents(*text_bytes(texts))
    best = probs.argmax(1)
    names = [model.names[k] if x else UNKNOWN for k, x in zip(best, found)]
    return names, np.where(found, np.clip(probs[np.arange(len(best)), best], 0, 1), 0.0)


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``lang_pred`` and ``score`` of every row; all bytes of every text are read."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("body"))
    kind = dict(rows.dtypes)["id"]

    def run(batches):
        for batch in grouped_by_bytes(batches, 1, BATCH_BYTES):
            names, score = predict(batch.column(1), model)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(score)], ["id", "lang_pred", "score"])

    return rows.mapInArrow(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def keep_language(docs: DataFrame, model: LanguageModel, least: float = ACCEPTED, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose language is known with a score of ``least`` or more."""

    def keep(texts):
        names, score = predict(texts, model)
        return np.array([n != UNKNOWN for n in names], bool) & (score >= least)

    return filter_texts(docs, text_col, keep, BATCH_BYTES)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = held_out("doc_id", 4, 2)
    model = fit_language(docs, ~held)
    out = identify(spread(docs.select("doc_id", "text")), model)
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")


QUERIES = {"op4_language": op4_language}
