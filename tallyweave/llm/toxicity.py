"""Toxicity (operator 7).

A bidirectional gated recurrent network with attention pooling reads the words of
overlapping windows.  Each word comes in as an embedding of its hash and one of
its characters: the mean over its hashed character trigrams.  Each window has a
score, and the document's is that of its highest window.  The network is trained
in numpy by backpropagation through time on a bounded sample of labelled
documents: each pass scores all windows of them, and of each document the highest
window learns.

Defined results: null and empty texts, and texts of white space, have one window
of no words, whose score is that of a window with nothing in it.  Labels that are
null, or belong to no document, are ignored.  Without labels of both kinds every
score is the labels' mean, or 0.  Texts of any length are scored whole.  Equal texts
get equal scores but for the rounding of sums in 32 bits, which may differ with the
texts beside them.  Repeated rows each get a row, an empty table none.  Only the
named columns are read, so other columns never clash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import grouped_by_bytes, held_out, spread, table, text_bytes
from .gru import Adam, backward, forward, glorot, sigmoid, softmax
from .hashing import LOWER, mix, span_hashes, word_spans

#: Labelled documents of each kind that are learned from, at most.
SAMPLE = 1500

#: Words of a window and between the starts of two.
WINDOW, STRIDE = 128, 96

#: Hash buckets of words and of trigrams; width of embeddings; state of each direction.
WORDS, TRIGRAMS, WIDTH, HIDDEN = 1 << 14, 1 << 12, 8, 8

#: Training: updates, documents in a batch, rate, share of word and of character inputs that are left out.
UPDATES, BATCH, RATE, DROP = 600, 24, 0.01, 0.25

#: Words of fewer sampled documents come in by their characters only.
LEAST_DOCUMENTS = 5

#: Windows that a worker takes at a time; bytes of text that it takes from Arrow at a time.
AT_ONCE, BATCH_BYTES = 1024, 1 << 20

_TRIM = np.ones(256, bool)  # bytes that count in a word: letters, digits, all beyond ASCII
_TRIM[:128] = [chr(b).isalnum() for b in range(128)]


@dataclass
class Words:
    """Distinct words of a batch: their buckets, and the trigrams' buckets with their weights."""

    bucket: np.ndarray
    trigram: np.ndarray
    owner: np.ndarray
    weight: np.ndarray


def words_of(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, Words]:
    """The number of every word among the distinct words, its row, and the distinct words.

    Signs around a word are cut off; a word of signs only stays as it is.
    """
    starts, ends, rows = word_spans(raw, at)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, rows, Words(none, none, none, np.zeros(0, np.float32))
    solid = np.flatnonzero(_TRIM[raw])
    first = np.searchsorted(solid, starts)
    last = np.searchsorted(solid, ends) - 1
    bare = first <= last
    if len(solid):
        starts = np.where(bare, solid[np.minimum(first, len(solid) - 1)], starts)
        ends = np.where(bare, solid[np.maximum(last, 0)] + 1, ends)
    hashes = span_hashes(raw, starts, ends)
    found, one, number = np.unique(hashes, return_index=True, return_inverse=True)
    low = LOWER[raw].astype(np.int64)
    s, e = starts[one], ends[one]
    # Trigrams of the word between two marks: as many as it has bytes.
    size = e - s
    owner = np.repeat(np.arange(len(found)), size)
    place = np.repeat(s, size) + np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
    before = np.where(place > np.repeat(s, size), low[np.maximum(place - 1, 0)], 256)
    after = np.where(place + 1 < np.repeat(e, size), low[np.minimum(place + 1, len(low) - 1)], 256)
    trigram = mix(((before << 18) | (low[place] << 9) | after).astype(np.uint64)) % np.uint64(TRIGRAMS)
    return number, rows, Words((found % np.uint64(WORDS)).astype(np.int64), trigram.astype(np.int64), owner, (1 / size[owner]).astype(np.float32))


def windows_of(rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All overlapping windows of texts of which each word's row is given: place of the first word, words and row of each.

    A text without words has one empty window.
    """
    count = np.bincount(rows, minlength=n)
    first = np.cumsum(count) - count
    windows = 1 + np.maximum(0, -(-(count - WINDOW) // STRIDE))
    of = np.repeat(np.arange(n), windows)
    start = (np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)) * STRIDE
    return first[of] + start, np.minimum(WINDOW, count[of] - start), of


@dataclass
class ToxicityModel:
    params: dict[str, np.ndarray]
    constant: float | None = None

    def embed(self, words: Words) -> np.ndarray:
        """Embeddings of the distinct words, word and characters side by side, and a row of zeros."""
        p = self.params
        chars = np.zeros((len(words.bucket) + 1, WIDTH), np.float32)
        if len(words.owner):
            chars[:-1] = np.add.reduceat(p["trigram"][words.trigram] * words.weight[:, None], np.flatnonzero(np.r_[True, np.diff(words.owner) > 0]))
        own = np.zeros_like(chars)
        own[:-1] = p["word"][words.bucket] * p["known"][words.bucket, None]
        return np.hstack((own, chars))

    def run(self, x: np.ndarray, sizes: np.ndarray, keep: bool = False):
        """Scores (logits) of windows from the input gates' source x (T, 2 WIDTH, B)."""
        p = self.params
        zero = np.zeros((HIDDEN, x.shape[2]), np.float32)
        gates_f = np.matmul(p["in_f"], x) + p["gate_f"]
        gates_b = np.matmul(p["in_b"], x[::-1]) + p["gate_b"]
        ahead = forward(gates_f, p["rec_f"], p["bias_f"], zero, keep)
        back = forward(gates_b, p["rec_b"], p["bias_b"], zero, keep)
        states_f, states_b = (ahead[0], back[0]) if keep else (ahead, back)
        h = np.concatenate((states_f[1:], states_b[:0:-1]), axis=1)
        u = np.tanh(np.matmul(p["att"], h) + p["att_bias"])
        e = np.einsum("k,tkb->tb", p["att_out"][:, 0], u)
        e[np.arange(len(e))[:, None] >= np.maximum(sizes, 1)] = -1e9
        a = softmax(e, axis=0)
        pooled = np.einsum("tb,thb->hb", a, h)
        logit = (p["out"].T @ pooled)[0] + p["out_bias"][0]
        return (logit, ahead, back, h, u, a, pooled) if keep else logit

    def scores(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The highest window's probability of each text."""
        n = len(at) - 1
        if self.constant is not None:
            return np.full(n, self.constant)
        number, rows, words = words_of(raw, at)
        embedded = self.embed(words)
        first, sizes, of = windows_of(rows, n)
        best = np.full(n, -np.inf)
        np.maximum.at(best, of, self.windows(number, embedded, first, sizes))
        return sigmoid(best)

    def windows(self, number: np.ndarray, embedded: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The logit of each window, as of ``windows_of``."""
        parts = [slice(k, k + AT_ONCE) for k in range(0, len(first), AT_ONCE)]
        return np.concatenate([np.zeros(0, np.float32), *(self.run(_source(number, embedded, first[p], sizes[p]), sizes[p]) for p in parts)])


def _picked(number: np.ndarray, empty: int, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Numbers of the words of windows, as columns; ``empty`` beyond their words."""
    place = first + np.arange(WINDOW)[:, None]
    inside = np.arange(WINDOW)[:, None] < sizes
    return np.where(inside, number[np.minimum(place, max(0, len(number) - 1))], empty) if len(number) else np.full(place.shape, empty)


def _source(number, embedded, first, sizes) -> np.ndarray:
    return np.ascontiguousarray(embedded[_picked(number, len(embedded) - 1, first, sizes)].transpose(0, 2, 1))


def new_params(rng: np.random.Generator) -> dict[str, np.ndarray]:
    h, zeros = HIDDEN, lambda *s: np.zeros(s, np.float32)
    return {
        "known": np.zeros(WORDS, np.float32), "word": (rng.normal(size=(WORDS, WIDTH)) * 0.1).astype(np.float32), "trigram": (rng.normal(size=(TRIGRAMS, WIDTH)) * 0.3).astype(np.float32),
        "in_f": glorot(rng, 3 * h, 2 * WIDTH), "in_b": glorot(rng, 3 * h, 2 * WIDTH), "gate_f": zeros(3 * h, 1), "gate_b": zeros(3 * h, 1),
        "rec_f": glorot(rng, 3 * h, h), "rec_b": glorot(rng, 3 * h, h), "bias_f": zeros(h, 1), "bias_b": zeros(h, 1),
        "att": glorot(rng, h, 2 * h), "att_bias": zeros(h, 1), "att_out": glorot(rng, h, 1), "out": glorot(rng, 2 * h, 1), "out_bias": zeros(1),
    }


def gradients(model: ToxicityModel, words: Words, picked: np.ndarray, sizes: np.ndarray, target: np.ndarray, weight: np.ndarray, drop: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the weighted log loss over windows; ``drop``: factors of the inputs (T, 2, B)."""
    p, h = model.params, HIDDEN
    drop = np.repeat(drop, WIDTH, axis=1)
    x = np.ascontiguousarray(model.embed(words)[picked].transpose(0, 2, 1)) * drop
    logit, ahead, back, states, u, a, pooled = model.run(x, sizes, keep=True)
    d = (sigmoid(logit.copy()) - target) * weight
    d = d.astype(np.float32)
    grads = {"out": (pooled @ d)[:, None], "out_bias": d.sum(keepdims=True)}
    d_pooled = p["out"] * d
    d_a = np.einsum("thb,hb->tb", states, d_pooled)
    d_e = a * (d_a - (a * d_a).sum(0))
    d_u = p["att_out"][:, 0][None, :, None] * d_e[:, None] * (1 - u * u)
    grads["att_out"] = np.einsum("tb,tkb->k", d_e, u)[:, None]
    grads["att"] = np.tensordot(d_u, states, axes=((0, 2), (0, 2)))
    grads["att_bias"] = d_u.sum((0, 2))[:, None]
    d_h = a[:, None] * d_pooled + np.matmul(p["att"].T, d_u)
    d_x = np.zeros_like(x)
    for name, (st, kept), part, turn in (("f", ahead, d_h[:, :h], False), ("b", back, d_h[::-1, h:], True)):
        d_in, grads[f"rec_{name}"], grads[f"bias_{name}"] = backward(np.ascontiguousarray(part), st, kept, p[f"rec_{name}"])
        seen = x[::-1] if turn else x
        grads[f"in_{name}"] = np.tensordot(d_in, seen, axes=((0, 2), (0, 2)))
        grads[f"gate_{name}"] = d_in.sum((0, 2))[:, None]
        back_in = np.matmul(p[f"in_{name}"].T, d_in)
        d_x += back_in[::-1] if turn else back_in
    d_x *= drop
    d_word = np.zeros((len(words.bucket) + 1, 2 * WIDTH), np.float32)
    np.add.at(d_word, picked.ravel(), d_x.transpose(0, 2, 1).reshape(-1, 2 * WIDTH))
    grads["word"], grads["trigram"] = np.zeros_like(p["word"]), np.zeros_like(p["trigram"])
    np.add.at(grads["word"], words.bucket, d_word[:-1, :WIDTH] * p["known"][words.bucket, None])
    np.add.at(grads["trigram"], words.trigram, d_word[words.owner, WIDTH:] * words.weight[:, None])
    return grads


def train(raw: np.ndarray, at: np.ndarray, y: np.ndarray, updates: int = UPDATES, seed: int = 3) -> ToxicityModel:
    """A model of texts with labels; of each text's windows, the one that now scores highest learns."""
    rng = np.random.default_rng(seed)
    model = ToxicityModel(new_params(rng))
    adam = Adam(model.params, RATE)
    number, rows, words = words_of(raw, at)
    first, sizes, of = windows_of(rows, len(y))
    if len(number):
        pairs = np.unique(rows * len(words.bucket) + number) % len(words.bucket)
        model.params["known"][words.bucket[np.bincount(pairs, minlength=len(words.bucket)) >= LEAST_DOCUMENTS]] = 1
    # Both kinds weigh alike while the network finds its words; then as they come, so that scores are probabilities.
    share = max(y.mean(), 1e-6)
    each = -(-len(y) // BATCH)
    passes = max(2, updates // each)
    last = np.append(np.flatnonzero(np.diff(of)), len(of) - 1)
    for turn in range(passes):
        # All windows of all documents are scored once a pass; each document's highest one learns.
        high = np.lexsort((model.windows(number, model.embed(words), first, sizes), of))[last]
        order = rng.permutation(len(y))
        for k in range(0, len(order), BATCH):
            docs = order[k : k + BATCH]
            use = high[docs]
            # Only the batch's own words get gradients.
            picked = _picked(number, len(words.bucket), first[use], sizes[use])
            some, local = np.unique(np.append(picked.ravel(), len(words.bucket)), return_inverse=True)
            kept = np.isin(words.owner, some)
            place = np.searchsorted(some, words.owner[kept])
            small = Words(words.bucket[some[:-1]], words.trigram[kept], place, words.weight[kept])
            t = y[docs].astype(np.float32)
            w = np.where(t == 1, 0.5 / share, 0.5 / (1 - share)) if turn < passes // 2 else np.ones(len(t))
            drop = (rng.random((WINDOW, 2, len(docs))) >= DROP).astype(np.float32)
            adam.update(gradients(model, small, local[:-1].reshape(picked.shape), sizes[use], t, w / len(docs), drop), RATE * min(1.0, 2 * (1 - turn / passes)))
    return model


def fit_toxicity(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> ToxicityModel:
    """A model of labelled rows where ``learn`` holds, an expression over the id.

    The sample: of each kind the labelled documents whose ids have the least
    hashes, ``sample`` at most; whole texts of them.
    """
    known = labels.where(learn).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("id").isNotNull())
    known = known.groupBy("id").agg(F.max("y").alias("y"))
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    if len(counts) < 2:
        return ToxicityModel({}, float(next(iter(counts), 0)))
    u = F.xxhash64("id", F.lit(13))
    picked = known.where("y = 0").orderBy(u, "id").limit(sample).unionByName(known.where("y = 1").orderBy(u, "id").limit(sample))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body")).join(F.broadcast(picked), "id")
    got = rows.select("id", "y", F.sha1("body").alias("h"), "body").toArrow().sort_by([("id", "ascending"), ("h", "ascending")])
    if not got.num_rows:
        return ToxicityModel({}, 0.0)
    y = np.asarray(got.column("y"))
    model = train(*text_bytes(got.column("body").combine_chunks()), y)
    # The sample has its own share of toxic rows; the last bias moves to that of all labels.
    odds = lambda s: np.log(s / (1 - s))
    total = counts[0] + counts[1]
    model.params["out_bias"] += np.float32(odds(counts[1] / total) - odds(np.clip(y.mean(), 1e-6, 1 - 1e-6)))
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``score`` of every row; all windows of every text are scored."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("body"))
    kind = dict(rows.dtypes)["id"]

    def run(batches):
        for batch in grouped_by_bytes(batches, 1, BATCH_BYTES):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(*text_bytes(batch.column(1))), pa.float64())], ["id", "score"])

    return rows.mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents."""
    held = held_out("doc_id", 3, 1)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"), ~held)
    out = score_toxicity(spread(docs), model)
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


QUERIES = {"op7_toxicity": op7_toxicity}
