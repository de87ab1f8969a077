"""Language-model scores of whole documents (operator 5).

Tokens are the words of a text, A-Z lower-cased, and one end.  All training
tokens of all training documents are counted.  A gated recurrent network reads
the tokens in windows and carries its state from window to window, so a document
of any length has one log-likelihood.  The output is factored: first the token's
class, then the token within its class.

* A frequent word's class holds CLASS_WORDS words; the network tells them apart.
* All other words are in SHAPES classes by their last two bytes; within a class a
  word has (c + 0.5) / (N_class + 0.5 * (V_class + 1)) by its training count c.
* The end is a class of its own.

All training words are counted before the network is made: the head words are the
most frequent ones, and the network begins with the exact frequencies of classes
and head words.  It is trained in numpy by truncated backpropagation through time,
first on a bounded sample of training documents, which all tasks begin from, then
by every task on all of its training documents, whole; the tasks' weights are
averaged by their tokens.  Documents are read side by side in lanes, one after the
other in each, with a state of zeros at each one's beginning.  That first count
tells the counts of LISTED words; all others are counted through a shuffle by hash
when texts are scored.  Both counts are exact.

Defined results: null and empty texts have the end alone.  Without training
documents N is 0, V is 0, and the network is the untrained one.  Texts of any length
are scored whole.  Equal texts, repeated rows among them, get equal base scores, and
equal scores but for the rounding of sums in 32 bits.  An empty table gives no rows.
Only the named columns are read, so other columns never clash.
Words are told apart by 58 bits of a hash and 6 of their shape.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import grouped_by_bytes, held_out, spread, table, text_bytes, written
from .gru import Adam, backward, forward, glorot, softmax
from .hashing import LOWER, mix, span_hashes, word_spans
from .quality import partition_sums

#: Training documents of the sample, at most, and words of each that train the network's first weights, from places dealt over the text.
SAMPLE, SAMPLE_WORDS = 2400, 512

#: Words that are counted by number, at most.
LISTED = 1 << 16

#: Classes of frequent words, words of each, classes by shape.
CLASSES, CLASS_WORDS, SHAPES = 48, 48, 63

#: Width of the state; steps of a window; documents that are read side by side to train, and to score.
HIDDEN, WINDOW, SIDE, SCORED_SIDE = 24, 32, 192, 384

#: Training on the sample: updates, documents side by side, rate.
UPDATES, TRAIN_SIDE, RATE = 700, 64, 0.01

#: Rate of the training on all documents; tokens that a task gathers to deal them to lanes.
REST_RATE, LANED = 0.002, 3 << 19

#: Tokens whose probabilities are computed at a time; size of logits up to which exponentials need no care.
AT_ONCE, SAFE = 2048, 60

#: Bytes of text that a worker takes at a time; words that a task gathers before it deals them out.
BATCH_BYTES, GATHERED = 1 << 20, 1 << 20

#: Tasks that merge the parts' most frequent words.
MERGERS = 16

_HEAD = CLASSES * CLASS_WORDS
_END = _HEAD + SHAPES  # number of the end among the inputs: head words, shapes, end
_INPUTS = _END + 1
_OUTPUTS = CLASSES + SHAPES + 1
_TABLE_BITS = 20


def tokens_of(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, the shape in the lowest six bits, and their rows."""
    starts, ends, rows = word_spans(raw, at)
    if not len(starts):
        return np.zeros(0, np.uint64), rows
    last = LOWER[raw[ends - 1]].astype(np.uint64)
    before = np.where(ends - starts > 1, LOWER[raw[np.maximum(ends - 2, 0)]], 0).astype(np.uint64)
    shape = mix(last << np.uint64(8) | before) % np.uint64(SHAPES)
    return span_hashes(raw, starts, ends) & ~np.uint64(63) | shape, rows


@dataclass
class Listing:
    """Listed words by number; the first ``_HEAD`` numbers are the frequent ones."""

    hashes: np.ndarray
    place: np.ndarray  # number by the hash's first bits, or -1

    @classmethod
    def of(cls, hashes: np.ndarray) -> Listing:
        """From hashes, the most frequent first; of those with equal first bits only the first is listed."""
        at = (hashes >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)
        _, first = np.unique(at, return_index=True)
        kept = hashes[np.sort(first)]
        place = np.full(1 << _TABLE_BITS, -1, np.int32)
        place[(kept >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)] = np.arange(len(kept))
        return cls(kept, place)

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Each word's number, -1 for those not listed."""
        found = self.place[(hashes >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)]
        if len(self.hashes):
            found = np.where((found >= 0) & (self.hashes[np.maximum(found, 0)] == hashes), found, -1)
        return found


def inputs_of(numbers: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """What the network reads: a head word's number, or _HEAD + shape."""
    shape = (hashes & np.uint64(63)).astype(np.int32)
    return np.where((numbers >= 0) & (numbers < _HEAD), numbers, _HEAD + shape).astype(np.int32)


def _class_of(inputs: np.ndarray) -> np.ndarray:
    return np.where(inputs < _HEAD, inputs // CLASS_WORDS, inputs - _HEAD + CLASSES)


@dataclass
class LanguageModel:
    listing: Listing
    params: dict[str, np.ndarray]
    trained: int = 0  # tokens of whole documents that the tasks trained with
    counts: np.ndarray | None = None  # of the listed words and, last, of ends, in all training documents

    def gates(self, inputs: np.ndarray) -> np.ndarray:
        """Input gates of tokens (T, B)."""
        return np.ascontiguousarray(self.params["in"].take(inputs, 0).transpose(0, 2, 1))

    def bound(self) -> float:
        """What no logit's size exceeds: states are within -1 and 1."""
        p = self.params
        return float(max(np.abs(p[k]).sum(-1).max() + np.abs(p[f"{k}_bias"]).max() for k in ("class", "word")))

    def token_scores(self, states: np.ndarray, targets: np.ndarray, safe: bool = False) -> np.ndarray:
        """Natural log probability of each target's class, and for head words of the word in it: of states (H, n), fastest if they lie state by state.

        ``safe``: the logits are known to be small enough for their exponentials.
        """
        p, n = self.params, len(targets)
        kind = _class_of(targets)
        picked, total = np.empty(n, np.float32), np.empty(n, np.float32)
        buffer = np.empty((_OUTPUTS, min(n, AT_ONCE)), np.float32)
        for a in range(0, n, AT_ONCE):
            b = min(n, a + AT_ONCE)
            logits = buffer[:, : b - a] if b - a == buffer.shape[1] else np.empty((_OUTPUTS, b - a), np.float32)
            np.dot(p["class"], states[:, a:b], out=logits)
            logits += p["class_bias"]
            if not safe:
                logits -= logits.max(0)
            picked[a:b] = logits[kind[a:b], np.arange(b - a)]
            np.exp(logits, out=logits)
            np.dot(_ones(_OUTPUTS), logits, out=total[a:b])
        out = picked.astype(np.float64) - np.log(total)
        order = np.argsort(kind.astype(np.int16), kind="stable")
        ends = np.searchsorted(kind[order], np.arange(CLASSES + 1))
        order = order[: ends[-1]]
        now, word = states.T.take(order, 0), targets[order] % CLASS_WORDS
        of, total, one = picked[: len(order)], total[: len(order)], _ones(CLASS_WORDS)
        for k, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
            if a < b:
                z = p["word"][k] @ now[a:b].T
                z += p["word_bias"][k][:, None]
                if not safe:
                    z -= z.max(0)
                of[a:b] = z[word[a:b], np.arange(b - a)]
                np.exp(z, out=z)
                np.dot(one, z, out=total[a:b])
        out[order] += of - np.log(total)
        return out

    def documents(self, inputs: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Summed token scores of documents, whose tokens (ends included) lie one document after the other.

        Documents are read side by side in lanes, a window at a time; states are
        carried from window to window, and begin anew where a document does.
        """
        p, n = self.params, len(at) - 1
        total = np.zeros(n)
        safe = self.bound() < SAFE
        order, lane_at = lanes(np.diff(at), SCORED_SIDE)
        owner = np.repeat(order.astype(np.int32), np.diff(at)[order])
        for targets, inside, alive, state, last, place, done in windows(inputs, at, order, lane_at):
            states = forward(self.gates(np.vstack((last, targets[:-1]))), p["rec"], p["bias"], state, alive=alive)
            # A target is told by the state after the token before it.
            flat = states[1:].transpose(0, 2, 1).reshape(-1, HIDDEN)
            goal, whose = targets.ravel(), place.ravel()
            if not inside.all():
                some = np.flatnonzero(inside.ravel())
                flat, goal, whose = flat.take(some, 0), goal[some], whose[some]
            total += np.bincount(owner[whose], self.token_scores(flat.T, goal, safe), n)
            done(states[-1])
        return total


@lru_cache(maxsize=1024)
def _ones(n: int) -> np.ndarray:
    return np.ones(n, np.float32)


def lanes(sizes: np.ndarray, most: int, rng: np.random.Generator | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Documents dealt to ``most`` lanes of about the same number of tokens: their order, and where each lane begins, the longest first.

    ``rng``: deals the documents of a lane in any order, not by length.
    """
    n = min(most, len(sizes))
    heap = [(0, k) for k in range(n)]
    own: list[list[int]] = [[] for _ in range(n)]
    for doc in np.argsort(-sizes, kind="stable").tolist():
        load, k = heap[0]
        own[k].append(doc)
        heapq.heapreplace(heap, (load + int(sizes[doc]), k))
    loads = {k: load for load, k in heap}
    ranked = sorted(range(n), key=lambda k: -loads[k])
    if rng is not None:
        own = [rng.permutation(x).tolist() for x in own]
    order = np.array([doc for k in ranked for doc in own[k]], np.int64)
    return order, np.cumsum([0, *(loads[k] for k in ranked)])


def windows(inputs: np.ndarray, at: np.ndarray, order: np.ndarray, lane_at: np.ndarray):
    """Windows over lanes: targets (T, B), which are inside, where documents go on, states and tokens before, places in the lanes' order, and what takes the states after.

    Lanes that have ended go.
    """
    stream = np.concatenate([inputs[at[k] : at[k + 1]] for k in order.tolist()]) if len(order) else inputs[:0]
    goes_on = np.ones(len(stream), bool)
    sizes = np.diff(at)[order]
    goes_on[np.cumsum(sizes) - sizes] = False
    place, end = lane_at[:-1].copy(), lane_at[1:]
    state, last = np.zeros((HIDDEN, len(place)), np.float32), np.full(len(place), _END)
    steps = np.arange(WINDOW)[:, None]
    held = {}
    while len(place):
        # Lanes get shorter, so the last window is as long as the longest lane needs.
        where = place + steps[: min(WINDOW, int((end - place).max()))]
        inside = where < end
        where = np.minimum(where, len(stream) - 1)
        targets = np.where(inside, stream[where], _END)
        yield targets, inside, goes_on[where].astype(np.float32), state, last, where, lambda after: held.update(state=after)
        place = place + len(where)
        go = place < end
        state, last = np.ascontiguousarray(held["state"][:, go]), targets[-1][go]
        place, end = place[go], end[go]


def new_params(rng: np.random.Generator, counts: np.ndarray) -> dict[str, np.ndarray]:
    """First weights; the last biases are the frequencies of ``counts``, so the network begins as those."""
    h = HIDDEN
    classes = np.bincount(_class_of(np.arange(_INPUTS)), counts + 0.5, _OUTPUTS)
    return {
        "in": (rng.normal(size=(_INPUTS, 3 * h)) * 0.1).astype(np.float32), "rec": glorot(rng, 3 * h, h), "bias": np.zeros((h, 1), np.float32),
        "class": np.zeros((_OUTPUTS, h), np.float32), "class_bias": np.log(classes / classes.sum())[:, None].astype(np.float32),
        "word": np.zeros((CLASSES, CLASS_WORDS, h), np.float32), "word_bias": np.log(counts[:_HEAD] + 0.5).reshape(CLASSES, CLASS_WORDS).astype(np.float32),
    }


def _likelier(logits: np.ndarray, safe: bool) -> np.ndarray:
    """Probabilities of logits (n, tokens), in place."""
    if not safe:
        return softmax(logits, axis=0)
    np.exp(logits, out=logits)
    logits *= np.reciprocal(_ones(len(logits)) @ logits)
    return logits


def _update(
    model: LanguageModel, adam: Adam, targets: np.ndarray, mask: np.ndarray, state: np.ndarray, last: np.ndarray, rate: float, alive: np.ndarray | None = None
) -> np.ndarray:
    """One update from a window (T, B) of documents side by side; the states after it."""
    p, side = model.params, targets.shape[1]
    safe = model.bound() < SAFE
    seen = np.vstack((last, targets[:-1]))
    states, kept = forward(model.gates(seen), p["rec"], p["bias"], state, keep=True, alive=alive)
    some = np.flatnonzero(mask.ravel())
    # In the order of classes, so that each class's words are one run.
    goal = targets.ravel()[some]
    kind = _class_of(goal)
    by = np.argsort(kind.astype(np.int16), kind="stable")
    some, goal, kind = some[by], goal[by], kind[by]
    ends = np.searchsorted(kind, np.arange(CLASSES + 1)).tolist()
    # A row for each state, so that states are picked, put back and added up by whole rows.
    flat = states[1:].transpose(0, 2, 1).reshape(-1, HIDDEN).take(some, 0)
    weight = np.float32(1 / max(1, len(some)))
    grads = {"class": 0, "class_bias": 0, "word": np.zeros_like(p["word"]), "word_bias": np.zeros_like(p["word_bias"])}
    d_flat = np.empty_like(flat)
    for a in range(0, len(some), AT_ONCE):
        part = slice(a, a + AT_ONCE)
        now = flat[part]
        d = p["class"] @ now.T
        d += p["class_bias"]
        d = _likelier(d, safe)
        d[kind[part], np.arange(d.shape[1])] -= 1
        grads["class"] = grads["class"] + d @ now
        grads["class_bias"] = grads["class_bias"] + (d @ _ones(d.shape[1]))[:, None]
        np.dot(d.T, p["class"], out=d_flat[part])
    word, each = goal % CLASS_WORDS, np.arange(len(goal))
    for k, (a, b) in enumerate(zip(ends[:-1], ends[1:])):
        if a < b:
            now, own = flat[a:b], p["word"][k]
            e = own @ now.T
            e += p["word_bias"][k][:, None]
            e = _likelier(e, safe)
            e[word[a:b], each[: b - a]] -= 1
            np.dot(e, now, out=grads["word"][k])
            np.dot(e, _ones(b - a), out=grads["word_bias"][k])
            d_flat[a:b] += e.T @ own
    for k in ("class", "class_bias", "word", "word_bias"):
        grads[k] = grads[k] * weight
    d_flat *= weight
    d_all = np.zeros((mask.size, HIDDEN), np.float32)
    d_all[some] = d_flat
    d_states = np.ascontiguousarray(d_all.reshape(-1, side, HIDDEN).transpose(0, 2, 1))
    d_in, grads["rec"], grads["bias"] = backward(d_states, states, kept, p["rec"], alive)
    # Rows of one input are added up in the order of inputs.
    rows, inputs = d_in.transpose(0, 2, 1).reshape(-1, 3 * HIDDEN), seen.ravel()
    by = np.argsort(inputs.astype(np.int16), kind="stable")
    found, first = np.unique(inputs[by], return_index=True)
    grads["in"] = np.zeros_like(p["in"])
    grads["in"][found] = np.add.reduceat(rows.take(by, 0), first)
    adam.update(grads, rate)
    return states[-1].copy()


def train(listing: Listing, texts: list[np.ndarray], updates: int = UPDATES, seed: int = 17, counts: np.ndarray | None = None) -> LanguageModel:
    """A network of documents given as inputs, ends included; states are carried over the windows of a document.

    ``counts``: of all inputs, those of the texts if left out.
    """
    rng = np.random.default_rng(seed)
    if counts is None:
        counts = np.bincount(np.concatenate(texts), minlength=_INPUTS) if texts else np.zeros(_INPUTS)
    model = LanguageModel(listing, new_params(rng, counts))
    if not texts:
        return model
    adam = Adam(model.params, RATE)
    b = TRAIN_SIDE
    doc, place = rng.integers(0, len(texts), b), np.zeros(b, np.int64)
    state, last = np.zeros((HIDDEN, b), np.float32), np.full(b, _END)
    for update in range(updates):
        targets = np.full((WINDOW, b), _END)
        mask = np.zeros((WINDOW, b), bool)
        for k in range(b):
            part = texts[doc[k]][place[k] : place[k] + WINDOW]
            targets[: len(part), k], mask[: len(part), k] = part, True
        # The state goes on into the next window; who has ended makes room for another document.
        state = _update(model, adam, targets, mask, state, last, RATE * min(1.0, 2 * (1 - update / updates)))
        last, place = targets[-1].copy(), place + WINDOW
        over = np.flatnonzero([place[k] >= len(texts[doc[k]]) for k in range(b)])
        doc[over], place[over], last[over] = rng.integers(0, len(texts), len(over)), 0, _END
        state[:, over] = 0
    return model


def train_on(model: LanguageModel, texts, seed: int = 19) -> int:
    """Train the network once with every token of all documents, which come as ``train`` takes them; the number of tokens."""
    adam, rng, tokens = Adam(model.params, REST_RATE), np.random.default_rng(seed), 0

    def learn(own: list[np.ndarray]) -> int:
        inputs, at = np.concatenate(own), np.cumsum([0, *map(len, own)])
        for targets, inside, alive, state, last, _, done in windows(inputs, at, *lanes(np.diff(at), SIDE, rng)):
            # A window of few tokens, as at the end of a task, moves the weights less.
            done(_update(model, adam, targets, inside, state, last, REST_RATE * float(inside.sum()) / (WINDOW * SIDE), alive))
        return len(inputs)

    own, size = [], 0
    for text in texts:
        own.append(text)
        size += len(text)
        if size >= LANED:
            tokens += learn(own)
            own, size = [], 0
    return tokens + (learn(own) if own else 0)


def _flat(params: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([params[k].ravel() for k in sorted(params)]).astype(np.float64)


def _unflat(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    names = sorted(like)
    parts = np.split(flat, np.cumsum([like[k].size for k in names])[:-1])
    return {k: np.ascontiguousarray(x.reshape(like[k].shape), np.float32) for k, x in zip(names, parts)}


def _with_ends(listing: Listing, hashes: np.ndarray, of: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs of texts, ends included, where each text's end, and numbers of the words."""
    numbers = listing.numbers(hashes)
    ends = np.cumsum(np.bincount(of, minlength=rows) + 1)
    inputs = np.empty(len(hashes) + rows, np.int32)
    inputs[ends - 1] = _END
    inputs[np.arange(len(hashes)) + of] = inputs_of(numbers, hashes)
    return inputs, ends, numbers


def train_on_all(model: LanguageModel, bodies: DataFrame) -> LanguageModel:
    """The network after every task has trained it with all of its documents, averaged by the tasks' tokens."""
    size = len(_flat(model.params))
    held = bodies.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        begin = held.value
        own = LanguageModel(begin.listing, {k: v.copy() for k, v in begin.params.items()})

        def texts():
            for batch in grouped_by_bytes(batches, 0, BATCH_BYTES):
                inputs, ends, _ = _with_ends(own.listing, *tokens_of(*text_bytes(batch.column(0))), batch.num_rows)
                yield from np.split(inputs, ends[:-1])

        n = train_on(own, texts())
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([np.append(_flat(own.params) * n, n).tobytes()], pa.binary())], ["v"])

    def add(batch):
        return sum((np.frombuffer(v) for v in batch.column(0).to_pylist()), np.zeros(size + 1))

    total = partition_sums(bodies.mapInArrow(run, "v binary"), add, (size + 1,))
    held.unpersist()
    if not total[-1]:
        return model
    return LanguageModel(model.listing, _unflat(total[:-1] / total[-1], model.params), int(total[-1]))


def fit_language_model(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> LanguageModel:
    """A network and a listing from all training documents.

    The first weights are learned from the documents whose ids have the least hashes,
    ``sample`` of them at most.
    """
    bodies = spread(docs.select(id_col, text_col)).where(learn).select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body"))
    words, n, shapes = count_words(bodies)
    listing = Listing.of(words)
    # Exact counts of what the network reads: head words, all others by shape, ends.
    counts = np.zeros(_INPUTS)
    counts[_HEAD:_END] = shapes
    inputs = inputs_of(listing.numbers(words), words)
    head = inputs < _HEAD
    counts[inputs[head]] = n[head]
    counts[_HEAD:_END] -= np.bincount((words[head] & np.uint64(63)).astype(np.int64), n[head], SHAPES)
    counts[_END] = bodies.count()
    numbers = listing.numbers(words)
    listed = np.zeros(len(listing.hashes) + 1)
    listed[numbers[numbers >= 0]] = n[numbers >= 0]
    listed[-1] = counts[_END]
    u = F.xxhash64(F.col(id_col), F.lit(29))
    ids = docs.where(learn).select(F.col(id_col).alias("id")).where("id IS NOT NULL").distinct().select("id", F.xxhash64("id", F.lit(29)).alias("u")).orderBy("u", "id").limit(sample)
    rows = docs.where(learn).select(F.col(id_col).alias("id"), u.alias("u"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body")).join(F.broadcast(ids.select("id")), "id")

    def run(batches):
        for batch in grouped_by_bytes(batches, 2, BATCH_BYTES):
            hashes, of = tokens_of(*text_bytes(batch.column(2)))
            ends = np.searchsorted(of, np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([hashes[a:b].tobytes() for a, b in zip(ends, ends[1:])], pa.binary())], ["u", "v"])

    got = rows.select("id", "u", "body").mapInArrow(run, "u long, v binary").toArrow().sort_by([("u", "ascending"), ("v", "ascending")])
    texts = [np.frombuffer(v, np.uint64) for v in got.column("v").to_pylist()]
    own = []
    for t in texts:
        # A long text trains with one run of words, from a place that the text's own length deals.
        first = len(t) * 7919 % max(1, len(t) - SAMPLE_WORDS) if len(t) > SAMPLE_WORDS else 0
        part = t[first : first + SAMPLE_WORDS]
        own.append(np.append(inputs_of(listing.numbers(part), part), _END))
    model = train_on_all(train(listing, own, counts=counts), bodies)
    model.counts = listed
    return model


_COUNT = np.dtype([("word", np.uint64), ("n", np.int64)])
_ASK = np.dtype([("word", np.uint64), ("text", np.int64)])
_SUM = np.dtype([("text", np.int64), ("log", np.float64), ("known", np.int64), ("times", np.int64)])


def _dealt(kind: int, rows: np.ndarray, by: np.ndarray, parts: int) -> pa.RecordBatch:
    """Rows as blobs, one for each part."""
    part = (by.view(np.uint64) >> np.uint64(16)) % np.uint64(parts)
    order = np.argsort(part, kind="stable")
    rows, part = rows[order], part[order]
    found, at = np.unique(part, return_index=True)
    blobs = [x.tobytes() for x in np.split(rows, at[1:])] if len(found) else []
    return pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(np.full(len(found), kind, np.int32)), pa.array(blobs, pa.binary())], ["part", "kind", "blob"])


def count_words(bodies: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The most frequent words of the one column of texts, their counts, and the counts of all words by shape.

    Words are dealt by hash, so every part has exact counts; a part tells its most
    frequent words, more than there are head words, and MERGERS tasks merge those.
    """
    spark = bodies.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    most = max(2 * _HEAD, 4 * LISTED // parts)

    def run(batches):
        held, size = [], 0

        def merged():
            words, at = np.unique(np.concatenate([r["word"] for r in held]), return_inverse=True)
            return _counts(words, np.bincount(at, np.concatenate([r["n"] for r in held]), len(words)))

        for batch in batches:
            for piece in grouped_by_bytes([batch], 0, BATCH_BYTES):
                held.append(_counts(*np.unique(tokens_of(*text_bytes(piece.column(0)))[0], return_counts=True)))
                size += len(held[-1])
                if size > GATHERED:
                    held = [merged()]
                    size = len(held[0])
                    if size > GATHERED // 2:
                        yield _dealt(0, held[0], held[0]["word"], parts)
                        held, size = [], 0
        if held:
            rows = merged()
            yield _dealt(0, rows, rows["word"], parts)

    def told(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                held.setdefault(part, []).append(blob)
        for part in list(held):
            rows = np.frombuffer(b"".join(held.pop(part)), _COUNT)
            words, at = np.unique(rows["word"], return_inverse=True)
            rows = _counts(words, np.bincount(at, rows["n"], len(words)))
            shapes = np.bincount((words & np.uint64(63)).astype(np.int64), rows["n"], SHAPES)
            yield pa.RecordBatch.from_arrays([pa.array([part % MERGERS], pa.int32()), pa.array([_first(rows, most).tobytes()], pa.binary()), pa.array([shapes.tobytes()], pa.binary())], ["k", "v", "shapes"])

    def merge(t: pa.Table) -> pa.Table:
        rows = _first(np.frombuffer(b"".join(t.column("v").to_pylist()), _COUNT), LISTED)
        shapes = sum(map(np.frombuffer, t.column("shapes").to_pylist()))
        return pa.table([t.column("k").combine_chunks()[:1], pa.array([rows.tobytes()], pa.binary()), pa.array([shapes.tobytes()], pa.binary())], ["k", "v", "shapes"])

    dealt = bodies.mapInArrow(run, "part int, kind int, blob binary").repartitionById(parts, F.col("part"))
    out = dealt.mapInArrow(told, "k int, v binary, shapes binary").groupBy("k").applyInArrow(merge, "k int, v binary, shapes binary").collect()
    rows = _first(np.frombuffer(b"".join(r["v"] for r in out), _COUNT), LISTED)
    return rows["word"], rows["n"], sum((np.frombuffer(r["shapes"]) for r in out), np.zeros(SHAPES))


def _counts(words: np.ndarray, n: np.ndarray) -> np.ndarray:
    rows = np.empty(len(words), _COUNT)
    rows["word"], rows["n"] = words, n
    return rows


def _first(rows: np.ndarray, most: int) -> np.ndarray:
    """The rows of the highest counts, the highest first; of equal counts the least hashes."""
    return rows[np.lexsort((rows["word"], -rows["n"]))[:most]]


def text_keys(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each text."""
    return span_hashes(raw, at[:-1], at[1:], lower=False).view(np.int64)


def _unlisted(listing: Listing, parts: int):
    """Counts of training words that are not listed, and each text's own such words, once for each task."""

    def run(batches):
        words, asks, times, size, seen = [], [], [], 0, set()

        def deal():
            found, count = np.unique(np.concatenate(words), return_counts=True)
            rows = np.empty(len(found), _COUNT)
            rows["word"], rows["n"] = found, count
            yield _dealt(0, rows, found, parts)
            rows = np.concatenate(asks)
            yield _dealt(1, rows, rows["word"], parts)
            rows = np.concatenate(times)
            yield _dealt(2, rows, rows["text"], parts)

        for batch in grouped_by_bytes(batches, 1, BATCH_BYTES):
            raw, at = text_bytes(batch.column(1))
            hashes, of = tokens_of(raw, at)
            rest = listing.numbers(hashes) < 0
            hashes, of = hashes[rest], of[rest]
            learns = np.asarray(batch.column(2).fill_null(False))
            words.append(hashes[learns[of]])
            keys = text_keys(raw, at)
            new = np.zeros(len(keys), bool)
            for k, key in enumerate(keys.tolist()):
                if key not in seen:
                    seen.add(key)
                    new[k] = True
            if len(seen) > GATHERED:
                seen.clear()
            rows = np.empty(int(new[of].sum()), _ASK)
            rows["word"], rows["text"] = hashes[new[of]], keys[of[new[of]]]
            asks.append(rows)
            # Tells how often a text is asked for: once for each task that holds it.
            size += len(hashes)
            rows = np.zeros(int(new.sum()), _SUM)
            rows["text"], rows["times"] = keys[new], 1
            times.append(rows)
            if size >= GATHERED:
                yield from deal()
                words, asks, times, size = [], [], [], 0
        if words:
            yield from deal()

    return run


def _answered(parts: int):
    """Sums over texts of the logs of their words' counts, dealt anew by text; totals of the shapes' counts."""

    def run(batches):
        held: dict[int, tuple[list, list]] = {}
        sums = []
        for batch in batches:
            for part, kind, blob in zip(*(c.to_pylist() for c in batch.columns)):
                if kind == 2:
                    sums.append(np.frombuffer(blob, _SUM))
                else:
                    held.setdefault(part, ([], []))[kind].append(blob)
        for part in list(held):
            counts, asks = (np.frombuffer(b"".join(x), t) for x, t in zip(held.pop(part), (_COUNT, _ASK)))
            words, place = np.unique(counts["word"], return_inverse=True)
            n = np.bincount(place, counts["n"], len(words))
            shape = (words & np.uint64(63)).astype(np.int64)
            totals = np.vstack((np.bincount(shape, n, SHAPES), np.bincount(shape, minlength=SHAPES)))
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([3], pa.int32()), pa.array([totals.tobytes()], pa.binary())], ["part", "kind", "blob"])
            if not len(asks):
                continue
            c = np.zeros(len(asks))
            if len(words):
                at = np.minimum(np.searchsorted(words, asks["word"]), len(words) - 1)
                c = np.where(words[at] == asks["word"], n[at], 0)
            # In the order of words, so that sums do not depend on the order of arrival.
            order = np.lexsort((asks["word"], asks["text"]))
            text, c = asks["text"][order], c[order]
            starts = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
            rows = np.zeros(len(starts), _SUM)
            rows["text"] = text[starts]
            rows["log"] = np.add.reduceat(np.log10(c + 0.5), starts)
            rows["known"] = np.add.reduceat((c > 0).astype(np.int64), starts)
            sums.append(rows)
        if sums:
            rows = np.concatenate(sums)
            yield _dealt(2, rows, rows["text"], parts)

    return run


def _added(batches):
    """Sums of all parts of each text; of a text that several tasks asked for, the mean."""
    held: dict[int, list] = {}
    for batch in batches:
        for part, blob in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            held.setdefault(part, []).append(blob)
    for part in list(held):
        rows = np.frombuffer(b"".join(held.pop(part)), _SUM)
        rows = rows[np.lexsort((rows["log"], rows["text"]))]
        starts = np.flatnonzero(np.r_[True, rows["text"][1:] != rows["text"][:-1]])
        times = np.maximum(np.add.reduceat(rows["times"], starts), 1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows["text"][starts]), pa.array(np.add.reduceat(rows["log"], starts) / times), pa.array(np.add.reduceat(rows["known"], starts) // times)], ["key", "log", "known"]
        )


def score_language_model(docs: DataFrame, model: LanguageModel, learn: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    ``learn``: which rows the model was fitted to, an expression over the id.
    """
    spark = docs.sparkSession
    listing = model.listing
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body"), learn.alias("learns"))
    kind = dict(rows.dtypes)["id"]

    count = model.counts
    blobs = "part int, kind int, blob binary"
    asked = rows.mapInArrow(_unlisted(listing, n), blobs).repartitionById(n, F.col("part")).mapInArrow(_answered(n), blobs)
    answers = written(asked, "word-answers")
    own = (np.frombuffer(r["blob"]).reshape(2, SHAPES) for r in answers.where("kind = 3").select("blob").collect())
    shapes = sum(own, np.zeros((2, SHAPES)))
    all_tokens = float(count.sum() + shapes[0].sum())
    distinct = float((count > 0).sum() + shapes[1].sum())
    shape = (listing.hashes & np.uint64(63)).astype(np.int64)
    tail = np.arange(len(shape)) >= _HEAD
    shapes += np.vstack((np.bincount(shape[tail], count[:-1][tail], SHAPES), np.bincount(shape[tail], count[:-1][tail] > 0, SHAPES)))
    base_rest = np.log10(all_tokens + 0.5 * (distinct + 1))
    rest = np.log10(shapes[0] + 0.5 * (shapes[1] + 1))
    log_count = np.log10(count + 0.5)
    known_word = np.append(count[:-1] > 0, False)
    held = spark.sparkContext.broadcast((model, log_count, known_word, rest))

    def run(batches):
        net, log_of, known_of, rest_of = held.value
        gathered, tokens = [], 0

        def scored():
            sizes = np.concatenate([size + 1 for _, _, size, *_ in gathered])
            total = net.documents(np.concatenate([x[-1] for x in gathered]), np.r_[0, np.cumsum(sizes)]) / np.log(10)
            at = 0
            for ids, keys, size, known, base, within, _ in gathered:
                own = total[at : at + len(size)] + within
                at += len(size)
                yield pa.RecordBatch.from_arrays([ids, pa.array(keys), pa.array(size + 1), pa.array(known), pa.array(base), pa.array(own)], ["id", "key", "n", "k", "base", "own"])

        for batch in grouped_by_bytes(batches, 1, BATCH_BYTES):
            raw, at = text_bytes(batch.column(1))
            hashes, of = tokens_of(raw, at)
            n_rows = len(at) - 1
            inputs, _, numbers = _with_ends(net.listing, hashes, of, n_rows)
            read = inputs[np.arange(len(hashes)) + of]
            size = np.bincount(of, minlength=n_rows).astype(np.int64)
            logs = np.where(numbers >= 0, log_of[numbers], 0.0)
            base = np.bincount(of, logs, n_rows) + log_of[-1]
            in_shape = read >= _HEAD
            within = np.bincount(of, np.where(in_shape, logs - rest_of[np.where(in_shape, read - _HEAD, 0)], 0.0), n_rows)
            known = np.bincount(of, known_of[numbers], n_rows).astype(np.int64) + (log_of[-1] > np.log10(0.5))
            # The ids are copied, so that the batch with its texts can go.
            ids = pa.concat_arrays([batch.column(0).take(pa.array(np.arange(n_rows)))])
            gathered.append((ids, text_keys(raw, at), size, known, base, within, inputs))
            tokens += len(inputs)
            if tokens >= LANED:
                yield from scored()
                gathered, tokens = [], 0
        if gathered:
            yield from scored()

    scored = rows.select("id", "body").mapInArrow(run, f"id {kind}, key long, n long, k long, base double, own double")
    sums = answers.where("kind = 2").repartitionById(n, F.col("part")).mapInArrow(_added, "key long, log double, known long")
    log, more = F.coalesce("log", F.lit(0.0)), F.coalesce("known", F.lit(0))
    return scored.join(sums, "key", "left").select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_tokens"),
        (F.col("k") + more).alias("n_known"),
        F.lit(int(all_tokens)).cast("long").alias("train_tokens"),
        (F.col("base") + log - F.col("n") * F.lit(float(base_rest))).alias("base_score"),
        (F.col("own") + log).alias("score"),
    )


def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = held_out("doc_id", 5, 1)
    model = fit_language_model(docs, ~held)
    out = score_language_model(spread(docs), model, ~held)
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op5_language_model": op5_language_model}
