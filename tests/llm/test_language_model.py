import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyweave.llm import language_model as M

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)), None]


def check_base(rows, docs, learns):
    count = Counter()
    for i, t in docs:
        if learns(i):
            count.update(tokens(t))
    n, v = sum(count.values()), len(count)
    texts = {}
    for i, t in docs:
        texts.setdefault(i, []).append(t)
    for r in rows:
        best = None
        for t in texts[r["doc_id"]]:
            own = tokens(t)
            base = sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)
            if r["n_tokens"] == len(own) and r["n_known"] == sum(count[w] > 0 for w in own) and abs(base - r["base_score"]) <= 1e-7 * max(1, abs(base)):
                best = t
        assert best is not None or None in texts[r["doc_id"]]
        assert r["train_tokens"] == n and r["score"] < 0


def test_base_equals_brute_force_and_model_beats_it(spark, sf_dir):
    import zlib

    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    rows = M.op5_language_model(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    check_base(rows, docs, lambda i: zlib.crc32(str(i).encode()) % 5 != 1)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(0)
    words = M.mix(np.arange(1, 3001, dtype=np.uint64)) & ~np.uint64(63)
    words |= M.mix(words) % np.uint64(M.SHAPES)
    listing = M.Listing.of(words)
    texts = [np.append(M.inputs_of(listing.numbers(w), w), M._END) for w in (words[rng.integers(0, 3000, 40)] for _ in range(30))]
    return M.train(listing, texts, updates=5)


def test_probabilities_add_up(model):
    """Of any state, head words, shapes and the end have one probability in all."""
    states = np.random.default_rng(1).normal(size=(M.HIDDEN, 1)).astype(np.float32)
    everything = np.arange(M._INPUTS)
    logs = model.token_scores(np.repeat(states, len(everything), axis=1), everything)
    assert abs(np.exp(logs).sum() - 1) < 1e-4


def test_documents_side_by_side(model):
    """A document's score does not depend on the documents beside it, nor on windows."""
    rng = np.random.default_rng(2)
    own = [np.append(rng.integers(0, M._END, n), M._END) for n in (0, 1, 31, 32, 33, 500, 3)] * 40
    ends = np.cumsum([0, *map(len, own)])
    together = model.documents(np.concatenate(own), ends)
    for k in range(7):
        alone = model.documents(own[k], np.array([0, len(own[k])]))
        assert abs(alone[0] - together[k]) < 1e-3 * max(1, abs(alone[0]))
        # By hand: one step after another.
        state, total, last = np.zeros((M.HIDDEN, 1), np.float32), 0.0, M._END
        for t in own[k][:40]:
            state = M.forward(model.gates(np.array([[last]])), model.params["rec"], model.params["bias"], state)[-1]
            total += model.token_scores(state, np.array([t]))[0]
            last = t
        if len(own[k]) <= 40:
            assert abs(total - alone[0]) < 1e-3 * max(1, abs(total))


def test_lanes_hold_every_document_once():
    rng = np.random.default_rng(3)
    for n, most in ((0, 4), (1, 4), (3, 4), (200, 7)):
        sizes = rng.integers(1, 400, n)
        order, at = M.lanes(sizes, most, rng if n == 3 else None)
        assert sorted(order.tolist()) == list(range(n)) and len(at) == min(n, most) + 1
        loads = np.diff(at)
        assert loads.sum() == sizes.sum() and (np.diff(loads) <= 0).all() and (n < most or loads.max() - loads.min() <= sizes.max())
        ends = set(np.cumsum(sizes[order]).tolist()) | {0}
        assert set(at.tolist()) <= ends


def test_gradients_equal_differences(model):
    """An update without momentum goes down the loss's slope, states that begin anew included."""
    import copy

    rng = np.random.default_rng(4)
    own = copy.deepcopy(model)
    targets = rng.integers(0, M._END, (6, 3))
    mask = rng.random((6, 3)) < 0.8
    alive = (rng.random((6, 3)) < 0.7).astype(np.float32)
    state, last = np.zeros((M.HIDDEN, 3), np.float32), np.full(3, M._END)

    class Seen:
        def update(self, grads, rate=None):
            self.grads = grads

    def loss():
        p = own.params
        states = M.forward(own.gates(np.vstack((last, targets[:-1]))), p["rec"], p["bias"], state, alive=alive)
        flat = np.ascontiguousarray(states[1:].transpose(1, 0, 2).reshape(M.HIDDEN, -1)[:, np.flatnonzero(mask.ravel())])
        return -float(own.token_scores(flat, targets.ravel()[mask.ravel()]).mean())

    seen = Seen()
    M._update(own, seen, targets, mask, state, last, 0.1, alive)
    for name, grad in seen.grads.items():
        for at in map(tuple, np.argwhere(np.abs(grad) > 1e-3)[:: max(1, int((np.abs(grad) > 1e-3).sum()) // 4)]):
            held, step = own.params[name][at], np.float32(2e-2)
            own.params[name][at] = held + step
            up = loss()
            own.params[name][at] = held - step
            down = loss()
            own.params[name][at] = held
            assert abs((up - down) / (2 * step) - grad[at]) < 2e-3, name


def test_odd_texts(spark, odd, none):
    learn = F.coalesce(F.col("doc_id") != 4, F.lit(True))
    model = M.fit_language_model(odd, learn)
    rows = M.score_language_model(odd, model, learn).collect()
    assert len(rows) == odd.count()
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    check_base(rows, docs, lambda i: i != 4)
    empty = [r["score"] for r in rows if r["n_tokens"] == 1]
    assert len(empty) > 2 and max(empty) - min(empty) < 1e-5
    assert M.score_language_model(none, model, learn).count() == 0
    untrained = M.fit_language_model(none, learn)
    rows = M.score_language_model(odd, untrained, F.lit(False)).collect()
    assert len(rows) == odd.count() and all(r["train_tokens"] == 0 and r["n_known"] == 0 and math.isfinite(r["score"]) for r in rows)


def test_all_training_documents_are_learned_from(spark):
    """Head words and class frequencies are of all training words, and every token of them trains, whatever the sample."""
    long = " ".join(f"w{k % 700}" for k in range(3000))
    rows = [(k, long if k == 7 else "often seen words " * (1 + k % 5)) for k in range(40)] + [(100 + k, "kept apart") for k in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    model = M.fit_language_model(docs, F.col("doc_id") < 100, sample=1)
    count = Counter(w for i, t in rows if i < 100 for w in tokens(t))
    hashes = {w: int(M.tokens_of(*text_of(w))[0][0]) for w in count if w is not None}
    listed = model.listing.hashes.tolist()
    assert {hashes[w] for w in ("often", "seen", "words")} == set(listed[:3])
    assert hashes["w699"] in listed and int(M.tokens_of(*text_of("kept"))[0][0]) not in listed
    assert model.trained == sum(count.values())
    # Training goes on from the exact frequency of the end, which the one document of the sample does not have.
    share = np.exp(model.params["class_bias"][-1, 0]) / np.exp(model.params["class_bias"]).sum()
    assert abs(np.log(share / (count[None] / sum(count.values())))) < 1


def text_of(word):
    raw = np.frombuffer(word.encode(), np.uint8)
    return raw, np.array([0, len(raw)])


def test_states_lie_row_by_row(monkeypatch):
    """Scores pick whole states, not single numbers all over the window, and are the same for either layout."""
    model = M.train(M.Listing.of(np.zeros(0, np.uint64)), [np.array([1, 2, M._END]), np.array([3, M._END])], updates=2)
    plain, seen = M.LanguageModel.token_scores, []

    def watched(self, states, targets, safe=False):
        seen.append(states.T.flags.c_contiguous)
        out = plain(self, states, targets, safe)
        assert np.allclose(out, plain(self, np.ascontiguousarray(states), targets, safe), atol=1e-5)
        return out

    monkeypatch.setattr(M.LanguageModel, "token_scores", watched)
    model.documents(np.array([1, 2, M._END, 3, 4, M._END]), np.array([0, 3, 6]))
    assert seen and all(seen)
