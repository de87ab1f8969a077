import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyweave.llm import toxicity as X
from tallyweave.llm.common import text_bytes


def test_windows_cover_all_words():
    rng = np.random.default_rng(0)
    counts = np.array([0, 1, X.WINDOW, X.WINDOW + 1, 5 * X.WINDOW + 7, 0, 3])
    rows = np.repeat(np.arange(len(counts)), counts)
    first, sizes, of = X.windows_of(rows, len(counts))
    start = np.cumsum(counts) - counts
    for k, n in enumerate(counts):
        seen = set()
        for f, s in zip(first[of == k], sizes[of == k]):
            assert 0 <= s <= X.WINDOW and s == min(X.WINDOW, n - (f - start[k]))
            seen.update(range(f - start[k], f - start[k] + s))
        assert seen == set(range(n)) and (of == k).any()
        begins = np.sort(first[of == k])
        assert (np.diff(begins) == X.STRIDE).all()
    del rng


def test_gradients_equal_differences(monkeypatch):
    model = X.ToxicityModel(X.new_params(np.random.default_rng(0)))
    p = model.params
    p["known"][:] = 1
    number, rows, words = X.words_of(*text_bytes(pa.array(["you are a fool, a FOOL", "nice day", ""])))
    first, sizes, _ = X.windows_of(rows, 3)
    picked = X._picked(number, len(words.bucket), first, sizes)
    y, w, drop = np.array([1.0, 0, 0]), np.array([1.0, 0.5, 0.7]), np.ones((X.WINDOW, 2, 3), np.float32)

    def loss():
        z = model.run(np.ascontiguousarray(model.embed(words)[picked].transpose(0, 2, 1)), sizes).astype(float)
        return float((w * (np.log1p(np.exp(z)) - y * z)).sum())

    grads = X.gradients(model, words, picked, sizes, y, w, drop)
    rng = np.random.default_rng(1)
    for name, grad in grads.items():
        if name == "known":
            continue
        places = np.argwhere(grad != 0) if name in ("word", "trigram") else np.argwhere(np.ones_like(grad))
        for at in map(tuple, places[rng.integers(0, len(places), 4)]):
            held, step = p[name][at], np.float32(2e-2)
            p[name][at] = held + step
            up = loss()
            p[name][at] = held - step
            down = loss()
            p[name][at] = held
            assert abs((up - down) / (2 * step) - grad[at]) < 2e-3, name


@pytest.fixture(scope="module")
def learned(spark):
    sf_dir = "/root/testdata/sf0.1"
    return X.op7_toxicity(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id", "left").cache()


def test_held_out_accuracy(learned):
    held = learned.where("held_out AND toxic IS NOT NULL")
    right, found, false = held.agg(
        F.avg((F.col("predicted") == F.col("toxic")).cast("int")), F.avg(F.when(F.col("toxic") == 1, F.col("predicted"))), F.avg(F.when(F.col("toxic") == 0, F.col("predicted")))
    ).first()
    assert right > 0.96 and found > 0.8 and false < 0.03
    assert learned.where("score IS NULL OR score < 0 OR score > 1 OR predicted <> int(score >= 0.7)").count() == 0


def test_odd_texts(spark, odd, none):
    labels = spark.createDataFrame([(1, 0, "x"), (5, 1, "x"), (6, 1, "x"), (7, None, "x"), (99, 1, "x"), (8, 0, "x")], "doc_id long, toxic int, text string")
    model = X.fit_toxicity(odd, labels, F.lit(True))
    rows = X.score_toxicity(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (0, 1, 2)}) == 1 and len({r["score"] for r in rows if r["doc_id"] in (5, 6, None)}) == 1
    assert X.score_toxicity(none, model).count() == 0
    constant = X.fit_toxicity(odd, labels.where("toxic = 0"), F.lit(True))
    assert {r["score"] for r in X.score_toxicity(odd, constant).collect()} == {0.0}


def test_all_windows_of_a_document_are_looked_at(monkeypatch):
    """The highest window is looked for among all windows of a training document, however many."""
    from tallyweave.llm import toxicity

    seen = []
    whole = toxicity.ToxicityModel.run
    monkeypatch.setattr(toxicity.ToxicityModel, "run", lambda self, x, sizes, keep=False: seen.append(0 if keep else len(sizes)) or whole(self, x, sizes, keep))
    texts = [" ".join(f"w{k}" for k in range(n)).encode() for n in (30 * toxicity.STRIDE, 5, 12 * toxicity.STRIDE)]
    at = np.cumsum([0, *map(len, texts)])
    raw = np.frombuffer(b"".join(texts), np.uint8)
    _, rows, _ = toxicity.words_of(raw, at)
    windows = len(toxicity.windows_of(rows, 3)[2])
    toxicity.train(raw, at, np.array([1, 0, 1]), updates=1)
    assert windows > 40 and sum(seen) == 2 * windows


def test_query_equals_brute_force(spark):
    """Scores of whole texts, window by window and word by word, by the definition of each layer."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    learn = ~X.held_out("doc_id", 3, 1)
    model = X.fit_toxicity(docs, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"), learn)
    got = {r["doc_id"]: r["score"] for r in X.score_toxicity(docs, model).collect()}
    p, h = model.params, X.HIDDEN
    sigmoid = lambda v: 1 / (1 + np.exp(-v))

    def states(xs, way):
        state, out = np.zeros(h), []
        for x in xs:
            own = p[f"in_{way}"].astype(float) @ x + p[f"gate_{way}"][:, 0]
            back = p[f"rec_{way}"].astype(float) @ state
            z, r = sigmoid(own[:h] + back[:h]), sigmoid(own[h : 2 * h] + back[h : 2 * h])
            state = z * state + (1 - z) * np.tanh(own[2 * h :] + r * (back[2 * h :] + p[f"bias_{way}"][:, 0]))
            out.append(state)
        return out

    rows = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=lambda r: len(r[1] or ""))
    for i, text in [*rows[:20], *rows[60:90:3]]:
        number, _, words = X.words_of(*text_bytes(pa.array([text or ""])))
        table = model.embed(words).astype(float)
        best = -np.inf
        for a in range(0, max(1, len(number)), X.STRIDE):
            own = number[a : a + X.WINDOW]
            if a and a + X.WINDOW - X.STRIDE >= len(number):
                break
            filled = [*own, *[len(table) - 1] * (X.WINDOW - len(own))]
            xs = table[filled]
            both = [np.concatenate(s) for s in zip(states(xs, "f"), states(xs[::-1], "b")[::-1])]
            seen = both[: max(1, len(own))]
            e = np.array([p["att_out"][:, 0] @ np.tanh(p["att"] @ s + p["att_bias"][:, 0]) for s in seen])
            weight = np.exp(e - e.max())
            pooled = sum(w * s for w, s in zip(weight / weight.sum(), seen))
            best = max(best, float(p["out"][:, 0] @ pooled + p["out_bias"][0]))
        assert abs(got[i] - sigmoid(best)) < 1e-4, i
