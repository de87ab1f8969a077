import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tallyweave.llm import language_id as L
from tallyweave.llm.common import text_bytes


def test_windows_hold_every_byte():
    texts = ["", "a" * L.WINDOW, "b" * (2 * L.WINDOW + 3), None, "é"]
    raw, at = text_bytes(pa.array(texts))
    windows, sizes, rows = L.cut(raw, at)
    for k, t in enumerate(texts):
        own = rows == k
        c = L.CONTEXT
        assert b"".join(w[c : c + n].tobytes() for w, n in zip(windows.T[own], sizes[own])) == (t or "").encode()
        whole = bytes(c) + (t or "").encode() + bytes(L.WINDOW + c)
        assert all(w.tobytes() == whole[j * L.WINDOW : j * L.WINDOW + L.WINDOW + 2 * c] for j, w in enumerate(windows.T[own]))


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.1"
    rows = L.op4_language(spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    got = rows.join(docs, "doc_id").where("held_out").agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int")).alias("a"), F.min("score"), F.max("score")).first()
    assert got[0] > 0.98 and 0 <= got[1] and got[2] <= 1


def test_odd_texts(spark, odd, none):
    model = L.fit_language(odd, F.col("doc_id") != 4)
    assert model.names == ["en"]
    rows = {r["doc_id"]: r for r in L.identify(odd, model).collect()}
    assert {k for k, r in rows.items() if r["lang_pred"] == "und"} == {0, 1, 2, 3}
    assert all(r["score"] == 0 for r in rows.values() if r["lang_pred"] == "und")
    kept = L.keep_language(odd, model)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 4
    assert L.identify(none, model).count() == 0
    nothing = L.fit_language(none, F.lit(True))
    assert nothing.names == [] and {r["lang_pred"] for r in L.identify(odd, nothing).collect()} == {"und"}


def test_mean_of_positions():
    model = L.train(*_two())
    raw, at = text_bytes(pa.array(["abcabc", "xyzxyzxyz" * 30]))
    probs = model.documents(raw, at)
    windows, sizes, rows = L.cut(raw, at)
    each = model.positions(windows)
    for k in (0, 1):
        want = np.concatenate([each[L.CONTEXT : L.CONTEXT + n, :, j].T for j, n in enumerate(sizes) if rows[j] == k], axis=1).mean(1)
        assert np.allclose(probs[k], want, atol=1e-5)
    assert probs.argmax(1).tolist() == [0, 1]


def _two():
    raw, at = text_bytes(pa.array(["abcab" * 15, "xyzxz" * 15] * 20))
    windows, sizes, rows = L.cut(raw, at)
    return windows, sizes, rows % 2, ["ab", "xy"], 40


def _plain_states(table, rec, bias, text):
    """States of a unit over bytes, one after the other, by its definition."""
    h = rec.shape[1]
    state, out = np.zeros(h), []
    for b in text:
        own, back = table[b].astype(float), rec.astype(float) @ state
        z, r = 1 / (1 + np.exp(-(own[:h] + back[:h]))), 1 / (1 + np.exp(-(own[h : 2 * h] + back[h : 2 * h])))
        candidate = np.tanh(own[2 * h :] + r * (back[2 * h :] + bias[:, 0]))
        state = z * state + (1 - z) * candidate
        out.append(state)
    return out


def test_query_equals_brute_force(spark, sf_dir):
    """Every text's language and score, byte by byte; a sample of texts, for time."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = L.fit_language(docs, ~L.held_out("doc_id", 4, 2))
    got = {r["doc_id"]: r for r in L.op4_language(spark, sf_dir).collect()}
    assert len(got) == docs.count()
    p = model.params
    rows = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=lambda r: len(r[1] or ""))
    for i, text in rows[:60]:
        raw, total = (text or "").encode(), np.zeros(len(model.names))
        c, filled = L.CONTEXT, bytes(L.CONTEXT) + raw + bytes(L.WINDOW + L.CONTEXT)
        for a in range(0, len(raw), L.WINDOW):
            part = filled[a : a + L.WINDOW + 2 * c]
            ahead = _plain_states(p["in_f"], p["rec_f"], p["bias_f"], part)
            back = _plain_states(p["in_b"], p["rec_b"], p["bias_b"], part[::-1])[::-1]
            for f, b in list(zip(ahead, back))[c : c + min(L.WINDOW, len(raw) - a)]:
                logit = p["out_f"] @ f + p["out_b"] @ b + p["out_bias"][:, 0]
                total += np.exp(logit - logit.max()) / np.exp(logit - logit.max()).sum()
        total /= max(1, len(raw))
        if any(c.isalpha() for c in text or ""):
            assert got[i]["lang_pred"] == model.names[int(total.argmax())] and abs(got[i]["score"] - total.max()) < 1e-4
        else:
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)


def test_every_language_is_learned(spark):
    """However many languages there are, and wherever in a text its language shows."""
    rows = []
    for k in range(70):
        word = chr(97 + k % 26) + chr(97 + k // 26) * 2
        rows += [(10 * k + j, f"{word} " * 60, f"l{k:02d}") for j in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert L.fit_language(df, F.lit(True)).names == [f"l{k:02d}" for k in range(70)]
