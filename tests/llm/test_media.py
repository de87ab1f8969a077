import hashlib
import io
import wave
import zlib

import numpy as np

from tallyweave.llm.media import BANDS, FRAME, HOP, REACH, fingerprints, from_wav, media_features, op10_media, padded, peaks, to_wav


def test_round_trip(odd, none):
    rows = media_features(odd).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in odd.collect()}
    for r in rows:
        data = texts[r["doc_id"]].encode()
        payload = bytes(r["payload"])
        assert r["n_bytes"] == len(data) and payload[: len(data)] == data
        assert len(payload) % 576 == 0 and 0 < len(payload) and len(payload) - max(1, len(data)) < 576
        assert set(payload[len(data) :]) <= {255}
        with wave.open(io.BytesIO(bytes(r["media"]))) as w:
            assert (w.getsampwidth(), w.getnchannels(), w.readframes(w.getnframes())) == (1, 1, payload)
        assert len(r["times"]) == len(r["codes"]) and r["times"] == sorted(r["times"])
    assert media_features(none).count() == 0


def test_peaks_find_tones():
    t = np.arange(576 * 8)
    tone = (128 + 60 * np.sin(2 * np.pi * 20 * t / 512) + 40 * np.sin(2 * np.pi * 150 * t / 512)).astype(np.uint8)
    found = peaks(tone)
    assert found.shape[1] == BANDS and (found[1:-2, 0] == 20).all() and (found[1:-2, 2] == 150).all()
    times, codes = fingerprints(found)
    assert len(times) == len(codes) > 0


def test_query(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op10_media(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    by: dict = {}
    for r in rows:
        payload = padded(texts[r["doc_id"]].encode())
        media = to_wav(payload)
        assert from_wav(media) == payload
        assert (r["payload_bytes"], r["payload_sha256"]) == (len(payload), hashlib.sha256(payload).hexdigest())
        assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(payload[-32:])
        assert by.setdefault(texts[r["doc_id"]], r["feature"]) == r["feature"]


def test_feature_equals_brute_force(spark, sf_dir):
    """Fingerprints by the definition of the transform, frame by frame; of short texts, for time."""
    texts = sorted(((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()), key=lambda r: len(r[1]))[:60]
    got = {r["doc_id"]: r["feature"] for r in op10_media(spark, sf_dir).collect()}
    k = np.arange(FRAME // 2 + 1)[:, None] * np.arange(FRAME)[None]
    wave_of = np.exp(-2j * np.pi * k / FRAME)
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(FRAME) / (FRAME - 1))
    for i, text in texts:
        x = np.frombuffer(padded(text.encode()), np.uint8).astype(float) - 128
        frames = []
        at = 0
        while True:
            frame = np.zeros(FRAME)
            part = x[at : at + FRAME]
            frame[: len(part)] = part
            power = np.round(np.log2(1 + np.abs(wave_of @ (frame * hann)) ** 2), 6)
            edges = np.linspace(1, FRAME // 2 + 1, BANDS + 1).astype(int)
            frames.append([[b for b in range(lo, hi) if power[b] >= power[lo:hi].max() - 1e-3] for lo, hi in zip(edges, edges[1:])])
            at += HOP
            if at + FRAME - HOP >= len(x):
                break
        times, codes = ([int(v) for v in s.split(",")] if s else [] for s in got[i].split("|"))
        want = [(t, d) for t in range(len(frames)) for d in range(1, REACH + 1) if t + d < len(frames) for _ in range(BANDS)]
        assert sorted((t, c & 15) for t, c in zip(times, codes)) == sorted(want)
        for t, c in zip(times, codes):
            one, two, d = c >> 16, c >> 4 & 0xFFF, c & 15
            assert any(one in frames[t][b] and two in frames[t + d][b] for b in range(BANDS))
