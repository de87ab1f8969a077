import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tallyweave.llm import quality as Q
from tallyweave.llm.common import text_bytes


def test_statistics():
    texts = ["The cat. The cat\nthe CAT", "", None, "a|b !! 12é", "x\nx\ny"]
    x = {n: v for n, v in zip(Q.NAMES, Q.statistics(*text_bytes(pa.array(texts))).T)}
    assert np.allclose(x["log_bytes"], np.log1p([len((t or "").encode()) for t in texts]))
    assert x["upper"][0] == np.float32(5 / 18) and x["lines"][0] == np.float32(1 / 24) and x["stops"][0] == np.float32(1 / 24)
    assert x["distinct"][0] == np.float32(3 / 6) and x["same_as_last"][0] == 0
    assert x["pipes"][3] > 0 and x["exclaims"][3] > 0 and x["digits"][3] > 0 and x["beyond_ascii"][3] > 0 and x["no_letter"][3] == np.float32(1 / 3)
    assert x["distinct_lines"][4] == np.float32(2 / 3)
    assert all(v[1] == v[2] == 0 or n == "distinct_lines" for n, v in x.items())


def test_each_row_by_itself():
    """A text's statistics do not depend on the texts beside it."""
    texts = ["one two", "two\n", "\n", "", "three " * 50, "!! ??", "one two"]
    together = Q.statistics(*text_bytes(pa.array(texts)))
    alone = np.vstack([Q.statistics(*text_bytes(pa.array([t]))) for t in texts])
    assert np.allclose(together, alone)


def test_isotonic_equals_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(20):
        v, w = rng.random(8), rng.random(8) + 0.1
        got = Q.isotonic(v, w)
        # max over beginnings of min over ends of the mean between them
        mean = lambda a, b: (v[a : b + 1] * w[a : b + 1]).sum() / w[a : b + 1].sum()
        want = [max(min(mean(a, b) for b in range(k, 8)) for a in range(k + 1)) for k in range(8)]
        assert np.allclose(got, want)


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.1"
    rows = Q.op2_quality(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    assert rows.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    right = rows.where("held_out").join(labels, "doc_id").agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0]
    assert right > 0.98
    assert rows.where("score < 0 OR score > 1 OR score IS NULL OR predicted <> int(score >= 0.5)").count() == 0


def test_odd_texts(spark, odd, none):
    labels = spark.createDataFrame([(1, 0, "x"), (5, 1, "x"), (6, 1, "x"), (7, None, "x"), (99, 1, "x"), (3, 0, "x"), (8, 0, "x")], "doc_id long, quality int, text string")
    model, stats = Q.learned(odd, labels, F.lit(True))
    rows = Q.score_quality(stats, model).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    same = {r["score"] for r in rows if r["doc_id"] in (5, 6, None)}
    assert len(same) == 1
    assert Q.keep_quality(odd, model, 0.0).columns == odd.columns and Q.keep_quality(odd, model, 0.0).count() == odd.count()
    # Without labels, and without documents.
    model, stats = Q.learned(odd, labels.where("false"), F.lit(True))
    assert {r["score"] for r in Q.score_quality(stats, model).collect()} == {0.5}
    model, stats = Q.learned(none, labels, F.lit(True))
    assert Q.score_quality(stats, model).count() == 0


def test_query_equals_brute_force(spark, sf_dir):
    """Features, equations, weights and calibration of the query, text by text and row by row."""
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(Q.CALIBRATES)).alias("part")).collect()]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    x = np.vstack([Q.statistics(*text_bytes(pa.array([t], pa.string()))) for _, t, _ in docs]).astype(float)
    use = [k for k, (i, _, _) in enumerate(docs) if zlib.crc32(str(i).encode()) % 3 != 1 and labels.get(i) in (0, 1)]
    own, y, part = x[use], np.array([labels[docs[k][0]] for k in use], float), np.array([docs[k][2] for k in use])
    mean, scale = own.mean(0), np.sqrt(np.maximum(own.var(0), 1e-8))
    rng = np.random.default_rng(11)
    d, n = len(Q.NAMES), Q.FEATURES
    directions, phases = rng.normal(size=(d, n)) / np.sqrt(d), rng.uniform(0, 2 * np.pi, n)

    def features(rows):
        z = np.clip((rows - mean) / scale, -6, 6)
        return np.array([[*(np.sqrt(2 / n) * np.cos(v @ directions + phases)), 1.0] for v in z])

    z = features(own[part != 0])
    left = sum(np.outer(v, v) for v in z) + (Q.RIDGE * len(own) + 1e-6) * np.eye(n + 1)
    weights = np.linalg.solve(left, sum(v * t for v, t in zip(z, y[part != 0])))
    bins = np.clip((features(own[part == 0]) @ weights + 0.5) / 2 * Q.BINS, 0, Q.BINS - 1).astype(int)
    has = sorted(set(bins))
    count = np.array([(bins == b).sum() for b in has], float)
    rising = Q.isotonic(np.array([y[part == 0][bins == b].mean() for b in has]), count)
    level = np.array([count[rising == v].sum() for v in rising])
    to = Q.isotonic((rising * level + y.mean()) / (level + 1), count)
    want = np.clip(np.interp(features(x) @ weights, (np.array(has) + 0.5) / Q.BINS * 2 - 0.5, to), 0, 1)
    got = {r["doc_id"]: r for r in Q.op2_quality(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for (i, _, _), s in zip(docs, want):
        assert abs(got[i]["score"] - s) < 1e-3 and got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)


def test_features_approximate_the_kernel():
    rng = np.random.default_rng(0)
    d = len(Q.NAMES)
    model = Q.QualityModel(np.zeros(d), np.ones(d), rng.normal(size=(d, 20_000)) / np.sqrt(d), rng.uniform(0, 2 * np.pi, 20_000), np.zeros(20_001), np.zeros(1), np.zeros(1))
    x = rng.normal(size=(6, d))
    z = model.features(x)[:, :-1]
    true = np.exp(-((x[:, None] - x[None]) ** 2).sum(2) / (2 * d))
    assert np.abs(z @ z.T - true).max() < 0.05


def test_levels():
    assert Q.levels(0) == [16] and Q.levels(1000) == [16] and Q.levels(800_000) == [12_500, 195, 16]
