import hashlib
import random
from collections import defaultdict

import corpus_pipeline

from tallyweave.llm.components import components


def test_components_equal_brute_force(spark):
    r = random.Random(0)
    edges = [(r.randrange(-300, 300), r.randrange(-300, 300)) for _ in range(250)] + [(k, k + 1) for k in range(1000, 1100)] + [(5000, k) for k in range(5001, 5100)]
    parent = defaultdict(lambda: None)

    def root(x):
        while parent[x] is not None:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        if a != b:
            parent[b] = a
    got = {x["node"]: x["label"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for e in edges if e[0] != e[1] for x in e}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "quality", "jaccard", "decontamination", "bpe"]
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == [*docs.columns, "n_tokens", "ids_sha256", "decoded_sha256"]
    rows, all_rows = {r["doc_id"]: r for r in out.collect()}, {r["doc_id"]: r for r in docs.collect()}
    assert 0 < len(rows) < len(all_rows) and out.count() == len(rows)
    assert all(rows[k]["text"] == all_rows[k]["text"] and rows[k]["n_chars"] == all_rows[k]["n_chars"] for k in rows)
    texts = [r["text"] for r in rows.values()]
    assert len(set(texts)) == len(texts)
    items = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert not any(i in t for t in texts for i in items)


def test_odd_texts(spark, odd, none, sf_dir):
    docs = odd
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.columns[: len(odd.columns)] == odd.columns
    docs.collect()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf_dir).count() == 0


def test_stages_equal_brute_force(spark, sf_dir):
    """Each stage's decisions, text by text, on all that the stage before kept."""
    import pyarrow as pa
    from test_jaccard import brute
    from tokenizers import Tokenizer

    from tallyweave.llm import bpe, decontamination, language_id, quality
    from tallyweave.llm.common import held_out, table, text_bytes, written

    docs = table(spark, sf_dir, "documents")
    held = {}
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs, sf_dir), name)
        held[name] = (docs, {r["doc_id"]: r for r in docs.collect()}, {r["doc_id"]: r for r in out.collect()})
        docs = out
    frame, before, after = held["language_id"]
    model = language_id.fit_language(frame, ~held_out("doc_id", 4, 2))
    for i, r in before.items():
        names, score = language_id.predict(pa.array([r["text"]], pa.string()), model)
        assert (i in after) == (names[0] != "und" and score[0] >= language_id.ACCEPTED)
    frame, before, after = held["quality"]
    fitted = quality.learned(frame, table(spark, sf_dir, "labels"), ~held_out("doc_id", 3, 1))[0]
    for i, r in before.items():
        assert (i in after) == (fitted.score(quality.statistics(*text_bytes(pa.array([r["text"]]))))[0] >= 0.5)
    _, before, after = held["jaccard"]
    assert set(after) == {c for _, _, c in brute([(i, r["text"]) for i, r in before.items()])}
    _, before, after = held["decontamination"]
    items = [(r["item_id"], r["text"]) for r in table(spark, sf_dir, "benchmark").collect()]
    index = decontamination.build(items)
    assert set(after) == {i for i, r in before.items() if not decontamination.hits([r["text"]], index)}
    assert not any(decontamination.normal(x).tobytes() in decontamination.normal(r["text"]).tobytes() for r in after.values() for _, x in items)
    _, before, after = held["bpe"]
    library = Tokenizer.from_file(bpe.default_path())
    assert set(before) == set(after)
    for i, r in after.items():
        ids = library.encode(before[i]["text"], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_text_goes_once(spark, odd):
    """The last stage sends each text to its workers once, in its row, and gives what it gave with a second copy."""
    from pyspark.sql import functions as F

    from tallyweave.llm import bpe

    out = corpus_pipeline.encoded(spark, odd, "")
    plan = out._jdf.queryExecution().executedPlan().toString()
    (sent,) = [line for line in plan.splitlines() if "MapInArrow" in line]
    assert "body" not in sent
    rows = odd.select(F.struct(*odd.columns).alias("row"), "text")
    apart = bpe.bpe_encode_decode(rows, bpe.default_path(), "row", "text").select("row", *bpe.digests()).select("row.*", "n_tokens", "ids_sha256", "decoded_sha256")
    assert sorted(map(str, out.collect())) == sorted(map(str, apart.collect()))
