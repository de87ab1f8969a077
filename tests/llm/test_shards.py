import tempfile
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyweave.llm.common import written
from tallyweave.llm.token_shards import END, Order, Shards, materialise


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5000), st.integers(0, 2**62))
def test_permutation(size, key):
    slots = Order(size, key).slots(np.arange(size, dtype=np.uint64))
    assert np.array_equal(np.sort(slots), np.arange(size))


def test_keys_differ():
    one, two = (Order(10_000, k).slots(np.arange(10_000, dtype=np.uint64)) for k in (1, 2))
    assert (one != two).mean() > 0.99 and abs(np.corrcoef(one, np.arange(10_000))[0, 1]) < 0.05


@pytest.mark.parametrize("length", [16, 512])
def test_round_trip(odd, length):
    docs = written(odd.repartition(3), "odd")
    rows, shards = materialise(docs, "file://" + tempfile.mkdtemp(), 3, length=length, shard_bytes=(8 if length > 16 else 512) * length)
    rows = rows.collect()
    stored = list(shards.read())
    assert sorted({r["slot"] for r in rows}) == list(range(shards.total)) and len(stored) == shards.total
    assert all(r["slot"] == r["shard"] * shards.each + r["place"] for r in rows)
    texts: dict = {}
    for r in sorted(rows, key=lambda r: r["part"]):
        texts.setdefault((r["doc_id"], r["part"]), []).append(stored[r["slot"]][r["start"] : r["start"] + r["n_ids"]].tobytes())
    held = {i: b"".join(texts[i, k][0] for k in range(len(texts)) if (i, k) in texts) for i in {i for i, _ in texts}}
    for r in docs.collect():
        # Rows of one id are held with both texts' parts; here they are equal.
        assert held[r["doc_id"]] == (r["text"] or "").encode() + bytes([END])
    # Parts cover each sequence from its beginning; what follows them is the end.
    by_slot: dict = {}
    for r in rows:
        by_slot.setdefault(r["slot"], []).append((r["start"], r["n_ids"]))
    for slot in range(shards.total):
        at = 0
        for start, n in sorted(by_slot[slot]):
            assert start == at
            at += n
        assert set(stored[slot][at:].tolist()) <= {END} and at <= length
    # Reading goes on from any slot, by the folder alone.
    again = Shards.open(shards.folder)
    assert again == shards and np.array_equal(np.stack(list(again.read(shards.total // 2))), np.stack(stored[shards.total // 2 :]))


def test_empty(none):
    rows, shards = materialise(none, "file://" + tempfile.mkdtemp(), 3)
    assert rows.count() == 0 and list(shards.read()) == []


@pytest.mark.parametrize("length", [16, 512])
def test_ids_are_of_the_vocabulary(odd, length):
    """What is stored equals the tokenizer library's ids, and the end after them."""
    from tokenizers import Tokenizer

    from tallyweave.llm import bpe
    from tallyweave.llm.token_shards import default_path

    library = Tokenizer.from_file(bpe.default_path())
    library.encode_special_tokens = True
    rows, shards = materialise(odd.repartition(3), "file://" + tempfile.mkdtemp(), 3, length=length, shard_bytes=16 * length, path=default_path())
    rows = rows.collect()
    stored = list(shards.read())
    assert sorted({r["slot"] for r in rows}) == list(range(shards.total)) and len(stored) == shards.total and shards.each == 8
    texts: dict = {}
    for r in sorted(rows, key=lambda r: r["part"]):
        texts.setdefault(r["doc_id"], []).append((r["part"], stored[r["slot"]][r["start"] : r["start"] + r["n_ids"]].tolist()))
    for r in odd.where("doc_id <> 5").collect():
        got = texts[r["doc_id"]]
        assert [k for k, _ in got] == list(range(len(got)))
        assert [x for _, own in got for x in own] == library.encode(r["text"] or "", add_special_tokens=False).ids + [50256]
    assert sum(r["n_ids"] for r in rows) == sum(len(library.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in odd.collect())


def test_query_equals_brute_force(spark, sf_dir):
    """All rows and all stored bytes of the query follow from the library's ids and the permutation."""
    from tallyweave.llm import token_shards as S

    encode = S.encoder(S.default_path())[0].encode_ordinary
    docs = {d["doc_id"]: encode(d["text"] or "") + [50256] for d in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    folder = "file://" + tempfile.mkdtemp()
    rows, shards = S.materialise(spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(5), folder, S.KEY, path=S.default_path())
    rows = rows.collect()
    stored = list(shards.read())
    got: dict = {}
    for r in sorted(rows, key=lambda r: r["part"]):
        got.setdefault(r["doc_id"], []).extend(stored[r["slot"]][r["start"] : r["start"] + r["n_ids"]].tolist())
        assert r["crc32"] == zlib.crc32(stored[r["slot"]].tobytes())
    assert got == docs
    assert sorted({r["slot"] for r in rows}) == list(range(shards.total)) and len(stored) == shards.total
    # Five tasks of one batch each: only their last sequences are filled up.
    assert shards.total <= sum(map(len, docs.values())) // S.LENGTH + 5
    query = S.op9_shards(spark, sf_dir).collect()
    total = lambda of: sorted((i, sum(r["n_ids"] for r in of if r["doc_id"] == i)) for i in docs)
    assert total(query) == total(rows) and len({r["doc_id"] for r in query}) == len(docs)


def test_numbering_does_not_depend_on_how_ids_are_read_again(spark, odd, monkeypatch):
    """Slots are the same when the written ids are scanned in other splits."""
    docs = written(odd.repartition(3), "odd")
    one = materialise(docs, "file://" + tempfile.mkdtemp(), 5, length=16)[0].collect()
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        lazy = materialise(docs, "file://" + tempfile.mkdtemp(), 5, length=16)[0]
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
        two = lazy.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)
    assert {r["slot"] for r in two} == {r["slot"] for r in one} and len(two) == len(one)


def test_more_ids_than_two_bytes(monkeypatch):
    from tallyweave.llm import token_shards as S

    monkeypatch.setattr(S, "encoder", lambda path: (None, 70_000))
    assert S.layout("x") == (70_000, "<u4") and S.layout(None) == (255, "u1")
