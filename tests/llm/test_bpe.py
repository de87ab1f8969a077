import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallyweave.llm.bpe import bpe_encode_decode, codec, default_path, op1_bpe

LIBRARY = Tokenizer.from_file(default_path())
ids_of = lambda t: LIBRARY.encode(t, add_special_tokens=False).ids

pieces = st.one_of(st.text(max_size=12), st.sampled_from(["<|endoftext|>", "  ", "\n\n", "'re", " the", "1234", "\r\n", "　", "İ", "x" * 200]))


@settings(max_examples=300, deadline=None)
@given(st.lists(pieces, max_size=12).map("".join))
def test_equals_library(text):
    own = codec(default_path())
    ids = own.encode(text)
    assert ids == ids_of(text)
    assert own.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False) == text


def test_cuts_are_certain():
    """No vocabulary token holds a pair at which texts are cut."""
    own = codec(default_path())
    for token in own.bytes_of[:50256]:
        assert not own.cuts(token)
    assert own.cuts(b"a\xe4") and own.inside.sum() < 65536


def test_long_fragment():
    own = codec(default_path())
    for text in ("ab" * 20000, "e" * 9999, "thth" * 500 + "é" * 500):
        assert own.encode(text) == ids_of(text)


def test_odd_texts(odd, none):
    rows = {r["doc_id"]: r for r in bpe_encode_decode(odd, default_path()).collect()}
    for r in odd.collect():
        text = r["text"] or ""
        assert rows[r["doc_id"]]["decoded"] == text and rows[r["doc_id"]]["ids"] == ids_of(text)
    assert bpe_encode_decode(none, default_path()).count() == 0


def test_query(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op1_bpe(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = ids_of(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
