import random
import time

import numpy as np
import pytest

from tallyweave.llm import decontamination as D


def distance(item, region):
    """Fewest edits between an item and any part of a region."""
    row = [0] * (len(region) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(region, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def edited(text, k, r):
    b = bytearray(text)
    for _ in range(k):
        p = r.randrange(len(b))
        match r.randrange(3):
            case 0:
                b[p] = r.choice(b"abcdefgh")
            case 1:
                del b[p]
            case _:
                b.insert(p, r.choice(b"abcdefgh"))
    return bytes(b)


def some(n, r):
    return bytes(r.choice(b"abcdefghijkl") for _ in range(n))


@pytest.mark.parametrize("seed", range(6))
def test_finds_all_within_the_budget(seed):
    r = random.Random(seed)
    items = [some(r.choice([10, 13, 19, 20, 25, 60, 150, 300]), r).decode() for _ in range(12)]
    index = D.build(list(enumerate(items)))
    assert (index.least >= 1).all()
    texts, want = [], []
    for k in range(40):
        j = r.randrange(12)
        e = r.randrange(2 * int(index.edits[j]) + 2)
        texts.append(np.frombuffer(some(r.randrange(60), r) + edited(items[j].encode(), e, r) + some(r.randrange(60), r), np.uint8))
        for i, item in enumerate(items):
            d = distance(item.encode(), texts[-1].tobytes())
            if d <= index.edits[i]:
                want.append((k, i, d))
    got = D.search(texts, index)
    assert [(t, i, e) for t, i, _, _, e in got] == want
    for t, i, s, p, e in got:
        assert distance(items[i].encode(), texts[t][s:p].tobytes()) == e


def test_align_is_exact():
    r = random.Random(5)
    for _ in range(150):
        item, most = some(r.choice([12, 30]), r), r.randrange(5)
        region = some(r.randrange(6), r) + edited(item, r.randrange(6), r) + some(r.randrange(6), r)
        hit = D.align(np.frombuffer(item, np.uint8), np.frombuffer(region, np.uint8), most)
        true = distance(item, region)
        assert (hit is None) == (true > most) and (hit is None or hit[0] == true)


def test_case_and_signs_do_not_matter(spark):
    item = "Qué oscura la noche, y las estrellas no se ven en el río."
    docs = [(1, f"x {item.upper()} y"), (2, item.replace(" ", " ## ")), (3, item[:25]), (4, None), (5, "")]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    found = D.find_contamination(docs, spark.createDataFrame([(7, item, "x"), (8, None, "x"), (9, "short", "x")], "item_id long, text string, doc_id string"))
    assert sorted((r["doc_id"], r["item_id"], r["edits"]) for r in found.collect()) == [(1, 7, 0), (2, 7, 0)]


def test_many_turns(spark, sf_dir, monkeypatch):
    docs, items = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "benchmark"))
    want = sorted(map(tuple, D.find_contamination(docs, items).collect()))
    assert want
    monkeypatch.setattr(D, "INDEX_BYTES", 80_000)
    assert D.indexes(items)[0] > 1
    assert sorted(map(tuple, D.find_contamination(docs, items).collect())) == want
    clean = {r["doc_id"] for r in D.keep_clean(docs, items).collect()}
    assert clean == {r["doc_id"] for r in docs.collect()} - {w[0] for w in want}


def test_exact_passages(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    got = {(r["doc_id"], r["item_id"]) for r in D.op3_decontamination(spark, sf_dir).collect()}
    exact = {(d, i) for d, t in texts.items() for i, x in items.items() if x in t}
    assert exact and exact <= got


def test_odd_texts(spark, odd, none):
    items = spark.createDataFrame([(1, "lorem ipsum dolor sit amet"), (2, "")], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in D.find_contamination(odd, items).collect()} == {(9, 1)}
    assert D.find_contamination(none, items).count() == 0 and D.find_contamination(odd, items.where("false")).count() == 0
    assert D.keep_clean(odd, items).count() == odd.count() - 1 and D.keep_clean(odd, items).columns == odd.columns


def test_short_items_are_found_as_whole_words(spark):
    items = [(1, "2 + 2?"), (2, "Yes!"), (3, "é"), (4, "What is 2+2? Four."), (5, "--"), (6, "yes"), (7, "abc de fgh")]
    texts = ["so 2+2 it is", "122", "yesterday", "Oh, YES.", "café", "an é alone", "what is 2 + 2 four", "-- --", "abc, de, fgh", "xabc de fgh", "abc de fghi", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = D.find_contamination(docs, spark.createDataFrame(items, "item_id long, text string"))
    got = sorted((r["doc_id"], r["item_id"], r["edits"]) for r in found.collect())
    assert got == [(0, 1, 0), (3, 2, 0), (3, 6, 0), (5, 3, 0), (6, 1, 0), (6, 4, 0), (8, 7, 0)]
    assert sorted(r["doc_id"] for r in D.keep_clean(docs, spark.createDataFrame(items, "item_id long, text string")).collect()) == [1, 2, 4, 7, 9, 10, 11, 12]


def test_items_of_one_template_take_seconds():
    """3,200 items that share a template, and a document that repeats the template and holds three of them."""
    r = random.Random(1)
    template = some(87, r).decode()
    items = [(k, template + some(60, r).decode()) for k in range(3200)]
    index = D.build(items)
    parts = [template + some(40, r).decode() for _ in range(50)]
    parts[10], parts[20], parts[49] = items[5][1], edited(items[3000][1].encode(), 6, r).decode(), items[77][1]
    began = time.perf_counter()
    got = D.search([np.frombuffer("".join(parts).encode(), np.uint8)], index)
    assert time.perf_counter() - began < 20
    assert [(i, e <= 6) for _, i, _, _, e in got] == [(5, True), (77, True), (3000, True)]


def test_turns_of_places_give_the_same(monkeypatch):
    r = random.Random(3)
    items = [some(60, r).decode() for _ in range(40)]
    index = D.build([*enumerate(items), (99, items[0])])
    texts = [np.frombuffer((some(30, r).decode() + items[k] + some(50, r).decode()).encode(), np.uint8) for k in range(0, 40, 3)]
    want = D.search(texts, index)
    assert len(want) >= 15
    monkeypatch.setattr(D, "ENTRIES", 50)
    assert D.search(texts, index) == want
