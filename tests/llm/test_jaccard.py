import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from oracle_check import connect, same

from tallyweave.llm import jaccard
from tallyweave.llm.common import text_bytes
from tallyweave.llm.shingles import bands, bitmaps, enough, folded, overlap_bound, segment_keys, sets_of

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else [])


def brute(rows):
    """n_shingles and component of each (id, text), all pairs compared."""
    sets = [(i, shingles(t)) for i, t in rows]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                parent[root(a)] = root(b)
    least = defaultdict(list)
    for k, (i, _) in enumerate(sets):
        least[root(k)].append(i)
    least = {r: min((i for i in ids if i is not None), default=None) for r, ids in least.items()}
    return sorted(((i, len(s), least[root(k)]) for k, (i, s) in enumerate(sets)), key=str)


def near_copies(n, words, seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    out = []
    while len(out) < n:
        base = [word() for _ in range(r.choice(words))]
        out.append(base)
        for _ in range(r.randrange(5)):
            own = list(r.choice(out[-3:]))
            for _ in range(max(1, len(own) // r.choice([20, 40, 80]))):
                own[r.randrange(len(own))] = word()
            out.append(own)
    return [" ".join(w).upper() if r.random() < 0.2 else "  ".join(w) for w in out[:n]]


@pytest.mark.parametrize("words", [[1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 15], [20, 28, 33, 40], [100, 300, 700]])
def test_components_equal_brute_force(spark, words):
    rows = list(enumerate(near_copies(150, words, len(words))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_join(df).collect()), key=str)
    assert got == brute(rows)


def test_linked_sets_share_a_key():
    texts = near_copies(500, [1, 4, 5, 6, 9, 14, 22, 30, 50, 120, 400], 9)
    hashes, at = sets_of(*text_bytes(pa.array(texts)))
    own = [hashes[a:b] for a, b in zip(at, at[1:])]
    keys, of = segment_keys(hashes, at)
    held = [set(keys[of == k].tolist()) for k in range(len(own))]
    links = 0
    for a in range(len(own)):
        for b in range(a):
            common = len(np.intersect1d(own[a], own[b]))
            if common and common < len(own[a]) and enough(common, len(own[a]), len(own[b])):
                links += 1
                assert held[a] & held[b]
    assert links > 20
    low, most, segments = bands()
    assert (np.diff(low) > 0).all() and (segments > most).all()


def test_bound_is_above():
    hashes, at = sets_of(*text_bytes(pa.array(near_copies(80, [30, 400, 2000], 2))))
    bits, sizes = folded(bitmaps(hashes, at)), np.diff(at)
    for k in range(len(sizes)):
        bound = overlap_bound(bits[k], sizes[k], bits, sizes)
        true = [len(np.intersect1d(hashes[at[k] : at[k + 1]], hashes[at[j] : at[j + 1]])) for j in range(len(sizes))]
        assert (bound >= true).all()


def test_blocks(spark, monkeypatch):
    """Tiles of many blocks give the same components."""
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    r = random.Random(4)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(40):
        own = list(base)
        own[r.randrange(120)] = f"x{k}"
        rows.append((k, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_join(df).collect()), key=str)
    assert got == brute(rows)


def test_odd_texts(odd, none):
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_join(odd).collect()), key=str)
    assert got == brute([(r["doc_id"], r["text"]) for r in odd.collect()])
    assert jaccard.jaccard_join(none).count() == 0


def test_keep_one(odd, none):
    kept = jaccard.keep_one(odd)
    assert kept.columns == odd.columns
    rows = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    want = [(k, r["text"]) for k, r in enumerate(odd.where("doc_id IS NOT NULL").orderBy("doc_id").dropDuplicates(["doc_id"]).orderBy("doc_id").collect()) if k != 6]
    assert rows == sorted(want, key=str)
    assert jaccard.keep_one(none).count() == 0


def test_query_equals_sql(spark):
    sf_dir = "/root/testdata/sf0.01"
    same(jaccard.op6_jaccard(spark, sf_dir), connect(sf_dir), jaccard.ORACLE_SQL["op6_jaccard"])


def one_group(n, words=300, seed=6):
    """Near copies of one text, each with one word of its own."""
    r = random.Random(seed)
    base = [f"w{k}" for k in range(words)]
    rows = []
    for k in range(n):
        own = list(base)
        own[r.randrange(words)] = f"x{k}"
        rows.append((k, " ".join(own)))
    return rows


@pytest.mark.parametrize("direct", [2, 100])
def test_edges_of_a_large_group_follow_its_sets(spark, monkeypatch, direct):
    """Blocks of 1,200 near copies give a few edges for each set, not one for each pair or tile, and the group is one component."""
    monkeypatch.setattr(jaccard, "DIRECT", direct)
    seen = []
    plain = jaccard.components
    monkeypatch.setattr(jaccard, "components", lambda edges: seen.append(edges.count()) or plain(edges))
    df = spark.createDataFrame(one_group(1200, 120), "doc_id long, text string").repartition(8)
    got = jaccard.jaccard_join(df).collect()
    assert {r["component_id"] for r in got} == {0} and len(got) == 1200
    assert seen and max(seen) <= 8 * 1200


def test_sets_that_blocks_leave_apart(spark, monkeypatch):
    """Chains of links between sets that lie in different blocks are found across them."""
    monkeypatch.setattr(jaccard, "BLOCK", 2)
    monkeypatch.setattr(jaccard, "DIRECT", 2)
    monkeypatch.setattr(jaccard, "CROSS", 3)
    rows = []
    for chain in range(3):
        words = [f"c{chain}w{k}" for k in range(400)]
        for k in range(14):
            # Each differs from the one before by some words, so that the ends of a chain do not link.
            rows.append((100 * chain + k, " ".join(words)))
            words = words[:]
            words[k * 25 : k * 25 + 12] = [f"c{chain}n{k}v{x}" for x in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_join(df).collect()), key=str)
    assert got == brute(rows)


def test_hot_copies_and_empty_texts(spark):
    """Copies that are a third of all rows, and empty texts that are another, get their components."""
    texts = ["a b c d e f g", "", None]
    rows = [(k, texts[k % 3] if k % 4 else f"only {k} one two three four") for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_join(df).collect()}
    for k, t in rows:
        assert got[k] == ((3, 3) if t == texts[0] else (0, k) if not t else (2, k))
