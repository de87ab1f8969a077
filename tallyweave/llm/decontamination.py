"""Benchmark decontamination by q-gram lemma filtering (operator 3).

Texts are lower-cased and only letters, digits and bytes beyond ASCII are kept.
A benchmark item of m bytes that stands in a document with at most e edits
shares m + 1 - q * (1 + e) of its q-grams with it, all within e diagonals.  So
shared q-grams are counted in overlapping diagonal bands; regions that reach
the bound are kept.  The same lemma with shorter q-grams, which a bitmap of the
region answers, leaves out regions that hold only what an item shares with other
items, and what is left is verified by banded alignment.  Items of fewer than Q kept
bytes have no q-gram: they are looked for exactly, from a word's beginning to a
word's end.

Defined results: one row for each document and item found in it, with the
region of the fewest edits (of ties the first), so clean documents have no row.
Null and empty texts contain nothing; texts of any length are searched whole.  Null
items, and items without a kept byte, are in no document.  Repeated rows of either
table give repeated rows.  An empty benchmark, or no documents, give no rows.  Only
the named columns are read, so other columns never clash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filter_texts, grouped_by_bytes, spread, table, written

#: Bytes of a q-gram, of the shorter ones of the second bound, and edits for each byte of an item.
Q, FINE, EDITS = 10, 4, 0.08

#: Bytes of an index that is broadcast, about, and of the index for each byte of text; a larger benchmark is searched for in several turns.
INDEX_BYTES, INDEX_FACTOR = 64 << 20, 28

#: Places of items that are counted at a time.
ENTRIES = 2 << 20

#: Bytes of text that a worker takes at a time.
BATCH_BYTES = 2 << 20

_KEPT = np.zeros(256, bool)
_KEPT[128:] = True
_KEPT[[*range(48, 58), *range(97, 123)]] = True

#: Bits of the table that tells which hashes of q-grams the benchmark may have.
_TABLE_BITS = 22


def normal(text: str) -> np.ndarray:
    """The kept bytes of a lower-cased text."""
    raw = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)
    return raw[_KEPT[raw]]


def word_starts(text: str) -> np.ndarray:
    """Whether each kept byte is the first of a run of kept bytes."""
    kept = _KEPT[np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)]
    return (kept & ~np.r_[False, kept[:-1]])[kept]


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """A hash of the Q bytes from every place on."""
    n = len(raw) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    raw = np.ascontiguousarray(raw)
    eight = lambda at: np.ndarray((n,), np.uint64, raw, at, (1,))
    h = eight(0) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h += eight(Q - 8)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h


def fine_hashes(raw: np.ndarray) -> np.ndarray:
    """A number below 2^16 for the FINE bytes from every place on."""
    n = len(raw) - FINE + 1
    if n <= 0:
        return np.zeros(0, np.uint16)
    four = np.ndarray((n,), np.uint32, np.ascontiguousarray(raw), 0, (1,))
    return (four * np.uint32(2654435761) >> np.uint32(16)).astype(np.uint16)


@dataclass
class Index:
    """Q-grams of benchmark items."""

    ids: list
    texts: list[np.ndarray]
    edits: np.ndarray
    least: np.ndarray  # q-grams that a region shares at least
    table: np.ndarray
    hashes: np.ndarray  # distinct, rising
    first: np.ndarray  # where each hash's entries begin
    item: np.ndarray  # rising for each hash
    place: np.ndarray
    fine: np.ndarray  # numbers of all FINE-grams of all items
    fine_at: np.ndarray  # where each item's begin
    short: dict[bytes, list]  # ids of the items of fewer than Q bytes


def budget(m: int) -> int:
    """Edits that an item of m bytes may have, few enough that the bound is 1 at least."""
    return max(0, min(int(m * EDITS), m // Q - 1))


def build(items: list[tuple[object, str]]) -> Index:
    kept = [(i, normal(t)) for i, t in items if t]
    short: dict[bytes, list] = {}
    for i, t in kept:
        if 0 < len(t) < Q:
            short.setdefault(t.tobytes(), []).append(i)
    pairs = [(i, t) for i, t in kept if len(t) >= Q]
    ids, texts = [i for i, _ in pairs], [t for _, t in pairs]
    edits = np.array([budget(len(t)) for t in texts], np.int64)
    least = np.array([len(t) + 1 - Q * (1 + e) for t, e in zip(texts, edits)], np.int64)
    grams = [gram_hashes(t) for t in texts]
    fine = [fine_hashes(t) for t in texts]
    flat = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
    item = np.repeat(np.arange(len(texts)), [len(g) for g in grams]).astype(np.int32)
    place = np.concatenate([np.arange(len(g), dtype=np.int32) for g in grams]) if grams else np.zeros(0, np.int32)
    order = np.argsort(flat, kind="stable")
    hashes, first = np.unique(flat[order], return_index=True)
    found = np.zeros(1 << _TABLE_BITS, bool)
    found[hashes >> np.uint64(64 - _TABLE_BITS)] = True
    return Index(
        ids, texts, edits, least, found, hashes, np.append(first, len(flat)), item[order], place[order],
        np.concatenate(fine) if fine else np.zeros(0, np.uint16), np.cumsum([0, *map(len, fine)]), short,
    )


def align(item: np.ndarray, region: np.ndarray, most: int) -> tuple[int, int, int] | None:
    """Fewest edits between an item and a part of a region, and where that part begins and ends.

    Alignments leave a band of diagonals, as wide as the region is longer than
    the item, by no more than ``most``; more than ``most`` edits are none.
    """
    m, n = len(item), len(region)
    low, width = -most, max(0, n - m) + 2 * most + 1  # diagonals low .. low + width - 1, place in region minus place in item
    steps = np.arange(width)
    far = m + n + 1
    # Column k of row i stands for place i + low + k of the region; costs and beginnings go together in one number.
    where = low + steps
    now = np.where((where >= 0) & (where <= n), where, far * (n + 2))
    size = n + 2
    for i in range(1, m + 1):
        where = i + low + steps
        inside = (where >= 0) & (where <= n)
        letter = region[np.clip(where - 1, 0, n - 1)] if n else np.zeros(width, np.uint8)
        match = np.where((where >= 1) & (where <= n), now + np.where(letter == item[i - 1], 0, size), far * size)
        drop = np.append(now[1:], far * size) + size
        best = np.minimum(match, drop)
        best[~inside] = far * size
        now = np.minimum.accumulate(best - steps * size) + steps * size
        now[~inside] = far * size
        if now.min() >= (most + 1) * size:
            return None
    k = int(now.argmin())
    edits, begin = divmod(int(now[k]), size)
    return (edits, begin, m + low + k) if edits <= most else None


def _shared_places(index: Index, at: np.ndarray, k: np.ndarray):
    """Places ``at`` of shared q-grams, numbers ``k`` of their hashes, in turns of whole items: place, item and place in the item of each."""
    total = int((index.first[k + 1] - index.first[k]).sum())
    turns = max(1, -(-total // ENTRIES))
    for turn in range(turns):
        first, item, place = index.first, index.item, index.place
        if turns > 1:
            own = item % turns == turn
            first, item, place = np.append(0, np.cumsum(own))[first], item[own], place[own]
        count = first[k + 1] - first[k]
        entry = np.repeat(first[k] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        yield np.repeat(at, count), item[entry].astype(np.int64), place[entry]


def _fine_enough(index: Index, fine: np.ndarray, item: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Whether an item's FINE-grams may stand in a region often enough for its edits.

    A region lies in one window of twice a power of two, and of all regions in a
    window the items' grams are looked up in one bitmap.  What else is in the window
    can only add to the count, so no region that the lemma keeps is lost.
    """
    width = 1 << np.ceil(np.log2(np.maximum(hi - lo, 64))).astype(np.int64)
    size = index.fine_at[item + 1] - index.fine_at[item]
    need = size - FINE * index.edits[item]
    kept = np.zeros(len(item), bool)
    order = np.lexsort((lo // width, width))
    cut = np.flatnonzero((np.diff(width[order]) != 0) | (np.diff((lo // width)[order]) != 0)) + 1
    for own in np.split(order, cut):
        w = int(width[own[0]])
        begin = int(lo[own[0]]) // w * w
        there = np.zeros(1 << 16, bool)
        there[fine[begin : begin + 2 * w]] = True
        ends = np.cumsum(size[own])
        grams = np.repeat(index.fine_at[item[own]] - (ends - size[own]), size[own]) + np.arange(ends[-1])
        kept[own] = np.add.reduceat(there[index.fine[grams]].astype(np.int64), ends - size[own]) >= need[own]
    return kept


def _regions(index: Index, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, grams: np.ndarray):
    """Text, item, start and stop (in ``raw``) of every region that the lemma keeps, a text's and item's in rising order."""
    at = np.flatnonzero(index.table[grams >> np.uint64(64 - _TABLE_BITS)])
    k = np.searchsorted(index.hashes, grams[at])
    k[k == len(index.hashes)] = 0
    true = index.hashes[k] == grams[at]
    at, k = at[true], k[true]
    if not len(at):
        return
    fine = fine_hashes(raw)
    for place, item, inside in _shared_places(index, at, k):
        band = (place - inside) // (index.edits[item] + 1)
        # A band is two steps wide, and begins a step after the one before.
        keys = np.concatenate((item << 40 | band + 1, item << 40 | band)) + (1 << 20)
        found, shared = np.unique(keys, return_counts=True)
        found -= 1 << 20
        item, band = found >> 40, (found & (1 << 40) - 1) - 1
        enough = shared >= index.least[item]
        item, band = item[enough], band[enough]
        e, m = index.edits[item], index.fine_at[item + 1] - index.fine_at[item] + FINE - 1
        first, last = band * (e + 1) - e, (band + 2) * (e + 1) + m + e
        # The region lies in the texts that it touches, one after another.
        low = np.searchsorted(ends, np.maximum(first, 0), side="right")
        count = np.maximum(np.searchsorted(starts, last, side="left") - low, 0)
        text = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())
        item, e, m = (np.repeat(x, count) for x in (item, e, m))
        lo, hi = np.maximum(np.repeat(first, count), starts[text]), np.minimum(np.repeat(last, count), ends[text] - 1)
        some = hi - lo >= m - e
        text, item, lo, hi = text[some], item[some], lo[some], hi[some]
        if not len(text):
            continue
        some = _fine_enough(index, fine, item, lo, hi)
        order = np.lexsort((lo[some], item[some], text[some]))
        yield from zip(*(x[some][order].tolist() for x in (text, item, lo, hi)))


def search(texts: list[np.ndarray], index: Index) -> list[tuple[int, int, int, int, int]]:
    """Text, item, start, stop and edits of each item found in each text; places are among the kept bytes."""
    if not index.ids or not texts:
        return []
    ends = np.cumsum([len(t) + 1 for t in texts])
    starts = ends - [len(t) + 1 for t in texts]
    raw = np.zeros(ends[-1], np.uint8)
    for t, s in zip(texts, starts):
        raw[s : s + len(t)] = t
    out: dict[tuple[int, int], tuple[int, int, int]] = {}
    for t, i, lo, hi in _regions(index, raw, starts, ends, gram_hashes(raw)):
        best = out.get((t, i))
        # Regions come in rising order, so a whole match is not beaten by a later one.
        if best and not best[0]:
            continue
        if hit := align(index.texts[i], raw[lo:hi], best[0] if best else int(index.edits[i])):
            s = lo - int(starts[t])
            new = (hit[0], s + hit[1], s + hit[2])
            out[t, i] = min(best or new, new)
    return [(t, i, s, p, e) for (t, i), (e, s, p) in sorted(out.items())]


def search_short(text: str, index: Index) -> list[tuple[object, int, int]]:
    """Id, start and stop of each short item in a text: the first place of each."""
    if not index.short:
        return []
    raw = normal(text).tobytes()
    first = np.flatnonzero(word_starts(text))
    stops = set([*first.tolist(), len(raw)])
    found: dict[bytes, int] = {}
    sizes = sorted({len(k) for k in index.short})
    for a in first.tolist():
        for n in sizes:
            if a + n in stops and (part := raw[a : a + n]) in index.short:
                found.setdefault(part, a)
    return [(i, a, a + len(part)) for part, a in found.items() for i in index.short[part]]


def hits(texts: list[str | None], index: Index) -> list[tuple[int, object, int, int, int]]:
    """Text's number, item's id, start, stop and edits of every item in every text."""
    found = [(t, index.ids[i], s, p, e) for t, i, s, p, e in search([normal(t or "") for t in texts], index)]
    if index.short:
        found += [(k, i, s, p, 0) for k, t in enumerate(texts) if t for i, s, p in search_short(t, index)]
    return found


def indexes(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text"):
    """The number of indexes over the benchmark, each of about INDEX_BYTES at most, or of one item, and the indexes in turn."""
    rows = benchmark.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("body")).where("body IS NOT NULL")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("body")), F.lit(0)).alias("n")).first()["n"] * INDEX_FACTOR
    # Parts differ in size, so more than one are planned half full.
    turns = -(-2 * size // INDEX_BYTES) if size > INDEX_BYTES else 1

    def each():
        for k in range(turns):
            part = rows.where(F.pmod(F.xxhash64("id", "body"), F.lit(turns)) == k) if turns > 1 else rows
            yield build([(r["id"], r["body"]) for r in part.orderBy("id", "body").collect()])

    return turns, each()


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``id_col``, ``item_col``, ``start``, ``stop`` and ``edits`` of every item in every document."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("body"))
    kinds = dict(rows.dtypes)["id"], dict(benchmark.dtypes)[item_col]
    out = None
    turns, each = indexes(benchmark, item_col, item_text_col)
    for index in each:
        held = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, held=held):
            own = held.value
            for batch in grouped_by_bytes(batches, 1, BATCH_BYTES):
                found = hits(batch.column(1).to_pylist(), own)
                if found:
                    t, i, s, p, e = zip(*found)
                    numbers = [pa.array(x, pa.int64()) for x in (s, p, e)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(t)), pa.array(i), *numbers], ["id", "item", "start", "stop", "edits"])

        part = rows.mapInArrow(run, f"id {kinds[0]}, item {kinds[1]}, start long, stop long, edits long")
        if turns > 1:
            # One index at a time is in the executors' memory.
            part = written(part, "contamination")
            held.unpersist()
        out = part if out is None else out.unionByName(part)
    return out.withColumnsRenamed({"id": id_col, "item": item_col})


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, that contain no item."""
    turns, each = indexes(benchmark, item_col, item_text_col)
    for index in each:
        held = docs.sparkSession.sparkContext.broadcast(index)

        def keep(texts, held=held):
            clean = np.ones(len(texts), bool)
            clean[[hit[0] for hit in hits(texts.to_pylist(), held.value)]] = False
            return clean

        docs = filter_texts(docs, text_col, keep, BATCH_BYTES)
        if turns > 1:
            docs = written(docs, "clean")
            held.unpersist()
    return docs


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items in all documents."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return find_contamination(docs, table(spark, sf_dir, "benchmark"))


QUERIES = {"op3_decontamination": op3_decontamination}
