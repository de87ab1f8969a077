"""N-gram Jaccard join (operator 6): all links of 0.8 or more between sets of five-word shingles.

1. Every text becomes a set of hashed shingles; equal sets are one class from here on.
2. Size bands and segment keys (see ``shingles``) deal the classes into tiles.  A
   tile holds the sets that agree on one segment; linked sets share a tile.
   Classes that share tiles, directly or through others, are a family.
3. Families are dealt into blocks of bounded size.  Set sizes and the bits of hashed
   bitmaps bound the overlap of two sets from above.  Pairs that the bound lets
   through make smaller families; only for these are texts read again, and their
   sorted arrays intersected exactly.  Pairs that are already connected are passed
   over, for they change no component.  Of a family of many blocks each block is
   connected in itself, and then only what these links leave apart is compared
   across its blocks.
4. Components of the verified links, and the least id in each.

Defined results: null texts and texts without words have an empty set and link
with nothing, each is its own component.  Texts of one to four words have one
shingle, the whole.  Texts of any length are taken whole.  Repeated rows are copies
like others; of rows with null ids the component is the least id that is not null,
if any.  An empty table gives no rows.  Only the id and text columns are read, so
other columns never clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import grouped_by_bytes, release, spread, table, text_bytes, written
from .components import components
from .hashing import mix
from .shingles import PERCENT, bitmaps, enough, folded, overlap_bound, segment_keys, set_keys, sets_of

#: Bytes of text that a worker takes at a time.
BATCH_BYTES = 1 << 20

#: Segment keys that a task gathers before it deals them out.
GATHERED = 1 << 20

#: Sets, and shingles of all its sets, in a block of a tile or family.
BLOCK, BLOCK_SHINGLES = 256, 1 << 22

#: Blocks of a family up to which all pairs of blocks are compared at once; sets in a block of those that the links within blocks leave apart.
DIRECT, CROSS = 8, 1024

#: A set with more than this share of all rows as its copies is one of few, so it is sent to the copies and not they to it.
HOT_SHARE = 1 / 1000

#: Keys of classes that a task remembers, to deal out the segments of equal sets once.
REMEMBERED = 1 << 20

#: Bits of the filter that tells which texts have sets to compare; a text that it lets through in error is dropped by the join that follows.
FILTER_BITS = 1 << 23

_PAIR = np.dtype([("key", np.int64), ("set", np.int64)])


def _gathered(batches, parts: int):
    """Rows of documents, and segment keys with their set's key, dealt into parts."""
    names = ["part", "blob", "id", "n", "set", "bits"]
    seen: set[int] = set()
    keys, owners, size = [], [], 0

    def deal():
        pairs = np.empty(size, _PAIR)
        pairs["key"], pairs["set"] = np.concatenate(keys), np.concatenate(owners)
        part = (pairs["key"].view(np.uint64) >> np.uint64(20)) % np.uint64(parts)
        order = np.argsort(part, kind="stable")
        pairs, part = pairs[order], part[order]
        found, at = np.unique(part, return_index=True)
        blobs = [p.tobytes() for p in np.split(pairs, at[1:])]
        none = lambda kind: pa.nulls(len(found), kind)
        return pa.RecordBatch.from_arrays(
            [pa.array(found.astype(np.int32)), pa.array(blobs, pa.binary()), none(id_type), none(pa.int64()), none(pa.int64()), none(pa.binary())], names
        )

    id_type = pa.int64()
    for batch in batches:
        id_type = batch.schema.field(0).type
        for piece in grouped_by_bytes([batch], 1, BATCH_BYTES):
            hashes, at = sets_of(*text_bytes(piece.column(1)))
            own, n = set_keys(hashes, at), np.diff(at)
            new = np.zeros(len(n), bool)
            for k, key in enumerate(own.tolist()):
                if n[k] and key not in seen:
                    new[k] = True
                    seen.add(key)
            if len(seen) > REMEMBERED:
                seen.clear()
            kept = np.repeat(new, n)
            segments, of = segment_keys(hashes[kept], np.r_[0, np.cumsum(n[new])])
            keys.append(segments)
            owners.append(own[new][of])
            size += len(segments)
            part = np.arange(len(n), dtype=np.int64) % parts
            # A set's bits go along with the first of its copies in this task.
            bits = [row if x else None for row, x in zip(bitmaps(hashes, at), new)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part.astype(np.int32)), pa.nulls(len(n), pa.binary()), piece.column(0), pa.array(n), pa.array(own), pa.array(bits, pa.binary())], names
            )
            if size >= GATHERED:
                yield deal()
                keys, owners, size = [], [], 0
    if size:
        yield deal()


def _shared(pairs: np.ndarray) -> np.ndarray:
    """Tiles of two or more sets, each named by a hash of its sets: rows (tile, set, sets of the tile), tiles of the same sets once."""
    order = np.lexsort((pairs["set"], pairs["key"]))
    key, own = pairs["key"][order], pairs["set"][order]
    first = np.r_[True, (key[1:] != key[:-1]) | (own[1:] != own[:-1])]
    key, own = key[first], own[first]
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    count = np.diff(np.r_[starts, len(own)])
    name = mix(np.add.reduceat(mix(own.view(np.uint64)), starts) + count.astype(np.uint64)).view(np.int64)
    some = np.flatnonzero(count > 1)
    some = some[np.unique(name[some], return_index=True)[1]]
    count = count[some]
    place = np.repeat(starts[some] - (np.cumsum(count) - count), count) + np.arange(count.sum())
    return np.column_stack((np.repeat(name[some], count), own[place], np.repeat(count, count)))


def _tiles(batches):
    """Documents pass; segment keys of a part become tiles."""
    names = ["id", "n", "set", "bits", "label", "node", "m"]
    held: dict[int, list[bytes]] = {}
    id_type = pa.int64()
    for batch in batches:
        id_type = batch.schema.field(2).type
        docs = batch.filter(batch.column(1).is_null())
        if docs.num_rows:
            none = pa.nulls(docs.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*docs.columns[2:], none, none, none], names)
        for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if blob is not None:
                held.setdefault(part, []).append(blob)
    for part in list(held):
        rows = _shared(np.frombuffer(b"".join(held.pop(part)), _PAIR))
        if len(rows):
            none = pa.nulls(len(rows), pa.int64())
            columns = [pa.array(np.ascontiguousarray(rows[:, k])) for k in range(3)]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(rows), id_type), none, none, pa.nulls(len(rows), pa.binary()), *columns], names)
    release()


def _tokenised(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``id, n, set, bits`` of every document, and ``label, node, m`` of tiles, their sets and the number of these."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = dict(docs.dtypes)["id"]
    gathered = docs.mapInArrow(lambda batches: _gathered(batches, parts), f"part int, blob binary, id {kind}, n long, set long, bits binary")
    dealt = gathered.repartitionById(parts, F.col("part"))
    out = written(dealt.mapInArrow(_tiles, f"id {kind}, n long, set long, bits binary, label long, node long, m long"), "jaccard-tiles")
    return out.where("n IS NOT NULL").select("id", "n", "set", "bits"), out.where("label IS NOT NULL").select("label", "node", "m")


def _filter_of(ids: DataFrame) -> np.ndarray:
    """A bit for the hash of every id: FILTER_BITS of them, whatever the number of ids."""
    at = ids.select((F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS)) + 1).alias("p"))
    found = at.groupBy(F.bitmap_bucket_number("p").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("v"))
    bits = np.zeros(FILTER_BITS // 8 + 4096, np.uint8)
    for r in found.collect():
        at = (r["k"] - 1) * 4096
        bits[at : at + len(r["v"])] |= np.frombuffer(bytes(r["v"]), np.uint8)
    return bits


def _sets(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """``set, n, bits`` and sorted ``hashes``, as bytes, of the documents that the filter lets through."""

    def run(batches):
        for batch in batches:
            at = np.asarray(batch.column(2))
            batch = batch.filter(pa.array(bits[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1))
            for piece in grouped_by_bytes([batch], 1, BATCH_BYTES):
                hashes, ends = sets_of(*text_bytes(piece.column(1)))
                raw = [hashes[x:y].tobytes() for x, y in zip(ends, ends[1:])]
                signs = bitmaps(hashes, ends)
                yield pa.RecordBatch.from_arrays([pa.array(set_keys(hashes, ends)), pa.array(np.diff(ends)), pa.array(signs, pa.binary()), pa.array(raw, pa.binary())], ["set", "n", "bits", "hashes"])

    return docs.withColumn("p", F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS))).mapInArrow(run, "set long, n long, bits binary, hashes binary")


class _Joined:
    """Union and find over places."""

    def __init__(self, of: np.ndarray):
        self.of = of

    def unite(self, a: int, b: int) -> None:
        x, y = self.of[a], self.of[b]
        self.of[self.of == max(x, y)] = min(x, y)


def links(sizes: np.ndarray, bits: np.ndarray, hashes: list[np.ndarray] | None = None, across: int | None = None, known: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Pairs of places whose sets link, as many as connect all that links connect.

    Without ``hashes``: pairs that may link, by their sizes and bits.
    ``across``: only pairs between places before and from it on.
    ``known``: a number for each place; places of one number are connected already.
    """
    n = len(sizes)
    joined, found = _Joined(np.arange(n) if known is None else np.unique(known, return_inverse=True)[1]), []
    common = lambda i, j: len(np.intersect1d(hashes[i], hashes[j], assume_unique=True))
    for i in range(n if across is None else across):
        rest = np.arange(i + 1 if across is None else across, n)
        rest = rest[joined.of[rest] != joined.of[i]]
        rest = rest[np.minimum(sizes[rest], sizes[i]) * 100 >= PERCENT * np.maximum(sizes[rest], sizes[i])]
        if len(rest):
            rest = rest[enough(overlap_bound(bits[i], sizes[i], bits[rest], sizes[rest]), sizes[i], sizes[rest])]
        for j in rest.tolist():
            if joined.of[i] != joined.of[j] and (hashes is None or enough(common(i, j), sizes[i], sizes[j])):
                found.append((i, j))
                joined.unite(i, j)
    return found


class _Forest:
    """Union and find over the sets of a task; a tree's root is its least set."""

    def __init__(self):
        self.above: dict[int, int] = {}

    def root(self, x: int) -> int:
        path = []
        while (y := self.above.get(x, x)) != x:
            path.append(x)
            x = y
        for y in path:
            self.above[y] = x
        return x

    def unite(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.above[max(a, b)] = min(a, b)

    def edges(self) -> pa.RecordBatch:
        """Each set that is no root, and its root; begins anew."""
        nodes = list(self.above)
        roots = [self.root(x) for x in nodes]
        self.above = {}
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(roots, pa.int64())], ["a", "b"])


def _connected(batches):
    """What blocks connect, as edges from sets to the least one of their tree, one tree for all blocks of a task.

    Rows ``family, i, j, side, set, n, bits, hashes, known`` come sorted by block.
    """
    now, rows, forest = None, [], _Forest()

    def connect():
        rows.sort(key=lambda r: (r[0], r[1]))
        sides = [r[0] for r in rows]
        bits = folded([r[3] for r in rows])
        hashes = None if rows[0][4] is None else [np.frombuffer(r[4], np.uint64) for r in rows]
        known = None if rows[0][5] is None else np.array([r[5] for r in rows])
        for a, b in links(np.array([r[2] for r in rows]), bits, hashes, sides.count(0) if 1 in sides else None, known):
            forest.unite(rows[a][1], rows[b][1])

    for batch in batches:
        for family, i, j, *row in zip(*(column.to_pylist() for column in batch.columns)):
            if (family, i, j) != now:
                if len(rows) > 1:
                    connect()
                    if len(forest.above) > REMEMBERED:
                        yield forest.edges()
                now, rows = (family, i, j), []
            rows.append(row)
    if len(rows) > 1:
        connect()
    if forest.above:
        yield forest.edges()
    release()


def _blocks_connected(sets: DataFrame, dealt: DataFrame) -> DataFrame:
    """Edges ``a, b`` within blocks; ``dealt``: ``set, family, i, j, side, known``."""
    n = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = sets.join(dealt, "set").select("family", "i", "j", "side", "set", "n", "bits", "hashes", "known")
    return rows.repartition(n, "family", "i", "j").sortWithinPartitions("family", "i", "j").mapInArrow(_connected, "a long, b long")


def _paired(own: DataFrame, at: Column, others: Column, known: Column) -> DataFrame:
    """``set, family, i, j, side, known`` of every set for each pair of blocks of its family that its block, ``at``, is in; ``others``: the blocks paired with it."""
    rows = own.select(F.col("node").alias("set"), F.col("label").alias("family"), at.cast("int").alias("at"), F.explode(others).alias("other"), known.alias("known"))
    return rows.select("set", "family", F.least("at", "other").alias("i"), F.greatest("at", "other").alias("j"), F.when(F.col("at") > F.col("other"), 1).otherwise(0).alias("side"), "known")


def _linked(sets: DataFrame, member: DataFrame, tag: str) -> DataFrame:
    """``node, label`` of all sets that links within tiles or families connect; no link is lost.

    ``member``: ``label, node, blocks`` of families, their sets and the number of
    blocks that each family is dealt into.  All pairs of up to DIRECT blocks are
    compared.  Families of more blocks are dealt into blocks twice, at random each
    time, and what blocks connect is contracted.  Where that leaves a family in
    several components, all sets outside its largest component are compared with the
    whole family.
    """
    is_large = bool(member.where(F.col("blocks") > DIRECT).take(1))
    member = member.distinct()
    none = F.lit(None).cast("long")
    block = lambda turn=0: F.pmod(F.xxhash64("node", "label", F.lit(turn)), F.col("blocks"))
    direct = F.when(F.col("blocks") <= 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = _paired(member.where(F.col("blocks") <= DIRECT), block(), direct, none)
    if not is_large:
        return components(written(_blocks_connected(sets, dealt), f"{tag}-edges"))
    large = member.where(F.col("blocks") > DIRECT)
    turns = F.explode(F.array(*[F.struct(block(turn).cast("int").alias("i"), F.lit(turn).alias("turn")) for turn in (0, 1)]))
    alone = large.select("node", "label", turns.alias("p")).select(F.col("node").alias("set"), F.col("label").alias("family"), F.col("p.i").alias("i"), (-1 - F.col("p.turn")).alias("j"), F.lit(0).alias("side"), none.alias("known"))
    first = components(written(_blocks_connected(sets, dealt.unionByName(alone)), f"{tag}-edges"))
    # Families of many blocks that are still in several components.
    own = written(large.join(first.withColumnRenamed("label", "part"), "node", "left").withColumn("part", F.coalesce("part", "node")), f"{tag}-large")
    parts = own.groupBy("label", "part").agg(F.count("*").alias("m"))
    parts = parts.groupBy("label").agg(F.max(F.struct("m", "part")).alias("most"), F.sum("m").alias("m"), F.count("*").alias("parts")).where("parts > 1")
    apart = written(parts.select("label", F.col("most.part").alias("main"), F.ceil(F.col("most.m") / CROSS).cast("int").alias("mains"), F.ceil((F.col("m") - F.col("most.m")) / CROSS).cast("int").alias("others")), f"{tag}-apart")
    if apart.isEmpty():
        return first
    own = own.join(apart, "label")
    main, place = F.col("part") == F.col("main"), F.xxhash64("node", "label")
    at = F.when(main, F.col("others") + F.pmod(place, F.col("mains"))).otherwise(F.pmod(place, F.col("others")))
    last = F.when(main, F.col("others") - 1).otherwise(F.col("others") + F.col("mains") - 1)
    more = _blocks_connected(sets, _paired(own, at, F.sequence(F.lit(0), last), F.col("part")))
    return components(written(more.unionByName(first.select(F.col("node").alias("a"), F.col("label").alias("b"))), f"{tag}-edges"))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return spread(docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body")))


def _groups(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``id, n, set`` of every document; ``set, least, copies, label`` of every set that is not empty: its least id, its rows and its component."""
    known, tiles = _tokenised(rows)
    signed = known.where("bits IS NOT NULL").dropDuplicates(["set"]).select("set", "n", "bits", F.lit(None).cast("binary").alias("hashes"))
    families = _linked(signed, tiles.select("label", "node", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks")), "jaccard-bounded")
    # A set's least id and its family; the family's blocks are bounded by sets and by shingles.
    chosen = known.where("bits IS NOT NULL").join(families.withColumnRenamed("node", "set"), "set").groupBy("set").agg(F.min("id").alias("id"), F.max("n").alias("n"), F.max("label").alias("label"))
    chosen = written(chosen, "jaccard-chosen")
    sets = _sets(rows, _filter_of(chosen.select("id"))).dropDuplicates(["set"])
    weight = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int")
    member = chosen.select("label", F.col("set").alias("node")).join(chosen.groupBy("label").agg(weight.alias("blocks")), "label")
    joined = _linked(sets, member, "jaccard-links")
    known = known.select("id", "n", "set")
    classes = known.where("n > 0").groupBy("set").agg(F.min("id").alias("least"), F.count("*").alias("copies"))
    return known, classes.join(joined.select(F.col("node").alias("set"), "label"), "set", "left").withColumn("label", F.coalesce("label", "set"))


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_shingles`` and ``component_id`` of every row."""
    known, group = _groups(_rows(docs, id_col, text_col))
    component = group.join(group.groupBy("label").agg(F.min("least").alias("component_id")), "label").select("set", "copies", "component_id")
    component = written(component, "jaccard-components")
    # Copies of one text may be a third of all rows.  Sets with so many copies are 1 / HOT_SHARE at most, and are broadcast.
    hot = F.broadcast(component.where(F.col("copies") > max(1, int(known.count() * HOT_SHARE))).select("set", "component_id"))
    some = known.where("n > 0")
    out = some.join(hot, "set").unionByName(some.join(hot.select("set"), "set", "left_anti").join(component.drop("copies"), "set"))
    out = out.select("id", "n", "component_id").unionByName(known.where("n = 0").select("id", "n", F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, of which one stays of each component: the one with the least id.

    Rows with an empty set all stay.  Of rows with equal id and set one stays; of
    a component without ids, one.  Only rows whose id may be that of a row to go
    are joined; a filter of fixed size lets all others pass where they are.
    """
    rows = _rows(docs, id_col, text_col)
    known, group = _groups(rows)
    first = group.groupBy("label").agg(F.min(F.struct(F.col("least").isNull(), "least", "set")).alias("k")).select(F.col("k.least").alias("id"), F.col("k.set").alias("set"))
    stays = written(first, "jaccard-stays")
    counted = known.where("n > 0").groupBy("id", "set").agg(F.count("*").alias("c"))
    other = (F.col("s.set").isNull()) | (F.col("c") > 1)
    goes = counted.alias("k").join(stays.alias("s"), F.expr("k.id <=> s.id AND k.set = s.set"), "left").where(other).select("k.id").distinct()
    bits = _filter_of(written(goes, "jaccard-goes"))
    at = docs.columns.index(text_col)
    place = len(docs.columns)

    def split(hit: bool):
        def run(batches):
            for batch in batches:
                p = np.asarray(batch.column(place))
                batch = batch.filter(pa.array((bits[p >> 3] >> (p & 7).astype(np.uint8) & 1 == 1) == hit))
                if not hit:
                    yield batch.select(range(place))
                    continue
                for piece in grouped_by_bytes([batch], at, BATCH_BYTES):
                    hashes, ends = sets_of(*text_bytes(piece.column(at)))
                    yield pa.RecordBatch.from_arrays([*piece.columns[:place], pa.array(set_keys(hashes, ends)), pa.array(np.diff(ends))], names=[*piece.schema.names[:place], "_set", "_n"])

        return run

    marked = docs.withColumn("_place", F.pmod(F.xxhash64(id_col), F.lit(FILTER_BITS)))
    passed = marked.mapInArrow(split(False), docs.schema)
    held = marked.mapInArrow(split(True), T.StructType([*docs.schema.fields, T.StructField("_set", T.LongType()), T.StructField("_n", T.LongType())]))
    alone = held.where("_n = 0").drop("_set", "_n")
    one = held.where("_n > 0").dropDuplicates([id_col, "_set"])
    kept = one.join(stays.select(F.col("id").alias("_id"), F.col("set").alias("_set2")), F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("_set") == F.col("_set2")), "left_semi")
    return passed.unionByName(alone).unionByName(kept.drop("_set", "_n"))


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return jaccard_join(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op6_jaccard": op6_jaccard}

#: All pairs of documents that share a shingle; takes whole tables of some ten thousand documents.
ORACLE_SQL = {
    "op6_jaccard": """
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g
  FROM split),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN least ON least.a = d.doc_id"""
}
