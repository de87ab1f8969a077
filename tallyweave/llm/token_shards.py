"""Training-order materialisation of token ids (operator 9).

Texts become token ids.  The texts of a batch follow each other, each with an end
after it, and are cut into sequences of a fixed number of ids, so a sequence may hold
the end of one text and the beginning of the next, and only a batch's last sequence is
filled up.  All sequences are counted, so each has a number; a keyed Feistel permutation with
cycle-walking turns the number into the sequence's global slot, its place in
training order.  Slots are dealt by ranges: each range is one shard file, in
which every sequence takes the same number of bytes.  A reader finds slot s in
shard s // sequences-a-shard, and can begin or go on anywhere.

The ids are those of a byte-level BPE vocabulary of ranks and the first number that
it leaves free as the end, two bytes each (four where there are more ids than two
bytes tell apart), little-endian; the end also fills up a batch's last sequence.
Without a vocabulary the ids are the text's UTF-8 bytes and END (255, which no UTF-8
text holds), one byte each.  Texts are encoded once: the ids are written to the
shared folder with each batch's place in its task, and are counted, numbered and
dealt from there, however often a task runs and on whatever executors.  A manifest
beside the shards tells their layout, so any process can read on from any slot.

Defined results: a null text counts as empty; an empty text is an end alone; a text
of any length is stored whole, in as many sequences as it takes.  Repeated rows, and
equal texts, are each stored.  An empty table
gives no rows and no shards.  Only the id and text columns are read, so other
columns never clash.
"""

from __future__ import annotations

import base64
import json
import uuid
import zlib
from dataclasses import asdict, dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import PATTERN
from .common import grouped_by_bytes, shared_dir, spread, table, text_bytes, written
from .hashing import mix

#: Ids of a sequence, the id that ends a text, rounds of the permutation.
LENGTH, END, ROUNDS = 512, 255, 6

#: Bytes of a shard at most, until there are so many shards; beyond that shards grow with the data.
SHARD_BYTES, SHARDS = 16 << 20, 200_000

#: How ids are compressed until they are in their shard, where they are as they are.
CODEC, LEVEL = "zstd", 9

#: The queries' key of the permutation.
KEY = 20240229

#: Bytes of text that a worker takes at a time; ids that a task gathers before it deals them out.
BATCH_BYTES, GATHERED = 8 << 20, 12 << 20

MANIFEST = "manifest.json"


def codec() -> pa.Codec:
    return pa.Codec(CODEC, compression_level=LEVEL)


def default_path() -> str:
    """The file of ranks that the query uses."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=2)
def encoder(path: str):
    """One encoder for each worker process and file, and the end's id."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("shards", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), max(ranks.values()) + 1


def layout(path: str | None) -> tuple[int, str]:
    """The end's id, and numpy's name of an id's kind."""
    if not path:
        return END, "u1"
    end = encoder(path)[1]
    return end, "<u2" if end <= 0xFFFF else "<u4"


def encoded(rows: DataFrame, path: str | None, length: int) -> DataFrame:
    """The ids of all texts, written to the shared folder: a row for each batch of ``id`` and ``body``.

    Rows: the texts' ids, their numbers of token ids, all token ids compressed, the
    number of sequences, the task, and the task's sequences before these.  Strings of
    special tokens are ordinary text.
    """

    def run(batches):
        kind = layout(path)[1]
        encode = encoder(path)[0].encode_to_numpy if path else None
        task, before = TaskContext.get().partitionId(), 0
        for batch in grouped_by_bytes(batches, 1, BATCH_BYTES):
            if encode:
                tokens = [encode(t, disallowed_special=()).astype(kind) for t in batch.column(1).to_pylist()]
                n, ids = np.array([len(t) for t in tokens], np.int64), np.concatenate(tokens)
            else:
                ids, at = text_bytes(batch.column(1))
                n = np.diff(at)
            ends = pa.array(np.array([0, batch.num_rows], np.int32))
            lists = [pa.ListArray.from_arrays(ends, x) for x in (batch.column(0), pa.array(n))]
            data = codec().compress(ids.tobytes(), asbytes=True)
            own = -(-(len(ids) + len(n)) // length)
            yield pa.RecordBatch.from_arrays([*lists, pa.array([data], pa.binary()), pa.array([own]), pa.array([task]), pa.array([before])], ["id", "n", "ids", "sequences", "task", "before"])
            before += own

    kind = dict(rows.dtypes)["id"]
    return written(rows.mapInArrow(run, f"id array<{kind}>, n array<long>, ids binary, sequences long, task long, before long"), "token-ids")


@dataclass(frozen=True)
class Order:
    """A keyed permutation of the numbers below ``size``."""

    size: int
    key: int

    def slots(self, numbers: np.ndarray) -> np.ndarray:
        """The slot of each number."""
        half = max(1, (max(self.size - 1, 1).bit_length() + 1) // 2)
        low = np.uint64((1 << half) - 1)
        keys = mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(self.key))
        x = np.array(numbers, np.uint64)
        out = np.arange(len(x))
        # What falls beyond the size goes through again until it falls within.
        while len(out):
            left, right = x[out] >> np.uint64(half), x[out] & low
            for k in keys:
                left, right = right, left ^ (mix(right + k) & low)
            x[out] = left << np.uint64(half) | right
            out = out[x[out] >= self.size]
        return x.astype(np.int64)


def sequences(raw: np.ndarray, n: np.ndarray, length: int = LENGTH, end: int = END) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All sequences of the texts of a batch, as rows of ids, and the texts' parts in them.

    ``raw``: the ids of all texts, ``n``: how many each text has.  The parts come in
    order: each one's text, its sequence, and its number of ids (the end included).
    """
    stops = np.cumsum(n + 1)
    starts = stops - n - 1
    total = int(stops[-1]) if len(stops) else 0
    ids = np.full((-(-total // length), length), end, raw.dtype)
    flat, at = ids.reshape(-1), np.cumsum(n) - n
    for a, k, to in zip(at.tolist(), n.tolist(), starts.tolist()):
        flat[to : to + k] = raw[a : a + k]
    first = starts // length
    count = (stops - 1) // length - first + 1
    text = np.repeat(np.arange(len(n)), count)
    sequence = np.arange(len(text)) - np.repeat(np.cumsum(count) - count - first, count)
    size = np.minimum(stops[text], (sequence + 1) * length) - np.maximum(starts[text], sequence * length)
    return ids, text, sequence, size


@dataclass(frozen=True)
class Shards:
    """Where shards are and how they are laid out."""

    folder: str
    length: int
    total: int  # sequences
    each: int  # sequences of a shard; the last has what is left
    kind: str = "u1"  # of an id
    end: int = END
    key: int = 0  # of the permutation

    @classmethod
    def open(cls, folder: str) -> Shards:
        """The layout of the shards in a folder, by its manifest."""
        fs, root = pafs.FileSystem.from_uri(folder)
        with fs.open_input_file(f"{root}/{MANIFEST}") as f:
            return cls(folder, **json.loads(f.read()))

    def declare(self) -> None:
        """Make the folder and write the manifest."""
        fs, root = pafs.FileSystem.from_uri(self.folder)
        fs.create_dir(root, recursive=True)
        path = f"{root}/.{uuid.uuid4().hex}"
        with fs.open_output_stream(path) as out:
            out.write(json.dumps({k: v for k, v in asdict(self).items() if k != "folder"}).encode())
        fs.move(path, f"{root}/{MANIFEST}")

    @property
    def stride(self) -> int:
        """Bytes of a sequence."""
        return self.length * np.dtype(self.kind).itemsize

    def path(self, shard: int) -> str:
        return f"{self.folder}/shard-{shard:06d}.bin"

    def read(self, slot: int = 0, stop: int | None = None):
        """Sequences from a slot on, in training order."""
        stop = self.total if stop is None else min(stop, self.total)
        fs, root = pafs.FileSystem.from_uri(self.folder)
        while slot < stop:
            shard, place = divmod(slot, self.each)
            with fs.open_input_file(f"{root}/shard-{shard:06d}.bin") as f:
                f.seek(place * self.stride)
                for _ in range(min(self.each - place, stop - slot)):
                    yield np.frombuffer(f.read(self.stride), self.kind)
                    slot += 1


def _write(shards: Shards):
    """A task's shards from what all tasks have dealt out for them; a row for each part of a text.

    A shard is of bounded size and is put together in memory.  The file is
    written under a name of its own and then renamed, so a task that is run
    again, or twice at once, leaves the same whole file.
    """

    def shard_of(shard: int, rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        first = shard * shards.each
        size = min(shards.each, shards.total - first)
        ids = np.empty((size, shards.length), shards.kind)
        places, parts, names, part, size_of = (pa.concat_arrays([r.column(k).flatten() for r in rows]) for k in range(1, 6))
        places, parts, size_of = np.asarray(places).astype(np.int64), np.asarray(parts), np.asarray(size_of)
        if len(places) != size or not np.array_equal(np.sort(places), np.arange(size)):
            raise RuntimeError(f"shard {shard} has {len(places)} sequences of {size}")
        at = 0
        for r in rows:
            n = len(r.column(1).flatten())
            raw = codec().decompress(r.column(6)[0].as_buffer(), n * shards.stride)
            ids[places[at : at + n]] = np.frombuffer(raw, shards.kind).reshape(n, shards.length)
            at += n
        fs, root = pafs.FileSystem.from_uri(shards.folder)
        path = f"{root}/.{shard:06d}-{uuid.uuid4().hex}"
        with fs.open_output_stream(path) as out:
            out.write(memoryview(ids).cast("B"))
        fs.move(path, f"{root}/shard-{shard:06d}.bin")
        sums = np.array([zlib.crc32(ids[p]) for p in places.tolist()], np.int64)
        # Parts follow each other in their sequence.
        of, stops = np.repeat(np.arange(size), parts), np.cumsum(size_of)
        starts = stops - size_of
        starts = starts - starts[np.cumsum(parts) - parts][of]
        columns = [names, part, pa.array(starts.astype(np.int32)), pa.array(size_of), pa.array(places[of] + first), pa.array(np.full(len(of), shard)), pa.array(places[of]), pa.array(sums[of])]
        return pa.RecordBatch.from_arrays(columns, ["id", "part", "start", "n_ids", "slot", "shard", "place", "crc32"])

    def run(batches):
        now, rows = None, []
        for batch in batches:
            for k, shard in enumerate(batch.column(0).to_pylist()):
                if shard != now and rows:
                    yield shard_of(now, rows)
                    rows = []
                now = shard
                rows.append(batch.slice(k, 1))
        if rows:
            yield shard_of(now, rows)

    return run


def materialise(docs: DataFrame, folder: str, key: int, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, shard_bytes: int = SHARD_BYTES, path: str | None = None) -> tuple[DataFrame, Shards]:
    """A row for each part of a text in a sequence, which writes the shards when it is run, and their layout.

    ``path``: a file of ranks, present on every executor; bytes are the ids if left out.

    Rows: ``id_col``, ``part`` (of the text, from 0 on), ``start`` (in the sequence),
    ``n_ids``, ``slot``, ``shard``, ``place`` (in the shard) and ``crc32`` of the
    stored sequence.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body"))
    kind = dict(rows.dtypes)["id"]
    end, id_kind = layout(path)
    rows = encoded(rows, path, length)
    # A sum for each task that encoded is all that the driver gets.
    sums = {r["task"]: r["n"] for r in rows.groupBy("task").agg(F.sum("sequences").alias("n")).collect()}
    counts = np.array([sums.get(t, 0) for t in range(max(sums, default=-1) + 1)], np.int64)
    total = int(counts.sum())
    first = spark.sparkContext.broadcast(np.cumsum(counts) - counts)
    order = Order(total, key)
    stride = length * np.dtype(id_kind).itemsize
    shards = Shards(folder, length, total, max(1, shard_bytes // stride, -(-total // SHARDS)), id_kind, end, key)
    shards.declare()

    def cut(batches):
        """Of each row: its sequences' slots and ids, parts in each, and the parts' texts, numbers and sizes."""
        for batch in batches:
            for k in range(batch.num_rows):
                n = np.asarray(batch.column(1).slice(k, 1).flatten())
                raw = codec().decompress(batch.column(2)[k].as_buffer(), int(n.sum()) * np.dtype(id_kind).itemsize) if n.sum() else b""
                ids, text, sequence, size = sequences(np.frombuffer(raw, id_kind), n, length, end)
                begin = int(first.value[batch.column(4)[k].as_py()]) + batch.column(5)[k].as_py()
                slots = order.slots(np.arange(begin, begin + len(ids), dtype=np.uint64))
                part = np.arange(len(text)) - np.searchsorted(text, text)
                yield slots, ids, np.bincount(sequence, minlength=len(ids)), batch.column(0).slice(k, 1).flatten().take(pa.array(text)), part, size

    def deal(held):
        slots, ids, parts, names, part, size = zip(*held)
        slots, ids, parts, part, size = (np.concatenate(x) for x in (slots, ids, parts, part, size))
        names = pa.concat_arrays(names)
        # What goes to one shard goes together, for there it compresses.
        shard, place = np.divmod(slots, shards.each)
        by = np.argsort(shard, kind="stable")
        found, begin = np.unique(shard[by], return_index=True)
        # The parts of the sequences, in the same order.
        stops = np.cumsum(parts)
        count = parts[by]
        parts_by = np.repeat((stops - parts)[by] - (np.cumsum(count) - count), count) + np.arange(len(part))
        ends = np.append(begin, len(by))
        part_ends = np.append(0, np.cumsum(count))[ends]
        lists = [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(x[by].astype(np.int32))) for x in (place, parts)]
        lists += [pa.ListArray.from_arrays(pa.array(part_ends.astype(np.int32)), x) for x in (names.take(pa.array(parts_by)), *(pa.array(x[parts_by].astype(np.int32)) for x in (part, size)))]
        data = [codec().compress(ids[own].tobytes(), asbytes=True) for own in np.split(by, begin[1:])]
        return pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), *lists, pa.array(data, pa.binary())], ["shard", "place", "parts", "id", "part", "n_ids", "ids"])

    def run(batches):
        held, total_ids = [], 0
        for own in cut(batches):
            held.append(own)
            total_ids += own[1].size
            if total_ids >= GATHERED:
                yield deal(held)
                held, total_ids = [], 0
        if held:
            yield deal(held)

    pieces = rows.mapInArrow(run, f"shard int, place array<int>, parts array<int>, id array<{kind}>, part array<int>, n_ids array<int>, ids binary")
    dealt = pieces.repartitionById(max(1, -(-total // shards.each)), F.col("shard"))
    out = dealt.mapInArrow(_write(shards), f"id {kind}, part int, start int, n_ids int, slot long, shard long, place long, crc32 long")
    return out.withColumnRenamed("id", id_col), shards


def op9_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part of all documents with its place in training order; the shards lie in the shared folder."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return materialise(docs, f"{shared_dir(spark)}/token-shards-{uuid.uuid4().hex}", KEY, path=default_path())[0]


QUERIES = {"op9_shards": op9_shards}
