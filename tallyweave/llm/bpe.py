"""BPE encoding and decoding with forced boundaries (operator 1).

A byte pair that stands inside no vocabulary token can never be merged, nor can
any larger merge cross it: such a pair marks a certain cut.  A text is split by
the tokenizer's own pattern and at its certain cuts; every fragment is encoded
by itself and the ids are concatenated.  Fragments repeat often, so each worker
keeps a bounded memo of them.

Defined results: a null text counts as empty; an empty text has no ids, and
decodes to the empty text.  Repeated rows give equal rows.  Only the id and text
columns are read, so other columns never clash.  An empty table gives no rows.
"""

from __future__ import annotations

import heapq
import json
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import grouped_by_bytes, spread, table

#: Fixed value: the split pattern of byte-level tokenizers.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Entries of a worker's memo, after which it starts anew.
MEMO = 250_000

#: Pieces of more bytes are not kept in the memo.
MEMO_BYTES = 64

#: Fragments of more bytes are merged by a heap.
LONG = 48

#: Bytes of text that a worker takes at a time.
BATCH_BYTES = 4 << 20


def default_path() -> str:
    """The tokenizer file that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary's strings.

    Printable Latin-1 bytes stand for themselves; the others take the code
    points from 256 on, in their order.
    """
    own = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)}
    letters, spare = [], 256
    for b in range(256):
        letters.append(chr(b if b in own else spare))
        spare += b not in own
    return letters


class _Memo(dict):
    """Ids of pieces; starts anew when it is full."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, piece):
        ids = self.encode(piece)
        if len(piece) <= MEMO_BYTES:
            if len(self) >= MEMO:
                self.clear()
            self[piece] = ids
        return ids


class ForcedBoundaryBPE:
    """Encoder and decoder over a byte-level BPE vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        to_byte = {c: b for b, c in enumerate(byte_letters())}
        raw = lambda s: bytes(to_byte[c] for c in s)
        vocab = {raw(s): i for s, i in model["vocab"].items()}
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.specials.values()]) + 1
        self.bytes_of = [b""] * size
        for b, i in vocab.items():
            self.bytes_of[i] = b
        for s, i in self.specials.items():
            self.bytes_of[i] = s.encode()
        self.single = [vocab[bytes([b])] for b in range(256)]
        #: Rank of a pair of ids, which are packed in one integer; the token that the rank's merge makes.
        self.rank, self.made = {}, []
        for rank, pair in enumerate(model["merges"]):
            left, right = map(raw, pair.split(" ") if isinstance(pair, str) else pair)
            self.rank[vocab[left] << 32 | vocab[right]] = rank
            self.made.append(vocab[left + right])
        # The certain cuts: pairs that stand inside no token.
        self.inside = np.zeros(65536, bool)
        for b in vocab:
            for x, y in zip(b, b[1:]):
                self.inside[x << 8 | y] = True
        self.inside_bytes = self.inside.tobytes()
        self.find = regex.compile(PATTERN, regex.V0).findall
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")").split if self.specials else None
        self.memo = _Memo(self._piece)
        self.fragments = _Memo(self._fragment)

    def cuts(self, piece: bytes) -> list[int]:
        """Where certain cuts are: before these positions of the piece."""
        if len(piece) <= LONG:
            inside = self.inside_bytes
            return [i for i, (x, y) in enumerate(zip(piece, piece[1:]), 1) if not inside[x << 8 | y]]
        a = np.frombuffer(piece, np.uint8).astype(np.int32)
        return (np.flatnonzero(~self.inside[a[:-1] << 8 | a[1:]]) + 1).tolist()

    def _piece(self, piece: str) -> tuple[int, ...]:
        b = piece.encode()
        if len(b) == 1:
            return (self.single[b[0]],)
        at = self.cuts(b)
        if not at:
            return self._fragment(b)
        return tuple(chain.from_iterable(self.fragments[b[x:y]] for x, y in zip([0, *at], [*at, len(b)])))

    def _fragment(self, b: bytes) -> tuple[int, ...]:
        """Merge a fragment, the lowest rank first and from the left."""
        ids = [self.single[x] for x in b]
        if len(ids) > LONG:
            return self._long(ids)
        none, rank = len(self.made), self.rank.get
        ranks = [rank(x << 32 | y, none) for x, y in zip(ids, ids[1:])]
        while ranks and (r := min(ranks)) < none:
            i = ranks.index(r)
            ids[i : i + 2] = (self.made[r],)
            del ranks[i]
            if i:
                ranks[i - 1] = rank(ids[i - 1] << 32 | ids[i], none)
            if i < len(ranks):
                ranks[i] = rank(ids[i] << 32 | ids[i + 1], none)
        return tuple(ids)

    def _long(self, ids: list[int]) -> tuple[int, ...]:
        """The same by a heap over a linked list, for fragments whose square would count."""
        n, rank, made = len(ids), self.rank.get, self.made
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, left, right = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue
            ids[i], ids[j] = made[r], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank(ids[i] << 32 | ids[k])) is not None:
                    heapq.heappush(heap, (r, i, ids[i], ids[k]))
            if (h := before[i]) >= 0 and (r := rank(ids[h] << 32 | ids[i])) is not None:
                heapq.heappush(heap, (r, h, ids[h], ids[i]))
        return tuple(i for i in ids if i >= 0)

    def encode(self, text: str) -> list[int]:
        """Ids of a text; the strings of special tokens stand for those tokens."""
        get = self.memo.__getitem__
        if not self.split or not any(s in text for s in self.specials):
            return list(chain.from_iterable(map(get, self.find(text))))
        ids: list[int] = []
        for part in self.split(text):
            if part in self.specials:
                ids.append(self.specials[part])
            else:
                ids.extend(chain.from_iterable(map(get, self.find(part))))
        return ids

    def decode(self, ids) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> ForcedBoundaryBPE:
    """One codec for each worker process and file."""
    return ForcedBoundaryBPE(path)


def bpe_encode_decode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = True, within: bool = False) -> DataFrame:
    """``id_col``, ``ids`` array<int> and, unless left out, ``decoded`` string of every row.

    ``path``: the tokenizer file, present on every executor.  ``within``: ``text_col``
    is a string field of ``id_col``, a struct, and goes to the workers once, in it.
    """
    rows = df.select(F.col(id_col).alias("id"), *[F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body")] * (not within))
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))] + [T.StructField("decoded", T.StringType())] * decoded)

    def run(batches):
        own = codec(path)
        if within:
            batches = (pa.RecordBatch.from_arrays([b.column(0), b.column(0).field(text_col)], ["id", "body"]) for b in batches)
        for batch in grouped_by_bytes(batches, 1, BATCH_BYTES):
            ids = [own.encode(t or "") for t in batch.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            flat = np.fromiter(chain.from_iterable(ids), np.int32, int(ends[-1]))
            columns = [batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))]
            if decoded:
                columns.append(pa.array([own.decode(x) for x in ids], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, ["id", "ids", "decoded"][: len(columns)])

    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def digests() -> list[Column]:
    """``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of the columns ``ids`` and ``decoded``."""
    return [
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    ]


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of all documents, as digests."""
    out = bpe_encode_decode(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), default_path())
    return out.select("doc_id", *digests())


QUERIES = {"op1_bpe": op1_bpe}
