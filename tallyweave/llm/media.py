"""Media columns: 8-bit WAV, spectra and spectral-peak fingerprints (operator 10).

A payload is stored losslessly as the 8-bit samples of a WAV file, written and
read back by the ``wave`` module.  Short-time Fourier transforms of the samples
give spectra; their peaks are paired with later peaks nearby, and each pair is a
fingerprint (both frequencies and the frames between) coded with its time.

Defined results: a null text counts as empty; the payload of an empty text is
576 bytes of 255.  Equal texts give equal values.  Only the id and text columns
are read, so other columns never clash.  An empty table gives no rows.
"""

from __future__ import annotations

import io
import wave

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import grouped_by_bytes, spread, table

#: Payloads are filled up with FILL to a positive multiple of so many bytes.
BLOCK, FILL = 576, 255

#: Samples a second that the WAV header tells.
RATE = 8000

#: Samples in a frame of the Fourier transform, and between the starts of two.
FRAME, HOP = 512, 288

#: A peak is the largest of so many bins; so many bands of them in each frame.
BANDS = 4

#: A peak is paired with the peaks of so many frames that follow.
REACH = 2

#: Bytes of text that a worker takes at a time.
BATCH_BYTES = 2 << 20


def to_wav(payload: bytes) -> bytes:
    """A mono WAV file of 8-bit samples."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    """The samples of a WAV file."""
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def padded(data: bytes) -> bytes:
    """The bytes filled up to a positive multiple of BLOCK."""
    size = max(1, -(-len(data) // BLOCK)) * BLOCK
    return data + bytes([FILL]) * (size - len(data))


_WINDOW = np.hanning(FRAME).astype(np.float32)

#: Frames that are transformed at a time, so that a long text stays in bounded memory.
_FRAMES = 4096


def peaks(samples: np.ndarray) -> np.ndarray:
    """Frequency bins of the largest magnitude in each band of each frame: (frames, BANDS).

    A band without a positive magnitude has its first bin.
    """
    n = max(1, -(-(len(samples) - FRAME) // HOP) + 1) if len(samples) > FRAME else 1
    held = np.zeros((n - 1) * HOP + FRAME, np.float32)
    held[: len(samples)] = samples.astype(np.float32) - 128
    frames = np.lib.stride_tricks.sliding_window_view(held, FRAME)[::HOP]
    found = np.empty((n, BANDS), np.int64)
    edges = np.linspace(1, FRAME // 2 + 1, BANDS + 1).astype(int)
    for at in range(0, n, _FRAMES):
        spectrum = np.fft.rfft(frames[at : at + _FRAMES] * _WINDOW, axis=1)
        # Rounded, so that equal magnitudes are ties and the lower bin wins.
        power = np.round(np.log2(1 + spectrum.real**2 + spectrum.imag**2), 6)
        for k in range(BANDS):
            found[at : at + _FRAMES, k] = edges[k] + np.argmax(power[:, edges[k] : edges[k + 1]], axis=1)
    return found


def fingerprints(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Times and codes: each band's peak with the same band's peaks of the next frames.

    A code packs both bins and the frames between them.
    """
    times, codes = [], []
    for d in range(1, REACH + 1):
        if len(found) > d:
            code = (found[:-d] << 12 | found[d:]) << 4 | d
            times.append(np.repeat(np.arange(len(found) - d), BANDS))
            codes.append(code.ravel())
    if not times:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    t, c = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((c, t))
    return t[order], c[order]


def media_features(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, the stored WAV ``media`` and what is read back from it of every row.

    ``n_bytes``, ``payload`` (read back), ``times`` and ``codes`` (fingerprints,
    sorted by time).
    """
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body"))
    schema = f"id {dict(rows.dtypes)['id']}, n_bytes long, media binary, payload binary, times array<int>, codes array<int>"

    def run(batches):
        for batch in grouped_by_bytes(batches, 1, BATCH_BYTES):
            sizes, stored, payloads, times, codes = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                data = text.encode()
                media = to_wav(padded(data))
                back = from_wav(media)
                t, c = fingerprints(peaks(np.frombuffer(back, np.uint8)))
                for kept, x in ((sizes, len(data)), (stored, media), (payloads, back), (times, t), (codes, c)):
                    kept.append(x)
            ends = pa.array(np.cumsum([0, *map(len, times)], dtype=np.int32))
            lists = lambda x: pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x).astype(np.int32)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(stored, pa.binary()), pa.array(payloads, pa.binary()), lists(times), lists(codes)],
                ["id", "n_bytes", "media", "payload", "times", "codes"],
            )

    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the stored form and of the payload read back, and the fingerprints of all documents."""
    out = media_features(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    payload = F.col("payload")
    return out.select(
        "doc_id",
        "n_bytes",
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha2(payload, 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, octet_length(payload) - 31, 32)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(
            "|",
            F.array_join(F.col("times").cast("array<string>"), ","),
            F.array_join(F.col("codes").cast("array<string>"), ","),
        ).alias("feature"),
    )


QUERIES = {"op10_media": op10_media}
