"""Media columns: texts' bytes as WAV samples, their spectra, and spectral-peak pair fingerprints.

The payload is written and read back by the ``wave`` module. Its short-time
Fourier transform (Hann windows of 256 samples, half overlapping) is searched
for peaks: in each of four frequency bands the strongest bin of a frame is a
peak if no neighbouring frame is stronger in that band. Each peak is paired with
the next few; a pair's two bins and time difference make one code, stored with
the time of its first peak.
"""

from __future__ import annotations

import hashlib
import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, table, text_or_empty, tune

RATE = 8000
FRAME = 256
HOP = 128
BLOCK_FRAMES = 2048
#: Edges of the bands in bins of the transform; bin 0 and 1 hold the mean.
BANDS = (2, 12, 32, 64, 129)
FAN_OUT = 3
MOST_FRAMES_APART = 63
BLOCK_BYTES = 64
_WINDOW = np.hanning(FRAME)

SCHEMA = "doc_id long, n_bytes long, media binary, payload binary, times array<int>, codes array<int>, feature string"


def pad(data: bytes, block: int = BLOCK_BYTES) -> bytes:
    """Zero bytes up to a positive multiple of ``block``."""
    return data + bytes(max(block, -(-len(data) // block) * block) - len(data))


def write_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(1)
        f.setframerate(RATE)
        f.writeframes(payload)
    return out.getvalue()


def read_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as f:
        if f.getnchannels() != 1 or f.getsampwidth() != 1:
            raise ValueError("one channel of 8-bit samples is expected")
        return f.readframes(f.getnframes())


def band_peaks(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For each frame and band the strongest bin and its strength. Works in blocks: memory doesn't grow with the media's length, but for the result."""
    n = max(1, -(-(len(samples) - FRAME) // HOP) + 1)
    bins, strength = np.empty((n, len(BANDS) - 1), np.int16), np.empty((n, len(BANDS) - 1))
    data = np.frombuffer(samples, np.uint8)
    for start in range(0, n, BLOCK_FRAMES):
        count = min(BLOCK_FRAMES, n - start)
        part = data[start * HOP : (start + count - 1) * HOP + FRAME].astype(np.float64)
        part = np.pad(part, (0, (count - 1) * HOP + FRAME - len(part)), mode="edge")
        frames = np.lib.stride_tricks.sliding_window_view(part / 128 - 1, FRAME)[::HOP]
        spectrum = np.abs(np.fft.rfft((frames - frames.mean(axis=1, keepdims=True)) * _WINDOW, axis=1))
        for k, (a, b) in enumerate(zip(BANDS, BANDS[1:])):
            best = spectrum[:, a:b].argmax(axis=1)
            bins[start : start + count, k] = best + a
            strength[start : start + count, k] = spectrum[np.arange(count), best + a]
    return bins, strength


def fingerprint(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """times (frames) and codes (first bin, second bin, frames apart) of the peak pairs, in time order."""
    bins, strength = band_peaks(samples)
    around = np.pad(strength, ((1, 1), (0, 0)))
    time, band = np.nonzero((strength > 1e-3) & (strength >= around[:-2]) & (strength > around[2:]))
    at = bins[time, band].astype(np.int64)
    times, codes = [], []
    for step in range(1, FAN_OUT + 1):
        apart = time[step:] - time[:-step]
        near = np.flatnonzero(apart <= MOST_FRAMES_APART)
        times.append(time[near])
        codes.append((at[near] << 14) | (at[near + step] << 6) | apart[near])
    times, codes = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((codes, times))
    return times[order].astype(np.int32), codes[order].astype(np.int32)


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes`` (unpadded), ``media`` (the WAV), ``payload`` (read back), the
    fingerprint's ``times`` and ``codes``, and ``feature``: their count and a hash.

    A null or empty text is 64 zero bytes; such constant media have no peaks.
    Equal texts have equal values. Rows are taken one by one, so repeated rows,
    ties and null ids need no rule; other columns are not read, so their names
    can't clash. An empty table gives no rows. A very long text is one recording,
    transformed in blocks. No shuffle.
    """
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                data = text.as_py().encode("utf-8", "replace")
                media = write_wav(pad(data))
                payload = read_wav(media)
                times, codes = fingerprint(payload)
                digest = hashlib.sha256(times.astype("<i4").tobytes() + codes.astype("<i4").tobytes()).hexdigest()[:32]
                rows.append((len(data), media, payload, times, codes, f"{len(times)}-{digest}"))
            n, media, payload, times, codes, feature = zip(*rows) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(media, pa.binary()), pa.array(payload, pa.binary()), pa.array(times, pa.list_(pa.int32())), pa.array(codes, pa.list_(pa.int32())), pa.array(feature, pa.string())], names=["doc_id", "n_bytes", "media", "payload", "times", "codes", "feature"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(lean(run), SCHEMA)


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = to_media(table(spark, sf_dir, "documents"))
    return stored.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -BLOCK_BYTES, BLOCK_BYTES)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )
