"""Media columns: bytes stored as WAV files, and fingerprints of their spectral peaks.

`store` writes a payload as an 8-bit mono WAV file and `load` reads it back. `fingerprints` takes a
short-time Fourier transform, keeps each band's strongest bin where it is a peak in time, and pairs
it with the peaks that follow. A pair is one 64-bit number, (bin, later bin, frames between) above
the frame's number, so an array of them is sorted by time within a band.

Null and empty texts are stored as one block of zeros. A text of any length is transformed in blocks
of frames, so memory beyond the text and its file stays bounded.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

RATE, BLOCK = 8000, 64
FRAME, HOP, FRAMES_AT_ONCE = 512, 256, 2048
#: First bins of the bands, and the end of the last.
BANDS = (1, 8, 24, 72, 257)
#: A peak is the strongest of so many frames on either side; it is paired with peaks so many frames later at most.
NEAR, REACH = 2, 16
_WINDOW = np.hanning(FRAME).astype(np.float32)


def padded(data: bytes, block: int = BLOCK) -> bytes:
    """data with zeros appended up to a positive multiple of block bytes."""
    return data.ljust(max(block, -(-len(data) // block) * block), b"\0")


def store(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as file:
        file.setnchannels(1), file.setsampwidth(1), file.setframerate(RATE)
        file.writeframes(payload)
    return out.getvalue()


def load(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media)) as file:
        return file.readframes(file.getnframes())


def spectrum(samples: np.ndarray) -> Iterator[np.ndarray]:
    """Power by frame and bin, in blocks of frames; the last frame is filled with silence."""
    n = max(1, -(-(len(samples) - FRAME) // HOP) + 1)
    for first in range(0, n, FRAMES_AT_ONCE):
        count = min(FRAMES_AT_ONCE, n - first)
        signal = np.zeros((count - 1) * HOP + FRAME, np.float32)
        part = samples[first * HOP : first * HOP + len(signal)]
        signal[: len(part)] = part.astype(np.float32) - 128
        frames = np.lib.stride_tricks.sliding_window_view(signal, FRAME)[::HOP]
        found = np.fft.rfft(frames * _WINDOW, axis=1)
        yield found.real**2 + found.imag**2


def fingerprints(payload: bytes) -> np.ndarray:
    samples = np.frombuffer(payload, np.uint8)
    bins, powers = [], []
    for block in spectrum(samples):
        parts = [block[:, a:b] for a, b in zip(BANDS, BANDS[1:])]
        at = np.stack([p.argmax(1) for p in parts], 1)
        powers.append(np.stack([np.take_along_axis(p, at[:, [i]], 1)[:, 0] for i, p in enumerate(parts)], 1))
        bins.append(at + np.array(BANDS[:-1]))
    bins, powers = np.concatenate(bins), np.concatenate(powers)
    edge = np.pad(powers, ((NEAR, NEAR), (0, 0)), constant_values=-1)
    around = np.lib.stride_tricks.sliding_window_view(edge, 2 * NEAR + 1, axis=0).max(2)
    out = []
    for band in range(powers.shape[1]):
        at = np.flatnonzero((powers[:, band] == around[:, band]) & (powers[:, band] > 0))
        for later in (1, 2, 3):
            a, b = at[:-later], at[later:]
            near = b - a <= REACH
            a, b = a[near], b[near]
            out.append(((bins[a, band] << 18 | bins[b, band] << 9 | (b - a)) << 32 | a).astype(np.int64))
    return np.concatenate(out)


def described(text: str | None) -> tuple:
    """n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256 and feature of one text."""
    data = (text or "").encode()
    media = store(padded(data))
    payload = load(media)
    found = fingerprints(payload)
    feature = f"{len(found)}:{hashlib.sha256(found.astype('<i8').tobytes()).hexdigest()[:32]}"
    return len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), feature


def media_columns(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, media (the WAV file) and fingerprints (array<bigint>) of each row, in any order."""

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                files = [store(padded((t or "").encode())) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(files, pa.binary()), pa.array([fingerprints(load(f)) for f in files], pa.list_(pa.int64()))], [key, "media", "fingerprints"])

    rows = documents.select(key, text)
    return rows.mapInArrow(run, f"`{key}` {rows.schema[0].dataType.simpleString()}, media binary, fingerprints array<bigint>")


def op8(spark, sf_dir: str) -> DataFrame:
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches):
        for batch in batches:
            found = list(zip(*(described(t.as_py()) for t in batch.column(1)))) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, k) for x, k in zip(found, kinds))], ["doc_id", *names])

    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return rows.mapInArrow(run, "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")
