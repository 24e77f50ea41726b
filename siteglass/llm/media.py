"""Media columns: a payload stored as WAV samples, and spectral-peak pair fingerprints from short-time Fourier transforms.

A payload becomes the 8-bit samples of a mono WAV file, which the wave module writes and reads. The samples read back are
cut into frames, weighted and transformed in blocks of fixed size; peaks are the strongest local maxima of a frame, and
each peak is paired with the next few. A pair is one 64-bit integer: the frame's number in the high half, and both
frequency bins and the time between them in the low half.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteglass.llm.byte_bpe import groups_by_bytes
from siteglass.llm.common import small_batches

RATE, FRAME, HOP, BLOCK, PEAKS, FAN, REACH = 8000, 256, 128, 4096, 2, 3, 16
HANN = np.hanning(FRAME).astype(np.float64)


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 padded with zero bytes to a positive multiple of 64, and the size before that."""
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % 64 if raw else 64), len(raw)


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(1)
        f.setframerate(rate)
        f.writeframes(payload)
    return out.getvalue()


def from_wav(stored: bytes) -> bytes:
    with wave.open(io.BytesIO(stored), "rb") as f:
        return f.readframes(f.getnframes())


def peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame numbers and frequency bins of the PEAKS strongest local maxima of each frame, by frame and bin."""
    x = samples.astype(np.float64) - 128.0
    n = max(1, -(-max(len(x) - FRAME, 0) // HOP) + 1)
    x = np.concatenate([x, np.zeros((n - 1) * HOP + FRAME - len(x))]) if len(x) < (n - 1) * HOP + FRAME else x
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    times, bins = [], []
    for i in range(0, n, BLOCK):
        power = np.abs(np.fft.rfft(frames[i : i + BLOCK] * HANN, axis=1))
        inner = power[:, 1:-1]
        top = np.where((inner > power[:, :-2]) & (inner >= power[:, 2:]), inner, -1.0)
        best = np.sort(np.argpartition(-top, PEAKS - 1, axis=1)[:, :PEAKS], axis=1)
        real = np.take_along_axis(top, best, 1) > 0
        rows, cols = np.nonzero(real)
        times.append(rows + i)
        bins.append(best[rows, cols] + 1)
    return np.concatenate(times), np.concatenate(bins)


def fingerprint(samples: np.ndarray) -> np.ndarray:
    """Time-coded pairs of each peak with the FAN next ones that are at most REACH frames later."""
    t, f = peaks(samples)
    out = []
    for k in range(1, FAN + 1):
        dt = t[k:] - t[:-k]
        near = dt <= REACH
        out.append((t[:-k][near].astype(np.int64) << 32) | (f[:-k][near].astype(np.int64) << 16) | (f[k:][near].astype(np.int64) << 8) | dt[near])
    return np.sort(np.concatenate(out))


def media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_bytes, wav, fingerprint): the stored file and the time-coded array.

    Null counts as empty, whose payload is 64 zero bytes. Repeated rows each give a row; equal texts give equal values.
    """
    return _map(docs, id_col, text_col, "wav binary, fingerprint array<long>", lambda wav, back, marks: (wav, marks.tolist()), [pa.binary(), pa.list_(pa.int64())])


def features(docs: DataFrame) -> DataFrame:
    """The columns of op10, from the bytes read back out of the stored file."""

    def row(wav: bytes, back: bytes, marks: np.ndarray) -> tuple:
        return len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(wav), hashlib.sha256(wav).hexdigest(), f"{len(marks)}:{hashlib.sha256(marks.astype('<i8').tobytes()).hexdigest()}"

    return _map(docs, "doc_id", "text", "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", row, [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()])


def _map(docs: DataFrame, id_col: str, text_col: str, schema: str, row, types: list) -> DataFrame:
    id_type = docs.schema[id_col].dataType.simpleString()
    small_batches(docs.sparkSession)
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(1)), 0).to_pylist()
            for a, b in groups_by_bytes(sizes, 4 << 20):
                rows, n_bytes = [], []
                for text in batch.column(1).slice(a, b - a).to_pylist():
                    payload, n = payload_of(text)
                    wav = to_wav(payload)
                    back = from_wav(wav)
                    rows.append(row(wav, back, fingerprint(np.frombuffer(back, np.uint8))))
                    n_bytes.append(n)
                columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n_bytes, pa.int64()), *columns], [id_col, "n_bytes", *names])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {id_type}, n_bytes long, {schema}")
