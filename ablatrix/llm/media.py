"""Media columns (operator 1): payloads kept as 8-bit WAV, short-time Fourier transforms, and fingerprints made of pairs of
spectral peaks, stored as time-coded arrays.

The payload of a text is its UTF-8 bytes (null: empty) with spaces appended up to a positive multiple of 192. It is written
as the samples of a mono 8-bit WAV by the wave module and read back from those bytes before anything is computed, so all
results are functions of the stored media. Frames of 192 samples every 96 get a Hann window and a real FFT; magnitudes are
rounded to steps of 1/16 on a log scale before peaks are compared, and a peak is the greatest of its neighbourhood (ties: all).
Each peak pairs with the next `FAN` peaks of later frames, at most `REACH` frames and `BAND` bins away. Long media are transformed in blocks of `BLOCK` frames with
an overlap, so memory beyond the payload and its peaks is bounded. Equal texts give equal values; rows may repeat.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import map_rows, table

UNIT, RATE = 192, 8000
FRAME, HOP, BLOCK = 192, 96, 4096
NEAR_T, NEAR_F = 2, 4
FAN, REACH, BAND = 3, 15, 31
WINDOW = np.hanning(FRAME).astype(np.float32)


def payload_of(text: str | None) -> bytes:
    data = (text or "").encode("utf-8", "replace")
    return data + b" " * (-len(data) % UNIT or (0 if data else UNIT))


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def _levels(samples: np.ndarray, first: int, last: int) -> np.ndarray:
    """Rounded log magnitudes of the frames first to last."""
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[first * HOP : (last - 1) * HOP + 1 : HOP]
    spectrum = np.fft.rfft((frames.astype(np.float32) - 128) * WINDOW, axis=1)
    return np.rint(np.log1p(np.abs(spectrum)) * 16).astype(np.int16)


def _spread(x: np.ndarray, axis: int, reach: int) -> np.ndarray:
    """The greatest value within reach along the axis."""
    out = x.copy()
    for k in range(1, reach + 1):
        a, b = [slice(None)] * 2, [slice(None)] * 2
        a[axis], b[axis] = slice(k, None), slice(None, -k)
        np.maximum(out[tuple(b)], x[tuple(a)], out=out[tuple(b)])
        np.maximum(out[tuple(a)], x[tuple(b)], out=out[tuple(a)])
    return out


def peaks(samples: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of frames; frame and bin of each peak, by frame then bin."""
    n = 1 + (len(samples) - FRAME) // HOP
    times, bins = [], []
    for start in range(0, n, BLOCK):
        lo, hi = max(0, start - NEAR_T), min(n, start + BLOCK + NEAR_T)
        level = _levels(samples, lo, hi)
        top = (level == _spread(_spread(level, 0, NEAR_T), 1, NEAR_F)) & (level > level.mean(axis=1, keepdims=True))
        t, f = np.nonzero(top[start - lo : min(n, start + BLOCK) - lo, 1:])
        times.append(t + start)
        bins.append(f + 1)
    return n, np.concatenate(times), np.concatenate(bins)


def fingerprint(samples: np.ndarray) -> tuple[int, int, np.ndarray, np.ndarray]:
    """Frames, peaks, and the pairs as two arrays: start frames (int32) and codes of both bins and the delay (int32)."""
    n, t, f = peaks(samples)
    times, codes, taken, open_ = [t[:0]], [t[:0]], np.zeros(len(t), int), np.arange(len(t))
    for k in range(1, len(t)):
        i = open_[open_ + k < len(t)]
        dt, df = t[i + k] - t[i], np.abs(f[i + k] - f[i])
        ok = (dt >= 1) & (dt <= REACH) & (df <= BAND)
        a = i[ok]
        times.append(t[a])
        codes.append((f[a] << 16) | (f[a + k] << 8) | dt[ok])
        taken[a] += 1
        open_ = i[(dt <= REACH) & (taken[i] < FAN)]
        if not len(open_):
            break
    at, code = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((code, at))
    return n, len(t), at[order].astype(np.int32), code[order].astype(np.int32)


def media_columns(docs: DataFrame, keep_media: bool = False) -> DataFrame:
    """The columns of op1_media; fp_times and fp_codes are the time-coded arrays. With keep_media also media binary, the WAV."""
    fields = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, n_pairs bigint, fp_times array<int>, fp_codes array<int>"
    fields += ", media binary" * keep_media

    def run(columns):
        rows = []
        for doc_id, text in zip(*columns):
            media = to_wav(payload_of(text))
            payload = from_wav(media)
            n, n_peaks, at, code = fingerprint(np.frombuffer(payload, np.uint8))
            digest = hashlib.sha256(at.tobytes() + code.tobytes()).hexdigest()
            row = (doc_id, len((text or "").encode("utf-8", "replace")), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), f"{n}:{n_peaks}:{len(at)}:{digest[:32]}", len(at), at, code)
            rows.append((*row, media) if keep_media else row)
        return list(zip(*rows)) if rows else [[] for _ in fields.split(", ")]

    return map_rows(docs.select("doc_id", "text"), fields, run, size_column=1)


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(table(spark, sf_dir, "documents"))
