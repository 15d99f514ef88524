"""Media columns: lossless 8-bit WAV storage, reading by the wave module, and spectral-peak fingerprints.

A payload is stored as mono 8-bit PCM, one sample a byte. Reading back gives the same bytes. A short-time Fourier
transform of the samples gives log-power levels, rounded to integers so that equal payloads give equal peaks; in each
band of a frame the strongest bin is a peak if it is not below its neighbours in time (a plateau counts once, at its
end); each peak is paired with the next few peaks in time. A fingerprint is two aligned arrays: the frame of the first peak, and a code of (bin, bin, distance).

Defined cases: null bytes are stored as no bytes; an empty recording has no peaks; long recordings are transformed in
blocks of frames, so memory does not follow their length; repeated rows each give a row; an empty table gives an empty one.
"""

from __future__ import annotations

import io
import wave

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillstone.llm.arrow import map_rows

RATE = 8000
FRAME, HOP = 512, 256
#: First bins of the bands in which peaks are sought; bin 0 is the mean.
BANDS = (1, 16, 64, 128, 257)
#: Partners of a peak, and the most frames between them.
FAN, REACH = 4, 63
BLOCK = 1024

_WINDOW = np.hanning(FRAME).astype(np.float32)


def wav_bytes(payload: bytes) -> bytes:
    held = io.BytesIO()
    with wave.open(held, "wb") as out:
        out.setnchannels(1)
        out.setsampwidth(1)
        out.setframerate(RATE)
        out.writeframes(payload)
    return held.getvalue()


def read_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as recording:
        if (recording.getnchannels(), recording.getsampwidth()) != (1, 1):
            raise ValueError("expected mono 8-bit samples")
        return recording.readframes(recording.getnframes())


def levels(samples: np.ndarray, first: int, last: int) -> np.ndarray:
    """Rounded log-power levels of frames first to last - 1; samples past the end are zero."""
    part = samples[first * HOP : (last - 1) * HOP + FRAME].astype(np.float32) - 128
    if (lacking := (last - 1 - first) * HOP + FRAME - len(part)) > 0:
        part = np.concatenate([part, np.zeros(lacking, np.float32)])
    frames = np.lib.stride_tricks.sliding_window_view(part, FRAME)[::HOP] * _WINDOW
    spectrum = np.fft.rfft(frames)
    power = spectrum.real**2 + spectrum.imag**2
    return np.rint(8 * np.log2(1 + power)).astype(np.int16)


def peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frames and bins of the peaks, in order of time and bin."""
    total = max(1, -(-max(0, len(samples) - FRAME) // HOP) + 1) if len(samples) else 0
    times, bins = [], []
    for first in range(0, total, BLOCK):
        last = min(total, first + BLOCK)
        low, high = max(0, first - 1), min(total, last + 1)
        level = levels(samples, low, high)
        rows = np.arange(first - low, last - low)
        before, after = np.maximum(rows - 1, 0), np.minimum(rows + 1, high - low - 1)
        for a, b in zip(BANDS, BANDS[1:]):
            top = a + level[rows, a:b].argmax(axis=1)
            own = level[rows, top]
            kept = (own > 0) & (own >= level[before, top]) & ((own > level[after, top]) | (after == rows))
            times.append(rows[kept] + low)
            bins.append(top[kept])
    t, f = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (times, bins))
    order = np.lexsort((f, t))
    return t[order], f[order]


def pairs(t: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame of the first peak and code of each pair, in order."""
    start, codes, ranks = [], [], []
    for step in range(1, FAN + 1):
        apart = t[step:] - t[:-step]
        kept = np.flatnonzero((apart >= 1) & (apart <= REACH))
        start.append(t[kept])
        codes.append(f[kept] << 15 | f[kept + step] << 6 | apart[kept])
        ranks.append(kept * FAN + step)
    order = np.argsort(np.concatenate(ranks), kind="stable")
    return np.concatenate(start)[order], np.concatenate(codes)[order]


def fingerprint(payload: bytes) -> tuple[list[int], list[int]]:
    at, codes = pairs(*peaks(np.frombuffer(payload, np.uint8)))
    return at.tolist(), codes.tolist()


def store(df: DataFrame, id_col: str, bytes_col: str) -> DataFrame:
    """id_col, n_bytes and the `media` column: bytes_col padded with bytes 0 to a positive multiple of 64, as WAV."""

    def padded(payload: bytes | None) -> tuple[int, bytes]:
        payload = payload or b""
        return len(payload), wav_bytes(payload + bytes(-len(payload) % 64 if payload else 64))

    fields = [pa.field("n_bytes", pa.int64()), pa.field("media", pa.binary())]
    return map_rows(df, [id_col, bytes_col], fields, lambda: padded)


FINGERPRINT = [pa.field("payload", pa.binary()), pa.field("peak_times", pa.list_(pa.int32())), pa.field("peak_codes", pa.list_(pa.int32()))]


def analyse(media: DataFrame, id_col: str, keep: list[str], fields: list[pa.Field] = FINGERPRINT, finish=None) -> DataFrame:
    """Reads the `media` column back and fingerprints it: payload, peak_times, peak_codes.

    `finish(media, payload, times, codes, *kept values)`, with its `fields`, may shorten what is returned.
    """
    finish = finish or (lambda stored, payload, times, codes, *kept: (payload, times, codes))

    def row(stored: bytes, *kept) -> tuple:
        payload = read_wav(stored)
        return finish(stored, payload, *fingerprint(payload), *kept)

    return map_rows(media, [id_col, "media", *keep], fields, lambda: row)
