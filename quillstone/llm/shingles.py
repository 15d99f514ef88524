"""Hashes of word shingles, computed on whole byte arrays.

Words are runs of bytes other than 0x20 and 0x09-0x0D after lower-casing A-Z; a shingle is a run of `size` words, and a
text of fewer words is one shingle. A shingle is known by 64 bits, so two different ones are taken for the same with a
chance of about 5e-20.
"""

from __future__ import annotations

import numpy as np

SIZE = 5
PIECE = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_PLACES = np.array([0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the base and of its inverse modulo 2^64, as many as were needed."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = 1 << (n - 1).bit_length()
            cls.up, cls.down = (np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)))) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
        return cls.up[:n], cls.down[:n]


def word_hashes(raw: bytes) -> np.ndarray:
    codes = np.frombuffer(raw, np.uint8)
    if not len(codes):
        return np.zeros(0, np.uint64)
    codes = codes + ((codes >= 65) & (codes <= 90)).astype(np.uint8) * np.uint8(32)
    inside = np.zeros(len(codes) + 2, np.int8)
    inside[1:-1] = (codes != 32) & ((codes < 9) | (codes > 13))
    turns = np.diff(inside)
    starts, ends = np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _Powers.of(len(codes))
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _PLACES[7])


def pieces(raw: bytes):
    """The bytes in parts that end at white space, so that no part needs much memory."""
    at = 0
    while len(raw) - at > PIECE:
        cut = max(raw.rfind(c, at, at + PIECE) for c in (b" ", b"\n", b"\t"))
        if cut <= at:
            cut = min((x for c in (b" ", b"\n", b"\t") if (x := raw.find(c, at + 1)) > 0), default=len(raw))
        yield raw[at:cut]
        at = cut
    yield raw[at:]


def shingles(text: str | None, size: int = SIZE) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a whole text; null is the empty text."""
    raw = (text or "").encode("utf-8")
    words = word_hashes(raw) if len(raw) <= PIECE else np.concatenate([word_hashes(p) for p in pieces(raw)])
    if not len(words):
        return words
    n = min(size, len(words))
    count = len(words) - n + 1
    total = np.full(count, n, np.uint64)
    for k in range(n):
        total += words[k : k + count] * _PLACES[k]
    return np.unique(mixed(total))
