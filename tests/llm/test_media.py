from __future__ import annotations

import hashlib
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillstone.llm import media
from tests.llm.rows import ODD, table


@settings(max_examples=50, deadline=None)
@given(st.binary(max_size=3000))
def test_wav_is_lossless(payload):
    assert media.read_wav(media.wav_bytes(payload)) == payload


def test_tone_gives_its_bin():
    t = np.arange(media.RATE)
    wave = np.rint(127 + 100 * np.sin(2 * np.pi * 40 * media.RATE / media.FRAME * t / media.RATE)).astype(np.uint8)
    times, bins = media.peaks(wave)
    inside = bins[(bins >= 16) & (bins < 64)]
    assert len(inside) and (inside == 40).all()  # a steady tone is one plateau


def plain_levels(samples):
    """Rounded log power by the definition of the transform, frame by frame."""
    n, hop = media.FRAME, media.HOP
    total = max(1, -(-max(0, len(samples) - n) // hop) + 1)
    k, t = np.arange(n // 2 + 1)[:, None], np.arange(n)[None, :]
    table = np.exp(-2j * np.pi * k * t / n)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / (n - 1))
    out = []
    for frame in range(total):
        x = np.zeros(n)
        own = samples[frame * hop : frame * hop + n].astype(float) - 128
        x[: len(own)] = own
        out.append(8 * np.log2(1 + np.abs(table @ (x * window)) ** 2))
    return np.array(out)


def plain_peaks(level):
    found = []
    for t in range(len(level)):
        for a, b in zip(media.BANDS, media.BANDS[1:]):
            top = max(range(a, b), key=lambda f: (level[t][f], -f))
            before = level[t - 1][top] if t else level[t][top]
            last = t + 1 == len(level)
            if level[t][top] > 0 and level[t][top] >= before and (last or level[t][top] > level[t + 1][top]):
                found.append((t, top))
    return found


def test_levels_and_peaks_by_the_definition():
    """Against a plain transform: levels agree but where rounding is on the edge, and peaks follow from the levels."""
    rng = np.random.default_rng(5)
    for size in (64, 512, 700, 9000):
        samples = rng.integers(0, 256, size).astype(np.uint8)
        plain = plain_levels(samples)
        got = media.levels(samples, 0, len(plain))
        assert got.shape == plain.shape and np.abs(got - plain).max() <= 0.5 + 1e-2
        t, f = media.peaks(samples)
        assert list(zip(t.tolist(), f.tolist())) == plain_peaks(got)


def test_blocks_change_nothing(monkeypatch):
    data = np.random.default_rng(3).integers(0, 256, 40_000).astype(np.uint8)
    whole = media.peaks(data)
    monkeypatch.setattr(media, "BLOCK", 7)
    parts = media.peaks(data)
    assert np.array_equal(whole[0], parts[0]) and np.array_equal(whole[1], parts[1])


def test_pairs_by_brute_force():
    rng = np.random.default_rng(1)
    t = np.sort(rng.integers(0, 200, 80))
    f = rng.integers(1, 257, 80)
    want = [(int(t[i]), int(f[i] << 15 | f[j] << 6 | t[j] - t[i])) for i in range(80) for j in range(i + 1, min(80, i + media.FAN + 1)) if 1 <= t[j] - t[i] <= media.REACH]
    assert list(zip(*(x.tolist() for x in media.pairs(t, f)))) == want


def test_table(spark):
    docs = table(spark, ODD).select("doc_id", "id", F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("raw"))
    rows = {r["doc_id"]: r for r in media.analyse(media.store(docs, "doc_id", "raw"), "doc_id", ["n_bytes"]).collect()}
    for k, text in enumerate(ODD):
        raw = (text or "").encode()
        padded = raw + bytes(-len(raw) % 64 if raw else 64)
        assert bytes(rows[k]["payload"]) == padded
        assert len(rows[k]["peak_times"]) == len(rows[k]["peak_codes"])
    assert rows[0]["peak_times"] == [] and rows[4]["peak_codes"] == rows[7]["peak_codes"]
    empty = docs.limit(0)
    assert media.analyse(media.store(empty, "doc_id", "raw"), "doc_id", []).count() == 0


def test_query(spark, data):
    from quillstone.llm.q_media import op2_media_columns

    rows = op2_media_columns(spark, data).collect()
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        raw = texts[r["doc_id"]]
        padded = raw + bytes(-len(raw) % 64 if raw else 64)
        stored = media.wav_bytes(padded)
        times, codes = media.fingerprint(padded)
        assert (r["payload_sha256"], r["media_sha256"]) == (hashlib.sha256(padded).hexdigest(), hashlib.sha256(stored).hexdigest())
        assert r["feature"] == ",".join(f"{t}:{c:x}" for t, c in zip(times, codes))
        assert (r["n_bytes"], r["payload_bytes"], r["tail_crc32"], r["media_bytes"]) == (len(raw), len(padded), zlib.crc32(padded[-64:]), len(padded) + 44)
