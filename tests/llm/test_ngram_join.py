from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.llm import ngram_join, q_ngram_join, shingles
from tests.llm.rows import ODD, table
from tests.oracle import assert_same

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def brute_set(text):
    words = (text or "").encode().translate(LOWER).split(None) if text else []
    words = [w for w in words if w]
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(texts, ids):
    sets = {}
    for i, t in zip(ids, texts):
        sets.setdefault(i, set()).add(brute_set(t))
    nodes = [(i, s) for i, own in sets.items() for s in own]
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(nodes):
        for j, b in nodes[:k]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}, {i: {len(s) for s in own} for i, own in sets.items()}


def check(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    rows = ngram_join.join(table(spark, texts, ids)).collect()
    components, sizes = brute(texts, ids)
    assert len(rows) == len(texts)
    for r in rows:
        assert r["component_id"] == components[r["doc_id"]], r
        assert r["n_shingles"] in sizes[r["doc_id"]]


def test_shingle_counts():
    for text in [*ODD, "a b c d e", "a b c d e f", "x " * 30, "\x0b\x0c\r", "A\x1cB"]:
        assert len(shingles.shingles(text)) == len({x for x in brute_set_ws(text)})
    assert np.array_equal(shingles.shingles("A  b\tC"), shingles.shingles("a b c"))


def brute_set_ws(text):
    import re

    words = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().translate(LOWER))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_pieces_change_nothing(monkeypatch):
    text = ODD[10]
    whole = shingles.shingles(text)
    monkeypatch.setattr(shingles, "PIECE", 1000)
    assert np.array_equal(shingles.shingles(text), whole)
    assert len(shingles.shingles("w" * 5000 + " end of it")) == 1


def test_odd_rows(spark):
    check(spark, ODD)


def edited(rnd, words, share):
    return " ".join(rnd.choice("pqrst") + str(rnd.randrange(999)) if rnd.random() < share else w for w in words)


@pytest.mark.parametrize("seed", range(3))
def test_random_groups(spark, seed):
    """Groups of near copies around the threshold, shared passages, chains, copies."""
    rnd = random.Random(seed)
    vocabulary = [f"v{k}" for k in range(400)]
    passage = " ".join(rnd.choice(vocabulary) for _ in range(50))
    texts = []
    for _ in range(6):
        words = [rnd.choice(vocabulary) for _ in range(rnd.randrange(20, 120))]
        texts += [edited(rnd, words, rnd.choice([0, 0.01, 0.02, 0.03])) for _ in range(rnd.choice([1, 3, 25]))]
        texts += [passage + " " + edited(rnd, words[:20], 0.5) for _ in range(4)]
    texts += ["a b", "A B", "a b c d", "", None, texts[0], texts[0].upper()]
    rnd.shuffle(texts)
    check(spark, texts)


def test_frequent_shingles_lose_no_link(spark, monkeypatch):
    """All shingles frequent, stars of one centre: what they miss comes from the last step."""
    monkeypatch.setattr(ngram_join, "FREQUENT", 2)
    monkeypatch.setattr(ngram_join, "STARS", (1,))
    rnd = random.Random(9)
    words = [f"w{k}" for k in range(60)]
    chain = [" ".join(words[k : k + 40]) for k in range(0, 20, 2)]
    check(spark, [*chain, *(edited(rnd, words, 0.03) for _ in range(30)), *chain[:3]])


def test_hot_shingles_stay_below_their_bound(spark, monkeypatch):
    """A hot table of ten at most, where many more shingles are as frequent as each other."""
    monkeypatch.setattr(ngram_join, "FREQUENT", 2)
    monkeypatch.setattr(ngram_join, "HOT", 10)
    rnd = random.Random(4)
    words = [f"w{k}" for k in range(60)]
    texts = [edited(rnd, words, 0.02) for _ in range(25)]
    check(spark, texts)
    docs = table(spark, texts).select(F.col("doc_id").alias("id"), "text")
    found = ngram_join.records(docs, 5).cache()
    total = found.agg(F.sum("n")).first()[0]
    assert len(ngram_join.hot_shingles(found, total).keys) <= 10


def test_last_step_by_length_class_and_block(spark, monkeypatch):
    """Blocks of three members, no stars: every pair comes from the dealt lists."""
    monkeypatch.setattr(ngram_join, "FREQUENT", 2)
    monkeypatch.setattr(ngram_join, "STARS", ())
    monkeypatch.setattr(ngram_join, "BLOCK", 3)
    rnd = random.Random(11)
    passage = " ".join(f"p{k}" for k in range(40))
    texts = [passage + " " + " ".join(f"x{rnd.randrange(4)}{k}" for k in range(n)) for n in (0, 1, 3, 6, 9, 10, 11, 14, 20, 30) for _ in range(3)]
    check(spark, texts)


def test_chunks_and_ranges_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "HELD", 150)
    monkeypatch.setattr(ngram_join, "RANGE", 16)
    monkeypatch.setattr(ngram_join, "DEALT", 200)
    rnd = random.Random(5)
    words = [f"w{k}" for k in range(300)]
    check(spark, [edited(rnd, words[a : a + 60], 0.01) for a in range(0, 200, 40) for _ in range(6)])


def test_first_hashes_that_collide(spark, monkeypatch):
    """All sets share their first hash; the second parts them."""
    own = ngram_join.class_of
    monkeypatch.setattr(ngram_join, "class_of", lambda x: (7, own(x)[1]))
    words = [f"w{k}" for k in range(40)]
    check(spark, [" ".join(words), " ".join(words[:39] + ["z"]), "a b c", "a b c", "d e f"])


def test_repeated_rows_and_ids(spark):
    words = [f"w{k}" for k in range(40)]
    other = words[:30] + [f"z{k}" for k in range(10)]  # too far from the first
    near = words[:38] + ["z", "z"]
    check(spark, [" ".join(words)] * 3 + [" ".join(other)] * 2 + [" ".join(near)], [7, 7, 7, 9, 9, 3])


def test_empty_and_null_ids(spark):
    assert ngram_join.join(table(spark, [])).count() == 0
    rows = ngram_join.join(table(spark, ["a b c", None], [None, 4])).collect()
    assert {(r["doc_id"], r["n_shingles"]) for r in rows} == {(None, 1), (4, 0)}


def test_query(spark, data):
    assert_same(q_ngram_join.op9_ngram_jaccard(spark, data), q_ngram_join.ORACLE, data)


def test_stage_on_odd_rows(spark):
    docs = table(spark, [*ODD, "a b", "a b", None], [*range(len(ODD)), None, 3, None])
    out = q_ngram_join.keep_representatives(spark, docs, "")
    components, _ = brute(ODD, list(range(len(ODD))))
    assert out.columns == docs.columns
    got = [r["doc_id"] for r in out.collect()]
    assert set(got) - {None} == set(components.values()) and got.count(None) == 2
    assert q_ngram_join.keep_representatives(spark, table(spark, []), "").count() == 0


def test_stage_keeps_one_of_each_group(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    out = q_ngram_join.keep_representatives(spark, docs, data)
    want = {r["component_id"] for r in ngram_join.join(docs).collect()}
    assert out.columns == docs.columns and sorted(r["doc_id"] for r in out.collect()) == sorted(want)
