from __future__ import annotations

import random

import numpy as np

from quillstone.llm import q_toxicity, toxicity
from tests.llm.rows import ODD, table


def corpus(n=300, seed=1):
    rnd = random.Random(seed)
    texts, flags = [], []
    for k in range(n):
        words = [rnd.choice("alpha beta gamma delta epsilon zeta eta theta".split()) + str(rnd.randrange(40)) for _ in range(30)]
        bad = k % 5 == 0
        if bad:
            words[3], words[9] = "grumblefool" + rnd.choice(["", "s", "ish"]), rnd.choice(["nitwit", "dolt"])
        texts.append(" ".join(words))
        flags.append(int(bad))
    return texts, flags


def labels(spark, flags):
    return spark.createDataFrame([(k, f) for k, f in enumerate(flags)], "doc_id bigint, toxic int")


def test_learns_and_generalises(spark):
    texts, flags = corpus()
    docs = table(spark, texts)
    half = labels(spark, flags).where("doc_id % 2 = 0")
    chain = toxicity.train(docs, half)
    rows = {r["doc_id"]: r for r in toxicity.score(docs, chain).collect()}
    assert [int(rows[k]["toxic"]) for k in range(len(texts))] == flags
    assert all(0 <= rows[k][f"p_{c}"] <= 1 for k in rows for c in toxicity.CATEGORIES)
    again = toxicity.train(docs, half)
    assert np.allclose(again.weights[-1], chain.weights[-1]) and again.threshold == chain.threshold


def test_odd_rows(spark):
    texts, flags = corpus()
    chain = toxicity.train(table(spark, texts), labels(spark, flags))
    rows = toxicity.score(table(spark, [*ODD, "a"], [*range(len(ODD)), None]), chain).collect()
    assert len(rows) == len(ODD) + 1 and not any(r["toxic"] for r in rows)


def test_nothing_to_learn(spark):
    docs = table(spark, ["a", "b"])
    for flags in ([], [0, 0], [1, 1], [None, None]):
        chain = toxicity.train(docs, labels(spark, flags))
        assert not any(r["toxic"] for r in toxicity.score(docs, chain).collect())
    assert toxicity.score(table(spark, []), toxicity.Chain({})).count() == 0


def test_no_model_sees_the_labels_of_its_fold(spark):
    """Another label of a fold's rows changes neither what is chosen without it nor the chain that predicts it."""
    texts, flags = corpus(200)
    rnd = random.Random(0)
    fold = np.array([rnd.randrange(toxicity.FOLDS) for _ in texts])
    held = [sorted(toxicity.words(t)) for t in texts]
    number = {w: k for k, w in enumerate(sorted({w for x in held for w in x}))}
    rows = toxicity.Rows.of([[number[w] for w in x] for x in held], len(number))

    def chosen(y):
        by = {w: [0] * (2 * toxicity.FOLDS) for w in number}
        for words, k, flag in zip(held, fold, y):
            for w in words:
                by[w][k] += 1
                by[w][toxicity.FOLDS + k] += int(flag)
        names = [f"{c}{k}" for c in "nt" for k in range(toxicity.FOLDS)]
        counts = spark.createDataFrame([(w, *n) for w, n in by.items()], "word string, " + ", ".join(f"{n} long" for n in names))
        sizes = {(k, f): int(((fold == k) & (y == f)).sum()) for k in range(toxicity.FOLDS) for f in (0, 1)}
        return {x: toxicity.Choice([number[w] for w in own], {number[w] for w in tied}) for x, (own, tied) in toxicity.choose(counts, sizes).items()}

    y = np.array(flags, float)
    other = np.where(fold == 2, 1 - y, y)
    one, two = chosen(y), chosen(other)
    assert one[frozenset({2})] == two[frozenset({2})] and one[frozenset({1, 2})] == two[frozenset({1, 2})] and one[frozenset()] != two[frozenset()]
    assert np.allclose(toxicity.held_out(one, rows, y, fold)[fold == 2], toxicity.held_out(two, rows, other, fold)[fold == 2])


def test_some_rows_and_words():
    rows = toxicity.Rows.of([[0, 2], [], [1, 2, 3], [3]], 4)
    own = rows.some(np.array([2, 3, 1]), [3, 1])
    assert [own.columns[a:b].tolist() for a, b in zip(own.starts, own.starts[1:])] == [[1, 0], [0], []] and own.width == 2
    assert np.diff(rows.some(np.array([0]), []).starts).tolist() == [0]


def test_linear_model_fits_its_loss():
    rng = np.random.default_rng(0)
    lists = [sorted(set(rng.integers(0, 20, 6).tolist())) for _ in range(200)]
    y = np.array([float(3 in x or 7 in x) for x in lists])
    w = toxicity.fit_linear(toxicity.Rows.of(lists, 20), np.zeros((200, 0)), y, steps=200)
    p = toxicity.sigmoid(toxicity.Rows.of(lists, 20).times(w[:20]) + w[-1])
    gradient = toxicity.Rows.of(lists, 20).summed(p - y) + toxicity.L2 * w[:20]
    assert np.abs(gradient).max() < 0.2 and ((p > 0.5) == (y > 0)).mean() > 0.97


def test_held_out_accuracy(spark):
    """Fitted on even documents of the test table, right on the odd ones."""
    d = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    flags = spark.read.parquet(f"{d}/labels.parquet")
    chain = toxicity.train(docs, flags.where("doc_id % 2 = 0"))
    odd = toxicity.score(docs, chain).join(flags.where("doc_id % 2 = 1").select("doc_id", flags["toxic"].alias("flag")), "doc_id").collect()
    toxic, clean = [r for r in odd if r["flag"]], [r for r in odd if not r["flag"]]
    assert sum(r["toxic"] for r in toxic) / len(toxic) > 0.8
    assert sum(r["toxic"] for r in clean) / len(clean) < 0.01


def test_stage_on_odd_rows(spark):
    texts, flags = corpus()
    chain = toxicity.train(table(spark, texts), labels(spark, flags))
    odd = table(spark, [*ODD, texts[0], texts[0]], [*range(len(ODD)), 500, None])
    out = toxicity.keep_clean(odd, chain)
    assert out.columns == odd.columns and sorted(r["doc_id"] for r in out.collect()) == list(range(len(ODD)))
    assert toxicity.keep_clean(table(spark, []), chain).count() == 0


def test_stage_keeps_columns(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    out = q_toxicity.keep_clean(spark, docs, data)
    assert out.columns == docs.columns and 0 < out.count() <= docs.count()
