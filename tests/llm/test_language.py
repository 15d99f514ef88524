from __future__ import annotations

import zlib

import numpy as np

from quillstone.llm import language, q_language
from tests.llm.rows import ODD, table


def test_grams_by_brute_force():
    def brute(text):
        words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
        padded = [f" {w} " for w in words]
        return sum(max(0, len(w) - n + 1) for n in language.SIZES for w in padded)

    for text in ["The cat, sat!", "a", "é1ü", "", "日本 語", "x  y\n\nz" * 50]:
        assert len(language.grams(text)) == brute(text)
    assert np.array_equal(np.sort(language.grams("AB cd")), np.sort(language.grams("  ab--CD ")))


def test_long_texts_are_cut_between_words(monkeypatch):
    text = "Ein ΣΑΣ langes\tWort\u2003steht hier. " * 40 + "w" * 300 + "\u2003ende"
    whole = np.sort(language.grams(text))
    for size in (7, 50, 1000):
        monkeypatch.setattr(language, "PIECE", size)
        assert "".join(language.pieces(text)) == text
        assert np.array_equal(np.sort(np.concatenate([language.grams(p) for p in language.pieces(text)])), whole)


def test_tasks_hold_few_grams(spark, monkeypatch):
    df = table(spark, ["der hund und die katze " * 9, "the dog and the cat " * 9] * 5).drop("lang").selectExpr("*", "IF(doc_id % 2 = 0, 'de', 'en') AS lang")
    model = language.learn(df)
    monkeypatch.setattr(language, "HELD", 20)
    again = language.learn(df)
    assert model.languages == again.languages and np.array_equal(model.masks, again.masks)


def test_filter_returns_all_languages_that_hold_a_gram():
    names = [f"l{k}" for k in range(70)]
    rng = np.random.default_rng(0)
    keys = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    held = {n: keys[rng.random(400) < 0.5] for n in names}
    model = language.Model.learn(names, held)
    found = None
    for at in language.slots(keys):
        found = model.masks[at] if found is None else found & model.masks[at]
    for k, n in enumerate(names):
        bits = found[:, k // 64] >> np.uint64(k % 64) & np.uint64(1)
        assert bits[np.isin(keys, held[n])].all()  # never a false negative
        assert bits[~np.isin(keys, held[n])].mean() < 0.02


def test_odd_rows(spark):
    texts = ["der hund und die katze sind im haus " * 5, "the dog and the cat are in the house " * 5] * 10
    df = table(spark, texts).drop("lang").selectExpr("*", "IF(doc_id % 2 = 0, 'de', 'en') AS lang")
    model = language.learn(df)
    rows = {r["doc_id"]: r for r in language.identify(table(spark, [*ODD, texts[0], "1234 !"]), model, ["doc_id"]).collect()}
    assert (rows[0]["lang_pred"], rows[0]["score"]) == ("und", 0.0)
    assert rows[1]["lang_pred"] == rows[2]["lang_pred"] == rows[len(ODD) + 1]["lang_pred"] == "und"
    assert rows[len(ODD)]["lang_pred"] == "de" and rows[len(ODD)]["score"] > 0.9
    assert all(r["lang_pred"] in ("de", "en", "und") and 0 <= r["score"] <= 1 for r in rows.values())
    assert rows[3]["lang_pred"] in ("de", "en")


def test_nothing_to_learn(spark):
    for df in (table(spark, []), table(spark, [None, "a b"]).selectExpr("doc_id", "text", "CAST(NULL AS string) AS lang")):
        model = language.learn(df)
        assert {r["lang_pred"] for r in language.identify(table(spark, ["some words"]), model, ["doc_id"]).collect()} == {"und"}
    assert language.identify(table(spark, []), language.Model.learn([], {}), ["doc_id"]).count() == 0


def test_predictions_by_exact_sets(spark):
    """Without filters: which language's own n-grams a text holds most of."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    learned = docs.where(~language.held_out())
    model = language.learn(learned)
    counts = {}
    for r in learned.where("text IS NOT NULL AND lang IS NOT NULL").collect():
        own = counts.setdefault(r["lang"], {})
        for g in language.grams(r["text"]).tolist():
            own[g] = own.get(g, 0) + 1
    totals = {lang: sum(own.values()) for lang, own in counts.items()}
    every = {}
    for lang, own in counts.items():
        for g, n in own.items():
            every[g] = every.get(g, 0) + n / totals[lang]
    held = {lang: {g for g, n in own.items() if n / totals[lang] >= max(language.LEAST_SHARE, language.LEAST_PART * every[g])} for lang, own in counts.items()}
    same = total = 0
    for r in docs.where("text IS NOT NULL").collect():
        found = {lang: sum(g in own for g in language.grams(r["text"]).tolist()) for lang, own in held.items()}
        best = sorted(found.values())[-2:]
        if any(map(str.isalpha, r["text"])) and best[-1] > 1.1 * best[0] + 2:  # a clear winner
            total += 1
            same += model.predict(r["text"])[0] == max(found, key=found.get)
    assert total > 50 and same == total


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang").collect()}
    rows = q_language.op7_language_bitmask(spark, d).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == langs[r["doc_id"]] for r in held) / len(held) > 0.98
