"""Small document tables with every odd case: nulls, empty and long texts, ties, repeated rows, clashing extra columns."""

from __future__ import annotations

LONG = " ".join(f"word{k % 977} number{k % 31}" for k in range(60_000))
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, row int, n int, kept string, cid string, label string, digest string, size string, token string, `a.b` string, `row.id` int, place string, file string, Row_ string"


def table(spark, texts, ids=None):
    """Documents with the given texts and extra columns named like the operators' own."""
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, ("en", None)[k % 2], ("b", "a", None)[k % 3], len(t or ""), "x", k, k, "x", "x", "x", "x", "x", "x", "x", k, "x", "x", "x") for k, (i, t) in enumerate(zip(ids, texts))]
    return spark.createDataFrame(rows, SCHEMA)


BASE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
ODD = [None, "", " \n\t ", "a", BASE, BASE.upper(), BASE + " end", BASE, "É é ÀB àb", "Éa", LONG, LONG + " tail", "日本語 テキスト 😀", "\x00 nul", "un deux"]
