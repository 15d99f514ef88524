from __future__ import annotations

import random
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from quillstone.llm import pii
from tests.llm.rows import ODD, table

# The patterns of the task, as they are given.
PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(number):
    total = 0
    for k, c in enumerate(reversed(number)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base(text):
    out = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            n = re.sub("[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")) or kind == "card" and 16 <= len(n) <= 19 and luhn(n) or kind == "phone" and 8 <= len(n) <= 15:
                out.append((k, m.start(), m.end()))
    return sorted(out)


TRICKY = [
    "a@b.c_d@e.f x@y@z.com a@b..c @x.y a@b. a.b+c%d@e-f.gh.ij",
    "1.2.3.4.5.6.7.8 256.1.1.1 0255.001.1.1 1.2.3 1..2.3.4 99999999999999999999.1.1.1",
    "4111111111111111 4111-1111 1111-1111 4111  1111 1111 1111 41111111111111111111 5500 0000 0000 0004, 1",
    "+1 (555) 123-4567 +49 30 901820. ++12345678 +1-(2)-3 +123456789012345678 é +44.20.7946.0958)",
    "😀 a@b.co é 10.0.0.1 " * 3,
    "1" * 20_000,
    "a" * 20_000 + "@",
    "1 " * 10_000,
    "( ( 1 ( " * 3000,
    "write to jane (at) example (dot) org or call 030-1234567",
]


def found(spark, texts, trees=None):
    rows = pii.spans(table(spark, texts), trees).collect()
    return {r["doc_id"]: ([tuple(s) for s in r["base"]], [tuple(s) for s in r["all"]]) for r in rows}


def test_base_equals_brute_force(spark):
    texts = [*ODD, *TRICKY]
    got = found(spark, texts)
    assert len(got) == len(texts)
    for k, text in enumerate(texts):
        assert got[k][0] == base(text), text and text[:80]


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="0123456789.@+-() aZé😀", max_size=60), min_size=40, max_size=120))
def test_base_on_random_texts(spark, texts):
    got = found(spark, texts)
    for k, text in enumerate(texts):
        assert got[k][0] == base(text), text


@pytest.fixture(scope="module")
def texts(data):
    import duckdb

    return [r[0] for r in duckdb.execute(f"SELECT text FROM '{data}/documents.parquet' WHERE text IS NOT NULL ORDER BY doc_id").fetchall()]


@pytest.fixture(scope="module")
def trees(spark, texts):
    """Fitted on every third document of the smallest table."""
    return pii.fit(table(spark, texts[::3]))


def test_trees_score_as_the_model_does(spark, texts):
    data = pii.taught(table(spark, texts[:20]), "doc_id", "text").cache()
    trees, scored = pii.fit_trees(data)
    assert len(trees.trees) == pii.TREES
    rows = scored.select(trees.score({n: F.col(n) for n in trees.names}).alias("own"), vector_to_array("probability")[1].alias("model")).collect()
    assert len(rows) > 200
    assert all(abs(r["own"] - r["model"]) < 1e-9 for r in rows)


def test_base_spans_stay_with_a_model(spark, trees):
    texts = [*ODD, *TRICKY]
    got = found(spark, texts, trees)
    for k, text in enumerate(texts):
        assert got[k][0] == base(text)
        assert set(got[k][0]) <= set(got[k][1])
        added = sorted((a, b) for _, a, b in set(got[k][1]) - set(got[k][0]))
        assert not any(a < d and c < b for a, b in added for _, c, d in got[k][0])
        assert all(b <= c for (_, b), (c, _) in zip(added, added[1:]))


def test_spans_without_their_mark_are_selected(spark, trees):
    """Forms that no pattern knows are found, and other numbers aren't: recall and precision on texts that weren't learnt from."""
    rnd = random.Random(3)

    def number(n):
        return "".join(rnd.choice("0123456789") for _ in range(n))

    makers = [
        (2, lambda: "4" + number(15)),
        (2, lambda: ".".join(number(4) for _ in range(4))),
        (3, lambda: f"({number(3)}) {number(3)}-{number(4)}"),
        (3, lambda: f"{number(3)}-{number(3)}-{number(4)}"),
        (0, lambda: f"jo.{number(2)}m (at) mail (dot) org"),
        (0, lambda: f"ann{number(3)}[at]post.net"),
        (4, lambda: "".join(rnd.choice("0123456789abcdef") for _ in range(40))),
        (None, lambda: f"20{number(2)}-0{rnd.randrange(1, 10)}-1{number(1)}"),
        (None, lambda: f"1.{number(1)}.{number(2)}.{number(3)}.{number(3)}"),
        (None, lambda: "ISBN 978" + number(10)),
        (None, lambda: "lot " + number(24)),
        (None, lambda: "abcdefghijk_2020_lmnopqrst"),
    ]
    hosts = [t for t in (" ".join(x.split()[:30]) for x in __import__("duckdb").execute("SELECT text FROM '/root/testdata/sf0.01/documents.parquet' WHERE lang IS NOT NULL ORDER BY doc_id LIMIT 400").df()["text"].dropna()) if len(t.split()) > 20 and not re.search("[0-9]", t)][:240]
    rows, want = [], []
    for k, host in enumerate(hosts):
        kind, make = makers[k % len(makers)]
        words = host.split()
        head = " ".join(words[:12]) + " "
        made = make().replace("ISBN ", "").replace("lot ", "")
        rows.append(head + made + " " + " ".join(words[12:]))
        want.append(None if kind is None else (kind, len(head), len(head) + len(made)))
    got = found(spark, rows, trees)
    extra = [[s for s in got[k][1] if s not in got[k][0]] for k in range(len(rows))]
    positives = [k for k, w in enumerate(want) if w and not got[k][0]]
    hit = sum(want[k] in extra[k] for k in positives)
    assert len(positives) > 100 and hit / len(positives) >= 0.9
    assert hit / max(1, sum(map(len, extra))) >= 0.9


def test_every_kind_has_a_calibrated_border(trees):
    assert set(trees.borders) == {"card", "phone", "email", "secret"}
    assert all(0.5 <= p <= 1 for p in trees.borders.values())


def test_long_spans_have_no_cap(spark, trees):
    secret = "0123456789abcdef" * 8
    local = "ab" * 60
    got = found(spark, [f'token = "{secret}"', f"mail {local} (at) {'cd' * 50} (dot) org"], trees)
    assert [(k, b - a) for k, a, b in got[0][1]] == [(4, 128)]
    assert got[1][1][0][2] - got[1][1][0][1] == 120 + 6 + 100 + 10


def test_nothing_to_learn(spark):
    assert pii.fit(table(spark, [])) is None
    assert pii.spans(table(spark, []), None).count() == 0


def test_redact(spark):
    texts = ["mail a@b.co now", None, "😀 1.2.3.4, x@y.z", "clean", "+1 234 567 890 1.2.3.4"]
    df = table(spark, texts, [1, 1, None, 4, 4])
    out = pii.redact(df, None)
    assert out.columns == df.columns
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in out.collect()) == sorted([("1", "mail ****** now"), ("1", "None"), ("None", "😀 *******, *****"), ("4", "clean"), ("4", "**********************")])


def test_repeated_rows(spark):
    rows = pii.spans(table(spark, ["a@b.co", "a@b.co"], [1, 1]), None).collect()
    assert [len(r["base"]) for r in rows] == [1, 1]


def test_query_counts(spark, data):
    from quillstone.llm.q_pii import op5_pii_boosted

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    for r in op5_pii_boosted(spark, data).collect():
        want = base(texts[r["doc_id"]])
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(k == x for k, _, _ in want) for x in range(4)]
