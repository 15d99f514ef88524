from __future__ import annotations

import collections
import re

from quillstone.llm import mixing, q_mixing
from tests.llm.rows import ODD, table
from tests.oracle import assert_same


def brute_targets(sizes: dict, weights=mixing.WEIGHTS, cap=mixing.CAP) -> dict:
    """Shares by weight; what is over a cap is shared again until nothing is."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, open_, out = sum(sizes.values()), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > cap * sizes[s]}
        if not over:
            return out | {s: left * weight[s] / total for s in open_}
        for s in over:
            out[s] = float(cap * sizes[s])
            left -= cap * sizes[s]
        open_ -= over
    return out


def test_targets_by_brute_force(spark):
    for sizes in ({"a": 10, "b": 2000, "c": 5}, {"a": 1, "b": 1, None: 900, "d": 40}, {"x": 7}, {"a": 0, "b": 0}, {"é": 5, "z": 100, "a": 3, "b": 1}):
        sized = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
        got = {r["source"]: r["target"] for r in mixing.targets(sized).collect()}
        want = brute_targets(sizes)
        assert got.keys() == want.keys()
        assert all(abs(got[s] - want[s]) <= 1e-9 * max(1, want[s]) for s in want), (sizes, got, want)


def test_points_are_golden(spark):
    n = [0, 1, 2, 3, 1000, 65535, 65536, 123456789, (1 << 32) - 1, 1 << 33, 10**15 + 7]
    got = [r["u"] for r in spark.createDataFrame([(k,) for k in n], "i long").select(mixing.point(__import__("pyspark").sql.functions.col("i")).alias("u")).collect()]
    assert got == [k * mixing.GOLDEN % mixing.WHOLE for k in n]
    assert mixing.GOLDEN % 2 and abs(mixing.GOLDEN / mixing.WHOLE - 0.6180339887498949) < 1e-12


def test_every_source_gets_its_slots(spark):
    """A few slots beside 10^5 of another source; where points come late, the slots follow at the end."""
    sizes = [(k + 1, 100_000 if k == 20 else 1 + k % 7) for k in range(40)]
    sources = spark.createDataFrame(sizes, "sid int, slots long")
    got = collections.defaultdict(list)
    for r in mixing.schedule(sources).collect():
        got[r["sid"]].append(r["rank"])
    assert {sid: sorted(ranks) for sid, ranks in got.items()} == {sid: list(range(n)) for sid, n in sizes}


def test_odd_rows(spark):
    texts, ids = [*ODD, "same words here", "same words here"], [*range(len(ODD)), 77, 77]
    df = table(spark, texts, ids)
    rows = mixing.mix(df).collect()
    assert collections.Counter(r["doc_id"] for r in rows) == collections.Counter(ids)
    want = collections.Counter((i, len(re.findall(mixing.WORD, t or ""))) for i, t in zip(ids, texts))
    assert collections.Counter((r["doc_id"], r["size"]) for r in rows) == want
    assert all(0 <= r["taken"] <= mixing.CAP * r["size"] for r in rows)
    by = collections.defaultdict(int)
    for r in rows:
        by[r["target"], r["source_size"]] += r["taken"]
    assert len(by) == 3
    for (target, size), taken in by.items():
        assert abs(taken - target) <= max(2, 0.02 * target, size / mixing.LEAST_BLOCKS + 1)
    assert sorted(map(tuple, mixing.mix(df).collect())) == sorted(map(tuple, rows))


def test_small_and_empty(spark):
    assert mixing.mix(table(spark, [])).count() == 0
    assert [r["taken"] for r in mixing.mix(table(spark, ["", None])).collect()] == [0, 0]
    assert mixing.mix(table(spark, ["one word more"])).first()["taken"] == 3


def test_stage_takes_whole_copies(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    out = q_mixing.mixed(spark, docs, data)
    times = collections.Counter(r["doc_id"] for r in out.collect())
    assert out.columns == docs.columns and max(times.values()) <= mixing.CAP
    for r in mixing.mix(docs).collect():
        if r["size"]:
            assert abs(times[r["doc_id"]] - r["taken"] / r["size"]) <= 0.5


def test_stage_comes_near_the_targets(spark):
    """Whole copies, rounded: the words of each source's copies against its target."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = mixing.mix(docs).join(docs.select("doc_id", "source"), "doc_id").collect()
    words, target = collections.Counter(), {}
    for r in rows:
        words[r["source"]] += round(r["taken"] / r["size"]) * r["size"] if r["size"] else 0
        target[r["source"]] = r["target"]
    assert all(abs(words[s] - target[s]) <= 0.03 * target[s] for s in target), {s: words[s] / target[s] for s in target}


def test_stage_on_odd_rows(spark):
    docs = table(spark, [*ODD, "x y"], [*range(len(ODD)), None])
    out = q_mixing.mixed(spark, docs, "")
    assert out.columns == docs.columns
    assert {r["doc_id"] for r in out.collect()} <= {*range(len(ODD)), None}
    assert q_mixing.mixed(spark, table(spark, []), "").count() == 0


def test_query(spark, data):
    assert_same(q_mixing.op6_golden_mix(spark, data), q_mixing.oracle(), data)
