from __future__ import annotations

import collections

from pyspark.sql import functions as F

from quillstone.llm import common, exact_dedup, q_exact_dedup
from tests.llm.rows import ODD, table
from tests.oracle import assert_same


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def check(rows, texts, ids):
    groups = collections.defaultdict(list)
    for i, t in zip(ids, texts):
        groups[lowered(t)].append(i)
    want = collections.Counter((i, max(g), len(g)) for g in groups.values() for i in g)
    assert collections.Counter((r["id"], r["keep_id"], r["group_size"]) for r in rows) == want
    kept = collections.Counter(r["keep_id"] for r in rows if r["kept"])
    assert kept == collections.Counter(max(g) for g in groups.values())


def test_odd_rows(spark):
    texts, ids = [*ODD, "a", "A"], [*range(len(ODD)), 3, 3]
    check(exact_dedup.classes(table(spark, texts, ids)).collect(), texts, ids)


def test_collisions_are_parted_by_bytes(spark):
    texts = [*ODD, "b", "B", "c"]
    rows = exact_dedup.classes(table(spark, texts), digest=lambda c: F.substring(exact_dedup.sha256(c), 1, 0)).collect()
    check(rows, texts, list(range(len(texts))))


def written(spark, tmp_path, name, texts, ids):
    """Documents as files, whose rows have places."""
    path = str(tmp_path / f"{name} %20.parquet")
    table(spark, texts, ids).repartition(2).write.parquet(path)
    return spark.read.parquet(path)


def test_files_that_come_later(spark, tmp_path):
    """Later arrivals find earlier state, its changes replace it, and row places don't repeat."""
    space = exact_dedup.Workspace(spark, "later")
    batches = [(["a", "b", "B", "é"], [1, 2, 3, 4]), (["A", "c", None, "b"], [5, 6, 7, 2]), (["", "d", "a"], [0, 9, 5])]
    texts, ids = [], []
    for k, (own, numbers) in enumerate(batches):
        texts, ids = texts + own, ids + numbers
        seen = exact_dedup.Seen(spark, space)  # as in another session
        seen.take(written(spark, tmp_path, f"part{k}", own, numbers), files_per_batch=1)
        check(seen.classes().collect(), texts, ids)
    assert seen.epochs() > len(batches)


def test_collisions_over_runs(spark, tmp_path):
    space = exact_dedup.Workspace(spark, "collisions")
    texts, ids = [], []
    for k, own in enumerate((["a", "b", "a"], ["c", "b", None], ["C"])):
        numbers = list(range(len(ids), len(ids) + len(own)))
        texts, ids = texts + own, ids + numbers
        seen = exact_dedup.Seen(spark, space, lambda c: F.substring(exact_dedup.sha256(c), 1, 0))
        seen.take(written(spark, tmp_path, f"part{k}", own, numbers))
        check(seen.classes().collect(), texts, ids)


def test_the_check_reads_files_with_hits_only(spark, tmp_path):
    seen = exact_dedup.Seen(spark)
    seen.take(written(spark, tmp_path, "first", ["a", "b"], [1, 2]))
    hits = seen.arrivals().where("id = 1")
    text = seen.texts(hits, "text")
    assert [tuple(r)[1:] for r in text.select("digest", "id", "low").collect()] == [(1, "a")] and len(text.inputFiles()) >= 1


def test_many_places_are_shuffled(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", 1)
    df = written(spark, tmp_path, "first", ["x", "X", "y", None, "", "y"], [1, 2, 3, 4, 5, 3])
    assert sorted(r["doc_id"] for r in exact_dedup.deduplicate(df).collect()) == [2, 3, 5]


def test_rows_that_stay(spark):
    df = table(spark, ["x", "X", "y", None, "", "y"], [1, 2, 3, 4, 5, 3])
    left = exact_dedup.deduplicate(df)
    assert sorted(r["doc_id"] for r in left.collect()) == [2, 3, 5]
    assert left.columns == df.columns
    assert exact_dedup.deduplicate(table(spark, [])).count() == 0


def test_null_ids(spark):
    rows = exact_dedup.classes(table(spark, ["x", "x"], [None, 1])).collect()
    assert {r["keep_id"] for r in rows} == {1}


def test_query(spark, data):
    assert_same(q_exact_dedup.op3_exact_dedup(spark, data), q_exact_dedup.ORACLE, data)
