from __future__ import annotations

import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillstone.plans import filters as f
from quillstone.plans.query import DocQuery
from quillstone.plans.schemaless import Schemaless, documents
from quillstone.plans.typed import where

ROWS = [
    (1, "anna", 30, 1.5, [80, 90], [("x", 1), ("y", 2)], dt.datetime(2024, 1, 1), True),
    (2, "Bob", None, -7.0, [], [], None, False),
    (3, None, 18, None, None, None, dt.datetime(2024, 6, 1), None),
    (4, "carl.d", -7, 7.9, [85, None], [("y", 5)], dt.datetime(2023, 1, 1), True),
]
SCHEMA = "_id int, name string, age int, score double, marks array<int>, items array<struct<k: string, v: int>>, seen timestamp, ok boolean"


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(ROWS, SCHEMA).cache()


CASES = [
    ({}, {1, 2, 3, 4}),
    ({"name": "anna"}, {1}),
    ({"NAME": "anna"}, {1}),
    ({"name": {"$ne": "anna"}}, {2, 3, 4}),
    ({"name": None}, {3}),
    ({"name": {"$exists": True}}, {1, 2, 4}),
    ({"age": {"$exists": False}}, {2}),
    ({"age": {"$gt": 17, "$lt": 31}}, {1, 3}),
    ({"age": {"$nin": [30]}}, {2, 3, 4}),
    ({"age": {"$in": [30, -7, "30"]}}, {1, 4}),
    ({"age": {"$not": {"$gt": 0}}}, {2, 4}),
    ({"$nor": [{"age": {"$gt": 0}}, {"name": "Bob"}]}, {4}),
    ({"$or": [{"age": 18}, {"name": "Bob"}]}, {2, 3}),
    ({"$not": {"name": {"$startsWith": "a"}}}, {2, 3, 4}),
    ({"age": {"$mod": [3, -1]}}, {4}),
    ({"score": {"$mod": [3, 1]}}, {1, 4}),
    ({"name": {"$regex": "^[A-Z]"}}, {2}),
    ({"name": {"$contains": "."}}, {4}),
    ({"marks": {"$size": 0}}, {2}),
    ({"marks": {"$all": []}}, {1, 2, 4}),
    ({"marks": {"$all": [80, 90]}}, {1}),
    ({"marks": {"$elemMatch": {"$gte": 85, "$lt": 90}}}, {4}),
    ({"items": {"$elemMatch": {"k": "y", "v": {"$gt": 3}}}}, {4}),
    ({"items": {"$elemMatch": {"$or": [{"k": "x"}, {"v": 5}]}}}, {1, 4}),
    ({"seen": {"$type": 9}}, {1, 3, 4}),
    ({"age": {"$type": 16}}, {1, 3, 4}),
    ({"age": {"$type": 18}}, set()),
    ({"nothing": {"$gt": 1}}, set()),
    ({"nothing": {"$ne": 1}}, {1, 2, 3, 4}),
    ({"nothing": None}, {1, 2, 3, 4}),
    ({"items.k": "x"}, set()),
    ({"ok": True}, {1, 4}),
    ({"age": {"$gt": True}}, {1, 3, 4}),
    ({"name": {"$lt": 5}}, set()),
    ({"marks": [80, 90]}, {1}),
]


@pytest.mark.parametrize("source,want", CASES, ids=[str(c[0]) for c in CASES])
def test_typed(people, source, want):
    assert {r["_id"] for r in where(people, source).collect()} == want


@pytest.mark.parametrize("bad", ['{"a": {"$foo": 1}}', '{"$foo": []}', "[1]", "{", '{"a": {"$mod": [0, 1]}}', '{"a": {"$in": 3}}', '{"a": {"$exists": 1}}', '{"a": {"$regex": "(?=x)"}}', '{"a": {"$regex": "("}}', '{"a": {"$geoNear": {"$center": [1]}}}', '{"a": {"$gt": 1, "b": 2}}', '{"$and": {}}', '{"a": {"$not": 3}}', '{"a": {"$nearVector": {}}}'])
def test_parse_errors(bad):
    with pytest.raises(f.FilterError):
        f.parse(bad)


def test_comments_and_case():
    assert f.parse('{/* c */ "a": {"$GT": 1} // end\n}') == f.Compare("a", "gt", 1)
    assert f.parse('{"a": "// no"}') == f.Compare("a", "eq", "// no")


def test_sort_parser():
    assert f.parse_sort('{"a": 1, "b": -1}') == [("a", True), ("b", False)]
    for bad in ('{"a": 2}', '{"a": true}', "[]"):
        with pytest.raises(f.FilterError):
            f.parse_sort(bad)


def test_query_shaping(people):
    q = DocQuery(people, "_id")
    assert [r["_id"] for r in q.order_by("age").to_list()] == [2, 4, 3, 1]
    assert [r["_id"] for r in q.sort({"age": -1}).to_list()] == [1, 3, 4, 2]
    assert [r["_id"] for r in q.order_by("age").skip(1).take(2).to_list()] == [4, 3]
    assert q.take(0).to_list() == []
    assert q.filter({"age": {"$gt": 0}}).skip(1).count() == 2
    assert q.order_by("age").skip(1).first()["_id"] == 4
    assert q.filter({"age": 99}).none() and not q.filter({"age": 99}).any()
    assert q.project("NAME", "absent").frame().columns == ["_id", "name"]
    assert "items" not in q.without("items", "absent").frame().columns
    with pytest.raises(ValueError):
        q.skip(-1)
    with pytest.raises(LookupError):
        q.filter({"age": 99}).first()


JSONS = ['{"v": null}', "{}", '{"v": true}', '{"v": 3}', '{"v": 3.5}', '{"v": "3"}', '{"v": [1, "a", null]}', '{"v": {"x": 1}}', '{"v": 5000000000}', '{"a.b": 1}', "not json"]


@pytest.fixture(scope="module")
def variants(spark):
    return spark.createDataFrame(list(enumerate(JSONS)), "id int, j string").select("id", documents(F.col("j")).alias("doc")).cache()


@pytest.mark.parametrize(
    "source,want",
    [
        ({"v": None}, {0, 1, 9, 10}),
        ({"v": {"$eq": None}}, {0}),
        ({"v": {"$lt": 4}}, {0, 2, 3, 4}),
        ({"v": {"$gt": 3}}, {4, 5, 6, 7, 8}),
        ({"v": {"$ne": 3}}, {0, 1, 2, 4, 5, 6, 7, 8, 9, 10}),
        ({"v": {"$nin": [3, "3"]}}, {0, 1, 2, 4, 6, 7, 8, 9, 10}),
        ({"v": {"$type": 16}}, {3}),
        ({"v": {"$type": 18}}, {8}),
        ({"v": {"$type": 1}}, {4}),
        ({"v": {"$type": 4}}, {6}),
        ({"v": {"$type": 3}}, {7}),
        ({"v": {"$size": 3}}, {6}),
        ({"v": {"$all": ["a", 1]}}, {6}),
        ({"v": {"$elemMatch": {"$eq": "a"}}}, {6}),
        ({"v": {"$mod": [2, 1]}}, {3, 4}),
        ({"a.b": 1}, {9}),
        ({"v": {"x": 1}}, {7}),
        ({"v": {"$not": {"$exists": True}}}, {0, 1, 9, 10}),
    ],
    ids=str,
)
def test_schemaless(variants, source, want):
    got = variants.where(Schemaless(F.col("doc")).compile(f.parse(source)))
    assert {r["id"] for r in got.collect()} == want


def test_schemaless_sort(variants):
    ordered = [r["id"] for r in DocQuery(variants, "id", "doc").sort({"v": 1}).to_list()]
    assert ordered == [0, 1, 9, 10, 2, 3, 4, 8, 5, 7, 6]


leaf = st.one_of(
    st.builds(lambda op, v: {"age": {op: v}}, st.sampled_from(["$eq", "$ne", "$gt", "$gte", "$lt", "$lte"]), st.sampled_from([-7, 0, 18, 30])),
    st.builds(lambda op, vs: {"age": {op: vs}}, st.sampled_from(["$in", "$nin"]), st.lists(st.sampled_from([-7, 18, 30]), max_size=2)),
    st.builds(lambda b: {"age": {"$exists": b}}, st.booleans()),
)
tree = st.recursive(leaf, lambda t: st.one_of(st.builds(lambda op, ts: {op: ts}, st.sampled_from(["$and", "$or", "$nor"]), st.lists(t, min_size=1, max_size=3)), st.builds(lambda x: {"$not": x}, t)), max_leaves=6)


def interpret(source: dict, age: int | None) -> bool:
    """The filter's meaning, on one row."""
    ((key, value),) = source.items()
    if key == "$and":
        return all(interpret(x, age) for x in value)
    if key == "$or":
        return any(interpret(x, age) for x in value)
    if key == "$nor":
        return not any(interpret(x, age) for x in value)
    if key == "$not":
        return not interpret(value, age)
    ((op, v),) = value.items()
    if op == "$exists":
        return (age is not None) == v
    if op in ("$in", "$nin"):
        return (age is not None and age in v) != (op == "$nin")
    if age is None:
        return op == "$ne"
    return {"$eq": age == v, "$ne": age != v, "$gt": age > v, "$gte": age >= v, "$lt": age < v, "$lte": age <= v}[op]


@settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck))
@given(tree)
def test_typed_agrees_with_meaning(people, source):
    got = {r["_id"] for r in where(people, source).select("_id").collect()}
    assert got == {r[0] for r in ROWS if interpret(source, r[2])}
