import pytest

from quillstone.queries import ALL
from tests.oracle import assert_same


@pytest.mark.parametrize("name", [n for n, (_, sql) in ALL.items() if sql])
def test_query_matches_sql(spark, data, name):
    query, sql = ALL[name]
    assert_same(query(spark, data), sql, data)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_plan_of_flagship_pushes_down(spark, data):
    query, _ = ALL["filter_compare_sort_page"]
    plan = spark._jvm.PythonSQLUtils.explainString(query(spark, data)._jdf.queryExecution(), "formatted")
    assert "TakeOrderedAndProject" in plan
    assert "GreaterThan(o_totalprice,100000" in plan and "EqualTo(o_orderstatus,F)" in plan
    assert "o_orderdate" not in plan
