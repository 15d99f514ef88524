"""Tables and helpers for the registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.plans.query import DocQuery

Query = Callable[[SparkSession, str], DataFrame]

KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "events": "event_id", "embeddings": "vec_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str, name: str) -> DocQuery:
    return DocQuery(table(spark, sf_dir, name), KEYS[name])


def cents(c: str | Column) -> Column:
    """Exact money: sums of doubles depend on their order, sums of decimals don't."""
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(18,2)")


def money(c: str | Column) -> Column:
    return F.sum(cents(c)).cast("double")
