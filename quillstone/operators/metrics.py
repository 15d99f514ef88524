"""Audit events and the metrics that come from them. Events: (ts, collection, type, micros, size)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "ts timestamp, collection string, type string, micros bigint, size bigint, detail string"
# Types of events.
TYPES = ("begin", "commit", "rollback", "group_commit", "checkpoint", "insert", "update", "delete", "find", "query", "slow_query", "refused_query")


def snapshot(events: DataFrame, by: str | None = "collection") -> DataFrame:
    """Number, mean time and mean size of the events of each type, per collection or in all; 0 where there are none."""
    keys = ["type"] if by is None else [by, "type"]
    return events.groupBy(*keys).agg(F.count("*").alias("n"), F.coalesce(F.avg("micros"), F.lit(0.0)).alias("avg_micros"), F.coalesce(F.avg("size"), F.lit(0.0)).alias("avg_size"))


def slow(events: DataFrame, limit_micros: int) -> DataFrame:
    return events.where((F.col("type") == "query") & (F.col("micros") >= limit_micros))


class AuditLog:
    """Appends events to a table. Events are held and written together."""

    def __init__(self, spark: SparkSession, path: str, slow_micros: int | None = None, batch: int = 100):
        self.spark, self.path, self.slow_micros, self.batch, self.held = spark, path, slow_micros, batch, []

    def record(self, ts: dt.datetime, collection: str, type_: str, micros: int = 0, size: int = 0, detail: str | None = None) -> None:
        if type_ not in TYPES:
            raise ValueError(f"unknown event {type_}")
        self.held.append((ts, collection, type_, micros, size, detail))
        if self.slow_micros is not None and type_ == "query" and micros >= self.slow_micros:
            self.held.append((ts, collection, "slow_query", micros, size, detail))
        if len(self.held) >= self.batch:
            self.flush()

    def flush(self) -> None:
        if self.held:
            self.spark.createDataFrame(self.held, EVENTS).coalesce(1).write.mode("append").parquet(self.path)
            self.held = []

    def events(self) -> DataFrame:
        self.flush()
        return self.spark.read.schema(EVENTS).parquet(self.path)
