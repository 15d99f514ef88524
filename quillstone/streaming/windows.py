"""Event-time windows over streams and tables, and scheduled retention. Extensions: the model has no windows of its own."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillstone.operators.retention import Policy, apply


def _windowed(df: DataFrame, window: Column, timestamp: str, by: tuple[str, ...], aggregates: tuple[Column, ...], late: str | None) -> DataFrame:
    rows = df.withWatermark(timestamp, late) if late else df
    out = rows.groupBy(window.alias("window"), *by).agg(*aggregates)
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *out.columns[1:])


def tumbling(df: DataFrame, timestamp: str, width: str, *aggregates: Column, by: tuple[str, ...] = (), late: str | None = None) -> DataFrame:
    """Aggregates per window (and key); with `late`, a stream drops rows that much behind the newest."""
    return _windowed(df, F.window(timestamp, width), timestamp, by, aggregates, late)


def sliding(df: DataFrame, timestamp: str, width: str, step: str, *aggregates: Column, by: tuple[str, ...] = (), late: str | None = None) -> DataFrame:
    return _windowed(df, F.window(timestamp, width, step), timestamp, by, aggregates, late)


def sessions(df: DataFrame, timestamp: str, gap: str, *aggregates: Column, by: tuple[str, ...] = (), late: str | None = None) -> DataFrame:
    return _windowed(df, F.session_window(timestamp, gap), timestamp, by, aggregates, late)


def scheduled_retention(ticks: DataFrame, table: Callable[[], DataFrame], replace: Callable[[DataFrame], None], policy: Policy, key: str, checkpoint: str, clock: Callable[[], dt.datetime]) -> StreamingQuery:
    """Applies a policy to a table at each batch of a rate stream; batches of one query never overlap."""

    def run(_: DataFrame, __: int) -> None:
        replace(apply(table(), policy, clock(), key))

    return ticks.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(processingTime=f"{policy.interval_s} seconds").start()
