"""Retention and time series. Times are parameters; nothing reads a clock."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.sources.shared import kept


@dataclass(frozen=True)
class Policy:
    """Limits of a collection; 0 means none. interval_s: between scheduled runs."""

    timestamp: str | None = None
    max_age: dt.timedelta = dt.timedelta(0)
    max_count: int = 0
    max_bytes: int = 0
    interval_s: int = 300
    on_insert: bool = True
    scheduled: bool = False


def by_age(df: DataFrame, timestamp: str, now: Column | dt.datetime, age: dt.timedelta) -> DataFrame:
    """Without rows older than `age`; rows without a time stay."""
    at = now if isinstance(now, Column) else F.lit(now)
    cutoff = at - F.expr(f"INTERVAL '{age.total_seconds():.6f}' SECOND")
    return df.where(F.col(timestamp).isNull() | (F.col(timestamp) >= cutoff.cast(df.schema[timestamp].dataType)))


def _newest_first(timestamp: str | None, key: str) -> list[Column]:
    """Deletion takes the oldest first and rows without a time last; so from the end of that order."""
    return [*([F.col(timestamp).desc_nulls_first()] if timestamp else []), F.col(key).desc()]


def by_count(df: DataFrame, n: int, key: str, timestamp: str | None = None) -> DataFrame:
    """The n newest rows: a top-n, so each task keeps n rows and nothing else is shuffled."""
    return df.orderBy(*_newest_first(timestamp, key)).limit(n)


def by_bytes(df: DataFrame, limit: int, size: Column, key: str, timestamp: str | None = None) -> DataFrame:
    """The newest rows whose sizes sum to at most `limit`.

    Sizes are summed per range of the order first; then running sums are taken inside ranges, so no task has all rows.
    The ranges come from a sample, so the dealt rows are written first: dealt twice, they could fall differently.
    """
    order = _newest_first(timestamp, key)
    dealt = df.withColumn("_size", size).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    dealt = kept(dealt, "retention")
    sums = dealt.groupBy("_part").agg(F.sum("_size").alias("_sum"))
    before = sums.select("_part", (F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_sum")).alias("_before"))
    inside = F.sum("_size").over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    newest = dealt.withColumn("_run", inside).join(F.broadcast(before), "_part").where(F.col("_before") + F.col("_run") <= limit)  # before: a row per partition
    return newest.select(*df.columns)


def apply(df: DataFrame, policy: Policy, now: Column | dt.datetime, key: str, size: Column | None = None) -> DataFrame:
    """Age, then count, then bytes."""
    if policy.max_age and policy.timestamp:
        df = by_age(df, policy.timestamp, now, policy.max_age)
    if policy.max_count:
        df = by_count(df, policy.max_count, key, policy.timestamp)
    if policy.max_bytes:
        df = by_bytes(df, policy.max_bytes, size if size is not None else F.octet_length(F.to_json(F.struct(*df.columns))), key, policy.timestamp)
    return df


def stamp_missing(df: DataFrame, timestamp: str, now: dt.datetime) -> DataFrame:
    """Series rows without a time get that of their insertion."""
    return df.withColumn(timestamp, F.coalesce(F.col(timestamp), F.lit(now).cast(df.schema[timestamp].dataType)))


def prune_parts(df: DataFrame, timestamp: str, cutoff: Column | dt.datetime, part: Column | None = None) -> DataFrame:
    """Drops whole parts (days) whose newest row is older than the cutoff; a part with a fresh row stays whole."""
    part = F.to_date(timestamp) if part is None else part
    at = cutoff if isinstance(cutoff, Column) else F.lit(cutoff)
    marked = df.withColumn("_part", part)
    fresh = marked.groupBy("_part").agg(F.max(timestamp).alias("_newest")).where(F.col("_newest") >= at)
    return marked.join(fresh.select(F.col("_part").alias("_kept")), F.col("_part").eqNullSafe(F.col("_kept")), "left_semi").drop("_part")


def write_series(df: DataFrame, path: str, timestamp: str) -> None:
    """Appends a series to a table in folders by day, which pruning and time filters skip whole."""
    df.withColumn("day", F.to_date(timestamp)).write.mode("append").partitionBy("day").parquet(path)


def prune_files(spark, path: str, cutoff_day: dt.date) -> list[str]:
    """Deletes the day folders before a day, without reading their rows; returns their names."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = []
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        if name.startswith("day=") and name[4:] < cutoff_day.isoformat() and name[4:] != "__HIVE_DEFAULT_PARTITION__":
            fs.delete(status.getPath(), True)
            gone.append(name)
    return sorted(gone)
