"""Change streams: Structured Streaming over an append-only change log."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from quillstone.operators.changes import Watch, masked

LOG_COLUMNS = ("ts", "txn", "collection", "type", "id")


def publish(log: DataFrame, path: str) -> None:
    """Appends changes; a write that fails publishes nothing."""
    log.write.mode("append").parquet(path)


def changes(spark: SparkSession, path: str, schema: T.StructType, watch: Watch | None = None, personal: Sequence[str] = (), collection: str | None = None, files_per_trigger: int | None = None) -> DataFrame:
    """The stream of changes as a reader may see it: all collections or one."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    rows = reader.parquet(path)
    if collection is not None:
        rows = rows.where(rows["collection"] == collection)
    return masked(rows, personal, watch or Watch(), [c for c in LOG_COLUMNS if c in rows.columns])


def subscribe(stream: DataFrame, checkpoint: str, on_batch: Callable[[DataFrame, int], None], once: bool = False, every: str = "1 second") -> StreamingQuery:
    """A subscriber has its own query and checkpoint, so a slow one holds up no other."""
    writer = stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def to_table(stream: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
