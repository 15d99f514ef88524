"""Exact deduplication as a stream with disk-backed keyed state.

Arrivals (digest, id, file, row) flow through a Structured Streaming aggregation keyed by digest. Its state is kept by
RocksDB without expiry, so a copy is found however late it comes; for each digest the state retains the largest id, the
stable identifier and locator of that row (its file and its place in it), and the number of rows. On a hit, a digest that
comes again, the full bytes are checked: the texts behind the digest are read through their locators, from the files that
hold hits only, and reduced, per task first, to their least and greatest; where these differ, the digest has collided and
its rows are parted by their texts.

State, arrivals and the stream's checkpoint lie in the shared folder, so a lost executor costs a task, not the state, and a
Seen of the same folder takes in further documents later, also in another session. Rows that aren't straight from Parquet
files are written there first, to have a locator. A digest with very many rows is one row per task after partial
aggregation; the join back to rows is one that adaptive execution splits.

Texts are equal when identical after lower-casing A-Z only; null counts as the empty text. The row with the largest id
stays; of rows that also share the id, exactly one. Null ids come after all others. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.common import Workspace, bounded, lower_ascii, whole_row

STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # a store per partition would reserve megabytes each
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def normalised(text_col: str) -> Column:
    return lower_ascii(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))


def place() -> Column:
    """Stable identifier and locator of a row of a Parquet scan: file and row number in it."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("place")


def scanned(docs: DataFrame, space: Workspace, name: str) -> DataFrame:
    """docs if they are as a Parquet scan reads them, else a written copy that is."""
    return docs if docs._jdf.queryExecution().analyzed().nodeName() == "LogicalRelation" and docs.inputFiles()[0].endswith(".parquet") else space.keep(docs, name)


class Seen:
    """The documents seen so far, in a workspace that outlives the session."""

    def __init__(self, spark: SparkSession, space: Workspace | None = None, digest: Callable[[Column], Column] = sha256):
        self.spark, self.space, self.digest = spark, space or Workspace(spark, "exact-dedup"), digest

    def arrivals(self) -> DataFrame:
        return self.spark.read.parquet(self.space.path("arrivals"))

    def take(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", files_per_batch: int | None = None) -> DataFrame:
        """Takes documents in; returns them as they are scanned, so that places tell their rows."""
        epoch = self.epochs()
        taken = scanned(docs, self.space, f"content-{epoch}")
        rows = taken.select(F.col(f"`{id_col}`").alias("id"), self.digest(normalised(text_col)).alias("digest"), place())
        rows.select("id", "digest", "place.*").write.mode("append").parquet(self.space.path("arrivals"))
        self._run(files_per_batch)
        if self.epochs() > epoch:
            self._check(epoch, text_col)
        return taken

    def epochs(self) -> int:
        """Number of micro-batches that changed the state."""
        last = self.spark.read.parquet(self.space.path("state")).agg(F.max("epoch")).first()[0] if there(self.space, "state") else None
        return 0 if last is None else last + 1

    def _run(self, files_per_batch: int | None) -> None:
        """Lets the stream see all arrivals that are new; files_per_batch bounds what a batch takes."""
        before = {k: self.spark.conf.get(k, None) for k in STATE}
        for k, v in STATE.items():
            self.spark.conf.set(k, v)
        try:
            reader = self.spark.readStream.schema(self.arrivals().schema)
            if files_per_batch:
                reader = reader.option("maxFilesPerTrigger", files_per_batch)
            seen = reader.parquet(self.space.path("arrivals"))
            state = seen.groupBy("digest").agg(F.max(F.struct("id", "file", "row")).alias("stays"), F.count("*").alias("n"))

            def write(changed: DataFrame, epoch: int) -> None:  # repeating an epoch writes the same folder again
                changed.write.mode("overwrite").parquet(f"{self.space.path('state')}/epoch={epoch}")

            query = state.writeStream.outputMode("update").option("checkpointLocation", self.space.path("checkpoint")).trigger(availableNow=True).foreachBatch(write).start()
            query.awaitTermination()
        finally:
            for k, v in before.items():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)

    def state(self) -> DataFrame:
        """digest, stays (id, file, row) and n of each digest: its last change."""
        if not there(self.space, "state"):
            kind = self.arrivals().schema["id"].dataType.simpleString()
            return self.spark.createDataFrame([], f"digest binary, stays struct<id:{kind},file:string,row:bigint>, n bigint")
        changes = self.spark.read.parquet(self.space.path("state"))
        if self.epochs() < 2:
            return changes.drop("epoch")
        return changes.groupBy("digest").agg(F.max_by("stays", "epoch").alias("stays"), F.max_by("n", "epoch").alias("n"))

    def texts(self, places: DataFrame, text_col: str) -> DataFrame:
        """digest, id, file, row and low (the normalised text) of rows of the arrivals, read through their locators."""
        files = [unquote(r["file"]) for r in places.select("file").distinct().collect()]  # a list as the reader makes one, too
        if not files:
            return places.select("digest", "id", "file", "row", F.lit("").alias("low")).limit(0)
        wanted = bounded(places.select(F.xxhash64("file", "row").alias("key")).distinct())
        found = self.spark.read.parquet(*files).select(normalised(text_col).alias("low"), place()).withColumn("key", F.xxhash64("place.file", "place.row"))
        found = found.join(wanted, "key", "left_semi").select("low", "place.*")
        return places.select("digest", "id", "file", "row").join(found, ["file", "row"])

    def _check(self, epoch: int, text_col: str) -> None:
        """Compares the bytes behind the digests that were hit since an epoch; notes those that have collided, with their texts' rows."""
        changed = self.spark.read.parquet(self.space.path("state")).where((F.col("epoch") >= epoch) & (F.col("n") > 1)).select("digest").distinct()
        hits = self.space.keep(self.arrivals().join(changed, "digest", "left_semi"), "hits")
        texts = self.texts(hits, text_col)
        collided = texts.groupBy("digest").agg(F.min("low").alias("least"), F.max("low").alias("most")).where("least <> most").select("digest")
        collided = self.space.keep(collided, "collided")
        if not collided.isEmpty():
            parted = self.texts(self.space.keep(hits.join(collided, "digest", "left_semi"), "parting"), text_col)
            parted.withColumn("epoch", F.lit(self.epochs())).write.mode("append").parquet(self.space.path("parted"))
        self.space.drop("hits")

    def classes(self) -> DataFrame:
        """A row for each row seen: id, digest, file, row, keep_id, group_size, kept."""

        def told(rows: DataFrame, own: DataFrame, on: list[str]) -> DataFrame:
            same = (F.col("file") == F.col("stays.file")) & (F.col("row") == F.col("stays.row"))
            return rows.join(own, on).select("id", "digest", "file", "row", F.col("stays.id").alias("keep_id"), F.col("n").alias("group_size"), same.alias("kept"))

        if not there(self.space, "parted"):
            return told(self.arrivals(), self.state(), ["digest"])
        every = self.spark.read.parquet(self.space.path("parted"))
        last = every.groupBy("digest").agg(F.max("epoch").alias("epoch"))  # each check of a digest holds all its rows
        parted = every.join(last, ["digest", "epoch"], "left_semi")
        by_text = parted.groupBy("digest", "low").agg(F.max(F.struct("id", "file", "row")).alias("stays"), F.count("*").alias("n"))
        clear = self.arrivals().join(last.select("digest"), "digest", "left_anti")
        return told(clear, self.state(), ["digest"]).unionByName(told(parted, by_text, ["digest", "low"]))


def there(space: Workspace, name: str) -> bool:
    at = space.spark._jvm.org.apache.hadoop.fs.Path(space.path(name))
    return at.getFileSystem(space.spark._jsc.hadoopConfiguration()).exists(at)


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """A row for each row of docs: id, digest, file, row, keep_id, group_size, kept."""
    seen = Seen(docs.sparkSession, digest=digest)
    seen.take(docs, id_col, text_col)
    return seen.classes()


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns. Rows are told by their places, so no text is hashed again."""
    seen = Seen(docs.sparkSession)
    taken = seen.take(docs, id_col, text_col)
    gone = bounded(seen.space.keep(seen.classes().where("NOT kept").select(F.col("file").alias("of"), F.col("row").alias("at")), "gone"))
    rows = taken.select(whole_row(taken), place())
    return rows.join(gone, (F.col("place.file") == F.col("of")) & (F.col("place.row") == F.col("at")), "left_anti").select("row.*")
