"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.sources.shared import shared_root

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z only. Pure ASCII texts take the fast built-in; others keep letters like É as they are."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def whole_row(df: DataFrame, name: str = "row") -> Column:
    """All columns as one struct, so that they travel whatever their names are; `.select(f"{name}.*")` gives them back."""
    return F.struct(*(F.col(f"`{c.replace('`', '``')}`") for c in df.columns)).alias(name)


#: Rows of keys that may be broadcast: ids or places, of 16 bytes or a file name each. Beyond it they are shuffled.
BROADCAST_ROWS = 200_000


def bounded(keys: DataFrame) -> DataFrame:
    """keys (a written table), marked for broadcast if they are few."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys


#: Bytes of input up to which spread() deals rows anew.
SMALL = 256 << 20


def spread(df: DataFrame) -> DataFrame:
    """Deals the rows of a few small files to all cores: a file of one row group is one task, however many cores wait.

    Only names and sizes of the files are looked at. Larger inputs, and those of as many files as cores, stay as they are.
    """
    spark = df.sparkSession
    jvm, cores, files = spark._jvm, spark.sparkContext.defaultParallelism, df.inputFiles()
    if not files or len(files) >= cores:
        return df
    paths = [jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f)) for f in files]
    conf = spark._jsc.hadoopConfiguration()
    return df.repartition(cores) if sum(p.getFileSystem(conf).getFileStatus(p).getLen() for p in paths) <= SMALL else df


#: Of small tables of narrow rows: a file a task would be many tiny ones.
ROWS_A_FILE = 100_000


class Workspace:
    """Written tables in the shared folder. Cuts lineage so that a lost executor costs one stage, not the whole job."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
        """df, written and read again; where it is known to have `rows` rows at most, in files of ROWS_A_FILE or so."""
        df = df if rows is None else df.coalesce(1 + rows // ROWS_A_FILE)
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Deletes tables that nothing reads any more."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            at = jvm.org.apache.hadoop.fs.Path(self.path(name))
            at.getFileSystem(conf).delete(at, True)
