"""Readers and writers of documents outside tables."""

from __future__ import annotations

import datetime as dt
import decimal
import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

from quillstone.operators.privacy import csv_ready

# What a text has to look like to be read as a time or an id.
ISO_TIME = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:Z|[+-]\d{2}:\d{2})?$"
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A document per line. With a schema, typed columns; without, one VARIANT column `doc`."""
    if schema is None:
        return spark.read.text(path).select(F.try_parse_json("value").alias("doc"))
    return spark.read.schema(schema).json(path)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """With a header; nested values as JSON."""
    csv_ready(df).write.mode(mode).option("header", True).option("escape", '"').csv(path)


def export_subject(tables: dict[str, tuple[DataFrame, str]], subject, path: str, form: str = "json") -> None:
    """All that concerns a subject, a folder for each collection, as JSON lines, CSV or BSON streams; tables: name -> (rows, field)."""
    if form not in ("json", "csv", "bson"):
        raise ValueError("exports are json, csv or bson")
    for name, (df, field) in tables.items():
        rows = df.where(F.col(field) == F.lit(subject))
        {"json": write_json, "csv": write_csv, "bson": write_bson}[form](rows, f"{path}/{name}", mode="overwrite")


def to_document(df: DataFrame) -> Column:
    """A row as JSON text."""
    return F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})


def value_kind(text: Column) -> Column:
    """How a JSON scalar's text is read: null, bool, int32, int64, double, datetime, uuid or string."""
    number = F.rlike(text, F.lit(r"^-?\d+$"))
    big = text.try_cast("decimal(38,0)")
    return (
        F.when(text.isNull() | (text == "null"), "null")
        .when(text.isin("true", "false"), "bool")
        .when(number & big.between(-(1 << 31), (1 << 31) - 1), "int32")
        .when(number & big.between(-(1 << 63), (1 << 63) - 1), "int64")
        .when(F.rlike(text, F.lit(r"^-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?$")), "double")
        .when(F.rlike(text, F.lit(ISO_TIME)), "datetime")
        .when(F.rlike(text, F.lit(UUID)), "uuid")
        .otherwise("string")
    )


_EXPONENT_BIAS = 6176  # fixed value of the decimal128 encoding


def bson(row: dict) -> bytes:
    """A document in the public BSON encoding: nulls, booleans, integers, doubles, decimals, strings, bytes, times, lists and dicts."""

    def element(name: str, v) -> bytes:
        key = name.encode() + b"\0"
        if v is None:
            return b"\x0a" + key
        if isinstance(v, bool):
            return b"\x08" + key + bytes([v])
        if isinstance(v, int):
            return b"\x10" + key + struct.pack("<i", v) if -(1 << 31) <= v < 1 << 31 else b"\x12" + key + struct.pack("<q", v)
        if isinstance(v, float):
            return b"\x01" + key + struct.pack("<d", v)
        if isinstance(v, decimal.Decimal):
            sign, digits, exponent = v.as_tuple()
            value = int("".join(map(str, digits)))
            return b"\x13" + key + (value | (exponent + _EXPONENT_BIAS) << 113 | sign << 127).to_bytes(16, "little")
        if isinstance(v, str):
            raw = v.encode() + b"\0"
            return b"\x02" + key + struct.pack("<i", len(raw)) + raw
        if isinstance(v, (bytes, bytearray)):
            return b"\x05" + key + struct.pack("<iB", len(v), 0) + bytes(v)
        if isinstance(v, dt.date):
            at = v if isinstance(v, dt.datetime) else dt.datetime(v.year, v.month, v.day)
            at = at if at.tzinfo else at.replace(tzinfo=dt.timezone.utc)
            return b"\x09" + key + struct.pack("<q", (at - _EPOCH) // dt.timedelta(milliseconds=1))
        if isinstance(v, dict):
            return b"\x03" + key + bson(v)
        if isinstance(v, (list, tuple)):
            return b"\x04" + key + bson({str(k): x for k, x in enumerate(v)})
        return element(name, str(v))

    body = b"".join(element(k, v) for k, v in row.items()) + b"\0"
    return struct.pack("<i", len(body) + 4) + body


_EPOCH = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)


def unbson(raw: bytes) -> dict:
    """A document from its BSON encoding, of the kinds that bson() writes; times come back in UTC."""

    def value(kind: int, at: int):
        if kind == 0x0A:
            return None, at
        if kind == 0x08:
            return raw[at] == 1, at + 1
        if kind in (0x10, 0x12, 0x01, 0x09):
            form = {0x10: "<i", 0x12: "<q", 0x01: "<d", 0x09: "<q"}[kind]
            (v,) = struct.unpack_from(form, raw, at)
            return (_EPOCH + dt.timedelta(milliseconds=v) if kind == 0x09 else v), at + struct.calcsize(form)
        if kind == 0x13:
            bits = int.from_bytes(raw[at : at + 16], "little")
            digits = tuple(map(int, str(bits & (1 << 113) - 1)))
            return decimal.Decimal((bits >> 127, digits, (bits >> 113 & 0x3FFF) - _EXPONENT_BIAS)), at + 16
        (size,) = struct.unpack_from("<i", raw, at)
        if kind == 0x02:
            return raw[at + 4 : at + 3 + size].decode(), at + 4 + size
        if kind == 0x05:
            return raw[at + 5 : at + 5 + size], at + 5 + size
        if kind in (0x03, 0x04):
            own = unbson(raw[at : at + size])
            return (own if kind == 0x03 else list(own.values())), at + size
        raise ValueError(f"kind {kind:#x} isn't known")

    out, at = {}, 4
    while raw[at]:
        end = raw.index(b"\0", at + 1)
        out[raw[at + 1 : end].decode()], at = value(raw[at], end + 1)
    return out


def bson_documents(df: DataFrame, name: str = "document") -> DataFrame:
    """A binary column with each row's document; written one after the other they are a BSON stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([bson(r) for r in batch.to_pylist()], pa.binary())], names=[name])

    return df.mapInArrow(run, f"{name} binary")


class BsonStreams(DataSource):
    """Spark data source "bson": files of documents one after the other, as rows with a binary `document`.

    The path is a folder that all executors reach as files. Each file is read by one task; a write makes a file a task.
    """

    @classmethod
    def name(cls) -> str:
        return "bson"

    def schema(self) -> str:
        return "document binary"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _BsonReader(_folder(self.options["path"]))

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return _BsonWriter(_folder(self.options["path"]), overwrite)


def _folder(path: str) -> str:
    return path.removeprefix("file://").removeprefix("file:")


class _BsonReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        names = [self.path] if os.path.isfile(self.path) else sorted(os.path.join(self.path, n) for n in os.listdir(self.path) if n.endswith(".bson"))
        return [InputPartition(n) for n in names]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition is None:
            return
        with open(partition.value, "rb") as f:
            while head := f.read(4):
                yield (head + f.read(int.from_bytes(head, "little") - 4),)


@dataclass
class _Written(WriterCommitMessage):
    name: str


class _BsonWriter(DataSourceWriter):
    """Tasks write hidden files; the job's commit shows them, so a failed write shows none."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        os.makedirs(self.path, exist_ok=True)
        name = f"part-{uuid.uuid4().hex}.bson"
        with open(os.path.join(self.path, "_" + name), "wb") as f:
            for row in iterator:
                f.write(row[0])
        return _Written(name)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        old = [n for n in os.listdir(self.path) if n.endswith(".bson") and not n.startswith("_")] if self.overwrite else []
        for m in messages:
            if m is not None:
                os.rename(os.path.join(self.path, "_" + m.name), os.path.join(self.path, m.name))
        for n in old:
            os.remove(os.path.join(self.path, n))

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        for m in messages:
            if m is not None and os.path.exists(os.path.join(self.path, "_" + m.name)):
                os.remove(os.path.join(self.path, "_" + m.name))


def write_bson(df: DataFrame, path: str, mode: str = "append") -> None:
    df.sparkSession.dataSource.register(BsonStreams)
    bson_documents(df).write.format("bson").option("path", path).mode(mode).save()


def read_bson(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """The documents of a stream; with a schema, as its columns (fields that a document lacks are null)."""
    spark.dataSource.register(BsonStreams)
    rows = spark.read.format("bson").option("path", path).load()
    if schema is None:
        return rows
    wanted = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = [unbson(raw) for raw in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([_fits(r.get(f.name), f.type) for r in read], f.type) for f in arrow], names=arrow.names)

    return rows.mapInArrow(run, wanted)


def _fits(v, kind: pa.DataType):
    """A value as an Arrow type takes it: BSON knows no dates, and its times have a zone."""
    if isinstance(v, dt.datetime):
        return v.date() if pa.types.is_date(kind) else v.replace(tzinfo=None) if pa.types.is_timestamp(kind) and kind.tz is None else v
    return v
