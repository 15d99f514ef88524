"""Query of the media operator."""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import media
from quillstone.llm.common import read

FIELDS = [
    pa.field("n_bytes", pa.int64()),
    pa.field("payload_bytes", pa.int64()),
    pa.field("payload_sha256", pa.string()),
    pa.field("tail_crc32", pa.int64()),
    pa.field("media_bytes", pa.int64()),
    pa.field("media_sha256", pa.string()),
    pa.field("feature", pa.string()),
]


def _digests(stored: bytes, payload: bytes, times: list[int], codes: list[int], n_bytes: int) -> tuple:
    feature = ",".join([f"{t}:{c:x}" for t, c in zip(times, codes)])
    return n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), feature


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("raw"))
    return media.analyse(media.store(docs, "doc_id", "raw"), "doc_id", ["n_bytes"], FIELDS, _digests)
