"""The corpus pipeline: stages that turn documents into encoded training data.

toxicity: documents that the classifier chain calls toxic go.
exact_dedup: of equal texts the row with the largest id stays.
near_dedup: of each group that the n-gram join links, the document with the smallest id stays.
mixing: each source comes to its share of the words; a document appears as often as the mix takes it whole, rounded.
encode: byte-level BPE; a row per document of the mix, with the number of tokens and the digests of ids and bytes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillstone.llm import q_bpe, q_exact_dedup, q_mixing, q_ngram_join, q_toxicity
from quillstone.llm.common import Workspace, read

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return q_bpe.encode_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", q_toxicity.keep_clean),
    ("exact_dedup", q_exact_dedup.keep_one),
    ("near_dedup", q_ngram_join.keep_representatives),
    ("mixing", q_mixing.mixed),
    ("encode", encode),
]

#: Trained models and BPE cannot be written in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents; each result is written and read again before the next stage."""
    docs, space = read(spark, sf_dir, "documents"), Workspace(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        docs = space.keep(stage(spark, docs, sf_dir), name)
        if k:
            space.drop(STAGES[k - 1][0])
    return STAGES[-1][1](spark, docs, sf_dir)
