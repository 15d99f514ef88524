"""Query and pipeline stage of the toxicity operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillstone.llm import toxicity
from quillstone.llm.common import read


def op4_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    chain = toxicity.train(docs, read(spark, sf_dir, "labels"))
    return toxicity.score(docs.select("doc_id", "text"), chain)


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without the documents that the chain calls toxic."""
    return toxicity.keep_clean(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))
