"""Query of the language operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import language
from quillstone.llm.common import read


def op7_language_bitmask(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.learn(docs.where(~language.held_out()))
    keyed = docs.select(F.struct("doc_id", language.held_out().alias("held_out")).alias("row"), "text")
    return language.identify(keyed, model, ["row"]).select("row.doc_id", "row.held_out", "lang_pred", "score")
