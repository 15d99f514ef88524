"""Queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillstone.llm import q_bpe, q_exact_dedup, q_html, q_language, q_licenses, q_media, q_mixing, q_ngram_join, q_pii, q_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": q_bpe.op1_byte_bpe,
    "op2_media_columns": q_media.op2_media_columns,
    "op3_exact_dedup": q_exact_dedup.op3_exact_dedup,
    "op4_toxicity_chain": q_toxicity.op4_toxicity_chain,
    "op5_pii_boosted": q_pii.op5_pii_boosted,
    "op6_golden_mix": q_mixing.op6_golden_mix,
    "op7_language_bitmask": q_language.op7_language_bitmask,
    "op8_html_main_text": q_html.op8_html_main_text,
    "op9_ngram_jaccard": q_ngram_join.op9_ngram_jaccard,
    "op10_license_scan": q_licenses.op10_license_scan,
}

ORACLES: dict[str, str] = {
    "op3_exact_dedup": q_exact_dedup.ORACLE,
    "op6_golden_mix": q_mixing.oracle(),
    "op9_ngram_jaccard": q_ngram_join.ORACLE,
    "op10_license_scan": q_licenses.oracle(),
}
