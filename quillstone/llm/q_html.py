"""Query of the HTML operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import html
from quillstone.llm.common import read


def op8_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select(F.struct("page_id", "url").alias("page"), "html")
    return html.extract(pages, "page").select("page.page_id", "page.url", "text", "n_chars")
