"""Query of the license scan, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import licenses
from quillstone.llm.common import LOWER, UPPER, read


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(read(spark, sf_dir, "documents"))
    joined = F.array_sort(F.array_union("base_labels", "method_labels"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.concat_ws(",", "base_labels").alias("base_labels"), F.concat_ws(",", joined).alias("labels"), "score")


def oracle() -> str:
    """DuckDB SQL: every block against every template of its span, without the filters."""

    def listed(items) -> str:
        return "[" + ", ".join(f"'{x}'" for x in items) + "]"

    places = []
    for phrase, label in licenses.PHRASES.items():
        parts = phrase.split()
        same = " AND ".join(f"w[i + {k}] = '{p}'" for k, p in enumerate(parts))
        places.append(f"SELECT rid, '{label}' AS label, i - 1 AS place FROM (SELECT rid, w, unnest(range(1, len(w) + 1)) AS i FROM words) WHERE {same}")
    templates = ", ".join(f"('{label}', {listed(sorted(set(t.split())))}, {licenses.need(len(set(t.split())))}, {licenses.span(t)})" for label, t in licenses.TEMPLATES)
    spans = ", ".join(f"({c})" for c in sorted({licenses.span(t) for _, t in licenses.TEMPLATES}))
    return f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS low FROM documents),
words AS (SELECT rid, doc_id, regexp_extract_all(low, '{licenses.WORD}') AS w FROM docs),
base AS ({' UNION ALL '.join(places)}),
bases AS (SELECT rid, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list_sort(list_distinct(list(label))) AS labels FROM base GROUP BY rid),
blocks AS (SELECT rid, span, list_distinct(w[k * span + 1 : k * span + 2 * span]) AS w FROM (SELECT rid, w, span, unnest(range(0, greatest(0, CAST(ceil(len(w) / CAST(span AS DOUBLE)) AS BIGINT) - 2) + 1)) AS k FROM words, (VALUES {spans}) s(span))),
templates(label, own, least, span) AS (VALUES {templates}),
matched AS (SELECT rid, list_sort(list_distinct(list(label))) AS labels, max(part / m) AS part FROM (
  SELECT rid, label, least, CAST(len(list_intersect(own, w)) AS DOUBLE) AS part, len(own) AS m FROM blocks JOIN templates USING (span) WHERE list_has_any(own, w)) WHERE part >= least GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(array_to_string(b.labels, ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(m.labels, [])))), ','), '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(part, 0.0)::DOUBLE END AS score
FROM words LEFT JOIN bases b USING (rid) LEFT JOIN matched m USING (rid)"""
