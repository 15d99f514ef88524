"""Query and pipeline stage of the n-gram Jaccard join, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import ngram_join
from quillstone.llm.common import LOWER, UPPER, Workspace, bounded, read, whole_row
from quillstone.llm.shingles import SIZE


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(read(spark, sf_dir, "documents"))


def keep_representatives(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with one document of each group, the one with the smallest id; rows that share an id stay or go together, null ids stay."""
    joined = ngram_join.join(docs).where("NOT doc_id <=> component_id").select(F.col("doc_id").alias("goes")).distinct()
    gone = bounded(Workspace(spark, "near-dedup").keep(joined, "gone"))
    whole = docs.select(whole_row(docs), F.col("doc_id").alias("id"))
    return whole.join(gone, F.col("id") == F.col("goes"), "left_anti").select("row.*")


#: DuckDB SQL: all pairs that share a shingle, of one document of each set; it suits small tables only.
ORACLE = f"""
WITH RECURSIVE words AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (SELECT rid, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {SIZE} THEN [array_to_string(w, ' ')]
  ELSE list_sort(list_distinct(list_transform(range(1, len(w) - {SIZE - 2}), lambda i: array_to_string(w[i:i + {SIZE - 1}], ' ')))) END AS s FROM words),
named AS (SELECT rid, doc_id, len(s) AS n, CASE WHEN len(s) = 0 THEN -rid ELSE min(rid) OVER (PARTITION BY s) END AS class FROM sets),
tokens AS (SELECT rid, len(s) AS n, unnest(s) AS token FROM sets WHERE rid IN (SELECT class FROM named)),
pairs AS (SELECT a.rid AS x, b.rid AS y, a.n + b.n AS total, count(*) AS shared FROM tokens a JOIN tokens b ON a.token = b.token AND a.rid < b.rid GROUP BY ALL),
linked AS (SELECT x, y FROM pairs WHERE 100 * shared >= 75 * (total - shared)),
edges AS (SELECT x, y FROM linked UNION ALL SELECT y, x FROM linked),
reached(x, y) AS (SELECT DISTINCT class, class FROM named UNION SELECT r.x, e.y FROM reached r JOIN edges e ON r.y = e.x),
least AS (SELECT x AS class, min(doc_id) AS component_id FROM reached JOIN named ON y = class GROUP BY x)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, CASE WHEN doc_id IS NOT NULL THEN component_id END AS component_id FROM named JOIN least USING (class)"""
