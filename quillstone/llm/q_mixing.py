"""Query and pipeline stage of the mixing operator, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import mixing
from quillstone.llm.common import read, whole_row


def op6_golden_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs as the mix takes them: a row for each whole time that its words are taken, rounded; documents not taken go.

    Rows that share an id are taken alike, as often as the one of them that is taken most. Null ids take part.
    """
    times = mixing.mix(docs).where("size > 0").groupBy("doc_id").agg(F.max(F.round(F.col("taken") / F.col("size"))).cast("int").alias("times"))
    whole = docs.select(whole_row(docs), F.col("doc_id").alias("id"))
    joined = whole.join(times.where("times > 0"), F.col("id").eqNullSafe(F.col("doc_id")))
    return joined.select("row", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy")).select("row.*")


def oracle() -> str:
    weights = ", ".join(map(str, mixing.WEIGHTS))
    n, cap, whole = len(mixing.WEIGHTS), mixing.CAP, f"{mixing.WHOLE}::HUGEINT"
    return f"""
WITH sized AS (SELECT row_number() OVER () AS rid, doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{mixing.WORD}')), 0) AS BIGINT) AS size, md5(concat('mix:', coalesce(CAST(doc_id AS VARCHAR), ''))) AS place FROM documents),
named AS (SELECT row_number() OVER (ORDER BY source NULLS LAST) AS sid, source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, [{weights}][(sid - 1) % {n} + 1] AS weight FROM named),
level AS (SELECT *, {cap} * source_size / weight AS room,
  (sum(source_size) OVER () - {cap} * coalesce(sum(source_size) OVER (ORDER BY {cap} * source_size / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY {cap} * source_size / weight, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
share AS (SELECT arg_min(level, (room, sid)) AS share FROM level WHERE NOT {cap} * source_size < level * weight),
targets AS (SELECT sid, source, source_size, least(CAST({cap} * source_size AS DOUBLE), share * weight) AS target, CAST(least({mixing.BLOCK}, greatest(1, source_size // {mixing.LEAST_BLOCKS})) AS BIGINT) AS block FROM level, share),
blocked AS (SELECT *, (source_size + block - 1) // block AS blocks, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS passes FROM targets),
sources AS (SELECT *, least({cap} * blocks, passes * blocks + least(blocks, CAST(round((target - passes * source_size) / block) AS BIGINT))) AS slots FROM blocked),
bounds AS (SELECT sid, slots, blocks, sum(slots) OVER (ORDER BY sid) AS upto, sum(slots) OVER () AS everything FROM sources WHERE slots > 0),
ranges AS (SELECT sid, slots, blocks, CAST((upto - slots)::HUGEINT * {whole} // everything::HUGEINT AS BIGINT) AS low, CAST(upto::HUGEINT * {whole} // everything::HUGEINT AS BIGINT) AS high FROM bounds),
points AS (SELECT i, CAST(i::HUGEINT * {mixing.GOLDEN}::HUGEINT % {whole} AS BIGINT) AS u FROM (SELECT unnest(range(CAST(floor((SELECT sum(slots) FROM sources) * {1 + mixing.SPARE}::DOUBLE) AS BIGINT) + 64)) AS i)),
placed AS (SELECT sid, slots, blocks, row_number() OVER (PARTITION BY sid ORDER BY i) - 1 AS rank FROM points JOIN ranges ON u >= low AND u < high),
late AS (SELECT s.sid, s.slots, s.blocks, unnest(range(coalesce(p.found, 0), s.slots)) AS rank FROM sources s LEFT JOIN (SELECT sid, count(*) AS found FROM placed GROUP BY 1) p USING (sid) WHERE coalesce(p.found, 0) < s.slots),
taken AS (SELECT sid, rank % blocks AS number, count(*) AS times FROM (SELECT sid, rank, slots, blocks FROM placed UNION ALL SELECT sid, rank, slots, blocks FROM late) WHERE rank < slots GROUP BY 1, 2),
laid AS (SELECT s.*, t.sid, t.source_size, t.target, t.block, sum(size) OVER (PARTITION BY s.source ORDER BY place, doc_id, size ROWS UNBOUNDED PRECEDING) AS high FROM sized s JOIN sources t ON s.source IS NOT DISTINCT FROM t.source),
pieces AS (SELECT *, unnest(range(CAST((high - size) // block AS BIGINT), CAST((high - 1) // block + 1 AS BIGINT))) AS number FROM laid WHERE size > 0),
summed AS (SELECT rid, sum((least(high, (p.number + 1) * block) - greatest(high - size, p.number * block)) * times) AS taken FROM pieces p JOIN taken USING (sid, number) GROUP BY rid)
SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM laid LEFT JOIN summed USING (rid)"""
