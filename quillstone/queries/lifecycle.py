"""Queries of vectors, places, time series, retention, key-value tables, changes, privacy, metrics and text."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions.text import embedding_text, normalize, source_text
from quillstone.operators import changes, keyvalue, metrics, privacy, retention, search
from quillstone.plans.query import DocQuery
from quillstone.queries.common import Query, table
from quillstone.queries.filters import _PLACES, away, places
from quillstone.sources.catalog import Collection, Database
from quillstone.sources.files import to_document, value_kind
from quillstone.sources.shared import shared_root
from quillstone.streaming import watch, windows

QUERIES: dict[str, tuple[Query, str | None]] = {}


def register(name: str, sql: str | None):
    def keep(fn: Query) -> Query:
        QUERIES[name] = (fn, sql)
        return fn

    return keep


def _query_vector(spark: SparkSession, d: str, id_: int = 0) -> list[float]:
    return list(table(spark, d, "embeddings").where(F.col("vec_id") == id_).first()["embedding"])


def _vector_sql(distance: str) -> str:
    return f"SELECT vec_id, round(distance, 6) AS distance FROM (SELECT vec_id, {distance} AS distance FROM (SELECT vec_id, embedding::DOUBLE[] AS v, (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0) AS q FROM embeddings)) ORDER BY distance, vec_id LIMIT 10"


def _top(spark: SparkSession, d: str, metric: str) -> DataFrame:
    found = search.nearest(table(spark, d, "embeddings"), "embedding", _query_vector(spark, d), 10, "vec_id", metric)
    return found.select("vec_id", F.round("distance", 6).alias("distance"))


@register("vector_cosine", _vector_sql("1 - list_cosine_similarity(v, q)"))
def vector_cosine(spark: SparkSession, d: str) -> DataFrame:
    return _top(spark, d, "cosine")


@register("vector_l2", _vector_sql("pow(list_distance(v, q), 2)"))
def vector_l2(spark: SparkSession, d: str) -> DataFrame:
    return _top(spark, d, "l2")


@register("vector_dot", _vector_sql("-list_inner_product(v, q)"))
def vector_dot(spark: SparkSession, d: str) -> DataFrame:
    return _top(spark, d, "dot")


@register("vector_filtered", "SELECT vec_id FROM (SELECT vec_id, label, embedding::DOUBLE[] AS v, (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0) AS q FROM embeddings) WHERE label < 5 ORDER BY 1 - list_cosine_similarity(v, q), vec_id LIMIT 7")
def vector_filtered(spark: SparkSession, d: str) -> DataFrame:
    return DocQuery(table(spark, d, "embeddings"), "vec_id").filter({"label": {"$lt": 5}, "embedding": {"$nearVector": {"$vector": _query_vector(spark, d), "$k": 7}}}).project().frame()


@register("vector_multi", "SELECT label, round(min(1 - list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0))), 6) AS distance FROM embeddings GROUP BY 1 ORDER BY 2, 1 LIMIT 4")
def vector_multi(spark: SparkSession, d: str) -> DataFrame:
    """A label has many vectors; the nearest of them counts."""
    found = search.nearest_groups(table(spark, d, "embeddings"), "embedding", _query_vector(spark, d), 4, "label")
    return found.select("label", F.round("distance", 6).alias("distance"))


@register("geo_near_box", f"SELECT c_custkey FROM {_PLACES} WHERE lat BETWEEN 48 - degrees(1000 / 6371.0) AND 48 + degrees(1000 / 6371.0) AND lon BETWEEN 11 - degrees(1000 / (6371.0 * cos(radians(48)))) AND 11 + degrees(1000 / (6371.0 * cos(radians(48))))")
def geo_near_box(spark: SparkSession, d: str) -> DataFrame:
    return search.near(places(spark, d), "place", (48, 11), 1000).select("c_custkey")


@register("geo_near_exact", f"SELECT c_custkey, round({away(48, 11)}, 6) AS km FROM {_PLACES} WHERE {away(48, 11)} <= 1000")
def geo_near_exact(spark: SparkSession, d: str) -> DataFrame:
    return search.near(places(spark, d), "place", (48, 11), 1000, exact=True, name="km").select("c_custkey", F.round("km", 6).alias("km"))


@register("geo_within", f"SELECT c_custkey FROM {_PLACES} WHERE lat BETWEEN -20 AND 20 AND lon BETWEEN -50 AND 50")
def geo_within(spark: SparkSession, d: str) -> DataFrame:
    return search.within(places(spark, d), "place", (-20, -50), (20, 50)).select("c_custkey")


def _now(spark: SparkSession, d: str) -> dt.datetime:
    return table(spark, d, "events").agg(F.max("ts")).first()[0]


@register("series_prune", "SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1 HAVING max(ts) >= (SELECT max(ts) - INTERVAL 60 HOUR FROM events)")
def series_prune(spark: SparkSession, d: str) -> DataFrame:
    kept = retention.prune_parts(table(spark, d, "events"), "ts", F.lit(_now(spark, d) - dt.timedelta(hours=60)))
    return kept.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))


@register("retention_age", "SELECT event_id FROM (SELECT event_id, CASE WHEN event_id % 50 <> 0 THEN ts END AS moment FROM events) WHERE moment IS NULL OR moment >= (SELECT max(ts) - INTERVAL 12 HOUR FROM events)")
def retention_age(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 50 != 0, F.col("ts")).alias("moment"))
    return retention.by_age(e, "moment", _now(spark, d), dt.timedelta(hours=12)).select("event_id")


@register("retention_count", "SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 500")
def retention_count(spark: SparkSession, d: str) -> DataFrame:
    return retention.by_count(table(spark, d, "events"), 500, "event_id", "ts").select("event_id")


@register("retention_bytes", "SELECT event_id FROM (SELECT event_id, sum(octet_length(encode(props)) + 24) OVER (ORDER BY ts DESC, event_id DESC) AS bytes FROM events) WHERE bytes <= 50000")
def retention_bytes(spark: SparkSession, d: str) -> DataFrame:
    return retention.by_bytes(table(spark, d, "events"), 50000, F.octet_length("props") + 24, "event_id", "ts").select("event_id")


def _change_log(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", changes.DELETE).otherwise(changes.UPDATE)
    return table(spark, d, "events").select("ts", F.col("event_id").alias("txn"), kind.alias("type"), F.col("user_id").alias("id"), "event_type", "value")


@register("changes_applied", "SELECT id, value FROM (SELECT user_id AS id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS nth FROM events) WHERE nth = 1 AND event_type <> 'error'")
def changes_applied(spark: SparkSession, d: str) -> DataFrame:
    return changes.state(_change_log(spark, d)).select("id", "value")


@register("changes_to_table", "SELECT id, value FROM (SELECT user_id AS id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS nth FROM events) WHERE nth = 1 AND event_type <> 'error' UNION ALL SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)")
def changes_to_table(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("value"))
    return changes.apply(old, _change_log(spark, d))


@register("changes_between", "SELECT CASE WHEN a.c_custkey IS NULL THEN 'insert' WHEN b.id IS NULL THEN 'delete' ELSE 'update' END AS type, count(*) AS n FROM customer a FULL JOIN (SELECT c_custkey + 10 AS id, c_nationkey FROM customer) b ON a.c_custkey = b.id WHERE a.c_nationkey IS DISTINCT FROM b.c_nationkey GROUP BY 1")
def changes_between(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_nationkey")
    return changes.log_of(old, old.withColumn("id", F.col("id") + 10), "id").groupBy("type").agg(F.count("*").alias("n"))


@register("changes_masked", "SELECT c_custkey, '***' AS c_name, c_nationkey, '***' AS c_acctbal FROM customer")
def changes_masked(spark: SparkSession, d: str) -> DataFrame:
    return changes.masked(table(spark, d, "customer"), ["C_NAME", "c_acctbal"], changes.Watch(exclude=("c_mktsegment",)), ["c_custkey"])


@register("changes_allowlist", "SELECT c_custkey, c_name FROM customer")
def changes_allowlist(spark: SparkSession, d: str) -> DataFrame:
    return changes.masked(table(spark, d, "customer"), ["c_name"], changes.Watch(only=("c_name",), exclude=("c_name",)), ["c_custkey"])


def _kv(spark: SparkSession, d: str) -> DataFrame:
    ttl = F.expr("make_dt_interval(0, event_id % 48, 0, 0)")
    return table(spark, d, "events").select(F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("key"), "value", F.when(F.col("event_id") % 3 != 0, F.col("ts") + ttl).alias("expires"), F.col("event_id").alias("seq"))


_KV = "(SELECT * FROM (SELECT 'user:' || user_id AS key, value, CASE WHEN event_id % 3 <> 0 THEN ts + to_hours(event_id % 48) END AS expires, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS nth FROM events) WHERE nth = 1 AND (expires IS NULL OR expires > (SELECT max(ts) FROM events)))"


@register("kv_live", f"SELECT key, value FROM {_KV}")
def kv_live(spark: SparkSession, d: str) -> DataFrame:
    return keyvalue.live(_kv(spark, d), F.lit(_now(spark, d))).select("key", "value")


@register("kv_prefix", f"SELECT key, value FROM {_KV} WHERE starts_with(key, 'user:1')")
def kv_prefix(spark: SparkSession, d: str) -> DataFrame:
    return keyvalue.scan_prefix(_kv(spark, d), "user:1", F.lit(_now(spark, d))).select("key", "value")


@register("subject_export", "SELECT 'customer' AS collection, count(*) AS n FROM customer WHERE c_custkey = 42 UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_custkey = 42 UNION ALL SELECT 'nation', count(*) FROM nation WHERE n_nationkey = 42")
def subject_export(spark: SparkSession, d: str) -> DataFrame:
    tables = {n: (table(spark, d, n), f) for n, f in (("customer", "c_custkey"), ("orders", "o_custkey"), ("nation", "n_nationkey"))}
    return privacy.subject_counts(tables, 42, spark)


@register("subject_documents", """SELECT 'nation' AS collection, '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}' AS document FROM nation WHERE n_regionkey = 2""")
def subject_documents(spark: SparkSession, d: str) -> DataFrame:
    return privacy.subject_rows({"nation": (table(spark, d, "nation"), "n_regionkey")}, 2)


@register("inspection", "SELECT * FROM (VALUES ('customer', 5, 'c_acctbal,c_name', true), ('nation', 3, '', false)) t(collection, fields, personal, retained)")
def inspection(spark: SparkSession, d: str) -> DataFrame:
    customer = privacy.annotate(table(spark, d, "customer"), c_name="personal", c_acctbal="sensitive")
    return privacy.inspect(spark, {"customer": customer, "nation": table(spark, d, "nation")}, ["customer"])


def _event_log(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("ts", (F.col("user_id") % 3).cast("string").alias("collection"), F.col("event_type").alias("type"), F.floor(F.col("value") * 100).alias("micros"), F.octet_length("props").alias("size"))


@register("metrics_snapshot", "SELECT CAST(user_id % 3 AS VARCHAR) AS collection, event_type AS type, count(*) AS n, round(coalesce(avg(CAST(floor(value * 100) AS BIGINT)), 0), 6) AS avg_micros, round(coalesce(avg(octet_length(encode(props))), 0), 6) AS avg_size FROM events GROUP BY 1, 2")
def metrics_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return metrics.snapshot(_event_log(spark, d)).select("collection", "type", "n", F.round("avg_micros", 6).alias("avg_micros"), F.round("avg_size", 6).alias("avg_size"))


@register("text_normalized", r"SELECT doc_id, trim(regexp_replace(lower(strip_accents(coalesce(text, ''))), '[^\p{L}\p{Nd}]+', ' ', 'g')) AS normal FROM documents")
def text_normalized(spark: SparkSession, d: str) -> DataFrame:
    """Every document, null and non-ASCII texts too. Tests also compare with a brute force, on odd texts."""
    return table(spark, d, "documents").select("doc_id", normalize(F.col("text")).alias("normal"))


@register("text_embedding", "SELECT p_partkey, concat_ws(',', 'p_name:' || trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')), 'p_brand:' || trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', ' ', 'g')), 'p_size:' || p_size) AS text FROM part")
def text_embedding(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select("p_partkey", embedding_text({c: p[c] for c in ("p_name", "p_brand", "p_size")}).alias("text"))


@register("text_source", "SELECT p_partkey, '[' || p_name || '] by ' || p_brand AS text FROM part")
def text_source(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select("p_partkey", source_text([(p["p_name"], "[", "]"), (p["p_brand"], "by ", "")]).alias("text"))


@register("json_kinds", "SELECT event_type, CAST(sum(CAST(props->>'$.k' AS BIGINT)) AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1")
def json_kinds(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    return table(spark, d, "events").where(value_kind(k) == "int32").groupBy("event_type").agg(F.sum(k.cast("long")).alias("k"), F.count("*").alias("n"))


@register("json_round_trip", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def json_round_trip(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return o.select(F.from_json(to_document(o), o.schema).alias("x")).select("x.*")


@register("window_tumbling", "SELECT time_bucket(INTERVAL 6 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def window_tumbling(spark: SparkSession, d: str) -> DataFrame:
    return windows.tumbling(table(spark, d, "events"), "ts", "6 hours", F.count("*").alias("n"), by=("event_type",)).select("start", "event_type", "n")


@register("window_sliding", "SELECT start, count(*) AS n FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts) - to_hours(k) AS start FROM events, (VALUES (0), (1), (2)) t(k)) GROUP BY 1")
def window_sliding(spark: SparkSession, d: str) -> DataFrame:
    return windows.sliding(table(spark, d, "events"), "ts", "3 hours", "1 hour", F.count("*").alias("n")).select("start", "n")


@register("window_session", "SELECT user_id, count(*) AS n, max(width) AS longest FROM (SELECT user_id, run, count(*) AS width FROM (SELECT user_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY 1, 2) GROUP BY 1")
def window_session(spark: SparkSession, d: str) -> DataFrame:
    own = windows.sessions(table(spark, d, "events"), "ts", "30 minutes", F.count("*").alias("width"), by=("user_id",))
    return own.groupBy("user_id").agg(F.count("*").alias("n"), F.max("width").alias("longest"))


def _database(spark: SparkSession, d: str) -> Collection:
    """nation in a database of its own: inserted, then rows updated and deleted."""
    db = Database(spark, f"{shared_root(spark)}/database-{uuid.uuid4().hex}")
    rows = table(spark, d, "nation")
    own = db.create("nation", "n_nationkey", rows.schema)
    own.insert(rows)
    own.update(rows.where("n_nationkey < 3").withColumn("n_name", F.concat(F.lit("new "), F.col("n_name"))))
    own.delete([5, 7, 99])
    own.create_index("by_region", "n_regionkey")
    return own


@register("catalog_writes", "SELECT n_nationkey, CASE WHEN n_nationkey < 3 THEN 'new ' || n_name ELSE n_name END AS n_name, n_regionkey FROM nation WHERE n_nationkey NOT IN (5, 7)")
def catalog_writes(spark: SparkSession, d: str) -> DataFrame:
    return _database(spark, d).frame()


@register("catalog_range", "SELECT n_nationkey, n_regionkey FROM nation WHERE n_regionkey BETWEEN 1 AND 3 AND n_nationkey NOT IN (5, 7) ORDER BY n_regionkey DESC, n_nationkey OFFSET 2 LIMIT 8")
def catalog_range(spark: SparkSession, d: str) -> DataFrame:
    return _database(spark, d).range("n_regionkey", 1, 3, ascending=False, skip=2, take=8).select("n_nationkey", "n_regionkey")


@register("kv_purged", f"SELECT count(*) AS n, CAST(sum(seq) AS BIGINT) AS seqs FROM (SELECT k.*, e.seq FROM {_KV} k JOIN (SELECT 'user:' || user_id AS key, max(event_id) AS seq FROM events GROUP BY 1) e USING (key))")
def kv_purged(spark: SparkSession, d: str) -> DataFrame:
    return keyvalue.purge(_kv(spark, d), F.lit(_now(spark, d))).agg(F.count("*").alias("n"), F.sum("seq").alias("seqs"))


@register("retention_policy", "SELECT event_id FROM (SELECT event_id, ts FROM events WHERE ts >= (SELECT max(ts) - INTERVAL 24 HOUR FROM events) ORDER BY ts DESC, event_id DESC LIMIT 300)")
def retention_policy(spark: SparkSession, d: str) -> DataFrame:
    policy = retention.Policy("ts", dt.timedelta(hours=24), 300)
    return retention.apply(table(spark, d, "events"), policy, _now(spark, d), "event_id").select("event_id")


@register("slow_queries", "SELECT event_type AS type, count(*) AS n FROM events WHERE event_type = 'purchase' AND floor(value * 100) >= 1000 GROUP BY 1")
def slow_queries(spark: SparkSession, d: str) -> DataFrame:
    log = _event_log(spark, d).withColumn("type", F.when(F.col("type") == "purchase", "query").otherwise(F.col("type")))
    return metrics.slow(log, 1000).groupBy(F.lit("purchase").alias("type")).agg(F.count("*").alias("n"))


@register("stream_state", "SELECT user_id AS id, count(*) AS n, max(ts) AS last FROM events GROUP BY 1")
def stream_state(spark: SparkSession, d: str) -> DataFrame:
    """Number and last time of each id's changes, kept by a stateful stream; a batch writes what it changed, and the last of an id counts."""
    root = f"{shared_root(spark)}/stream-state-{uuid.uuid4().hex}"
    watch.publish(_change_log(spark, d).withColumn("collection", F.lit("users")), f"{root}/log")
    log = spark.read.parquet(f"{root}/log")
    counted = spark.readStream.schema(log.schema).parquet(f"{root}/log").groupBy("id").agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    query = counted.writeStream.outputMode("update").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).foreachBatch(lambda df, k: df.write.mode("overwrite").parquet(f"{root}/out/batch={k}")).start()
    query.awaitTermination()
    changed = spark.read.parquet(f"{root}/out")
    return changed.groupBy("id").agg(F.max_by("n", "batch").alias("n"), F.max_by("last", "batch").alias("last"))


def _streamed(spark: SparkSession, d: str, own: changes.Watch, personal: tuple[str, ...], collection: str | None) -> DataFrame:
    """A log of two collections, read as a stream by one subscriber into a table."""
    root = f"{shared_root(spark)}/stream-changes-{uuid.uuid4().hex}"
    log = _change_log(spark, d).withColumn("collection", F.when(F.col("id") % 2 == 0, "users").otherwise("guests"))
    watch.publish(log, f"{root}/log")
    seen = watch.changes(spark, f"{root}/log", log.schema, own, personal, collection)
    watch.to_table(seen, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{root}/out")


_LOG_SQL = "ts, event_id AS txn, CASE WHEN user_id % 2 = 0 THEN 'users' ELSE 'guests' END AS collection, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'update' END AS type, user_id AS id"


@register("stream_changes", f"SELECT {_LOG_SQL}, '***' AS value FROM events WHERE user_id % 2 = 0")
def stream_changes(spark: SparkSession, d: str) -> DataFrame:
    """One collection's changes, masked on the way."""
    return _streamed(spark, d, changes.Watch(exclude=("event_type",)), ("value",), "users")


@register("stream_without_payload", f"SELECT {_LOG_SQL} FROM events")
def stream_without_payload(spark: SparkSession, d: str) -> DataFrame:
    """The changes of all collections, as a subscriber of the whole database sees them, without what was written."""
    return _streamed(spark, d, changes.Watch(payload=False), (), None)


@register("stream_subscribers", "SELECT who, count(*) AS n, CAST(sum(user_id) AS BIGINT) AS ids FROM events, (VALUES ('all'), ('guests'), ('users')) w(who) WHERE who = 'all' OR (who = 'users') = (user_id % 2 = 0) GROUP BY 1")
def stream_subscribers(spark: SparkSession, d: str) -> DataFrame:
    """Three subscribers with a checkpoint each; none waits for another."""
    root = f"{shared_root(spark)}/stream-subscribers-{uuid.uuid4().hex}"
    log = _change_log(spark, d).withColumn("collection", F.when(F.col("id") % 2 == 0, "users").otherwise("guests"))
    watch.publish(log, f"{root}/log")

    def note(who: str):
        def write(batch: DataFrame, k: int) -> None:
            batch.agg(F.count("*").alias("n"), F.sum("id").alias("ids")).withColumn("who", F.lit(who)).write.mode("overwrite").parquet(f"{root}/out/{who}-{k}")

        return write

    running = [watch.subscribe(watch.changes(spark, f"{root}/log", log.schema, collection=of), f"{root}/{who}", note(who), once=True) for who, of in (("all", None), ("users", "users"), ("guests", "guests"))]
    for query in running:
        query.awaitTermination()
    return spark.read.option("recursiveFileLookup", True).schema("n long, ids long, who string").parquet(f"{root}/out").groupBy("who").agg(F.sum("n").alias("n"), F.sum("ids").alias("ids"))
