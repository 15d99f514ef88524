"""Queries of collections, files, key-value stores, indexes, audit and export, with their SQL."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions.predicates import field
from quillstone.operators import encryption, keyvalue, metrics, privacy, retention, search
from quillstone.plans.query import DocQuery
from quillstone.queries.common import Query, table
from quillstone.queries.filters import _PLACES, away, places
from quillstone.sources import files
from quillstone.sources.catalog import Collection, Database, DuplicateKey
from quillstone.sources.shared import shared_root

QUERIES: dict[str, tuple[Query, str | None]] = {}


def register(name: str, sql: str | None):
    def keep(fn: Query) -> Query:
        QUERIES[name] = (fn, sql)
        return fn

    return keep


def fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def collection(spark: SparkSession, d: str, name: str = "customer", key: str = "c_custkey") -> Collection:
    """A table as a collection of a new database."""
    own = Database(spark, fresh(spark, "database")).create(name, key, table(spark, d, name).schema)
    own.insert(table(spark, d, name))
    return own


@register("collection_find_by_id", "SELECT c_custkey, c_name FROM customer WHERE c_custkey = 42")
def collection_find_by_id(spark: SparkSession, d: str) -> DataFrame:
    return collection(spark, d).find_by_id(42).select("c_custkey", "c_name")


@register("collection_find", "SELECT c_custkey FROM customer WHERE c_acctbal > 9000 AND c_mktsegment = 'BUILDING'")
def collection_find(spark: SparkSession, d: str) -> DataFrame:
    return collection(spark, d).find(field("c_acctbal").gt(9000) & field("c_mktsegment").eq("BUILDING")).select("c_custkey")


@register("collection_find_one", "SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey = 17")
def collection_find_one(spark: SparkSession, d: str) -> DataFrame:
    return collection(spark, d).find_one(field("c_custkey").eq(17)).select("c_custkey", "c_nationkey")


@register("collection_find_python", "SELECT c_custkey FROM customer WHERE c_custkey % 11 = 3")
def collection_find_python(spark: SparkSession, d: str) -> DataFrame:
    return collection(spark, d).find_rows(lambda r: r["c_custkey"] % 11 == 3, "c_custkey").select("c_custkey")


@register("collection_truncate", "SELECT count(*) AS gone, 0::BIGINT AS n, 0::BIGINT AS collections FROM nation")
def collection_truncate(spark: SparkSession, d: str) -> DataFrame:
    own = collection(spark, d, "nation", "n_nationkey")
    gone, n = own.truncate(), own.count()
    own.db.drop("nation")
    return spark.createDataFrame([(gone, n, len(own.db.collections()))], "gone long, n long, collections long")


@register("collection_unique", "SELECT 'exists,repeated,updated' AS refused, count(*) + 1 AS n FROM nation")
def collection_unique(spark: SparkSession, d: str) -> DataFrame:
    """A unique index refuses a value that exists, one that is twice in what is written, and an update to another row's value."""
    own = collection(spark, d, "nation", "n_nationkey")
    own.create_index("by_name", "n_name", unique=True)
    row = table(spark, d, "nation").limit(1)
    name = row.first()["n_name"]
    again = [("exists", lambda: own.insert(row.withColumn("n_nationkey", F.lit(100)))), ("repeated", lambda: own.insert(table(spark, d, "nation").limit(2).select((F.col("n_nationkey") + 200).alias("n_nationkey"), F.lit("X").alias("n_name"), "n_regionkey"))), ("updated", lambda: own.update(table(spark, d, "nation").where(F.col("n_name") != name).limit(1).withColumn("n_name", F.lit(name))))]
    refused = []
    for kind, write in again:
        try:
            write()
        except DuplicateKey:
            refused.append(kind)
    own.insert(row.withColumns({"n_nationkey": F.lit(100), "n_name": F.lit("ATLANTIS")}))
    return spark.createDataFrame([(",".join(refused), own.count())], "refused string, n long")


@register("collection_plan", "SELECT c_custkey, c_acctbal, c_nationkey FROM customer WHERE c_acctbal BETWEEN 100 AND 900 AND c_nationkey < 12")
def collection_plan(spark: SparkSession, d: str) -> DataFrame:
    """A range on an index, the rest as residue."""
    own = collection(spark, d)
    own.create_index("by_balance", "c_acctbal")
    plan = own.plan({"c_acctbal": {"$gte": 100, "$lte": 900}, "c_nationkey": {"$lt": 12}})
    assert plan.kind == "range" and plan.column == "c_acctbal"
    return own.run(plan).select("c_custkey", "c_acctbal", "c_nationkey").df


@register("collection_plan_probes", "SELECT c_custkey FROM customer WHERE c_nationkey IN (3, 7, 9)")
def collection_plan_probes(spark: SparkSession, d: str) -> DataFrame:
    """An OR of look-ups on one index is one look-up of all their values."""
    own = collection(spark, d)
    own.create_index("by_nation", "c_nationkey")
    plan = own.plan({"$or": [{"c_nationkey": 3}, {"c_nationkey": {"$in": [7, 3]}}, {"c_nationkey": 9}]})
    assert plan.kind == "in" and plan.values == (3, 7, 9)
    return own.run(plan).select("c_custkey").df


@register("collection_plan_terminals", "SELECT (SELECT count(*) FROM customer WHERE c_acctbal >= 9000) AS n, (SELECT c_custkey FROM customer WHERE c_acctbal >= 9000 ORDER BY c_acctbal, c_custkey LIMIT 1) AS first, (SELECT c_custkey FROM customer WHERE c_acctbal >= 9000 ORDER BY c_acctbal DESC, c_custkey DESC LIMIT 1) AS last, (SELECT c_custkey FROM customer WHERE c_acctbal >= 9000 ORDER BY c_acctbal, c_custkey OFFSET 2 LIMIT 1) AS third")
def collection_plan_terminals(spark: SparkSession, d: str) -> DataFrame:
    own = collection(spark, d)
    own.create_index("by_balance", "c_acctbal")
    rows = own.run(own.plan({"c_acctbal": {"$gte": 9000}}))
    return spark.createDataFrame([(rows.count(), rows.first()["c_custkey"], rows.last_or_none()["c_custkey"], rows.element_at(2)["c_custkey"])], "n long, first long, last long, third long")


@register("collection_bounds", "SELECT min(c_acctbal) AS least, max(c_acctbal) AS most, min(c_custkey) AS first, max(c_custkey) AS last FROM customer")
def collection_bounds(spark: SparkSession, d: str) -> DataFrame:
    """From the statistics in the files' footers."""
    own = collection(spark, d)
    return spark.createDataFrame([(*own.bounds("c_acctbal"), *own.bounds("c_custkey"))], "least double, most double, first long, last long")


@register("collection_cursor", "SELECT row_number() OVER (ORDER BY n_regionkey, n_nationkey) - 1 AS step, n_nationkey FROM nation WHERE n_regionkey >= 2")
def collection_cursor(spark: SparkSession, d: str) -> DataFrame:
    """Seeks, goes back over the start and on to the end."""
    cursor = collection(spark, d, "nation", "n_nationkey").cursor("n_regionkey")
    cursor.seek(2)
    cursor.previous()
    row, out = cursor.next(), []
    while row is not None:
        out.append((len(out), row["n_nationkey"]))
        row = cursor.next()
    return spark.createDataFrame(out, "step long, n_nationkey int")


@register("collection_hash_index", "SELECT c_custkey FROM customer WHERE c_nationkey = 7")
def collection_hash_index(spark: SparkSession, d: str) -> DataFrame:
    own = collection(spark, d)
    own.create_index("by_nation", "c_nationkey", kind="hash")
    return own.find_hashed(7).select("c_custkey")


@register("collection_spatial_index", f"SELECT c_custkey, round({away(48, 11)}, 6) AS km FROM {_PLACES} WHERE {away(48, 11)} <= 2000")
def collection_spatial_index(spark: SparkSession, d: str) -> DataFrame:
    """Files sorted along cells of the sphere."""
    rows = places(spark, d)
    own = Database(spark, fresh(spark, "database")).create("places", "c_custkey", rows.schema)
    own.insert(rows)
    own.create_index("by_place", "place", kind="spatial")
    found = search.near(own.frame(), "place", (48, 11), 2000, exact=True, name="km")
    return found.select("c_custkey", F.round("km", 6).alias("km"))


@register("collection_vacuum_backup", "SELECT 4 AS versions, 1 AS parts, true AS same, true AS copied, true AS single FROM region LIMIT 1")
def collection_vacuum_backup(spark: SparkSession, d: str) -> DataFrame:
    """Old versions go, the content stays; so does that of a backup and of a copy in single files."""
    own = collection(spark, d, "nation", "n_nationkey")
    own.update(table(spark, d, "nation").limit(3).withColumn("n_regionkey", F.lit(4)))
    versions, before = len(own.db._entries("nation")) + 1, own.digest()
    own.db.vacuum()
    parts, same = len(own.db.entry("nation").parts), own.digest() == before
    manifest = own.db.backup(fresh(spark, "backup"))
    copied = manifest.where("length(sha256) = 64 AND bytes > 0").count() > 0
    single = own.db.migrate(fresh(spark, "single"), files=1)["nation"]
    return spark.createDataFrame([(versions, parts, same, copied, single.digest() == before and len(single.frame().inputFiles()) == 1)], "versions int, parts int, same boolean, copied boolean, single boolean")


@register("series_insert", "SELECT event_id, CASE WHEN event_id % 50 = 0 THEN (SELECT max(ts) FROM events) ELSE ts END AS ts FROM events WHERE event_id % 50 = 0 OR CAST(ts AS DATE) >= (SELECT CAST(max(ts) AS DATE) - 2 FROM events)")
def series_insert(spark: SparkSession, d: str) -> DataFrame:
    """A series takes a part a day, stamps rows without a time, and on insert drops parts whose newest row is too old."""
    rows = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 50 != 0, F.col("ts")).alias("ts"), F.to_date("ts").alias("day"))
    now = table(spark, d, "events").agg(F.max("ts")).first()[0]
    ttl = now - dt.datetime.combine(now.date(), dt.time()) + dt.timedelta(days=2)
    own = Database(spark, fresh(spark, "database"), clock=lambda: now).create("events", "event_id", "event_id long, ts timestamp_ntz", series="ts", ttl=ttl)
    for r in rows.where("ts IS NOT NULL").select("day").distinct().orderBy("day").collect():
        own.insert(rows.where((F.col("day") == r["day"]) & F.col("ts").isNotNull()).select("event_id", "ts"))
    own.insert(rows.where("ts IS NULL").select("event_id", "ts"))
    own.prune()
    return own.frame()


@register("retention_on_insert", "SELECT event_id FROM (SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 200)")
def retention_on_insert(spark: SparkSession, d: str) -> DataFrame:
    """A collection that keeps its 200 newest rows, filled in two inserts."""
    rows = table(spark, d, "events").select("event_id", "ts")
    own = Database(spark, fresh(spark, "database")).create("events", "event_id", rows.schema)
    own.set_retention(retention.Policy("ts", max_count=200))
    for half in (0, 1):
        own.insert(rows.where(F.col("event_id") % 2 == half))
    return own.frame().select("event_id")


@register("retention_scheduled", "SELECT event_id FROM events WHERE ts >= (SELECT max(ts) - INTERVAL 6 HOUR FROM events)")
def retention_scheduled(spark: SparkSession, d: str) -> DataFrame:
    """A policy that only runs when it is due; the run is forced here, as one batch of a schedule would do it."""
    rows = table(spark, d, "events").select("event_id", "ts")
    now = rows.agg(F.max("ts")).first()[0]
    own = Database(spark, fresh(spark, "database"), clock=lambda: now).create("events", "event_id", rows.schema)
    own.set_retention(retention.Policy("ts", max_age=dt.timedelta(hours=6), on_insert=False, scheduled=True))
    own.insert(rows)
    assert own.count() == rows.count()
    own.retain()
    return own.frame().select("event_id")


@register("series_force_prune", "SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1 HAVING CAST(ts AS DATE) >= (SELECT CAST(max(ts) AS DATE) - 3 FROM events)")
def series_force_prune(spark: SparkSession, d: str) -> DataFrame:
    """Folders by day; old ones go without being read."""
    path, rows = fresh(spark, "series"), table(spark, d, "events")
    retention.write_series(rows, path, "ts")
    retention.prune_files(spark, path, rows.agg(F.max("ts")).first()[0].date() - dt.timedelta(days=3))
    return spark.read.parquet(path).groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))


@register("json_file", "SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderdate FROM orders")
def json_file(spark: SparkSession, d: str) -> DataFrame:
    """Written as JSON lines and read back by schema."""
    rows, path = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate"), fresh(spark, "json")
    files.write_json(rows, path)
    return files.read_json(spark, path, rows.schema)


@register("json_file_variant", "SELECT event_id, event_type FROM events WHERE value > 50")
def json_file_variant(spark: SparkSession, d: str) -> DataFrame:
    """Read back without a schema, and queried as documents."""
    path = fresh(spark, "json")
    files.write_json(table(spark, d, "events").select("event_id", "event_type", "value"), path)
    docs = files.read_json(spark, path).withColumn("event_id", F.try_variant_get("doc", "$.event_id", "bigint"))
    return DocQuery(docs, "event_id", "doc").filter({"value": {"$gt": 50}}).matching().select("event_id", F.try_variant_get("doc", "$.event_type", "string").alias("event_type"))


@register("csv_file", "SELECT n_nationkey, n_name, '[' || n_regionkey || ',' || n_nationkey || ']' AS pair FROM nation")
def csv_file(spark: SparkSession, d: str) -> DataFrame:
    """Nested values are JSON in their cell."""
    path = fresh(spark, "csv")
    files.write_csv(table(spark, d, "nation").select("n_nationkey", "n_name", F.array("n_regionkey", "n_nationkey").alias("pair")), path)
    return spark.read.option("header", True).option("escape", '"').schema("n_nationkey int, n_name string, pair string").csv(path)


@register("bson_file", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate FROM orders")
def bson_file(spark: SparkSession, d: str) -> DataFrame:
    """Written as streams of documents and read back."""
    rows, path = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate"), fresh(spark, "bson")
    files.write_bson(rows, path)
    return files.read_bson(spark, path, rows.schema)


@register("subject_files", "SELECT 'csv' AS form, count(*) AS n FROM orders WHERE o_custkey = 42 UNION ALL SELECT 'json', count(*) FROM orders WHERE o_custkey = 42 UNION ALL SELECT 'bson', count(*) FROM orders WHERE o_custkey = 42")
def subject_files(spark: SparkSession, d: str) -> DataFrame:
    """All that concerns a subject, exported in three forms and counted there."""
    tables = {"orders": (table(spark, d, "orders"), "o_custkey"), "customer": (table(spark, d, "customer"), "c_custkey")}
    path = fresh(spark, "export")
    for form in ("json", "csv", "bson"):
        files.export_subject(tables, 42, f"{path}/{form}", form)
    counts = [("json", files.read_json(spark, f"{path}/json/orders").count()), ("csv", spark.read.option("header", True).csv(f"{path}/csv/orders").count()), ("bson", files.read_bson(spark, f"{path}/bson/orders").count())]
    return spark.createDataFrame(counts, "form string, n long")


@register("strict_mode", "SELECT true AS refused, 2 AS warnings")
def strict_mode(spark: SparkSession, d: str) -> DataFrame:
    """Without encryption it fails; with it, what lacks is told: an audit log, and retention of personal data."""
    customer = privacy.annotate(table(spark, d, "customer"), c_name="personal")
    try:
        privacy.strict(spark, {"customer": customer})
        refused = False
    except RuntimeError:
        refused = True
    conf, name = spark.sparkContext._jsc.hadoopConfiguration(), "parquet.crypto.factory.class"
    conf.set(name, "org.apache.parquet.crypto.keytools.PropertiesDrivenCryptoFactory")
    try:
        lacking = privacy.strict(spark, {"customer": customer, "nation": table(spark, d, "nation")})
    finally:
        conf.unset(name)
    return spark.createDataFrame([(refused, len(lacking))], "refused boolean, warnings int")


@register("audit_log", "SELECT * FROM (VALUES ('commit', 4::BIGINT), ('delete', 1), ('insert', 1), ('update', 1)) t(type, n)")
def audit_log(spark: SparkSession, d: str) -> DataFrame:
    """What the database records of its own operations."""
    log = metrics.AuditLog(spark, fresh(spark, "audit"))
    rows = table(spark, d, "nation")
    own = Database(spark, fresh(spark, "database"), audit=log).create("nation", "n_nationkey", rows.schema)
    own.insert(rows)
    own.update(rows.limit(2))
    own.delete([3])
    return metrics.snapshot(log.events(), None).select("type", "n")


@register("kv_batch", "SELECT * FROM (VALUES ('a', '2'), ('c', '4'), ('d', '5')) t(key, value)")
def kv_batch(spark: SparkSession, d: str) -> DataFrame:
    """Sets, deletes and refreshes in one append; the order given is the order of effect."""
    now, hour = dt.datetime(2024, 1, 1), dt.timedelta(hours=1)
    store = keyvalue.Store(spark, fresh(spark, "kv"))
    store.batch([("set", "a", b"1", hour), ("set", "a", b"2", 9 * hour), ("set", "b", b"3", None), ("delete", "b"), ("set", "c", b"4", hour), ("refresh", "c", 9 * hour), ("set", "e", b"6", hour)], now)
    store.batch([("set", "d", b"5", None), ("refresh", "nothing", hour)], now)
    return store.live(now + 2 * hour).select("key", F.col("value").cast("string").alias("value"))


@register("kv_refresh", "SELECT 'user:' || c_custkey AS key FROM customer WHERE c_custkey IN (3, 5)")
def kv_refresh(spark: SparkSession, d: str) -> DataFrame:
    """All keys expire after an hour but those that were refreshed."""
    now, hour = dt.datetime(2024, 1, 1), dt.timedelta(hours=1)
    store = keyvalue.Store(spark, fresh(spark, "kv"))
    rows = table(spark, d, "customer").select(F.concat(F.lit("user:"), F.col("c_custkey").cast("string")).alias("key"), F.col("c_name").alias("value"), F.lit(now + hour).alias("expires"))
    store.load(rows, now)
    store.batch([("refresh", "user:3", 5 * hour), ("refresh", "user:5", 5 * hour), ("refresh", "user:none", hour)], now)
    return store.keys("user:", now + 2 * hour)


@register("kv_cache", "SELECT true AS slid, false AS past_end, 'made' AS got, 1 AS times")
def kv_cache(spark: SparkSession, d: str) -> DataFrame:
    """Reading slides the expiry up to an absolute end; a value that lacks is made once."""
    now, hour, made = dt.datetime(2024, 1, 1), dt.timedelta(hours=1), []
    store = keyvalue.Store(spark, fresh(spark, "kv"))
    store.set("s", b"v", now, hour)
    store.get_sliding("s", 3 * hour, now, now + 2 * hour)
    slid, past = store.exists("s", now + 1.5 * hour), store.exists("s", now + 2.5 * hour)
    got = [store.get_or_set("m", lambda: made.append(1) or b"made", now) for _ in range(2)]
    return spark.createDataFrame([(slid, past, got[1].decode(), len(made))], "slid boolean, past_end boolean, got string, times int")


def _index(spark: SparkSession, d: str) -> search.VectorIndex:
    return search.VectorIndex.build(table(spark, d, "embeddings"), fresh(spark, "vectors"), "embedding", "vec_id")


@register("vector_index_exact", "SELECT query, vec_id, round(distance, 6) AS distance FROM (SELECT a.vec_id AS query, b.vec_id, 1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS distance, row_number() OVER (PARTITION BY a.vec_id ORDER BY 1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), b.vec_id) AS nth FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0) WHERE nth <= 10")
def vector_index_exact(spark: SparkSession, d: str) -> DataFrame:
    """Every hundredth vector against all, with as many probes as cells."""
    asked = table(spark, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))
    return _index(spark, d).search_all(asked, 10, probes=16).select("query", "vec_id", F.round("distance", 6).alias("distance"))


@register("vector_index_recall", "SELECT true AS enough, count(*) AS queries FROM embeddings WHERE vec_id % 100 = 0")
def vector_index_recall(spark: SparkSession, d: str) -> DataFrame:
    """Whether twelve of sixteen cells give 0.9 or more of the ten nearest of every hundredth vector; a row without a vector counts as asked."""
    asked = table(spark, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))
    index = _index(spark, d)
    exact = index.search_all(asked, 10, probes=16).select("query", F.col("vec_id").alias("near"))
    found = index.search_all(asked, 10).select(F.col("query").alias("of"), F.col("vec_id").alias("got"))
    both = exact.join(found, (F.col("query") == F.col("of")) & (F.col("near") == F.col("got")), "left")
    return both.agg((F.count("got") >= 0.9 * F.count("near")).alias("enough")).crossJoin(asked.agg(F.count("*").alias("queries")))


@register("sealed_rows", "SELECT c_custkey, c_name, c_acctbal, c_nationkey FROM customer WHERE c_nationkey < 5")
def sealed_rows(spark: SparkSession, d: str) -> DataFrame:
    """Written encrypted but for the column that is searched by, read and opened."""
    key = encryption.expand(encryption.key_of("a password", b"salt of this query", 1000), b"customer")
    rows, path = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal", "c_nationkey"), fresh(spark, "sealed")
    encryption.seal(rows, key, "customer", ["c_nationkey"]).write.parquet(path)
    return encryption.unseal(spark.read.parquet(path).where("c_nationkey < 5"), key, "customer", "c_custkey long, c_name string, c_acctbal double")


@register("temporary_database", "SELECT count(*) AS n, false AS there FROM nation")
def temporary_database(spark: SparkSession, d: str) -> DataFrame:
    """A database for the time of a block."""
    with Database.temporary(spark) as db:
        own = db.create("nation", "n_nationkey", table(spark, d, "nation").schema)
        own.insert(table(spark, d, "nation"))
        n = own.count()
    return spark.createDataFrame([(n, bool(db.collections()))], "n long, there boolean")
