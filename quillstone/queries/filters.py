"""Queries in the filter language, over typed columns and over schema-less documents, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.plans import filters as f
from quillstone.plans.query import DocQuery, Sort
from quillstone.plans.schemaless import documents
from quillstone.queries.common import Query, docs, money, table

QUERIES: dict[str, tuple[Query, str | None]] = {}


def register(name: str, sql: str | None):
    def keep(fn: Query) -> Query:
        QUERIES[name] = (fn, sql)
        return fn

    return keep


@register("filter_compare_sort_page", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def filter_compare_sort_page(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d, "orders").filter('{"o_orderstatus": "F", "o_totalprice": {"$gt": 100000}}').sort('{"o_totalprice": -1, "o_orderkey": 1}').take(10).project("o_custkey", "o_totalprice").frame()


@register("filter_ranges", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 50000 AND o_totalprice < 60000 AND o_custkey <= 500 AND o_orderkey <> 3")
def filter_ranges(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d, "orders").filter({"o_totalprice": {"$gte": 50000, "$lt": 60000}, "o_custkey": {"$lte": 500}, "o_orderkey": {"$ne": 3}}).project("o_totalprice").frame()


def _holes(spark: SparkSession, d: str) -> DocQuery:
    """orders with nulls in status and price."""
    df = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderstatus")).alias("status"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice")).alias("price"))
    return DocQuery(df, "o_orderkey")


_HOLES = "(SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderstatus END AS status, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS price FROM orders)"


@register("filter_ne_nin_missing", f"SELECT * FROM {_HOLES} WHERE coalesce(status <> 'F', true) AND coalesce(status NOT IN ('O'), true)")
def filter_ne_nin_missing(spark: SparkSession, d: str) -> DataFrame:
    return _holes(spark, d).filter({"status": {"$ne": "F", "$nin": ["O"]}}).frame()


@register("filter_boolean", f"SELECT * FROM {_HOLES} WHERE (coalesce(status IN ('F', 'P'), false) OR coalesce(price > 400000, false)) AND NOT (coalesce(price < 1000, false) OR coalesce(status = 'P', false)) AND NOT coalesce(price > 450000, false)")
def filter_boolean(spark: SparkSession, d: str) -> DataFrame:
    return _holes(spark, d).filter('{"$or": [{"status": {"$in": ["F", "P"]}}, {"price": {"$gt": 400000}}], "$nor": [{"price": {"$lt": 1000}}, {"status": "P"}], "price": {"$not": {"$gt": 450000}}}').frame()


@register("filter_and_not", f"SELECT * FROM {_HOLES} WHERE coalesce(price > 100000, false) AND coalesce(status = 'O', false) AND NOT coalesce(price > 200000, false)")
def filter_and_not(spark: SparkSession, d: str) -> DataFrame:
    return _holes(spark, d).filter('{"$and": [{"price": {"$gt": 100000}}, {"status": "O"}], "$not": {"price": {"$gt": 200000}}}').frame()


@register("filter_exists_null", f"SELECT * FROM {_HOLES} WHERE status IS NULL AND price IS NOT NULL")
def filter_exists_null(spark: SparkSession, d: str) -> DataFrame:
    return _holes(spark, d).filter({"status": None, "price": {"$exists": True}}).frame()


@register("filter_type", "SELECT o_orderkey FROM orders")
def filter_type(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d, "orders").filter({"o_totalprice": {"$type": 1}, "o_orderstatus": {"$type": 2}, "o_orderdate": {"$type": 9}}).project().frame()


@register("filter_cross_kind", "SELECT o_orderkey FROM orders")
def filter_cross_kind(spark: SparkSession, d: str) -> DataFrame:
    """Values of different kinds compare by kind: numbers are below strings, strings never equal numbers."""
    return docs(spark, d, "orders").filter({"o_totalprice": {"$lt": "a"}, "o_orderstatus": {"$ne": 1, "$gt": 5}}).project().frame()


@register("filter_strings", "SELECT p_partkey, p_name FROM part WHERE starts_with(p_name, 'red') AND ends_with(p_name, 't') AND contains(p_name, 'dge')")
def filter_strings(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d, "part").filter('{"p_name": {"$startsWith": "red", "$endsWith": "t", "$contains": "dge"}}').project("p_name").frame()


@register("filter_regex", "SELECT p_partkey, p_brand FROM part WHERE regexp_matches(p_brand, '#[12][0-4]?$')")
def filter_regex(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d, "part").filter({"p_brand": {"$regex": "#[12][0-4]?$"}}).project("p_brand").frame()


@register("filter_mod_between", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 6 = 4 AND o_custkey BETWEEN 100 AND 300")
def filter_mod_between(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d, "orders").filter(f.Mod("o_orderkey", 6, 4) & f.between("o_custkey", 100, 300)).project("o_custkey").frame()


def _nested(spark: SparkSession, d: str) -> DocQuery:
    """An order document with the array of its lines."""
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("n"), F.col("l_quantity").alias("quantity"), F.col("l_returnflag").alias("flag")))).alias("lines"))
    return DocQuery(lines.withColumn("quantities", F.transform("lines", lambda x: x["quantity"])).withColumn("flags", F.array_distinct(F.transform("lines", lambda x: x["flag"]))), "id")


@register("filter_elem_match", "SELECT l_orderkey AS id, count(*) AS n FROM lineitem GROUP BY 1 HAVING bool_or(l_quantity >= 45 AND l_quantity < 48) AND bool_or(l_returnflag = 'R' AND l_quantity <= 10)")
def filter_elem_match(spark: SparkSession, d: str) -> DataFrame:
    q = _nested(spark, d).filter('{"quantities": {"$elemMatch": {"$gte": 45, "$lt": 48}}, "lines": {"$elemMatch": {"flag": "R", "quantity": {"$lte": 10}}}}')
    return q.frame().select("id", F.size("lines").cast("long").alias("n"))


@register("filter_size_all", "SELECT l_orderkey AS id FROM lineitem GROUP BY 1 HAVING count(*) = 5 AND bool_or(l_returnflag = 'A') AND bool_or(l_returnflag = 'R')")
def filter_size_all(spark: SparkSession, d: str) -> DataFrame:
    return _nested(spark, d).filter('{"lines": {"$size": 5}, "flags": {"$all": ["A", "R"]}}').project().frame()


_PLACES = "(SELECT c_custkey, (c_custkey * 37 % 1800) / 10.0::DOUBLE - 90 AS lat, (c_custkey * 91 % 3600) / 10.0::DOUBLE - 180 AS lon FROM customer)"
_AWAY = "2 * 6371.0 * atan2(sqrt({a}), sqrt(1 - {a}))"


def away(lat: float, lon: float) -> str:
    a = f"(pow(sin(radians({lat} - lat) / 2), 2) + cos(radians(lat)) * cos(radians({lat})) * pow(sin(radians({lon} - lon) / 2), 2))"
    return _AWAY.format(a=a)


def places(spark: SparkSession, d: str) -> DataFrame:
    """Customers with a made-up place."""
    key = F.col("c_custkey")
    return table(spark, d, "customer").select("c_custkey", F.struct(((key * 37 % 1800) / 10.0 - 90).alias("lat"), ((key * 91 % 3600) / 10.0 - 180).alias("lon")).alias("place"))


@register("filter_geo_within", f"SELECT c_custkey, lat, lon FROM {_PLACES} WHERE lat BETWEEN 35.0 AND 60.0 AND lon BETWEEN -10.0 AND 30.0")
def filter_geo_within(spark: SparkSession, d: str) -> DataFrame:
    return DocQuery(places(spark, d), "c_custkey").filter({"place": {"$geoWithin": {"$box": [[-10, 35], [30, 60]]}}}).frame().select("c_custkey", "place.lat", "place.lon")


@register("filter_geo_near", f"SELECT c_custkey FROM {_PLACES} WHERE {away(48.0, 11.0)} <= 1500")
def filter_geo_near(spark: SparkSession, d: str) -> DataFrame:
    return DocQuery(places(spark, d), "c_custkey").filter({"place": {"$geoNear": {"$center": [11.0, 48.0], "$maxDistance": 1500}}}).project().frame()


@register("filter_exclude", "SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_nationkey = 3")
def filter_exclude(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d, "customer").filter({"c_nationkey": 3}).without("c_acctbal", "c_mktsegment").frame()


@register("filter_everything_skip", "SELECT n_nationkey, n_name FROM nation ORDER BY n_name DESC, n_nationkey OFFSET 5 LIMIT 7")
def filter_everything_skip(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d, "nation").filter("{}").order_by_descending("n_name").skip(5).take(7).project("n_name").frame()


@register("filter_or_combined", "SELECT count(*) AS n, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS total FROM orders WHERE (o_orderstatus = 'F' AND o_totalprice > 300000) OR o_orderpriority = '1-URGENT'")
def filter_or_combined(spark: SparkSession, d: str) -> DataFrame:
    q = docs(spark, d, "orders").filter({"o_orderstatus": "F"}).and_({"o_totalprice": {"$gt": 300000}}).or_({"o_orderpriority": "1-URGENT"})
    return q.frame().agg(F.count("*").alias("n"), money("o_totalprice").alias("total"))


def _variants(spark: SparkSession, d: str) -> DocQuery:
    """Events as schema-less documents: kind is absent, null, a number or a text, by id."""
    e, n = table(spark, d, "events"), F.col("event_id") % 4
    kind = F.when(n == 0, "").when(n == 1, ', "kind": null').when(n == 2, F.concat(F.lit(', "kind": '), (F.col("event_id") % 10).cast("string"))).otherwise(F.concat(F.lit(', "kind": "'), F.col("event_type"), F.lit('"')))
    text = F.concat(F.lit('{"user": '), F.col("user_id").cast("string"), kind, F.lit(', "props": '), F.col("props"), F.lit(', "tags": ["'), F.col("event_type"), F.lit('", 1, null]}'))
    return DocQuery(e.select("event_id", documents(text).alias("doc")), "event_id", "doc")


def _by_kind(q: DocQuery) -> DataFrame:
    return q.matching().groupBy((F.col("event_id") % 4).alias("how")).agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


def _kind_sql(where: str) -> str:
    return f"SELECT event_id % 4 AS how, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events WHERE {where} GROUP BY 1"


@register("variant_less_than", _kind_sql("event_id % 4 = 1 OR (event_id % 4 = 2 AND event_id % 10 < 5)"))
def variant_less_than(spark: SparkSession, d: str) -> DataFrame:
    """Null is below every number; absent fields and texts don't match."""
    return _by_kind(_variants(spark, d).filter({"kind": {"$lt": 5}}))


@register("variant_ne", _kind_sql("NOT (event_id % 4 = 3 AND event_type = 'click')"))
def variant_ne(spark: SparkSession, d: str) -> DataFrame:
    return _by_kind(_variants(spark, d).filter({"kind": {"$ne": "click"}}))


@register("variant_null_eq", _kind_sql("event_id % 4 = 1"))
def variant_null_eq(spark: SparkSession, d: str) -> DataFrame:
    """$eq null matches a null that is there; {kind: null} would match absent fields too."""
    return _by_kind(_variants(spark, d).filter({"kind": {"$eq": None}}))


@register("variant_missing", _kind_sql("event_id % 4 < 2"))
def variant_missing(spark: SparkSession, d: str) -> DataFrame:
    return _by_kind(_variants(spark, d).filter({"kind": None}))


@register("variant_type_in", _kind_sql("(event_id % 4 = 2) OR (event_id % 4 = 3 AND event_type IN ('view', 'error'))"))
def variant_type_in(spark: SparkSession, d: str) -> DataFrame:
    return _by_kind(_variants(spark, d).filter({"$or": [{"kind": {"$type": 16}}, {"kind": {"$in": ["view", "error"]}}]}))


@register("variant_arrays", _kind_sql("event_type = 'click'"))
def variant_arrays(spark: SparkSession, d: str) -> DataFrame:
    return _by_kind(_variants(spark, d).filter('{"tags": {"$size": 3, "$all": ["click", 1], "$elemMatch": {"$regex": "^cl"}}}'))


@register("variant_sort", "SELECT event_id FROM events ORDER BY CASE event_id % 4 WHEN 2 THEN 2 WHEN 3 THEN 3 ELSE 0 END DESC, CASE WHEN event_id % 4 = 2 THEN event_id % 10 END DESC NULLS LAST, CASE WHEN event_id % 4 = 3 THEN event_type END DESC NULLS LAST, event_id LIMIT 20")
def variant_sort(spark: SparkSession, d: str) -> DataFrame:
    return _variants(spark, d).sort({"kind": -1}).take(20).project().frame()


@register("variant_nested_path", "SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k FROM events WHERE CAST(props->>'$.k' AS BIGINT) > 95")
def variant_nested_path(spark: SparkSession, d: str) -> DataFrame:
    """A path is its outer field's document; the filter language takes names, not paths, so the inner document is queried."""
    inner = _variants(spark, d).df.select("event_id", F.try_variant_get("doc", "$.props", "variant").alias("doc"))
    return DocQuery(inner, "event_id", "doc").filter({"k": {"$gt": 95}}).matching().select("event_id", F.try_variant_get("doc", "$.k", "bigint").alias("k"))


@register("sort_then_by", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_totalprice > 300000 ORDER BY o_orderstatus, o_totalprice DESC, o_orderkey LIMIT 40")
def sort_then_by(spark: SparkSession, d: str) -> DataFrame:
    order = Sort.by("o_orderstatus").then_by("o_totalprice", descending=True)
    return docs(spark, d, "orders").filter({"o_totalprice": {"$gt": 300000}}).sort(order).take(40).project("o_orderstatus", "o_totalprice").frame()


@register("filter_terminals", "SELECT (SELECT count(*) FROM customer WHERE c_nationkey = 3) AS n, (SELECT count(*) > 0 FROM customer WHERE c_acctbal > 9000) AS some, (SELECT count(*) = 0 FROM customer WHERE c_acctbal > 99999) AS nothing, (SELECT c_custkey FROM customer WHERE c_nationkey = 3 ORDER BY c_acctbal DESC, c_custkey LIMIT 1) AS first, (SELECT string_agg(CAST(c_custkey AS VARCHAR), ',' ORDER BY c_custkey) FROM customer WHERE c_acctbal > 9990) AS listed")
def filter_terminals(spark: SparkSession, d: str) -> DataFrame:
    q = docs(spark, d, "customer")
    nation = q.filter({"c_nationkey": 3})
    rich = q.filter({"c_acctbal": {"$gt": 9990}})
    listed = ",".join(str(r["c_custkey"]) for r in sorted(rich.to_list(), key=lambda r: r["c_custkey"]))
    row = (nation.count(), q.filter({"c_acctbal": {"$gt": 9000}}).any(), q.filter({"c_acctbal": {"$gt": 99999}}).none(), nation.order_by_descending("c_acctbal").first()["c_custkey"], listed if listed else None)
    return spark.createDataFrame([row], "n long, some boolean, nothing boolean, first long, listed string")
