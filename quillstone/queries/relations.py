"""Queries of the fluent surface, with their SQL."""

from __future__ import annotations

import datetime as dt
import enum
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions.predicates import Fields, converts, field, negate
from quillstone.operators.relation import Relation
from quillstone.queries.common import KEYS, Query, cents, money, table

QUERIES: dict[str, tuple[Query, str | None]] = {}


def register(name: str, sql: str | None):
    def keep(fn: Query) -> Query:
        QUERIES[name] = (fn, sql)
        return fn

    return keep


def rel(spark: SparkSession, d: str, name: str) -> Relation:
    df = table(spark, d, name)
    return Relation(df, (KEYS[name],) if name in KEYS else ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))


@register("where_predicates", "SELECT c_custkey, c_name FROM customer WHERE c_acctbal BETWEEN 1000 AND 5000 AND c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_name LIKE 'Customer#%1_' AND NOT (c_nationkey = 3 OR c_nationkey > 20)")
def where_predicates(spark: SparkSession, d: str) -> DataFrame:
    c = rel(spark, d, "customer")
    return c.where(field("c_acctbal").between(1000, 5000)).where(field("c_mktsegment").one_of(["BUILDING", "MACHINERY"]) & field("c_name").like("Customer#%1_")).where(negate(field("c_nationkey").eq(3) | field("c_nationkey").gt(20))).select("c_custkey", "c_name").df


@register("where_null_logic", "SELECT o_orderkey FROM orders WHERE (o_orderkey % 3 <> 0 AND o_orderstatus <> 'F') OR (o_orderkey % 3 = 0 AND o_orderkey % 2 = 0)")
def where_null_logic(spark: SparkSession, d: str) -> DataFrame:
    """`ne` is false of null; a null in a list matches null; blank counts null."""
    o = rel(spark, d, "orders").df.withColumn("s", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus")))
    odd = F.col("o_orderkey") % 2 == 0
    return Relation(o).where(field("s").ne("F") | (field("s").one_of([None]) & field("s").null_or_blank() & field("s").null_or_empty() & odd)).select("o_orderkey").df


@register("project_nested_path", "SELECT o_orderkey AS id, o_orderpriority AS priority, o_totalprice * 2 AS twice FROM orders WHERE o_totalprice > 490000")
def project_nested_path(spark: SparkSession, d: str) -> DataFrame:
    df = rel(spark, d, "orders").df.select("o_orderkey", F.struct(F.struct(F.col("o_orderpriority").alias("level"), F.col("o_totalprice").alias("price")).alias("inner")).alias("outer"))
    return Relation(df).where(field("outer.inner.price").gt(490000)).select(F.col("o_orderkey").alias("id"), F.col("outer.inner.level").alias("priority"), (F.col("outer.inner.price") * 2).alias("twice")).df


@register("count_any_all", "SELECT count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS finished, bool_or(o_totalprice > 499000) AS some, bool_and(o_totalprice > 0) AS every, count(DISTINCT o_custkey) AS customers FROM orders")
def count_any_all(spark: SparkSession, d: str) -> DataFrame:
    return rel(spark, d, "orders").aggregate(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("finished"), F.bool_or(F.col("o_totalprice") > 499000).alias("some"), F.bool_and(F.col("o_totalprice") > 0).alias("every"), F.countDistinct("o_custkey").alias("customers"))


@register("aggregate_sum_avg_min_max", "SELECT sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS total, round((sum(l_extendedprice::DECIMAL(18,2)) / count(*))::DOUBLE, 4) AS mean, min(l_extendedprice) AS least, max(l_extendedprice) AS most, CAST(sum(l_linenumber) AS BIGINT) AS lines FROM lineitem")
def aggregate_sum_avg_min_max(spark: SparkSession, d: str) -> DataFrame:
    mean = F.round(F.sum(cents("l_extendedprice")).cast("double") / F.count("*"), 4)
    return rel(spark, d, "lineitem").aggregate(money("l_extendedprice").alias("total"), mean.alias("mean"), F.min("l_extendedprice").alias("least"), F.max("l_extendedprice").alias("most"), F.sum("l_linenumber").alias("lines"))


@register("aggregate_empty_as_zero", "SELECT 0::DOUBLE AS total, 0::DOUBLE AS most, 0::BIGINT AS n")
def aggregate_empty_as_zero(spark: SparkSession, d: str) -> DataFrame:
    return rel(spark, d, "orders").where(F.col("o_totalprice") < 0).aggregate(F.sum("o_totalprice").alias("total"), F.max("o_totalprice").alias("most"), F.count("*").alias("n"), empty_as_zero=True)


@register("group_count_sum", "SELECT o_orderstatus, count(*) AS n, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS total, min(o_orderdate) AS first_day FROM orders GROUP BY 1")
def group_count_sum(spark: SparkSession, d: str) -> DataFrame:
    return rel(spark, d, "orders").group_by("o_orderstatus").select(F.count("*").alias("n"), money("o_totalprice").alias("total"), F.min("o_orderdate").alias("first_day")).df


@register("group_having", "SELECT o_custkey, count(*) AS n, max(o_totalprice) AS most FROM orders GROUP BY 1 HAVING count(*) > 12 AND max(o_totalprice) > 400000")
def group_having(spark: SparkSession, d: str) -> DataFrame:
    return rel(spark, d, "orders").group_by("o_custkey").having((F.col("n") > 12) & (F.col("most") > 400000), F.count("*").alias("n"), F.max("o_totalprice").alias("most")).df


@register("group_collect", "SELECT c_nationkey, string_agg(CAST(c_custkey AS VARCHAR), ',' ORDER BY c_custkey) AS customers FROM customer GROUP BY 1")
def group_collect(spark: SparkSession, d: str) -> DataFrame:
    grouped = rel(spark, d, "customer").group_by("c_nationkey").collect("rows", ["c_custkey"], "c_custkey").df
    return grouped.select("c_nationkey", F.concat_ws(",", F.transform("rows", lambda x: x["c_custkey"].cast("string"))).alias("customers"))


@register("group_fold", "SELECT l_orderkey, list_reduce(list_concat([0::BIGINT], list(CAST(l_quantity AS BIGINT) ORDER BY l_linenumber, l_quantity)), lambda t, x: (t * 31 + x) % 1000003) AS code FROM lineitem GROUP BY 1")
def group_fold(spark: SparkSession, d: str) -> DataFrame:
    return rel(spark, d, "lineitem").group_by("l_orderkey").fold(F.col("l_quantity").cast("long"), ["l_linenumber", "l_quantity"], F.lit(0).cast("long"), lambda t, x: (t * 31 + x) % 1000003, "code")


@register("join_inner", "SELECT n_name, count(*) AS n, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def join_inner(spark: SparkSession, d: str) -> DataFrame:
    o, c, n = (rel(spark, d, t) for t in ("orders", "customer", "nation"))
    joined = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.group_by("n_name").select(F.count("*").alias("n"), money("o_totalprice").alias("total")).df


@register("join_group", "SELECT c_custkey, count(o_orderkey) AS n, coalesce(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey), '') AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def join_group(spark: SparkSession, d: str) -> DataFrame:
    o = Relation(rel(spark, d, "orders").df.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey"))
    grouped = rel(spark, d, "customer").select("c_custkey").group_join(o, ["c_custkey"], "own", ["o_orderkey"]).df
    return grouped.select("c_custkey", F.size("own").cast("long").alias("n"), F.concat_ws(",", F.transform("own", lambda x: x["o_orderkey"].cast("string"))).alias("orders"))


@register("join_left", "SELECT n_nationkey, count(s_suppkey) AS suppliers FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey AND s_acctbal > 9000 GROUP BY 1")
def join_left(spark: SparkSession, d: str) -> DataFrame:
    s = rel(spark, d, "supplier").where(field("s_acctbal").gt(9000))
    return rel(spark, d, "nation").left_join(s, F.col("n_nationkey") == F.col("s_nationkey")).group_by("n_nationkey").select(F.count("s_suppkey").alias("suppliers")).df


@register("join_semi", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)")
def join_semi(spark: SparkSession, d: str) -> DataFrame:
    o = rel(spark, d, "orders").where(field("o_totalprice").gt(450000))
    return rel(spark, d, "customer").semi(o, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey").df


@register("join_anti", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def join_anti(spark: SparkSession, d: str) -> DataFrame:
    o = rel(spark, d, "orders").where(field("o_orderstatus").eq("F"))
    return rel(spark, d, "customer").anti(o, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey").df


@register("join_self", "SELECT a.n_nationkey AS id, b.n_name AS leader FROM nation a JOIN nation b ON a.n_nationkey // 5 = b.n_nationkey")
def join_self(spark: SparkSession, d: str) -> DataFrame:
    n = rel(spark, d, "nation").df
    leaders = Relation(n.select(F.col("n_nationkey").alias("leader_id"), F.col("n_name").alias("leader")))
    return Relation(n).join(leaders, F.expr("n_nationkey div 5 = leader_id")).select(F.col("n_nationkey").alias("id"), "leader").df


@register("select_many", "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part WHERE p_size = 7")
def select_many(spark: SparkSession, d: str) -> DataFrame:
    return rel(spark, d, "part").where(field("p_size").eq(7)).select_many(F.split("p_name", " "), "word").select("p_partkey", "word").df


@register("top_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def top_n(spark: SparkSession, d: str) -> DataFrame:
    return rel(spark, d, "orders").order_by_descending("o_totalprice").take(10).select("o_orderkey", "o_totalprice").df


@register("paged", "SELECT o_orderkey, o_orderpriority, o_orderdate FROM orders ORDER BY o_orderpriority, o_orderdate DESC, o_orderkey OFFSET 100 LIMIT 25")
def paged(spark: SparkSession, d: str) -> DataFrame:
    return rel(spark, d, "orders").order_by("o_orderpriority").then_by_descending("o_orderdate").skip(100).take(25).select("o_orderkey", "o_orderpriority", "o_orderdate").df


@register("first_last_element", "(SELECT 'first' AS place, o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 1) UNION ALL (SELECT 'last', o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 1) UNION ALL (SELECT 'tenth', o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey OFFSET 9 LIMIT 1)")
def first_last_element(spark: SparkSession, d: str) -> DataFrame:
    o = Relation(rel(spark, d, "orders").df.select("o_orderkey", "o_totalprice"), ("o_orderkey",)).order_by("o_totalprice")
    parts = [o.take(1), o.take_last(1), o.skip(9).take(1)]
    out = [p.df.select(F.lit(n).alias("place"), "o_orderkey") for n, p in zip(("first", "last", "tenth"), parts)]
    return out[0].unionByName(out[1]).unionByName(out[2])


@register("positions", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS position FROM orders")
def positions(spark: SparkSession, d: str) -> DataFrame:
    return rel(spark, d, "orders").order_by("o_orderdate").numbered().select("o_orderkey", "position")


@register("take_while", "SELECT o_orderkey FROM (SELECT o_orderkey, min(CASE WHEN o_totalprice >= 495000 THEN o_orderkey END) OVER () AS stop FROM orders) WHERE o_orderkey < stop")
def take_while(spark: SparkSession, d: str) -> DataFrame:
    return rel(spark, d, "orders").order_by("o_orderkey").take_while(field("o_totalprice").lt(495000)).select("o_orderkey").df


@register("skip_while", "SELECT o_orderkey FROM (SELECT o_orderkey, o_orderdate, min(CASE WHEN o_totalprice >= 495000 THEN o_orderdate END) OVER () AS stop, min(CASE WHEN o_totalprice >= 495000 THEN (o_orderdate, o_orderkey) END) OVER () AS start FROM orders) WHERE (o_orderdate, o_orderkey) >= start")
def skip_while(spark: SparkSession, d: str) -> DataFrame:
    return rel(spark, d, "orders").order_by("o_orderdate").skip_while(field("o_totalprice").lt(495000)).select("o_orderkey").df


@register("reversed_order", "SELECT o_orderkey FROM orders ORDER BY o_orderpriority DESC, o_orderdate, o_orderkey DESC OFFSET 5 LIMIT 20")
def reversed_order(spark: SparkSession, d: str) -> DataFrame:
    return rel(spark, d, "orders").order_by("o_orderpriority").then_by_descending("o_orderdate").reverse().skip(5).take(20).select("o_orderkey").df


@register("take_last", "SELECT o_orderkey FROM (SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 15)")
def take_last(spark: SparkSession, d: str) -> DataFrame:
    return rel(spark, d, "orders").order_by("o_totalprice").take_last(15).select("o_orderkey").df


@register("skip_last", "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey DESC) AS nth FROM orders) WHERE nth > 15")
def skip_last(spark: SparkSession, d: str) -> DataFrame:
    return rel(spark, d, "orders").order_by("o_totalprice").skip_last(15).select("o_orderkey").df


@register("chunks", "SELECT n // 10 AS chunk, count(*) AS n, min(name) AS least FROM (SELECT n_name AS name, row_number() OVER (ORDER BY n_name) - 1 AS n FROM nation) GROUP BY 1")
def chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = rel(spark, d, "nation").order_by("n_name").chunk(10)
    return rows.select("chunk", F.size("rows").cast("long").alias("n"), F.array_min(F.transform("rows", lambda x: x["n_name"])).alias("least"))


@register("zip_rows", "SELECT a.n_name AS first, b.r_name AS second FROM (SELECT n_name, row_number() OVER (ORDER BY n_name DESC) AS n FROM nation) a JOIN (SELECT r_name, row_number() OVER (ORDER BY r_name) AS n FROM region) b USING (n)")
def zip_rows(spark: SparkSession, d: str) -> DataFrame:
    zipped = rel(spark, d, "nation").order_by_descending("n_name").zip(rel(spark, d, "region").order_by("r_name"))
    return zipped.select(F.col("first.n_name").alias("first"), F.col("second.r_name").alias("second"))


@register("sequence_equal", "SELECT true AS same, false AS other")
def sequence_equal(spark: SparkSession, d: str) -> DataFrame:
    n = Relation(rel(spark, d, "nation").df.select("n_name", "n_nationkey"))
    return spark.createDataFrame([(n.order_by("n_name").sequence_equal(n.order_by_descending("n_name").reverse()), n.order_by("n_name").sequence_equal(n.order_by("n_nationkey")))], "same boolean, other boolean")


@register("append_prepend", "(SELECT 'begin' AS r_name, 0 AS place) UNION ALL (SELECT r_name, row_number() OVER (ORDER BY r_name) FROM region) UNION ALL (SELECT 'end', count(*) + 1 FROM region)")
def append_prepend(spark: SparkSession, d: str) -> DataFrame:
    r = Relation(rel(spark, d, "region").df.select("r_name")).order_by("r_name").append(("end",)).prepend(("begin",))
    return r.numbered("place").select("r_name", "place")


@register("of_type_cast", "SELECT event_id, TRY_CAST(word AS INTEGER) AS word, CAST(value AS DECIMAL(18,2))::DOUBLE AS value FROM (SELECT event_id, value, CASE WHEN event_id % 3 = 0 THEN CAST(event_id AS VARCHAR) ELSE event_type END AS word FROM events) WHERE TRY_CAST(word AS INTEGER) IS NOT NULL")
def of_type_cast(spark: SparkSession, d: str) -> DataFrame:
    e = rel(spark, d, "events").df.select("event_id", F.when(F.col("event_id") % 3 == 0, F.col("event_id").cast("string")).otherwise(F.col("event_type")).alias("word"), "value")
    return Relation(e).of_type("word", "int").cast("value", "decimal(18,2)").df.withColumn("value", F.col("value").cast("double"))


@register("fetch_cap", "SELECT 7 AS n, 7 AS known")
def fetch_cap(spark: SparkSession, d: str) -> DataFrame:
    """Without an order any rows count, and no more than asked are read."""
    o = rel(spark, d, "orders")
    some = Relation(o.df.select("o_orderkey")).take(7).df
    return some.join(o.df.select(F.col("o_orderkey").alias("known")), F.col("o_orderkey") == F.col("known"), "left").agg(F.count("o_orderkey").cast("int").alias("n"), F.count("known").cast("int").alias("known"))


@register("terminals", "SELECT (SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) AS first, (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 1) AS last, (SELECT o_custkey FROM orders WHERE o_orderkey = 7) AS single, (SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey OFFSET 41 LIMIT 1) AS nth, CAST(NULL AS BIGINT) AS nothing, 'empty,several' AS errors, (SELECT CAST(sum(n_nationkey) AS BIGINT) FROM nation) AS keys")
def terminals(spark: SparkSession, d: str) -> DataFrame:
    o, n = rel(spark, d, "orders"), rel(spark, d, "nation")
    errors = []
    for name, ask in (("empty", lambda: o.first(field("o_totalprice").lt(0))), ("several", lambda: o.single(field("o_orderstatus").eq("F")))):
        try:
            ask()
        except LookupError:
            errors.append(name)
    seen: list[int] = []
    n.for_each(lambda r: seen.append(r["n_nationkey"]))
    dear = o.order_by_descending("o_totalprice")
    row = (dear.first()["o_orderkey"], o.order_by("o_totalprice").last_or_none(field("o_orderstatus").eq("F"))["o_orderkey"], o.single(field("o_orderkey").eq(7))["o_custkey"], dear.element_at(41)["o_orderkey"], o.single_or_none(field("o_orderkey").eq(-1)), ",".join(errors), sum(seen))
    return spark.createDataFrame([row], "first long, last long, single long, nth long, nothing long, errors string, keys long")


@register("where_strings", "SELECT p_partkey FROM part WHERE starts_with(p_name, 're') AND ends_with(p_name, 't') AND contains(p_name, 'd') AND p_brand NOT IN ('Brand#11')")
def where_strings(spark: SparkSession, d: str) -> DataFrame:
    by = Fields(rel(spark, d, "part").df)
    return rel(spark, d, "part").where(by.P_Name.startswith("re") & by.p_name.endswith("t") & by.p_name.contains("d") & negate(by.p_brand.one_of(["Brand#11"]))).select("p_partkey").df


@register("where_flag", "SELECT c_custkey FROM customer WHERE c_acctbal > 5000 AND NOT (c_custkey % 5 <> 0 AND c_custkey % 3 = 0)")
def where_flag(spark: SparkSession, d: str) -> DataFrame:
    """Boolean columns as predicates of their own; a null isn't true."""
    c = rel(spark, d, "customer").df.select("c_custkey", (F.col("c_acctbal") > 5000).alias("rich"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_custkey") % 3 == 0).alias("third"))
    return Relation(c).where(field("rich").is_true() & negate(field("third").is_true())).select("c_custkey").df


@register("where_compare_to", "SELECT o_orderkey FROM orders WHERE o_orderpriority > '3-MEDIUM' AND o_totalprice <= 100000")
def where_compare_to(spark: SparkSession, d: str) -> DataFrame:
    return rel(spark, d, "orders").where((field("o_orderpriority").compare_to("3-MEDIUM") > 0) & (field("o_totalprice").compare_to(100000) <= 0)).select("o_orderkey").df


class Status(enum.Enum):
    FINISHED, OPEN, PARTIAL = 1, 2, 3


@register("where_enum", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_orderstatus <> 'O'")
def where_enum(spark: SparkSession, d: str) -> DataFrame:
    """Enums are kept as numbers."""
    number = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(3)
    return Relation(rel(spark, d, "orders").df.select("o_orderkey", number.alias("status"))).where(field("status").one_of([Status.FINISHED, Status.PARTIAL]) & field("status").ne(Status.OPEN)).select("o_orderkey").df


@dataclass(frozen=True)
class Money:
    """A value of its own class, kept as cents."""

    cents: int


@register("where_converted", "SELECT o_orderkey FROM orders WHERE CAST(round(o_totalprice * 100) AS BIGINT) BETWEEN 10000000 AND 10500000")
def where_converted(spark: SparkSession, d: str) -> DataFrame:
    converts(Money, lambda m: m.cents)
    priced = rel(spark, d, "orders").df.select("o_orderkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("price"))
    return Relation(priced).where(field("price").between(Money(10_000_000), Money(10_500_000))).select("o_orderkey").df


@register("where_ticks", "SELECT event_id FROM events WHERE hour(ts) * 60 + minute(ts) < 390 AND CAST(ts AS DATE) >= DATE '2024-01-02'")
def where_ticks(spark: SparkSession, d: str) -> DataFrame:
    """Times of day as ticks of 100 ns, and dates."""
    e = rel(spark, d, "events").df
    day = F.date_trunc("day", "ts")
    ticks = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(day.cast("timestamp"))) * 10
    return Relation(e.select("event_id", ticks.alias("time"), F.to_date("ts").alias("day"))).where(field("time").lt(dt.time(6, 30)) & field("day").ge(dt.date(2024, 1, 2))).select("event_id").df


@register("where_python", "SELECT c_custkey FROM customer WHERE c_custkey % 7 = 0 AND c_mktsegment LIKE '%U%'")
def where_python(spark: SparkSession, d: str) -> DataFrame:
    """A predicate that only Python knows sees the columns that it names."""
    return rel(spark, d, "customer").where_rows(lambda r: r["c_custkey"] % 7 == 0 and "U" in r["c_mktsegment"], "c_custkey", "c_mktsegment").select("c_custkey").df


@register("min_max_by", "SELECT arg_min(p_name, (p_retailprice, p_partkey)) AS cheapest, arg_max(p_partkey, (p_retailprice, p_partkey)) AS dearest FROM part")
def min_max_by(spark: SparkSession, d: str) -> DataFrame:
    p = rel(spark, d, "part")
    return p.min_by("p_retailprice").select(F.col("p_name").alias("cheapest")).join(p.max_by("p_retailprice").select(F.col("p_partkey").alias("dearest")))


@register("set_union", "SELECT c_nationkey AS nation FROM customer WHERE c_acctbal > 9000 UNION SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def set_union(spark: SparkSession, d: str) -> DataFrame:
    return _rich(spark, d, "customer", 9000).union(_rich(spark, d, "supplier", 5000)).df


@register("set_concat", "SELECT nation, count(*) AS n FROM (SELECT c_nationkey AS nation FROM customer WHERE c_acctbal > 9000 UNION ALL SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000) GROUP BY 1")
def set_concat(spark: SparkSession, d: str) -> DataFrame:
    return _rich(spark, d, "customer", 9000).concat(_rich(spark, d, "supplier", 5000)).group_by("nation").select(F.count("*").alias("n")).df


@register("set_intersect", "SELECT c_nationkey AS nation FROM customer WHERE c_acctbal > 9800 INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 8000")
def set_intersect(spark: SparkSession, d: str) -> DataFrame:
    return _rich(spark, d, "customer", 9800).intersect(_rich(spark, d, "supplier", 8000)).df


@register("set_except", "SELECT c_nationkey AS nation FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def set_except(spark: SparkSession, d: str) -> DataFrame:
    return _rich(spark, d, "customer", -1e9).except_(_rich(spark, d, "supplier", 5000)).df


def _rich(spark: SparkSession, d: str, name: str, least: float) -> Relation:
    own = rel(spark, d, name)
    p = name[0]
    return own.where(field(f"{p}_acctbal").gt(least)).select(F.col(f"{p}_nationkey").alias("nation"))


@register("distinct_by", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS nth FROM orders) WHERE nth = 1")
def distinct_by(spark: SparkSession, d: str) -> DataFrame:
    return rel(spark, d, "orders").order_by_descending("o_totalprice").distinct_by("o_custkey").df.select("o_custkey", "o_orderkey")


@register("distinct_rows", "SELECT DISTINCT p_brand, p_type FROM part")
def distinct_rows(spark: SparkSession, d: str) -> DataFrame:
    return rel(spark, d, "part").select("p_brand", "p_type").distinct().df


@register("default_if_empty", "SELECT -1::BIGINT AS n_nationkey, 'none' AS n_name, -1::BIGINT AS n_regionkey")
def default_if_empty(spark: SparkSession, d: str) -> DataFrame:
    return rel(spark, d, "nation").where(field("n_name").eq("nowhere")).default_if_empty((-1, "none", -1)).df


@register("key_prefix_like", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE 'blue%' AND p_name LIKE '%_dge_'")
def key_prefix_like(spark: SparkSession, d: str) -> DataFrame:
    return rel(spark, d, "part").where(field("p_name").like("blue%") & field("p_name").like("%_dge_")).select("p_partkey", "p_name").df


@register("range_count", "SELECT count(*) AS n, min(o_orderkey) AS first_key FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-01-01'")
def range_count(spark: SparkSession, d: str) -> DataFrame:
    o = rel(spark, d, "orders").where(field("o_orderdate").ge(F.lit("1997-01-01").cast("timestamp_ntz")) & field("o_orderdate").lt(F.lit("1998-01-01").cast("timestamp_ntz")))
    return o.aggregate(F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"))
