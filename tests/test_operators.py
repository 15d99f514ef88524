from __future__ import annotations

import datetime as dt
import math
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from quillstone.functions import geo, text, vectors
from quillstone.functions.predicates import field
from quillstone.operators import changes, keyvalue, metrics, privacy, retention, search
from quillstone.operators.relation import Relation
from quillstone.queries import ALL
from quillstone.sources import files
from quillstone.sources.catalog import Database, DuplicateKey
from quillstone.streaming import watch

NOW = dt.datetime(2024, 5, 1)


def ids(df, c="id"):
    return [r[c] for r in df.collect()]


@pytest.fixture(scope="module")
def few(spark):
    return Relation(spark.createDataFrame([(1, "b", 5), (2, "a", None), (3, "b", 7), (4, None, 5)], "id int, g string, v int").cache(), ("id",))


def test_order_and_positions(few):
    assert ids(few.order_by("v").frame()) == [2, 1, 4, 3]
    assert ids(few.order_by_descending("v").then_by_descending("id").frame()) == [3, 4, 1, 2]
    o = few.order_by("v")
    assert {r["id"]: r["position"] for r in o.numbered().collect()} == {2: 0, 1: 1, 4: 2, 3: 3}
    assert ids(o.reverse().frame()) == [3, 4, 1, 2]
    assert sorted(ids(o.take_last(2).df)) == [3, 4]
    assert sorted(ids(o.skip_last(3).df)) == [2]
    assert sorted(ids(o.take_while(F.col("v").isNull() | (F.col("v") < 7)).df)) == [1, 2, 4]
    assert sorted(ids(o.skip_while(F.col("v").isNull()).df)) == [1, 3, 4]
    assert o.element_at(1)["id"] == 1 and o.first()["id"] == 2 and o.last_or_none()["id"] == 3
    assert o.sequence_equal(few.order_by("v")) and not o.sequence_equal(few.order_by_descending("v"))
    assert o.zip(few.order_by_descending("v")).count() == 4
    with pytest.raises(LookupError):
        o.element_at(9)


def test_terminals(few):
    assert few.single(field("id").eq(3))["v"] == 7
    assert few.single_or_none(field("id").eq(9)) is None
    with pytest.raises(LookupError):
        few.single(field("v").eq(5))
    assert few.any(field("g").is_null()) and not few.all(field("v").gt(0)) and few.where(field("id").gt(9)).all(field("v").gt(0))
    assert few.count(field("g").ne("a")) == 2  # a null isn't unequal
    assert few.count(field("g").one_of(["a", None])) == 2
    seen = []
    few.for_each(lambda r: seen.append(r["id"]))
    assert sorted(seen) == [1, 2, 3, 4]


def test_sets_and_groups(few):
    assert few.distinct_by("g").count() == 3
    assert few.append((9, "z", 1)).count() == 5
    assert few.where(field("id").gt(9)).default_if_empty((0, "none", 0)).first()["g"] == "none"
    assert few.of_type("g", "int").count() == 0
    folded = few.group_by("g").fold(F.coalesce("v", F.lit(0)), ["id"], 0, lambda t, x: t * 10 + x).collect()
    assert {r["g"]: r["value"] for r in folded} == {"b": 57, "a": 0, None: 5}
    gathered = few.group_join(Relation(few.df.select(F.col("v").alias("id"), "g")), ["id"], "own", ["g"])
    assert all(r["own"] == [] for r in gathered.df.where("id < 4").collect())


def test_python_predicate_and_fields(few):
    from quillstone.functions.predicates import Fields

    assert sorted(ids(few.where_rows(lambda r: r["v"] is not None and r["v"] > 5, "v").df)) == [3]
    by = Fields(few.df)
    assert few.count(by.G.eq("b") & by.v.between(6, 9)) == 1
    with pytest.raises(AttributeError):
        by.nothing


def test_ids(spark):
    from quillstone.functions import ids as make

    df = spark.createDataFrame([(k, NOW + dt.timedelta(seconds=k)) for k in range(50)], "k int, at timestamp")
    rows = df.select("k", make.object_id(F.col("at")).alias("o"), make.ulid(F.col("at")).alias("u")).orderBy("k").collect()
    assert [r["o"] for r in rows] == sorted({r["o"] for r in rows}) and all(len(r["o"]) == 24 for r in rows)
    assert [r["u"] for r in rows] == sorted({r["u"] for r in rows}) and all(len(r["u"]) == 26 for r in rows)
    assert {r["k"]: r["n"] for r in make.sequence(df, "n", 100, ["k"]).collect()} == {k: 100 + k for k in range(50)}


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 1.0]), (4, None)], "id int, v array<double>")
    assert ids(search.nearest(df, "v", [1, 0], 9, "id")) == [1, 3, 2]
    assert ids(search.nearest(df, "v", [1, 1], 1, "id", "dot")) == [3]
    assert ids(search.nearest(df, "v", [0, 0], 2, "id", "l2")) == [2, 1]
    with pytest.raises(Exception, match="different lengths"):
        search.nearest(df, "v", [1, 0, 0], 1, "id").collect()
    with pytest.raises(ValueError):
        vectors.distance(F.col("v"), [1], "other")


def test_geo(spark):
    df = spark.createDataFrame([(1, [48.1, 11.6]), (2, [52.5, 13.4]), (3, [-33.9, 151.2])], "id int, p array<double>")
    assert ids(search.near(df, "p", (48.1, 11.5), 600)) == [1, 2]
    assert ids(search.near(df, "p", (48.1, 11.5), 500, exact=True)) == [1]
    assert ids(search.within(df, "p", (-40, 100), (0, 160))) == [3]
    low, high = geo.box_around(89.9, 0, 100)
    assert high[1] - low[1] >= 360


def test_text(spark):
    assert text.normal_form("  Crème—Brûlée, 2x!  ") == "creme brulee 2x"
    df = spark.createDataFrame([("Ünï  Cöde",), (None,)], "t string")
    assert [r["n"] for r in df.select(text.normalize(F.col("t")).alias("n")).collect()] == ["uni code", ""]
    one = df.select(text.embedding_text({"t": F.col("t"), "n": F.lit(3)}).alias("e")).collect()
    assert [r["e"] for r in one] == ["t:uni code,n:3", "n:3"]


def brute_normal(t):
    plain = (c for c in unicodedata.normalize("NFD", t or "") if unicodedata.category(c) != "Mn")
    return re.sub(" +", " ", "".join(c.lower() if c.isalpha() else c if c.isdecimal() else " " for c in plain)).strip()


def test_all_documents_are_normalized(spark, data, tmp_path):
    from quillstone.queries import ALL

    query, _ = ALL["text_normalized"]
    own = spark.createDataFrame([(1, "ÀÉî—ß Straße 2½"), (2, None), (3, ""), (4, "日本語、テキスト 😀"), (5, "Привет, мир ٣"), (6, "plain Text"), (None, "e\u0301 \u00a0x")], "doc_id bigint, text string")
    own.write.parquet(f"{tmp_path}/documents.parquet")
    for d in (data, str(tmp_path)):
        want = sorted((str(r["doc_id"]), brute_normal(r["text"])) for r in spark.read.parquet(f"{d}/documents.parquet").collect())
        got = sorted((str(r["doc_id"]), r["normal"]) for r in query(spark, d).collect())
        assert got == want


def test_retention(spark):
    day = dt.timedelta(days=1)
    df = spark.createDataFrame([(k, NOW - k * day if k else None) for k in range(6)], "id int, at timestamp")
    assert sorted(ids(retention.by_age(df, "at", NOW, 2 * day))) == [0, 1, 2]
    assert sorted(ids(retention.by_count(df, 3, "id", "at"))) == [0, 1, 2]
    assert sorted(ids(retention.by_bytes(df, 35, F.lit(10), "id", "at"))) == [0, 1, 2]
    both = retention.Policy("at", 3 * day, 2)
    assert sorted(ids(retention.apply(df, both, NOW, "id"))) == [0, 1]
    parts = df.where("at IS NOT NULL")
    assert sorted(ids(retention.prune_parts(parts, "at", NOW - 2 * day))) == [1, 2]


def test_series_files(spark, tmp_path):
    df = spark.createDataFrame([(k, NOW - dt.timedelta(days=k)) for k in range(4)], "id int, at timestamp")
    retention.write_series(df, str(tmp_path / "s"), "at")
    assert retention.prune_files(spark, str(tmp_path / "s"), (NOW - dt.timedelta(days=1)).date()) == ["day=2024-04-28", "day=2024-04-29"]
    assert sorted(ids(spark.read.parquet(str(tmp_path / "s")))) == [0, 1]


def test_store(spark, tmp_path):
    s = keyvalue.Store(spark, str(tmp_path / "kv"))
    hour = dt.timedelta(hours=1)
    assert s.get("a", NOW) is None
    s.batch([("set", "a", b"1", hour), ("set", "a", b"2", hour), ("set", "b", b"3", None), ("delete", "b"), ("set", "c", b"4", hour), ("refresh", "c", 3 * hour)], NOW)
    assert s.get("a", NOW) == b"2" and s.get("b", NOW) is None and s.get("a", NOW + hour) is None
    assert s.get("c", NOW + 2 * hour) == b"4"
    assert s.refresh("a", 2 * hour, NOW) and s.exists("a", NOW + hour)
    assert s.delete("a", NOW) and not s.delete("a", NOW)
    assert s.get_sliding("c", 9 * hour, NOW, NOW + 5 * hour) == b"4" and s.exists("c", NOW + 4 * hour) and not s.exists("c", NOW + 5 * hour)
    assert s.get_or_set("d", lambda: b"5", NOW) == b"5" and s.get_or_set("d", lambda: b"6", NOW) == b"5"
    assert sorted(ids(s.keys("", NOW), "key")) == ["c", "d"]
    assert s.compact(NOW) > 0 and s.get("c", NOW) == b"4"
    with pytest.raises(ValueError):
        s.set("k" * 256, b"", NOW)


def test_changes(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, v string")
    new = spark.createDataFrame([(1, "a"), (2, "x"), (4, None)], "id int, v string")
    log = changes.log_of(old, new, "id")
    assert {(r["type"], r["id"]) for r in log.collect()} == {("update", 2), ("delete", 3), ("insert", 4)}
    stamped = log.withColumns({"ts": F.lit(1), "txn": F.col("id")})
    assert sorted(map(tuple, changes.apply(old, stamped).collect())) == sorted(map(tuple, new.collect()))
    shown = changes.masked(new, ["v"], changes.Watch(mask=None), ["id"])
    assert shown.columns == ["id"]
    assert changes.masked(new, ["v"], changes.Watch(reveal=True), ["id"]).columns == ["id", "v"]
    assert changes.masked(new, ["v"], changes.Watch(payload=False), ["id"]).columns == ["id"]


def test_change_stream(spark, tmp_path):
    schema = spark.createDataFrame([], "ts bigint, txn bigint, collection string, type string, id int, name string").schema
    watch.publish(spark.createDataFrame([(1, 1, "c", "insert", 7, "x"), (1, 1, "other", "insert", 8, "y")], schema), str(tmp_path / "log"))
    got: dict[str, list] = {"a": [], "b": []}
    for who, w in (("a", changes.Watch()), ("b", changes.Watch(payload=False))):
        stream = watch.changes(spark, str(tmp_path / "log"), schema, w, ["name"], "c")
        watch.subscribe(stream, str(tmp_path / who), lambda df, _, who=who: got[who].extend(df.collect()), once=True).awaitTermination()
    assert [(r["id"], r["name"]) for r in got["a"]] == [(7, "***")]
    assert got["b"][0].asDict().keys() == {"ts", "txn", "collection", "type", "id"}


def test_privacy(spark):
    df = privacy.annotate(spark.createDataFrame([(1, "a", [1, 2])], "id int, name string, l array<int>"), name="personal")
    assert privacy.personal_fields(df) == {"name": "personal"}
    counts = {r["collection"]: r["n"] for r in privacy.subject_counts({"x": (df, "id"), "y": (df, "name")}, "1", spark).collect()}
    assert counts == {"x": 1, "y": 0}
    assert privacy.csv_ready(df).first()["l"] == "[1,2]"
    with pytest.raises(RuntimeError):
        privacy.strict(spark, {"x": df})


def test_metrics(spark, tmp_path):
    log = metrics.AuditLog(spark, str(tmp_path / "audit"), slow_micros=100)
    log.record(NOW, "c", "query", 50)
    log.record(NOW, "c", "query", 150)
    log.record(NOW, "c", "insert", 10, 3)
    got = {r["type"]: (r["n"], r["avg_micros"]) for r in metrics.snapshot(log.events()).collect()}
    assert got == {"query": (2, 100.0), "slow_query": (1, 150.0), "insert": (1, 10.0)}
    assert metrics.slow(log.events(), 100).count() == 1
    with pytest.raises(ValueError):
        log.record(NOW, "c", "what")


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, [("a", 2)], None)], "id int, l array<struct<k: string, v: int>>, s string")
    files.write_csv(df, str(tmp_path / "csv"))
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv")).first()["l"] == '[{"k":"a","v":2}]'
    files.write_json(df, str(tmp_path / "json"))
    assert files.read_json(spark, str(tmp_path / "json"), df.schema).first()["id"] == 1
    assert files.read_json(spark, str(tmp_path / "json")).columns == ["doc"]
    texts = ["1", "5000000000", "1.5", "true", "null", "x", "2024-01-01T10:00:00Z", "123e4567-e89b-12d3-a456-426614174000"]
    kinds = spark.createDataFrame([(t,) for t in texts], "t string").select(files.value_kind(F.col("t")).alias("k"))
    assert [r["k"] for r in kinds.collect()] == ["int32", "int64", "double", "bool", "null", "string", "datetime", "uuid"]
    raw = bytes(files.bson_documents(df).first()["document"])
    assert int.from_bytes(raw[:4], "little") == len(raw) and raw.endswith(b"\0")


def test_database(spark, tmp_path):
    db = Database(spark, str(tmp_path / "db"))
    c = db.create("people", "id", "id int, name string")
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, name string")
    c.insert(rows)
    assert c.count() == 3 and c.find_by_id(2).first()["name"] == "b"
    with pytest.raises(DuplicateKey):
        c.insert(rows.limit(1))
    c.create_index("by_name", "name", unique=True)
    with pytest.raises(DuplicateKey):
        c.insert(spark.createDataFrame([(9, "a")], "id int, name string"))
    assert c.update(spark.createDataFrame([(2, "z"), (8, "n")], "id int, name string")) == 1
    assert [r["id"] for r in c.range("name", "b", None, ascending=False).collect()] == [2, 3]
    c.insert(spark.createDataFrame([(4, "d", 1.5)], "id int, name string, score double"))
    assert c.schema_version() == 2 and c.query({"score": {"$gt": 1}}).count() == 1
    before = c.digest()
    db.vacuum()
    assert c.digest() == before
    manifest = db.backup(str(tmp_path / "copy"))
    assert manifest.count() > 0 and Database(spark, str(tmp_path / "copy"))["people"].digest() == before
    assert c.delete([1, 99]) == 1 and c.truncate() == 3 and c.count() == 0
    assert db.collections() == ["people"] and c.drop_index("by_name") and db.drop("people") and not db.drop("people")


def test_catalog_entries_and_conflicts(spark, tmp_path):
    from quillstone.sources.catalog import Conflict

    db = Database(spark, str(tmp_path / "db"))
    c = db.create("t", "id", "id int, v int")
    one, two = db.entry("t"), db.entry("t")
    c._commit(one, spark.createDataFrame([(1, 1)], "id int, v int"))
    with pytest.raises(Conflict):
        c._commit(two, spark.createDataFrame([(2, 2)], "id int, v int"))
    assert ids(c.frame()) == [1]
    c.insert(spark.createDataFrame([(k, k % 5) for k in range(2, 60)], "id int, v int"))
    assert ids(c.find_one(field("v").eq(99))) == [] and c.find_rows(lambda r: r["id"] == 7, "id").count() == 1
    c.create_index("by_hash", "v", kind="hash")
    c.insert(spark.createDataFrame([(70, 3), (71, None)], "id int, v int"))
    found = c.find_hashed(3)
    assert sorted(ids(found)) == [*range(3, 60, 5), 70]
    plan = spark._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
    assert "PartitionFilters: [isnotnull(_bucket" in plan
    assert c.bounds("v") == (0, 4) and c.bounds("id") == (1, 71)
    assert sorted(c.frame().columns) == ["id", "v"] and c.delete([70]) == 1 and c.update(spark.createDataFrame([(71, 3)], "id int, v int")) == 1
    assert sorted(ids(c.find_hashed(3))) == [*range(3, 60, 5), 71]
    other = db.migrate(str(tmp_path / "single"), files=1)
    assert other["t"].digest() == c.digest() and len(other["t"].frame().inputFiles()) >= 1
    db.vacuum()
    assert db._entries("t")[-1:] == db._entries("t") and c.count() == 60
    assert c.drop_index("by_hash") and c.count() == 60
    with pytest.raises(LookupError):
        c.find_hashed(3)


def test_plans_and_cursor(spark, tmp_path):
    from quillstone.plans import filters as f
    from quillstone.plans.access import plan_of

    assert plan_of(f.parse({"$or": [{"a": 1}, {"a": {"$in": [2, 1]}}]}), {"a"}).values == (1, 2)
    assert plan_of(f.parse({"$or": [{"a": 1}, {"b": 2}]}), {"a", "b"}).kind == "scan"
    p = plan_of(f.parse({"a": {"$gt": 3, "$lte": 9}, "b": {"$gt": 1}}), {"a", "b"})
    assert (p.kind, p.column, p.low, p.high) == ("range", "a", 3, 9)
    db = Database(spark, str(tmp_path / "db"))
    c = db.create("t", "id", "id int, v int")
    c.insert(spark.createDataFrame([(k, (k * 7) % 20 if k % 9 else None) for k in range(50)], "id int, v int"))
    c.create_index("by_v", "v")
    rows = {r["id"]: r["v"] for r in c.frame().collect()}
    plan = c.plan({"v": {"$gte": 3, "$lt": 6}})
    assert plan.kind == "range" and [r["id"] for r in c.run(plan).to_list()] == sorted((k for k, v in rows.items() if v is not None and 3 <= v < 6), key=lambda k: (rows[k], k))
    assert c.run(c.plan({"$or": [{"v": 3}, {"v": 5}, {"v": 3}]})).count() == sum(v in (3, 5) for v in rows.values())
    cursor = c.cursor("v")
    cursor.size = 4
    order = sorted((v, k) for k, v in rows.items() if v is not None)
    got = [cursor.first()]
    while (row := cursor.next()) is not None:
        got.append(row)
    assert [(r["v"], r["id"]) for r in got] == order
    assert cursor.last()["id"] == order[-1][1] and cursor.previous()["id"] == order[-2][1] and cursor.next()["id"] == order[-1][1]
    at = next(i for i, (v, _) in enumerate(order) if v >= 7)
    assert cursor.seek(7)["id"] == order[at][1] and cursor.previous()["id"] == order[at - 1][1]


def test_series_and_policies_on_insert(spark, tmp_path):
    now = [NOW]
    log = metrics.AuditLog(spark, str(tmp_path / "audit"))
    db = Database(spark, str(tmp_path / "db"), clock=lambda: now[0], audit=log)
    day = dt.timedelta(days=1)
    s = db.create("s", "id", "id int, at timestamp", series="at", ttl=2 * day)
    schema = "id int, at timestamp"
    s.insert(spark.createDataFrame([(1, NOW - 5 * day), (2, NOW - 4 * day)], schema))
    s.insert(spark.createDataFrame([(3, None)], schema))
    assert s.frame().where("id = 3").first()["at"] == NOW and s.count() == 3
    now[0] = NOW + dt.timedelta(minutes=6)  # the next insert prunes
    s.insert(spark.createDataFrame([(4, NOW - 9 * day)], schema))
    assert sorted(ids(s.frame())) == [3, 4]  # the old part went whole; what follows a fresh part stays
    assert s.prune(NOW + 30 * day) and s.count() == 0
    c = db.create("c", "id", schema)
    c.set_retention(retention.Policy("at", max_count=2))
    c.insert(spark.createDataFrame([(k, NOW + k * day) for k in range(4)], schema))
    assert sorted(ids(c.frame())) == [2, 3] and c.policy().max_count == 2
    c.set_retention(retention.Policy("at", max_age=day, on_insert=False))
    c.insert(spark.createDataFrame([(9, NOW - 9 * day), (10, None)], schema))
    assert c.count() == 4 and c.retain(NOW + 4 * day) == 2 and sorted(ids(c.frame())) == [3, 10]
    kinds = {r["type"] for r in log.events().collect()}
    assert kinds == {"insert", "commit", "delete"}


def test_vector_index(spark, tmp_path):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    for metric in vectors.METRICS:
        index = search.VectorIndex.build(df, str(tmp_path / metric), "embedding", "vec_id", metric, cells=12)
        assert index.rows().count() == df.count()
        asked = df.where("vec_id % 100 = 0")
        got = index.search_all(asked.select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector")), 10, probes=8).collect()
        hit = total = 0
        for q in asked.collect():
            exact = {r["vec_id"] for r in search.nearest(df, "embedding", q["embedding"], 10, "vec_id", metric).collect()}
            hit += len(exact & {r["vec_id"] for r in got if r["query"] == q["vec_id"]})
            total += len(exact)
            assert {r["vec_id"] for r in index.search(q["embedding"], 10, probes=12).collect()} == exact
        assert hit / total >= 0.9, (metric, hit / total)
    empty = search.VectorIndex.build(df.limit(0), str(tmp_path / "none"), "embedding", "vec_id")
    assert empty.search([1.0] * 64, 3).count() == 0


@pytest.mark.parametrize("metric", vectors.METRICS)
def test_vector_index_blocks(spark, tmp_path, monkeypatch, metric):
    """Blocks of rows and queries meet, never single rows in a join; distances and ties are those of the plain search."""
    monkeypatch.setattr(search, "BLOCK", 64 * 20)
    monkeypatch.setattr(search, "PAIRS", 50)
    some = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").where("vec_id < 150").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    copies = some.where("vec_id < 3").crossJoin(spark.range(1, 20)).select((F.col("vec_id") + 1000 * F.col("id")).alias("vec_id"), "v")
    odd = some.where("vec_id < 5").select((F.col("vec_id") + 50_000).alias("vec_id"), F.transform("v", lambda x: x * F.when(F.col("vec_id") == 4, 0.0).otherwise(3.0)).alias("v"))
    huge = some.where("vec_id = 7").select(F.lit(60_000).cast("long").alias("vec_id"), F.transform("v", lambda x: x * 1e160).alias("v"))
    none = some.where("vec_id = 0").select(F.lit(70_000).cast("long").alias("vec_id"), F.lit(None).cast("array<double>").alias("v"))
    for name, df in (("tame", some.union(copies).union(odd).union(none)), ("wild", some.union(copies).union(odd).union(huge))):
        df = df.repartition(3).localCheckpoint()
        index = search.VectorIndex.build(df, str(tmp_path / name), "v", "vec_id", metric, cells=3)
        asked = df.where("vec_id % 10 = 0 OR vec_id > 40000").select(F.col("vec_id").alias("query"), F.col("v").alias("vector"))
        pairs = asked.crossJoin(df.where("v IS NOT NULL")).select("query", "vec_id", F.when(F.col("vector").isNotNull(), vectors.distance(F.col("v"), F.col("vector"), metric)).alias("distance")).collect()
        for k in (4, 500):
            found = index.search_all(asked, k, probes=3)
            want: dict = {}
            for r in sorted(pairs, key=lambda r: (math.isnan(d := r["distance"] or 0), 0 if math.isnan(d) else d, r["vec_id"])):
                want.setdefault(r["query"], []).append((r["query"], r["vec_id"], str(r["distance"] or 0.0)))
            assert sorted((r["query"], r["vec_id"], str(r["distance"] or 0.0)) for r in found.collect()) == sorted(x for rows in want.values() for x in rows[:k]), (name, k)
            assert {r["query"] for r in found.where("distance IS NULL").collect()} == ({70_000} if name == "tame" else set())
        plan = found._jdf.queryExecution().toString()
        assert "CoGroup" in plan and "HashJoin" not in plan and "SortMergeJoin" not in plan


def test_vector_index_refuses_other_lengths(spark, tmp_path):
    """Such rows were kept in no folder that a search reads."""
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0])], "id int, v array<double>")
    with pytest.raises(Exception, match="different lengths|requirement failed"):
        search.VectorIndex.build(df, str(tmp_path / "a"), "v", "id", cells=2)
    index = search.VectorIndex.build(df.where("id < 3"), str(tmp_path / "b"), "v", "id", cells=2)
    with pytest.raises(Exception, match="different lengths"):
        index.search_all(df.select(F.col("id").alias("query"), F.col("v").alias("vector")), 1, probes=2).collect()
    assert index.search_all(df.where("id < 3").select(F.col("id").alias("query"), F.col("v").alias("vector")), 0, probes=2).count() == 0
    empty = search.VectorIndex.build(df.limit(0), str(tmp_path / "none"), "v", "id")
    assert empty.search_all(df.select(F.col("id").alias("query"), F.col("v").alias("vector")), 3).count() == 0


def test_vector_index_counts_queries_without_vector(spark, data, tmp_path):
    rows = spark.read.parquet(f"{data}/embeddings.parquet")
    rows.withColumn("embedding", F.when(F.col("vec_id") != 100, F.col("embedding"))).write.parquet(f"{tmp_path}/embeddings.parquet")
    query, _ = ALL["vector_index_recall"]
    got = query(spark, str(tmp_path)).first()
    assert (got["enough"], got["queries"]) == (True, 5)


def test_spatial_cells(spark, tmp_path):
    cells = [r[0] for r in spark.createDataFrame([(48.1, 11.5), (48.2, 11.6), (-48.0, 11.5), (90.0, 180.0), (-90.0, -180.0), (None, 1.0)], "a double, o double").select(geo.cell(F.col("a"), F.col("o"))).collect()]
    assert abs(cells[0] - cells[1]) < abs(cells[0] - cells[2]) and cells[3] == 2**32 - 1 and cells[4] == 0 and cells[5] is None
    db = Database(spark, str(tmp_path / "db"))
    c = db.create("p", "id", "id int, place struct<lat: double, lon: double>")
    c.insert(spark.createDataFrame([(k, ((k * 37 % 180) - 90.0, (k * 91 % 360) - 180.0)) for k in range(500)], c.frame().schema))
    before = sorted(ids(c.near("place", (10, 20), 3000, exact=True)))
    c.create_index("by_place", "place", kind="spatial")
    assert sorted(ids(c.near("place", (10, 20), 3000, exact=True))) == before and len(before) > 3
    places = [geo_cell["c"] for geo_cell in c.frame().select(geo.cell(F.col("place.lat"), F.col("place.lon")).alias("c")).collect()]
    assert sum(a <= b for a, b in zip(places, places[1:])) > 490


def test_bson_streams(spark, tmp_path):
    import decimal

    schema = "id int, big bigint, x double, d decimal(12,3), s string, b binary, f boolean, day date, at timestamp, l array<int>, o struct<k: string, n: int>"
    rows = [(1, 1 << 40, 1.5, decimal.Decimal("-12.345"), "é", b"\0x", True, dt.date(2024, 2, 29), dt.datetime(2024, 1, 1, 5), [1, 2], ("k", 3)), (2, *[None] * 10)]
    df = spark.createDataFrame(rows, schema)
    files.write_bson(df, str(tmp_path / "out"))
    back = files.read_bson(spark, str(tmp_path / "out"), schema)
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    files.write_bson(df.limit(1), str(tmp_path / "out"), mode="overwrite")
    assert files.read_bson(spark, str(tmp_path / "out")).count() == 1
    assert files.unbson(files.bson({"a": {"b": [1, None, "x"]}})) == {"a": {"b": [1, None, "x"]}}
    for form in ("json", "csv", "bson"):
        files.export_subject({"t": (df.select("id", "s"), "id")}, 1, str(tmp_path / form), form)
    assert files.read_json(spark, str(tmp_path / "json/t"), "id int, s string").first()["s"] == "é"
    assert files.read_bson(spark, str(tmp_path / "bson/t"), "id int, s string").first()["id"] == 1
    assert spark.read.option("header", True).csv(str(tmp_path / "csv/t")).first()["s"] == "é"


def test_converted_values(spark):
    import enum

    from quillstone.functions import predicates

    class Role(enum.Enum):
        USER, ADMIN = 1, 2

    class Mail:
        def __init__(self, text):
            self.text = text

    predicates.converts(Mail, lambda m: m.text.lower())
    hour = 36_000_000_000
    df = Relation(spark.createDataFrame([(1, 1, "a@b.c", 9 * hour), (2, 2, "x@y.z", 17 * hour), (3, None, None, None)], "id int, role int, mail string, opens bigint"), ("id",))
    assert ids(df.where(field("role").eq(Role.ADMIN)).df) == [2] and ids(df.where(field("role").one_of([Role.USER, None])).df) == [1, 3]
    assert ids(df.where(field("mail").eq(Mail("X@y.z"))).df) == [2]
    assert ids(df.where(field("opens").lt(dt.time(12))).df) == [1] and ids(df.where(field("opens").ge(dt.timedelta(hours=17))).df) == [2]
    assert ids(df.where(field("role").compare_to(Role.USER) > 0).df) == [2]


def test_put_rows(few):
    both = few.order_by("v").append((9, "z", 0)).prepend((8, "y", 100)).append((7, "x", 1))
    assert ids(both.frame()) == [8, 2, 1, 4, 3, 9, 7] and both.frame().columns == ["id", "g", "v"]
    assert both.last_or_none()["id"] == 7 and both.first()["id"] == 8 and ids(both.reverse().frame())[0] == 7


def test_store_versions(spark, tmp_path):
    s = keyvalue.Store(spark, str(tmp_path / "kv"))
    s.load(spark.createDataFrame([(f"k{n}", str(n).encode()) for n in range(9)], "key string, value binary"), NOW)
    s.set("k1", b"new", NOW)
    assert s.get("k1", NOW) == b"new" and s.live(NOW).count() == 9
    assert s._block() < s._block()
    assert s.compact(NOW) == 1 and s._version() == 1 and s.live(NOW).count() == 9
    s.delete("k2", NOW)
    assert s.compact(NOW) == 2 and s.live(NOW).count() == 8
    calls = []
    s.fs.createNewFile(s._at("making/" + __import__("hashlib").sha256(b"slow").hexdigest()))  # somebody is making it
    assert s.get_or_set("slow", lambda: calls.append(1) or b"v", NOW, patience_s=0.3) == b"v" and calls == [1]


def test_near_vector_stands_alone():
    from quillstone.plans import filters as f
    from quillstone.plans.typed import nearest

    near = {"v": {"$nearVector": {"$vector": [1.0], "$k": 2}}}
    assert nearest(f.parse({"a": 1, **near})).k == 2 and nearest(f.parse({"a": 1})) is None
    for bad in ({"$or": [near, {"a": 1}]}, {"$nor": [near]}, {"$and": [near, near]}):
        with pytest.raises(f.FilterError):
            nearest(f.parse(bad))


def test_no_folder_of_one_machine_on_a_cluster(monkeypatch):
    from types import SimpleNamespace

    from quillstone.sources.shared import shared_root

    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(RuntimeError):
        shared_root(cluster)


def test_encryption(spark):
    from quillstone.operators import encryption as e

    # fixed values: test case 1 of RFC 5869, and a published one of PBKDF2
    assert e.expand(bytes([0x0B] * 22), bytes(range(0xF0, 0xFA)), bytes(range(13)), 42).hex() == "3cb25f25faacd57a90434f64d0362f2a2d2d0a90cf1a5a4c5db02d56ecc4c5bf34007208d5b887185865"
    assert e.key_of("password", b"salt", 1).hex() == "120fb6cffcf8b32c43e7225256c4f837a86548c92ccc35480805987cb70be17b"
    df = spark.createDataFrame([(1, "é", None, [1, 2]), (2, "é", 2.5, None)], "id int, `a.b` string, x double, l array<int>")
    key = e.expand(b"k" * 32, b"t")
    sealed = e.seal(df, key, "t", ["id"])
    rows = sealed.collect()
    assert sealed.columns == ["id", "sealed"] and all("é".encode() not in bytes(r["sealed"]) for r in rows)
    back = e.unseal(spark.createDataFrame(rows, sealed.schema), key, "t", "`a.b` string, x double, l array<int>")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    for other, name in ((e.expand(b"k" * 32, b"u"), "t"), (key, "u")):
        with pytest.raises(Exception, match="AES"):
            e.unseal(spark.createDataFrame(rows, sealed.schema), other, name, "x double").collect()
    with pytest.raises(ValueError):
        e.seal(df, b"short", "t")
