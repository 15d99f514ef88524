"""A database of named collections, each a Parquet table under one folder, with its catalog entries.

A collection is a list of parts (folders). An insert adds a part; an update or a delete rewrites the parts that hold the
rows. Parts are written before a catalog entry names them, and an entry is a new file beside the older ones, the newest of
which counts: readers and failed writes never see half of one, and of two writers that began from the same entry one fails.

Indexes are ways to lay files out: sorted by their columns, so that min/max statistics prune (btree); in folders by a hash
of a column, so that a look-up reads one (hash); sorted along a curve through cells of the sphere (spatial); in folders by
the nearest of a few centres (vector, in operators.search).
"""

from __future__ import annotations

import datetime as dt
import hashlib
import itertools
import json
import re
import time
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.functions import geo
from quillstone.functions.predicates import decided
from quillstone.operators import retention, search
from quillstone.operators.metrics import AuditLog
from quillstone.operators.relation import Relation
from quillstone.plans import filters as f
from quillstone.plans.access import Cursor, IndexPlan, plan_of
from quillstone.plans.query import DocQuery
from quillstone.sources.shared import kept, shared_root


class DuplicateKey(ValueError):
    """A write would repeat a key or a unique value."""


class Conflict(RuntimeError):
    """Another writer changed the collection meanwhile."""


#: Folders of a hash index.
BUCKETS = 64
_BUCKET = "_bucket"
#: A series is pruned after so many inserted rows, or so long after the last time.
PRUNE_ROWS, PRUNE_EVERY = 1000, dt.timedelta(minutes=5)


@dataclass
class Entry:
    """Of a collection: version, key, parts, schema versions (JSON), indexes (name -> columns, unique, kind), retention, series.

    retention: a Policy as JSON; series: field, time to live in seconds, rows since the last pruning, its time. saved: number of its file.
    """

    name: str
    key: str
    version: int = 0
    parts: list[str] = field(default_factory=list)
    schemas: list[str] = field(default_factory=list)
    indexes: dict[str, dict] = field(default_factory=dict)
    retention: dict | None = None
    series: dict | None = None
    saved: int = 0


def _utc() -> dt.datetime:
    return dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)


class Database:
    """clock: the time of inserts, for retention and series; audit: where operations are recorded."""

    def __init__(self, spark: SparkSession, root: str, clock: Callable[[], dt.datetime] = _utc, audit: AuditLog | None = None):
        self.spark, self.root, self.clock, self.audit = spark, root.rstrip("/"), clock, audit
        self.jvm = spark._jvm
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    @classmethod
    def temporary(cls, spark: SparkSession, **options) -> Database:
        """A database that lives until close(), or to the end of a with block; its rows are in the folder that all executors share."""
        return cls(spark, f"{shared_root(spark)}/temporary-{uuid.uuid4().hex}", **options)

    def close(self) -> None:
        """Deletes the database."""
        self.fs.delete(self._path(""), True)

    def __enter__(self) -> Database:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _read_text(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _entries(self, name: str) -> list[int]:
        at = self._path(f"_catalog/{name}")
        names = [x.getPath().getName() for x in self.fs.listStatus(at)] if self.fs.exists(at) else []
        return sorted(int(n[:-5]) for n in names if re.fullmatch(r"[0-9]+\.json", n))

    @contextmanager
    def recorded(self, collection: str, kind: str) -> Iterator[None]:
        """An audit event of what is done inside, if there is an audit log."""
        start = time.perf_counter()
        yield
        if self.audit is not None:
            self.audit.record(self.clock(), collection, kind, int((time.perf_counter() - start) * 1e6))

    # catalog
    def collections(self) -> list[str]:
        if not self.fs.exists(self._path("_catalog")):
            return []
        return sorted(n for s in self.fs.listStatus(self._path("_catalog")) if self._entries(n := s.getPath().getName()))

    def entry(self, name: str) -> Entry:
        numbers = self._entries(name)
        if not numbers:
            raise LookupError(f"no collection {name}")
        return Entry(**json.loads(self._read_text(f"_catalog/{name}/{numbers[-1]:012d}.json")))

    def _save(self, entry: Entry) -> None:
        """Writes the entry beside the one that it was read from."""
        entry.saved += 1
        final = self._path(f"_catalog/{entry.name}/{entry.saved:012d}.json")
        if self.fs.exists(final):
            raise Conflict(f"{entry.name} was changed by another writer")
        draft = self._path(f"_catalog/{entry.name}/{uuid.uuid4().hex}.new")
        out = self.fs.create(draft, True)
        out.write(bytearray(json.dumps(asdict(entry)).encode()))
        out.close()
        if not self.fs.rename(draft, final):
            raise Conflict(f"{entry.name} was changed by another writer")

    def create(self, name: str, key: str, schema: T.StructType | str, series: str | None = None, ttl: dt.timedelta | None = None) -> Collection:
        """series: time field of a series, whose rows live for `ttl`."""
        if not re.fullmatch(r"[A-Za-z0-9_]+", name) or name.startswith("_"):
            raise ValueError("a collection's name has letters, digits and _, and doesn't start with _")
        if name in self.collections():
            raise ValueError(f"{name} exists")
        empty = self.spark.createDataFrame([], schema)
        if key not in empty.columns:
            raise ValueError(f"{key} isn't a column")
        own = Collection(self, name)
        entry = Entry(name, key, series=series and {"field": series, "ttl_s": (ttl or dt.timedelta(days=7)).total_seconds(), "rows": 0, "pruned": None})
        own._commit(entry, empty)
        return own

    def __getitem__(self, name: str) -> Collection:
        self.entry(name)
        return Collection(self, name)

    def drop(self, name: str) -> bool:
        if name not in self.collections():
            return False
        self.fs.delete(self._path(f"_catalog/{name}"), True)
        self.fs.delete(self._path(name), True)
        return True

    def vacuum(self, name: str | None = None) -> None:
        """Deletes old versions and rewrites the current one in whole files."""
        for one in [name] if name else self.collections():
            own = self[one]
            entry = self.entry(one)
            own._commit(entry, own.frame(), sort=True)
            for status in self.fs.listStatus(self._path(one)):
                if status.getPath().getName() not in entry.parts:
                    self.fs.delete(status.getPath(), True)
            for number in self._entries(one)[:-1]:
                self.fs.delete(self._path(f"_catalog/{one}/{number:012d}.json"), False)

    def backup(self, target: str) -> DataFrame:
        """Copies all collections and returns the manifest (file, bytes, sha256), which is written beside them."""
        for name in self.collections():
            for part in self.entry(name).parts:
                self.spark.read.parquet(f"{self.root}/{name}/{part}").write.mode("overwrite").parquet(f"{target}/{name}/{part}")
        other = Database(self.spark, target)
        for name in self.collections():
            entry = self.entry(name)
            entry.saved = 0
            other._save(entry)
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(target)
        manifest = files.select(F.regexp_replace("path", r"^.*?([^/]+/part\d+-[0-9a-f]+/(?:_bucket=\d+/)?[^/]+)$", "$1").alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
        manifest.write.mode("overwrite").json(f"{target}/_manifest")
        return self.spark.read.schema("file string, bytes bigint, sha256 string").json(f"{target}/_manifest")

    def migrate(self, target: str, files: int | None = None) -> Database:
        """A copy in another layout: each collection as one part of `files` files (1: a single one), or as Spark deals it."""
        other = Database(self.spark, target, self.clock, self.audit)
        for name in self.collections():
            entry = self.entry(name)
            rows = self[name].frame()
            fresh = Entry(name, entry.key, schemas=entry.schemas, indexes=entry.indexes, retention=entry.retention, series=entry.series)
            Collection(other, name)._commit(fresh, rows if files is None else rows.repartition(files))
        return other


class Collection:
    def __init__(self, db: Database, name: str):
        self.db, self.name = db, name

    @property
    def key(self) -> str:
        return self.db.entry(self.name).key

    def frame(self) -> DataFrame:
        return self._read(self.db.entry(self.name))

    def _read(self, entry: Entry, parts: list[str] | None = None, buckets: bool = False) -> DataFrame:
        """Rows of all parts or some; columns that a part lacks are null."""
        schema = T.StructType.fromJson(json.loads(entry.schemas[-1]))
        named = entry.parts if parts is None else parts
        if not named:
            return self.db.spark.createDataFrame([], schema)
        paths = [f"{self.db.root}/{self.name}/{p}" for p in named]
        if self._hashed(entry) is None:
            return self.db.spark.read.schema(schema).parquet(*paths)
        whole = T.StructType([*schema.fields, T.StructField(_BUCKET, T.IntegerType())])
        rows = reduce(DataFrame.unionByName, (self.db.spark.read.schema(whole).parquet(p) for p in paths))  # each part has folders of its own
        return rows if buckets else rows.drop(_BUCKET)

    @staticmethod
    def _hashed(entry: Entry) -> str | None:
        return next((i["columns"][0] for i in entry.indexes.values() if i["kind"] == "hash"), None)

    def _order(self, entry: Entry, schema: T.StructType) -> list[Column]:
        """What the files are sorted by."""
        out = []
        for i in entry.indexes.values():
            if i["kind"] == "spatial":
                point, kind = F.col(i["columns"][0]), schema[i["columns"][0]].dataType
                out.append(geo.cell(geo.lat_of(point, kind), geo.lon_of(point, kind)))
            elif i["kind"] == "btree":
                out += map(F.col, i["columns"])
        return out

    def _commit(self, entry: Entry, df: DataFrame, replaced: list[str] | None = None, schema: T.StructType | None = None, sort: bool = False) -> None:
        """Writes df as a new part, in place of the parts in `replaced` (all by default)."""
        with self.db.recorded(self.name, "commit"):
            text = json.dumps(json.loads((schema or df.schema).json()), sort_keys=True)
            if not entry.schemas or entry.schemas[-1] != text:
                entry.schemas.append(text)
            order, hashed = self._order(entry, df.schema), self._hashed(entry)
            if hashed:
                df = df.withColumn(_BUCKET, F.pmod(F.xxhash64(hashed), F.lit(BUCKETS)).cast("int"))
                df = df.repartition(_BUCKET).sortWithinPartitions(_BUCKET, *order) if sort else df
            elif sort and order:
                df = df.repartitionByRange(order[0]).sortWithinPartitions(*order)
            entry.version += 1
            part = f"part{entry.version}-{uuid.uuid4().hex[:8]}"
            writer = df.write.mode("overwrite")
            (writer.partitionBy(_BUCKET) if hashed else writer).parquet(f"{self.db.root}/{self.name}/{part}")
            entry.parts = [*([] if replaced is None else [p for p in entry.parts if p not in replaced]), part]
            self.db._save(entry)

    def _placed(self, entry: Entry) -> DataFrame:
        """Rows with the part that holds them in _in."""
        return self._read(entry).withColumn("_in", F.regexp_extract(F.input_file_name(), r"/(part\d+-[0-9a-f]+)/(?:_bucket=\d+/)?[^/]*$", 1))

    def _holding(self, entry: Entry, ids: DataFrame) -> list[str]:
        """The parts in which any of the ids is; only keys are read."""
        found = self._placed(entry).select(entry.key, "_in")
        return [r["_in"] for r in found.join(ids, entry.key, "left_semi").select("_in").distinct().collect()]

    def schema_version(self) -> int:
        return len(self.db.entry(self.name).schemas)

    # queries
    def query(self, source: str | dict | None = None) -> DocQuery:
        own = DocQuery(self.frame(), self.key)
        return own if source is None else own.filter(source)

    def rows(self) -> Relation:
        return Relation(self.frame(), (self.key,))

    def find_by_id(self, id_) -> DataFrame:
        return self.frame().where(F.col(self.key) == F.lit(id_)).limit(1)

    def find(self, predicate: Column) -> DataFrame:
        return self.frame().where(decided(predicate))

    def find_rows(self, predicate: Callable[[dict], bool], *columns: str) -> DataFrame:
        """Rows that a Python function accepts; it sees `columns`, or all."""
        return self.rows().where_rows(predicate, *columns).df

    def find_hashed(self, value) -> DataFrame:
        """Rows by the column of the hash index; one folder of each part is read."""
        entry = self.db.entry(self.name)
        column = self._hashed(entry)
        if column is None:
            raise LookupError(f"{self.name} has no hash index")
        rows = self._read(entry, buckets=True)
        wanted = F.lit(value).cast(rows.schema[column].dataType)
        bucket = self.db.spark.range(1).select(F.pmod(F.xxhash64(wanted), F.lit(BUCKETS)).cast("int")).first()[0]
        return rows.where((F.col(_BUCKET) == bucket) & (F.col(column) == wanted)).drop(_BUCKET)

    def bounds(self, column: str) -> tuple:
        """Least and greatest value of a column, from the statistics in the files' footers; (None, None) without rows."""
        conf, before = self.db.spark.conf, {}
        for k, v in {"spark.sql.sources.useV1SourceList": "", "spark.sql.parquet.aggregatePushdown": "true"}.items():
            before[k] = conf.get(k)
            conf.set(k, v)
        try:
            return tuple(self.frame().agg(F.min(column), F.max(column)).first())
        finally:
            for k, v in before.items():
                conf.set(k, v)

    def near(self, point: str, center: tuple[float, float], km: float, exact: bool = False) -> DataFrame:
        return search.near(self.frame(), point, center, km, exact)

    def within(self, point: str, low: tuple[float, float], high: tuple[float, float]) -> DataFrame:
        return search.within(self.frame(), point, low, high)

    # plans
    def plan(self, source: str | dict | f.Node) -> IndexPlan:
        return plan_of(source if isinstance(source, f.Node) else f.parse(source), {i["columns"][0] for i in self.indexes().values() if i["kind"] in ("btree", "hash")} | {self.key})

    def run(self, plan: IndexPlan) -> Relation:
        """The rows of a plan, in the order of its index, with all terminals of the fluent surface."""
        rows = Relation(plan.rows(self.frame()), (self.key,))
        return rows if plan.column is None else rows.order_by(plan.column)

    def cursor(self, column: str | None = None) -> Cursor:
        return Cursor(self.frame(), column or self.key, self.key)

    def find_one(self, predicate: Column) -> DataFrame:
        return self.find(predicate).limit(1)

    def scan(self, predicate: Column | None = None, *columns: str | Column) -> DataFrame:
        rows = self.frame() if predicate is None else self.frame().where(predicate)
        return rows.select(*columns) if columns else rows

    def range(self, column: str, low=None, high=None, ascending: bool = True, skip: int = 0, take: int | None = None) -> DataFrame:
        """Rows in the order of a column between inclusive bounds; nulls are in no range with bounds."""
        rows = self.frame()
        if low is not None:
            rows = rows.where(F.col(column) >= F.lit(low))
        if high is not None:
            rows = rows.where(F.col(column) <= F.lit(high))
        order = F.col(column).asc_nulls_first() if ascending else F.col(column).desc_nulls_last()
        rows = rows.orderBy(order, self.key).offset(skip)
        return rows if take is None else rows.limit(take)

    def count(self, predicate: Column | None = None) -> int:
        return self.scan(predicate).count()

    # writes
    def _check(self, entry: Entry, new: DataFrame, old: DataFrame | None = None) -> None:
        """Fails on keys or unique values that are twice in `new`, or in `new` and `old`. Reads only those columns."""
        unique = [[entry.key], *(i["columns"] for i in entry.indexes.values() if i["unique"])]
        for columns in unique:
            known = new.where(" AND ".join(f"`{c}` IS NOT NULL" for c in columns)) if columns != [entry.key] else new
            if (twice := known.groupBy(*columns).count().where("count > 1").first()) is not None:
                raise DuplicateKey(f"{self.name}: {columns} {[twice[c] for c in columns]} more than once")
            if old is not None and (there := known.select(*columns).join(old.select(*columns), columns, "left_semi").first()) is not None:
                raise DuplicateKey(f"{self.name}: {columns} {list(there)} exists")

    def insert(self, rows: DataFrame) -> None:
        """Appends a part. Columns that the collection lacks are added (a new schema version); those that rows lack are null."""
        entry, old = self.db.entry(self.name), self.frame()
        rows = kept(rows.withColumn(entry.key, F.coalesce(F.col(entry.key), F.uuid())), "inserted") if dict(rows.dtypes).get(entry.key) == "string" else rows
        whole = old.limit(0).unionByName(rows, allowMissingColumns=True)
        now = self.db.clock()
        if entry.series:
            whole = retention.stamp_missing(whole, entry.series["field"], now)
            entry.series["rows"] += whole.count()
        self._check(entry, whole, whole.limit(0).unionByName(old, allowMissingColumns=True))
        with self.db.recorded(self.name, "insert"):
            self._commit(entry, whole, [], whole.schema)
        if entry.series:
            last = entry.series["pruned"]
            if entry.series["rows"] >= PRUNE_ROWS or last is not None and now - dt.datetime.fromisoformat(last) >= PRUNE_EVERY:
                self.prune(now)
            elif last is None:
                self._pruned(self.db.entry(self.name), now)
        if entry.retention and entry.retention["on_insert"]:
            self.retain(now)

    def _pruned(self, entry: Entry, now: dt.datetime) -> None:
        entry.series |= {"rows": 0 if entry.series["pruned"] else entry.series["rows"], "pruned": now.isoformat()}
        self.db._save(entry)

    def prune(self, now: dt.datetime | None = None) -> list[str]:
        """Drops, of a series, whole parts whose newest row is older than its time to live, oldest part first, up to the first fresh one."""
        entry, now = self.db.entry(self.name), now or self.db.clock()
        if not entry.series:
            raise ValueError(f"{self.name} isn't a series")
        cutoff = now - dt.timedelta(seconds=entry.series["ttl_s"])
        newest = {r["_in"]: r["newest"] for r in self._placed(entry).groupBy("_in").agg(F.max(entry.series["field"]).alias("newest")).collect()}
        gone = list(itertools.takewhile(lambda p: p not in newest or newest[p].replace(tzinfo=None) < cutoff, entry.parts))
        entry.parts = [p for p in entry.parts if p not in gone]
        entry.series |= {"rows": 0, "pruned": now.isoformat()}
        self.db._save(entry)
        return [p for p in gone if p in newest]

    def set_retention(self, policy: retention.Policy | None) -> None:
        entry = self.db.entry(self.name)
        entry.retention = policy and asdict(policy) | {"max_age": policy.max_age.total_seconds()}
        self.db._save(entry)

    def policy(self) -> retention.Policy | None:
        own = self.db.entry(self.name).retention
        return own and retention.Policy(**own | {"max_age": dt.timedelta(seconds=own["max_age"])})

    def retain(self, now: dt.datetime | None = None) -> int:
        """Applies the policy of the collection; returns how many rows went. Parts that lose none stay as they are."""
        policy, rows = self.policy(), self.frame()
        if policy is None:
            return 0
        stay = retention.apply(rows, policy, now or self.db.clock(), self.key).select(F.col(self.key).alias("_stays"))
        return self.delete(kept(rows.join(stay, F.col(self.key).eqNullSafe(F.col("_stays")), "left_anti").select(self.key), "retained"))

    def update(self, rows: DataFrame) -> int:
        """Replaces rows by key; returns how many there were. Parts without any of them stay as they are."""
        entry, old = self.db.entry(self.name), self.frame()
        found = rows.join(old.select(entry.key), entry.key, "left_semi")
        n = found.count()
        if n:
            parts = self._holding(entry, found.select(entry.key))
            rest = old.join(found.select(entry.key), entry.key, "left_anti")
            self._check(entry, found.select(*old.columns), rest)
            with self.db.recorded(self.name, "update"):
                self._commit(entry, self._read(entry, parts).join(found.select(entry.key), entry.key, "left_anti").unionByName(found.select(*old.columns)), parts)
        return n

    def delete(self, ids: Sequence | DataFrame) -> int:
        entry, old = self.db.entry(self.name), self.frame()
        gone = ids if isinstance(ids, DataFrame) else self.db.spark.createDataFrame([(i,) for i in ids], T.StructType([old.schema[entry.key]]))
        n = old.join(gone, entry.key, "left_semi").count()
        if n:
            parts = self._holding(entry, gone)
            with self.db.recorded(self.name, "delete"):
                self._commit(entry, self._read(entry, parts).join(gone, entry.key, "left_anti"), parts)
        return n

    def truncate(self) -> int:
        n = self.frame().count()
        self._commit(self.db.entry(self.name), self.frame().limit(0))
        return n

    def replace(self, df: DataFrame) -> None:
        entry = self.db.entry(self.name)
        self._check(entry, df)
        self._commit(entry, df)

    # indexes
    def create_index(self, name: str, *columns: str, unique: bool = False, kind: str = "btree") -> None:
        """Lays the files out by the columns (btree, hash, spatial: see the module); unique values are enforced on writes."""
        if kind not in ("btree", "hash", "spatial"):
            raise ValueError("an index is btree, hash or spatial; vectors are indexed by operators.search.VectorIndex")
        entry = self.db.entry(self.name)
        if name in entry.indexes:
            raise ValueError(f"index {name} exists")
        if kind == "hash" and self._hashed(entry):
            raise ValueError("files have one hash index")
        rows = self._read(entry)
        entry.indexes[name] = {"columns": list(columns), "unique": unique, "kind": kind}
        self._check(entry, rows)
        self._commit(entry, rows, sort=True)

    def drop_index(self, name: str) -> bool:
        entry = self.db.entry(self.name)
        rows, gone = self._read(entry), entry.indexes.pop(name, None)
        if gone is not None and gone["kind"] == "hash":
            self._commit(entry, rows)
        elif gone is not None:
            self.db._save(entry)
        return gone is not None

    def indexes(self) -> dict[str, dict]:
        return self.db.entry(self.name).indexes

    def digest(self) -> str:
        """Of the content, whatever the order of rows."""
        hashes = self.frame().select(F.xxhash64(F.to_json(F.struct("*"))).alias("h")).agg(F.bit_xor("h"), F.count("*")).first()
        return hashlib.sha256(repr(tuple(hashes)).encode()).hexdigest()
