"""Nearest vectors and places."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.functions.geo import box_around, haversine_km, lat_of, lon_of, within_box
from quillstone.functions.vectors import distance


def nearest(df: DataFrame, vector: str, query: Sequence[float], k: int, key: str, metric: str = "cosine", name: str = "distance") -> DataFrame:
    """The k rows nearest to query, exactly: each task keeps its own best k. More than there are gives all."""
    scored = df.where(F.col(vector).isNotNull()).withColumn(name, distance(F.col(vector), query, metric))
    return scored.orderBy(name, key).limit(k)


def nearest_of_many(df: DataFrame, vectors: str, query: Sequence[float], k: int, key: str, metric: str = "cosine", name: str = "distance") -> DataFrame:
    """Rows with several vectors; the nearest of a row's vectors counts."""
    best = F.array_min(F.transform(vectors, lambda v: distance(v, query, metric)))
    return df.where(F.size(vectors) > 0).withColumn(name, best).orderBy(name, key).limit(k)


def nearest_groups(df: DataFrame, vector: str, query: Sequence[float], k: int, group: str, metric: str = "cosine", name: str = "distance") -> DataFrame:
    """The k groups of rows nearest to query, each by its nearest row: a minimum per task and group, so groups may be of any size."""
    scored = df.where(F.col(vector).isNotNull()).select(group, distance(F.col(vector), query, metric).alias(name))
    return scored.groupBy(group).agg(F.min(name).alias(name)).orderBy(name, group).limit(k)


#: Rows that the centres of an index are fitted on, at most.
CENTRE_SAMPLE = 20_000
#: Numbers in the vectors of a block of rows or of queries: one block of each meets in a task.
BLOCK = 1 << 21
#: Pairs of a query and a row that are scored at once.
PAIRS = 1 << 21
_CELL = "_cell"


class VectorIndex:
    """An approximate index of a table's vectors: every row lies in a folder by the nearest of some centres.

    The centres come from a bounded sample (CENTRE_SAMPLE rows, first by a hash of the key); all rows are indexed. A search
    reads the folders of the `probes` centres nearest to the query and is exact among their rows; with as many probes as
    centres it is exact. Rows without a vector are left out. `metric` is that of the searches; cosine centres are of unit vectors.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        own = json.loads(spark.read.text(f"{self.path}/centres").first()[0])
        self.vector, self.key, self.metric, self.centres = own["vector"], own["key"], own["metric"], np.array(own["centres"])
        self.schema = T.StructType.fromJson(own["schema"]).add(_CELL, T.IntegerType())

    @classmethod
    def build(cls, df: DataFrame, path: str, vector: str, key: str, metric: str = "cosine", cells: int = 16, seed: int = 1) -> VectorIndex:
        rows = df.where(F.col(vector).isNotNull())
        sample = rows.orderBy(F.xxhash64(key), key).limit(CENTRE_SAMPLE).select(array_to_vector(_unit(F.col(vector), metric)).alias("features"))
        fitted = None if rows.isEmpty() else KMeans(k=cells, seed=seed, maxIter=20).fit(sample.coalesce(1))
        centres = [[float(x) for x in c] for c in fitted.clusterCenters()] if fitted else []
        place = F.get(_cells(F.col(vector), np.array(centres), metric, 1, "l2"), F.lit(0)) if centres else F.lit(0)
        rows.withColumn(_CELL, place).repartition(_CELL, F.pmod(F.xxhash64(key), F.lit(8))).write.mode("overwrite").partitionBy(_CELL).parquet(f"{path}/rows")
        text = json.dumps({"vector": vector, "key": key, "metric": metric, "centres": centres, "schema": json.loads(df.schema.json())})
        df.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/centres")
        return cls(df.sparkSession, path)

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/rows")

    def _probed(self, query: Sequence[float], probes: int) -> list[int]:
        return _ranked(np.asarray([query], float), self.centres, self.metric)[0, :probes].tolist()

    def search(self, query: Sequence[float], k: int, probes: int = 12, name: str = "distance") -> DataFrame:
        """The k nearest rows among those of the probed folders; other folders aren't read."""
        rows = self.rows().where(F.col(_CELL).isin(*self._probed(query, probes))) if len(self.centres) else self.rows()
        return nearest(rows, self.vector, query, k, self.key, self.metric, name).drop(_CELL)

    def search_all(self, queries: DataFrame, k: int, probes: int = 12, query_key: str = "query", query_vector: str = "vector") -> DataFrame:
        """query_key, key and distance of the k nearest rows of each query, among the folders that it probes.

        Rows of a folder and queries are cut into blocks of a bounded size; each block of queries meets each of rows in one
        task, which gives k rows a query. To a query without a vector all distances are null, so it has the k lowest keys.
        """
        key, metric, fit = self.key, self.metric, max(1, BLOCK // max(1, self.centres.shape[-1]))
        held = {r[_CELL]: r["count"] for r in self.rows().groupBy(_CELL).count().collect()}
        asked = queries.where(F.col(query_vector).isNotNull()).select(F.col(query_key).alias("_query"), F.col(query_vector).alias("_asked"))
        slices = max(1, -(-asked.count() // fit))
        parts = F.get(F.array(*(F.lit(max(1, -(-held.get(c, 0) // fit))) for c in range(max(1, len(self.centres))))), F.col(_CELL))
        left = self.rows().select(_CELL, F.pmod(F.xxhash64(key), parts).cast("int").alias("_part"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("_slice"), F.col(key).alias("_key"), F.col(self.vector).alias("_vector"))
        right = asked.withColumn(_CELL, F.explode(_cells(F.col("_asked"), self.centres, metric, probes, metric)))
        right = right.select(_CELL, F.explode(F.sequence(F.lit(0), parts - 1)).alias("_part"), F.pmod(F.xxhash64("_query"), F.lit(slices)).cast("int").alias("_slice"), "_query", "_asked")

        def meet(rows: pa.Table, of: pa.Table) -> pa.Table:
            keys, named = rows["_key"].combine_chunks(), of["_query"].combine_chunks()
            if not len(keys) or not len(named):
                return pa.table({"_query": named[:0], "_key": keys[:0], "distance": pa.array([], pa.float64())})
            rank = np.empty(len(keys), np.int64)
            rank[pc.array_sort_indices(keys, null_placement="at_start").to_numpy()] = np.arange(len(keys))
            with np.errstate(all="ignore"):
                q, r, d = map(np.concatenate, zip(*_best(_matrix(of["_asked"].combine_chunks()), _matrix(rows["_vector"].combine_chunks()), rank, k, metric)))
            return pa.table({"_query": named.take(pa.array(q)), "_key": keys.take(pa.array(r)), "distance": pa.array(d)})

        schema = T.StructType([asked.schema["_query"], T.StructField("_key", self.schema[key].dataType), T.StructField("distance", T.DoubleType())])
        block = [_CELL, "_part", "_slice"]
        scored = left.groupBy(*block).cogroup(right.groupBy(*block)).applyInArrow(meet, schema)
        order = Window.partitionBy("_query").orderBy("distance", "_key")
        best = scored.withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") <= k)
        lacking = queries.where(F.col(query_vector).isNull()).select(F.col(query_key).alias("_query"))
        first = self.rows().select(F.col(key).alias("_key")).orderBy("_key").limit(k)
        best = best.drop("_nth").union(lacking.crossJoin(first).withColumn("distance", F.lit(None).cast("double")))
        return best.select(F.col("_query").alias(query_key), F.col("_key").alias(key), "distance")


def _unit(vector: Column, metric: str) -> Column:
    own = vector.cast("array<double>")
    if metric != "cosine":
        return own
    norm = F.sqrt(F.aggregate(own, F.lit(0.0), lambda total, x: total + x * x))
    scaled = F.transform(F.array(norm), lambda n: F.when(n == 0, own).otherwise(F.transform(own, lambda x: x / n)))  # the norm once, not for each element
    return F.get(scaled, F.lit(0))


def _matrix(vectors: pa.Array, size: int | None = None) -> np.ndarray:
    """A row of doubles for each vector; fails on lengths that differ and elements that lack, as that means nothing."""
    size = len(vectors[0]) if size is None else size
    if not pc.all(pc.equal(pc.list_value_length(vectors), size)).as_py():
        raise ValueError("vectors of different lengths")
    flat = vectors.flatten()
    if flat.null_count:
        raise ValueError("a vector has an element that is null")
    return flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(vectors), size)


def _ranked(vectors: np.ndarray, centres: np.ndarray, metric: str, by: str | None = None) -> np.ndarray:
    """Numbers of the centres by their distance to each vector, nearest first; by: the distance, if not that of metric."""
    if metric == "cosine":
        norms = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
        vectors = vectors / np.where(norms == 0, 1.0, norms)
    apart = [-(vectors * c).sum(axis=1) if (by or metric) == "dot" else ((vectors - c) ** 2).sum(axis=1) for c in centres]
    return np.argsort(np.array(apart).reshape(len(centres), len(vectors)).T, axis=1, kind="stable")


def _cells(vector: Column, centres: np.ndarray, metric: str, probes: int, by: str) -> Column:
    """The numbers of the `probes` nearest centres of a vector."""

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def cells(vectors: pa.Array) -> pa.Array:
        if not len(vectors) or not len(centres):
            return pa.array([[]] * len(vectors), pa.list_(pa.int32()))
        with np.errstate(all="ignore"):
            found = _ranked(_matrix(vectors, centres.shape[1]), centres, metric, by)[:, :probes].astype(np.int32)
        return pa.ListArray.from_arrays(np.arange(len(found) + 1, dtype=np.int32) * found.shape[1], found.ravel())

    return cells(vector)


def _norms(vectors: np.ndarray) -> np.ndarray:
    every = np.arange(len(vectors))
    return np.sqrt(_products(vectors, vectors, every, every, "dot"))


def _products(a: np.ndarray, b: np.ndarray, at: np.ndarray, of: np.ndarray, metric: str) -> np.ndarray:
    """Of rows `at` of a and `of` of b, the sum of products (l2: squared differences), term after term as functions.vectors sums."""
    total = np.zeros(len(at))
    for x, y in zip(a.T, b.T):
        x, y = x[at], y[of]
        total += (x - y) * (x - y) if metric == "l2" else x * y
    return total


def _best(queries: np.ndarray, vectors: np.ndarray, rank: np.ndarray, k: int, metric: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Numbers of queries, of their k nearest rows, and distances; of rows equally near, those of the lowest rank.

    A product of matrices, whose rounding depends on where a row stands, only leaves out rows that can't be among the k by
    any rounding. The distances of the others are those of functions.vectors to the last bit, so equal vectors are equally near.
    """
    n, size = vectors.shape
    k, own, lengths = max(1, min(k, n)), _norms(vectors), _norms(queries)
    queries, vectors = np.asfortranarray(queries), np.asfortranarray(vectors)
    norms = np.concatenate([own, lengths])
    tame = bool(np.all((norms == 0) | (norms > 1e-100) & (norms < 1e100)))  # false of NaN; else bounds on rounding don't hold, and all pairs are summed
    error = 8 * (size + 8) * np.finfo(float).eps
    step = max(1, PAIRS // n)
    for start in range(0, len(queries), step):
        some, long = queries[start : start + step], lengths[start : start + step, None]
        if tame:
            product = some @ vectors.T
            if metric == "cosine":
                scale = long * own
                rough, slack = -product / np.where(scale == 0, 1.0, scale), error
            elif metric == "dot":
                rough, slack = -product, error * long * own.max()
            else:
                rough, slack = own**2 - 2 * product + long**2, error * (long + own.max()) ** 2
            q, r = np.nonzero(rough <= np.partition(rough, k - 1, axis=1)[:, k - 1 : k] + 2 * slack)
        else:
            q, r = (x.ravel() for x in np.indices((len(some), n)))
        d = _products(vectors, some, r, q, metric)
        if metric == "cosine":
            scale = own[r] * long[q, 0]
            d = 1 - np.divide(d, scale, out=np.zeros(len(d)), where=scale != 0)
        elif metric == "dot":
            d = -d
        order = np.lexsort((rank[r], d, q))
        q, r, d = q[order], r[order], d[order]
        keep = np.arange(len(q)) - np.searchsorted(q, q) < k
        yield q[keep] + start, r[keep], d[keep]


def within(df: DataFrame, point: str, low: tuple[float, float], high: tuple[float, float]) -> DataFrame:
    """Points in a box, borders included; corners are (lat, lon)."""
    return df.where(within_box(F.col(point), df.schema[point].dataType, low, high))


def near(df: DataFrame, point: str, center: tuple[float, float], km: float, exact: bool = False, name: str | None = None) -> DataFrame:
    """Points in the box around a circle, as an index of boxes would give; with exact=True those in the circle."""
    kind = df.schema[point].dataType
    rows = within(df, point, *box_around(*center, km))
    away = haversine_km(lat_of(F.col(point), kind), lon_of(F.col(point), kind), F.lit(center[0]), F.lit(center[1]))
    rows = rows.where(away <= km) if exact else rows
    return rows.withColumn(name, away) if name else rows
