"""The fluent query surface: a lazy sequence of rows with projections, grouping, joins, set and positional operators.

Operators apply in the order in which they are written. Sorting is stable: an order that isn't total is completed by the
columns of `key`. Positions are counted without sending rows to one task: see `numbered`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace
from functools import reduce
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.functions.predicates import decided
from quillstone.sources.shared import kept


def column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


@dataclass(frozen=True)
class Key:
    """A sort key; nulls come first when ascending and last when descending, so flipping it turns the order round."""

    column: Column
    descending: bool = False

    def sorted(self) -> Column:
        return self.column.desc_nulls_last() if self.descending else self.column.asc_nulls_first()

    def flipped(self) -> Key:
        return Key(self.column, not self.descending)


#: Holds the places of rows that were put before or after all others; not among the columns that frame() shows.
_SIDE = "_side"


@dataclass(frozen=True)
class Relation:
    df: DataFrame
    key: tuple[str, ...] = ()
    order: tuple[Key, ...] = ()

    # filters and projections
    def where(self, predicate: Column) -> Relation:
        return replace(self, df=self.df.where(decided(predicate)))

    def where_rows(self, predicate: Callable[[dict], bool], *columns: str) -> Relation:
        """Rows that a Python function accepts, for what no expression can say; it sees `columns`, or all. Goes by Arrow batches."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                seen = batch.select(list(columns)) if columns else batch
                yield batch.filter(pa.array([bool(predicate(r)) for r in seen.to_pylist()], pa.bool_()))

        return replace(self, df=self.df.mapInArrow(run, self.df.schema))

    def select(self, *columns: str | Column) -> Relation:
        """Rows of an ordered relation are ordered before columns go."""
        return Relation(self.frame().select(*map(column, columns)))

    def of_type(self, c: str, kind: str) -> Relation:
        """Rows whose value can be had as another type, with that type."""
        return replace(self, df=self.df.withColumn(c, F.col(c).try_cast(kind)).where(F.col(c).isNotNull()))

    def cast(self, c: str, kind: str) -> Relation:
        return replace(self, df=self.df.withColumn(c, F.col(c).cast(kind)))

    def select_many(self, array: str | Column, name: str) -> Relation:
        return Relation(self.df.withColumn(name, F.explode(column(array))))

    def select_many_cross(self, other: Relation, on: Column) -> Relation:
        """Rows of other that go with each row, by a condition; a condition on equal columns makes this an equi-join."""
        return Relation(self.df.join(other.df, on, "inner"))

    # joins
    def join(self, other: Relation, on: str | list[str] | Column) -> Relation:
        return Relation(self.df.join(other.df, on, "inner"))

    def group_join(self, other: Relation, on: Sequence[str], name: str, order: Sequence[str | Column]) -> Relation:
        """Each row with the array of its partners, empty if there are none. Partners are gathered before the join."""
        rest = [c for c in other.df.columns if c not in on]
        gathered = other.df.groupBy(*on).agg(F.array_sort(F.collect_list(F.struct(*map(column, order), F.struct(*rest).alias("own")))).alias("all"))
        gathered = gathered.withColumn(name, F.transform("all", lambda x: x["own"])).drop("all")
        kind = dict(gathered.dtypes)[name]
        return Relation(self.df.join(gathered, list(on), "left").withColumn(name, F.coalesce(name, F.array().cast(kind))))

    def semi(self, other: Relation, on: str | list[str] | Column) -> Relation:
        return replace(self, df=self.df.join(other.df, on, "left_semi"))

    def anti(self, other: Relation, on: str | list[str] | Column) -> Relation:
        return replace(self, df=self.df.join(other.df, on, "left_anti"))

    def left_join(self, other: Relation, on: str | list[str] | Column) -> Relation:
        return Relation(self.df.join(other.df, on, "left"))

    # grouping
    def group_by(self, *keys: str | Column) -> Grouped:
        return Grouped(self.df, tuple(map(column, keys)))

    # order and position
    def order_by(self, c: str | Column) -> Relation:
        return replace(self, order=(Key(column(c)),))

    def order_by_descending(self, c: str | Column) -> Relation:
        return replace(self, order=(Key(column(c), True),))

    def then_by(self, c: str | Column) -> Relation:
        return replace(self, order=(*self.order, Key(column(c))))

    def then_by_descending(self, c: str | Column) -> Relation:
        return replace(self, order=(*self.order, Key(column(c), True)))

    def _keys(self) -> tuple[Key, ...]:
        return (*self.order, *(Key(F.col(k)) for k in self.key))

    def _total(self) -> list[Column]:
        return [k.sorted() for k in self._keys()]

    def _flipped(self) -> Relation:
        if not self._keys():
            raise ValueError("positions need an order or a key")
        return replace(self, order=tuple(k.flipped() for k in self._keys()))

    def frame(self) -> DataFrame:
        return (self.df.orderBy(*self._total()) if self.order else self.df).drop(_SIDE)

    def _ordered(self) -> DataFrame:
        return self.df.orderBy(*self._total()) if self.order else self.df

    def take(self, n: int) -> Relation:
        """Sorted, this is a top-n: each task keeps n rows."""
        return replace(self, df=self._ordered().limit(n))

    def skip(self, n: int) -> Relation:
        """With take() after it a top-n; alone, all rows pass one task."""
        return replace(self, df=self._ordered().offset(n))

    def numbered(self, name: str = "position") -> DataFrame:
        """Rows with their place in the order, from 0.

        Rows are dealt by ranges of the order and counted per range; a range's own rows are numbered inside it. Only the
        counts, one a partition, are summed in one place. The ranges come from a sample, so the dealt rows are written
        first: dealt twice, they could fall differently.
        """
        if not self._total():
            raise ValueError("positions need an order or a key")
        dealt = self.df.repartitionByRange(*self._total()).sortWithinPartitions(*self._total())
        marked = kept(dealt.withColumn("_at", F.monotonically_increasing_id()), "numbered")  # partition number << 33 | row in partition
        marked = marked.withColumns({"_part": F.shiftright("_at", 33), "_row": F.col("_at").bitwiseAND((1 << 33) - 1)}).drop("_at")
        counts = marked.groupBy("_part").agg(F.count("*").alias("_n"))
        before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")).alias("_before"))
        return marked.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_row")).drop("_part", "_row", "_before")

    def reverse(self) -> Relation:
        """The opposite order."""
        return self._flipped()

    def take_last(self, n: int) -> Relation:
        """The first n of the opposite order: each task keeps n rows."""
        return replace(self, df=self._flipped().take(n).df)

    def skip_last(self, n: int) -> Relation:
        """All but the last n; a key tells those by a join with n rows, without one all rows are numbered."""
        if not self.key:
            total = self.df.count()
            return replace(self, df=self.numbered("_place").where(F.col("_place") < total - n).drop("_place"))
        last = self.take_last(n).df.select(*(F.col(k).alias(f"_last{i}") for i, k in enumerate(self.key)))
        same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_last{i}")) for i, k in enumerate(self.key)))
        return replace(self, df=self.df.join(last, same, "left_anti"))

    def _first_miss(self, predicate: Column) -> DataFrame:
        numbered = self.numbered("_place")
        miss = numbered.where(~decided(predicate)).agg(F.min("_place").alias("_miss"))
        return numbered.join(F.broadcast(miss))  # one row

    def take_while(self, predicate: Column) -> Relation:
        return replace(self, df=self._first_miss(predicate).where(F.col("_miss").isNull() | (F.col("_place") < F.col("_miss"))).drop("_place", "_miss"))

    def skip_while(self, predicate: Column) -> Relation:
        return replace(self, df=self._first_miss(predicate).where(F.col("_place") >= F.col("_miss")).drop("_place", "_miss"))

    def chunk(self, size: int) -> DataFrame:
        """chunk (number from 0) and rows (array of structs, in order)."""
        rows = self.numbered("_place").withColumn("chunk", F.floor(F.col("_place") / size))
        packed = F.array_sort(F.collect_list(F.struct("_place", F.struct(*self.df.columns).alias("row"))))
        return rows.groupBy("chunk").agg(F.transform(packed, lambda x: x["row"]).alias("rows"))

    def zip(self, other: Relation) -> DataFrame:
        """Rows at the same place side by side, as far as the shorter goes."""
        left = self.numbered("_place").select("_place", F.struct(*self.df.columns).alias("first"))
        right = other.numbered("_place").select("_place", F.struct(*other.df.columns).alias("second"))
        return left.join(right, "_place").drop("_place")

    def _put(self, rows: tuple[tuple, ...], side: int) -> Relation:
        own = self.df if _SIDE in self.df.columns else self.df.withColumn(_SIDE, F.lit(0))
        plain = [f for f in own.schema.fields if f.name != _SIDE]
        edge = own.agg((F.min if side < 0 else F.max)(_SIDE)).first()[0] or 0
        more = self.df.sparkSession.createDataFrame(list(rows), T.StructType(plain))
        order = self.order if any(_SIDE in repr(k.column) for k in self.order) else (Key(F.col(_SIDE)), *self.order)
        return Relation(own.unionByName(more.withColumn(_SIDE, F.lit(edge + side))), self.key, order)

    def append(self, *rows: tuple) -> Relation:
        """With rows after all others; those given together are in the order of the key."""
        return self._put(rows, 1)

    def prepend(self, *rows: tuple) -> Relation:
        """With rows before all others."""
        return self._put(rows, -1)

    def default_if_empty(self, row: tuple) -> Relation:
        spare = self.df.sparkSession.createDataFrame([row], self.df.schema)
        some = self.df.limit(1).select(F.lit(1).alias("_some"))
        return Relation(self.df.unionByName(spare.join(some, how="left_anti")))

    # set operations
    def distinct(self) -> Relation:
        return replace(self, df=self.df.distinct())

    def distinct_by(self, *keys: str) -> Relation:
        """Of each key the first row in the order; the choice is an aggregate, so hot keys shrink before the shuffle."""
        if not self._total():
            return replace(self, df=self.df.dropDuplicates(list(keys)))
        window = Window.partitionBy(*keys).orderBy(*self._total())
        return replace(self, df=self.df.withColumn("_nth", F.row_number().over(window)).where("_nth = 1").drop("_nth"))

    def concat(self, other: Relation) -> Relation:
        return Relation(self.df.unionByName(other.df), self.key)

    def union(self, other: Relation) -> Relation:
        return Relation(self.df.unionByName(other.df).distinct(), self.key)

    def intersect(self, other: Relation) -> Relation:
        return Relation(self.df.intersect(other.df), self.key)

    def except_(self, other: Relation) -> Relation:
        return Relation(self.df.subtract(other.df), self.key)

    def sequence_equal(self, other: Relation) -> bool:
        left, right = self.numbered("_place"), other.numbered("_place")
        return left.columns == right.columns and left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()

    # terminals
    def to_list(self) -> list[Row]:
        return self.frame().collect()

    def iterate(self) -> Iterator[Row]:
        return self.frame().toLocalIterator()

    def for_each(self, action: Callable[[Row], Any]) -> None:
        for row in self.iterate():
            action(row)

    def first_or_none(self, predicate: Column | None = None) -> Row | None:
        own = self if predicate is None else self.where(predicate)
        return next(iter(own.take(1).frame().collect()), None)

    def first(self, predicate: Column | None = None) -> Row:
        row = self.first_or_none(predicate)
        if row is None:
            raise LookupError("the sequence is empty")
        return row

    def last_or_none(self, predicate: Column | None = None) -> Row | None:
        own = self if predicate is None else self.where(predicate)
        return next(iter(own.take_last(1).frame().collect()), None)

    def single_or_none(self, predicate: Column | None = None) -> Row | None:
        rows = (self if predicate is None else self.where(predicate)).df.drop(_SIDE).limit(2).collect()
        if len(rows) > 1:
            raise LookupError("the sequence has more than one row")
        return rows[0] if rows else None

    def single(self, predicate: Column | None = None) -> Row:
        row = self.single_or_none(predicate)
        if row is None:
            raise LookupError("the sequence is empty")
        return row

    def element_at(self, n: int) -> Row:
        rows = self.skip(n).df.limit(1).drop(_SIDE).collect() if n >= 0 else []
        if not rows:
            raise LookupError(f"no row at {n}")
        return rows[0]

    def count(self, predicate: Column | None = None) -> int:
        return (self if predicate is None else self.where(predicate)).df.count()

    def any(self, predicate: Column | None = None) -> bool:
        return not (self if predicate is None else self.where(predicate)).df.isEmpty()

    def all(self, predicate: Column) -> bool:
        """True of no rows."""
        return self.df.where(~decided(predicate)).isEmpty()

    def aggregate(self, *aggregates: Column, empty_as_zero: bool = False) -> DataFrame:
        out = self.df.agg(*aggregates)
        return out.select(*(F.coalesce(F.col(c), F.lit(0)).alias(c) for c in out.columns)) if empty_as_zero else out

    def fold(self, value: Column, order: Sequence[str | Column], seed: Any, step: Callable[[Column, Column], Column]) -> DataFrame:
        """One row: `step` over all values in order. Sequential by nature, so only for what fits one task; fold groups instead."""
        return Grouped(self.df, ()).fold(value, order, seed, step)

    def min_by(self, c: str | Column) -> DataFrame:
        return self.df.agg(F.min_by(F.struct(*self.df.columns), F.struct(column(c), *self.key)).alias("row")).select("row.*")

    def max_by(self, c: str | Column) -> DataFrame:
        return self.df.agg(F.max_by(F.struct(*self.df.columns), F.struct(column(c), *self.key)).alias("row")).select("row.*")


@dataclass(frozen=True)
class Grouped:
    df: DataFrame
    keys: tuple[Column, ...]

    def select(self, *aggregates: Column) -> Relation:
        return Relation(self.df.groupBy(*self.keys).agg(*aggregates))

    def having(self, predicate: Column, *aggregates: Column) -> Relation:
        """Groups by a condition on their aggregates."""
        return Relation(self.df.groupBy(*self.keys).agg(*aggregates).where(predicate))

    def collect(self, name: str, order: Sequence[str | Column], *columns: str) -> Relation:
        """Groups with the array of their rows. A group is one value, so it has to fit a task."""
        own = columns or tuple(self.df.columns)
        packed = F.array_sort(F.collect_list(F.struct(*map(column, order), F.struct(*own).alias("own"))))
        return Relation(self.df.groupBy(*self.keys).agg(F.transform(packed, lambda x: x["own"]).alias(name)))

    def fold(self, value: Column, order: Sequence[str | Column], seed: Any, step: Callable[[Column, Column], Column], name: str = "value") -> DataFrame:
        packed = F.array_sort(F.collect_list(F.struct(*map(column, order), value.alias("_value"))))
        return self.df.groupBy(*self.keys).agg(packed.alias("_all")).withColumn(name, F.aggregate("_all", seed if isinstance(seed, Column) else F.lit(seed), lambda total, x: step(total, x["_value"]))).drop("_all")
