"""Predicates for typed queries: plain SQL comparisons in which null is false, `not equal` included."""

from __future__ import annotations

import datetime as dt
import enum
import uuid
from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: How values of a type are kept in columns; more by converts().
CONVERTERS: dict[type, Callable[[Any], Any]] = {}
TICK_US = 10  # ticks of 100 ns a microsecond


def converts(kind: type, to: Callable[[Any], Any]) -> None:
    """Registers how values of a class are kept, so that predicates take the class itself."""
    CONVERTERS[kind] = to


def kept_as(v: Any) -> Any:
    """The value as columns hold it: enums by their number, times of day and spans as ticks, ids as text, others as registered."""
    if isinstance(v, Column) or v is None:
        return v
    for kind, to in CONVERTERS.items():
        if isinstance(v, kind):
            return to(v)
    if isinstance(v, enum.Enum):
        return v.value
    if isinstance(v, dt.time):
        return ((v.hour * 60 + v.minute) * 60 + v.second) * 1_000_000 * TICK_US + v.microsecond * TICK_US
    if isinstance(v, dt.timedelta):
        return v // dt.timedelta(microseconds=1) * TICK_US
    return str(v) if isinstance(v, uuid.UUID) else v


def decided(predicate: Column) -> Column:
    return F.coalesce(predicate, F.lit(False))


class Field:
    """field("a.b.c") gives predicates on a column or a nested path."""

    def __init__(self, path: str | Column):
        self.col = path if isinstance(path, Column) else F.col(path)

    def eq(self, v: Any) -> Column:
        return self.is_null() if v is None else decided(self.col == kept_as(v))

    def ne(self, v: Any) -> Column:
        return self.not_null() if v is None else decided(self.col != kept_as(v))

    def gt(self, v: Any) -> Column:
        return decided(self.col > kept_as(v))

    def ge(self, v: Any) -> Column:
        return decided(self.col >= kept_as(v))

    def lt(self, v: Any) -> Column:
        return decided(self.col < kept_as(v))

    def le(self, v: Any) -> Column:
        return decided(self.col <= kept_as(v))

    def compare_to(self, v: Any) -> Column:
        """-1, 0 or 1, null of null: to be compared with 0."""
        other = kept_as(v)
        return F.when(self.col < other, -1).when(self.col > other, 1).when(self.col == other, 0)

    def between(self, low: Any, high: Any) -> Column:
        return decided(self.col.between(kept_as(low), kept_as(high)))

    def one_of(self, values: Iterable[Any]) -> Column:
        """A null among the values matches null fields."""
        listed = [kept_as(v) for v in values]
        known = [v for v in listed if v is not None]
        found = decided(self.col.isin(*known)) if known else F.lit(False)
        return found | self.col.isNull() if len(known) < len(listed) else found

    def contains(self, v: str) -> Column:
        return decided(F.contains(self.col, F.lit(v)))

    def startswith(self, v: str) -> Column:
        return decided(F.startswith(self.col, F.lit(v)))

    def endswith(self, v: str) -> Column:
        return decided(F.endswith(self.col, F.lit(v)))

    def like(self, pattern: str) -> Column:
        from quillstone.functions.text import like

        return decided(like(self.col, pattern))

    def matches(self, pattern: str) -> Column:
        return decided(self.col.rlike(pattern))

    def is_null(self) -> Column:
        return self.col.isNull()

    def not_null(self) -> Column:
        return self.col.isNotNull()

    has_value = not_null

    def is_true(self) -> Column:
        return decided(self.col)

    def null_or_empty(self) -> Column:
        return self.col.isNull() | (self.col == "")

    def null_or_blank(self) -> Column:
        return self.col.isNull() | (F.regexp_replace(self.col, r"^[\s\p{Z}]+$", "") == "")


def field(path: str | Column) -> Field:
    return Field(path)


def negate(predicate: Column) -> Column:
    """Two-valued: what isn't true is."""
    return ~decided(predicate)


class Fields:
    """Fields(df).name is field("name"), for the columns that df has; names compare without case."""

    def __init__(self, df: DataFrame):
        self._columns = {c.lower(): c for c in df.columns}

    def __getattr__(self, name: str) -> Field:
        own = self.__dict__.get("_columns", {}).get(name.lower())
        if own is None:
            raise AttributeError(f"no column {name}")
        return Field(F.col(f"`{own}`"))
