"""The filter language's query builder: filter, sort, skip, take, project, terminals. Everything stays lazy until a terminal."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from quillstone.functions.vectors import distance
from quillstone.plans import filters as f
from quillstone.plans.schemaless import Schemaless, sort_key
from quillstone.plans.typed import Typed, nearest


@dataclass(frozen=True)
class Sort:
    """An order that is made apart from a query."""

    keys: tuple[tuple[str, bool], ...]

    @classmethod
    def by(cls, name: str, descending: bool = False) -> Sort:
        return cls(((name, not descending),))

    def then_by(self, name: str, descending: bool = False) -> Sort:
        return Sort((*self.keys, (name, not descending)))


@dataclass(frozen=True)
class DocQuery:
    """A query on `df`. key: column that identifies a row; it breaks ties and every projection keeps it.

    variant: name of a VARIANT column that holds the documents; without it the columns are the fields.
    """

    df: DataFrame
    key: str
    variant: str | None = None
    node: f.Node = f.Everything()
    order: tuple[tuple[str, bool], ...] = ()
    skipped: int = 0
    taken: int | None = None
    include: tuple[str, ...] | None = None
    exclude: tuple[str, ...] = ()

    def filter(self, source: f.Node | str | dict) -> DocQuery:
        """Replaces the filter."""
        return replace(self, node=source if isinstance(source, f.Node) else f.parse(source))

    def and_(self, source: f.Node | str | dict) -> DocQuery:
        return replace(self, node=self.node & (source if isinstance(source, f.Node) else f.parse(source)))

    def or_(self, source: f.Node | str | dict) -> DocQuery:
        return replace(self, node=self.node | (source if isinstance(source, f.Node) else f.parse(source)))

    def sort(self, source: str | dict | list[tuple[str, bool]] | Sort) -> DocQuery:
        """Replaces the order; {"a": 1, "b": -1}, or Sort.by("a").then_by("b", descending=True)."""
        return replace(self, order=source.keys if isinstance(source, Sort) else tuple(source if isinstance(source, list) else f.parse_sort(source)))

    def order_by(self, name: str) -> DocQuery:
        return replace(self, order=((name, True),))

    def order_by_descending(self, name: str) -> DocQuery:
        return replace(self, order=((name, False),))

    def then_by(self, name: str, ascending: bool = True) -> DocQuery:
        return replace(self, order=(*self.order, (name, ascending)))

    def skip(self, n: int) -> DocQuery:
        if n < 0:
            raise ValueError("skip takes 0 or more")
        return replace(self, skipped=n)

    def take(self, n: int) -> DocQuery:
        if n < 0:
            raise ValueError("take takes 0 or more")
        return replace(self, taken=n)

    limit = take

    def project(self, *names: str) -> DocQuery:
        """Keeps the key and those of the fields that exist."""
        return replace(self, include=names, exclude=())

    def without(self, *names: str) -> DocQuery:
        return replace(self, exclude=names, include=None)

    def matching(self) -> DataFrame:
        nearest(self.node)  # fails where the clause has no meaning
        compiler = Schemaless(F.col(self.variant)) if self.variant else Typed(self.df.schema)
        return self.df.where(compiler.compile(self.node))

    def _field(self, name: str) -> Column:
        if self.variant:
            return sort_key(F.col(self.variant), name)
        own = Typed(self.df.schema).field(name)
        return own[0] if own else F.lit(None)

    def frame(self) -> DataFrame:
        """The result; sorted nulls first when ascending, last when descending, ties by key."""
        rows = self.matching()
        near = nearest(self.node)
        if near is not None:
            vector = F.try_variant_get(F.col(self.variant), f"$['{near.field}']", "array<double>") if self.variant else self._field(near.field)
            rows = rows.orderBy(distance(vector, near.vector, near.metric), self.key).limit(near.k)
        if self.order:
            keys = [self._field(n).asc_nulls_first() if up else self._field(n).desc_nulls_last() for n, up in self.order]
            rows = rows.orderBy(*keys, self.key)
        if self.skipped:
            rows = rows.offset(self.skipped)
        if self.taken is not None:
            rows = rows.limit(self.taken)
        if self.include is not None:
            have = {c.lower(): c for c in rows.columns}
            names = [self.key, *(have[n.lower()] for n in self.include if n.lower() in have and n.lower() != self.key.lower())]
            rows = rows.select(*dict.fromkeys(names))
        return rows.drop(*(n for n in self.exclude)) if self.exclude else rows

    # terminals
    def to_list(self) -> list[Row]:
        return self.frame().collect()

    def stream(self) -> Iterator[Row]:
        return self.frame().toLocalIterator()

    def count(self) -> int:
        """Of all matches, whatever skip and take say."""
        return self.matching().count()

    def any(self) -> bool:
        return not self.matching().isEmpty()

    def none(self) -> bool:
        return self.matching().isEmpty()

    def first_or_none(self) -> Row | None:
        """Honours sort and skip."""
        return next(iter(replace(self, taken=1).to_list()), None)

    def first(self) -> Row:
        row = self.first_or_none()
        if row is None:
            raise LookupError("no document matches")
        return row


def compare(name: str, op: str, value: Any) -> f.Node:
    return f.Compare(name, op, value)
