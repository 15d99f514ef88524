"""How rows of an indexed collection are reached: plans that filters give, and cursors.

A plan says which index narrows a filter down, and to what; the narrowed condition is put before the whole filter, so that
files are pruned by it. Catalyst would find the same conditions; a plan shows and keeps them.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from quillstone.plans import filters as f
from quillstone.plans.typed import where


@dataclass(frozen=True)
class IndexPlan:
    """kind: "range" (low to high, either may be None), "in" (values) or "scan"; column: of the index; residue: the whole filter."""

    kind: str
    residue: f.Node
    column: str | None = None
    low: Any = None
    high: Any = None
    values: tuple = ()

    def condition(self) -> Column | None:
        if self.kind == "in":
            return F.col(self.column).isin(*self.values)
        if self.kind == "range":
            bounds = [F.col(self.column) >= F.lit(self.low)] * (self.low is not None) + [F.col(self.column) <= F.lit(self.high)] * (self.high is not None)
            return reduce(lambda a, b: a & b, bounds)
        return None

    def rows(self, df: DataFrame) -> DataFrame:
        own = self.condition()
        return where(df if own is None else df.where(own), self.residue)


def plan_of(node: f.Node, columns: set[str]) -> IndexPlan:
    """The best plan of a filter: equal or listed values, else a range with both ends, else with one, else a scan."""
    found = [p for c in sorted(columns) if (p := _narrowed(node, c)) is not None]
    worth = {"in": lambda p: 3, "range": lambda p: 1 + (p[2] is not None and p[3] is not None)}
    best = max(found, key=lambda p: worth[p[0]](p), default=None)
    return IndexPlan("scan", node) if best is None else IndexPlan(best[0], node, *best[1:])


def _narrowed(node: f.Node, column: str) -> tuple | None:
    """(kind, column, low, high, values) that all rows of a filter satisfy, or None."""
    if isinstance(node, f.Compare) and node.field == column and node.value is not None and not isinstance(node.value, (list, dict)):
        if node.op == "eq":
            return "in", column, None, None, (node.value,)
        if node.op in ("gt", "gte"):
            return "range", column, node.value, None, ()
        if node.op in ("lt", "lte"):
            return "range", column, None, node.value, ()
    if isinstance(node, f.In) and node.field == column and not node.negated and None not in node.values:
        return "in", column, None, None, tuple(dict.fromkeys(node.values))
    if isinstance(node, f.And):
        own = [p for x in node.parts if (p := _narrowed(x, column)) is not None]
        listed = [p for p in own if p[0] == "in"]
        if listed:
            return min(listed, key=lambda p: len(p[4]))
        if own:
            return "range", column, max((p[2] for p in own if p[2] is not None), default=None), min((p[3] for p in own if p[3] is not None), default=None), ()
    if isinstance(node, f.Or) and node.parts:  # point look-ups of one index are one look-up of all their values
        own = [_narrowed(x, column) for x in node.parts]
        if all(p is not None and p[0] == "in" for p in own):
            return "in", column, None, None, tuple(dict.fromkeys(v for p in own for v in p[4]))
    return None


class Cursor:
    """Moves over rows in the order of a column, ties by key. Rows come in pages, each a top-n from the place reached; null columns aren't reached."""

    def __init__(self, df: DataFrame, column: str, key: str, page: int = 100):
        self.df, self.column, self.key, self.size = df.where(F.col(column).isNotNull()), column, key, page
        self.page: list[Row] = []
        self.at = 0
        self.down = False

    def current(self) -> Row | None:
        return self.page[self.at] if self.at < len(self.page) else None

    def _load(self, start: Column | None, down: bool) -> Row | None:
        rows = self.df if start is None else self.df.where(start)
        order = [F.col(c).desc() if down else F.col(c).asc() for c in (self.column, self.key)]
        self.page, self.at, self.down = rows.orderBy(*order).limit(self.size).collect(), 0, down
        return self.current()

    def first(self) -> Row | None:
        return self._load(None, False)

    def last(self) -> Row | None:
        return self._load(None, True)

    def seek(self, value: Any) -> Row | None:
        """The first row whose value isn't less."""
        return self._load(F.col(self.column) >= F.lit(value), False)

    def _move(self, down: bool) -> Row | None:
        here = self.current()
        if here is None:
            return None
        step = 1 if down == self.down else -1
        if 0 <= self.at + step < len(self.page):
            self.at += step
            return self.current()
        value, key = F.lit(here[self.column]), F.lit(here[self.key])
        c, k = F.col(self.column), F.col(self.key)
        return self._load((c < value) | (c == value) & (k < key) if down else (c > value) | (c == value) & (k > key), down)

    def next(self) -> Row | None:
        return self._move(False)

    def previous(self) -> Row | None:
        return self._move(True)
