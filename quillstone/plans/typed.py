"""Filters over typed columns, compiled to Column expressions that Catalyst can push into the scan.

Typed columns can't tell an absent field from a null one; null is taken as absent. So comparisons with null are false,
except $ne and $nin, which are true; negation works on these two-valued results. Values of different kinds compare by
the order of kinds: null, boolean, number, string, timestamp, binary, document, array. A field without a column is absent.
"""

from __future__ import annotations

import datetime as dt
import decimal
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.functions.geo import haversine_km, lat_of, lon_of, within_box
from quillstone.plans import filters as f

KINDS = ("null", "boolean", "number", "string", "id", "timestamp", "binary", "document", "array")
# Type codes of the document format.
CODES = {1: "double", 2: "string", 3: "document", 4: "array", 5: "binary", 7: "id", 8: "boolean", 9: "timestamp", 10: "null", 16: "int", 18: "long", 19: "decimal"}


def kind_of_type(t: T.DataType) -> str:
    if isinstance(t, T.BooleanType):
        return "boolean"
    if isinstance(t, T.NumericType):
        return "number"
    if isinstance(t, (T.StringType, T.CharType, T.VarcharType)):
        return "string"
    if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "timestamp"
    if isinstance(t, T.BinaryType):
        return "binary"
    if isinstance(t, (T.StructType, T.MapType)):
        return "document"
    return "array" if isinstance(t, T.ArrayType) else "null"


def kind_of_value(v: Any) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, (int, float, decimal.Decimal)):
        return "number"
    if isinstance(v, str):
        return "string"
    if isinstance(v, (dt.datetime, dt.date)):
        return "timestamp"
    if isinstance(v, (bytes, bytearray)):
        return "binary"
    return "document" if isinstance(v, dict) else "array"


def code_matches(code: int, t: T.DataType) -> bool:
    name = CODES.get(code)
    return name == {T.DoubleType: "double", T.FloatType: "double", T.IntegerType: "int", T.ShortType: "int", T.ByteType: "int", T.LongType: "long", T.DecimalType: "decimal"}.get(type(t), kind_of_type(t))


class Typed:
    """Compiles filters against the columns of a schema; `column` gives the Column of a field."""

    def __init__(self, schema: T.StructType, column=None):
        self.types = {x.name.lower(): x for x in schema.fields}
        self.column = column or (lambda name: F.col(f"`{name.replace('`', '``')}`"))

    def field(self, name: str) -> tuple[Column, T.DataType] | None:
        own = self.types.get(name.lower())
        return own and (self.column(own.name), own.dataType)

    def compile(self, node: f.Node) -> Column:
        return getattr(self, "_" + type(node).__name__.lower())(node)

    def _everything(self, node: f.Everything) -> Column:
        return F.lit(True)

    def _and(self, node: f.And) -> Column:
        return reduce(lambda a, b: a & b, map(self.compile, node.parts)) if node.parts else F.lit(True)

    def _or(self, node: f.Or) -> Column:
        return reduce(lambda a, b: a | b, map(self.compile, node.parts)) if node.parts else F.lit(False)

    def _not(self, node: f.Not) -> Column:
        return ~self.two_valued(node.part)

    def two_valued(self, node: f.Node) -> Column:
        """A column that is never null, which negation needs; elsewhere null counts as false without it."""
        return F.coalesce(self.compile(node), F.lit(False))

    def _compare(self, node: f.Compare) -> Column:
        return self.compare(self.field(node.field), node.op, node.value)

    def compare(self, own: tuple[Column, T.DataType] | None, op: str, value: Any) -> Column:
        if own is None:
            return F.lit(op == "ne")
        column, kind = own[0], kind_of_type(own[1])
        other = kind_of_value(value)
        if kind != other:
            low = KINDS.index(kind) < KINDS.index(other)
            if {"eq": False, "ne": True, "gt": not low, "gte": not low, "lt": low, "lte": low}[op]:
                return F.lit(True) if op == "ne" else column.isNotNull()
            return F.lit(False)
        if kind in ("array", "document"):
            text, wanted = F.to_json(column), F.to_json(F.from_json(F.lit(_json(value)), own[1]))
            if op not in ("eq", "ne"):
                raise f.FilterError("documents and arrays can only be compared by $eq and $ne")
            return text == wanted if op == "eq" else F.coalesce(text != wanted, F.lit(True))
        v = F.lit(value)
        if op == "ne":
            return F.coalesce(column != v, F.lit(True))
        return {"eq": column == v, "gt": column > v, "gte": column >= v, "lt": column < v, "lte": column <= v}[op]

    def _in(self, node: f.In) -> Column:
        own = self.field(node.field)
        if own is None:
            return F.lit(node.negated)
        same = [v for v in node.values if kind_of_value(v) == kind_of_type(own[1])]
        found = own[0].isin(*same) if same else F.lit(False)
        return F.coalesce(~found, F.lit(True)) if node.negated else found

    def _exists(self, node: f.Exists) -> Column:
        own = self.field(node.field)
        if own is None:
            return F.lit(not node.present)
        return own[0].isNotNull() if node.present else own[0].isNull()

    def _hastype(self, node: f.HasType) -> Column:
        own = self.field(node.field)
        return own[0].isNotNull() if own and code_matches(node.code, own[1]) else F.lit(False)

    def _string(self, name: str, test) -> Column:
        own = self.field(name)
        return test(own[0]) if own and kind_of_type(own[1]) == "string" else F.lit(False)

    def _regex(self, node: f.Regex) -> Column:
        return self._string(node.field, lambda c: c.rlike(node.pattern))

    def _text(self, node: f.Text) -> Column:
        return self._string(node.field, lambda c: getattr(F, node.op)(c, F.lit(node.value)))

    def _array(self, name: str) -> tuple[Column, T.DataType] | None:
        own = self.field(name)
        return (own[0], own[1].elementType) if own and isinstance(own[1], T.ArrayType) else None

    def _elemmatch(self, node: f.ElemMatch) -> Column:
        own = self._array(node.field)
        if own is None:
            return F.lit(False)
        array, element = own

        def test(x: Column) -> Column:
            if node.scalar:
                inner = Typed(T.StructType([T.StructField("", element)]), lambda _: x)
            elif isinstance(element, T.StructType):
                inner = Typed(element, lambda name: x.getField(name))
            else:
                return F.lit(False)
            return inner.two_valued(node.condition)

        return F.coalesce(F.exists(array, test), F.lit(False))

    def _size(self, node: f.Size) -> Column:
        own = self._array(node.field)
        return F.coalesce(own[0].isNotNull() & (F.size(own[0]) == node.size), F.lit(False)) if own else F.lit(False)

    def _all(self, node: f.All) -> Column:
        own = self._array(node.field)
        if own is None:
            return F.lit(False)

        def has(v: Any) -> Column:
            return F.exists(own[0], lambda x: F.coalesce(self.compare((x, own[1]), "eq", v), F.lit(False)))

        return F.coalesce(reduce(lambda a, b: a & b, map(has, node.values), own[0].isNotNull()), F.lit(False))

    def _mod(self, node: f.Mod) -> Column:
        own = self.field(node.field)
        if own is None or kind_of_type(own[1]) != "number":
            return F.lit(False)
        return own[0].try_cast("long") % node.divisor == node.remainder

    def _geowithin(self, node: f.GeoWithin) -> Column:
        own = self.field(node.field)
        return F.coalesce(within_box(own[0], own[1], node.low, node.high), F.lit(False)) if own else F.lit(False)

    def _geonear(self, node: f.GeoNear) -> Column:
        own = self.field(node.field)
        if own is None:
            return F.lit(False)
        return F.coalesce(haversine_km(lat_of(*own), lon_of(*own), F.lit(node.center[0]), F.lit(node.center[1])) <= node.km, F.lit(False))

    def _nearvector(self, node: f.NearVector) -> Column:
        """The condition itself; the query takes the nearest of what matches, so it must stand beside the others (`nearest`)."""
        own = self.field(node.field)
        return own[0].isNotNull() if own else F.lit(False)


def _json(value: Any) -> str:
    import json

    return json.dumps(value, ensure_ascii=False)


def where(df: DataFrame, node: f.Node | str | dict) -> DataFrame:
    """Rows of df that a filter matches."""
    return df.where(Typed(df.schema).compile(node if isinstance(node, f.Node) else f.parse(node)))


def nearest(node: f.Node) -> f.NearVector | None:
    """The nearest-neighbour clause that stands at the top of a filter, alone or in an AND; elsewhere it has no meaning."""
    parts = node.parts if isinstance(node, f.And) else (node,)
    here = [p for p in parts if isinstance(p, f.NearVector)]
    inner = [nearest(p) for p in parts if isinstance(p, f.And) and p is not node]
    if any(_holds(p) for p in parts if isinstance(p, (f.Or, f.Not))) or len(here) + sum(x is not None for x in inner) > 1:
        raise f.FilterError("$nearVector stands once, alone or beside other conditions")
    return next(iter([*here, *(x for x in inner if x is not None)]), None)


def _holds(node: f.Node) -> bool:
    if isinstance(node, f.NearVector):
        return True
    return any(map(_holds, node.parts)) if isinstance(node, (f.And, f.Or)) else _holds(node.part) if isinstance(node, f.Not) else False
