"""Filters and sort keys over schema-less documents in a VARIANT column.

A variant tells an absent field from a null one: absent fields fail every comparison but $ne and $nin, while null is a
value that equals null and is less than all else. Values of different kinds compare by kind. Numbers compare as doubles.
Variants can't be ordered or grouped themselves, so sort_key() gives an orderable struct.
"""

from __future__ import annotations

import datetime as dt
import json
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstone.functions.geo import haversine_km
from quillstone.plans import filters as f
from quillstone.plans.typed import CODES, KINDS, kind_of_value


def path_of(name: str) -> str:
    quoted = name.replace("\\", "\\\\").replace("'", "\\'")
    return f"$['{quoted}']"


def part(doc: Column, name: str) -> Column:
    """The field as a variant; SQL null where absent."""
    return F.try_variant_get(doc, path_of(name), "variant")


def type_name(v: Column) -> Column:
    return F.schema_of_variant(v)


def kind(v: Column) -> Column:
    """Place of the value's kind in KINDS; SQL null where absent. The name of the type is made once for each value."""

    def of(name: Column) -> Column:
        return (
            F.when(name == "VOID", KINDS.index("null"))
            .when(name == "BOOLEAN", KINDS.index("boolean"))
            .when(name.isin("BIGINT", "DOUBLE", "FLOAT") | F.startswith(name, F.lit("DECIMAL")), KINDS.index("number"))
            .when(name == "STRING", KINDS.index("string"))
            .when(name.isin("TIMESTAMP", "TIMESTAMP_NTZ", "DATE"), KINDS.index("timestamp"))
            .when(name == "BINARY", KINDS.index("binary"))
            .when(F.startswith(name, F.lit("OBJECT")), KINDS.index("document"))
            .otherwise(KINDS.index("array"))
        )

    return F.when(v.isNotNull(), F.transform(F.array(type_name(v)), of)[0])


def as_type(v: Column, t: str) -> Column:
    return F.try_variant_get(v, "$", t)


def sort_key(doc: Column, name: str) -> Column:
    """Orders like the values do: null and absent first, then by kind, then by value."""
    v = part(doc, name)
    k = F.coalesce(kind(v), F.lit(KINDS.index("null")))
    number = F.when(k == KINDS.index("boolean"), as_type(v, "boolean").cast("double")).when(k == KINDS.index("number"), as_type(v, "double"))
    return F.struct(k.alias("kind"), F.when(F.isnan(number), None).otherwise(number).alias("number"), F.when(k == KINDS.index("string"), as_type(v, "string")).alias("string"), F.when(k == KINDS.index("timestamp"), as_type(v, "timestamp")).alias("time"), F.when(k > KINDS.index("timestamp"), F.to_json(v)).alias("rest"))


class Schemaless:
    """Compiles filters against a VARIANT column."""

    def __init__(self, doc: Column):
        self.doc = doc

    def compile(self, node: f.Node) -> Column:
        """Never null."""
        return F.coalesce(getattr(self, "_" + type(node).__name__.lower())(node), F.lit(False))

    def _everything(self, node: f.Everything) -> Column:
        return F.lit(True)

    def _and(self, node: f.And) -> Column:
        return reduce(lambda a, b: a & b, map(self.compile, node.parts), F.lit(True))

    def _or(self, node: f.Or) -> Column:
        return reduce(lambda a, b: a | b, map(self.compile, node.parts), F.lit(False))

    def _not(self, node: f.Not) -> Column:
        return ~self.compile(node.part)

    def value(self, name: str) -> Column:
        return part(self.doc, name) if name else self.doc

    def _compare(self, node: f.Compare) -> Column:
        return self.compare(self.value(node.field), node.op, node.value)

    def compare(self, v: Column, op: str, value: Any) -> Column:
        """A value of the wanted type is compared as such; only of others is the kind looked up."""
        wanted = KINDS.index(kind_of_value(value))
        name = KINDS[wanted]
        if name in ("null", "document", "array"):
            there = F.is_variant_null(v) if name == "null" else kind(v) == wanted
            order = F.lit(0) if name == "null" else F.when(F.to_json(v) == F.to_json(F.parse_json(F.lit(json.dumps(value)))), 0).otherwise(1)
        else:
            got = self._exactly(v, name)
            other = F.lit(float(value) if name == "number" else value)
            there, order = got.isNotNull(), F.when(got == other, 0).when(got < other, -1).otherwise(1)
        if op == "eq":
            return there & (order == 0)
        if op == "ne":
            return ~F.coalesce(there & (order == 0), F.lit(False))
        order = F.when(v.isNull(), None).when(there, order).otherwise(F.when(kind(v) < wanted, -1).otherwise(1))
        return {"gt": order > 0, "gte": order >= 0, "lt": order < 0, "lte": order <= 0}[op]

    def _exactly(self, v: Column, name: str) -> Column:
        """The value if it is of that kind, else null: a cast alone would take "1" for a number, or true for 1."""
        got = as_type(v, {"number": "double", "string": "string", "timestamp": "timestamp", "binary": "binary", "boolean": "boolean"}[name])
        return F.when(got.isNotNull() & (kind(v) == KINDS.index(name)), got)

    def _in(self, node: f.In) -> Column:
        v = self.value(node.field)
        found = F.coalesce(reduce(lambda a, b: a | b, (self.compare(v, "eq", x) for x in node.values), F.lit(False)), F.lit(False))
        return ~found if node.negated else found

    def _exists(self, node: f.Exists) -> Column:
        v = self.value(node.field)
        there = v.isNotNull() & ~F.coalesce(F.is_variant_null(v), F.lit(False))
        return there if node.present else ~there

    def _hastype(self, node: f.HasType) -> Column:
        v, name = self.value(node.field), CODES.get(node.code)
        if name in ("int", "long"):
            small = as_type(v, "long").between(-(1 << 31), (1 << 31) - 1)
            return (type_name(v) == "BIGINT") & (small if name == "int" else ~small)
        if name in ("double", "decimal"):  # numbers with a fraction in JSON are doubles
            return F.lit(name == "double") & (type_name(v).isin("DOUBLE", "FLOAT") | F.startswith(type_name(v), F.lit("DECIMAL")))
        return kind(v) == KINDS.index(name) if name in KINDS else F.lit(False)

    def _string(self, name: str) -> Column:
        v = self.value(name)
        return F.when(type_name(v) == "STRING", as_type(v, "string"))

    def _regex(self, node: f.Regex) -> Column:
        return self._string(node.field).rlike(node.pattern)

    def _text(self, node: f.Text) -> Column:
        return getattr(F, node.op)(self._string(node.field), F.lit(node.value))

    def _array(self, name: str) -> Column:
        return F.try_variant_get(self.value(name), "$", "array<variant>")

    def _elemmatch(self, node: f.ElemMatch) -> Column:
        return F.exists(self._array(node.field), lambda x: Schemaless(x).compile(node.condition))

    def _size(self, node: f.Size) -> Column:
        return F.size(self._array(node.field)) == node.size

    def _all(self, node: f.All) -> Column:
        array = self._array(node.field)

        def has(v: Any) -> Column:
            return F.exists(array, lambda x: F.coalesce(self.compare(x, "eq", v), F.lit(False)))

        return reduce(lambda a, b: a & b, map(has, node.values), array.isNotNull())

    def _mod(self, node: f.Mod) -> Column:
        v = self.value(node.field)
        return F.when(kind(v) == KINDS.index("number"), as_type(v, "double").try_cast("long") % node.divisor == node.remainder)

    def _point(self, name: str) -> tuple[Column, Column]:
        pair = F.try_variant_get(self.value(name), "$", "array<double>")
        pair = F.when(F.size(pair) == 2, pair)
        return pair[0], pair[1]

    def _geowithin(self, node: f.GeoWithin) -> Column:
        lat, lon = self._point(node.field)
        return lat.between(node.low[0], node.high[0]) & lon.between(node.low[1], node.high[1])

    def _geonear(self, node: f.GeoNear) -> Column:
        lat, lon = self._point(node.field)
        return haversine_km(lat, lon, F.lit(node.center[0]), F.lit(node.center[1])) <= node.km

    def _nearvector(self, node: f.NearVector) -> Column:
        return F.try_variant_get(self.value(node.field), "$", "array<double>").isNotNull()


def documents(text: Column) -> Column:
    """A VARIANT column from JSON texts; texts that aren't JSON give null."""
    return F.try_parse_json(text)


def timestamp(v: dt.datetime) -> dt.datetime:
    """Times have millisecond precision in documents."""
    return v.replace(microsecond=v.microsecond // 1000 * 1000)
