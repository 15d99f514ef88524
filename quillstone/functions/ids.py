"""Ids for rows that come without one. Times are given; the random part differs from run to run, so write rows before reuse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BASE32 = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def object_id(at: Column) -> Column:
    """24 hex digits: seconds, then 64 random bits; orders by time."""
    return F.concat(F.lpad(F.lower(F.hex(F.unix_seconds(at))), 8, "0"), F.substring(F.regexp_replace(F.uuid(), "-", ""), 1, 16))


def ulid(at: Column) -> Column:
    """26 base-32 digits: milliseconds in 10, then 16 random ones; orders by time."""
    millis = F.unix_millis(at)
    digits = F.split(F.lit(_BASE32), "")

    def digit(n: Column) -> Column:
        return F.get(digits, n.cast("int"))

    time = [digit(F.shiftright(millis, 5 * k).bitwiseAND(31)) for k in range(9, -1, -1)]
    rest = F.transform(F.sequence(F.lit(1), F.lit(16)), lambda k: digit(F.conv(F.substring(F.regexp_replace(F.uuid(), "-", ""), 1, 2), 16, 10).cast("int") % 32 + 0 * k))
    return F.concat(*time, F.array_join(rest, ""))


def sequence(df: DataFrame, name: str, start: int, order: list[str]) -> DataFrame:
    """Gapless numbers from `start` in an order, counted in two levels."""
    from quillstone.operators.relation import Relation

    return Relation(df, tuple(order)).numbered(name).withColumn(name, F.col(name) + start)
