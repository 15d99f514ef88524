"""Points on the sphere: struct(lat, lon) or arrays of [lat, lon]."""

from __future__ import annotations

from math import cos, degrees, radians

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

EARTH_KM = 6371.0


def lat_of(point: Column, t: T.DataType) -> Column:
    return point.getField("lat") if isinstance(t, T.StructType) else F.get(point, F.lit(0))


def lon_of(point: Column, t: T.DataType) -> Column:
    return point.getField("lon") if isinstance(t, T.StructType) else F.get(point, F.lit(1))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.sin(dlat / 2) * F.sin(dlat / 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlon / 2) * F.sin(dlon / 2)
    return 2 * EARTH_KM * F.atan2(F.sqrt(a), F.sqrt(F.greatest(F.lit(0.0), 1 - a)))


def within_box(point: Column, t: T.DataType, low: tuple[float, float], high: tuple[float, float]) -> Column:
    """Inclusive; corners are (lat, lon)."""
    return lat_of(point, t).between(low[0], high[0]) & lon_of(point, t).between(low[1], high[1])


def box_around(lat: float, lon: float, km: float) -> tuple[tuple[float, float], tuple[float, float]]:
    """The box that holds a circle; all longitudes where the circle reaches a pole."""
    dlat = degrees(km / EARTH_KM)
    flat = cos(radians(lat))
    dlon = degrees(km / (EARTH_KM * flat)) if flat > 1e-12 and abs(lat) + dlat < 90 else 360.0
    return (lat - dlat, lon - dlon), (lat + dlat, lon + dlon)


def cell(lat: Column, lon: Column, bits: int = 16) -> Column:
    """Number of a cell of the sphere along a Z-shaped curve: near points have near numbers, mostly. Null without a place."""

    def spread(x: Column) -> Column:
        """The low 16 bits with a gap after each."""
        for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
            x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask).cast("long"))
        return x

    def part(x: Column, low: float, width: float) -> Column:
        last = (1 << bits) - 1
        return F.least(F.greatest(F.floor((x - low) / width * (1 << bits)), F.lit(0)), F.lit(last)).cast("long")

    number = spread(part(lon, -180.0, 360.0)).bitwiseOR(F.shiftleft(spread(part(lat, -90.0, 180.0)), 1))
    return F.when(lat.isNotNull() & lon.isNotNull(), number)
