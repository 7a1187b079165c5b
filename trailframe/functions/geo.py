"""Geodesy as Column arithmetic (GEO scalars, PRJ-01, PRJ-02): no Python in the hot path."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6371008.8
TILE_DEGREES = 5
METERS_PER_DEG_LAT = 111320.0


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres."""
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), F.lit(2))
    h = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    # not F.least, which takes 1 where a coordinate is null
    return 2 * EARTH_RADIUS_M * F.asin(F.when(h > 1, 1.0).otherwise(F.sqrt(h)))


def flat_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Flat-earth distance with the cosine of the first latitude (GEO-04)."""
    dy, dx = (lat1 - lat2) * METERS_PER_DEG_LAT, (lon1 - lon2) * METERS_PER_DEG_LAT * F.cos(F.radians(lat1))
    return F.sqrt(dy * dy + dx * dx)


def destination(lat: Column, lon: Column, bearing: Column, metres: Column) -> tuple[Column, Column]:
    """(lat, lon) after ``metres`` along a great circle; the longitude is in [-180, 180) (GEO-03)."""
    arc, turn, phi = metres / EARTH_RADIUS_M, F.radians(bearing), F.radians(lat)
    sine = F.sin(phi) * F.cos(arc) + F.cos(phi) * F.sin(arc) * F.cos(turn)
    end = F.asin(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), sine)))
    east = F.radians(lon) + F.atan2(F.sin(turn) * F.sin(arc) * F.cos(phi), F.cos(arc) - F.sin(phi) * sine)
    return F.degrees(end), F.pmod(F.degrees(east) + 540, F.lit(360.0)) - 180


def turn_deg(before: Column, after: Column) -> Column:
    """Turn from one bearing to another, -180 to 180, right is positive (GEO-06)."""
    return F.pmod(after - before + 540, F.lit(360.0)) - 180


def bearing_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing, 0 to 360."""
    turn = F.radians(lon2 - lon1)
    y = F.sin(turn) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(turn)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360, F.lit(360.0))


def compass_octant(bearing: Column) -> Column:
    """0 (north) to 7, each 45 degrees wide around its direction."""
    return F.pmod(F.floor((bearing + 22.5) / 45), F.lit(8)).cast("int")


def tile_name(lat: Column, lon: Column) -> Column:
    """Name of the 5-degree tile of a point by its south-west corner, such as ``W20_N30``."""
    corner = lambda v, top: (F.floor(F.least(F.greatest(v, F.lit(-top)), F.lit(top - 1e-9)) / TILE_DEGREES) * TILE_DEGREES).cast("int")
    named = lambda c, low, high: F.concat(F.when(c < 0, low).otherwise(high), F.abs(c).cast("string"))
    return F.concat_ws("_", named(corner(lon, 180.0), F.lit("W"), F.lit("E")), named(corner(lat, 90.0), F.lit("S"), F.lit("N")))


def mercator_tile(lat: Column, lon: Column, zoom: int) -> tuple[Column, Column]:
    """Web-Mercator tile numbers (x, y) of a point."""
    n = 1 << zoom
    held = F.radians(F.least(F.greatest(lat, F.lit(-85.05112878)), F.lit(85.05112878)))
    x = F.floor((lon + 180) / 360 * n)
    y = F.floor((1 - F.ln(F.tan(held) + 1 / F.cos(held)) / math.pi) / 2 * n)
    inside = lambda c: F.least(F.greatest(c, F.lit(0)), F.lit(n - 1)).cast("int")
    return inside(x), inside(y)


def whole(value: Column, scale: float = 1.0) -> Column:
    """Half up to an integer after scaling: sums of such values do not depend on order."""
    return F.floor(value * scale + 0.5).cast("long")
