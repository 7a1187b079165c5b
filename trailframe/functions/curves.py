"""Covers of boxes by tiles, directions on the circle, classes of values and the speed that a power allows, as Column expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import METERS_PER_DEG_LAT, TILE_DEGREES

#: The edge of the Mercator map, and the Newton steps from their first speed.
MERCATOR_EDGE = 85.0511
STEPS, FIRST_SPEED, CLOSE = 10, 8.0, 0.1


def _range(low: Column, high: Column, step: int) -> Column:
    return F.when(high >= low, F.sequence(low, high, F.lit(step))).otherwise(F.array().cast("array<int>"))


def expanded(south: Column, west: Column, north: Column, east: Column, metres: Column | float) -> tuple[Column, Column, Column, Column]:
    """A box grown by metres on each side, by the cosine of its latitude farthest from the equator (PRJ-06)."""
    dlat = (metres if isinstance(metres, Column) else F.lit(metres)) / METERS_PER_DEG_LAT
    dlon = dlat / F.greatest(F.cos(F.radians(F.greatest(F.abs(south), F.abs(north)))), F.lit(1e-6))
    return south - dlat, west - dlon, north + dlat, east + dlon


def tiles_of_box(south: Column, west: Column, north: Column, east: Column) -> Column:
    """Names of the 5-degree tiles that a box touches, its edges included; it is cut at the ends of the map and does not wrap (PRJ-01)."""
    floor = lambda v: (F.floor(v / TILE_DEGREES) * TILE_DEGREES).cast("int")
    lats = _range(F.greatest(F.lit(-90), floor(south)), F.least(F.lit(85), floor(north)), TILE_DEGREES)
    lons = _range(F.greatest(F.lit(-180), floor(west)), F.least(F.lit(175), floor(east)), TILE_DEGREES)
    named = lambda c, low, high: F.concat(F.when(c < 0, low).otherwise(high), F.abs(c).cast("string"))
    return F.flatten(F.transform(lats, lambda y: F.transform(lons, lambda x: F.concat(named(x, F.lit("W"), F.lit("E")), F.lit("_"), named(y, F.lit("S"), F.lit("N"))))))


def mercator_tiles_of_box(south: Column, west: Column, north: Column, east: Column, zoom: int) -> Column:
    """``(x, y)`` of the Web-Mercator tiles that a box touches; one that reaches over the date line wraps (PRJ-02)."""
    n = 1 << zoom
    column = lambda lon: F.floor((lon + 180) / 360 * n).cast("int")

    def row(lat: Column) -> Column:
        held = F.radians(F.least(F.greatest(lat, F.lit(-MERCATOR_EDGE)), F.lit(MERCATOR_EDGE)))
        y = F.floor((1 - F.ln(F.tan(held) + 1 / F.cos(held)) / math.pi) / 2 * n).cast("int")
        return F.least(F.greatest(y, F.lit(0)), F.lit(n - 1))

    xs = _range(column(west), F.least(column(east), column(west) + (n - 1)), 1)
    return F.flatten(F.transform(_range(row(north), row(south), 1), lambda y: F.transform(xs, lambda x: F.struct(F.pmod(x, F.lit(n)).alias("x"), y.alias("y")))))


def circular_difference(a: Column, b: Column) -> Column:
    """How far two directions lie apart, 0 to 180 degrees (GEO-06)."""
    turn = F.pmod(b - a, F.lit(360.0))
    return F.least(turn, 360 - turn)


def circular_between(a: Column, b: Column, share: Column) -> Column:
    """The direction a share of the shorter way from one to the other, 0 to 360; of two equal ways the right one (GEO-06)."""
    turn = F.pmod(b - a + 180, F.lit(360.0)) - 180
    turn = F.when(turn == -180, 180.0).otherwise(turn)
    return F.pmod(a + turn * share, F.lit(360.0))


def class_of(value: Column, bounds: Sequence[Column]) -> Column:
    """The number of the first bound that a value lies below, else how many there are (WIN-12)."""
    found = F.lit(len(bounds))
    for i in range(len(bounds) - 1, -1, -1):
        found = F.when(value < bounds[i], i).otherwise(found)
    return F.when(value.isNotNull(), found)


def speed_of_power(a: Column, c: Column, d: Column) -> Column:
    """The speed with ``a v^3 + c v = d``: Newton steps from 8 m/s, which is doubled first until it is too fast; ten rounds in all (NUM-02)."""

    def step(s: Column, _: Column) -> Column:
        v = s["v"]
        y = (a * v * v + c) * v - d
        state = lambda speed, seeking, done: F.struct(speed.alias("v"), seeking.alias("seeking"), done.alias("done"))
        none, yes = F.lit(False), F.lit(True)
        near = y < CLOSE
        return F.when(s["done"], s).when(near & s["seeking"], state(v * 2, yes, none)).when(near, state(v, none, yes)).otherwise(state(v - y / (3 * a * v * v + c), none, none))

    start = F.struct(F.lit(FIRST_SPEED).alias("v"), F.lit(True).alias("seeking"), F.lit(False).alias("done"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step, lambda s: s["v"])
