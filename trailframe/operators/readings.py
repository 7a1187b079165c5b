"""Sensor readings of rides: power on a grid of seconds, counters, attached samples, fused sources, range means."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import METERS_PER_DEG_LAT, haversine_m, whole
from ..sources.shared import Rounds

#: Seconds that a reading is held at most, seconds of the rolling mean.
HELD_S = 5
ROLLING_S = 30


def power_grid(samples: DataFrame) -> DataFrame:
    """``(track_id, series, at_s, watts)``: each reading held until the next, a gap over ``HELD_S`` starts a new series.

    ``samples(track_id, at_s, watts)`` has one reading a second at most. A reading before a gap covers its own second.
    """
    w = Window.partitionBy("track_id").orderBy("at_s")
    rows = samples.filter("watts IS NOT NULL").withColumn("gap", F.lead("at_s").over(w) - F.col("at_s"))
    rows = rows.withColumn("series", F.coalesce(F.sum((F.col("gap") > HELD_S).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    held = F.when(F.col("gap") <= HELD_S, F.col("gap")).otherwise(1)
    return rows.select("track_id", "series", F.explode(F.sequence("at_s", F.col("at_s") + held - 1)).alias("at_s"), "watts")


def rolling(grid: DataFrame, seconds: int) -> DataFrame:
    """Sum of watts over each full window of ``seconds``."""
    w = Window.partitionBy("track_id", "series").orderBy("at_s").rowsBetween(1 - seconds, 0)
    sums = grid.withColumn("total", F.sum("watts").over(w)).withColumn("n", F.count("*").over(w))
    return sums.filter(F.col("n") == seconds).drop("n")


def normalised_power(grid: DataFrame) -> DataFrame:
    """``(track_id, watts)``: fourth root of the mean fourth power of the rolling means; no row without a full window (AGG-09)."""
    mean = F.col("total") / ROLLING_S
    return rolling(grid, ROLLING_S).groupBy("track_id").agg(F.floor(F.pow(F.avg(mean * mean * mean * mean), F.lit(0.25)) + 0.5).cast("long").alias("watts"))


def best_power(grid: DataFrame, seconds: int = 1200) -> DataFrame:
    """``(track_id, best_w, threshold_w)``: the highest mean over a full window, and 95 % of it to the nearest 5 W (AGG-10, AGG-11)."""
    best = rolling(grid, seconds).groupBy("track_id").agg(F.max("total").alias("total"))
    watts = F.col("total") / seconds
    return best.select("track_id", F.floor(watts + 0.5).cast("long").alias("best_w"), (F.floor(watts * 0.95 / 5 + 0.5) * 5).cast("long").alias("threshold_w"))


def counted(frames: DataFrame, counter: str, event: str, bits: int = 16) -> DataFrame:
    """Adds ``steps`` and ``ticks`` since the frame before, counters that wrap at ``bits`` included (STM-04)."""
    w = Window.partitionBy("source").orderBy("ts_us")
    ahead = lambda c, top: F.pmod(F.col(c) - F.lag(c).over(w), F.lit(top)).cast("long")
    return frames.withColumn("steps", ahead(counter, 1 << bits)).withColumn("ticks", ahead(event, 1 << 16))


def attached(fixes: DataFrame, samples: DataFrame, reach_s: int = 30) -> DataFrame:
    """``(track_id, id, s, value)``: the sample nearest in time within ``reach_s`` of each fix, of two the later (JOIN-26).

    The samples are dealt to slots of ``reach_s``; a fix meets three slots by an equi-join.
    """
    slot = lambda c: F.floor(F.col(c) / reach_s).cast("long")
    near = fixes.withColumn("slot", F.explode(F.sequence(slot("s") - 1, slot("s") + 1)))
    there = samples.select("track_id", F.col("s").alias("at"), "value", slot("s").alias("slot"))
    met = near.join(there, ["track_id", "slot"]).withColumn("far", F.abs(F.col("at") - F.col("s"))).filter(F.col("far") <= reach_s)
    best = met.groupBy("track_id", "id", "s").agg(F.min(F.struct("far", -F.col("at"), "value")).alias("x"))
    return best.select("track_id", "id", "s", "x.value")


def fused(readings: DataFrame, at_us: int, fresh_us: int = 10_000_000) -> DataFrame:
    """``(ride_id, kind, source_id, value)``: of each kind the highest-priority source that is fresh at ``at_us``, of equals the newer (STM-03)."""
    fresh = readings.filter(F.abs(F.col("ts_us") - at_us) <= fresh_us)
    best = fresh.groupBy("ride_id", "kind").agg(F.max(F.struct("priority", "ts_us", "source_id", "value")).alias("x"))
    return best.select("ride_id", "kind", "x.source_id", "x.value")


def range_mean(rows: DataFrame, along: str, value: str, reach: int) -> DataFrame:
    """Adds ``mean_milli``: mean of ``value`` within ``reach`` units of ``along``, nulls skipped (WIN-06)."""
    w = Window.partitionBy("track_id").orderBy(along).rangeBetween(-reach, reach)
    return rows.withColumn("mean_milli", F.floor(F.sum(value).over(w) * 1000 / F.count(value).over(w) + 0.5).cast("long"))


def worst_offset(waypoints: DataFrame, route: DataFrame, cell_m: float = 200.0) -> DataFrame:
    """``(route_id, worst_dm)``: the largest of the distances from ``waypoints (route_id, waypoint, lat, lon)`` to their nearest point of ``route (route_id, lat, lon)`` (AGG-16).

    Route points are thinned to the distinct positions of each route and laid on cells; a waypoint looks around itself, and
    what it does not find it looks for in cells four times as large, until a nearest point lies within the cells' reach. Points
    of one cell are met only by the waypoints near it. Joins are hinted, since files that compress well look small enough to broadcast. Waypoints and points with a null are left out, as are routes that have only one of both. Cells do not wrap at the date line.
    """
    spark = route.sparkSession
    rounds, done = Rounds(spark, "open-waypoints"), Rounds(spark, "near-waypoints", keep=1 << 30)
    points = Rounds(spark, "route-points").next(route.select("route_id", F.col("lat").alias("y"), F.col("lon").alias("x")).dropna().distinct())
    has = points.select("route_id").distinct()
    todo = rounds.next(waypoints.select("route_id", "waypoint", "lat", "lon").dropna().join(has.hint("merge"), "route_id", "left_semi"))
    found = []
    while not todo.isEmpty():
        high = cell_m / METERS_PER_DEG_LAT
        whole_globe = high > 180
        cell = lambda c: F.floor(c / high).cast("long")  # noqa: E731, B023
        # a column is as wide as a cell is high at the latitude of the waypoint, or a little more
        reach = high / F.greatest(F.cos(F.radians(F.least(F.abs("lat") + high, F.lit(89.0)))), F.lit(0.01))
        here = todo.withColumn("cy", F.explode(F.sequence(cell(F.col("lat") - high), cell(F.col("lat") + high)))).withColumn("cx", F.explode(F.sequence(cell(F.col("lon") - reach), cell(F.col("lon") + reach))))
        there = points.withColumn("cy", cell(F.col("y"))).withColumn("cx", cell(F.col("x")))
        met = here.join(there.hint("merge"), ["route_id", "cy", "cx"]).withColumn("dm", whole(haversine_m(F.col("lat"), F.col("lon"), F.col("y"), F.col("x")), 10.0))
        near = met.groupBy("route_id", "waypoint").agg(F.min("dm").alias("dm"))
        # nearer than a cell is high: no point outside the cells looked at can be nearer
        near = near if whole_globe else near.filter(F.col("dm") <= cell_m * 10 * 0.99)
        found.append(done.next(near))
        todo = rounds.next(todo.join(found[-1].hint("merge"), ["route_id", "waypoint"], "left_anti"))
        cell_m *= 4
    if not found:
        return spark.createDataFrame([], waypoints.select("route_id").schema.add("worst_dm", "bigint"))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every.groupBy("route_id").agg(F.max("dm").alias("worst_dm"))


def crossed(steps: DataFrame, breaks: DataFrame) -> DataFrame:
    """The ``steps (track_id, id, lo_us, hi_us)`` that some of ``breaks (track_id, lo_us, hi_us)`` overlaps by more than a moment (JOIN-19).

    Of the breaks that begin before a step ends, the latest end decides: one pass over both by time, no pairs. Steps or breaks
    with a null overlap nothing.
    """
    by = Window.partitionBy("track_id").orderBy("lo_us", "hi_us")
    known = breaks.select("track_id", "lo_us", "hi_us").dropna().filter("hi_us > lo_us")
    until = known.withColumn("until", F.max("hi_us").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    # of all breaks that begin before a step ends, the latest end decides
    marks = until.select("track_id", F.col("lo_us").alias("at"), "until", F.lit(None).cast("long").alias("lo_us"), F.lit(1).alias("order"), F.lit(None).cast("long").alias("id"))
    asked = steps.select("track_id", F.col("hi_us").alias("at"), F.lit(None).cast("long").alias("until"), "lo_us", F.lit(0).alias("order"), F.col("id").cast("long").alias("id")).dropna(subset=["track_id", "at", "lo_us"])
    sweep = Window.partitionBy("track_id").orderBy("at", "order").rowsBetween(Window.unboundedPreceding, 0)
    met = marks.unionByName(asked).withColumn("latest", F.max("until").over(sweep))
    return met.filter("order = 0 AND latest > lo_us").select("track_id", "id")


def smoothed_leg_speeds(legs: DataFrame, half_us: int = 5_000_000) -> DataFrame:
    """``legs`` with ``smooth_mmps``: the mean speed of the moving legs whose ends lie within ``half_us``, in one run of moving legs; 0 for a leg that does not move (WIN-07)."""
    by = Window.partitionBy("track_id").orderBy("ts_us", "event_id")
    runs = legs.withColumn("run", F.sum((~F.col("moving")).cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    near = Window.partitionBy("track_id", "run", "moving").orderBy("ts_us").rangeBetween(-half_us, half_us)
    mmps = whole(F.col("dm") * F.lit(1e8) / F.col("dur_us"))
    mean = F.floor(F.sum(F.when(F.col("moving"), mmps)).over(near) / F.count("*").over(near) + 0.5).cast("long")
    return runs.withColumn("smooth_mmps", F.when(F.col("moving"), mean).otherwise(F.lit(0).cast("long"))).drop("run")
