"""Rows met along a route: aliases, marks, grids, providers, merged streets, weather along it, items spread over it, positions on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo

MARK_REACH_M = 60
CELL_DEG = 0.001
#: Metres of a degree for the box, cell of streets without a place, limits of a weather digest.
BOX_M_PER_DEG = 111195
ORPHAN_CELL_E7 = 1_000_000
DOMINANT_PERMILLE = 500
GUST_MPS = 10
WIND_CLASSES = ("headwind", "tailwind", "crosswind", "calm")


def resolved(hits: DataFrame, rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """Hits ``(id, rank)`` as ``rows`` with their best rank; an id that is no row's stands for its alias's row (JOIN-04).

    Ids that are neither, and aliases of rows that are gone, are left out.
    """
    own = rows.select("id", F.col("id").alias("target"))
    of = aliases.select("id", F.col("ref_id").alias("target")).join(own.select("id"), "id", "left_anti")
    best = hits.join(own.unionByName(of), "id").groupBy(F.col("target").alias("id")).agg(F.min("rank").alias("rank"))
    return best.join(rows, "id")


def marks(pois: DataFrame, fixes: DataFrame, reach_m: float = MARK_REACH_M) -> DataFrame:
    """The fix of each track that is nearest to a place ``(id, y, x)`` within reach; of equals, in whole millimetres, the last (JOIN-15).

    Places are laid on all cells of their box, so they and the fixes meet by cell; nothing is broadcast.
    """
    high = reach_m / BOX_M_PER_DEG
    wide = F.lit(high) / F.greatest(F.cos(F.radians("y")), F.lit(0.01))
    cell = lambda c: F.floor(c / CELL_DEG)
    cells = lambda c, m: F.explode(F.sequence(cell(c - m), cell(c + m)))
    laid = pois.withColumn("cy", cells(F.col("y"), F.lit(high))).withColumn("cx", cells(F.col("x"), wide))
    near = laid.join(fixes.withColumn("cy", cell(F.col("lat"))).withColumn("cx", cell(F.col("lon"))), ["cy", "cx"])
    mm = geo.whole(geo.haversine_m(F.col("y"), F.col("x"), F.col("lat"), F.col("lon")), 1000.0)
    last = F.max(F.struct((-F.col("mm")).alias("d"), "ts_us", "event_id"))
    return near.withColumn("mm", mm).filter(F.col("mm") <= int(reach_m * 1000)).groupBy("track_id", "id").agg(last.alias("m")).select("track_id", "id", (-F.col("m.d")).alias("mm"), "m.event_id")


def bilinear(points: DataFrame, grid: DataFrame, columns: int, rows: int) -> DataFrame:
    """Values of a grid ``(col, row, value)`` at ``(id, x, y)`` in steps of the grid (JOIN-18).

    Corners without a value are left out and the others weighed up; where only corners of no weight have one, these alike;
    null outside of the grid or where no corner has one.
    """
    low = lambda c, n: F.least(F.greatest(F.floor(c), F.lit(0)), F.lit(max(n - 2, 0)))
    held = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    inside = F.col("x").between(-1e-9, columns - 1 + 1e-9) & F.col("y").between(-1e-9, rows - 1 + 1e-9)
    at = points.filter(inside).withColumn("x0", low(F.col("x"), columns)).withColumn("y0", low(F.col("y"), rows))
    fx, fy = held(F.col("x") - F.col("x0")), held(F.col("y") - F.col("y0"))
    side = lambda c, i, n: F.least(F.col(c) + i, F.lit(n - 1))
    corner = lambda i, j: F.struct(side("x0", i, columns).alias("col"), side("y0", j, rows).alias("row"), ((fx if i else 1 - fx) * (fy if j else 1 - fy)).alias("w"))
    corners = at.select("id", F.inline(F.array(*[corner(i, j) for j in (0, 1) for i in (0, 1)])))
    known = corners.join(grid.filter("value IS NOT NULL AND NOT isnan(value)"), ["col", "row"])
    w = F.sum("w")
    sampled = known.groupBy("id").agg(F.when(w > 0, F.sum(F.col("value") * F.col("w")) / w).otherwise(F.avg("value")).alias("value"))
    return points.select("id").join(sampled, "id", "left")


def first_provider(wanted: DataFrame, offers: DataFrame, fallback: str) -> DataFrame:
    """Wanted cells with the value of the first provider by priority that covers them, else the fallback's, and its name (JOIN-21).

    An offer ``(cell, priority, source, value)`` says that its source covers the cell; a null value that it failed. No third provider is
    asked; a cell without an answer has nulls.
    """
    back = F.min(F.when(F.col("source") == fallback, F.col("value")))
    best = offers.groupBy("cell").agg(F.min(F.struct("priority", "source", "value")).alias("b"), back.alias("back"))
    met, value = wanted.join(best, "cell", "left"), F.coalesce("b.value", "back")
    source = F.when(F.col("b.value").isNotNull(), F.col("b.source")).when(F.col("back").isNotNull(), fallback)
    return met.select(*wanted.columns, source.alias("source"), value.alias("value"))


def merged_streets(ways: DataFrame) -> DataFrame:
    """Ways ``(seq, name, place_id, lat_e7, lon_e7, alts)`` as one street a name and place, or a name and cell without a place (AGG-17).

    The position is the mean, the aliases are the union in the order of the ways. ``first_seq`` orders streets as they were first read
    (numbers without gaps would need one task). Aliases are made distinct before they are collected, so a long street stays small.
    """
    cell = lambda c: F.when(F.col("place_id").isNull(), F.floor(F.col(c) / ORPHAN_CELL_E7)).otherwise(0)
    key = ["name", "orphan", "p", "cy", "cx"]
    keyed = ways.withColumns({"orphan": F.col("place_id").isNull(), "p": F.coalesce("place_id", F.lit(0)), "cy": cell("lat_e7"), "cx": cell("lon_e7")})
    mean = lambda c: F.floor(F.sum(c) / F.count("*")).cast("long")
    streets = keyed.groupBy(*key).agg(F.min("seq").alias("first_seq"), F.max("place_id").alias("place_id"), mean("lat_e7").alias("lat_e7"), mean("lon_e7").alias("lon_e7"))
    alts = keyed.select(*key, "seq", F.posexplode("alts").alias("i", "alt")).groupBy(*key, "alt").agg(F.min(F.struct("seq", "i")).alias("at"))
    named = alts.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "alt"))), lambda a: a["alt"]).alias("alts"))
    return streets.join(named, key, "left").select("first_seq", "name", "place_id", "lat_e7", "lon_e7", F.coalesce("alts", F.array().cast("array<string>")).alias("alts"))


def first_addresses(addresses: DataFrame) -> DataFrame:
    """One address ``(street_id, number, seq, lat_e7, lon_e7)`` a house number of a street: the first in the file (AGG-25)."""
    first = F.min(F.struct("seq", "lat_e7", "lon_e7"))
    return addresses.groupBy("street_id", "number").agg(first.alias("a")).select("street_id", "number", "a.lat_e7", "a.lon_e7")


def frame_statistics(frames: DataFrame, by: str, budget: int, short_us: int = 1_000_000, long_us: int = 2_000_000) -> DataFrame:
    """Of frames ``(at_us, build, raster)``: those of the short and the long time up to the last one, and the slow ones of the long, in permille (AGG-26)."""
    now = frames.groupBy(by).agg(F.max("at_us").alias("now_us"))
    recent = frames.join(now, by).filter(F.col("at_us") > F.col("now_us") - long_us)
    slow = (F.col("build") > budget) | (F.col("raster") > budget)
    return recent.groupBy(by).agg(
        F.count_if(F.col("at_us") > F.col("now_us") - short_us).alias("n_short"), F.count("*").alias("n_long"), F.floor(F.count_if(slow) * 1000 / F.count("*")).cast("long").alias("slow_permille")
    )


def _weighed(samples: DataFrame) -> DataFrame:
    """Each sample's share of the way and the time, half to each neighbour, doubled (whole numbers stay whole)."""
    w = Window.partitionBy("ride_id").orderBy("seq")
    span = lambda c: F.coalesce(F.lead(c).over(w), F.col(c)) - F.coalesce(F.lag(c).over(w), F.col(c))
    return samples.withColumn("way2", span("along_m")).withColumn("time2", span("minute"))


def weather_summary(samples: DataFrame) -> DataFrame:
    """Shares of winds by way, in permille of the whole way, and the extremes and rain of a ride (AGG-21).

    Samples ``(ride_id, seq, along_m, minute, wind, temp, gust, mm100, wet)``; without weather ``wind`` is null. ``rain`` is in
    hundredths of a millimetre times the minutes that a sample stands for.
    """
    total, known = F.sum("way2"), F.col("wind").isNotNull()
    share = lambda c: F.when(total > 0, F.floor(F.coalesce(F.sum(F.when(F.col("wind") == c, F.col("way2"))), F.lit(0)) * 1000 / total)).otherwise(0).cast("long").alias(c)
    if_known = lambda c: F.when(known, F.col(c))
    first_wet = F.min(F.when(known & F.col("wet"), F.struct("seq", "along_m")))
    return _weighed(samples).groupBy("ride_id").agg(
        *map(share, WIND_CLASSES), F.min(if_known("temp")).alias("min_temp"), F.max(if_known("temp")).alias("max_temp"), first_wet["along_m"].alias("first_rain_m"),
        F.max(if_known("gust")).alias("max_gust"), F.coalesce(F.floor(F.sum(F.when(known, F.col("mm100") * F.col("time2"))) / 2), F.lit(0)).cast("long").alias("rain"))


def weather_digest(samples: DataFrame, light_mm100: int) -> DataFrame:
    """The wind of at least half of the covered way, else ``mixed``; the first wet sample, whether its rain stays light, gusts worth telling (AGG-31).

    Of winds with equal shares the one met first; where the covered way has no length, the first sample's. Samples as in ``weather_summary``.
    """
    known = _weighed(samples).filter("wind IS NOT NULL")
    sums = [F.struct(F.sum(F.when(F.col("wind") == c, F.col("way2"))).alias("way"), (-F.min(F.when(F.col("wind") == c, F.col("seq")))).alias("first"), F.lit(c).alias("wind")) for c in WIND_CLASSES]
    first_wet, wettest, gust = F.min(F.when(F.col("wet"), F.struct("seq", "along_m"))), F.max(F.when(F.col("wet"), F.col("mm100"))), F.max("gust")
    told = known.groupBy("ride_id").agg(
        F.array_max(F.filter(F.array(*sums), lambda s: s["way"].isNotNull())).alias("top"), F.sum("way2").alias("covered"), F.min(F.struct("seq", "wind"))["wind"].alias("only"),
        first_wet["along_m"].alias("rain_m"), (wettest < light_mm100).alias("light"), F.when(gust >= GUST_MPS, gust).alias("gust"))
    dominant = F.when(F.col("top.way") * 1000 >= F.col("covered") * DOMINANT_PERMILLE, F.col("top.wind")).otherwise("mixed")
    return told.select("ride_id", F.when(F.col("covered") <= 0, F.col("only")).otherwise(dominant).alias("wind"), "rain_m", "light", "gust")


def spread(items: DataFrame, route: str, along: str, length: int, group: str, better: list[Column], cap: int) -> DataFrame:
    """At most ``cap`` items a route, spread along it: parts of the way take turns, in a part the groups do (WIN-02).

    Each ranking keeps ``cap`` rows a group at most, which Spark applies before it shuffles; no later row can be chosen.
    """
    parts = -(-cap // 4)
    part = F.least(F.greatest(F.floor(F.col(along) * parts / length), F.lit(0)), F.lit(parts - 1)) if length > 0 else F.lit(0)
    rank = lambda by, order: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    turns = items.withColumn("part", part).withColumn("turn", rank([route, "part", group], better)).filter(F.col("turn") <= cap)
    rounds = turns.withColumn("round", rank([route, "part"], ["turn", *better])).filter(F.col("round") <= cap)
    return rounds.withColumn("chosen", rank([route], ["round", "part"])).filter(F.col("chosen") <= cap).drop("part", "turn", "round")


def points_along(line: DataFrame, wanted: DataFrame) -> DataFrame:
    """Positions on lines ``(route_id, seq, along, lat, lon)`` at wanted ``(route_id, id, along)``, between two points by share of the way (GEO-07).

    Before the start the first point, after the end the last; null for a route without points. No pairs: the point before is the
    last one seen by the way, the point after the last one seen on the way back, so that each row costs no more than two sorts.
    """
    points = line.select("route_id", "along", F.struct("along", "lat", "lon").alias("p"), F.col("seq").cast("long").alias("n"), F.lit(None).cast("long").alias("id"))
    both = points.unionByName(wanted.select("route_id", "along", F.lit(None).cast(points.schema["p"].dataType).alias("p"), F.lit(None).cast("long").alias("n"), F.col("id").cast("long").alias("id")))
    w = Window.partitionBy("route_id").orderBy("along", F.col("n").asc_nulls_last(), "id")
    back = Window.partitionBy("route_id").orderBy(F.desc("along"), F.col("n").desc_nulls_first(), F.desc("id"))
    seen = lambda way: F.last("p", ignorenulls=True).over(way.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    a, b = seen(w), seen(back)
    met = both.withColumn("a", a).withColumn("b", b).filter("id IS NOT NULL")
    span = F.col("b.along") - F.col("a.along")
    between = lambda c: F.coalesce(F.when(span > 0, F.col(f"a.{c}") + (F.col(f"b.{c}") - F.col(f"a.{c}")) * ((F.col("along") - F.col("a.along")) / span)), F.col(f"a.{c}"), F.col(f"b.{c}")).alias(c)
    return met.select("route_id", "id", between("lat"), between("lon"))
