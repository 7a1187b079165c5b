"""Work on lines as tables of points: what lies beside them, fewer points of the same shape, pieces joined end to end.

A line is never gathered into one row or task. ``points (line_id, seq, lat, lon)`` hold a line's points in the order of
``seq``; rows with a null in one of these are left out, and points that repeat a (line_id, seq) give undefined legs.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.geo import haversine_m, whole
from ..sources.shared import Rounds

#: Fixed values of the corridor: metres of a degree, and how far from a line a stop may lie.
METERS_PER_DEGREE = 111195.0
CORRIDOR_M = 300.0
#: Segments that look for stops together, and how many times the corridor the cells are high in which they do.
TOGETHER = 64
CELLS = 4


def _known(points: DataFrame) -> DataFrame:
    return points.select("line_id", "seq", "lat", "lon").dropna()


def segments(points: DataFrame) -> DataFrame:
    """``(line_id, segment, lat, lon, lat2, lon2, start_mm, end_mm)``: a row between two points, numbered from 0 (AGG-04)."""
    by = Window.partitionBy("line_id").orderBy("seq")
    after = _known(points).select("*", F.lead("lat").over(by).alias("lat2"), F.lead("lon").over(by).alias("lon2"), (F.row_number().over(by) - 1).alias("segment")).filter("lat2 IS NOT NULL")
    after = after.withColumn("mm", whole(haversine_m(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")), 1000.0))
    end = F.sum("mm").over(Window.partitionBy("line_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, 0))
    return after.withColumn("end_mm", end).select("line_id", "segment", "lat", "lon", "lat2", "lon2", (F.col("end_mm") - F.col("mm")).alias("start_mm"), "end_mm")


def foot(lat: Column, lon: Column, least: Column | float = 0.0, most: Column | float = 1.0) -> tuple[Column, Column]:
    """(share of the segment, metres off) of the nearest point to ``(lat, lon)`` of a row of ``segments``, between two shares (JOIN-12)."""
    kx = F.cos(F.radians(F.col("lat")))
    bx, by, px, py = (F.col("lon2") - F.col("lon")) * kx, F.col("lat2") - F.col("lat"), (lon - F.col("lon")) * kx, lat - F.col("lat")
    square = bx * bx + by * by
    t = F.when(square == 0, 0.0).otherwise((px * bx + py * by) / square)
    wrap = lambda v: v if isinstance(v, Column) else F.lit(v)
    t = F.least(F.greatest(t, wrap(least)), wrap(most))
    return t, _off(lat, lon, t)


def _off(lat: Column, lon: Column, t: Column) -> Column:
    """Metres from ``(lat, lon)`` to the point of a segment at a share of its way."""
    return haversine_m(lat, lon, F.col("lat") + (F.col("lat2") - F.col("lat")) * t, F.col("lon") + (F.col("lon2") - F.col("lon")) * t)


def _wide(reach: float) -> Column:
    """Degrees of longitude that ``reach`` degrees of latitude are, at most, beside a segment."""
    return reach / F.greatest(F.cos(F.radians(F.greatest(F.abs("lat"), F.abs("lat2")) + 2 * reach)), F.lit(1e-6)) * 1.001


def on_cells(rows: DataFrame, reach_m: float, times: int = 1) -> DataFrame:
    """``segments`` laid on all cells within ``reach_m`` of them, as ``cy`` and ``cx``; a cell is ``times`` as high.

    A segment takes, band by band, the columns between where it enters and where it leaves the band, so that the cells of a
    long one grow with its length and not with its box.
    """
    reach = reach_m / METERS_PER_DEGREE
    high = reach * times
    south, north = F.least("lat", "lat2"), F.greatest("lat", "lat2")
    cell = lambda c: F.floor(c / high).cast("long")
    banded = rows.withColumn("cy", F.explode(F.sequence(cell(south - reach), cell(north + reach))))
    slope = F.when(F.col("lat2") != F.col("lat"), (F.col("lon2") - F.col("lon")) / (F.col("lat2") - F.col("lat")))
    # a foot within reach of a point of the band lies within a band more on either side
    at = lambda band: F.col("lon") + slope * (F.least(F.greatest(band * high, south), north) - F.col("lat"))
    a, b = at(F.col("cy") - 1), at(F.col("cy") + 2)
    west, east = F.coalesce(F.least(a, b), F.least("lon", "lon2")), F.coalesce(F.greatest(a, b), F.greatest("lon", "lon2"))
    wide = _wide(reach)
    # cells at high latitudes are as narrow in metres as they are there; their number a segment is bounded by 1e-6 above
    return banded.withColumn("cx", F.explode(F.sequence(cell(west - wide), cell(east + wide))))


def stops_along(points: DataFrame, stops: DataFrame, corridor_m: float = CORRIDOR_M, ahead: DataFrame | None = None) -> DataFrame:
    """``(line_id, stop_id, at_dm, off_mm)`` of ``stops (stop_id, lat, lon)`` within ``corridor_m`` of a line (JOIN-13).

    A stop is placed where the first contiguous stretch of segments beside it comes nearest. ``ahead (line_id, from_mm,
    to_mm)`` keeps to a part of each line; lines that it does not list are left out. Stops with a null are left out. Stops at one
    position are placed once, and their ids put to it at the end. Not the segments but stretches of some of them are laid on cells
    and meet the stops there, so that what is shuffled does not grow with the cells of every segment.
    """
    rows = segments(points)
    if ahead is None:
        rows = rows.withColumn("from_mm", F.lit(0).cast("long")).withColumn("to_mm", F.lit(None).cast("long"))
    else:
        rows = rows.join(ahead.select("line_id", "from_mm", "to_mm").hint("merge"), "line_id").filter("end_mm > from_mm AND start_mm < to_mm")
    reach = corridor_m / METERS_PER_DEGREE
    high = reach * CELLS
    known = stops.select("stop_id", F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon")).dropna()
    there = known.select("s_lat", "s_lon").distinct().withColumn("cy", F.floor(F.col("s_lat") / high).cast("long")).withColumn("cx", F.floor(F.col("s_lon") / high).cast("long"))
    rows = rows.withColumn("together", F.floor(F.col("segment") / TOGETHER))
    beside = on_cells(rows, corridor_m, CELLS).select("line_id", "together", "cy", "cx").distinct().join(there.hint("merge"), ["cy", "cx"]).drop("cy", "cx")
    near = lambda stop, a, b, by: (F.col(stop) >= F.least(a, b) - by) & (F.col(stop) <= F.greatest(a, b) + by)
    boxed = rows.withColumn("wide", _wide(reach)).hint("merge")
    met = beside.join(boxed, ["line_id", "together"]).filter(near("s_lat", "lat", "lat2", reach * 1.001) & near("s_lon", "lon", "lon2", F.col("wide")))
    length = F.col("end_mm") - F.col("start_mm")
    share = lambda mm, bare: F.when(length > 0, (mm - F.col("start_mm")) / length).otherwise(bare)
    least = F.greatest(F.lit(0.0), share(F.col("from_mm"), 0.0))
    most = F.least(F.lit(1.0), F.coalesce(share(F.col("to_mm"), 1.0), F.lit(1.0)))
    t, _ = foot(F.col("s_lat"), F.col("s_lon"), least, most)
    # exploded one by one, so that Spark does not copy them into the join's condition, whose loop would be too long for the JVM to compile
    placed = met.withColumn("t", F.explode(F.array(t))).withColumn("off_mm", F.explode(F.array(whole(_off(F.col("s_lat"), F.col("s_lon"), F.col("t")), 1000.0))))
    placed = placed.filter(F.col("off_mm") <= corridor_m * 1000)
    placed = placed.select("line_id", "s_lat", "s_lon", "segment", "off_mm", whole((F.col("start_mm") + length * F.col("t")) / 100).alias("at_dm"))
    by = Window.partitionBy("line_id", "s_lat", "s_lon")
    stretch = placed.withColumn("nth", F.row_number().over(by.orderBy("segment"))).withColumn("first", F.min("segment").over(by))
    stretch = stretch.filter(F.col("segment") - F.col("first") == F.col("nth") - 1)
    met = stretch.groupBy("line_id", "s_lat", "s_lon").agg(F.min_by("at_dm", F.struct("off_mm", "segment")).alias("at_dm"), F.min("off_mm").alias("off_mm"))
    return met.join(known.hint("merge"), ["s_lat", "s_lon"]).select("line_id", "stop_id", "at_dm", "off_mm")


@F.pandas_udf(DoubleType())
def _cosine(angle: pd.Series) -> pd.Series:
    """Cosines of the C library, whose last bits are not those of the JVM."""
    return pd.Series([math.cos(v) for v in angle.tolist()], dtype="float64")


@F.pandas_udf(DoubleType())
def _square_of(u: pd.Series, v: pd.Series) -> pd.Series:
    """``u^2 + v^2`` by the C library's power, which a product misses by the last bit at times."""
    return pd.Series([math.pow(a, 2.0) + math.pow(b, 2.0) for a, b in zip(u.tolist(), v.tolist(), strict=True)], dtype="float64")


def simplified(points: DataFrame, tolerance: float) -> DataFrame:
    """The ``(line_id, seq)`` to keep, so that no line strays more than ``tolerance`` micro-degrees of latitude from its points (WIN-16).

    All lines are split at once: each round takes the farthest point of every open stretch (the first of equals), keeps it if
    it is too far, and splits the stretch there. A stretch's rows are spread over tasks; its farthest point is a
    combined aggregate. As many rounds as the deepest split. Longitudes shrink by the cosine of the line's first latitude.
    Points on a grid are often equally far, so that the last bit of a distance chooses: cosines and squares are those of the
    C library, as SQL engines take them.
    """
    spark = points.sparkSession
    by = Window.partitionBy("line_id").orderBy("seq")
    micro = lambda c: F.floor(F.col(c) * 1e6 + 0.5)
    ends = _known(points).groupBy("line_id").agg(F.min("seq").alias("a"), F.max("seq").alias("b"), _cosine(F.radians(F.min_by("lat", "seq"))).alias("shrunk"))
    flat = _known(points).join(ends, "line_id").select("line_id", "seq", "a", "b", (micro("lon") * F.col("shrunk")).alias("x"), micro("lat").cast("double").alias("y"))
    flat = Rounds(spark, "flat-points").next(flat)
    kept = flat.filter("seq = a OR seq = b").select("line_id", "seq")
    if tolerance <= 0:
        return flat.select("line_id", "seq")
    end = lambda which: flat.filter(f"seq = {which}").select("line_id", F.col("x").alias(f"{which}x"), F.col("y").alias(f"{which}y"))
    rounds, found = Rounds(spark, "open-stretches"), Rounds(spark, "split-points", keep=1 << 30)
    open_ = rounds.next(flat.filter("seq > a AND seq < b").join(end("a"), "line_id").join(end("b"), "line_id"))
    dx, dy, px, py = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"), F.col("x") - F.col("ax"), F.col("y") - F.col("ay")
    square = dx * dx + dy * dy
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (px * dx + py * dy) / square))
    away = _square_of(F.when(square == 0, px).otherwise(px - t * dx), F.when(square == 0, py).otherwise(py - t * dy))
    while not open_.isEmpty():
        farthest = F.max(F.struct("away", (-F.col("seq")).alias("seq"), "x", "y")).alias("far")
        split = open_.withColumn("away", away).groupBy("line_id", "a").agg(farthest).filter(F.col("far.away") > tolerance * tolerance)
        split = found.next(split.select("line_id", "a", (-F.col("far.seq")).alias("at"), F.col("far.x").alias("fx"), F.col("far.y").alias("fy")))
        left = F.col("seq") < F.col("at")
        side = lambda yes, no, name: F.when(left, F.col(yes)).otherwise(F.col(no)).alias(name)
        halves = open_.join(split, ["line_id", "a"]).filter("seq <> at").select(
            "line_id", "seq", side("a", "at", "a"), side("at", "b", "b"), "x", "y", side("ax", "fx", "ax"), side("ay", "fy", "ay"), side("fx", "bx", "bx"), side("fy", "by", "by")
        )
        open_ = rounds.next(halves)
        kept = kept.unionByName(split.select("line_id", F.col("at").alias("seq")))
    return kept.distinct()


def chained(pieces: DataFrame) -> DataFrame:
    """``(chain_id, place, piece_id, before)`` of ``pieces (piece_id, attrs, start, end, weight)`` joined end to end (WIN-19).

    Two pieces join where one ends and the other starts with the same ``attrs``, and no other with these ends or starts there.
    A chain is named by its first piece, a ring by its smallest, from which it runs; ``place`` counts from 0 and ``before``
    sums the weights of the pieces before. Pieces are ranked by doubling: as many rounds as the logarithm of the longest
    chain. Pieces with a null end, start or attrs join nothing; a null weight is 0; piece ids are unique.
    """
    spark = pieces.sparkSession
    one = lambda side: pieces.dropna(subset=["attrs", side]).groupBy("attrs", F.col(side).alias("at")).agg(F.min("piece_id").alias(side), F.count("*").alias("n")).filter("n = 1").drop("n")
    links = one("end").join(one("start"), ["attrs", "at"]).filter("start <> end").select(F.col("start").alias("piece_id"), F.col("end").alias("prev"))
    weights = pieces.select("piece_id", F.coalesce("weight", F.lit(0)).cast("long").alias("weight"))
    nodes = Rounds(spark, "pieces").next(weights.join(links, "piece_id", "left"))
    ranked, rings = _ranked(nodes)
    if rings is not None:
        # a ring begins at its smallest piece
        cut = nodes.join(rings.select("piece_id", "least"), "piece_id").withColumn("prev", F.when(F.col("piece_id") != F.col("least"), F.col("prev"))).drop("least")
        around, _ = _ranked(Rounds(spark, "rings").next(cut))
        ranked = ranked.unionByName(around)
    return ranked.select(F.col("head").alias("chain_id"), "place", "piece_id", "before")


def _ranked(nodes: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(pieces with their head, place and weights before; pieces of rings with the smallest of their ring, if any)."""
    spark = nodes.sparkSession
    before = nodes.select(F.col("piece_id").alias("prev"), F.col("weight").alias("w"))
    state = nodes.join(before, "prev", "left").select(
        "piece_id", F.col("prev").alias("to"), F.when(F.col("prev").isNotNull(), 1).otherwise(0).cast("long").alias("place"), F.coalesce("w", F.lit(0)).alias("before"),
        F.when(F.col("prev").isNull(), F.col("piece_id")).alias("head"), F.least("piece_id", F.coalesce("prev", "piece_id")).alias("least"), F.lit(True).alias("moved"),
    )

    rounds = Rounds(spark, "ranks", final="finished")

    def parted(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The finished and the other pieces; finished ones are not written again."""
        found = rounds.next(rows.withColumn("finished", F.col("to").isNull()))
        return found.filter("finished").drop("finished"), found.filter("NOT finished").drop("finished")

    done, going = parted(state)
    unfinished = None
    while True:
        left, moved = going.agg(F.count("*"), F.count_if("moved")).first()
        if not left:
            return done.select("piece_id", "head", "place", "before"), None
        if left == unfinished and not moved:  # every chain gains finished pieces in a round, so these are rings
            return done.select("piece_id", "head", "place", "before"), going.select("piece_id", "least")
        unfinished = left
        up = done.unionByName(going).select(F.col("piece_id").alias("to"), F.col("to").alias("to2"), F.col("place").alias("place2"), F.col("before").alias("before2"), F.col("head").alias("head2"), F.col("least").alias("least2"))
        step = going.join(up, "to").select(
            "piece_id", F.col("to2").alias("to"), (F.col("place") + F.col("place2")).alias("place"), (F.col("before") + F.col("before2")).alias("before"), F.col("head2").alias("head"),
            F.least("least", "least2").alias("least"), (F.col("least2") < F.col("least")).alias("moved"),
        )
        more, going = parted(step)
        done = done.unionByName(more)


def chunk_boxes(points: DataFrame, chunk_m: float = 5000.0, pad_m: float = CORRIDOR_M) -> DataFrame:
    """``(line_id, chunk, south, west, north, east)``: boxes over about ``chunk_m`` of each line, grown by ``pad_m`` (JOIN-14).

    A chunk ends with the first segment that makes it that long, so chunks depend on where the ones before ended. That is a
    fold along the line that keeps one number; it runs over the sorted segments of a task.
    """
    rows = segments(points).select("line_id", "segment", "start_mm", "end_mm")

    def run(batches):
        import pyarrow as pa

        line, begin, chunk = None, 0, 0
        for batch in batches:
            out = []
            for own, start, end in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("line_id", "start_mm", "end_mm")), strict=True):
                if own != line:
                    line, begin, chunk = own, start, 0
                out.append(chunk)
                if end - begin >= chunk_m * 1000:
                    begin, chunk = end, chunk + 1
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.int32())], names=["line_id", "segment", "chunk"])

    dealt = rows.repartition("line_id").sortWithinPartitions("line_id", "segment")
    kind = rows.schema["line_id"].dataType.simpleString()
    cut = dealt.mapInArrow(run, f"line_id {kind}, segment int, chunk int")
    box = segments(points).join(cut, ["line_id", "segment"]).groupBy("line_id", "chunk").agg(
        F.min(F.least("lat", "lat2")).alias("s"), F.min(F.least("lon", "lon2")).alias("w"), F.max(F.greatest("lat", "lat2")).alias("n"), F.max(F.greatest("lon", "lon2")).alias("e")
    )
    dlat = F.lit(pad_m / 111320.0)
    dlon = dlat / F.greatest(F.cos(F.radians(F.greatest(F.abs("s"), F.abs("n")))), F.lit(1e-6))
    return box.select("line_id", "chunk", (F.col("s") - dlat).alias("south"), (F.col("w") - dlon).alias("west"), (F.col("n") + dlat).alias("north"), (F.col("e") + dlon).alias("east"))


def _between(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """``(span_id, line_id, from_mm, to_mm, first, last)``: the first and the last of the ``segments`` that each span meets.

    Segments and the ends of spans are counted in one order along each line, so that a span costs two rows, however many
    segments it meets. Segments without length count where they lie within a span, not at its ends. Spans that meet none are left out.
    """
    wanted = spans.dropna(subset=["line_id", "from_mm", "to_mm"]).filter("from_mm < to_mm").withColumn("from_mm", F.greatest("from_mm", F.lit(0)))
    ends = rows.groupBy("line_id").agg(F.max("end_mm").alias("length"))
    wanted = wanted.join(ends.hint("merge"), "line_id").withColumn("to_mm", F.least("to_mm", "length")).filter("from_mm < to_mm").select("span_id", "line_id", "from_mm", "to_mm")
    # at one distance: segments that end there, spans that begin, spans that end, segments that begin
    mark = lambda at, kind: F.struct(F.col(at).cast("long").alias("at"), F.lit(kind).alias("kind"))
    ways = rows.select("line_id", F.explode(F.array(mark("end_mm", 0), mark("start_mm", 3))).alias("m"))
    marks = wanted.select("*", F.explode(F.array(mark("from_mm", 1), mark("to_mm", 2))).alias("m")).unionByName(ways, allowMissingColumns=True)
    by = Window.partitionBy("line_id").orderBy("m.at", "m.kind").rowsBetween(Window.unboundedPreceding, 0)
    met = marks.withColumn("ended", F.count_if(F.col("m.kind") == 0).over(by)).withColumn("begun", F.count_if(F.col("m.kind") == 3).over(by)).filter("m.kind IN (1, 2)")
    found = met.groupBy("span_id", "line_id", "from_mm", "to_mm").agg(F.min("ended").alias("first"), (F.max("begun") - 1).alias("last"))
    return found.filter("first <= last")


def _share(mm: str, bare: float) -> Column:
    """How far along its segment a distance lies; ``bare`` for a segment without length."""
    length = F.col("end_mm") - F.col("start_mm")
    return F.when(length > 0, (F.col(mm) - F.col("start_mm")) / length).otherwise(bare)


def _cut() -> tuple[Column, Column, Column, Column]:
    """Where the segment of a row begins and ends within its span: lat, lon, lat2, lon2."""
    a, b = F.greatest(_share("from_mm", 0.0), F.lit(0.0)), F.least(_share("to_mm", 1.0), F.lit(1.0))
    on = lambda c, t: F.col(c) + (F.col(f"{c}2") - F.col(c)) * t
    return on("lat", a), on("lon", a), on("lat", b), on("lon", b)


def slices(points: DataFrame, spans: DataFrame) -> DataFrame:
    """``(span_id, piece, lat, lon, lat2, lon2)``: what lies of each line between two distances of ``spans (span_id, line_id, from_mm, to_mm)`` (JOIN-20).

    Ends are interpolated; a span beyond its line is cut, one without length has no pieces. Ids of spans are unique.
    """
    rows = segments(points)
    each = _between(rows, spans).withColumn("segment", F.explode(F.sequence("first", "last")))
    met = rows.join(each.hint("merge"), ["line_id", "segment"])
    return met.select("span_id", (F.col("segment") - F.col("first")).cast("int").alias("piece"), *[c.alias(name) for c, name in zip(_cut(), ("lat", "lon", "lat2", "lon2"), strict=True)])


def slice_ends(points: DataFrame, spans: DataFrame) -> DataFrame:
    """``(span_id, pieces, lat, lon, lat2, lon2)``: how many ``slices`` a span has, where its first one begins and where its last one ends.

    The pieces between are counted, not made.
    """
    rows = segments(points)
    between = _between(rows, spans)
    ends = between.withColumn("segment", F.explode(F.array_distinct(F.array("first", "last"))))
    met = rows.join(ends.hint("merge"), ["line_id", "segment"])
    lat, lon, lat2, lon2 = _cut()
    at = lambda end, v, w: F.max(F.when(F.col("segment") == F.col(end), F.struct(v.alias("lat"), w.alias("lon"))))
    found = met.groupBy("span_id", "first", "last").agg(at("first", lat, lon).alias("a"), at("last", lat2, lon2).alias("b"))
    return found.select("span_id", (F.col("last") - F.col("first") + 1).alias("pieces"), "a.lat", "a.lon", F.col("b.lat").alias("lat2"), F.col("b.lon").alias("lon2"))


def resampled(rows: DataFrame, most: int, *values: str) -> DataFrame:
    """``(line_id, nth, along, values)`` at ``most`` distances at most, evenly from the first row to the last (WIN-13).

    ``rows (line_id, seq, along, values)``. Values are interpolated between the two rows around a distance, and null if either
    is. A line of no more rows than that keeps them as they are.
    """
    pick = F.struct("along", *values)
    ends = rows.groupBy("line_id").agg(F.min("along").alias("lo"), F.max("along").alias("hi"), F.count("*").alias("n"))
    short = rows.join(ends.filter(F.col("n") <= most), "line_id")
    short = short.select("line_id", (F.row_number().over(Window.partitionBy("line_id").orderBy("along", "seq")) - 1).alias("nth"), F.col("along").cast("double").alias("along"), *[F.col(v).cast("double").alias(v) for v in values])
    long = ends.filter(F.col("n") > most)
    wanted = long.withColumn("nth", F.explode(F.sequence(F.lit(0), F.lit(most - 1)))).select("line_id", "nth", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("nth") / (most - 1)).alias("d"))
    seen = rows.join(long.select("line_id"), "line_id").select("line_id", F.lit(None).cast("int").alias("nth"), F.col("along").cast("double").alias("d"), pick.alias("p"), F.col("seq"))
    both = seen.unionByName(wanted, allowMissingColumns=True)
    forth = Window.partitionBy("line_id").orderBy("d", F.col("seq").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy("line_id").orderBy(F.desc("d"), F.col("seq").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("a", F.last("p", ignorenulls=True).over(forth)).withColumn("b", F.last("p", ignorenulls=True).over(back)).filter("nth IS NOT NULL")
    met = met.withColumn("a", F.coalesce("a", "b")).withColumn("b", F.coalesce("b", "a"))
    span = F.col("b.along") - F.col("a.along")
    t = F.when(span > 0, (F.col("d") - F.col("a.along")) / span).otherwise(0.0)
    return short.unionByName(met.select("line_id", "nth", F.col("d").alias("along"), *[(F.col(f"a.{v}") + (F.col(f"b.{v}") - F.col(f"a.{v}")) * t).alias(v) for v in values]))
