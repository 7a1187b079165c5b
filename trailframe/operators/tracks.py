"""Per-track statistics: one window pass over (track, time) and map-side combined sums.

Every operator keys its only shuffle on the track; a track is a bounded recording, so a window partition is one
recording. Distances are rounded to decimetres per leg, so sums do not depend on the order of addition.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.geo import EARTH_RADIUS_M, haversine_m, whole

#: Fixed values of the reference's statistics.
MOVING_MPS = 1000 / 3600
MAX_PLAUSIBLE_MPS = 30.0
ELEVATION_HYSTERESIS_M = 3
HEART_ZONE_PERCENT = (60, 70, 80, 90)
POWER_ZONE_PERCENT = (55, 75, 90, 105, 120, 150)


def in_time() -> WindowSpec:
    return Window.partitionBy("track_id").orderBy("ts_us", "event_id")



def legs(points: DataFrame, pause_us: int) -> DataFrame:
    """A row per fix with the leg that ends there: length in decimetres, duration, break and moving flags (AGG-04)."""
    before = lambda c: F.lag(c).over(in_time())
    rows = points.select("*", before("lat").alias("lat0"), before("lon").alias("lon0"), before("ts_us").alias("ts0"), before("pwr").alias("pwr0"), before("ele").alias("ele0"), before("kind").alias("kind0"))
    rows = rows.withColumn("dur_us", F.col("ts_us") - F.col("ts0"))
    rows = rows.withColumn("dm", whole(haversine_m(F.col("lat0"), F.col("lon0"), F.col("lat"), F.col("lon")), 10.0))
    ridden = (F.col("dur_us") > 0) & (F.col("dur_us") <= pause_us)
    speed = F.col("dm") * F.lit(100000.0) / F.col("dur_us")
    plausible = ridden & (speed <= MAX_PLAUSIBLE_MPS)
    return rows.withColumn("ridden", F.coalesce(plausible, F.lit(False))).withColumn("moving", F.coalesce(plausible & (speed > MOVING_MPS), F.lit(False))).withColumn("speed", F.when(plausible, speed))


def ride_totals(rows: DataFrame) -> DataFrame:
    """Distance, moving and elapsed time, top speed and sensor means of each ride, from the legs of its accepted fixes (AGG-01)."""
    mean = lambda c: whole(F.sum(c) / F.count(c))
    return rows.groupBy("track_id").agg(
        F.count("*").alias("n_points"),
        F.coalesce(F.sum(F.when(F.col("ridden"), F.col("dm"))), F.lit(0)).alias("distance_dm"),
        F.coalesce(F.sum(F.when(F.col("moving"), F.col("dur_us"))), F.lit(0)).alias("moving_us"),
        (F.max("ts_us") - F.min("ts_us")).alias("elapsed_us"),
        whole(F.max("speed"), 100.0).alias("max_speed_cmps"),
        mean("hr").alias("avg_hr"), F.max("hr").alias("max_hr"), mean("pwr").alias("avg_power"),
    )


def accepted(points: DataFrame) -> DataFrame:
    """Fixes that pass against the last *accepted* fix (PRJ-11): later, and not faster than plausible.

    Which fix is the last accepted one depends on all before it, so this is a fold along each track. Tracks come sorted,
    and the fold keeps one fix only, so no track is held in memory. A fix without time or position is dropped.
    """
    from math import asin, cos, radians, sin, sqrt

    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        track, last = object(), None
        for batch in batches:
            keep = []
            for own, ts, y, x in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("track_id", "ts_us", "lat", "lon")), strict=True):
                if own != track:
                    track, last = own, None
                ok = ts is not None and y is not None and x is not None
                if ok and last is not None:
                    h = sin(radians(y - last[1]) / 2) ** 2 + cos(radians(last[1])) * cos(radians(y)) * sin(radians(x - last[2]) / 2) ** 2
                    seconds = (ts - last[0]) / 1e6
                    ok = seconds > 0 and 2 * EARTH_RADIUS_M * asin(min(1.0, sqrt(h))) / seconds <= MAX_PLAUSIBLE_MPS
                keep.append(ok)
                if ok:
                    last = (ts, y, x)
            yield batch.filter(pa.array(keep, pa.bool_()))

    ordered = points.repartition("track_id").sortWithinPartitions("track_id", "ts_us", "event_id")
    return ordered.mapInArrow(run, points.schema)


def elevation_gain(points: DataFrame, hysteresis: int = ELEVATION_HYSTERESIS_M) -> DataFrame:
    """Ascent and descent, to the millimetre, with an anchor that moves only by ``hysteresis`` metres or more (AGG-02), a fold in the JVM."""
    height = F.col("ele").cast("double")
    finite = points.filter(height.isNotNull() & ~F.isnan(height) & (F.abs(height) != float("inf"))).withColumn("mm", whole(height, 1000.0))
    heights = finite.groupBy("track_id").agg(F.sort_array(F.collect_list(F.struct("ts_us", "event_id", "mm"))).alias("x"))
    start = F.struct(F.col("x")[0]["mm"].alias("anchor"), F.lit(0).cast("long").alias("up"), F.lit(0).cast("long").alias("down"))

    def step(s: Column, x: Column) -> Column:
        d = x["mm"] - s["anchor"]
        far = F.abs(d) >= hysteresis * 1000
        return F.struct(
            F.when(far, x["mm"]).otherwise(s["anchor"]).alias("anchor"),
            (s["up"] + F.when(far & (d > 0), d).otherwise(F.lit(0))).cast("long").alias("up"),
            (s["down"] + F.when(far & (d < 0), -d).otherwise(F.lit(0))).cast("long").alias("down"),
        )

    return heights.select("track_id", F.aggregate("x", start, step).alias("s")).select("track_id", (F.col("s.up") / 1000).alias("ascent_m"), (F.col("s.down") / 1000).alias("descent_m"))


def ride_statistics(points: DataFrame, pause_us: int) -> DataFrame:
    """Totals, ascent and descent of each ride over its accepted fixes (AGG-01 after PRJ-11, AGG-02)."""
    kept = accepted(points)
    climbed = elevation_gain(kept).withColumnRenamed("track_id", "t")
    found = ride_totals(legs(kept, pause_us)).join(climbed, F.col("track_id").eqNullSafe(F.col("t")), "left").drop("t")
    return found.fillna(0, ["ascent_m", "descent_m"])


def splits(rows: DataFrame, length_dm: int) -> DataFrame:
    """Distance and time of each split; a leg over a boundary is cut in proportion (AGG-05)."""
    along = F.sum(F.when(F.col("ridden"), F.col("dm")).otherwise(0)).over(in_time())
    placed = rows.withColumn("b", along).filter("ridden AND dm > 0").withColumn("a", F.col("b") - F.col("dm"))
    each = placed.withColumn("split", F.explode(F.sequence(F.floor(F.col("a") / length_dm), F.floor((F.col("b") - 1) / length_dm))))
    own = F.least("b", (F.col("split") + 1) * length_dm) - F.greatest("a", F.col("split") * length_dm)
    return each.groupBy("track_id", "split").agg(F.sum(own).alias("distance_dm"), F.sum(F.floor(F.col("dur_us") / F.col("dm") * own)).alias("time_us"))


def effort(rows: DataFrame) -> DataFrame:
    """Moving time, work by the trapezoid rule, heart beats of the moving legs (AGG-06)."""
    s = F.col("dur_us")
    return rows.filter("moving").groupBy("track_id").agg(
        F.sum(s).alias("moving_us"), F.sum((F.col("pwr") + F.col("pwr0")) * s).alias("double_work_uj"),
        F.sum(F.col("hr") * s).alias("beat_us_minutes"), F.max("pwr").alias("max_power"),
    )


def zones(rows: DataFrame, value: str, most: int, percents: tuple[int, ...]) -> DataFrame:
    """Ridden time by zone of ``value`` against ``most``, in integers (AGG-07)."""
    zone = sum(((F.col(value) * 100 >= most * p).cast("int") for p in percents), F.lit(1))
    return rows.filter(F.col("ridden") & F.col(value).isNotNull()).groupBy("track_id", zone.alias("zone")).agg(F.sum("dur_us").alias("time_us"))


def repeated_share(points: DataFrame) -> DataFrame:
    """Length ridden over segments already used, by undirected keys of four decimals; steps inside one key are left out (AGG-14)."""
    key = lambda a, b: F.struct(whole(F.col(a), 1e4), whole(F.col(b), 1e4))
    ends = points.select("track_id", "ts_us", "event_id", "dm", key("lat0", "lon0").alias("p"), key("lat", "lon").alias("q")).filter("dm IS NOT NULL AND p <> q")
    keyed = ends.select("*", F.least("p", "q").alias("lo"), F.greatest("p", "q").alias("hi"))
    nth = F.row_number().over(Window.partitionBy("track_id", "lo", "hi").orderBy("ts_us", "event_id"))
    return keyed.withColumn("nth", nth).groupBy("track_id").agg(F.sum("dm").alias("length_dm"), F.sum(F.when(F.col("nth") > 1, F.col("dm")).otherwise(0)).alias("repeated_dm"))


def smoothed(points: DataFrame, width: int = 5) -> DataFrame:
    """Moving mean of the elevation, truncated at the ends (WIN-05)."""
    frame = in_time().rowsBetween(-(width // 2), width // 2)
    return points.select("track_id", "event_id", whole(F.sum("ele").over(frame) * 1000 / F.count("ele").over(frame)).alias("mean_mm"))


def runs(rows: DataFrame) -> DataFrame:
    """Neighbouring fixes of one kind become one run (WIN-11)."""
    new = F.sum(F.when(F.col("kind0").eqNullSafe(F.col("kind")), 0).otherwise(1)).over(in_time())
    return rows.withColumn("run", new).groupBy("track_id", "run", "kind").agg(F.count("*").alias("n_points"), F.min("ts_us").alias("from_us"), F.max("ts_us").alias("to_us"))


def thinned(points: DataFrame, stride: int) -> DataFrame:
    """Every ``stride``-th fix and the last one (WIN-14)."""
    n = F.row_number().over(in_time())
    last = F.count("*").over(Window.partitionBy("track_id"))
    return points.select("track_id", "event_id", n.alias("n"), last.alias("last")).filter(((F.col("n") - 1) % stride == 0) | (F.col("n") == F.col("last"))).select("track_id", "event_id", "n")


#: Fixed value: a remainder shorter than this, in decimetres, belongs to the split before it.
SHORTEST_SPLIT_DM = 100


def climbed_steps(rows: DataFrame, hysteresis: int = ELEVATION_HYSTERESIS_M) -> DataFrame:
    """``(track_id, event_id, up_m, down_m)`` of the legs at whose end the anchor of the ascent moves (AGG-02).

    The anchor is a fold along each track that keeps one height; tracks come sorted. A leg that was not ridden sets it anew.
    """
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        track, anchor = object(), None
        for batch in batches:
            out = []
            for own, event, height, ridden in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if own != track:
                    track, anchor = own, None
                if height is None or height != height or height in (float("inf"), float("-inf")):
                    continue
                if anchor is None or not ridden:
                    anchor = height
                elif abs(height - anchor) >= hysteresis:
                    out.append((own, event, max(height - anchor, 0.0), max(anchor - height, 0.0)))
                    anchor = height
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.float64()))], names=["track_id", "event_id", "up_m", "down_m"])

    ordered = rows.select("track_id", "event_id", F.col("ele").cast("double").alias("ele"), "ridden", "ts_us").repartition("track_id").sortWithinPartitions("track_id", "ts_us", "event_id")
    return ordered.drop("ts_us").mapInArrow(run, "track_id bigint, event_id bigint, up_m double, down_m double")


def whole_splits(rows: DataFrame, length_dm: int) -> DataFrame:
    """``(track_id, split, distance_dm, moving_us, ascent_m, descent_m, partial)`` of each split of each ride (AGG-05).

    Distance and moving time of a leg over a boundary are cut in proportion; a step of the climb belongs to the split in which it
    ends. A last split of under 10 m is added to the one before. All splits are listed, empty ones too; ``partial``: the last
    one is not a whole one, to a metre.
    """
    along = F.coalesce(F.sum(F.when(F.col("ridden"), F.col("dm"))).over(in_time()), F.lit(0))
    placed = rows.withColumn("b", along)
    legs_ = placed.filter("ridden AND dm > 0").withColumn("a", F.col("b") - F.col("dm"))
    each = legs_.withColumn("split", F.explode(F.sequence(F.floor(F.col("a") / length_dm), F.floor((F.col("b") - 1) / length_dm))))
    own = F.least("b", (F.col("split") + 1) * length_dm) - F.greatest("a", F.col("split") * length_dm)
    time = F.when(F.col("moving"), F.floor(F.col("dur_us") * own / F.col("dm") + 0.5).cast("long")).otherwise(F.lit(0))
    none = [F.lit(0.0).alias("up_m"), F.lit(0.0).alias("down_m")]
    cut = each.select("track_id", "split", own.alias("dm"), time.alias("us"), *none)
    steps = placed.select("track_id", "event_id", "b").join(climbed_steps(rows), ["track_id", "event_id"])
    cut = cut.unionByName(steps.select("track_id", F.floor(F.col("b") / length_dm).alias("split"), F.lit(0).cast("long").alias("dm"), F.lit(0).cast("long").alias("us"), "up_m", "down_m"))
    found = cut.groupBy("track_id", "split").agg(F.sum("dm").alias("dm"), F.sum("us").alias("us"), F.sum("up_m").alias("up"), F.sum("down_m").alias("down"))
    ends = found.groupBy("track_id").agg(F.max("split").alias("last"), F.max_by("dm", "split").alias("tail"))
    folded = (F.col("last") > 0) & (F.col("tail") < SHORTEST_SPLIT_DM)
    ends = ends.select("track_id", (F.col("last") - folded.cast("int")).alias("last"))
    held = found.join(ends, "track_id").groupBy("track_id", F.least("split", "last").alias("split")).agg(*[F.sum(c).alias(c) for c in ("dm", "us", "up", "down")])
    every = ends.select("track_id", "last", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("split"))
    listed = every.join(held, ["track_id", "split"], "left").fillna(0, ["dm", "us", "up", "down"])
    partial = (F.col("split") == F.col("last")) & (F.col("dm") < length_dm - 10)
    return listed.select("track_id", "split", F.col("dm").alias("distance_dm"), F.col("us").alias("moving_us"), F.col("up").alias("ascent_m"), F.col("down").alias("descent_m"), partial.alias("partial"))
