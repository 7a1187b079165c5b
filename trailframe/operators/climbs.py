"""Climbs of tracks: where the road ahead is steep enough to begin one, where each ends, and how it was ridden (WIN-08, SRT-08)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of a climb: look-ahead in decimetres, grade in percent, drop that ends it, slack of its top, least length and ascent.
WINDOW_DM = 1000
GRADE_PERCENT = 3
END_DROP_M = 10
TOP_SLACK_M = 0.5
LEAST_LENGTH_DM = 3000
LEAST_ASCENT_M = 20


def heights(legs: DataFrame) -> DataFrame:
    """Fixes of ``legs`` with ``along_dm`` and the height gained so far over ridden road, ``up`` (a leg without both heights is level)."""
    by = Window.partitionBy("track_id").orderBy("ts_us", "event_id")
    so_far = by.rowsBetween(Window.unboundedPreceding, 0)
    rise = F.when(F.col("ridden"), F.col("ele") - F.col("ele0"))
    return legs.select(
        "*", F.coalesce(F.sum(F.when(F.col("ridden"), F.col("dm"))).over(so_far), F.lit(0)).alias("along_dm"), F.coalesce(F.sum(rise).over(so_far), F.lit(0)).alias("up"), F.row_number().over(by).alias("nth"),
    )


def steep_ahead(fixes: DataFrame) -> DataFrame:
    """``fixes`` with ``steep``: whether the road up to the first fix a window ahead rises enough; false without such a fix.

    The fix ahead is the last one seen when all fixes and all wanted distances are gone through from the far end, so a row
    costs no more than the sort.
    """
    wanted = fixes.select("track_id", "nth", (F.col("along_dm") + WINDOW_DM).alias("d"), F.lit(None).cast("struct<d: bigint, up: double>").alias("fix"))
    seen = fixes.select("track_id", "nth", F.col("along_dm").alias("d"), F.struct(F.col("along_dm").alias("d"), F.col("up").cast("double").alias("up")).alias("fix"))
    back = Window.partitionBy("track_id").orderBy(F.desc("d"), F.expr("fix IS NULL"), F.desc("nth")).rowsBetween(Window.unboundedPreceding, 0)
    met = seen.unionByName(wanted).withColumn("ahead", F.last("fix", ignorenulls=True).over(back)).filter("fix IS NULL").select("track_id", "nth", "ahead")
    joined = fixes.join(met, ["track_id", "nth"])
    rises = (F.col("ahead.up") - F.col("up")) * 1000 >= GRADE_PERCENT * (F.col("ahead.d") - F.col("along_dm"))
    return joined.withColumn("steep", F.coalesce(rises, F.lit(False))).drop("ahead")


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(track, fix, climb) of the fixes from the foot to the top of each climb. Holds the fixes of the climb at hand."""
    held: list[tuple[int, float, bool]] = []
    high = climb = 0
    track, out = None, []

    def ended(last: bool) -> None:
        """Write the climb that begins at the first held fix if it is one, and go through what lies beyond its high point again."""
        nonlocal held, high, climb
        while held and (last or held[high][1] - held[-1][1] > END_DROP_M):
            top = next(i for i, x in enumerate(held) if x[1] >= held[high][1] - TOP_SLACK_M)
            out.extend((track, nth, climb) for nth, _, _ in held[: top + 1])
            rest, held, high, climb = held[high + 1 :], [], 0, climb + 1
            for x in rest:
                took(x)
            if not last:
                return

    def took(fix: tuple[int, float, bool]) -> None:
        nonlocal high
        if not held and not fix[2]:
            return
        held.append(fix)
        if fix[1] > held[high][1]:
            high = len(held) - 1
        ended(False)

    def written() -> pa.RecordBatch:
        nonlocal out
        columns = [pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int32()))]
        out = []
        return pa.RecordBatch.from_arrays(columns, names=["track_id", "nth", "climb"])

    for batch in batches:
        for t, *fix in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if t != track:
                ended(True)
                track, climb = t, 0
            took(tuple(fix))
        yield written()
    ended(True)
    yield written()


def climbs(legs: DataFrame) -> DataFrame:
    """A row a climb: ``(track_id, climb, start_dm, length_dm, ascent_m, grade_pm, moving_us, avg_hr, avg_power)`` (WIN-08).

    A climb begins where the next 100 m rise by 3 % and runs to its high point, known once the road has dropped 10 m below it;
    it is listed if it is 300 m long, gains 20 m and averages 3 %. ``grade_pm`` is the steepest window within it in
    thousandths. Heart rate and power are means by time over its moving legs, read at their starts. ``climb`` counts from 1.
    """
    fixes = steep_ahead(heights(legs))
    laid = fixes.select("track_id", "nth", F.col("up").cast("double").alias("up"), "steep").repartition("track_id").sortWithinPartitions("track_id", "nth")
    members = laid.mapInArrow(_fold, "track_id bigint, nth int, climb int")
    within = fixes.join(members, ["track_id", "nth"])
    by = Window.partitionBy("track_id", "climb").orderBy("nth")
    # a leg belongs to a climb if both its ends do; sensors are read at its start
    inner = within.select("*", F.lag("hr").over(by).alias("hr_at"), F.lag("pwr").over(by).alias("pwr_at"), F.lag("nth").over(by).isNotNull().alias("leg"))
    moving = F.col("leg") & F.col("moving")
    mean = lambda c: F.floor(F.sum(F.when(moving, F.col(c) * F.col("dur_us"))) / F.sum(F.when(moving & F.col(c).isNotNull(), F.col("dur_us"))) + 0.5).cast("int")
    steepest = _steepest(within)
    found = inner.groupBy("track_id", "climb").agg(
        F.min("along_dm").alias("start_dm"), (F.max("along_dm") - F.min("along_dm")).alias("length_dm"), (F.max_by("up", "nth") - F.min_by("up", "nth")).alias("ascent_m"),
        F.coalesce(F.sum(F.when(moving, F.col("dur_us"))), F.lit(0)).alias("moving_us"), mean("hr_at").alias("avg_hr"), mean("pwr_at").alias("avg_power"),
    )
    listed = found.filter((F.col("length_dm") >= LEAST_LENGTH_DM) & (F.col("ascent_m") >= LEAST_ASCENT_M) & (F.col("ascent_m") * 1000 >= GRADE_PERCENT * F.col("length_dm")))
    whole = F.floor(F.col("ascent_m") * 10000 / F.col("length_dm") + 0.5).cast("long")
    listed = listed.join(steepest, ["track_id", "climb"], "left").withColumn("grade_pm", F.coalesce("grade_pm", whole))
    number = F.row_number().over(Window.partitionBy("track_id").orderBy("climb")).alias("climb")
    return listed.select("track_id", number, "start_dm", "length_dm", "ascent_m", "grade_pm", "moving_us", "avg_hr", "avg_power")


def _steepest(within: DataFrame) -> DataFrame:
    """``(track_id, climb, grade_pm)``: the steepest window from a fix of a climb to the first one a window ahead that is on it."""
    rows = within.select("track_id", "climb", "nth", "along_dm", F.col("up").cast("double").alias("up"))
    wanted = rows.withColumn("d", F.col("along_dm") + WINDOW_DM).withColumn("fix", F.lit(None).cast("struct<d: bigint, up: double>"))
    seen = rows.withColumn("d", F.col("along_dm")).withColumn("fix", F.struct(F.col("along_dm").alias("d"), "up"))
    back = Window.partitionBy("track_id", "climb").orderBy(F.desc("d"), F.expr("fix IS NULL"), F.desc("nth")).rowsBetween(Window.unboundedPreceding, 0)
    met = seen.unionByName(wanted).withColumn("ahead", F.last("fix", ignorenulls=True).over(back)).filter("fix IS NULL AND ahead IS NOT NULL")
    grade = F.floor((F.col("ahead.up") - F.col("up")) * 10000 / (F.col("ahead.d") - F.col("along_dm")) + 0.5).cast("long")
    return met.groupBy("track_id", "climb").agg(F.max(grade).alias("grade_pm"))


def biggest(found: DataFrame, most: int) -> DataFrame:
    """The ``most`` climbs of each track with the greatest ascent (the earlier of equals), numbered in riding order (SRT-08)."""
    rank = F.row_number().over(Window.partitionBy("track_id").orderBy(F.desc("ascent_m"), "start_dm"))
    kept = found.withColumn("rank", rank).filter(F.col("rank") <= most)
    return kept.withColumn("nth", F.row_number().over(Window.partitionBy("track_id").orderBy("start_dm")))
