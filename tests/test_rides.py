"""The recorder and the route guard: scenes worked out by hand, and streams, also restarted ones, against whole tables."""

import pytest
from pyspark.sql import functions as F

from trailframe.streaming import rides

S = rides.SECOND
DEGREE_M = 111194.9266  # metres of a degree on the sphere
EVENT = "ride_id long, s double, seq long, what string, lat double, lon double, speed double"
FIX = "ride_id long, s double, seq long, what string, lat double, lon double, accuracy double, mode string, drift double, target double"


def north(m):
    return m / DEGREE_M


def events(spark, rows, schema):
    df = spark.createDataFrame(rows, schema)
    return df.withColumn("at", (F.lit(1_000_000) + F.col("s")).cast("timestamp")).drop("s")


def ride(ride_id, *steps):
    return [(ride_id, float(s), i, what, None if m is None else north(m), 0.0 if m is not None else None, None) for i, (s, what, m) in enumerate(steps)]


STAND = ride(1, (0, "fix", 0), (5, "fix", 25), (10, "fix", 50), (12, "fix", 50), (25, "fix", 50.2), (26, "fix", 56), (27, "fix", 62))
MANUAL = ride(2, (0, "fix", 0), (2, "fix", 10), (3, "pause", None), (4, "fix", 30), (40, "resume", None), (41, "fix", 60), (42, "fix", 65), (43, "stop", None), (44, "fix", 70))
#: a jump of 5 km, two fixes of one second, and one without a position
ODD = ride(3, (0, "fix", 0), (1, "fix", 5000), (2, "fix", 10), (2, "fix", 12), (1, "fix", 9), (3, "fix", None), (4, "fix", 20))


def told(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.ride_id, []).append((r.at_us / S - 1_000_000, r.what, round(r.distance_mm / 1000, 1), r.moving_us / S, r.n_fixes))
    return {k: sorted(v) for k, v in out.items()}


def test_standing_still_pauses_and_moving_resumes(spark):
    got = told(rides.recorded(events(spark, STAND, EVENT)))[1]
    # moved last at 10 s, so the clock pauses at 20 s; the fix of 25 s is kept but slow, that of 26 s moves
    assert [(s, what) for s, what, *_ in got] == [(0, "fix"), (5, "fix"), (10, "fix"), (12, "fix"), (20, "auto-paused"), (25, "fix"), (26, "fix"), (26, "resumed"), (27, "fix")]
    assert got[-1][2:] == (62.0, 12.0, 7)


def test_a_rider_who_pauses_loses_fixes_and_the_leg_across(spark):
    got = told(rides.recorded(events(spark, MANUAL, EVENT)))[2]
    assert [(s, what) for s, what, *_ in got] == [(0, "fix"), (2, "fix"), (3, "paused"), (40, "resumed"), (41, "fix"), (42, "fix"), (43, "stopped")]
    assert got[-1][2:] == (15.0, 3.0, 4)  # 10 m and 5 m; 39 s lie between the fixes around the pause


def test_jumps_and_fixes_back_in_time_are_dropped(spark):
    got = told(rides.recorded(events(spark, ODD, EVENT)))[3]
    assert [s for s, what, *_ in got if what == "fix"] == [0, 1, 2, 4] and got[-1][2] == 20.0  # of the fixes at 1 s and 2 s one each


def test_rides_of_one_task_are_folded_one_after_the_other_in_batches(spark):
    df = events(spark, [*STAND, *MANUAL, *ODD, *ride(4, (0, "fix", 0), (1, "fix", 5))], EVENT)
    whole = told(rides.recorded(df, until_us=(1_000_000 + 60) * S))
    for key, own in ((1, STAND), (2, MANUAL), (3, ODD)):
        assert whole[key] == told(rides.recorded(events(spark, own, EVENT), until_us=(1_000_000 + 60) * S))[key]
    assert (14, "auto-paused") in [x[:2] for x in whole[3]] and whole[4][-1][:2] == (11, "auto-paused")
    asked = rides.recorded(df)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in asked and "FlatMapGroups" not in asked  # a group a ride costs a frame a ride


def test_the_clock_after_the_last_event(spark):
    df = events(spark, ride(4, (0, "fix", 0), (1, "fix", 5)), EVENT)
    assert len(told(rides.recorded(df))[4]) == 2
    assert told(rides.recorded(df, until_us=(1_000_000 + 11) * S))[4][-1][:2] == (11, "auto-paused")


def all_rides(n=6):
    rows = STAND + MANUAL + ODD
    for k in range(10, 10 + n):
        rows += ride(k, *[(t * (1 + k % 3), "fix", t * (k % 5)) for t in range(40)])
    return rows


def stream_of(spark, frames, build, tmp_path, name, stop_after=None):
    """Run ``build`` on files one a batch; with ``stop_after``, in two runs of the query from one checkpoint."""
    source, sink, state = (str(tmp_path / f"{name}-{x}") for x in ("in", "out", "state"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = frames[0].schema

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        query = build(stream).writeStream.format("parquet").option("path", sink).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination(300)
        assert query.exception() is None

    for i, frame in enumerate(frames):
        frame.coalesce(1).write.mode("append").parquet(source)
        if stop_after is not None and i + 1 == stop_after:
            run()
    run()
    return spark.read.parquet(sink)


def in_batches(df, n):
    lo, hi = df.agg(F.min("at"), F.max(F.col("at") + F.expr("interval 1 second"))).first()
    at = F.floor((F.unix_micros("at") - int(lo.timestamp() * S)) * n / (int(hi.timestamp() * S) - int(lo.timestamp() * S)))
    return [df.filter(at == i) for i in range(n)]


@pytest.mark.parametrize("stop_after", [None, 2])
def test_recording_a_stream(spark, tmp_path, stop_after):
    df = events(spark, all_rides(), EVENT).cache()
    # the rows of ODD that go back in time lie in one batch with what they follow
    whole = told(rides.recorded(df))
    found = told(stream_of(spark, in_batches(df, 4), lambda d: rides.record(d, "0 seconds"), tmp_path, f"rec{stop_after}", stop_after))
    last = df.agg(F.max("at")).first()[0].timestamp() - 1_000_000
    for k, rows in whole.items():
        extra = [r for r in found[k] if r not in rows]
        assert [r for r in found[k] if r in rows] == rows
        assert all(r[1] == "auto-paused" and r[0] <= last for r in extra) and len(extra) <= 1  # by the clock, after the last event
    assert any(len(found[k]) > len(whole[k]) for k in whole)


LINE = [north(50.0 * i) for i in range(101)]  # 5 km to the north


def routes(spark):
    rows = [(k, LINE, [0.0] * len(LINE)) for k in range(1, 9)]
    # a loop of four sides of 1 km, a point each 100 m
    side = [(0, i * 100) for i in range(10)] + [(i * 100, 1000) for i in range(10)] + [(1000, 1000 - i * 100) for i in range(10)] + [(1000 - i * 100, 0) for i in range(11)]
    rows.append((20, [north(n) for _, n in side], [north(e) for e, _ in side]))
    return spark.createDataFrame(rows, "ride_id long, lats array<double>, lons array<double>")


def path(ride_id, *steps, mode="guide"):
    """(second, metres east, metres north[, accuracy]) or (second, 'detour', target)."""
    out = []
    for i, step in enumerate(steps):
        if step[1] == "detour":
            out.append((ride_id, float(step[0]), i, "detour", north(step[3]), north(step[2]), None, mode, None, float(step[4])))
        else:
            out.append((ride_id, float(step[0]), i, "fix", north(step[2]), north(step[1]), float(step[3]) if len(step) > 3 and step[3] is not None else None, mode, float(step[4]) if len(step) > 4 else None, None))
    return out


SCENES = [
    *path(1, (0, 0, 0), (1, 90, 10), (2, 5, 20), (3, 0, 30)),  # one stray
    *path(2, (0, 0, 0), (1, 90, 10), (2, 95, 20), (3, 60, 30), (4, 20, 40)),  # two strays, not back at 60 m, back at 20 m
    *path(3, (0, 0, 0), (10, 80, 10), (18, 81, 20)),  # straying for 8 s
    *path(4, (0, 0, 100), *[(t, 100, 100) for t in range(1, 60)]),  # standing off the route: a detour after 45 s
    *path(5, (0, 0, 100), *[(t, 40 * t, 100) for t in range(1, 30)]),  # far off: a detour once 15 s have passed; said again 300 m on
    *path(6, (0, 0, 0), (1, 120, 10, 80), (2, 130, 20, 80), (3, 170, 30, 80), (4, 180, 30, 80), (5, 75, 30, 80)),  # a poor fix widens both bounds
    *path(7, (0, 0, 100), (1, 100, 110), (2, 110, 120), (3, "detour", 110, 120, 800), (10, 120, 200, None, 90), (24, 130, 300, None, 90), (30, 400, 500, None, 90), (40, 350, 900, None, 10), (50, 10, 900)),
    *path(8, (0, 0, 0), (1, 200, 10), (2, 210, 20), *[(t, 210, 20) for t in range(3, 80)], mode="off"),
    *path(20, (0, 0, 0), (60, 0, 300), (120, 0, 900), (180, 300, 1000), (300, 1000, 500), (400, 300, 3), (420, 40, -3), (440, 3, 30)),
    *path(99, (0, 0, 0)),  # no route
]


def states(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.ride_id, r.at_us)):
        out.setdefault(r.ride_id, []).append((r.at_us // S - 1_000_000, r.state, r.speak, r.plan_detour, r.restored, r.away_dm, r.along_dm, r.guide_dm))
    return out


@pytest.fixture(scope="module")
def scenes(spark):
    return events(spark, SCENES, FIX).cache()


def test_scenes_of_the_guard(spark, scenes):
    got = states(rides.followed(scenes, routes(spark)))
    assert set(got) == {1, 2, 3, 4, 5, 6, 7, 8, 20}
    assert [x[1] for x in got[1]] == ["on"] * 4
    assert [x[1:5] for x in got[2]] == [("on", False, False, False), ("on", False, False, False), ("guiding", True, False, False), ("guiding", False, False, False), ("on", False, False, True)]
    assert [x[1] for x in got[3]] == ["on", "on", "guiding"]
    assert [x[0] for x in got[4] if x[3]][0] == 2 + 45  # off the route since its second stray
    assert [x[0] for x in got[5] if x[3]][0] == 3 + 15 and [x[0] for x in got[5] if x[2]] == [3, 11, 19, 27]
    assert [x[1] for x in got[6]] == ["on", "on", "on", "on", "guiding", "on"]
    assert [(x[0], x[3]) for x in got[7] if x[1] == "detour"] == [(10, False), (24, False), (30, True), (40, True)] and got[7][-1][1] == "on"
    assert not any(x[3] for x in got[8]) and got[8][-1][1] == "guiding"


def test_a_loop_is_not_snapped_to_its_end(spark, scenes):
    got = states(rides.followed(scenes, routes(spark)))[20]
    assert [x[1] for x in got] == ["on"] * 8
    along = [x[6] / 10 for x in got]
    assert along[:5] == pytest.approx([0, 300, 900, 1300, 2500], abs=2) and along[5] == pytest.approx(3700, abs=2) and along[6] == pytest.approx(3960, abs=2)


@pytest.mark.parametrize("stop_after", [None, 1])
def test_following_a_stream(spark, scenes, tmp_path, stop_after):
    found = stream_of(spark, in_batches(scenes, 3), lambda d: rides.follow(d, routes(spark)), tmp_path, f"guard{stop_after}", stop_after)
    assert states(found) == states(rides.followed(scenes, routes(spark)))
