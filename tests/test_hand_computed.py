"""Operators on small tables whose answers are worked out by hand."""

from trailframe.operators import places as P
from trailframe.operators import tracks as T

POINT = "track_id long, ts_us long, event_id long, kind string, lat double, lon double, ele double, hr int, pwr int"


def points(spark, rows):
    return spark.createDataFrame([(1, s * 1_000_000, i, "a", la, lo, e, 90, 10) for i, (s, la, lo, e) in enumerate(rows)], POINT)


def test_out_and_back_is_half_repeated(spark):
    # 0 -> 1 -> 2 -> 1 -> 0 along a meridian, with one step inside a key
    lats = (0.0, 0.01, 0.02, 0.02000001, 0.01, 0.0)
    rows = T.legs(points(spark, [(600 * i, la, 0.0, 0.0) for i, la in enumerate(lats)]), 10**12)
    r = T.repeated_share(rows).first()
    assert (r.length_dm, r.repeated_dm) == (4 * 11120, 2 * 11120)


def test_heights_are_not_rounded_before_the_hysteresis(spark):
    r = T.elevation_gain(points(spark, [(0, 0.0, 0.0, 0.9), (1, 0.0, 0.0, 3.1), (2, 0.0, 0.0, float("nan")), (3, 0.0, 0.0, 3.9), (4, 0.0, 0.0, None), (5, 0.0, 0.0, 0.5)])).first()
    assert (r.ascent_m, r.descent_m) == (3.0, 3.4)


def test_kinds_take_turns_by_the_same_order(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 9), ("b", 8), ("b", 7), ("c", 3)], "kind string, importance int")
    found = [(r.kind, r.importance) for r in P.taking_turns(rows, "kind", rows.importance.desc(), limit=4).collect()]
    assert found == [("a", 9), ("b", 8), ("c", 3), ("b", 7)]


def test_nearest_is_measured_in_metres_at_its_latitude(spark):
    # at 60 degrees north 0.03 degrees of longitude are 1,670 m, 0.02 of latitude 2,226 m
    left = spark.createDataFrame([(1, 600000000, 100000000)], "id long, lat_e7 long, lon_e7 long")
    right = spark.createDataFrame([(2, 600200000, 100000000), (3, 600000000, 100300000), (1, 600000000, 100000000)], "id long, lat_e7 long, lon_e7 long")
    assert [tuple(r) for r in P.nearest_within(left, right, 2500).collect()] == [(1, 3, 1669800)]


def test_power_on_a_grid_of_seconds(spark):
    from trailframe.operators import readings as R

    # a gap of 5 s is held, one of 6 s starts a new series
    rows = [(1, s, 200) for s in range(0, 31, 5)] + [(1, 36 + s, 100) for s in range(10)]
    grid = R.power_grid(spark.createDataFrame(rows, "track_id long, at_s long, watts int"))
    assert [(r.series, r.n) for r in grid.groupBy("series").count().withColumnRenamed("count", "n").orderBy("series").collect()] == [(0, 31), (1, 10)]
    assert [r.watts for r in R.normalised_power(grid).collect()] == [200]
    assert [(r.best_w, r.threshold_w) for r in R.best_power(grid, 30).collect()] == [(200, 190)]
    assert R.best_power(grid, 40).count() == 0


def test_counters_wrap(spark):
    from trailframe.operators import readings as R

    frames = spark.createDataFrame([(1, 0, 65530, 65000), (1, 1, 4, 464), (1, 2, 4, 464)], "source long, ts_us long, wheel long, at long")
    assert [(r.steps, r.ticks) for r in R.counted(frames, "wheel", "at").orderBy("ts_us").collect()] == [(None, None), (10, 1000), (0, 0)]


def test_of_two_samples_as_near_the_later_is_attached(spark):
    from trailframe.operators import readings as R

    fixes = spark.createDataFrame([(1, 7, 100)], "track_id long, id long, s long")
    samples = spark.createDataFrame([(1, 90, 1), (1, 110, 2), (1, 131, 3), (2, 100, 4)], "track_id long, s long, value long")
    assert [r.value for r in R.attached(fixes, samples).collect()] == [2]


def test_sources_that_fall_silent_give_way(spark):
    from trailframe.operators import readings as R

    rows = [("hr", 1, 9, 0, 150), ("hr", 2, 1, 9_000_000, 140), ("cad", 3, 5, 1_000_000, 80), ("cad", 4, 5, 2_000_000, 81)]
    r = spark.createDataFrame([(1, *x) for x in rows], "ride_id long, kind string, source_id long, priority long, ts_us long, value long")
    assert {(x.kind, x.value) for x in R.fused(r, 10_000_000).collect()} == {("hr", 150), ("cad", 81)}
    assert {(x.kind, x.value) for x in R.fused(r, 10_001_000).collect()} == {("hr", 140), ("cad", 81)}


def test_scalars(spark):
    from pyspark.sql import functions as F
    from trailframe.functions import scalars as S

    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first().x
    assert value(S.tags(F.lit(" a=b=c bare  a=d "))) == {"a": "d", "bare": ""} and value(S.tags(F.lit(None).cast("string"))) == {}
    assert [value(S.gradient_class(F.lit(x))) for x in (-3, 2.9, 3, 6, 10)] == ["descent", "flat", "moderate", "steep", "verySteep"]
    assert [value(S.rain_class(F.lit(x))) for x in (0.05, 0.1, 200.0)] == [0, 1, 15]
    assert [value(S.duration_hours(F.lit(x))) for x in ("PT1H", "P1DT6H", "PT90M", "PT20M", "P1Y", "PT", "P", "P1W")] == [1, 30, 2, None, None, None, None, 168]
    assert value(S.nanos(F.lit("-0.9999999995"))) == -1_000_000_000 and value(S.nanos(F.lit("3.99"))) == 3_990_000_000 and value(S.nanos(F.lit("1."))) is None
    assert [value(S.file_name(F.lit(x))) for x in ("..", "a/b\tc ", "x" * 99)] == ["track", "a_b c", "x" * 80]
    rise, down, whole_day = S.sun_times(F.lit("2024-06-21").cast("date"), F.lit(51.5), F.lit(0.0))
    assert abs(value(rise) - 1718941380) < 300 and abs(value(down) - 1719001260) < 300 and value(whole_day) is False
    assert value(S.sun_times(F.lit("2024-06-21").cast("date"), F.lit(80.0), F.lit(0.0))[2]) is True
    formats = [b'<?xml version="1.0"?><gpx>', b"\x0e1234567.FIT", b"<TrainingCenterDatabase>", b'{"gpx":1}', b""]
    assert [value(S.track_format(F.lit(x))) for x in formats] == ["gpx", "fit", "tcx", None, None]


def test_gpx_of_other_programs(spark):
    from trailframe.sources import track_files as G

    odd = '''<?xml version="1.0"?>\n<g:gpx xmlns:g="x"><g:trk><g:trkseg><g:trkpt lat="1.5" lon="-2"><g:time>2024-01-01T00:00:00Z</g:time><g:extensions><y:TrackPointExtension><y:hr>99</y:hr></y:TrackPointExtension>
      </g:extensions></g:trkpt><g:trkpt lat="1.6" lon="-2"/></g:trkseg></g:trk><g:trk><g:trkseg><g:trkpt lat="3" lon="4"><ele>7</ele><extensions><power>0</power></extensions></g:trkpt></g:trkseg></g:trk>
      <g:rte><g:rtept lat="5" lon="6"/></g:rte></g:gpx>'''
    files = spark.createDataFrame([("a", odd.encode()), ("b", b'{"gpx": 1}'), ("c", b""), ("d", None)], "path string, content binary")
    found = sorted((r.form, r.line, r.seq, r.lat, r.hr, r.pwr, r.ele) for r in G.read_gpx(files).collect())
    assert found == [("route", 0, 0, 5.0, None, None, None), ("track", 0, 0, 1.5, 99, None, None), ("track", 0, 1, 1.6, None, None, None), ("track", 1, 0, 3.0, None, 0, 7.0)]


def test_packed_tracks_of_both_versions_and_torn_ends(spark):
    import numpy as np
    from trailframe.sources import track_files as G

    old = np.zeros(1, G.PACKED_BEFORE)
    old["lat"], old["ele"] = 3.0, np.nan
    whole = np.zeros(2, G.PACKED)
    whole["hr"] = (0, G.ABSENT)
    blobs = [(1, b"\1" + old.tobytes()), (2, b"\2" + whole.tobytes()[:-1]), (3, b"\2" + whole.tobytes() + b"torn"), (4, b"\7"), (5, b""), (6, None)]
    found = G.unpacked_tracks(spark.createDataFrame(blobs, "track_id long, packed binary")).orderBy("track_id", "seq").collect()
    assert [(r.track_id, r.seq, r.lat, r.ele, r.hr) for r in found] == [(1, 0, 3.0, None, None), (2, 0, 0.0, 0.0, 0), (3, 0, 0.0, 0.0, 0), (3, 1, 0.0, 0.0, None)]


def test_tracks_longer_than_batches_are_packed_without_gathering_their_points(spark, monkeypatch):
    from pyspark.sql import functions as F
    from trailframe.sources import track_files as G

    none = lambda kind: F.lit(None).cast(kind)
    points = spark.range(25_000).select((F.col("id") % 3).alias("track_id"), (25_000 - F.col("id")).cast("int").alias("seq"), F.col("id").cast("double").alias("lat"), none("double").alias("lon"))
    points = points.select("*", *[none(kind).alias(n) for n, kind in (x.split() for x in G.POINT.split(", ")) if n not in ("seq", "lat", "lon")])
    packed = G.packed_tracks(points)
    assert "collect_list" not in packed._jdf.queryExecution().executedPlan().toString()
    assert {r.track_id: r.n for r in packed.select("track_id", G.packed_points(F.col("packed")).alias("n")).collect()} == {0: 8334, 1: 8333, 2: 8333}
    monkeypatch.setattr(G, "BATCH_BYTES", 50_000)  # several slices of one track, and several tracks to a batch
    found = sorted((r.track_id, r.seq, r.lat, r.hr) for r in G.unpacked_tracks(packed).collect())
    assert found == [(t, i, float(v), None) for t in range(3) for i, v in enumerate(sorted((v for v in range(25_000) if v % 3 == t), reverse=True))]


def test_waypoints_and_tracks_before_routes(spark):
    from trailframe.sources import track_files as G

    both = '<gpx><wpt lat="1" lon="2"><name>Tap</name><sym>Water</sym><ele>5</ele></wpt><wpt lat="3"/><rte><rtept lat="5" lon="6"/></rte><trk><trkseg><trkpt lat="7" lon="8"/></trkseg></trk></gpx>'
    files = spark.createDataFrame([("a", both.encode()), ("b", b'<gpx><rte><rtept lat="5" lon="6"/></rte></gpx>')], "path string, content binary")
    assert [(r.path, r.nth, r.name, r.sym, r.type, r.lat, r.lon, r.ele) for r in G.read_waypoints(files).collect()] == [("a", 0, "Tap", "Water", None, 1.0, 2.0, 5.0)]
    assert sorted((r.path, r.form, r.lat) for r in G.preferred(G.read_gpx(files)).collect()) == [("a", "track", 7.0), ("b", "route", 5.0)]


def test_points_appended_to_packed_tracks(spark):
    from pyspark.sql import functions as F
    import numpy as np
    from trailframe.sources import track_files as G

    old, new = np.zeros(1, G.PACKED_BEFORE), np.zeros(2, G.PACKED)
    old["lat"], new["lat"] = 3.0, (1.0, 2.0)
    held = spark.createDataFrame([(1, b"\1" + old.tobytes()), (2, b"\2" + new.tobytes() + b"torn"), (3, b"\2" + new.tobytes()), (5, b"\7"), (6, None)], "track_id long, packed binary")
    more = spark.createDataFrame([(k, 0, 9.0 + k) for k in (1, 2, 4)], "track_id long, seq int, lat double")
    for name in ("lon", "ele", "time_ms", "speed", "accuracy", "hr", "cad", "pwr"):
        kind = dict(x.split() for x in G.POINT.split(", "))[name]
        more = more.withColumn(name, F.lit(None).cast(kind))
    found = G.unpacked_tracks(G.appended(held, more))
    assert sorted((r.track_id, r.seq, r.lat) for r in found.collect()) == [(1, 0, 3.0), (1, 1, 10.0), (2, 0, 1.0), (2, 1, 2.0), (2, 2, 11.0), (3, 0, 1.0), (3, 1, 2.0), (4, 0, 13.0)]
    assert {r.track_id: r.n for r in held.select("track_id", G.packed_points(F.col("packed")).alias("n")).collect()} == {1: 1, 2: 2, 3: 2, 5: None, 6: None}
