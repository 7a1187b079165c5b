"""Operators along routes against answers worked out by hand."""

from pyspark.sql import functions as F

from trailframe.functions import scalars as S
from trailframe.operators import routes as R


def test_an_alias_stands_for_its_row_with_the_best_rank(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    aliases = spark.createDataFrame([(10, 1), (11, 9), (2, 1)], "id long, ref_id long")
    hits = spark.createDataFrame([(1, 5), (10, 3), (11, 1), (12, 1), (2, 7)], "id long, rank long")
    # 11 names a row that is gone, 12 is nothing; 2 is a row itself, so its alias does not count
    assert sorted(map(tuple, R.resolved(hits, rows, aliases).collect())) == [(1, 3, "a"), (2, 7, "b")]


def test_of_equally_near_fixes_the_last_is_marked(spark):
    pois = spark.createDataFrame([(7, 0.0, 0.0), (8, 0.01, 0.0), (9, None, 0.0)], "id long, y double, x double")
    fixes = spark.createDataFrame([(1, 1, 1, 0.0001, 0.0), (1, 2, 2, 0.0001, 0.0), (1, 3, 3, 0.0006, 0.0), (1, 4, 4, None, None)], "track_id long, ts_us long, event_id long, lat double, lon double")
    assert [tuple(r) for r in R.marks(pois, fixes).collect()] == [(1, 7, 11120, 2)]


def test_grid_corners_without_a_value_are_left_out(spark):
    grid = spark.createDataFrame([(0, 0, 4.0), (1, 0, None), (0, 1, float("nan")), (1, 1, 8.0)], "col long, row long, value double")
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, 0.25, 0.0), (3, 1.0, 0.0), (4, 1.5, 0.0)], "id long, x double, y double")
    # 1: both known corners weigh the same; 2: only (0, 0); 3: lies on a corner without a value, so all four alike; 4: outside
    assert sorted(map(tuple, R.bilinear(points, grid, 2, 2).collect())) == [(1, 6.0), (2, 4.0), (3, 6.0), (4, None)]


def test_streets_keep_the_order_of_their_aliases(spark):
    ways = [(1, "s", None, 0, 0, ["b", "a"]), (2, "s", None, 20, 40, ["a", "c"]), (3, "s", 0, 0, 0, None), (4, "s", None, 2_000_000, 0, []), (5, "s", -1, 0, 0, ["z"])]
    df = spark.createDataFrame(ways, "seq long, name string, place_id long, lat_e7 long, lon_e7 long, alts array<string>")
    got = sorted(map(tuple, R.merged_streets(df).collect()))
    assert got == [(1, "s", None, 10, 20, ["b", "a", "c"]), (3, "s", 0, 0, 0, []), (4, "s", None, 2_000_000, 0, []), (5, "s", -1, 0, 0, ["z"])]


def test_weather_counts_half_the_way_to_each_neighbour(spark):
    rows = [(1, 0, 0, 0, "headwind", 5, 9, 0, False), (1, 1, 100, 10, "tailwind", 3, 12, 30, True), (1, 2, 400, 30, None, 1, 99, 500, True), (2, 0, 50, 0, "calm", None, None, 0, False)]
    df = spark.createDataFrame(rows, "ride_id long, seq long, along_m long, minute long, wind string, temp long, gust long, mm100 long, wet boolean")
    # doubled ways 100, 400, 300; the sample without weather counts for the whole way only; 30 hundredths for 15 minutes
    summary = {r.ride_id: r for r in R.weather_summary(df).collect()}
    assert tuple(summary[1]) == (1, 125, 500, 0, 0, 3, 5, 100, 12, 450)
    assert tuple(summary[2]) == (2, 0, 0, 0, 0, None, None, None, None, 0)
    digest = {r.ride_id: tuple(r)[1:] for r in R.weather_digest(df, 100).collect()}
    assert digest == {1: ("tailwind", 100, True, 12), 2: ("calm", None, None, None)}


def test_parts_of_the_way_take_turns(spark):
    items = [(1, 0, "a", 9), (1, 1, "a", 8), (1, 2, "b", 1), (1, 99, "a", 2), (1, 98, "a", 3), (1, 3, "a", 7)]
    df = spark.createDataFrame(items, "route long, along long, kind string, size long")
    got = R.spread(df, "route", "along", 100, "kind", [F.desc("size")], 5).orderBy("chosen")
    # the first part gives 9, then the other kind's 1, then 8; the second 3, then 2
    assert [r["size"] for r in got.collect()] == [9, 3, 1, 2, 8]


def test_positions_between_and_beyond_points(spark):
    line = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.0), (1, 1, 10.0, 1.0, 2.0), (1, 2, 10.0, 5.0, 5.0), (1, 3, 20.0, 6.0, 5.0)], "route_id long, seq long, along double, lat double, lon double")
    wanted = spark.createDataFrame([(1, 1, -5.0), (1, 2, 5.0), (1, 3, 10.0), (1, 4, 15.0), (1, 5, 99.0), (2, 6, 1.0)], "route_id long, id long, along double")
    got = {r.id: (r.lat, r.lon) for r in R.points_along(line, wanted).collect()}
    assert got == {1: (0.0, 0.0), 2: (0.5, 1.0), 3: (5.0, 5.0), 4: (5.5, 5.0), 5: (6.0, 5.0), 6: (None, None)}


def test_ride_names(spark):
    rows = [(None, 4, "Funchal", "Monte", False), (None, 21, " ", "Monte", True), (" Mine ", 9, "Funchal", None, True), (None, 12, "Funchal", "Funchal", None), (None, 16, "Funchal", "Monte", True)]
    df = spark.createDataFrame(rows, "route string, hour int, a string, b string, is_loop boolean")
    got = [r[0] for r in df.select(S.ride_name(*map(F.col, df.columns))).collect()]
    assert got == ["Morning ride from Funchal to Monte", "Night loop", "Mine", "Lunch ride from Funchal", "Afternoon loop from Funchal"]


def test_only_the_first_covering_provider_and_the_fallback_answer(spark):
    wanted = spark.createDataFrame([(i,) for i in range(1, 5)], "cell long")
    offers = [(1, 1, "a", 5), (1, 9, "far", 6), (2, 1, "a", None), (2, 2, "b", 7), (2, 9, "far", 8), (3, 1, "a", None), (3, 2, "b", 7)]
    df = spark.createDataFrame(offers, "cell long, priority int, source string, value long")
    assert sorted(tuple(r) for r in R.first_provider(wanted, df, "far").collect() if r.source) == [(1, "a", 5), (2, "far", 8)]
    assert R.first_provider(wanted, df, "far").filter("source IS NULL AND value IS NULL").count() == 2


def test_the_first_address_of_a_number_stays(spark):
    df = spark.createDataFrame([(1, 5, 2, 20, 0), (1, 5, 1, 10, 0), (1, 7, 3, 30, 0), (2, 5, 4, 40, 0)], "street_id long, number long, seq long, lat_e7 long, lon_e7 long")
    assert sorted(map(tuple, R.first_addresses(df).collect())) == [(1, 5, 10, 0), (1, 7, 30, 0), (2, 5, 40, 0)]


def test_frames_of_the_last_seconds(spark):
    s = 1_000_000
    df = spark.createDataFrame([(1, 10 * s, 5, 5), (1, 9 * s + 1, 20, 5), (1, 9 * s, 5, 17), (1, 8 * s, 99, 99)], "d long, at_us long, build long, raster long")
    # the last second takes in its end only, so the frame at 9 s is in the two seconds alone and that at 8 s in neither
    assert [tuple(r) for r in R.frame_statistics(df, "d", 16).collect()] == [(1, 2, 3, 666)]
