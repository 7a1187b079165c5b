"""Rides with rejected fixes."""

POINT = "track_id long, ts_us long, event_id long, kind string, lat double, lon double, ele int, hr int, pwr int"


def test_a_ride_keeps_the_leg_over_a_rejected_fix(spark):
    from trailframe.operators import tracks as T

    # the second fix is a spike of 11 km and 500 m of height; without it 111 m are ridden in 20 s, and 10 m climbed
    rows = [(1, 0, 1, "a", 0.0, 0.0, 100, 90, 10), (1, 10_000_000, 2, "a", 0.1, 0.0, 600, 90, 10), (1, 20_000_000, 3, "a", 0.001, 0.0, 110, 90, 10)]
    points = spark.createDataFrame(rows, POINT)
    r = T.ride_statistics(points, 30_000_000).first()
    assert (r.n_points, r.distance_dm, r.moving_us, r.ascent_m, r.descent_m) == (2, 1112, 20_000_000, 10, 0)
    assert T.ride_totals(T.legs(points, 30_000_000)).first().distance_dm == 0  # the plain lag loses it
