"""Operators that once were quadratic or overflowed: answers by hand, and one key with very many rows."""

import random
import time

from pyspark.sql import functions as F

from trailframe.operators import library, readings, routes


def test_digest_of_any_order_and_size(spark):
    rows = spark.range(150_000).select(F.col("id"), F.when(F.col("id") % 7 > 0, F.col("id") * 3).alias("v"))
    one, two = library.digest(rows).first(), library.digest(rows.orderBy(F.desc("id")).repartition(5)).first()
    assert one == two and one.n == 150_000 and 0 <= one.summed < 1 << 48
    small = lambda *values: tuple(library.digest(spark.createDataFrame(values, "a string, b string")).first())
    assert small(("x", None)) != small((None, "x")) and small(("xy", "")) != small(("x", "y")) and small(("", None)) != small((None, ""))
    assert small(("x", "y"), ("x", "y")) != small(("z", "y"), ("z", "y"))  # repeated rows do not cancel out
    assert tuple(library.digest(rows.limit(0)).first()) == (0, 0, 0)


def test_positions_along_one_long_route(spark):
    n = 300_000
    line = spark.range(n).select(F.lit(1).cast("long").alias("route_id"), F.col("id").alias("seq"), F.col("id").cast("double").alias("along"), (F.col("id") / n).alias("lat"), F.lit(0.0).alias("lon"))
    wanted = spark.createDataFrame([(1, i, i * 1000 + 0.5) for i in range(100)], "route_id long, id long, along double")
    began = time.time()
    found = {r.id: r.lat for r in routes.points_along(line, wanted).collect()}
    assert time.time() - began < 60
    assert all(abs(found[i] - (i * 1000 + 0.5) / n) < 1e-12 for i in range(100))


def test_worst_offsets(spark):
    draw = random.Random(3)
    rows = [(k, draw.uniform(47, 47.05), draw.uniform(8, 8.08)) for k in (1, 2) for _ in range(200)]
    marks = [(k, i, draw.uniform(47, 47.05), draw.uniform(8, 8.08)) for k in (1, 2) for i in range(40)] + [(1, 99, 47.0, 12.0), (3, 1, 47.0, 8.0), (2, 98, None, 8.0)]
    points = spark.createDataFrame(rows, "route_id long, lat double, lon double")
    waypoints = spark.createDataFrame(marks, "route_id long, waypoint long, lat double, lon double")
    from test_lines import haversine

    want = {}
    for k in (1, 2):
        near = [min(haversine(y, x, b, a) for r, b, a in rows if r == k) for r, _, y, x in marks if r == k and y is not None]
        want[k] = int(max(near) * 10 + 0.5)
    assert {r.route_id: r.worst_dm for r in readings.worst_offset(waypoints, points).collect()} == want and want[1] > 2_000_000


def test_steps_across_breaks(spark):
    breaks = spark.createDataFrame([(1, 10, 20), (1, 12, 40), (1, 15, 16), (1, 60, 60), (2, 5, 6), (1, None, 9)], "track_id long, lo_us long, hi_us long")
    steps = [(1, 1, 0, 10), (1, 2, 0, 11), (1, 3, 20, 30), (1, 4, 39, 45), (1, 5, 40, 50), (1, 6, 55, 70), (2, 7, 0, 100), (2, 8, 6, 9), (3, 9, 0, 9), (1, 10, 16, 18)]
    found = readings.crossed(spark.createDataFrame([(t, i, a, b) for t, i, a, b in steps], "track_id long, id long, lo_us long, hi_us long"), breaks)
    assert sorted(r.id for r in found.collect()) == [2, 3, 4, 7, 10]
