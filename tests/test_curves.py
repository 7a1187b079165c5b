"""Covers, directions, classes, speeds and smoothed legs, by hand."""

import pytest
from pyspark.sql import functions as F

from trailframe.functions import curves
from trailframe.operators import readings


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def lits(*values):
    return [F.lit(float(v)) for v in values]


@pytest.mark.parametrize(
    ("box", "want"),
    [
        ((47.1, 8.2, 47.2, 8.3), ["E5_N45"]), ((-1, -1, 5, 0), ["W5_S5", "E0_S5", "W5_N0", "E0_N0", "W5_N5", "E0_N5"]),  # edges belong to the next tile as well
        ((89, 179, 95, 185), ["E175_N85"]), ((10, 10, 5, 20), []),
    ],
)
def test_tiles_of_boxes(spark, box, want):
    assert one(spark, curves.tiles_of_box(*lits(*box))) == want


def test_mercator_tiles(spark):
    got = lambda *box: {(t.x, t.y) for t in one(spark, curves.mercator_tiles_of_box(*lits(*box), 1))}
    assert got(1, 1, 2, 2) == {(1, 0)} and got(-1, -1, 1, 1) == {(0, 0), (1, 0), (0, 1), (1, 1)}
    assert got(1, 179, 2, 181) == {(1, 0), (0, 0)} and got(-90, -180, 90, 540) == {(0, 0), (1, 0), (0, 1), (1, 1)}


def test_directions(spark):
    apart = lambda a, b: one(spark, curves.circular_difference(*lits(a, b)))
    assert (apart(350, 10), apart(10, 350), apart(0, 180), apart(90, -270)) == (20, 20, 180, 0)
    between = lambda a, b, t: one(spark, curves.circular_between(*lits(a, b, t)))
    assert (between(350, 10, 0.5), between(10, 350, 0.25), between(0, 180, 0.5), between(10, 20, 0)) == (0, 5, 90, 10)


def test_classes(spark):
    bounds = [F.lit(x) for x in (1, 2, 2, 5)]
    assert [one(spark, curves.class_of(F.lit(v).cast("double"), bounds)) for v in (0.5, 1, 1.9, 2, 9)] == [0, 1, 1, 3, 4]
    assert one(spark, curves.class_of(F.lit(None).cast("double"), bounds)) is None


def test_speeds(spark):
    speed = lambda a, c, d: one(spark, curves.speed_of_power(*lits(a, c, d)))
    v = speed(0.3, 4, 200)
    assert 0.3 * v**3 + 4 * v == pytest.approx(200, abs=0.2)
    assert speed(0.3, 4, 9000) * 0 == 0 and speed(0.01, 1, 0) == pytest.approx(0, abs=0.2)


def test_smoothed_legs_keep_to_their_run(spark):
    rows = [(1, 0, 1, None, None, False), (1, 5, 2, 100, 5, True), (1, 10, 3, 200, 5, True), (1, 15, 4, 0, 5, False), (1, 20, 5, 400, 5, True), (1, 40, 6, 600, 20, True)]
    legs = spark.createDataFrame([(t, s * 10**6, e, dm, d and d * 10**6, m) for t, s, e, dm, d, m in rows], "track_id long, ts_us long, event_id long, dm long, dur_us long, moving boolean")
    got = {r.event_id: r.smooth_mmps for r in readings.smoothed_leg_speeds(legs).collect()}
    assert got == {1: 0, 2: 3000, 3: 3000, 4: 0, 5: 8000, 6: 3000}
