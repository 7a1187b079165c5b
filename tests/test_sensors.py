"""Fused sources, counters and the sliding limit by hand; streams against tables."""

import pytest
from pyspark.sql import functions as F
from test_rides import stream_of

from trailframe.streaming import sensors

S = sensors.SECOND


def table(spark, rows, columns):
    df = spark.createDataFrame(rows, f"key long, s double, seq long{columns}")
    return df.withColumn("at", (F.lit(1_000_000) + F.col("s")).cast("timestamp")).drop("s")


def answers(df):
    return sorted((r.key, round(r.at_us / S - 1_000_000, 3), *list(r)[2:]) for r in df.collect())


READINGS = [
    (1, 0.0, 1, "hr", 10, 1, 100.0), (1, 1.0, 2, "hr", 20, 5, 120.0), (1, 5.0, 3, "hr", 10, 1, 101.0), (1, 11.0, 4, "hr", 10, 1, 102.0), (1, 11.002, 5, "hr", 10, 1, 103.0),
    (1, 12.0, 6, "power", 30, 1, 200.0), (1, 13.0, 7, "hr", 40, 1, 99.0), (2, 0.0, 8, "hr", 10, 1, 50.0), (None, 0.0, 9, "hr", 1, 1, 1.0),
]
FRAMES = [
    (1, 0.0, 1, 65534, 65000, 16), (1, 1.0, 2, 0, 488, 16), (1, 2.0, 3, 0, 488, 16), (1, 4.0, 4, 0, 488, 16), (1, 9.0, 5, 0, 488, 16), (1, 10.0, 6, 3, 2536, 16),  # both wrap; 3 s without an event; said once
    (2, 0.0, 7, 4294967295, 10, 32), (2, 0.5, 8, 1, 522, 32),
]


def test_sources_take_over_and_fall_silent(spark):
    got = answers(sensors.folded(table(spark, READINGS, ", kind string, source_id long, priority int, value double"), "fused"))
    assert [(k, s, source, v) for k, s, _, kind, source, v in got if kind == "hr"] == [
        (1, 0, 10, 100), (1, 1, 20, 120), (1, 5, 20, 120), (1, 11, 20, 120), (1, 11.002, 10, 103), (1, 13, 40, 99), (2, 0, 10, 50),
    ]


def test_counters_wrap_and_stall(spark):
    got = answers(sensors.folded(table(spark, FRAMES, ", revs long, clock long, bits int"), "counted"))
    assert got == [(1, 1.0, 2, 2000), (1, 4.0, 4, 0), (1, 10.0, 6, 3 * 1000 * 1024 // 2048), (2, 0.5, 8, 4000)]


def requests():
    rows = [(1, float(i), i) for i in range(100)] + [(1, 899.0, 200), (1, 900.0, 201), (1, 900.5, 202), (1, 901.0, 203)]
    return rows + [(2, 5.0, i) for i in range(91)]


def test_refused_requests_use_up_nothing(spark):
    got = answers(sensors.folded(table(spark, requests(), ""), "limited"))
    one = {s: (ok, wait) for k, s, _, ok, wait in got if k == 1}
    assert all(one[float(i)] == (True, 0) for i in range(90)) and one[90.0] == (False, 810 * S) and one[899.0] == (False, S)
    assert one[900.0] == (True, 0) and one[900.5] == (False, S // 2) and one[901.0] == (True, 0)
    assert [ok for k, _, _, ok, _ in got if k == 2].count(False) == 1


@pytest.mark.parametrize("name", ["fused", "limited"])
def test_streams_give_what_tables_give(spark, tmp_path, name):
    df = table(spark, READINGS, ", kind string, source_id long, priority int, value double") if name == "fused" else table(spark, requests(), "")
    s = F.col("at").cast("double") - 1_000_000
    parts = [df.filter(s < 2), df.filter((s >= 2) & (s < 12)), df.filter(s >= 12)]
    found = stream_of(spark, parts, lambda d: sensors.fold(d, name), tmp_path, name, 2)
    assert answers(found) == answers(sensors.folded(df, name))
