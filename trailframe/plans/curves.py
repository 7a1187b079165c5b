"""Queries of covers, directions, classes, speeds and smoothed legs, named by their number, with SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import curves
from ..operators import library, readings
from ..sources.adapters import table
from .tracks import _RIDDEN, _ridden

#: Boxes of customers all over the globe, some over its ends.
_BOXES = """SELECT c_custkey AS id, c_custkey * 7919 % 1700 / CAST(10 AS DOUBLE) - 85 AS south, c_custkey * 104729 % 3500 / CAST(10 AS DOUBLE) - 175 AS west,
  c_custkey * 7919 % 1700 / CAST(10 AS DOUBLE) - 85 + c_custkey % 12 AS north, c_custkey * 104729 % 3500 / CAST(10 AS DOUBLE) - 175 + c_custkey % 17 AS east FROM customer"""
ZOOM = 5


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_BOXES.replace("FROM customer", "FROM {rows}"), rows=table(spark, sf_dir, "customer"))


def prj_01_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boxes(spark, sf_dir).select("id", F.explode(curves.tiles_of_box(*map(F.col, ("south", "west", "north", "east")))).alias("tile"))


def prj_02_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _boxes(spark, sf_dir).select("id", F.explode(curves.mercator_tiles_of_box(*map(F.col, ("south", "west", "north", "east")), ZOOM)).alias("t"))
    return found.select("id", "t.x", "t.y")


def geo_06_circle(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, share = F.col("o_custkey") * 37 % 360 + 0.0, F.col("o_orderkey") * 53 % 720 - 360.0, F.col("o_orderkey") % 5 / 4
    return table(spark, sf_dir, "orders").select("o_orderkey", (curves.circular_difference(a, b) * 4).cast("long").alias("apart_q"), (curves.circular_between(a, b, share) * 4).cast("long").alias("between_q"))


def num_02_speeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, c, d = F.col("o_custkey") % 50 / 100 + 0.05, F.col("o_orderkey") % 40 + 1.0, F.col("o_orderkey") * 7 % 900 + 0.0
    return table(spark, sf_dir, "orders").select("o_orderkey", F.floor(curves.speed_of_power(a, c, d) * 1000 + 0.5).cast("long").alias("mmps"))


def win_12_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many legs of each track lie in each of five classes between its own quantiles."""
    rides = _ridden(spark, sf_dir).filter("ridden").select("track_id", F.col("dm").cast("double").alias("v"))
    cuts = rides.groupBy("track_id").agg(F.percentile("v", [0.2, 0.4, 0.6, 0.8]).alias("cuts"))
    # whole centimetres, so that both engines part them alike
    bound = [F.floor(F.get("cuts", F.lit(i)) * 10 + 0.5) for i in range(4)]
    classed = rides.join(cuts, "track_id").select("track_id", curves.class_of(F.col("v") * 10, bound).alias("class"))
    return classed.groupBy("track_id", "class").agg(F.count("*").alias("n"))


def win_07_smoothed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Within two hours, as test tracks have hours between fixes."""
    return readings.smoothed_leg_speeds(_ridden(spark, sf_dir), 2 * 3600 * 1_000_000).select("track_id", "event_id", "smooth_mmps")


def set_11_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of one name in one square of 50 parts: positions within 1e-5 degrees are one."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.expr("CAST(floor(p_partkey * 7919 % 40 * 60 / 100.0 + 0.5) AS BIGINT)").alias("y5"))
    return library.first_of_each(parts, ["p_name", "y5"], "p_partkey")


QUERIES = {f.__name__: f for f in (prj_01_cover, prj_02_cover, geo_06_circle, num_02_speeds, win_12_classes, win_07_smoothed, set_11_places)}

_ROW = "least(greatest(CAST(floor((1 - ln(tan(radians({0})) + 1 / cos(radians({0}))) / pi()) / 2 * 32) AS INT), 0), 31)"
_HELD = "least(greatest({0}, -85.0511::DOUBLE), 85.0511::DOUBLE)"
ORACLE = {
    "prj_01_cover": f"""WITH b AS ({_BOXES}), f AS (SELECT *, greatest(-90, floor(south / 5) * 5)::INT AS y0, least(85, floor(north / 5) * 5)::INT AS y1, greatest(-180, floor(west / 5) * 5)::INT AS x0, least(175, floor(east / 5) * 5)::INT AS x1 FROM b),
      y AS (SELECT *, unnest(range(y0, y1 + 1, 5)) AS y FROM f), x AS (SELECT *, unnest(range(x0, x1 + 1, 5)) AS x FROM y)
      SELECT id, CASE WHEN x < 0 THEN 'W' ELSE 'E' END || abs(x) || '_' || CASE WHEN y < 0 THEN 'S' ELSE 'N' END || abs(y) AS tile FROM x""",
    "prj_02_cover": f"""WITH b AS ({_BOXES}), f AS (SELECT id, {_ROW.format(_HELD.format('north'))} AS y0, {_ROW.format(_HELD.format('south'))} AS y1, floor((west + 180) / 360 * 32)::INT AS x0, floor((east + 180) / 360 * 32)::INT AS x1 FROM b),
      y AS (SELECT *, unnest(range(y0, y1 + 1)) AS y FROM f), x AS (SELECT *, unnest(range(x0, least(x1, x0 + 31) + 1)) AS x FROM y) SELECT id, (x % 32)::INT AS x, y::INT AS y FROM x""",
    "geo_06_circle": """WITH t AS (SELECT o_orderkey, o_custkey * 37 % 360 AS a, o_orderkey * 53 % 720 - 360 AS b, o_orderkey % 5 / 4::DOUBLE AS share FROM orders),
      u AS (SELECT *, ((b - a) % 360 + 360) % 360 AS turn FROM t)
      SELECT o_orderkey, least(turn, 360 - turn) * 4 AS apart_q, CAST((CAST((a + CASE WHEN turn > 180 THEN turn - 360 ELSE turn END * share) * 4 AS BIGINT) % 1440 + 1440) % 1440 AS BIGINT) AS between_q FROM u""",
    "num_02_speeds": """WITH RECURSIVE t AS (SELECT o_orderkey, o_custkey % 50 / 100::DOUBLE + 0.05::DOUBLE AS a, o_orderkey % 40 + 1.0::DOUBLE AS c, o_orderkey * 7 % 900 + 0.0::DOUBLE AS d FROM orders),
      r AS (SELECT o_orderkey, a, c, d, 8.0::DOUBLE AS v, true AS seeking, false AS done, 0 AS k FROM t
        UNION ALL SELECT o_orderkey, a, c, d, CASE WHEN done OR y < 0.1::DOUBLE AND NOT seeking THEN v WHEN y < 0.1::DOUBLE THEN v * 2 ELSE v - y / (3 * a * v * v + c) END, CASE WHEN done THEN seeking ELSE y < 0.1::DOUBLE AND seeking END, done OR y < 0.1::DOUBLE AND NOT seeking, k + 1
        FROM (SELECT *, (a * v * v + c) * v - d AS y FROM r WHERE k < 10)) SELECT o_orderkey, CAST(floor(v * 1000 + 0.5) AS BIGINT) AS mmps FROM r WHERE k = 10""",
    "win_12_classes": _RIDDEN + """, v AS (SELECT track_id, dm::DOUBLE AS v FROM legs WHERE ridden), q AS (SELECT track_id, list_transform(quantile_cont(v, [0.2, 0.4, 0.6, 0.8]), lambda x: floor(x * 10 + 0.5)) AS cuts FROM v GROUP BY track_id)
      SELECT track_id, len(list_filter(cuts, lambda x: v * 10 >= x))::INT AS class, count(*) AS n FROM v JOIN q USING (track_id) GROUP BY ALL""",
    "win_07_smoothed": _RIDDEN + """, r AS (SELECT *, sum((NOT moving)::INT) OVER (PARTITION BY track_id ORDER BY ts_us, event_id) AS run, CAST(floor(dm * 1e8::DOUBLE / dur_us + 0.5) AS BIGINT) AS mmps FROM legs)
      SELECT track_id, event_id, CASE WHEN moving THEN CAST(floor(sum(mmps) OVER w / (count(*) OVER w)::DOUBLE + 0.5) AS BIGINT) ELSE 0 END AS smooth_mmps FROM r WINDOW w AS (PARTITION BY track_id, run, moving ORDER BY ts_us RANGE BETWEEN 7200000000 PRECEDING AND 7200000000 FOLLOWING)""",
    "set_11_places": "SELECT p_name, CAST(floor(p_partkey * 7919 % 40 * 60 / 100.0 + 0.5) AS BIGINT) AS y5, min(p_partkey) AS p_partkey FROM part GROUP BY ALL",
}
