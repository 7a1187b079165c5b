"""Queries of what is met along routes, named by their number, each with its SQL counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import routes as R
from ..sources.adapters import PLACES_SQL, TRACK_POINTS_SQL, places, table, track_points
from .tracks import _HAVERSINE

LIGHT_MM100 = 100
CAP = 12
HOUR_US = 3_600_000_000


def join_04_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows are suppliers and parts, aliases customers; lines name all three, and some ids that are none."""
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    aliases = table(spark, sf_dir, "customer").select((F.col("c_custkey") + 1000000).alias("id"), (F.col("c_custkey") % 2000).alias("ref_id"))
    hits = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey") % 500).otherwise(F.col("o_custkey") + 1000000).alias("id"), (F.col("o_orderkey") * 7919 % 1000).alias("rank"))
    return R.resolved(hits, rows, aliases)


def join_15_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pois = places(spark, sf_dir).select("id", (F.col("lat_e7") / F.lit(1e7)).alias("y"), (F.col("lon_e7") / F.lit(1e7)).alias("x"))
    return R.marks(pois, track_points(spark, sf_dir).select("track_id", "ts_us", "event_id", "lat", "lon"))


def join_18_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid of 60 by 20, values missing in places, sampled beside and inside of it in eighths of a step (sums are exact)."""
    c = table(spark, sf_dir, "customer").filter("c_custkey <= 1200").select(((F.col("c_custkey") - 1) % 60).alias("col"), F.floor((F.col("c_custkey") - 1) / 60).alias("row"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_nationkey")).cast("double").alias("value"))
    points = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") * 37 % 490 / 8.0 - 0.5).alias("x"), (F.col("o_orderkey") * 13 % 160 / 8.0).alias("y"))
    return R.bilinear(points, c, 60, 20).select("id", F.floor(F.col("value") * 1024).cast("long").alias("value_1024"))


def join_21_providers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells are parts; their lines are providers by number, of which some fail; every fifth part falls back to its own price."""
    wanted = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("cell"), "p_brand")
    near = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("cell"), F.col("l_linenumber").cast("int").alias("priority"), F.concat(F.lit("line "), F.col("l_orderkey").cast("string")).alias("source"), F.when(F.col("l_returnflag") == "N", F.col("l_quantity").cast("long")).alias("value"))
    far = wanted.filter("cell % 5 = 0").select("cell", F.lit(9).alias("priority"), F.lit("fallback").alias("source"), (F.col("cell") % 7).alias("value"))
    return R.first_provider(wanted, near.unionByName(far), "fallback")


_WAYS = """SELECT l_orderkey * 8 + l_linenumber AS seq, concat('Street ', l_suppkey % 40) AS name, CASE WHEN l_partkey % 3 <> 0 THEN l_suppkey % 25 END AS place_id,
  CAST(326000000 + l_partkey * 7919 % 4000 * 1000 AS BIGINT) AS lat_e7, CAST(-170000000 + l_partkey * 104729 % 4000 * 1000 AS BIGINT) AS lon_e7, {0}(concat('alt ', l_linenumber), concat('old ', l_partkey % 4)) AS alts FROM lineitem"""


def agg_17_streets(spark: SparkSession, sf_dir: str) -> DataFrame:
    ways = spark.sql(_WAYS.format("array").replace("FROM lineitem", "FROM {rows}"), rows=table(spark, sf_dir, "lineitem"))
    return R.merged_streets(ways).withColumn("alts", F.array_join("alts", "|"))


def agg_25_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("street_id"), F.col("l_quantity").cast("long").alias("number"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"), F.col("l_partkey").alias("lat_e7"), (-F.col("l_partkey")).alias("lon_e7"))
    return R.first_addresses(rows)


def agg_26_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings stand for frames, ten hours and a hundred for one second and two."""
    frames = track_points(spark, sf_dir).select("track_id", F.col("ts_us").alias("at_us"), F.col("ele").alias("build"), F.col("pwr").alias("raster"))
    return R.frame_statistics(frames, "track_id", 60, 10 * HOUR_US, 100 * HOUR_US)


_SAMPLES = """SELECT o_custkey AS ride_id, o_orderkey AS seq, o_orderkey * 7 AS along_m, o_orderkey * 3 AS minute,
  CASE o_orderkey * 7919 % 11 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN 'calm' WHEN 3 THEN 'crosswind' WHEN 4 THEN 'crosswind' WHEN 5 THEN 'tailwind' WHEN 6 THEN 'tailwind' ELSE 'headwind' END AS wind,
  CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey * 31 % 50 - 10 END AS temp, CASE WHEN o_orderkey % 13 <> 0 THEN o_orderkey * 17 % 15 END AS gust,
  o_orderkey * 41 % 150 AS mm100, o_orderkey * 41 % 150 >= 140 OR o_orderkey * 53 % 100 >= 90 AS wet FROM orders"""


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_SAMPLES.replace("FROM orders", "FROM {rows}"), rows=table(spark, sf_dir, "orders"))


def agg_21_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.weather_summary(_samples(spark, sf_dir))


def agg_31_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.weather_digest(_samples(spark, sf_dir), LIGHT_MM100)


def win_02_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each supplier as items on a way of 1000, the largest first, return flags as groups."""
    items = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", (F.col("l_partkey") * 7 % 1000).alias("along"), "l_returnflag", F.col("l_quantity").cast("long").alias("size"))
    better = [F.desc("size"), F.asc("l_orderkey"), F.asc("l_linenumber")]
    return R.spread(items, "l_suppkey", "along", 1000, "l_returnflag", better, CAP).select("l_suppkey", "l_orderkey", "l_linenumber", "chosen")


def geo_07_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    along = (F.col("o_orderkey") * 32).cast("double")
    line = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("route_id"), F.col("o_orderkey").alias("seq"), along.alias("along"), (F.col("o_orderkey") * 7919 % 4000 / 1024).alias("lat"), (-(F.col("o_orderkey") * 104729 % 4000) / 1024).alias("lon"))
    wanted = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("route_id"), F.col("c_custkey").alias("id"), (F.col("c_custkey") * 7919 % 15000 * 33).cast("double").alias("along"))
    return R.points_along(line, wanted).select("id", F.floor(F.col("lat") * 32768).cast("long").alias("lat_q"), F.floor(F.col("lon") * 32768).cast("long").alias("lon_q"))


_ENDS = """SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN ' My route ' WHEN o_orderkey % 7 = 0 THEN ' ' END AS route, CAST(o_orderkey * 5 % 24 AS INT) AS hour,
  CASE o_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN ' ' ELSE concat('Town ', o_custkey % 9, ' ') END AS a, CASE WHEN o_custkey % 5 <> 0 THEN concat('Town ', o_orderkey % 9) END AS b, CASE WHEN o_orderkey % 13 <> 0 THEN o_custkey % 3 = 0 END AS is_loop FROM orders"""


def str_16_ride_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rides = spark.sql(_ENDS.replace("FROM orders", "FROM {rows}"), rows=table(spark, sf_dir, "orders"))
    return rides.select("o_orderkey", S.ride_name(*map(F.col, ("route", "hour", "a", "b", "is_loop"))).alias("name"))


QUERIES = {f.__name__: f for f in (
    join_04_aliases, join_15_marks, join_18_samples, join_21_providers, agg_17_streets, agg_25_addresses, agg_26_frames, agg_21_weather, agg_31_digest, win_02_spread, geo_07_positions, str_16_ride_names,
)}

_HALF = f"""WITH s AS ({_SAMPLES}), w AS (SELECT *, coalesce(lead(along_m) OVER o, along_m) - coalesce(lag(along_m) OVER o, along_m) AS way2,
  coalesce(lead(minute) OVER o, minute) - coalesce(lag(minute) OVER o, minute) AS time2 FROM s WINDOW o AS (PARTITION BY ride_id ORDER BY seq))"""

ORACLE = {
    "join_04_aliases": """WITH h AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN o_custkey % 500 ELSE o_custkey + 1000000 END AS id, o_orderkey * 7919 % 1000 AS rank FROM orders),
      t AS (SELECT s_suppkey AS id, s_suppkey AS target FROM supplier UNION ALL SELECT c_custkey + 1000000, c_custkey % 2000 FROM customer WHERE c_custkey % 2000 IN (SELECT s_suppkey FROM supplier))
      SELECT target AS id, min(rank) AS rank, s_name AS name FROM h JOIN t USING (id) JOIN supplier ON s_suppkey = target GROUP BY target, s_name""",
    "join_15_marks": f"""WITH {TRACK_POINTS_SQL}, {PLACES_SQL}, q AS (SELECT id, lat_e7 / 1e7 AS y, lon_e7 / 1e7 AS x FROM places),
      d AS (SELECT track_id, id, event_id, ts_us, CAST(floor(1000 * {_HAVERSINE.format(a="q.y", b="p.lat", c="q.x", d="p.lon")} + 0.5) AS BIGINT) AS mm FROM q JOIN points p ON abs(p.lat - q.y) < 0.001 AND abs(p.lon - q.x) < 0.001),
      r AS (SELECT *, row_number() OVER (PARTITION BY track_id, id ORDER BY mm, ts_us DESC, event_id DESC) AS n FROM d WHERE mm <= {R.MARK_REACH_M * 1000}) SELECT track_id, id, mm, event_id FROM r WHERE n = 1""",
    "join_18_samples": """WITH g AS (SELECT (c_custkey - 1) % 60 AS col, (c_custkey - 1) // 60 AS "row", CASE WHEN c_custkey % 3 <> 0 THEN CAST(c_nationkey AS DOUBLE) END AS v FROM customer WHERE c_custkey <= 1200),
      p AS (SELECT o_orderkey AS id, o_custkey * 37 % 490 / 8.0::DOUBLE - 0.5 AS x, o_orderkey * 13 % 160 / 8.0::DOUBLE AS y FROM orders), i AS (SELECT *, least(floor(x), 58) AS x0, least(floor(y), 18) AS y0 FROM p WHERE x BETWEEN 0 AND 59 AND y BETWEEN 0 AND 19),
      c AS (SELECT id, x0 + dx AS col, y0 + dy AS "row", abs(1 - dx - (x - x0)) * abs(1 - dy - (y - y0)) AS w FROM i, (VALUES (0, 0), (1, 0), (0, 1), (1, 1)) AS t(dx, dy)),
      m AS (SELECT id, CASE WHEN sum(w) > 0 THEN sum(v * w) / sum(w) ELSE avg(v) END AS value FROM c JOIN g USING (col, "row") WHERE v IS NOT NULL GROUP BY id)
      SELECT id, CAST(floor(value * 1024) AS BIGINT) AS value_1024 FROM p LEFT JOIN m USING (id)""",
    "join_21_providers": """WITH o AS (SELECT l_partkey AS cell, l_linenumber AS priority, 'line ' || l_orderkey AS source, CASE WHEN l_returnflag = 'N' THEN CAST(l_quantity AS BIGINT) END AS value FROM lineitem
        UNION ALL SELECT p_partkey, 9, 'fallback', p_partkey % 7 FROM part WHERE p_partkey % 5 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY priority, source, value NULLS FIRST) AS n FROM o),
      m AS (SELECT p_partkey AS cell, p_brand, r.source, r.value, CASE WHEN p_partkey % 5 = 0 THEN p_partkey % 7 END AS back FROM part LEFT JOIN r ON r.cell = p_partkey AND n = 1)
      SELECT cell, p_brand, CASE WHEN value IS NOT NULL THEN source WHEN back IS NOT NULL THEN 'fallback' END AS source, coalesce(value, back) AS value FROM m""",
    "agg_17_streets": f"""WITH w AS ({_WAYS.format("list_value")}), k AS (SELECT *, CASE WHEN place_id IS NULL THEN floor(lat_e7 / 1e6) END AS cy, CASE WHEN place_id IS NULL THEN floor(lon_e7 / 1e6) END AS cx FROM w),
      a AS (SELECT name, place_id, cy, cx, unnest(alts) AS alt, seq * 2 + unnest([0, 1]) AS pos FROM k), f AS (SELECT name, place_id, cy, cx, alt, min(pos) AS pos FROM a GROUP BY ALL),
      n AS (SELECT name, place_id, cy, cx, string_agg(alt, '|' ORDER BY pos, alt) AS alts FROM f GROUP BY name, place_id, cy, cx),
      m AS (SELECT name, place_id, cy, cx, min(seq) AS first_seq, CAST(floor(sum(lat_e7) / count(*)::DOUBLE) AS BIGINT) AS lat_e7, CAST(floor(sum(lon_e7) / count(*)::DOUBLE) AS BIGINT) AS lon_e7 FROM k GROUP BY name, place_id, cy, cx)
      SELECT first_seq, m.name, m.place_id, lat_e7, lon_e7, alts FROM m JOIN n ON m.name = n.name AND m.place_id IS NOT DISTINCT FROM n.place_id AND m.cy IS NOT DISTINCT FROM n.cy AND m.cx IS NOT DISTINCT FROM n.cx""",
    "agg_25_addresses": """WITH r AS (SELECT l_suppkey, CAST(l_quantity AS BIGINT) AS number, l_partkey, row_number() OVER (PARTITION BY l_suppkey, CAST(l_quantity AS BIGINT) ORDER BY l_orderkey, l_linenumber, l_partkey) AS n FROM lineitem)
      SELECT l_suppkey AS street_id, number, l_partkey AS lat_e7, -l_partkey AS lon_e7 FROM r WHERE n = 1""",
    "agg_26_frames": f"""WITH {TRACK_POINTS_SQL}, n AS (SELECT *, max(ts_us) OVER (PARTITION BY track_id) AS now FROM points)
      SELECT track_id, count(*) FILTER (ts_us > now - {10 * HOUR_US}) AS n_short, count(*) AS n_long, CAST(floor(count(*) FILTER (ele > 60 OR pwr > 60) * 1000 / count(*)::DOUBLE) AS BIGINT) AS slow_permille FROM n WHERE ts_us > now - {100 * HOUR_US} GROUP BY track_id""",
    "agg_21_weather": _HALF + " SELECT ride_id, " + ", ".join(f"CAST(CASE WHEN sum(way2) > 0 THEN floor(coalesce(sum(way2) FILTER (wind = '{c}'), 0) * 1000 / sum(way2)::DOUBLE) ELSE 0 END AS BIGINT) AS {c}" for c in R.WIND_CLASSES)
    + """, min(temp) FILTER (wind IS NOT NULL) AS min_temp, max(temp) FILTER (wind IS NOT NULL) AS max_temp, arg_min(along_m, seq) FILTER (wind IS NOT NULL AND wet) AS first_rain_m,
      max(gust) FILTER (wind IS NOT NULL) AS max_gust, CAST(coalesce(floor(sum(mm100 * time2) FILTER (wind IS NOT NULL) / 2.0::DOUBLE), 0) AS BIGINT) AS rain FROM w GROUP BY ride_id""",
    "agg_31_digest": _HALF + f""", k AS (SELECT * FROM w WHERE wind IS NOT NULL), c AS (SELECT ride_id, wind, sum(way2) AS way, min(seq) AS seq FROM k GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY ride_id ORDER BY way DESC, seq) AS n FROM c),
      t AS (SELECT ride_id, sum(way2) AS covered, arg_min(wind, seq) AS one, arg_min(along_m, seq) FILTER (wet) AS rain_m, max(mm100) FILTER (wet) < {LIGHT_MM100} AS light, CASE WHEN max(gust) >= 10 THEN max(gust) END AS gust FROM k GROUP BY ride_id)
      SELECT ride_id, CASE WHEN covered <= 0 THEN one WHEN way * 2 >= covered THEN wind ELSE 'mixed' END AS wind, rain_m, light, gust FROM t JOIN b USING (ride_id) WHERE n = 1""",
    "win_02_spread": """WITH i AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_returnflag, CAST(l_quantity AS BIGINT) AS size, l_partkey * 7 % 1000 * 3 // 1000 AS part FROM lineitem),
      t AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, part, l_returnflag ORDER BY size DESC, l_orderkey, l_linenumber) AS turn FROM i),
      r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, part ORDER BY turn, size DESC, l_orderkey, l_linenumber) AS round FROM t),
      c AS (SELECT *, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY round, part) AS INT) AS chosen FROM r) SELECT l_suppkey, l_orderkey, l_linenumber, chosen FROM c WHERE chosen <= 12""",
    "geo_07_positions": """WITH l AS (SELECT o_custkey AS r, o_orderkey * 32.0::DOUBLE AS along, o_orderkey * 7919 % 4000 / 1024.0::DOUBLE AS lat, -(o_orderkey * 104729 % 4000) / 1024.0::DOUBLE AS lon FROM orders),
      o AS (SELECT c_custkey AS id, c_custkey * 7919 % 15000 * 33.0::DOUBLE AS along FROM customer),
      a AS (SELECT id, arg_max(lat, l.along) AS lat, arg_max(lon, l.along) AS lon, max(l.along) AS at FROM o JOIN l ON r = id AND l.along <= o.along GROUP BY id),
      b AS (SELECT id, arg_min(lat, l.along) AS lat, arg_min(lon, l.along) AS lon, min(l.along) AS at FROM o JOIN l ON r = id AND l.along > o.along GROUP BY id)
      SELECT id, """ + ", ".join(f"CAST(floor(32768 * coalesce(a.{c} + (b.{c} - a.{c}) * ((o.along - a.at) / (b.at - a.at)), a.{c}, b.{c})) AS BIGINT) AS {c}_q" for c in ("lat", "lon")) + " FROM o LEFT JOIN a USING (id) LEFT JOIN b USING (id)",
    "str_16_ride_names": f"""WITH e AS (SELECT o_orderkey, nullif(trim(route), '') AS route, nullif(trim(a), '') AS a, nullif(trim(b), '') AS b, coalesce(is_loop, false) AS l,
        CASE WHEN hour < 4 OR hour >= 21 THEN 'Night' WHEN hour < 11 THEN 'Morning' WHEN hour < 14 THEN 'Lunch' WHEN hour < 17 THEN 'Afternoon' ELSE 'Evening' END || CASE WHEN coalesce(is_loop, false) THEN ' loop' ELSE ' ride' END AS kind FROM ({_ENDS}))
      SELECT o_orderkey, CASE WHEN route IS NOT NULL THEN route WHEN a IS NULL THEN kind WHEN l OR b IS NULL OR a = b THEN kind || ' from ' || a ELSE kind || ' from ' || a || ' to ' || b END AS name FROM e""",
}
