"""Queries of places by name and distance, named by their number, with SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import nearby
from ..sources.adapters import table

#: Customers as settlements, parts as addresses and points; some hundred kilometres wide.
_PLACES = """SELECT c_custkey AS id, concat('Town ', c_custkey % 97) AS name, CASE c_nationkey % 6 WHEN 0 THEN 'city' WHEN 1 THEN 'town' WHEN 2 THEN 'village' WHEN 3 THEN 'suburb' ELSE 'hamlet' END AS kind,
  470000000 + c_custkey * 7919 % 9973 * 1000 AS lat_e7, 80000000 + c_custkey * 104729 % 9967 * 1000 AS lon_e7, CASE WHEN c_custkey % 3 = 0 THEN concat('Town ', c_custkey * 5 % 131) END AS context FROM customer"""
_POINTS = """SELECT p_partkey AS id, p_name AS name, p_brand AS kind, 470000000 + p_partkey * 6007 % 9973 * 1000 AS lat_e7, 80000000 + p_partkey * 9949 % 9967 * 1000 AS lon_e7,
  CASE WHEN p_partkey % 4 = 0 THEN concat('Town ', p_partkey * 3 % 110) END AS city FROM part"""
_RANKS = {"city": 0, "town": 0, "village": 0, "suburb": 1, "hamlet": 1}


def _rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    of = lambda sql, t: spark.sql(sql.replace(f"FROM {t}", "FROM {rows}"), rows=table(spark, sf_dir, t))
    return of(_PLACES, "customer"), of(_POINTS, "part")


def join_06_place_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    places, points = _rows(spark, sf_dir)
    return nearby.place_of(points, places)


def join_07_town_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearby.town_of(_rows(spark, sf_dir)[0])


def join_08_street_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as streets, and each again as an address whose name is written in capitals, some way off."""
    points = _rows(spark, sf_dir)[1]
    moved = points.select("id", F.upper("name").alias("name"), (F.col("lat_e7") + F.col("id") % 7 * 40000).alias("lat_e7"), (F.col("lon_e7") - F.col("id") % 5 * 60000).alias("lon_e7"))
    return nearby.street_of(moved, points)


def join_09_of_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest parts of a brand around each settlement."""
    places, points = _rows(spark, sf_dir)
    return nearby.nearest_of_kind(places.select("id", "lat_e7", "lon_e7", F.concat(F.lit("Brand#"), F.col("id") % 25).alias("kind")), points, 5)


def join_11_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    places, points = _rows(spark, sf_dir)
    return nearby.naming_settlement(points, places, 2000, _RANKS)


def join_10_reverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts, a tenth of them far out at sea, against all settlements."""
    places, points = _rows(spark, sf_dir)
    moved = points.select("id", F.when(F.col("id") % 10 == 0, F.col("lat_e7") - 400000000).otherwise(F.col("lat_e7")).alias("lat_e7"), "lon_e7")
    return nearby.reverse_lookup(moved, places)


QUERIES = {f.__name__: f for f in (join_10_reverse, join_06_place_of, join_07_town_of, join_08_street_of, join_09_of_kind, join_11_naming)}

_MM = "CAST(floor(sqrt(pow(({0}.lat_e7 / 1e7::DOUBLE - {1}.lat_e7 / 1e7::DOUBLE) * 111320.0::DOUBLE, 2) + pow(({0}.lon_e7 / 1e7::DOUBLE - {1}.lon_e7 / 1e7::DOUBLE) * 111320.0::DOUBLE * cos(radians({0}.lat_e7 / 1e7::DOUBLE)), 2)) * 1000 + 0.5) AS BIGINT)"
_BOTH = f"WITH places AS ({_PLACES}), points AS ({_POINTS})"
ORACLE = {
    "join_10_reverse": _BOTH
    + f""", a AS (SELECT id, CASE WHEN id % 10 = 0 THEN lat_e7 - 400000000 ELSE lat_e7 END AS lat_e7, lon_e7 FROM points),
      m AS (SELECT a.id, q.id AS near_id, {_MM.format('a', 'q')} AS mm, greatest(abs(q.lat_e7 - a.lat_e7), abs(q.lon_e7 - a.lon_e7) * cos(radians(a.lat_e7 / 1e7::DOUBLE))) / 1e7::DOUBLE AS aside FROM a, places q),
      x AS (SELECT *, CASE WHEN aside <= 0.02 THEN 0.02 WHEN aside <= 0.1 THEN 0.1 WHEN aside <= 0.5 THEN 0.5 WHEN aside <= 2 THEN 2.0 END::DOUBLE AS box_deg FROM m)
      SELECT id, near_id, mm, box_deg FROM x QUALIFY row_number() OVER (PARTITION BY id ORDER BY box_deg NULLS LAST, mm, near_id) = 1""",
    "join_06_place_of": _BOTH
    + f""", m AS (SELECT p.id, q.id AS near_id, {_MM.format('p', 'q')} AS mm, coalesce(p.city = q.name, false) AS named FROM points p, places q),
      b AS (SELECT id, arg_min(near_id, struct_pack(a := NOT named, b := mm, c := near_id)) AS place_id FROM m WHERE named OR mm < 5000000 GROUP BY id) SELECT points.id, place_id FROM points LEFT JOIN b USING (id)""",
    "join_07_town_of": _BOTH
    + f""", m AS (SELECT p.id, q.id AS near_id, {_MM.format('p', 'q')} AS mm, coalesce(p.context = q.name, false) AS named FROM places p, places q WHERE p.kind NOT IN ('city', 'town') AND q.kind IN ('city', 'town')),
      b AS (SELECT id, arg_min(near_id, struct_pack(a := NOT named, b := mm, c := near_id)) AS admin_id FROM m WHERE mm < 25000000 OR named AND mm = 25000000 GROUP BY id) SELECT places.id, admin_id FROM places LEFT JOIN b USING (id)""",
    "join_08_street_of": _BOTH
    + f""", a AS (SELECT id, upper(name) AS name, lat_e7 + id % 7 * 40000 AS lat_e7, lon_e7 - id % 5 * 60000 AS lon_e7 FROM points),
      m AS (SELECT a.id, q.id AS near_id, {_MM.format('a', 'q')} AS mm FROM a JOIN points q ON lower(a.name) = lower(q.name)),
      b AS (SELECT id, arg_min(near_id, struct_pack(b := mm, c := near_id)) AS street_id FROM m WHERE mm < 2000000 GROUP BY id) SELECT a.id, street_id FROM a LEFT JOIN b USING (id)""",
    "join_09_of_kind": _BOTH
    + f""", m AS (SELECT p.id, q.id AS near_id, {_MM.format('p', 'q')} AS mm, greatest(abs(q.lat_e7 - p.lat_e7), abs(q.lon_e7 - p.lon_e7) * cos(radians(p.lat_e7 / 1e7::DOUBLE))) / 1e7::DOUBLE * 111320.0::DOUBLE AS aside
        FROM places p JOIN points q ON q.kind = concat('Brand#', p.id % 25)),
      x AS (SELECT *, CASE WHEN aside <= 5000 THEN 5000 WHEN aside <= 10000 THEN 10000 WHEN aside <= 25000 THEN 25000 ELSE 50000 END AS box FROM m WHERE aside <= 50000),
      h AS (SELECT id, box, sum(count(*)) OVER (PARTITION BY id ORDER BY box) AS held FROM x GROUP BY id, box),
      c AS (SELECT id, coalesce(min(box) FILTER (held >= 5), 50000)::INT AS box_m FROM h GROUP BY id)
      SELECT id, row_number() OVER (PARTITION BY id ORDER BY mm, near_id)::INT AS place, near_id, mm, box_m FROM x JOIN c USING (id) WHERE box <= box_m QUALIFY place <= 5""",
    "join_11_naming": _BOTH
    + f""", m AS (SELECT p.id, q.id AS near_id, {_MM.format('p', 'q')} AS mm, CASE q.kind WHEN 'city' THEN 0 WHEN 'town' THEN 0 WHEN 'village' THEN 0 WHEN 'suburb' THEN 1 WHEN 'hamlet' THEN 1 END AS rank, q.kind FROM points p, places q),
      b AS (SELECT id, min(struct_pack(a := rank, b := mm, c := near_id)) AS best FROM m WHERE rank IS NOT NULL AND mm <= CASE WHEN kind IN ('city', 'town') THEN 5000000 ELSE 2000000 END GROUP BY id)
      SELECT id, best.c AS near_id, best.b AS mm FROM b""",
}
