"""The track, place and text tables of the engine as views of the star-schema test tables (integer arithmetic only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def track_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(track_id, ts_us, event_id, kind, lat, lon, ele, hr, pwr)``; a track's order is (ts_us, event_id)."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("track_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), "event_id", F.col("event_type").alias("kind"),
        ((326000000 + F.col("event_id") * 7919 % 4000 * 100) / F.lit(1e7)).alias("lat"), ((-170000000 + F.col("event_id") * 104729 % 4000 * 100) / F.lit(1e7)).alias("lon"),
        k.alias("ele"), (90 + k).alias("hr"), F.floor("value").cast("int").alias("pwr"),
    )


TRACK_POINTS_SQL = """points AS (
  SELECT user_id AS track_id, epoch_us(ts) AS ts_us, event_id, event_type AS kind,
    (326000000 + event_id * 7919 % 4000 * 100) / 1e7 AS lat, (-170000000 + event_id * 104729 % 4000 * 100) / 1e7 AS lon,
    CAST(json_extract_string(props, '$.k') AS INT) AS ele, 90 + CAST(json_extract_string(props, '$.k') AS INT) AS hr, CAST(floor(value) AS INT) AS pwr
  FROM events)"""


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settlements ``(id, name, kind, lat_e7, lon_e7)`` from suppliers and points of interest from parts."""
    s = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("settlement").alias("kind"),
        (326000000 + F.col("s_suppkey") * 7919 % 4000 * 1000).alias("lat_e7"), (-170000000 + F.col("s_suppkey") * 104729 % 4000 * 1000).alias("lon_e7"))
    p = table(spark, sf_dir, "part").select(
        (F.col("p_partkey") + 1000000).alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("kind"),
        (326000000 + F.col("p_partkey") * 6007 % 4000 * 1000).alias("lat_e7"), (-170000000 + F.col("p_partkey") * 9973 % 4000 * 1000).alias("lon_e7"))
    return s.unionByName(p)


PLACES_SQL = """places AS (
  SELECT s_suppkey AS id, s_name AS name, 'settlement' AS kind, 326000000 + s_suppkey * 7919 % 4000 * 1000 AS lat_e7, -170000000 + s_suppkey * 104729 % 4000 * 1000 AS lon_e7 FROM supplier
  UNION ALL
  SELECT p_partkey + 1000000, p_name, p_brand, 326000000 + p_partkey * 6007 % 4000 * 1000, -170000000 + p_partkey * 9973 % 4000 * 1000 FROM part)"""
