"""Place, search, table-maintenance and weather queries, each with its SQL counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import places as P
from ..operators import weather as W
from ..sources.adapters import PLACES_SQL, places, table

RADIUS_M = 5000
WORDS = ("the", "and", "der", "que", "for")


def nearest_settlement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-05"""
    all_places = places(spark, sf_dir)
    return P.nearest_within(all_places.filter("kind <> 'settlement'"), all_places.filter("kind = 'settlement'"), RADIUS_M)


def merged_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-03, SET-05: two overlapping extracts, the first one wins"""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", F.col("o_custkey").alias("importance"))
    second = o.filter("o_orderkey % 3 = 0").withColumn("o_orderpriority", F.lit("second")).withColumn("importance", F.col("importance") + 7)
    return P.merged_by_identity([o.filter("o_orderkey % 2 = 0"), second], ["o_orderkey"], "importance")


def merged_extracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-03, SET-05: all orders, urgent ones again from a second extract, and a third whose rows have no identity"""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", F.col("o_custkey").alias("importance"), "o_orderstatus")
    first = o.drop("o_orderstatus")
    second = first.filter("o_orderpriority = '1-URGENT'").withColumn("o_orderpriority", F.lit("second")).withColumn("importance", F.col("importance") + 7)
    third = o.filter("o_orderstatus = 'P'").drop("o_orderstatus").withColumn("o_orderkey", F.lit(None).cast(o.schema["o_orderkey"].dataType))
    return P.merged_by_identity([first, second, third], ["o_orderkey"], "importance")


def customers_without_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-03"""
    return P.orphans(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", table(spark, sf_dir, "orders"), "o_custkey")


def kinds_taking_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-01"""
    return P.taking_turns(places(spark, sf_dir).filter("kind <> 'settlement'").select("id", "kind"), "kind", F.desc("id"), limit=60)


def interpolated_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-16: hourly means of the event table at the instants of its purchases"""
    e = table(spark, sf_dir, "events").withColumn("s", F.unix_seconds(F.col("ts").cast("timestamp")))
    return W.interpolated(e.filter("event_type = 'purchase'").select("event_id", "s"), W.hourly(e)).select("event_id", "s", "milli")


def best_departures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT-07: lines of an order are its departures"""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("route"), (F.col("l_linenumber") - 1).cast("int").alias("step")).agg(F.sum(F.col("l_quantity").cast("long")).alias("score"))
    with_now = lines.filter("step = 0").select("route")
    return W.best_departure(lines.join(with_now, "route", "left_semi"))


def surface_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-13: shares of a route's length, in thousandths"""
    q = F.col("l_quantity").cast("long")
    part = lambda c: F.coalesce(F.sum(F.when(c, q)), F.lit(0))
    sums = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(q).alias("length"), part(F.col("l_returnflag") == "R").alias("rough"), part(F.col("l_linestatus") == "O").alias("open"))
    return sums.select("l_orderkey", "length", *[F.floor(F.col(c) * 1000 / F.col("length")).cast("long").alias(f"{c}_permille") for c in ("rough", "open")])


def hours_with_traffic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-30: status counts, zero rows present"""
    e = table(spark, sf_dir, "events")
    kinds, statuses = e.select("event_type").distinct(), e.select(F.hour("ts").alias("hour")).distinct()
    counted = e.groupBy("event_type", F.hour("ts").alias("hour")).agg(F.count("*").alias("n"))
    spine = kinds.join(F.broadcast(statuses), F.lit(True))  # a few kinds by 24 hours
    return spine.join(counted, ["event_type", "hour"], "left").select("event_type", "hour", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


QUERIES = {
    "nearest_settlement": nearest_settlement,
    "merged_orders": merged_orders,
    "merged_extracts": merged_extracts,
    "vocabulary": lambda s, d: P.vocabulary(table(s, d, "documents")),
    "ranked_search": lambda s, d: P.search(table(s, d, "documents"), WORDS, 60),
    "customers_without_orders": customers_without_orders,
    "kinds_taking_turns": kinds_taking_turns,
    "interpolated_weather": interpolated_weather,
    "best_departures": best_departures,
    "surface_shares": surface_shares,
    "hours_with_traffic": hours_with_traffic,
}

_TOKENS = "list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: w <> '')"

ORACLE = {
    "nearest_settlement": f"""WITH {PLACES_SQL}, met AS (
      SELECT a.id, b.id AS near_id, CAST(floor(sqrt(pow((a.lat_e7 / 1e7 - b.lat_e7 / 1e7) * 111320, 2) + pow((a.lon_e7 / 1e7 - b.lon_e7 / 1e7) * 111320 * cos(radians(a.lat_e7 / 1e7)), 2)) * 1000 + 0.5) AS BIGINT) AS mm
      FROM places a, places b WHERE a.kind <> 'settlement' AND b.kind = 'settlement')
    SELECT id, arg_min(near_id, {{'d': mm, 'i': near_id}}) AS near_id, min(mm) AS distance_mm FROM met WHERE mm < {RADIUS_M * 1000} AND id <> near_id GROUP BY id""",
    "merged_orders": """WITH both_inputs AS (
      SELECT o_orderkey, o_orderpriority, o_custkey AS importance, 0 AS input FROM orders WHERE o_orderkey % 2 = 0
      UNION ALL SELECT o_orderkey, 'second', o_custkey + 7, 1 FROM orders WHERE o_orderkey % 3 = 0)
    SELECT o_orderkey, arg_min(o_orderpriority, input) AS o_orderpriority, max(importance) AS importance, count(*) AS n_inputs FROM both_inputs GROUP BY o_orderkey""",
    "merged_extracts": """WITH all_inputs AS (
      SELECT o_orderkey, o_orderpriority, o_custkey AS importance, 0 AS input FROM orders
      UNION ALL SELECT o_orderkey, 'second', o_custkey + 7, 1 FROM orders WHERE o_orderpriority = '1-URGENT')
    SELECT o_orderkey, arg_min(o_orderpriority, input) AS o_orderpriority, max(importance) AS importance, count(*) AS n_inputs FROM all_inputs GROUP BY o_orderkey
    UNION ALL SELECT NULL, o_orderpriority, o_custkey, 1 FROM orders WHERE o_orderstatus = 'P'""",
    "vocabulary": f"WITH t AS (SELECT unnest(list_distinct({_TOKENS})) AS term FROM documents) SELECT term, count(*) AS docs FROM t GROUP BY term",
    "ranked_search": f"""SELECT doc_id, hits, chars FROM (SELECT doc_id, CAST(len(list_intersect(list_distinct({_TOKENS}), {list(WORDS)})) AS INT) AS hits, CAST(length(text) AS INT) AS chars FROM documents)
      WHERE hits > 0 ORDER BY hits DESC, chars, doc_id LIMIT 60""",
    "customers_without_orders": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)",
    "kinds_taking_turns": f"""WITH {PLACES_SQL} SELECT id, kind, CAST(turn AS INT) AS turn FROM (
      SELECT id, kind, row_number() OVER (PARTITION BY kind ORDER BY id DESC) AS turn FROM places WHERE kind <> 'settlement') ORDER BY turn, id DESC LIMIT 60""",
    "interpolated_weather": """WITH e AS (SELECT *, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS s FROM events),
      h AS (SELECT s // 3600 AS hour, CAST(floor(sum(CAST(floor(value * 1000) AS BIGINT))::DOUBLE / count(*)) AS BIGINT) AS milli FROM e GROUP BY ALL)
      SELECT event_id, s, CAST(floor((l.milli * (3600 - s % 3600) + u.milli * (s % 3600))::DOUBLE / 3600) AS BIGINT) AS milli FROM e
      LEFT JOIN h l ON l.hour = s // 3600 LEFT JOIN h u ON u.hour = s // 3600 + 1 WHERE event_type = 'purchase'""",
    "best_departures": """WITH lines AS (SELECT l_orderkey AS route, CAST(l_linenumber - 1 AS INT) AS step, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS score FROM lineitem GROUP BY ALL),
      b AS (SELECT route, arg_min(step, {'s': score, 'k': step}) AS step, min(score) AS score, max(score) FILTER (step = 0) AS now FROM lines GROUP BY route)
      SELECT route, CASE WHEN score * 100 <= now * 80 THEN step ELSE 0 END AS step, CASE WHEN score * 100 <= now * 80 THEN score ELSE now END AS score FROM b WHERE now IS NOT NULL""",
    "surface_shares": """WITH s AS (SELECT l_orderkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS length, coalesce(sum(CAST(l_quantity AS BIGINT)) FILTER (l_returnflag = 'R'), 0) AS rough,
      coalesce(sum(CAST(l_quantity AS BIGINT)) FILTER (l_linestatus = 'O'), 0) AS open FROM lineitem GROUP BY l_orderkey)
      SELECT l_orderkey, length, CAST(floor(rough * 1000 / length::DOUBLE) AS BIGINT) AS rough_permille, CAST(floor(open * 1000 / length::DOUBLE) AS BIGINT) AS open_permille FROM s""",
    "hours_with_traffic": """WITH c AS (SELECT event_type, CAST(hour(ts) AS INT) AS hour, count(*) AS n FROM events GROUP BY ALL)
      SELECT k.event_type, h.hour, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT event_type FROM events) k CROSS JOIN (SELECT DISTINCT CAST(hour(ts) AS INT) AS hour FROM events) h
      LEFT JOIN c ON c.event_type = k.event_type AND c.hour = h.hour""",
}
