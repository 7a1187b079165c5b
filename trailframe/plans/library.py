"""Library, text and window queries, each with its SQL counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.geo import whole
from ..operators import library as L
from ..operators import tracks as T
from ..sources.adapters import PLACES_SQL, TRACK_POINTS_SQL, places, table, track_points
from ..streaming import live

DAY_US = 86_400_000_000
GAP_HOURS, LIMIT = 6, 3
HERE_LAT_E7, HERE_LON_E7 = 328000000, -168000000


def folded_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-01, STR-04, STR-06, AGG-18"""
    terms = table(spark, sf_dir, "documents").select(F.explode(F.array_distinct(text.words(text.fold(F.col("text"))))).alias("term"))
    return terms.groupBy("term").agg(F.count("*").alias("docs")).withColumn("edits", text.allowed_edits(F.col("term")))


def moving_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-04: five heights, the window moved inward at the ends of a track; shorter tracks unchanged."""
    p = track_points(spark, sf_dir).filter("ele IS NOT NULL")
    w = T.in_time()
    i, n, near = F.row_number().over(w) - 1, F.count("*").over(Window.partitionBy("track_id")), F.collect_list("ele").over(w.rowsBetween(-4, 4))
    rows = p.select("track_id", "event_id", "ele", i.alias("i"), n.cast("int").alias("n"), near.alias("near"))
    start = F.greatest(F.lit(0), F.least(F.col("i") - 2, F.col("n") - 5)) - (F.col("i") - F.least(F.col("i"), F.lit(4)))
    middle = F.get(F.array_sort(F.slice("near", start + 1, F.lit(5))), F.lit(2))
    return rows.select("track_id", "event_id", F.when(F.col("n") < 5, F.col("ele")).otherwise(middle).alias("median_m"))


def distance_along(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-04"""
    rows = T.legs(track_points(spark, sf_dir), GAP_HOURS * 3_600_000_000)
    return rows.select("track_id", "event_id", F.sum(F.coalesce("dm", F.lit(0))).over(T.in_time()).alias("along_dm"))


def weather_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GEO-09: fixes by cell of 0.025 degrees"""
    cell = lambda c: whole(F.col(c), 40.0)
    return track_points(spark, sf_dir).groupBy(cell("lat").alias("y"), cell("lon").alias("x")).agg(F.count("*").alias("n"))


def timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return track_points(spark, sf_dir).withColumn("at", F.timestamp_micros("ts_us"))


def _suppliers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The table before and after an edit: overdrawn accounts are cleared, ids move on by five."""
    before = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), whole(F.col("s_acctbal").cast("double"), 100.0).alias("cents"), F.lit(1).alias("version"))
    return before, before.select((F.col("id") + 5).alias("id"), "name", F.when(F.col("cents") >= 0, F.col("cents")).alias("cents"))


_SUPPLIERS = """before AS (SELECT s_suppkey AS id, s_name AS name, CAST(floor(CAST(s_acctbal AS DOUBLE) * 100 + 0.5) AS BIGINT) AS cents FROM supplier),
  after AS (SELECT id + 5 AS id, name, CASE WHEN cents >= 0 THEN cents END AS cents FROM before)"""


def synced_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-07"""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.col("c_nationkey").cast("long").alias("at"))
    local = c.select("c_custkey", "c_name", (F.col("c_custkey") % 2 == 0).alias("dirty"), F.col("at").alias("changed_at"))
    remote = c.select("c_custkey", F.concat(F.col("c_name"), F.lit("*")).alias("c_name"), F.when(F.col("c_custkey") % 3 == 0, F.col("at")).otherwise(F.lit(12)).alias("changed_at"))
    return L.applied(local, remote, "c_custkey", "c_name")


def _terms(spark: SparkSession, sf_dir: str, name: str, column: str) -> DataFrame:
    return table(spark, sf_dir, name).select(F.explode(text.words(text.fold(F.col(column)))).alias("term")).distinct()


def nations_or_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.min("s_name").alias("name"))
    return L.with_fallback(own, table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"), F.col("n_name").alias("name")), "nation")


def newest_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-29"""
    o = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderdate").cast("date").alias("o_orderdate"), "o_orderkey")
    return L.in_force(o, "o_custkey", "o_orderdate", "o_orderkey", "1996-01-01")


QUERIES = {
    "folded_vocabulary": folded_vocabulary,
    "moving_median": moving_median,
    "distance_along": distance_along,
    "weather_cells": weather_cells,
    "ride_sessions": lambda s, d: live.sessions(timed(s, d), "track_id", f"{GAP_HOURS} hours"),
    "limited_requests": lambda s, d: live.limited(timed(s, d), "track_id", "1 day", LIMIT),
    "sliding_kinds": lambda s, d: live.sliding(timed(s, d), "kind", "2 days", "1 day"),
    "upserted_suppliers": lambda s, d: L.upserted(*_suppliers(s, d), "id", ["name", "cents"]),
    "supplier_changes": lambda s, d: L.changes(*_suppliers(s, d), "id", ["name", "cents"]),
    "synced_customers": synced_customers,
    "one_row_per_place": lambda s, d: L.first_of_each(places(s, d), ["name", "lat_e7", "lon_e7"], "id"),
    "nearest_of_each_kind": lambda s, d: L.nearest_of_each_kind(places(s, d), HERE_LAT_E7, HERE_LON_E7, 10),
    "nations_or_suppliers": nations_or_suppliers,
    "term_differences": lambda s, d: L.differences(_terms(s, d, "part", "p_name"), _terms(s, d, "part", "p_type")),
    "newest_orders": newest_orders,
}

_POINTS = f"WITH {TRACK_POINTS_SQL}"


def _words(column: str) -> str:
    return f"regexp_extract_all(translate(lower({column}), '{text.FROM}', '{text.TO}'), '{text.WORD}')"


_DM = """CASE WHEN lat0 IS NOT NULL THEN CAST(floor(10 * 2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians(lat - lat0) / 2), 2)
  + cos(radians(lat0)) * cos(radians(lat)) * pow(sin(radians(lon - lon0) / 2), 2)))) + 0.5) AS BIGINT) END"""

ORACLE = {
    "folded_vocabulary": f"""SELECT term, count(*) AS docs, CASE WHEN length(term) < 4 THEN 0 WHEN length(term) <= 5 THEN 1 ELSE 2 END AS edits
      FROM (SELECT unnest(list_distinct({_words("text")})) AS term FROM documents) GROUP BY term""",
    "moving_median": _POINTS + """, x AS (SELECT track_id, event_id, ele, row_number() OVER (PARTITION BY track_id ORDER BY ts_us, event_id) AS i, count(*) OVER (PARTITION BY track_id) AS n FROM points WHERE ele IS NOT NULL)
      SELECT a.track_id, a.event_id, CASE WHEN any_value(a.n) < 5 THEN any_value(a.ele) ELSE list_sort(list(b.ele))[3] END AS median_m
      FROM x a JOIN x b ON a.track_id = b.track_id AND b.i BETWEEN greatest(1, least(a.i - 2, a.n - 4)) AND greatest(1, least(a.i - 2, a.n - 4)) + 4 GROUP BY a.track_id, a.event_id""",
    "distance_along": _POINTS + f""", lagged AS (SELECT *, lag(lat) OVER w AS lat0, lag(lon) OVER w AS lon0 FROM points WINDOW w AS (PARTITION BY track_id ORDER BY ts_us, event_id))
      SELECT track_id, event_id, CAST(sum(coalesce({_DM}, 0)) OVER (PARTITION BY track_id ORDER BY ts_us, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS along_dm FROM lagged""",
    "weather_cells": _POINTS + " SELECT CAST(floor(lat * 40::DOUBLE + 0.5) AS BIGINT) AS y, CAST(floor(lon * 40::DOUBLE + 0.5) AS BIGINT) AS x, count(*) AS n FROM points GROUP BY ALL",
    "ride_sessions": _POINTS + f""", f AS (SELECT *, CASE WHEN ts_us - lag(ts_us) OVER w > {GAP_HOURS * 3_600_000_000} THEN 1 ELSE 0 END AS new FROM points WINDOW w AS (PARTITION BY track_id ORDER BY ts_us, event_id)),
      g AS (SELECT *, sum(new) OVER (PARTITION BY track_id ORDER BY ts_us, event_id) AS s FROM f)
      SELECT track_id, min(ts_us) AS from_us, max(ts_us) AS to_us, count(*) AS n_fixes FROM g GROUP BY track_id, s""",
    "limited_requests": _POINTS + f" SELECT track_id, ts_us // {DAY_US} * {DAY_US} AS window_us, count(*) AS n, greatest(count(*) - {LIMIT}, 0) AS refused FROM points GROUP BY ALL",
    "sliding_kinds": _POINTS + f", w AS (SELECT kind, unnest([ts_us // {DAY_US} * {DAY_US}, ts_us // {DAY_US} * {DAY_US} - {DAY_US}]) AS window_us FROM points) SELECT kind, window_us, count(*) AS n FROM w GROUP BY ALL",
    "upserted_suppliers": f"""WITH {_SUPPLIERS} SELECT coalesce(b.id, a.id) AS id, CASE WHEN a.id IS NULL THEN b.name ELSE a.name END AS name, CASE WHEN a.id IS NULL THEN b.cents ELSE a.cents END AS cents,
      CAST((CASE WHEN b.id IS NULL THEN 0 ELSE 1 END) + (CASE WHEN a.id IS NULL THEN 0 ELSE 1 END) AS INT) AS version FROM before b FULL JOIN after a ON a.id = b.id""",
    "supplier_changes": f"""WITH {_SUPPLIERS} SELECT coalesce(b.id, a.id) AS id, CASE WHEN b.id IS NULL THEN 'added' WHEN a.id IS NULL THEN 'removed' ELSE 'changed' END AS change
      FROM before b FULL JOIN after a ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL OR a.name IS DISTINCT FROM b.name OR a.cents IS DISTINCT FROM b.cents""",
    "synced_customers": """WITH x AS (SELECT c_custkey, c_name, c_custkey % 2 = 0 AS dirty, c_nationkey AS here, CASE WHEN c_custkey % 3 = 0 THEN c_nationkey ELSE 12 END AS there FROM customer),
      y AS (SELECT *, CASE WHEN NOT dirty AND here = there THEN 'same_change' WHEN dirty AND here > there THEN 'local_wins' ELSE 'written' END AS outcome FROM x)
      SELECT c_custkey, outcome, CASE WHEN outcome = 'written' THEN c_name || '*' ELSE c_name END AS c_name FROM y""",
    "one_row_per_place": f"WITH {PLACES_SQL} SELECT name, lat_e7, lon_e7, min(id) AS id FROM places GROUP BY ALL",
    "nearest_of_each_kind": f"""WITH {PLACES_SQL}, d AS (SELECT kind, id, (lat_e7 - {HERE_LAT_E7}) * (lat_e7 - {HERE_LAT_E7}) + (lon_e7 - {HERE_LON_E7}) * (lon_e7 - {HERE_LON_E7}) AS d2 FROM places)
      SELECT kind, id, d2 FROM d QUALIFY row_number() OVER (PARTITION BY kind ORDER BY d2, id) = 1 ORDER BY d2, id LIMIT 10""",
    "nations_or_suppliers": "SELECT n_nationkey AS nation, coalesce(min(s_name), min(n_name)) AS name FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey",
    "term_differences": f"""WITH a AS (SELECT DISTINCT unnest({_words("p_name")}) AS term FROM part), b AS (SELECT DISTINCT unnest({_words("p_type")}) AS term FROM part)
      SELECT term, 'left' AS side FROM (FROM a EXCEPT FROM b) UNION ALL SELECT term, 'right' FROM (FROM b EXCEPT FROM a)""",
    "newest_orders": "SELECT o_custkey, arg_max(o_orderkey, (CAST(o_orderdate AS DATE), -o_orderkey)) AS o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) <= DATE '1996-01-01' GROUP BY o_custkey",
}
