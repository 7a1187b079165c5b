"""Track queries over the event table, each with its SQL counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import tracks as T
from ..sources.adapters import TRACK_POINTS_SQL, track_points

#: Test tracks have hours between fixes, so their pause gap is six hours (30 s for recordings).
PAUSE_US = 6 * 3600 * 1_000_000
SPLIT_DM = 100_000
MOST_HR, THRESHOLD_W = 190, 60


def _legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legs between all fixes."""
    return T.legs(track_points(spark, sf_dir), PAUSE_US)


def _ridden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legs between accepted fixes, on which a ride's statistics stand."""
    return T.legs(T.accepted(track_points(spark, sf_dir)), PAUSE_US)


def tile_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-01, AGG-19"""
    return track_points(spark, sf_dir).groupBy(geo.tile_name(F.col("lat"), F.col("lon")).alias("tile")).agg(F.count("*").alias("n"))


def mercator_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-02"""
    x, y = geo.mercator_tile(F.col("lat"), F.col("lon"), 12)
    return track_points(spark, sf_dir).groupBy(x.alias("x"), y.alias("y")).agg(F.count("*").alias("n"))


def leg_octants(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = geo.bearing_deg(F.col("lat0"), F.col("lon0"), F.col("lat"), F.col("lon"))
    return _legs(spark, sf_dir).filter("ridden AND dm > 0").groupBy(geo.compass_octant(b).alias("octant")).agg(F.count("*").alias("n"), F.sum("dm").alias("distance_dm"))


def box_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-06"""
    inside = F.col("lat").between(32.61, 32.62) & F.col("lon").between(-16.99, -16.97)
    return track_points(spark, sf_dir).filter(inside).select("track_id", "event_id")


def power_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-12: cut points of the classes, in hundredths"""
    cuts = F.percentile("pwr", F.array(*map(F.lit, (0.2, 0.4, 0.6, 0.8))))
    q = track_points(spark, sf_dir).groupBy("kind").agg(cuts.alias("q"))
    return q.select("kind", *[geo.whole(F.col("q")[i], 100.0).alias(f"q{i + 1}") for i in range(4)])


def ride_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-11, AGG-01, AGG-02: the whole statistics of each ride, over accepted fixes"""
    return T.ride_statistics(track_points(spark, sf_dir), PAUSE_US)


QUERIES = {
    "ride_totals": lambda s, d: T.ride_totals(_ridden(s, d)),
    "ride_statistics": ride_statistics,
    "accepted_fixes": lambda s, d: T.accepted(track_points(s, d)).select("track_id", "event_id"),
    "elevation_gain": lambda s, d: T.elevation_gain(track_points(s, d)),
    "splits": lambda s, d: T.splits(_ridden(s, d), SPLIT_DM),
    "effort": lambda s, d: T.effort(_ridden(s, d)),
    "heart_zones": lambda s, d: T.zones(_ridden(s, d), "hr", MOST_HR, T.HEART_ZONE_PERCENT),
    "power_zones": lambda s, d: T.zones(_ridden(s, d), "pwr", THRESHOLD_W, T.POWER_ZONE_PERCENT),
    "repeated_share": lambda s, d: T.repeated_share(_legs(s, d)),
    "smoothed_elevation": lambda s, d: T.smoothed(track_points(s, d)),
    "kind_runs": lambda s, d: T.runs(_legs(s, d)),
    "thinned_fixes": lambda s, d: T.thinned(track_points(s, d), 7),
    "tile_counts": tile_counts,
    "mercator_counts": mercator_counts,
    "leg_octants": leg_octants,
    "box_points": box_points,
    "power_quantiles": power_quantiles,
}

_HAVERSINE = "2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians({b} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({b})) * pow(sin(radians({d} - {c}) / 2), 2))))"
#: Fixes later than the last accepted one, and not faster from it than plausible.
_ACCEPTED = f"""WITH RECURSIVE {TRACK_POINTS_SQL}, numbered AS (
  SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY ts_us, event_id) AS n FROM points
), fold AS (
  SELECT track_id, n, event_id, lat AS lat_kept, lon AS lon_kept, ts_us AS ts_kept, true AS ok FROM numbered WHERE n = 1
  UNION ALL
  SELECT track_id, n, event_id, CASE WHEN ok THEN lat ELSE lat_kept END, CASE WHEN ok THEN lon ELSE lon_kept END, CASE WHEN ok THEN ts_us ELSE ts_kept END, ok
  FROM (SELECT x.*, lat_kept, lon_kept, ts_kept, x.ts_us > ts_kept AND {_HAVERSINE.format(a="lat_kept", b="lat", c="lon_kept", d="lon")} * 1e6 / nullif(x.ts_us - ts_kept, 0) <= 30 AS ok
    FROM fold f JOIN numbered x ON x.track_id = f.track_id AND x.n = f.n + 1)
), accepted AS (SELECT points.* FROM points JOIN fold USING (track_id, event_id) WHERE ok)"""
_MEASURED = f"""lagged AS (
  SELECT *, lag(lat) OVER w AS lat0, lag(lon) OVER w AS lon0, lag(ts_us) OVER w AS ts0, lag(pwr) OVER w AS pwr0, lag(kind) OVER w AS kind0
  FROM {{source}} WINDOW w AS (PARTITION BY track_id ORDER BY ts_us, event_id)
), measured AS (
  SELECT *, ts_us - ts0 AS dur_us, CASE WHEN lat0 IS NOT NULL THEN CAST(floor(10 * 2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians(lat - lat0) / 2), 2)
    + cos(radians(lat0)) * cos(radians(lat)) * pow(sin(radians(lon - lon0) / 2), 2)))) + 0.5) AS BIGINT) END AS dm FROM lagged
), flagged AS (
  SELECT *, coalesce(dur_us > 0 AND dur_us <= {PAUSE_US} AND dm * 100000.0::DOUBLE / dur_us <= 30, false) AS ridden FROM measured
), legs AS (
  SELECT *, ridden AND dm * 100000.0::DOUBLE / dur_us > 1000::DOUBLE / 3600 AS moving, CASE WHEN ridden THEN dm * 100000.0::DOUBLE / dur_us END AS speed FROM flagged
)"""
_LEGS = f"WITH {TRACK_POINTS_SQL}, " + _MEASURED.format(source="points")
_RIDDEN = f"{_ACCEPTED}, " + _MEASURED.format(source="accepted")
_ZONES = _RIDDEN + " SELECT track_id, CAST({0} AS INT) AS zone, CAST(sum(dur_us) AS BIGINT) AS time_us FROM legs WHERE ridden AND {1} IS NOT NULL GROUP BY ALL"


def _zone(value: str, most: int, percents: tuple[int, ...]) -> str:
    return _ZONES.format("1 + " + " + ".join(f"CAST({value} * 100 >= {most * p} AS INT)" for p in percents), value)


ORACLE = {
    "accepted_fixes": _ACCEPTED + " SELECT track_id, event_id FROM accepted",
    "ride_totals": _RIDDEN + """ SELECT track_id, count(*) AS n_points, CAST(coalesce(sum(dm) FILTER (ridden), 0) AS BIGINT) AS distance_dm,
      CAST(coalesce(sum(dur_us) FILTER (moving), 0) AS BIGINT) AS moving_us, max(ts_us) - min(ts_us) AS elapsed_us,
      CAST(floor(max(speed) * 100 + 0.5) AS BIGINT) AS max_speed_cmps, CAST(floor(sum(hr)::DOUBLE / count(hr) + 0.5) AS BIGINT) AS avg_hr,
      max(hr) AS max_hr, CAST(floor(sum(pwr)::DOUBLE / count(pwr) + 0.5) AS BIGINT) AS avg_power FROM legs GROUP BY track_id""",
    "splits": _RIDDEN + f""", along AS (
      SELECT track_id, dm, dur_us, ridden, sum(CASE WHEN ridden THEN dm ELSE 0 END) OVER (PARTITION BY track_id ORDER BY ts_us, event_id)::BIGINT AS b FROM legs
    ), cut AS (SELECT *, b - dm AS a, unnest(generate_series((b - dm) // {SPLIT_DM}, (b - 1) // {SPLIT_DM})) AS split FROM along WHERE ridden AND dm > 0
    ), own AS (SELECT *, least(b, (split + 1) * {SPLIT_DM}) - greatest(a, split * {SPLIT_DM}) AS own FROM cut)
    SELECT track_id, split, CAST(sum(own) AS BIGINT) AS distance_dm, CAST(sum(CAST(floor(dur_us::DOUBLE / dm * own) AS BIGINT)) AS BIGINT) AS time_us FROM own GROUP BY ALL""",
    "effort": _RIDDEN + """ SELECT track_id, CAST(sum(dur_us) AS BIGINT) AS moving_us, CAST(sum((pwr + pwr0) * dur_us) AS BIGINT) AS double_work_uj,
      CAST(sum(hr * dur_us) AS BIGINT) AS beat_us_minutes, max(pwr) AS max_power FROM legs WHERE moving GROUP BY track_id""",
    "heart_zones": _zone("hr", MOST_HR, T.HEART_ZONE_PERCENT),
    "power_zones": _zone("pwr", THRESHOLD_W, T.POWER_ZONE_PERCENT),
    "repeated_share": _LEGS + """, ends AS (
      SELECT track_id, ts_us, event_id, dm, [CAST(floor(lat0 * 1e4 + 0.5) AS BIGINT), CAST(floor(lon0 * 1e4 + 0.5) AS BIGINT)] AS p,
        [CAST(floor(lat * 1e4 + 0.5) AS BIGINT), CAST(floor(lon * 1e4 + 0.5) AS BIGINT)] AS q FROM legs WHERE dm IS NOT NULL
    ), nth AS (SELECT *, row_number() OVER (PARTITION BY track_id, least(p, q), greatest(p, q) ORDER BY ts_us, event_id) AS nth FROM ends WHERE p <> q)
    SELECT track_id, CAST(sum(dm) AS BIGINT) AS length_dm, CAST(sum(CASE WHEN nth > 1 THEN dm ELSE 0 END) AS BIGINT) AS repeated_dm FROM nth GROUP BY track_id""",
    "elevation_gain": f"""WITH RECURSIVE {TRACK_POINTS_SQL}, numbered AS (
      SELECT track_id, ele, row_number() OVER (PARTITION BY track_id ORDER BY ts_us, event_id) AS n FROM points WHERE ele IS NOT NULL
    ), fold AS (
      SELECT track_id, n, CAST(ele AS BIGINT) AS anchor, 0::BIGINT AS up, 0::BIGINT AS down FROM numbered WHERE n = 1
      UNION ALL
      SELECT f.track_id, x.n, CASE WHEN abs(x.ele - f.anchor) >= 3 THEN x.ele ELSE f.anchor END,
        f.up + CASE WHEN x.ele - f.anchor >= 3 THEN x.ele - f.anchor ELSE 0 END, f.down + CASE WHEN f.anchor - x.ele >= 3 THEN f.anchor - x.ele ELSE 0 END
      FROM fold f JOIN numbered x ON x.track_id = f.track_id AND x.n = f.n + 1)
    SELECT track_id, max_by(up, n)::DOUBLE AS ascent_m, max_by(down, n)::DOUBLE AS descent_m FROM fold GROUP BY track_id""",
    "smoothed_elevation": f"""WITH {TRACK_POINTS_SQL} SELECT track_id, event_id, CAST(floor(sum(ele) OVER w * 1000::DOUBLE / count(ele) OVER w + 0.5) AS BIGINT) AS mean_mm
      FROM points WINDOW w AS (PARTITION BY track_id ORDER BY ts_us, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)""",
    "kind_runs": _LEGS + """, numbered AS (SELECT *, sum(CASE WHEN kind0 IS NOT DISTINCT FROM kind THEN 0 ELSE 1 END) OVER (PARTITION BY track_id ORDER BY ts_us, event_id)::BIGINT AS run FROM legs)
      SELECT track_id, run, kind, count(*) AS n_points, min(ts_us) AS from_us, max(ts_us) AS to_us FROM numbered GROUP BY ALL""",
    "thinned_fixes": f"""WITH {TRACK_POINTS_SQL}, x AS (SELECT track_id, event_id, CAST(row_number() OVER (PARTITION BY track_id ORDER BY ts_us, event_id) AS INT) AS n, count(*) OVER (PARTITION BY track_id) AS last FROM points)
      SELECT track_id, event_id, n FROM x WHERE (n - 1) % 7 = 0 OR n = last""",
    "tile_counts": f"""WITH {TRACK_POINTS_SQL}, c AS (SELECT CAST(floor(lon / 5) * 5 AS INT) AS x, CAST(floor(lat / 5) * 5 AS INT) AS y FROM points)
      SELECT (CASE WHEN x < 0 THEN 'W' ELSE 'E' END) || abs(x) || '_' || (CASE WHEN y < 0 THEN 'S' ELSE 'N' END) || abs(y) AS tile, count(*) AS n FROM c GROUP BY ALL""",
    "mercator_counts": f"""WITH {TRACK_POINTS_SQL} SELECT CAST(floor((lon + 180) / 360 * 4096) AS INT) AS x,
      CAST(floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 4096) AS INT) AS y, count(*) AS n FROM points GROUP BY ALL""",
    "leg_octants": _LEGS + """, b AS (SELECT dm, degrees(atan2(sin(radians(lon - lon0)) * cos(radians(lat)),
        cos(radians(lat0)) * sin(radians(lat)) - sin(radians(lat0)) * cos(radians(lat)) * cos(radians(lon - lon0)))) AS turn FROM legs WHERE ridden AND dm > 0)
      SELECT CAST(floor(((CASE WHEN turn < 0 THEN turn + 360 ELSE turn END) + 22.5) / 45) % 8 AS INT) AS octant, count(*) AS n, CAST(sum(dm) AS BIGINT) AS distance_dm FROM b GROUP BY ALL""",
    "box_points": f"WITH {TRACK_POINTS_SQL} SELECT track_id, event_id FROM points WHERE lat BETWEEN 32.61 AND 32.62 AND lon BETWEEN -16.99 AND -16.97",
    "power_quantiles": f"WITH {TRACK_POINTS_SQL} SELECT kind, " + ", ".join(f"CAST(floor(quantile_cont(pwr, {q}) * 100 + 0.5) AS BIGINT) AS q{i + 1}" for i, q in enumerate((0.2, 0.4, 0.6, 0.8))) + " FROM points GROUP BY kind",
}

_TOTALS = ORACLE["ride_totals"][len(_RIDDEN) :]
ORACLE["ride_statistics"] = _RIDDEN + f""", totals AS ({_TOTALS}), held AS (SELECT track_id, ele, row_number() OVER (PARTITION BY track_id ORDER BY ts_us, event_id) AS n FROM accepted WHERE ele IS NOT NULL),
  rise AS (SELECT track_id, n, CAST(ele AS BIGINT) AS anchor, 0::BIGINT AS up, 0::BIGINT AS down FROM held WHERE n = 1
    UNION ALL SELECT f.track_id, x.n, CASE WHEN abs(x.ele - f.anchor) >= 3 THEN x.ele ELSE f.anchor END, f.up + greatest(0, CASE WHEN abs(x.ele - f.anchor) >= 3 THEN x.ele - f.anchor ELSE 0 END),
      f.down + greatest(0, CASE WHEN abs(x.ele - f.anchor) >= 3 THEN f.anchor - x.ele ELSE 0 END) FROM rise f JOIN held x ON x.track_id = f.track_id AND x.n = f.n + 1),
  climbed AS (SELECT track_id, max_by(up, n)::DOUBLE AS ascent_m, max_by(down, n)::DOUBLE AS descent_m FROM rise GROUP BY track_id)
  SELECT totals.*, coalesce(ascent_m, 0) AS ascent_m, coalesce(descent_m, 0) AS descent_m FROM totals LEFT JOIN climbed USING (track_id)"""
