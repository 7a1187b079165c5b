"""Queries of the folds that also run on streams, over whole tables, named by their number, with SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.adapters import table
from ..streaming import rides, sensors
from .tracks import _HAVERSINE

#: Events as a ride a user, a thousand times faster and on a field of 90 m, some of them the rider's pauses and resumes.
_RIDES = """SELECT user_id AS ride_id, {micros} DIV 1000 AS at_us, event_id AS seq, CASE event_type WHEN 'purchase' THEN 'pause' WHEN 'error' THEN 'resume' ELSE 'fix' END AS what,
  (326000000 + event_id * 7919 % 4000 * 2) / CAST(10000000 AS DOUBLE) AS lat, (-170000000 + event_id * 104729 % 4000 * 2) / CAST(10000000 AS DOUBLE) AS lon FROM {rows}"""


def stm_01_recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM-01, STM-02: what the recorder writes, with automatic pauses between fixes."""
    sql = _RIDES.replace("{micros}", "unix_micros(CAST(ts AS TIMESTAMP))")
    events = spark.sql(sql, rows=table(spark, sf_dir, "events")).withColumn("at", F.timestamp_micros("at_us")).withColumn("speed", F.lit(None).cast("double"))
    return rides.recorded(events)


def stm_09_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of each user, four thousand times faster, against 90 in 15 minutes."""
    micros = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 4000)
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.timestamp_micros(micros).alias("at"), F.col("event_id").alias("seq"))
    return sensors.folded(rows, "limited")


QUERIES = {f.__name__: f for f in (stm_01_recorded, stm_09_limits)}

_LEG = _HAVERSINE.format(a="r.lat", b="e.lat", c="r.lon", d="e.lon")
ORACLE = {
    "stm_01_recorded": f"""WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY ride_id ORDER BY at_us, seq) AS k FROM ({_RIDES.replace('{micros}', 'epoch_us(ts)').replace('DIV', '//').replace('{rows}', 'events')})),
      r AS (
        SELECT ride_id, 0::BIGINT AS k, 0::BIGINT AS at_us, false AS paused, false AS auto, NULL::BIGINT AS moved, NULL::BIGINT AS last, NULL::DOUBLE AS lat, NULL::DOUBLE AS lon, 0::BIGINT AS mm, 0::BIGINT AS moving, 0::BIGINT AS n,
          0::BIGINT AS mm0, 0::BIGINT AS moving0, 0::BIGINT AS n0, NULL::BIGINT AS ticked, false AS pausing, false AS resuming, false AS fixed, false AS woken FROM (SELECT DISTINCT ride_id FROM e)
        UNION ALL
        SELECT ride_id, k, at_us, CASE WHEN pausing THEN true WHEN resuming OR woken THEN false ELSE paused1 END, CASE WHEN pausing OR resuming OR woken THEN false ELSE auto1 END,
          CASE WHEN resuming OR fixed AND fast THEN at_us ELSE moved0 END, CASE WHEN fixed THEN at_us ELSE last END, CASE WHEN fixed THEN y ELSE lat END, CASE WHEN fixed THEN x ELSE lon END,
          CASE WHEN fixed AND near THEN mm + CAST(floor(leg * 1000 + 0.5) AS BIGINT) ELSE mm END, CASE WHEN fixed AND fast THEN moving + took ELSE moving END, n + fixed::BIGINT, mm, moving, n, ticked, pausing, resuming, fixed, woken
        FROM (SELECT *, fixed AND fast AND auto1 AS woken FROM (
          SELECT *, what = 'pause' AND (NOT paused1 OR auto1) AS pausing, what = 'resume' AND paused1 AS resuming,
            what = 'fix' AND (NOT paused1 OR auto1) AND (last IS NULL OR took > 0 AND leg / (took / 1e6::DOUBLE) <= 30) AS fixed, coalesce(took <= 30000000, false) AS near, coalesce(took <= 30000000 AND leg / (took / 1e6::DOUBLE) >= 1000::DOUBLE / 3600, false) AS fast
          FROM (SELECT *, paused OR ticked IS NOT NULL AS paused1, auto OR ticked IS NOT NULL AS auto1 FROM (
            SELECT r.ride_id, e.k, e.at_us, e.what, e.lat AS y, e.lon AS x, r.paused, r.auto, r.last, r.lat, r.lon, r.mm, r.moving, r.n, coalesce(r.moved, e.at_us) AS moved0, e.at_us - r.last AS took, {_LEG} AS leg,
              CASE WHEN NOT r.paused AND e.at_us >= coalesce(r.moved, e.at_us) + 10000000 THEN r.moved + 10000000 END AS ticked FROM r JOIN e ON e.ride_id = r.ride_id AND e.k = r.k + 1)))))
      SELECT ride_id, ticked AS at_us, 'auto-paused' AS what, mm0 AS distance_mm, moving0 AS moving_us, n0 AS n_fixes FROM r WHERE ticked IS NOT NULL
      UNION ALL SELECT ride_id, at_us, 'paused', mm, moving, n FROM r WHERE pausing UNION ALL SELECT ride_id, at_us, 'fix', mm, moving, n FROM r WHERE fixed UNION ALL SELECT ride_id, at_us, 'resumed', mm, moving, n FROM r WHERE resuming OR woken""",
    "stm_09_limits": """WITH RECURSIVE e AS (SELECT user_id AS key, epoch_us(ts) // 4000 AS at_us, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 4000, event_id) AS k FROM events),
      r AS (SELECT DISTINCT key, 0::BIGINT AS k, 0::BIGINT AS at_us, 0::BIGINT AS seq, []::BIGINT[] AS kept, true AS accepted, 0::BIGINT AS wait_us FROM e
        UNION ALL
        SELECT key, k, at_us, seq, CASE WHEN len(live) < 90 THEN list_append(live, at_us) ELSE live END, len(live) < 90, CASE WHEN len(live) < 90 THEN 0 ELSE live[1] + 900000000 - at_us END
        FROM (SELECT e.*, list_filter(r.kept, lambda x: x > e.at_us - 900000000) AS live FROM r JOIN e ON e.key = r.key AND e.k = r.k + 1))
      SELECT key, at_us, seq, accepted, wait_us FROM r WHERE k > 0""",
}
