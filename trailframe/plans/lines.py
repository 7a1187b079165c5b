"""Queries of lines and climbs, named by their number, with SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import climbs, lines
from ..operators import tracks as T
from ..sources.adapters import PLACES_SQL, TRACK_POINTS_SQL, places, table, track_points
from .tracks import _HAVERSINE, _RIDDEN, _ridden

TOLERANCE = 12000


def _track_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = Window.partitionBy("track_id").orderBy("ts_us", "event_id")
    return track_points(spark, sf_dir).select(F.col("track_id").alias("line_id"), F.row_number().over(by).alias("seq"), "lat", "lon")


def join_13_corridor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All places against all tracks."""
    stops = places(spark, sf_dir).select(F.col("id").alias("stop_id"), (F.col("lat_e7") / 1e7).alias("lat"), (F.col("lon_e7") / 1e7).alias("lon"))
    return lines.stops_along(_track_lines(spark, sf_dir), stops)


def join_13_ahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settlements along the second part of each track, from 100 km on for 50 km."""
    stops = places(spark, sf_dir).filter("kind = 'settlement'").select(F.col("id").alias("stop_id"), (F.col("lat_e7") / 1e7).alias("lat"), (F.col("lon_e7") / 1e7).alias("lon"))
    rows = _track_lines(spark, sf_dir)
    ahead = rows.select("line_id").distinct().select("line_id", F.lit(100_000_000).cast("long").alias("from_mm"), F.lit(150_000_000).cast("long").alias("to_mm"))
    return lines.stops_along(rows, stops, 1000.0, ahead)


def win_16_simplified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.simplified(_track_lines(spark, sf_dir), TOLERANCE)


#: Orders as pieces from one node to the next: each block of 40 has its own attributes, some blocks close to rings, and some nodes have a second piece.
_PIECES = """SELECT o_orderkey AS piece_id, CAST(o_orderkey DIV 40 % 3 AS STRING) AS attrs, CASE WHEN o_custkey % 41 = 0 THEN o_orderkey - 1 ELSE o_orderkey END AS start,
  CASE WHEN o_orderkey % 40 = 39 AND o_orderkey DIV 40 % 4 = 0 THEN o_orderkey - 39 ELSE o_orderkey + 1 END AS end, o_custkey % 9 AS weight FROM {rows}"""


def win_19_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.chained(spark.sql(_PIECES, rows=table(spark, sf_dir, "orders")))


def win_08_climbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return climbs.climbs(_ridden(spark, sf_dir))


def srt_08_biggest_climbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three biggest climbs of each track, in riding order."""
    return climbs.biggest(climbs.climbs(_ridden(spark, sf_dir)), 3).select("track_id", "nth", "rank", "climb", "start_dm", "ascent_m")


def join_14_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes over each 20 km of every track, their corners in units of 1e-6 degrees."""
    found = lines.chunk_boxes(_track_lines(spark, sf_dir), 20_000.0)
    return found.select("line_id", "chunk", *[F.floor(F.col(c) * 1e6 + 0.5).cast("long").alias(c) for c in ("south", "west", "north", "east")])


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = "SELECT o_orderkey AS span_id, o_custkey % 151 AS line_id, o_orderkey * 7919 % 400000 * 1000 AS from_mm, o_orderkey * 7919 % 400000 * 1000 + o_custkey * 3000 AS to_mm FROM {rows}"
    return spark.sql(sql, rows=table(spark, sf_dir, "orders"))


def join_20_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One slice of a track an order: its pieces, and where it begins and ends."""
    found = lines.slice_ends(_track_lines(spark, sf_dir), _spans(spark, sf_dir))
    q = lambda c: F.floor(F.col(c) * 1e5).cast("long")
    return found.select("span_id", "pieces", q("lat").alias("lat_q"), q("lon2").alias("lon_q"))


def win_13_resampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heights of each track at 40 distances."""
    by = Window.partitionBy("track_id").orderBy("ts_us", "event_id")
    along = F.coalesce(F.sum("dm").over(by.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    rows = _ridden(spark, sf_dir).select(F.col("track_id").alias("line_id"), F.row_number().over(by).alias("seq"), along.alias("along"), "ele")
    found = lines.resampled(rows, 40, "ele")
    return found.select("line_id", "nth", F.floor(F.col("along") * 100).cast("long").alias("along_mm"), F.floor(F.col("ele") * 1000 + 1e-6).cast("long").alias("ele_mm"))


SPLIT_DM = 100_000


def agg_05_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splits of 10 km with their climb, all of them."""
    found = T.whole_splits(_ridden(spark, sf_dir), SPLIT_DM)
    return found.withColumn("ascent_m", F.col("ascent_m").cast("long")).withColumn("descent_m", F.col("descent_m").cast("long"))


QUERIES = {f.__name__: f for f in (agg_05_splits, join_14_chunks, join_20_slices, win_13_resampled, join_13_corridor, join_13_ahead, win_16_simplified, win_19_chains, win_08_climbs, srt_08_biggest_climbs)}

_LINES = f"""{TRACK_POINTS_SQL}, pts AS (SELECT track_id AS line_id, row_number() OVER (PARTITION BY track_id ORDER BY ts_us, event_id)::INT AS seq, lat, lon FROM points)"""
_SEGMENTS = f"""{_LINES}, two AS (SELECT line_id, seq - 1 AS segment, lat, lon, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2 FROM pts WINDOW w AS (PARTITION BY line_id ORDER BY seq)),
  len AS (SELECT *, CAST(floor({_HAVERSINE.format(a='lat', b='lat2', c='lon', d='lon2')} * 1000 + 0.5) AS BIGINT) AS mm FROM two WHERE lat2 IS NOT NULL),
  seg AS (SELECT *, sum(mm) OVER (PARTITION BY line_id ORDER BY segment)::BIGINT AS end_mm FROM len)"""


def _corridor(stops: str, corridor: int, span: str) -> str:
    kx, dlat = "cos(radians(lat))", f"{corridor} / 111195.0::DOUBLE * 1.01"
    return f"""WITH {_SEGMENTS}, {PLACES_SQL}, stops AS (SELECT id AS stop_id, lat_e7 / 1e7::DOUBLE AS y, lon_e7 / 1e7::DOUBLE AS x FROM places WHERE {stops}),
      span AS (SELECT *, end_mm - mm AS start_mm, {span} FROM seg),
      near AS (SELECT *, pow((lon2 - lon) * {kx}, 2) + pow(lat2 - lat, 2) AS sq, ((x - lon) * {kx}) * ((lon2 - lon) * {kx}) + (y - lat) * (lat2 - lat) AS dot FROM span, stops
        WHERE y BETWEEN least(lat, lat2) - {dlat} AND greatest(lat, lat2) + {dlat} AND x BETWEEN least(lon, lon2) - 2 * {dlat} AND greatest(lon, lon2) + 2 * {dlat} AND end_mm > from_mm AND start_mm < to_mm),
      cut AS (SELECT *, least(greatest(CASE WHEN sq = 0 THEN 0 ELSE dot / sq END, greatest(0, CASE WHEN mm > 0 THEN (from_mm - start_mm) / mm::DOUBLE ELSE 0 END)), least(1, CASE WHEN mm > 0 THEN (to_mm - start_mm) / mm::DOUBLE ELSE 1 END)) AS t FROM near),
      off AS (SELECT *, lat + (lat2 - lat) * t AS fy, lon + (lon2 - lon) * t AS fx FROM cut),
      beside AS (SELECT *, CAST(floor({_HAVERSINE.format(a='y', b='fy', c='x', d='fx')} * 1000 + 0.5) AS BIGINT) AS off_mm, CAST(floor((start_mm + mm * t) / 100 + 0.5) AS BIGINT) AS at_dm FROM off),
      run AS (SELECT *, segment - row_number() OVER w AS island, min(segment) OVER (PARTITION BY line_id, stop_id) AS first FROM beside WHERE off_mm <= {corridor * 1000} WINDOW w AS (PARTITION BY line_id, stop_id ORDER BY segment))
      SELECT line_id, stop_id, arg_min(at_dm, struct_pack(o := off_mm, s := segment)) AS at_dm, min(off_mm) AS off_mm FROM run WHERE island = first - 1 GROUP BY ALL"""


_CLIMBS = f"""{_RIDDEN}, high AS (SELECT *, lag(ele) OVER w AS ele0, row_number() OVER w AS nth FROM legs WINDOW w AS (PARTITION BY track_id ORDER BY ts_us, event_id)),
  up AS (SELECT *, coalesce(sum(CASE WHEN ridden THEN dm END) OVER w, 0)::BIGINT AS d, coalesce(sum(CASE WHEN ridden THEN ele - ele0 END) OVER w, 0)::BIGINT AS h, lag(hr) OVER w AS hr0
    FROM high WINDOW w AS (PARTITION BY track_id ORDER BY nth)),
  l AS (SELECT track_id, list(d ORDER BY nth) AS ds, list(h ORDER BY nth) AS hs, count(*)::BIGINT AS n FROM up GROUP BY track_id),
  walk AS (
    SELECT track_id, ds, hs, n, 1::BIGINT AS i, NULL::BIGINT AS foot, NULL::BIGINT AS top FROM l
    UNION ALL
    SELECT track_id, ds, hs, n, CASE WHEN steep THEN peak + 1 ELSE i + 1 END, CASE WHEN steep THEN i END, CASE WHEN steep THEN i - 1 + list_position(list_transform(hs[i:], lambda v: v >= hs[peak] - 0.5), true) END FROM (
      SELECT *, i - 1 + list_position(hs[i:coalesce(i - 1 + brk, n)], list_max(hs[i:coalesce(i - 1 + brk, n)])) AS peak FROM (
        SELECT *, (hs[m] - hs[i]) * 1000 >= 3 * (ds[m] - ds[i]) AS steep,
          CASE WHEN (hs[m] - hs[i]) * 1000 >= 3 * (ds[m] - ds[i]) THEN list_position(list_transform(range(i, n + 1), lambda j: list_max(hs[i:j]) - hs[j] > 10), true) END AS brk
        FROM (SELECT track_id, ds, hs, n, i, list_position(list_transform(ds, lambda v: v - ds[i] >= 1000), true) AS m FROM walk WHERE i <= n) WHERE m IS NOT NULL))),
  found AS (SELECT track_id, foot, top, ds[foot] AS start_dm, ds[top] - ds[foot] AS length_dm, hs[top] - hs[foot] AS ascent_m, ds, hs FROM walk WHERE foot IS NOT NULL),
  listed AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY foot)::INT AS climb FROM found WHERE length_dm >= 3000 AND ascent_m >= 20 AND ascent_m * 1000 >= 3 * length_dm),
  steepest AS (SELECT track_id, climb, max(CAST(floor((hs[b] - hs[a]) * 10000 / (ds[b] - ds[a])::DOUBLE + 0.5) AS BIGINT)) AS grade FROM (
    SELECT *, list_position(list_transform(ds, lambda v: v - ds[a] >= 1000), true) AS b FROM (SELECT *, unnest(range(foot, top)) AS a FROM listed)) WHERE b <= top GROUP BY ALL),
  ridden_ AS (SELECT track_id, climb, coalesce(sum(dur_us) FILTER (moving), 0)::BIGINT AS moving_us, CAST(floor(sum(hr0 * dur_us) FILTER (moving) / sum(dur_us) FILTER (moving AND hr0 IS NOT NULL)::DOUBLE + 0.5) AS INT) AS avg_hr,
      CAST(floor(sum(pwr0 * dur_us) FILTER (moving) / sum(dur_us) FILTER (moving AND pwr0 IS NOT NULL)::DOUBLE + 0.5) AS INT) AS avg_power
    FROM listed JOIN up USING (track_id) WHERE nth > foot AND nth <= top GROUP BY ALL),
  climbs AS (SELECT track_id, climb, start_dm, length_dm, ascent_m, coalesce(grade, CAST(floor(ascent_m * 10000 / length_dm::DOUBLE + 0.5) AS BIGINT)) AS grade_pm, moving_us, avg_hr, avg_power
    FROM listed LEFT JOIN steepest USING (track_id, climb) LEFT JOIN ridden_ USING (track_id, climb))"""

ORACLE = {
    "agg_05_splits": f"""{_RIDDEN}, n AS (SELECT *, row_number() OVER w AS nth, coalesce(sum(CASE WHEN ridden THEN dm END) OVER w, 0)::BIGINT AS b FROM legs WINDOW w AS (PARTITION BY track_id ORDER BY ts_us, event_id)),
      walk AS (SELECT track_id, nth, b, ele AS anchor, 0 AS up, 0 AS down FROM n WHERE nth = 1
        UNION ALL SELECT n.track_id, n.nth, n.b, CASE WHEN ele IS NULL THEN anchor WHEN anchor IS NULL OR NOT ridden OR abs(ele - anchor) >= 3 THEN ele ELSE anchor END,
          CASE WHEN ridden AND ele - anchor >= 3 THEN ele - anchor ELSE 0 END, CASE WHEN ridden AND anchor - ele >= 3 THEN anchor - ele ELSE 0 END FROM walk JOIN n ON n.track_id = walk.track_id AND n.nth = walk.nth + 1),
      legs_ AS (SELECT *, b - dm AS a FROM n WHERE ridden AND dm > 0),
      e AS (SELECT *, unnest(range(a // {SPLIT_DM}, (b - 1) // {SPLIT_DM} + 1)) AS split FROM legs_),
      o AS (SELECT *, least(b, (split + 1) * {SPLIT_DM}) - greatest(a, split * {SPLIT_DM}) AS own FROM e),
      c AS (SELECT track_id, split, own AS dm, CASE WHEN moving THEN CAST(floor(dur_us * own / dm::DOUBLE + 0.5) AS BIGINT) ELSE 0 END AS us, 0 AS up, 0 AS down FROM o
        UNION ALL SELECT track_id, b // {SPLIT_DM}, 0, 0, up, down FROM walk WHERE up + down > 0),
      f AS (SELECT track_id, split, sum(dm)::BIGINT AS dm, sum(us)::BIGINT AS us, sum(up)::BIGINT AS up, sum(down)::BIGINT AS down FROM c GROUP BY ALL),
      l AS (SELECT track_id, max(split) AS top, arg_max(dm, split) AS tail FROM f GROUP BY track_id), z AS (SELECT track_id, CASE WHEN top > 0 AND tail < 100 THEN top - 1 ELSE top END AS last FROM l),
      h AS (SELECT track_id, least(split, last) AS split, sum(dm)::BIGINT AS dm, sum(us)::BIGINT AS us, sum(up)::BIGINT AS up, sum(down)::BIGINT AS down FROM f JOIN z USING (track_id) GROUP BY ALL),
      g AS (SELECT track_id, last, unnest(range(0, last + 1)) AS split FROM z)
      SELECT track_id, split, coalesce(dm, 0) AS distance_dm, coalesce(us, 0) AS moving_us, coalesce(up, 0) AS ascent_m, coalesce(down, 0) AS descent_m, split = last AND coalesce(dm, 0) < {SPLIT_DM} - 10 AS partial FROM g LEFT JOIN h USING (track_id, split)""",
    "join_14_chunks": f"""WITH RECURSIVE {_SEGMENTS}, span AS (SELECT *, end_mm - mm AS start_mm FROM seg),
      c AS (SELECT line_id, segment, end_mm, start_mm AS begin, 0 AS chunk FROM span WHERE segment = 0
        UNION ALL SELECT s.line_id, s.segment, s.end_mm, CASE WHEN c.end_mm - begin >= 20000000 THEN c.end_mm ELSE begin END, CASE WHEN c.end_mm - begin >= 20000000 THEN chunk + 1 ELSE chunk END FROM c JOIN span s ON s.line_id = c.line_id AND s.segment = c.segment + 1),
      b AS (SELECT line_id, chunk, min(least(lat, lat2)) AS s, min(least(lon, lon2)) AS w, max(greatest(lat, lat2)) AS n, max(greatest(lon, lon2)) AS e FROM c JOIN seg USING (line_id, segment) GROUP BY ALL),
      p AS (SELECT *, 300.0::DOUBLE / 111320.0::DOUBLE AS dlat FROM b), q AS (SELECT *, dlat / greatest(cos(radians(greatest(abs(s), abs(n)))), 1e-6::DOUBLE) AS dlon FROM p)
      SELECT line_id, chunk::INT AS chunk, """
    + ", ".join(f"CAST(floor(({v}) * 1e6::DOUBLE + 0.5) AS BIGINT) AS {c}" for v, c in (("s - dlat", "south"), ("w - dlon", "west"), ("n + dlat", "north"), ("e + dlon", "east")))
    + " FROM q",
    "join_20_slices": f"""WITH {_SEGMENTS}, span AS (SELECT *, end_mm - mm AS start_mm, max(end_mm) OVER (PARTITION BY line_id) AS length FROM seg),
      o AS (SELECT o_orderkey AS span_id, o_custkey % 151 AS line_id, o_orderkey * 7919 % 400000 * 1000 AS a, o_orderkey * 7919 % 400000 * 1000 + o_custkey * 3000 AS b FROM orders),
      m AS (SELECT *, least(b, length) AS z FROM o JOIN span USING (line_id) WHERE a < least(b, length) AND start_mm < least(b, length) AND end_mm > a)
      SELECT span_id, count(*) AS pieces, CAST(floor(arg_min(lat + (lat2 - lat) * greatest((a - start_mm) / mm::DOUBLE, 0), segment) * 1e5::DOUBLE) AS BIGINT) AS lat_q,
        CAST(floor(arg_max(lon + (lon2 - lon) * least((z - start_mm) / mm::DOUBLE, 1), segment) * 1e5::DOUBLE) AS BIGINT) AS lon_q FROM m GROUP BY span_id""",
    "win_13_resampled": f"""{_RIDDEN}, r AS (SELECT track_id AS line_id, row_number() OVER w AS seq, coalesce(sum(dm) OVER w, 0)::DOUBLE AS along, ele::DOUBLE AS ele FROM legs WINDOW w AS (PARTITION BY track_id ORDER BY ts_us, event_id)),
      e AS (SELECT line_id, min(along) AS lo, max(along) AS hi, count(*) AS n FROM r GROUP BY line_id),
      w AS (SELECT line_id, nth, lo + (hi - lo) * nth / 39 AS d FROM (SELECT *, unnest(range(0, 40)) AS nth FROM e WHERE n > 40)),
      a AS (SELECT w.line_id, nth, d, arg_max(along, struct_pack(x := along, y := seq)) AS aa, arg_max(ele, struct_pack(x := along, y := seq)) AS ae FROM w JOIN r ON r.line_id = w.line_id AND along <= d GROUP BY ALL),
      b AS (SELECT w.line_id, nth, arg_min(along, struct_pack(x := along, y := seq)) AS ba, arg_min(ele, struct_pack(x := along, y := seq)) AS be FROM w JOIN r ON r.line_id = w.line_id AND along >= d GROUP BY ALL),
      f AS (SELECT line_id, nth, d AS along, ae + (be - ae) * CASE WHEN ba > aa THEN (d - aa) / (ba - aa) ELSE 0 END AS ele FROM a JOIN b USING (line_id, nth)
        UNION ALL SELECT line_id, row_number() OVER (PARTITION BY line_id ORDER BY along, seq) - 1, along, ele FROM r JOIN e USING (line_id) WHERE n <= 40)
      SELECT line_id, nth::INT AS nth, CAST(floor(along * 100) AS BIGINT) AS along_mm, CAST(floor(ele * 1000 + 1e-6::DOUBLE) AS BIGINT) AS ele_mm FROM f""",
    "join_13_corridor": _corridor("true", 300, "0::BIGINT AS from_mm, 9223372036854775807 AS to_mm"),
    "join_13_ahead": _corridor("kind = 'settlement'", 1000, "100000000::BIGINT AS from_mm, 150000000::BIGINT AS to_mm"),
    "win_16_simplified": f"""WITH RECURSIVE {_LINES}, flat AS (SELECT line_id, seq, floor(lon * 1e6::DOUBLE + 0.5) * cos(radians(first_value(lat) OVER (PARTITION BY line_id ORDER BY seq))) AS x, floor(lat * 1e6::DOUBLE + 0.5) AS y FROM pts),
      l AS (SELECT line_id, list(x ORDER BY seq) AS xs, list(y ORDER BY seq) AS ys, count(*) AS n FROM flat GROUP BY line_id),
      s AS (SELECT line_id, xs, ys, 1::BIGINT AS a, n AS b FROM l
        UNION ALL
        SELECT line_id, xs, ys, unnest([a, a + far]), unnest([a + far, b]) FROM (SELECT *, list_position(away, list_max(away)) AS far FROM (
          SELECT *, list_transform(range(a + 1, b), lambda i: CASE WHEN dx * dx + dy * dy = 0 THEN pow(xs[i] - xs[a], 2) + pow(ys[i] - ys[a], 2) ELSE
            pow((xs[i] - xs[a]) - greatest(0, least(1, ((xs[i] - xs[a]) * dx + (ys[i] - ys[a]) * dy) / (dx * dx + dy * dy))) * dx, 2)
            + pow((ys[i] - ys[a]) - greatest(0, least(1, ((xs[i] - xs[a]) * dx + (ys[i] - ys[a]) * dy) / (dx * dx + dy * dy))) * dy, 2) END) AS away
          FROM (SELECT *, xs[b] - xs[a] AS dx, ys[b] - ys[a] AS dy FROM s WHERE b > a + 1))) WHERE list_max(away) > {TOLERANCE * TOLERANCE}::DOUBLE)
      SELECT DISTINCT line_id, seq::INT AS seq FROM (SELECT line_id, a AS seq FROM s UNION ALL SELECT line_id, b FROM s)""",
    "win_19_chains": f"""WITH RECURSIVE p AS ({_PIECES.replace('DIV', '//').replace('STRING', 'VARCHAR').replace('AS end,', 'AS "end",').format(rows='orders')}),
      e AS (SELECT attrs, "end" AS node, min(piece_id) AS a FROM p GROUP BY ALL HAVING count(*) = 1), s AS (SELECT attrs, start AS node, min(piece_id) AS b FROM p GROUP BY ALL HAVING count(*) = 1),
      k AS (SELECT a, b FROM e JOIN s USING (attrs, node) WHERE a <> b),
      w AS (SELECT piece_id AS chain_id, 0::BIGINT AS place, piece_id, 0::BIGINT AS before FROM p WHERE piece_id NOT IN (SELECT b FROM k)
        UNION ALL SELECT chain_id, place + 1, b, before + weight FROM w JOIN k ON a = w.piece_id JOIN p ON p.piece_id = w.piece_id),
      left_ AS (SELECT piece_id FROM p WHERE piece_id NOT IN (SELECT piece_id FROM w)),
      r AS (SELECT piece_id AS one, piece_id FROM left_ UNION SELECT one, b FROM r JOIN k ON a = r.piece_id),
      h AS (SELECT one, min(piece_id) AS head FROM r GROUP BY one),
      g AS (SELECT DISTINCT head AS chain_id, 0::BIGINT AS place, head AS piece_id, 0::BIGINT AS before FROM h
        UNION ALL SELECT chain_id, place + 1, b, before + weight FROM g JOIN k ON a = g.piece_id JOIN p ON p.piece_id = g.piece_id WHERE b <> chain_id)
      SELECT * FROM w UNION ALL SELECT * FROM g""",
    "win_08_climbs": _CLIMBS + " SELECT * FROM climbs",
    "srt_08_biggest_climbs": _CLIMBS
    + """ SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY start_dm)::INT AS nth, rank, climb, start_dm, ascent_m
      FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY ascent_m DESC, start_dm)::INT AS rank FROM climbs) WHERE rank <= 3""",
}
