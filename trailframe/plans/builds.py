"""Queries of merged extracts and radar frames, named by their number, with SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import extracts, radar
from ..sources.adapters import table

#: Two extracts: all suppliers, customers and parts as places, streets and points, and some of them again with other ids.
_ROWS = """
  SELECT 0 AS input, 0 AS tab, s_suppkey AS id, s_name AS name, 'city' AS kind, CAST(floor(s_suppkey / 2) AS BIGINT) AS ref, s_suppkey * 100000 AS lat_e7, s_suppkey * 200000 AS lon_e7, 'n' AS osm_type, s_suppkey AS osm_id, CAST(s_nationkey AS INT) AS importance FROM supplier
  UNION ALL SELECT 1, 0, 5000000000 + s_suppkey, concat(s_name, '*'), 'town', 5000000000 + CAST(floor(s_suppkey / 2) AS BIGINT), s_suppkey * 100000, s_suppkey * 200000, 'n', s_suppkey, CAST(s_nationkey + s_suppkey % 5 - 2 AS INT) FROM supplier WHERE s_suppkey % 3 <> 1
  UNION ALL SELECT 0, 1, 1000000000 + c_custkey, c_mktsegment, 'street', c_custkey % 120, c_custkey % 50 * 9000, c_custkey % 20 * 9000, NULL, NULL, NULL FROM customer
  UNION ALL SELECT 1, 1, 2000000000 + c_custkey, c_mktsegment, 'street', 5000000000 + c_custkey % 120, c_custkey % 50 * 9000 + c_custkey % 7 * 900, c_custkey % 20 * 9000, NULL, NULL, NULL FROM customer WHERE c_custkey % 3 = 0
  UNION ALL SELECT 0, 2, 3000000000 + p_partkey, p_name, p_brand, p_partkey % 100, 0, 0, 'w', p_partkey, CAST(p_size AS INT) FROM part
  UNION ALL SELECT 1, 2, 4000000000 + p_partkey, p_name, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE 'other' END, 5000000000 + p_partkey % 100, 0, 0, CASE WHEN p_partkey % 7 <> 0 THEN 'w' END, p_partkey, CAST(p_size + p_partkey % 3 - 1 AS INT) FROM part WHERE p_partkey % 5 = 0"""
_ALIASES = """
  SELECT 0 AS input, s_suppkey AS ref, concat('alias ', s_nationkey) AS name FROM supplier
  UNION ALL SELECT 1, 5000000000 + s_suppkey, concat('alias ', s_nationkey % 7) FROM supplier"""
_NUMBERS = """
  SELECT 0 AS input, 1000000000 + o_custkey AS street_id, CAST(o_orderkey % 40 AS INT) AS number, o_orderkey % 97 AS lat_e7, o_orderkey % 89 AS lon_e7 FROM orders WHERE o_orderstatus <> 'F'
  UNION ALL SELECT 1, 2000000000 + o_custkey, CAST(o_orderkey % 40 AS INT), o_orderkey % 97, o_orderkey % 89 FROM orders WHERE o_orderstatus <> 'P'"""


def _of(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    names = [t for t in ("supplier", "customer", "part", "orders") if f"FROM {t}" in sql]
    for t in names:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}")
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in names})


def set_03_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = extracts.merged(_of(spark, sf_dir, _ROWS))
    return rows


def set_03_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, remap = extracts.merged(_of(spark, sf_dir, _ROWS))
    last = rows.agg(F.max("new_id")).first()[0] or 0
    return extracts.merged_aliases(_of(spark, sf_dir, _ALIASES), remap, last + 1)


def set_04_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, remap = extracts.merged(_of(spark, sf_dir, _ROWS))
    return extracts.merged_numbers(_of(spark, sf_dir, _NUMBERS), remap)


#: Line items as echoes of frames, the strongest of a cell.
_CELLS = "SELECT CAST(l_linenumber AS INT) AS frame, CAST(l_partkey % 211 AS INT) AS row, CAST((l_orderkey * 7 + l_suppkey) % 197 AS INT) AS col, CAST(max(CAST(l_quantity AS INT) * 7 % 11) AS INT) AS cls FROM lineitem GROUP BY 1, 2, 3"


def grd_01_without_clutter(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = spark.sql(_CELLS.replace("FROM lineitem", "FROM {rows}"), rows=table(spark, sf_dir, "lineitem"))
    return radar.without_clutter(cells)


QUERIES = {f.__name__: f for f in (set_03_merged, set_03_aliases, set_04_numbers, grd_01_without_clutter)}

_MERGED = f"""WITH rows AS ({_ROWS}), names AS (SELECT input, id AS ref, name AS place_name FROM rows WHERE tab = 0),
  keyed AS (SELECT rows.*, CASE WHEN osm_type IS NOT NULL AND osm_id IS NOT NULL THEN concat_ws('|', tab, 'osm', osm_type, osm_id, CASE WHEN tab = 2 THEN kind END)
    WHEN tab = 1 THEN concat_ws('|', tab, 'pos', name, coalesce(place_name, chr(1)), round_even(lat_e7 / 10000::DOUBLE, 0)::BIGINT, round_even(lon_e7 / 10000::DOUBLE, 0)::BIGINT) END AS key FROM rows LEFT JOIN names USING (input, ref)),
  own AS (SELECT *, coalesce(key, concat_ws('|', 'alone', input, tab, id)) AS k FROM keyed),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY input, id) AS place, max(importance) OVER (PARTITION BY k) AS most FROM own),
  kept AS (SELECT *, row_number() OVER (ORDER BY tab, input, id) AS new_id FROM ranked WHERE place = 1),
  remap AS (SELECT own.input, own.id, new_id FROM own JOIN kept USING (k))"""
ORACLE = {
    "set_03_merged": _MERGED + " SELECT kept.new_id, tab, name, kind, r.new_id AS ref, lat_e7, lon_e7, osm_type, osm_id, most AS importance FROM kept LEFT JOIN remap r ON r.input = kept.input AND r.id = kept.ref",
    "set_03_aliases": _MERGED
    + f""", met AS (SELECT new_id, name, min(struct_pack(i := a.input, r := a.ref)) AS seen FROM ({_ALIASES}) a JOIN remap ON remap.input = a.input AND remap.id = a.ref GROUP BY ALL)
      SELECT (SELECT max(new_id) FROM kept) + row_number() OVER (ORDER BY seen.i, seen.r, name, new_id) AS id, new_id AS ref, name FROM met""",
    "set_04_numbers": _MERGED
    + f""", e AS (SELECT new_id, n.input, number, min(struct_pack(y := n.lat_e7, x := n.lon_e7)) AS at_ FROM ({_NUMBERS}) n JOIN remap ON remap.input = n.input AND remap.id = n.street_id GROUP BY ALL),
      p AS (SELECT new_id, number, arg_min(at_, input) AS won FROM e GROUP BY ALL), a AS (SELECT new_id, input, count(*) AS agreed FROM e JOIN p USING (new_id, number) WHERE at_ = won GROUP BY ALL),
      w AS (SELECT new_id, max(agreed) AS most FROM a GROUP BY ALL)
      SELECT new_id AS street_id, number, won.y AS lat_e7, won.x AS lon_e7, most < count(*) OVER (PARTITION BY new_id) AS "union" FROM p JOIN w USING (new_id)""",
    "grd_01_without_clutter": f"""WITH RECURSIVE c AS ({_CELLS}), e AS (SELECT frame, row, col, cls, frame * 1000000 + row * 1000 + col AS id FROM c WHERE cls NOT IN (0, 255)),
      x AS (SELECT id AS a, frame, row + dy AS row, unnest([col - 1, col, col + 1]) AS col FROM (SELECT *, unnest([-1, 0, 1]) AS dy FROM e)), n AS (SELECT a, id AS b FROM x JOIN e USING (frame, row, col)),
      r AS (SELECT id, id AS label FROM e UNION SELECT n.b, r.label FROM r JOIN n ON n.a = r.id AND n.b > r.label),
      l AS (SELECT id, min(label) AS label FROM r GROUP BY id), s AS (SELECT label, count(*) AS cells, count(*) FILTER (cls >= 7) AS heavy FROM l JOIN e USING (id) GROUP BY label),
      d AS (SELECT id FROM l JOIN s USING (label) WHERE cells < 4 OR heavy > 0.5::DOUBLE * cells)
      SELECT frame, row, col, CASE WHEN frame * 1000000 + row * 1000 + col IN (SELECT id FROM d) THEN 0 ELSE cls END AS cls FROM c""",
}
