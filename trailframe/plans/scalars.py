"""Queries of the scalar, reading and table operators, named by their number, each with its SQL counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo, text
from ..functions import scalars as S
from ..operators import library as L
from ..operators import readings as R
from ..operators import tracks as T
from ..sources import track_files
from ..sources.adapters import TRACK_POINTS_SQL, table, track_points
from .tracks import _HAVERSINE, _LEGS, _RIDDEN, PAUSE_US
from .tracks import ORACLE as _TRACKS

#: Tag values of paved and unpaved ways.
PAVED = (
    "asphalt", "paved", "concrete", "concrete:lanes", "concrete:plates", "paving_stones", "paving_stones:lanes", "sett",
    "cobblestone", "cobblestone:flattened", "unhewn_cobblestone", "metal", "wood", "chipseal", "bricks", "brick",
)
UNPAVED = (
    "unpaved", "compacted", "fine_gravel", "gravel", "shells", "rock", "pebblestone", "ground", "dirt", "earth", "grass",
    "grass_paver", "metal_grid", "mud", "sand", "woodchips", "snow", "ice", "salt",
)
WINDOW_S = 60
_POINTS = f"WITH {TRACK_POINTS_SQL}"


def _sql(expression: str):
    return F.expr(expression)


def geo_03_destinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    lat, lon = geo.destination(F.col("lat"), F.col("lon"), F.col("ele") * 3.0, F.col("pwr") * 100.0)
    return track_points(spark, sf_dir).select("event_id", geo.whole(lat, 1e6).alias("lat_e6"), geo.whole(lon, 1e6).alias("lon_e6"))


def geo_06_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    legs = T.legs(track_points(spark, sf_dir), PAUSE_US).filter("dm > 0")
    b = legs.withColumn("b", geo.bearing_deg(F.col("lat0"), F.col("lon0"), F.col("lat"), F.col("lon")))
    turn = geo.turn_deg(F.lag("b").over(T.in_time()), F.col("b"))
    return b.withColumn("turn", turn).filter("turn IS NOT NULL").groupBy(F.floor(F.col("turn") / 30).cast("int").alias("turn_class")).agg(F.count("*").alias("n"))


def geo_10_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight points of a circle of 3 km around each supplier's place, from a bearing that is a column."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") % 170 - 85.0).alias("lat"), (F.col("s_suppkey") * 7 % 360 - 180.0).alias("lon"))
    ring = s.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(7))))
    lat, lon = geo.destination(F.col("lat"), F.col("lon"), F.col("s_suppkey") % 45 + F.col("i") * 45.0, F.lit(3000.0))
    return ring.select("s_suppkey", "i", geo.whole(lat, 1e5).alias("lat_e5"), geo.whole(lon, 1e5).alias("lon_e5"))


def geo_11_retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next query of a loop: 18 degrees further, the radius scaled by wanted over found length within 0.45 to 1.5."""
    o = table(spark, sf_dir, "orders")
    scale = F.least(F.greatest(F.col("o_custkey") / (F.col("o_orderkey") + 1), F.lit(0.45)), F.lit(1.5))
    return o.select("o_orderkey", F.pmod(F.col("o_custkey") + 18, F.lit(360)).cast("int").alias("bearing"), geo.whole(scale, 1000.0).alias("scale_milli"))


def num_01_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = track_points(spark, sf_dir)
    grade, wind = (F.col("ele") - 50) / 4, F.col("pwr") / 20
    rows = p.select(S.gradient_class(grade).alias("grade"), S.wind_class(wind, F.col("hr") * 4, F.col("ele") * 3).alias("wind"), S.rain_class(F.col("pwr") / 10).alias("rain"))
    return rows.groupBy("grade", "wind", "rain").agg(F.count("*").alias("n"))


def num_05_nanos(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    amount = F.concat(F.when(F.col("o_orderkey") % 3 == 0, "-").otherwise(""), F.col("o_custkey").cast("string"), F.lit("."), F.lpad((F.col("o_orderkey") * 7919 % 100000000000).cast("string"), 11, "0"))
    return o.select("o_orderkey", S.nanos(amount).alias("nanos"), S.nanos(F.concat(F.lit("x"), amount)).alias("none"))


def dtm_01_quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.unix_seconds(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").groupBy((F.floor(s / 3600) * 3600).alias("hour_s"), (F.floor(s / 900) * 900).alias("quarter_s")).agg(F.count("*").alias("n"))


_DURATION = """CASE l_linenumber WHEN 1 THEN concat('PT', q, 'H') WHEN 2 THEN concat('P', q, 'D') WHEN 3 THEN concat('PT', q, 'M') WHEN 4 THEN concat('P1DT', q, 'H30M')
  WHEN 5 THEN concat('P', q, 'Y') WHEN 6 THEN 'PT' ELSE concat('P1W', q, 'D') END"""


def dtm_02_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "lineitem").select("l_linenumber", F.col("l_quantity").cast("long").cast("string").alias("q")).select(_sql(_DURATION).alias("text"))
    return texts.groupBy("text").agg(F.count("*").alias("n")).withColumn("hours", S.duration_hours(F.col("text")))


def dtm_03_daylight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sunrise and sunset in minutes, null where the sun does not rise or set."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"), (F.col("o_custkey") % 160 - 80.0).alias("lat"), (F.col("o_orderkey") % 360 - 180.0).alias("lon"))
    rise, down, whole_day = S.sun_times(F.col("day"), F.col("lat"), F.col("lon"))
    return o.select("o_orderkey", F.floor(rise / 60).alias("rise_min"), F.floor(down / 60).alias("set_min"), whole_day.alias("all_day"))


_WAY = """concat('surface=', CASE l_returnflag WHEN 'A' THEN 'asphalt' WHEN 'N' THEN 'gravel' ELSE 'odd=one' END, CASE WHEN l_linenumber = 7 THEN '  ' ELSE ' oneway ' END,
  CASE l_linenumber % 5 WHEN 0 THEN 'highway=primary' WHEN 1 THEN 'highway=cycleway' WHEN 2 THEN 'highway=track' WHEN 3 THEN 'highway=road cycleway:left=no' ELSE 'cycleway:both=lane' END,
  CASE WHEN l_linestatus = 'O' THEN ' surface=' ELSE '' END)"""


def map_01_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(_sql(_WAY).alias("way")).groupBy("way").agg(F.count("*").alias("n"))
    return rows.withColumn("m", S.tags(F.col("way"))).select("way", "n", F.size("m").alias("n_tags"), F.col("m")["surface"].alias("surface"), F.col("m")["oneway"].alias("oneway"))


def prj_08_surface_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    ways = table(spark, sf_dir, "lineitem").select(S.tags(_sql(_WAY.replace("l_linestatus = 'O'", "false"))).alias("m"), F.col("l_quantity").cast("long").alias("q"))
    return ways.groupBy(S.surface_kind(F.col("m"), PAVED, UNPAVED).alias("kind")).agg(F.count("*").alias("n"), F.sum("q").alias("length"))


_NAMES = """concat_ws(' ', 'name=x', CASE WHEN c_custkey % 2 = 0 THEN 'name:de=y' END, CASE WHEN c_custkey % 3 = 0 THEN 'name:zh-Hant=z' END, CASE WHEN c_custkey % 5 = 0 THEN 'wikidata=Q1' END,
  CASE WHEN c_custkey % 7 = 0 THEN 'wikipedia:fr=W name:etymology=no' END)"""


def prj_05_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", S.importance(S.tags(_sql(_NAMES))).alias("importance"))


def src_08_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    xml, kind = F.lit('<?xml version="1.0"?>\n<!-- c -->'), F.col("doc_id") % 5
    content = (
        F.when(kind == 0, F.concat(xml, F.lit('<gpx version="1.1">'), "t")).when(kind == 1, F.concat(xml, F.lit('<x:TrainingCenterDatabase a="b">'), "t"))
        .when(kind == 2, F.concat(F.chr(F.lit(14)), F.lit("1234567.FIT"), "t")).when(kind == 3, F.concat(F.lit('{"gpx": 1}'), "t")).otherwise(F.concat(F.lit("plain "), "t"))
    )
    return d.groupBy(S.track_format(content.cast("binary")).alias("format")).agg(F.count("*").alias("n"))


_RAW = """CASE c_custkey % 4 WHEN 0 THEN concat('..', c_name, '/x:y') WHEN 1 THEN concat('  a', chr(9), c_name, '  b ') WHEN 2 THEN '... ' ELSE repeat(c_name, 10) END"""


def src_22_file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", S.file_name(_sql(_RAW)).alias("file_name"))


def str_02_match_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = table(spark, sf_dir, "documents").select(F.explode(F.array_distinct(text.words(text.fold(F.col("text"))))).alias("term"))
    return terms.groupBy("term").agg(F.count("*").alias("docs")).withColumn("form", S.match_fold(F.col("term"))).filter("form <> term")


def str_13_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", S.clean_name(_sql(_RAW.replace("10", "30"))).alias("name"))


def _power(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings two to four seconds apart, with a pause after each forty."""
    n = F.row_number().over(T.in_time())
    p = track_points(spark, sf_dir).filter("pwr IS NOT NULL").withColumn("n", n)
    return p.select("track_id", (F.col("n") * 3 + F.col("event_id") % 2 + F.floor(F.col("n") / 40) * 100).alias("at_s"), F.col("pwr").alias("watts"))


def agg_10_best_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-10, AGG-11"""
    return R.best_power(R.power_grid(_power(spark, sf_dir)), WINDOW_S)


def agg_16_worst_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = track_points(spark, sf_dir)
    waypoints = p.filter("kind = 'purchase'").select(F.col("track_id").alias("route_id"), F.col("event_id").alias("waypoint"), "lat", "lon")
    route = p.filter("kind <> 'purchase'").select(F.col("track_id").alias("route_id"), "lat", "lon")
    return R.worst_offset(waypoints, route)


def agg_03_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length and climb of the line, whatever its times."""
    p = track_points(spark, sf_dir)
    length = T.legs(p, PAUSE_US).groupBy("track_id").agg(F.coalesce(F.sum("dm"), F.lit(0)).alias("length_dm"))
    return length.join(T.elevation_gain(p), "track_id")


def agg_19_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n")).filter("n > 1")


def agg_20_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda c: F.coalesce(F.count_if(F.expr(c)), F.lit(0))
    return table(spark, sf_dir, "orders").agg(count("o_orderstatus = 'F'").alias("finished"), count("o_orderstatus <> 'F' AND o_totalprice > 100000").alias("kept"), count("o_orderpriority = '1-URGENT'").alias("waiting"))


def agg_22_departure_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten for a wet kilometre by its chance, one for a kilometre against 1 m/s; null if any sample has no weather."""
    km, hundredths = F.col("l_quantity").cast("long"), F.when(F.col("l_returnflag") == "A", 100).otherwise(F.col("l_linenumber") * 10)
    wind = F.greatest(F.lit(0), F.col("l_suppkey") % 9 - 4)
    part = F.when(~((F.col("l_returnflag") == "N") & (F.col("l_linenumber") == 6)), km * (10 * hundredths + 100 * wind))
    scores = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(part).alias("s"), F.count(part).alias("known"), F.count("*").alias("n"))
    return scores.select("l_orderkey", F.when(F.col("known") == F.col("n"), F.col("s")).alias("score_hundredths"))


#: What of each table goes into its digest, the same in both engines.
_DIGESTED = {
    "supplier": "s_suppkey, s_name, s_nationkey, CAST(floor(s_acctbal * 100 + 0.5) AS BIGINT) AS cents", "nation": "n_nationkey, n_name, n_regionkey", "part": "p_partkey, p_name, p_brand, p_type, p_size",
    "customer": "c_custkey, c_name, c_nationkey, CAST(floor(c_acctbal * 100 + 0.5) AS BIGINT) AS cents, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_mktsegment END AS segment",
    "lineitem": "l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(l_quantity AS BIGINT) AS quantity, l_returnflag, l_linestatus",
}


def agg_27_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of five tables, whatever the order of their rows."""
    found = [L.digest(table(spark, sf_dir, t).selectExpr(*_columns(of))).select(F.lit(t).alias("name"), "*") for t, of in _DIGESTED.items()]
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every


def _marked(column: str) -> str:
    value = f"CAST({column.partition(' AS ')[0] if column.endswith('segment') else column.removesuffix(' AS cents').removesuffix(' AS quantity')} AS VARCHAR)"
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE concat(length({value}), ':', {value}) END"


def _columns(listed: str) -> list[str]:
    """The columns of a select list whose commas stand outside of parentheses only."""
    return [c.strip() for c in listed.split(", ")]


def agg_28_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd"))
    return o.groupBy("o_custkey").agg(F.max("day").alias("latest"), F.max(F.when(F.col("o_orderstatus") == "F", F.col("day"))).alias("latest_finished"))


def arr_01_dominant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kind with the greatest weight of each ride; of equal weights the first name."""
    w = track_points(spark, sf_dir).groupBy("track_id", "kind").agg(F.sum("pwr").alias("weight"))
    best = w.groupBy("track_id").agg(F.min(F.struct((-F.col("weight")).alias("w"), "kind")).alias("b"), F.sum("weight").alias("total"))
    return best.select("track_id", "b.kind", F.floor(-F.col("b.w") * 1000 / F.col("total")).cast("long").alias("share_milli"))


def join_01_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-01, SET-01: ids of three tables in one id space, met by the rows that name them."""
    n = lambda t, k, v, base: table(spark, sf_dir, t).select((F.col(k) + base).alias("id"), F.col(v).alias("name"))
    ids = n("supplier", "s_suppkey", "s_name", 0).unionByName(n("part", "p_partkey", "p_name", 10**6)).unionByName(n("customer", "c_custkey", "c_name", 2 * 10**6))
    wanted = table(spark, sf_dir, "lineitem").select(F.explode(F.array("l_suppkey", F.col("l_partkey") + 10**6)).alias("id")).groupBy("id").agg(F.count("*").alias("hits"))
    return wanted.join(ids, "id")


def join_02_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").join(table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'"), F.col("p_partkey") == F.col("l_partkey"), "left_semi").select("p_partkey", "p_brand")


def join_19_crossed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of a ride that a break of an hour after each purchase overlaps."""
    p = track_points(spark, sf_dir)
    steps = T.legs(p, PAUSE_US).filter("ts0 IS NOT NULL").select("track_id", F.col("event_id").alias("id"), F.col("ts0").alias("lo_us"), F.col("ts_us").alias("hi_us"))
    breaks = p.filter("kind = 'purchase'").select("track_id", (F.col("ts_us") + 1).alias("lo_us"), (F.col("ts_us") + 3_600_000_000).alias("hi_us"))
    return R.crossed(steps, breaks).select("track_id", F.col("id").alias("event_id"))


def join_26_attached(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = track_points(spark, sf_dir).withColumn("s", F.floor(F.col("ts_us") / 1_000_000))
    return R.attached(p.filter("kind = 'purchase'").select("track_id", F.col("event_id").alias("id"), "s"), p.filter("kind <> 'purchase'").select("track_id", "s", F.col("event_id").alias("value")), 7200)


def join_28_reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-27, JOIN-28, PRJ-13: status of each supplier's amount against the customer of its number."""
    theirs = table(spark, sf_dir, "customer").filter("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("s_suppkey"), "c_nationkey", F.floor("c_acctbal").cast("long").alias("theirs"))
    own = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", F.floor("s_acctbal").cast("long").alias("own"))
    status = F.when(F.col("theirs").isNull(), "missing").when(F.col("c_nationkey") % 5 != F.col("s_nationkey") % 5, "currency").when(F.col("own") == F.col("theirs"), "same").otherwise("update")
    bad = F.when(F.col("theirs") <= 0, "not positive").when((F.col("theirs") * 2 < F.col("own")) | (F.col("theirs") > F.col("own") * 2), "too far from the present amount")
    met = own.join(theirs, "s_suppkey", "left").withColumn("status", status)
    return met.select("s_suppkey", "status", F.when(F.col("status") == "update", bad).alias("blocked"))


def set_08_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-08, SET-10: rows updated where the version is the one that was read and the row is not deleted; expired rows are not seen."""
    c = table(spark, sf_dir, "customer").filter("c_custkey % 11 <> 0")
    fits = (F.col("c_nationkey") % 3 == F.col("c_custkey") % 3) & (F.col("c_custkey") % 7 != 0)
    return c.select("c_custkey", F.when(fits, F.lit("new")).otherwise(F.col("c_mktsegment")).alias("segment"), (F.col("c_nationkey") % 3 + fits.cast("int")).cast("int").alias("version"))


def set_13_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At the last order's hour: routes older than 7 days go, the 30 oldest of those over 48 hours are checked again."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.floor(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) / 3600).alias("h"))
    now = o.agg(F.max("h").alias("now"))
    aged = o.join(F.broadcast(now)).withColumn("age", F.col("now") - F.col("h"))  # one row
    checked = aged.filter("age > 48 AND age <= 168").orderBy(F.desc("age"), "o_orderkey").limit(30).select("o_orderkey", F.lit("check").alias("action"))
    return checked.unionByName(aged.filter("age > 168").select("o_orderkey", F.lit("drop").alias("action")))


def srt_01_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(50).select("o_orderkey")


def srt_08_largest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five largest runs of each ride, in their own order again."""
    runs = T.runs(T.legs(track_points(spark, sf_dir), PAUSE_US))
    size = F.row_number().over(Window.partitionBy("track_id").orderBy(F.desc("n_points"), "run"))
    place = F.row_number().over(Window.partitionBy("track_id").orderBy("run"))
    return runs.withColumn("size", size).filter("size <= 5").select("track_id", "run", "n_points", place.cast("int").alias("place"))


def win_06_range_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.legs(T.accepted(track_points(spark, sf_dir)), PAUSE_US)
    rows = rows.withColumn("along", F.sum(F.coalesce("dm", F.lit(0))).over(T.in_time()))
    return R.range_mean(rows, "along", "ele", 50_000).select("track_id", "event_id", "mean_milli")


def jsn_01_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSN-01, JSN-02: unreadable columns count as empty."""
    props = F.when(F.col("event_id") % 10 == 0, "broken{").otherwise(F.col("props"))
    k = F.coalesce(F.from_json(props, "k int")["k"], F.lit(-1))
    return table(spark, sf_dir, "events").groupBy(k.alias("k")).agg(F.count("*").alias("n"), F.count_if(F.contains(props, F.lit("7"))).alias("with_seven"))


def stm_03_fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch form, a day around the last purchase of all."""
    r = track_points(spark, sf_dir).select(F.col("track_id").alias("ride_id"), "kind", (F.col("event_id") % 3).alias("source_id"), (F.col("event_id") % 3).alias("priority"), "ts_us", F.col("event_id").alias("value"))
    at = r.filter("kind = 'purchase'").agg(F.max("ts_us")).first()[0] or 0
    return R.fused(r, at, 86_400_000_000)


def stm_04_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = track_points(spark, sf_dir).withColumn("n", F.row_number().over(T.in_time()))
    frames = p.select(F.col("track_id").alias("source"), (F.col("ts_us") * 1000 + F.col("n")).alias("ts_us"), "event_id", (F.col("n") * 40000 % 65536).alias("wheel"), (F.col("n") * 1000 + F.col("event_id") % 500).alias("at"))
    frames = frames.withColumn("at", F.col("at") % 65536)
    return R.counted(frames, "wheel", "at").select("source", "event_id", "steps", "ticks")


def _recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = track_points(spark, sf_dir)
    seq = (F.row_number().over(T.in_time()) - 1).cast("int")
    return p.withColumn("seq", seq).withColumn("cad", F.when(F.col("ele") % 3 == 0, F.col("ele")))


def src_01_gpx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-01, SRC-02, SRC-09: each track written as a GPX document and read back."""
    p = _recorded(spark, sf_dir).withColumn("time", F.timestamp_micros("ts_us")).withColumn("name", F.lit("a < b & c"))
    found = track_files.read_gpx(track_files.gpx_documents(p).select(F.col("track_id").cast("string").alias("path"), F.col("gpx").cast("binary").alias("content")))
    return found.select(F.col("path").cast("long").alias("track_id"), "seq", "name", geo.whole(F.col("lat"), 1e7).alias("lat_e7"), geo.whole(F.col("lon"), 1e7).alias("lon_e7"), F.col("ele").cast("int").alias("ele"), F.unix_seconds("time").alias("s"), "hr", "cad", "pwr")


def _packable(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("float")
    return _recorded(spark, sf_dir).select("track_id", "seq", "lat", "lon", F.col("ele").cast("float").alias("ele"), F.floor(F.col("ts_us") / 1000).alias("time_ms"), none.alias("speed"), none.alias("accuracy"), "hr", "cad", "pwr")


def _unpacked(found: DataFrame) -> DataFrame:
    found = track_files.unpacked_tracks(found)
    return found.select("track_id", "seq", geo.whole(F.col("lat"), 1e7).alias("lat_e7"), geo.whole(F.col("lon"), 1e7).alias("lon_e7"), F.col("ele").cast("int").alias("ele"), "time_ms", "hr", "cad", "pwr")


def src_10_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-10: each track packed and unpacked."""
    return _unpacked(track_files.packed_tracks(_packable(spark, sf_dir)))


def src_10_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-10: the first part of each track packed, the rest appended, and all of it unpacked."""
    p = _packable(spark, sf_dir)
    return _unpacked(track_files.appended(track_files.packed_tracks(p.filter("seq < 20 + track_id % 7")), p.filter("seq >= 20 + track_id % 7")))


def src_02_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-02, SRC-09: each track written as a route and read back."""
    p = _recorded(spark, sf_dir).withColumn("time", F.timestamp_micros("ts_us")).withColumn("name", F.lit("a < b & c"))
    found = track_files.read_gpx(track_files.gpx_documents(p, route=True).select(F.col("track_id").cast("string").alias("path"), F.col("gpx").cast("binary").alias("content")))
    found = track_files.preferred(found).filter("form = 'route'")
    return found.select(F.col("path").cast("long").alias("track_id"), "seq", "name", geo.whole(F.col("lat"), 1e7).alias("lat_e7"), geo.whole(F.col("lon"), 1e7).alias("lon_e7"), F.col("ele").cast("int").alias("ele"), F.unix_seconds("time").alias("s"), "hr", "cad", "pwr")


QUERIES = {f.__name__: f for f in (
    src_10_appended, src_02_routes, geo_03_destinations, geo_06_turns, geo_10_rings, geo_11_retries, num_01_classes, num_05_nanos, dtm_01_quarters, dtm_02_durations, dtm_03_daylight, map_01_tags, prj_08_surface_kinds, prj_05_importance,
    src_08_formats, src_22_file_names, str_02_match_forms, str_13_names, agg_10_best_power, agg_16_worst_offset, agg_03_geometry, agg_19_duplicates, agg_20_counts, agg_22_departure_scores, agg_27_digest,
    agg_28_latest, arr_01_dominant, join_01_names, join_02_known, join_19_crossed, join_26_attached, join_28_reconciled, set_08_versions, set_13_retention, srt_01_library, srt_08_largest, win_06_range_means,
    jsn_01_decoded, stm_03_fused, stm_04_counters, src_01_gpx, src_10_packed)}
QUERIES["agg_09_normalised_power"] = lambda s, d: R.normalised_power(R.power_grid(_power(s, d)))

_DESTINATION = """, a AS (SELECT *, sin(radians(lat)) * cos(m / 6371008.8) + cos(radians(lat)) * sin(m / 6371008.8) * cos(radians(b)) AS sine FROM src),
  z AS (SELECT *, degrees(asin(least(1.0, greatest(-1.0, sine)))) AS y, degrees(radians(lon) + atan2(sin(radians(b)) * sin(m / 6371008.8) * cos(radians(lat)), cos(m / 6371008.8) - sin(radians(lat)) * sine)) + 540 AS x FROM a),
  d AS (SELECT *, x - 360 * floor(x / 360) - 180 AS e FROM z)"""
_GRID = f"""WITH {TRACK_POINTS_SQL}, n AS (SELECT track_id, event_id, pwr, row_number() OVER (PARTITION BY track_id ORDER BY ts_us, event_id) AS n FROM points WHERE pwr IS NOT NULL),
  r AS (SELECT track_id, n * 3 + event_id % 2 + (n // 40) * 100 AS at_s, pwr FROM n), g AS (SELECT *, lead(at_s) OVER (PARTITION BY track_id ORDER BY at_s) - at_s AS gap FROM r),
  h AS (SELECT *, coalesce(sum(CASE WHEN gap > 5 THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY at_s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS series FROM g),
  grid AS (SELECT track_id, series, unnest(generate_series(at_s, at_s + CASE WHEN gap <= 5 THEN gap ELSE 1 END - 1)) AS at_s, pwr FROM h),
  rolled AS (SELECT track_id, sum(pwr) OVER w AS total, count(*) OVER w AS n FROM grid WINDOW w AS (PARTITION BY track_id, series ORDER BY at_s ROWS BETWEEN {{0}} PRECEDING AND CURRENT ROW))"""
_CLIMB = _TRACKS["elevation_gain"]
_WHOLE_PART = "coalesce(TRY_CAST(regexp_extract({0}, '(\\d+){1}', 1) AS DOUBLE), 0)"

_RECORDED = _POINTS + """ SELECT track_id, CAST(row_number() OVER (PARTITION BY track_id ORDER BY ts_us, event_id) - 1 AS INT) AS seq, {0} CAST(floor(lat * 1e7 + 0.5) AS BIGINT) AS lat_e7, CAST(floor(lon * 1e7 + 0.5) AS BIGINT) AS lon_e7,
  ele, {1}, hr, CASE WHEN ele % 3 = 0 THEN ele END AS cad, pwr FROM points"""

ORACLE = {
    "src_01_gpx": _RECORDED.format("'a < b & c' AS name,", "ts_us // 1000000 AS s"),
    "src_10_packed": _RECORDED.format("", "ts_us // 1000 AS time_ms"),
    "src_10_appended": _RECORDED.format("", "ts_us // 1000 AS time_ms"),
    "src_02_routes": _RECORDED.format("'a < b & c' AS name,", "ts_us // 1000000 AS s"),
    "geo_03_destinations": _POINTS + ", src AS (SELECT event_id, lat, lon, ele * 3.0::DOUBLE AS b, pwr * 100.0::DOUBLE AS m FROM points)" + _DESTINATION
    + " SELECT event_id, CAST(floor(y * 1e6 + 0.5) AS BIGINT) AS lat_e6, CAST(floor(e * 1e6 + 0.5) AS BIGINT) AS lon_e6 FROM d",
    "geo_06_turns": _LEGS + """, b AS (SELECT track_id, ts_us, event_id, degrees(atan2(sin(radians(lon - lon0)) * cos(radians(lat)), cos(radians(lat0)) * sin(radians(lat)) - sin(radians(lat0)) * cos(radians(lat)) * cos(radians(lon - lon0)))) + 360 AS b0 FROM legs WHERE dm > 0),
      c AS (SELECT *, b0 - 360 * floor(b0 / 360) AS b FROM b), t AS (SELECT b - lag(b) OVER (PARTITION BY track_id ORDER BY ts_us, event_id) + 540 AS t FROM c)
      SELECT CAST(floor((t - 360 * floor(t / 360) - 180) / 30) AS INT) AS turn_class, count(*) AS n FROM t WHERE t IS NOT NULL GROUP BY ALL""",
    "geo_10_rings": "WITH src AS (SELECT s_suppkey, i, s_suppkey % 170 - 85.0::DOUBLE AS lat, s_suppkey * 7 % 360 - 180.0::DOUBLE AS lon, s_suppkey % 45 + i * 45.0::DOUBLE AS b, 3000.0::DOUBLE AS m FROM supplier, (SELECT CAST(unnest(range(0, 8)) AS INT) AS i))"
    + _DESTINATION + " SELECT s_suppkey, i, CAST(floor(y * 1e5 + 0.5) AS BIGINT) AS lat_e5, CAST(floor(e * 1e5 + 0.5) AS BIGINT) AS lon_e5 FROM d",
    "geo_11_retries": "SELECT o_orderkey, CAST((o_custkey + 18) % 360 AS INT) AS bearing, CAST(floor(least(greatest(o_custkey / (o_orderkey + 1), 0.45::DOUBLE), 1.5::DOUBLE) * 1000 + 0.5) AS BIGINT) AS scale_milli FROM orders",
    "num_01_classes": _POINTS + f""", c AS (SELECT (ele - 50) / 4 AS g, pwr / 20 AS w, pwr / 20 * cos(radians(hr * 4 - ele * 3)) AS a, pwr / 10 AS r FROM points)
      SELECT CASE WHEN g <= -3 THEN 'descent' WHEN g < 3 THEN 'flat' WHEN g < 6 THEN 'moderate' WHEN g < 10 THEN 'steep' ELSE 'verySteep' END AS grade,
        CASE WHEN w < 1.5 THEN 'calm' WHEN a >= 0.5 * w THEN 'headwind' WHEN a <= -0.5 * w THEN 'tailwind' ELSE 'crosswind' END AS wind,
        CAST({" + ".join(f"CASE WHEN r >= {x} THEN 1 ELSE 0 END" for x in S.RAIN_FLOORS)} AS INT) AS rain, count(*) AS n FROM c GROUP BY ALL""",
    "num_05_nanos": """SELECT o_orderkey, (CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE 1 END) * (o_custkey * 1000000000 + (o_orderkey * 7919 % 100000000000) // 100 + CASE WHEN (o_orderkey * 7919 % 100) // 10 >= 5 THEN 1 ELSE 0 END) AS nanos, NULL::BIGINT AS "none" FROM orders""",
    "dtm_01_quarters": "SELECT CAST(epoch_us(ts) // 3600000000 * 3600 AS BIGINT) AS hour_s, CAST(epoch_us(ts) // 900000000 * 900 AS BIGINT) AS quarter_s, count(*) AS n FROM events GROUP BY ALL",
    "dtm_02_durations": f"""WITH t AS (SELECT {_DURATION} AS text FROM (SELECT l_linenumber, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS q FROM lineitem)),
      c AS (SELECT text, count(*) AS n, CASE WHEN contains(text, 'T') THEN string_split(text, 'T')[-1] ELSE '' END AS clock FROM t GROUP BY text),
      h AS (SELECT text, n, CAST(floor({_WHOLE_PART.format("text", "W")} * 168 + {_WHOLE_PART.format("text", "D")} * 24 + {_WHOLE_PART.format("clock", "H")} + {_WHOLE_PART.format("clock", "M")} / 60 + 0.5) AS INT) AS hours,
        regexp_full_match(text, 'P(?:\\d+W)?(?:\\d+D)?(?:T(?:\\d+H)?(?:\\d+M)?(?:\\d+S)?)?') AND text <> 'P' AND NOT ends_with(text, 'T') AS ok FROM c)
      SELECT text, n, CASE WHEN ok AND hours >= 1 THEN hours END AS hours FROM h""",
    "dtm_03_daylight": """WITH a AS (SELECT o_orderkey, o_custkey % 160 - 80.0::DOUBLE AS lat, floor(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) + 0.5::DOUBLE + 2440587.5 - 2451545.0 + 0.0008 + 0.5) - (o_orderkey % 360 - 180.0::DOUBLE) / 360 AS noon FROM orders),
      b AS (SELECT *, 357.5291::DOUBLE + 0.98560028::DOUBLE * noon AS an FROM a), c AS (SELECT *, an - 360 * floor(an / 360) AS anomaly FROM b), d AS (SELECT *, radians(anomaly) AS m FROM c),
      e AS (SELECT *, anomaly + 1.9148::DOUBLE * sin(m) + 0.02::DOUBLE * sin(2 * m) + 0.0003::DOUBLE * sin(3 * m) + 180 + 102.9372::DOUBLE AS lo FROM d), f AS (SELECT *, radians(lo - 360 * floor(lo / 360)) AS l FROM e),
      g AS (SELECT *, 2451545.0::DOUBLE + noon + 0.0053::DOUBLE * sin(m) - 0.0069::DOUBLE * sin(2 * l) AS transit, sin(l) * sin(radians(23.4397)) AS s FROM f),
      h AS (SELECT *, (sin(radians(-0.833)) - sin(radians(lat)) * s) / (cos(radians(lat)) * cos(asin(s))) AS c FROM g), i AS (SELECT *, CASE WHEN c BETWEEN -1 AND 1 THEN degrees(acos(least(1.0, greatest(-1.0, c)))) / 360 END AS half FROM h)
      SELECT o_orderkey, CAST(floor(floor((transit - half - 2440587.5) * 86400 + 0.5) / 60) AS BIGINT) AS rise_min, CAST(floor(floor((transit + half - 2440587.5) * 86400 + 0.5) / 60) AS BIGINT) AS set_min, c < -1 AS all_day FROM i""",
    "map_01_tags": f"""WITH w AS (SELECT {_WAY} AS way, count(*) AS n FROM lineitem GROUP BY ALL), t AS (SELECT way, n, list_filter(regexp_split_to_array(trim(way), '\\s+'), lambda x: x <> '') AS t FROM w)
      SELECT way, n, CAST(len(list_distinct(list_transform(t, lambda x: string_split(x, '=')[1]))) AS INT) AS n_tags,
        list_transform(list_filter(t, lambda x: string_split(x, '=')[1] = 'surface'), lambda x: substr(x, 9))[-1] AS surface, CASE WHEN list_contains(t, 'oneway') THEN '' END AS oneway FROM t""",
    "prj_08_surface_kinds": """SELECT CASE WHEN l_linenumber % 5 = 0 THEN 'busy' WHEN l_returnflag = 'N' THEN 'unpaved' WHEN l_linenumber % 5 IN (1, 4) THEN 'cycleway' WHEN l_returnflag = 'A' THEN 'paved' ELSE 'unknown' END AS kind,
      count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS length FROM lineitem GROUP BY ALL""",
    "prj_05_importance": """SELECT c_custkey, nullif(CAST((CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END) + (CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END) + (CASE WHEN c_custkey % 5 = 0 OR c_custkey % 7 = 0 THEN 5 ELSE 0 END) AS INT), 0) AS importance FROM customer""",
    "src_08_formats": "SELECT CASE doc_id % 5 WHEN 0 THEN 'gpx' WHEN 1 THEN 'tcx' WHEN 2 THEN 'fit' END AS format, count(*) AS n FROM documents GROUP BY ALL",
    "src_22_file_names": """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_name || '_x_y' WHEN 1 THEN 'a ' || c_name || ' b' WHEN 2 THEN 'track' ELSE substr(repeat(c_name, 10), 1, 80) END AS file_name FROM customer""",
    "str_02_match_forms": f"""WITH v AS (SELECT term, count(*) AS docs FROM (SELECT unnest(list_distinct(regexp_extract_all(translate(lower(text), '{text.FROM}', '{text.TO}'), '{text.WORD}'))) AS term FROM documents) GROUP BY term)
      SELECT term, docs, replace(replace(replace(term, 'ß', 'ss'), 'æ', 'ae'), 'œ', 'oe') AS form FROM v WHERE term SIMILAR TO '.*[ßæœ].*'""",
    "str_13_names": """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '..' || c_name || '/x:y' WHEN 1 THEN 'a ' || c_name || ' b' WHEN 2 THEN '...' ELSE CASE WHEN length(repeat(c_name, 30)) <= 200 THEN repeat(c_name, 30) END END AS name FROM customer""",
    "agg_09_normalised_power": _GRID.format(29) + " SELECT track_id, CAST(floor(pow(avg(pow(total::DOUBLE / 30, 4)), 0.25) + 0.5) AS BIGINT) AS watts FROM rolled WHERE n = 30 GROUP BY track_id",
    "agg_10_best_power": _GRID.format(WINDOW_S - 1) + f""" SELECT track_id, CAST(floor(max(total)::DOUBLE / {WINDOW_S} + 0.5) AS BIGINT) AS best_w, CAST(floor(max(total)::DOUBLE / {WINDOW_S} * 0.95::DOUBLE / 5 + 0.5) * 5 AS BIGINT) AS threshold_w
      FROM rolled WHERE n = {WINDOW_S} GROUP BY track_id""",
    "agg_16_worst_offset": _POINTS + f""", d AS (SELECT w.track_id, w.event_id, min(CAST(floor(10 * {_HAVERSINE.format(a="w.lat", b="r.lat", c="w.lon", d="r.lon")} + 0.5) AS BIGINT)) AS dm
      FROM points w JOIN points r ON w.track_id = r.track_id WHERE w.kind = 'purchase' AND r.kind <> 'purchase' GROUP BY ALL) SELECT track_id AS route_id, max(dm) AS worst_dm FROM d GROUP BY ALL""",
    "agg_03_geometry": f"""SELECT track_id, length_dm, ascent_m, descent_m FROM ({_LEGS} SELECT track_id, CAST(coalesce(sum(dm), 0) AS BIGINT) AS length_dm FROM legs GROUP BY track_id)
      JOIN ({_CLIMB}) USING (track_id)""",
    "agg_19_duplicates": "SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL HAVING count(*) > 1",
    "agg_20_counts": """SELECT count(*) FILTER (o_orderstatus = 'F') AS finished, count(*) FILTER (o_orderstatus <> 'F' AND o_totalprice > 100000) AS kept, count(*) FILTER (o_orderpriority = '1-URGENT') AS waiting FROM orders""",
    "agg_22_departure_scores": """SELECT l_orderkey, CASE WHEN count(*) FILTER (l_returnflag = 'N' AND l_linenumber = 6) = 0 THEN CAST(sum(CAST(l_quantity AS BIGINT) * (10 * CASE WHEN l_returnflag = 'A' THEN 100 ELSE l_linenumber * 10 END + 100 * greatest(0, l_suppkey % 9 - 4))) AS BIGINT) END AS score_hundredths
      FROM lineitem GROUP BY l_orderkey""",
    "agg_27_digest": " UNION ALL ".join(
        f"SELECT '{t}' AS name, count(*) AS n, coalesce(bit_xor(CAST('0x' || substr(h, 1, 12) AS BIGINT)), 0) AS folded, CAST(coalesce(sum(CAST('0x' || substr(h, 13, 12) AS BIGINT)), 0) % 281474976710656 AS BIGINT) AS summed"
        f" FROM (SELECT sha256(concat({', '.join(_marked(c) for c in _columns(of))})) AS h FROM {t})"
        for t, of in _DIGESTED.items()
    ),
    "agg_28_latest": "SELECT o_custkey, strftime(max(o_orderdate), '%Y-%m-%d') AS latest, strftime(max(o_orderdate) FILTER (o_orderstatus = 'F'), '%Y-%m-%d') AS latest_finished FROM orders GROUP BY ALL",
    "arr_01_dominant": _POINTS + """, w AS (SELECT track_id, kind, sum(pwr)::BIGINT AS weight FROM points GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY weight DESC, kind) AS n, sum(weight) OVER (PARTITION BY track_id) AS total FROM w)
      SELECT track_id, kind, CAST(floor(weight * 1000 / total::DOUBLE) AS BIGINT) AS share_milli FROM r WHERE n = 1""",
    "join_01_names": """WITH ids AS (SELECT s_suppkey AS id, s_name AS name FROM supplier UNION ALL SELECT p_partkey + 1000000, p_name FROM part UNION ALL SELECT c_custkey + 2000000, c_name FROM customer),
      w AS (SELECT id, count(*) AS hits FROM (SELECT l_suppkey AS id FROM lineitem UNION ALL SELECT l_partkey + 1000000 FROM lineitem) GROUP BY id) SELECT id, hits, name FROM w JOIN ids USING (id)""",
    "join_02_known": "SELECT p_partkey, p_brand FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')",
    "join_19_crossed": _LEGS + """ SELECT track_id, event_id FROM legs l WHERE ts0 IS NOT NULL AND EXISTS (SELECT 1 FROM points p WHERE p.track_id = l.track_id AND p.kind = 'purchase' AND p.ts_us + 1 < l.ts_us AND p.ts_us + 3600000000 > l.ts0)""",
    "join_26_attached": _POINTS + """, m AS (SELECT f.track_id, f.event_id AS id, f.ts_us // 1000000 AS s, x.ts_us // 1000000 AS "then", x.event_id AS value FROM points f JOIN points x ON f.track_id = x.track_id
      WHERE f.kind = 'purchase' AND x.kind <> 'purchase' AND abs(f.ts_us // 1000000 - x.ts_us // 1000000) <= 7200), r AS (SELECT *, row_number() OVER (PARTITION BY track_id, id ORDER BY abs("then" - s), "then" DESC, value) AS n FROM m)
      SELECT track_id, id, s, value FROM r WHERE n = 1""",
    "join_28_reconciled": """WITH m AS (SELECT s_suppkey, CAST(floor(s_acctbal) AS BIGINT) AS own, CAST(floor(c_acctbal) AS BIGINT) AS theirs, CASE WHEN c_custkey IS NULL THEN 'missing' WHEN c_nationkey % 5 <> s_nationkey % 5 THEN 'currency'
        WHEN floor(s_acctbal) = floor(c_acctbal) THEN 'same' ELSE 'update' END AS status FROM supplier LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 4 <> 0) ON c_custkey = s_suppkey)
      SELECT s_suppkey, status, CASE WHEN status = 'update' THEN CASE WHEN theirs <= 0 THEN 'not positive' WHEN theirs * 2 < own OR theirs > own * 2 THEN 'too far from the present amount' END END AS blocked FROM m""",
    "set_08_versions": """WITH c AS (SELECT *, c_nationkey % 3 = c_custkey % 3 AND c_custkey % 7 <> 0 AS fits FROM customer WHERE c_custkey % 11 <> 0)
      SELECT c_custkey, CASE WHEN fits THEN 'new' ELSE c_mktsegment END AS segment, CAST(c_nationkey % 3 + CAST(fits AS INT) AS INT) AS version FROM c""",
    "set_13_retention": """WITH a AS (SELECT o_orderkey, max(epoch_us(o_orderdate) // 3600000000) OVER () - epoch_us(o_orderdate) // 3600000000 AS age FROM orders)
      SELECT o_orderkey, 'drop' AS action FROM a WHERE age > 168 UNION ALL (SELECT o_orderkey, 'check' FROM a WHERE age > 48 AND age <= 168 ORDER BY age DESC, o_orderkey LIMIT 30)""",
    "srt_01_library": "SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50",
    "srt_08_largest": _LEGS + """, m AS (SELECT *, sum(CASE WHEN kind0 IS NOT DISTINCT FROM kind THEN 0 ELSE 1 END) OVER (PARTITION BY track_id ORDER BY ts_us, event_id)::BIGINT AS run FROM legs), r AS (SELECT track_id, run, count(*) AS n_points FROM m GROUP BY ALL),
      s AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY n_points DESC, run) AS size FROM r) SELECT track_id, run, n_points, CAST(row_number() OVER (PARTITION BY track_id ORDER BY run) AS INT) AS place FROM s WHERE size <= 5""",
    "win_06_range_means": _RIDDEN + """, a AS (SELECT track_id, event_id, ele, sum(coalesce(dm, 0)) OVER (PARTITION BY track_id ORDER BY ts_us, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS along FROM legs)
      SELECT track_id, event_id, CAST(floor(sum(ele) OVER w * 1000::DOUBLE / count(ele) OVER w + 0.5) AS BIGINT) AS mean_milli FROM a WINDOW w AS (PARTITION BY track_id ORDER BY along RANGE BETWEEN 50000 PRECEDING AND 50000 FOLLOWING)""",
    "jsn_01_decoded": """WITH p AS (SELECT CASE WHEN event_id % 10 = 0 THEN 'broken{' ELSE props END AS p FROM events)
      SELECT CASE WHEN json_valid(p) THEN CAST(json_extract_string(p, '$.k') AS INT) ELSE -1 END AS k, count(*) AS n, count(*) FILTER (p LIKE '%7%') AS with_seven FROM p GROUP BY ALL""",
    "stm_03_fused": _POINTS + """, r AS (SELECT *, event_id % 3 AS source_id, row_number() OVER (PARTITION BY track_id, kind ORDER BY event_id % 3 DESC, ts_us DESC, event_id DESC) AS n FROM points
      WHERE abs(ts_us - (SELECT max(ts_us) FROM points WHERE kind = 'purchase')) <= 86400000000) SELECT track_id AS ride_id, kind, source_id, event_id AS value FROM r WHERE n = 1""",
    "stm_04_counters": _POINTS + """, n AS (SELECT track_id AS source, event_id, row_number() OVER (PARTITION BY track_id ORDER BY ts_us, event_id) AS n FROM points), f AS (SELECT *, n * 40000 % 65536 AS wheel, (n * 1000 + event_id % 500) % 65536 AS tick FROM n)
      SELECT source, event_id, (wheel - lag(wheel) OVER w + 65536) % 65536 AS steps, (tick - lag(tick) OVER w + 65536) % 65536 AS ticks FROM f WINDOW w AS (PARTITION BY source ORDER BY n)""",
}
