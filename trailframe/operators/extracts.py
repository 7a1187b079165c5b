"""Extracts of a place index merged into one: duplicates, new ids, references, aliases and house numbers (SET-03, SET-04).

``rows (input, tab, id, name, kind, ref, lat_e7, lon_e7, osm_type, osm_id, importance)`` holds the places (``tab`` 0), streets (1) and
points of interest (2) of all inputs; ``ref`` is the id of a row's place or region in its own input. Rows of one object are one:
by their identity, for a point of interest with its kind, and a street without one by its name, the name of its place and its position
in steps of a thousandth of a degree. Any other row stands by itself. The first input wins and takes the greatest importance.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import Rounds
from .components import numbered

STREET_STEP = 10_000  # in units of 1e-7 degrees


def _keyed(rows: DataFrame) -> DataFrame:
    """``rows`` with ``key``: what makes two rows one, null if nothing does."""
    names = rows.filter("tab = 0").select("input", F.col("id").alias("ref"), F.col("name").alias("place_name"))
    known = F.col("osm_type").isNotNull() & F.col("osm_id").isNotNull()
    step = lambda c: F.bround(F.col(c) / STREET_STEP, 0).cast("long")
    none = F.lit(None).cast("string")
    of_identity = F.struct(F.lit("osm").alias("by"), "osm_type", "osm_id", F.when(F.col("tab") == 2, F.col("kind")).otherwise(none).alias("kind"), none.alias("place"), F.lit(None).cast("long").alias("y"), F.lit(None).cast("long").alias("x"))
    of_place = F.struct(F.lit("pos").alias("by"), F.col("name").alias("osm_type"), F.lit(None).cast("long").alias("osm_id"), none.alias("kind"), F.col("place_name").alias("place"), step("lat_e7").alias("y"), step("lon_e7").alias("x"))
    key = F.when(known, of_identity).when(F.col("tab") == 1, of_place)
    # a hash of all parts, with nulls told apart from empty names
    return rows.join(names, ["input", "ref"], "left").withColumn("key", F.when(key.isNotNull(), F.sha2(F.to_json(F.struct("tab", key.alias("k")), {"ignoreNullFields": "false"}), 256))).drop("place_name")


def merged(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(merged rows with new ids, ``(input, id, new_id)`` of every row).

    New ids are dense from 1 on, places first, then streets, then points, each in the order of inputs and old ids; they are
    given out range by range. A reference to a row that is in no input becomes null.
    """
    spark = rows.sparkSession
    keyed = Rounds(spark, "keyed").next(_keyed(rows))
    first = keyed.filter("key IS NOT NULL").groupBy("key").agg(F.min(F.struct("input", "id")).alias("winner"), F.max("importance").alias("most"))
    alone = keyed.filter("key IS NULL").withColumn("most", F.col("importance"))
    won = keyed.filter("key IS NOT NULL").join(first, "key").filter("input = winner.input AND id = winner.id").drop("winner")
    kept = numbered(alone.unionByName(won), "tab", "input", "id", name="new_id")
    kept = Rounds(spark, "kept").next(kept)
    remap = keyed.filter("key IS NOT NULL").select("input", "id", "key").join(kept.filter("key IS NOT NULL").select("key", "new_id"), "key").select("input", "id", "new_id")
    remap = Rounds(spark, "remap").next(remap.unionByName(kept.filter("key IS NULL").select("input", "id", "new_id")))
    up = remap.select("input", F.col("id").alias("ref"), F.col("new_id").alias("new_ref"))
    linked = kept.join(up, ["input", "ref"], "left")
    return linked.select("new_id", "tab", "name", "kind", F.col("new_ref").alias("ref"), "lat_e7", "lon_e7", "osm_type", "osm_id", F.col("most").alias("importance")), remap


def merged_aliases(aliases: DataFrame, remap: DataFrame, first: int) -> DataFrame:
    """``(id, ref, name)`` of ``aliases (input, ref, name)``: each name of a row once, dangling ones dropped, ids from ``first`` on."""
    met = aliases.join(remap.select("input", F.col("id").alias("ref"), "new_id"), ["input", "ref"])
    once = met.groupBy("new_id", "name").agg(F.min(F.struct("input", "ref")).alias("seen"))
    return numbered(once.select("new_id", "name", "seen.input", "seen.ref"), "input", "ref", "name", "new_id", first=first, name="id").select("id", F.col("new_id").alias("ref"), "name")


def merged_numbers(numbers: DataFrame, remap: DataFrame) -> DataFrame:
    """``(street_id, number, lat_e7, lon_e7, union)`` of ``numbers (input, street_id, number, lat_e7, lon_e7)`` (SET-04).

    The first input that knows a number of a street places it (by the smallest position, if it knows it twice). ``union``:
    no input knows all numbers and positions of the street, so that its points are to be thinned again.
    """
    met = numbers.join(remap.select("input", F.col("id").alias("street_id"), "new_id"), ["input", "street_id"])
    each = met.groupBy("new_id", "input", "number").agg(F.min(F.struct("lat_e7", "lon_e7")).alias("at"))
    placed = each.groupBy("new_id", "number").agg(F.min(F.struct("input", "at")).alias("first"))
    # an input holds the union if it knows as many numbers, all of them at the places that won
    agree = each.join(placed, ["new_id", "number"]).filter("at = first.at").groupBy("new_id", "input").agg(F.count("*").alias("agreed"))
    whole = agree.groupBy("new_id").agg(F.max("agreed").alias("most")).join(placed.groupBy("new_id").agg(F.count("*").alias("n")), "new_id")
    return placed.join(whole.select("new_id", (F.col("most") < F.col("n")).alias("union")), "new_id").select(F.col("new_id").alias("street_id"), "number", "first.at.lat_e7", "first.at.lon_e7", "union")
