"""Nearest rows by branch and bound over a tree of cells: no pairs of all rows in reach, however many lie there.

Rows at one position count as one, with their smallest ids. A cell of the tree covers 2 ** level units of 1e-7 degrees, knows the box of its
positions, and is split by 4 each way while it holds more than ``LEAF``. Whatever asks goes down from the top and keeps the
cells that may hold one of its nearest: those whose least distance is not beyond the greatest of cells that surely hold enough.
Positions that ask go down as groups first, then each by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import METERS_PER_DEG_LAT, flat_m, whole
from ..sources.shared import Rounds

TOP, MIDDLE, STEP, LEAF, GROUP = 26, 12, 2, 128, 128
#: Groups begin at the lowest level with at most so many cells a key; at most so many cells go to every executor.
FIRST, SENT = 64, 20_000
LEAST_COSINE = 0.05
UNITS_PER_M = 1e7 / METERS_PER_DEG_LAT
#: Distances are compared in whole millimetres: cells up to two of them beyond the bound are kept.
SLACK = 0.2
_ASKING = ["key", "box", "lat_e7", "lon_e7"]
_CELL = ["level", "cy", "cx", "s", "w", "n", "e", "positions", "ids"]


def _shifted(c: str, level: str = "level") -> Column:
    return F.expr(f"shiftright({c}, {level})")


def _positions(rows: DataFrame, key: Column, k: int) -> DataFrame:
    """``(key, y, x, near)``: each position with its ``k`` smallest ids."""
    known = rows.select(key.alias("key"), F.col("lat_e7").cast("long").alias("y"), F.col("lon_e7").cast("long").alias("x"), F.col("id").alias("near_id")).dropna()
    by = ["key", "y", "x"]
    if k == 1:
        return known.groupBy(*by).agg(F.array(F.min("near_id")).alias("near"))
    first = known.distinct().withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy("near_id"))).filter(F.col("nth") <= k)
    return first.groupBy(*by).agg(F.array_sort(F.collect_list("near_id")).alias("near"))


def _cells(positions: DataFrame, levels: range) -> DataFrame:
    laid = positions.select("key", "y", "x", F.size("near").alias("held"), F.explode(F.array(*[F.lit(v) for v in levels])).alias("level"))
    return laid.groupBy("key", "level", _shifted("y").alias("cy"), _shifted("x").alias("cx")).agg(
        F.min("y").alias("s"), F.min("x").alias("w"), F.max("y").alias("n"), F.max("x").alias("e"), F.count("*").alias("positions"), F.sum("held").alias("ids")
    )


def _tree(positions: DataFrame) -> DataFrame:
    """``(key, py, px, level, cy, cx, s, w, n, e, positions, ids)``: the top cells and all cells of split ones."""
    spark = positions.sparkSession
    cells = Rounds(spark, "cells").next(_cells(positions, range(TOP, MIDDLE - 1, -STEP)))
    full = cells.filter((F.col("level") == MIDDLE) & (F.col("positions") > LEAF))
    if not full.isEmpty():
        at = lambda c: F.shiftright(c, MIDDLE)
        crowded = positions.withColumns({"cy": at("y"), "cx": at("x")}).join(full.select("key", "cy", "cx").hint("merge"), ["key", "cy", "cx"], "left_semi")
        cells = cells.unionByName(_cells(crowded, range(MIDDLE - STEP, -1, -STEP)))
    above = Window.partitionBy("key", "up", "py", "px")
    cells = cells.withColumns({"up": F.col("level") + STEP, "py": F.shiftright("cy", STEP), "px": F.shiftright("cx", STEP)})
    cells = cells.withColumn("beside", F.sum("positions").over(above)).filter((F.col("level") == TOP) | (F.col("beside") > LEAF))
    return Rounds(spark, "tree").next(cells.drop("up", "beside"))


def _first(tree: DataFrame) -> DataFrame:
    """The cells with which groups begin: those of one level, and above it those that are not split."""
    found = tree.groupBy("level").agg(F.count("*").alias("n"), F.count_if(F.col("positions") <= LEAF).alias("leaves"), F.count_distinct("key").alias("keys")).orderBy(F.desc("level")).collect()
    level, size, leaves = TOP, found[0].n if found else 0, 0
    for r in found:
        if r.n + leaves <= FIRST * found[0]["keys"]:
            level, size = r.level, r.n + leaves
        leaves += r.leaves
    first = tree.filter((F.col("level") == level) | ((F.col("level") > level) & (F.col("positions") <= LEAF))).select("key", *_CELL)
    return F.broadcast(first) if size <= SENT else first.hint("merge")


def _pruned(met: DataFrame, by: list[str], shape: tuple[Column, ...], k: int, square: bool, reach: float | None, until: int) -> DataFrame:
    """Cells that may hold one of the ``k`` nearest, ``open`` where they are to be split, ``going`` for all cells of what asks if one of them is."""
    qs, qw, qn, qe = shape
    zero = F.lit(0)
    dy0, dx0 = F.greatest(zero, F.col("s") - qn, qs - F.col("n")), F.greatest(zero, F.col("w") - qe, qw - F.col("e"))
    dy1, dx1 = F.greatest(F.col("n") - qs, qn - F.col("s")), F.greatest(F.col("e") - qw, qe - F.col("w"))
    a, b = F.cos(F.radians(qs / 1e7)), F.cos(F.radians(qn / 1e7))
    c0, c1 = F.least(a, b), F.when((qs <= 0) & (qn >= 0), 1.0).otherwise(F.greatest(a, b))
    floor = lambda c: F.greatest(c, F.lit(LEAST_COSINE))
    aside0, aside1 = F.greatest(dy0, dx0 * floor(c0)), F.greatest(dy1, dx1 * floor(c1))
    far = lambda dy, dx, c: F.sqrt(dy.cast("double") * dy + (dx * c) * (dx * c))
    low, high = (aside0, aside1) if square else (far(dy0, dx0, c0), far(dy1, dx1, c1))
    near = met.filter(aside0 * (1 - 1e-9) - SLACK <= F.col("box")).withColumn("low", low * (1 - 1e-9) - SLACK)
    near = near.withColumn("high", F.when(aside1 * (1 + 1e-9) + SLACK <= F.col("box"), high * (1 + 1e-9) + SLACK))
    if reach is not None:
        near = near.filter(F.col("low") <= reach * UNITS_PER_M)
    w = Window.partitionBy(*by)
    if k > 1:
        held = F.sum("ids").over(w.orderBy(F.col("high").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0))
        near = near.withColumn("high", F.when(held >= k, F.col("high")))
    kept = near.withColumn("most", F.min("high").over(w)).filter(F.col("most").isNull() | (F.col("low") <= F.col("most")))
    kept = kept.withColumn("open", (F.col("positions") > LEAF) & (F.col("level") > until))
    return kept.withColumn("going", F.max("open").over(w)).select(*by, *_CELL, "open", "going")


def _descended(start: DataFrame, tree: DataFrame, by: list[str], *how) -> DataFrame:
    """The cells of ``start`` and what they are split into, as far as ``_pruned`` keeps them open."""
    rounds = Rounds(start.sparkSession, "cells-met", keep=1 << 30)
    here, done = rounds.next(_pruned(start, by, *how)), None
    below = tree.filter(F.col("level") < TOP).withColumn("level_above", F.col("level") + STEP)
    while True:
        settled = here.filter("NOT going")
        done = settled if done is None else done.unionByName(settled)
        going = here.filter("going")
        if going.isEmpty():
            return done
        split = going.filter("open").select(*by, F.col("level").alias("level_above"), F.col("cy").alias("py"), F.col("cx").alias("px"))
        split = split.join(below.hint("merge"), ["key", "level_above", "py", "px"]).select(*by, *_CELL)
        here = rounds.next(_pruned(split.unionByName(going.filter("NOT open").select(*by, *_CELL)), by, *how))


def nearest(asked: DataFrame, rows: DataFrame, k: int = 1, also: Column | None = None, of: Column | None = None, box: Column | None = None, reach_m: float | None = None, square: bool = False) -> DataFrame:
    """``(id, place, near_id, mm)``, or ``aside`` for ``mm`` if ``square``: the ``k`` nearest of ``rows (id, lat_e7, lon_e7)`` to each of ``asked (id, lat_e7, lon_e7)``, nearest first, ties to the smaller id.

    ``also`` of an asking row must equal ``of`` of a row, such as a name. ``box`` keeps to the square of so many units of
    1e-7 degrees of latitude around the asking row. Nearness is the flat distance with the asking row's cosine in whole
    millimetres, or, if ``square``, the greater of its two parts (``aside``, in units). Rows much beyond ``reach_m`` are left
    out. Ids are unique; rows with a null id, position or key meet nothing.
    """
    key, other = (F.lit(0), F.lit(0)) if also is None else (also, of)
    spark = asked.sparkSession
    own = asked.select("id", key.alias("key"), (F.lit(1e12) if box is None else box).cast("double").alias("box"), F.col("lat_e7").cast("long").alias("lat_e7"), F.col("lon_e7").cast("long").alias("lon_e7")).dropna(subset=_ASKING)
    questions = Rounds(spark, "questions").next(own.select(*_ASKING).distinct())
    positions = Rounds(spark, "positions").next(_positions(rows, other, k))
    tree = _tree(positions)

    levels = list(range(TOP, -1, -STEP))
    groups = questions.agg(F.count("*").alias("all"), *[F.approx_count_distinct(F.hash("key", "box", F.shiftright("lat_e7", v), F.shiftright("lon_e7", v))).alias(str(v)) for v in levels]).first()
    until = next((v for v in levels if groups[str(v)] * GROUP >= groups["all"]), 0)
    by = ["key", "box", "gy", "gx"]
    asking = questions.select("*", F.shiftright("lat_e7", until).alias("gy"), F.shiftright("lon_e7", until).alias("gx"))
    sides = [F.min("lat_e7").alias("qs"), F.min("lon_e7").alias("qw"), F.max("lat_e7").alias("qn"), F.max("lon_e7").alias("qe")]
    shape = ("qs", "qw", "qn", "qe")
    cells = _descended(asking.groupBy(*by).agg(*sides).join(_first(tree), "key"), tree, [*by, *shape], tuple(map(F.col, shape)), k, square, reach_m, until)
    lat, lon = F.col("lat_e7"), F.col("lon_e7")
    each = asking.join(cells.select(*by, *_CELL).hint("merge"), by)
    leaves = _descended(each, tree, [*by, "lat_e7", "lon_e7"], (lat, lon, lat, lon), k, square, reach_m, -1).select(*_ASKING, "level", "cy", "cx", "s", "w", "n", "e")

    held = sorted(r.level for r in tree.filter(F.col("positions") <= LEAF).select("level").distinct().collect())
    laid = positions.withColumn("level", F.explode(F.array(*[F.lit(v) for v in held or [TOP]])))
    laid = laid.select("*", _shifted("y").alias("cy"), _shifted("x").alias("cx"))
    metres = flat_m(F.col("lat_e7") / 1e7, F.col("lon_e7") / 1e7, F.col("y") / 1e7, F.col("x") / 1e7)
    aside = F.greatest(F.abs(F.col("y") - F.col("lat_e7")), F.abs(F.col("x") - F.col("lon_e7")) * F.greatest(F.cos(F.radians(F.col("lat_e7") / 1e7)), F.lit(LEAST_COSINE)))
    far = (aside if square else whole(metres, 1000.0)).alias("far")

    def pairs(cells: DataFrame, *more: str) -> DataFrame:
        met = cells.join(laid.hint("merge"), ["key", "level", "cy", "cx"]).filter(aside <= F.col("box"))
        return met.select(*_ASKING, "y", "x", "near", far, *more)

    # the k-th of the least distances of some shares of the positions bounds the k-th of all; a plain minimum takes no sort
    shares = 1 if k == 1 else 4 * k
    share = F.pmod(F.hash("y", "x"), F.lit(shares))
    least = pairs(leaves).groupBy(*_ASKING).agg(*[F.min("far" if k == 1 else F.when(share == i, F.col("far"))).alias(f"m{i}") for i in range(shares)])
    bound = least.select(*_ASKING, F.get(F.array_sort(F.array(*[f"m{i}" for i in range(shares)])), F.lit(k - 1)).alias("bound"))
    bound = Rounds(spark, "bounds").next(bound)
    dy, dx = F.greatest(F.lit(0), F.col("s") - lat, lat - F.col("n")), F.greatest(F.lit(0), F.col("w") - lon, lon - F.col("e"))
    # the flat distance and aside are not less than the difference of latitudes, or of longitudes shrunk by the cosine
    low = F.greatest(dy, dx * F.cos(F.radians(lat / 1e7))) * (1 - 1e-9) - SLACK
    most = F.col("bound") if square else F.col("bound") / 1000 * UNITS_PER_M
    close = leaves.join(bound.hint("merge"), _ASKING).filter(F.col("bound").isNull() | (low <= most))
    met = pairs(close, "bound").filter(F.col("bound").isNull() | (F.col("far") <= F.col("bound")))
    if k == 1:
        best = met.groupBy(*_ASKING, "far").agg(F.min(F.col("near")[0]).alias("near_id")).select(*_ASKING, F.lit(1).alias("place"), "near_id", "far")
    else:
        each = met.select(*_ASKING, "far", F.explode("near").alias("near_id"))
        best = each.withColumn("place", F.row_number().over(Window.partitionBy(*_ASKING).orderBy("far", "near_id"))).filter(F.col("place") <= k)
    return own.join(best.hint("merge"), _ASKING).select("id", "place", "near_id", F.col("far").alias("aside" if square else "mm"))
