"""Radar frames as tables of cells: patches of echo that are clutter and not rain (GRD-01)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import Rounds
from .components import components

#: Classes without echo, cells and share of heavy cells of a patch, first heavy class.
DRY, NO_DATA = 0, 255
LEAST_CELLS = 4
MOST_HEAVY = 0.5
HEAVY = 7
#: Columns of a block, in which runs of neighbouring rows meet.
BLOCK = 32


def patches(cells: DataFrame) -> DataFrame:
    """``(frame, row, begin, end, heavy, patch)``: runs of echo cells along a row, with their 8-connected patch.

    Runs take the place of cells: a patch is a component of runs whose columns touch in neighbouring rows, also at a corner.
    Runs meet by the blocks of columns that they lie in, and no frame is held in one task.
    """
    echo = cells.select("frame", "row", "col", "cls").dropna().filter(~F.col("cls").isin(DRY, NO_DATA))
    by = Window.partitionBy("frame", "row").orderBy("col")
    island = echo.withColumn("island", F.col("col") - F.row_number().over(by))
    runs = island.groupBy("frame", "row", "island").agg(F.min("col").alias("begin"), F.max("col").alias("end"), F.count_if(F.col("cls") >= HEAVY).alias("heavy"))
    runs = Rounds(cells.sparkSession, "runs").next(runs.drop("island").withColumn("run", F.monotonically_increasing_id()))
    block = lambda c: F.floor(c / BLOCK)
    upper = runs.select("frame", F.col("row"), F.col("begin").alias("b"), F.col("end").alias("e"), F.col("run").alias("a"), F.explode(F.sequence(block(F.col("begin") - 1), block(F.col("end") + 1))).alias("block"))
    lower = runs.select("frame", (F.col("row") - 1).alias("row"), "begin", "end", F.col("run").alias("b_run"), F.explode(F.sequence(block(F.col("begin")), block(F.col("end")))).alias("block"))
    touching = upper.join(lower, ["frame", "row", "block"]).filter("begin <= e + 1 AND end >= b - 1").select("a", F.col("b_run").alias("b"))
    found = components(runs.select(F.col("run").alias("node")), touching)
    return runs.join(found, runs.run == found.node).select("frame", "row", "begin", "end", "heavy", F.col("component").alias("patch"))


def without_clutter(cells: DataFrame) -> DataFrame:
    """``(frame, row, col, cls)`` of ``cells``, each of them once in its frame: patches that are clutter become dry.

    Clutter is a patch of fewer than 4 cells, or one of which more than half is heavy. Cells with a null are left as they are.
    """
    runs = patches(cells)
    sizes = runs.groupBy("patch").agg(F.sum(F.col("end") - F.col("begin") + 1).alias("cells"), F.sum("heavy").alias("heavy"))
    bad = sizes.filter((F.col("cells") < LEAST_CELLS) | (F.col("heavy") > MOST_HEAVY * F.col("cells"))).select("patch")
    dropped = runs.join(bad, "patch").select("frame", "row", F.explode(F.sequence("begin", "end")).alias("col"), F.lit(True).alias("clutter"))
    return cells.join(dropped, ["frame", "row", "col"], "left").select("frame", "row", "col", F.when(F.col("clutter"), F.lit(DRY)).otherwise(F.col("cls")).alias("cls"))
