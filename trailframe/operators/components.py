"""Connected components and dense numbers as rounds of joins and range partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import Rounds


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(node, component)`` of all ``nodes (node)``, named by the smallest node that ``edges (a, b)`` reach.

    Each round takes the smallest label among the neighbours and then the label of that label, so that chains halve; it ends
    when no label moved. Labels of neighbours are combined before their shuffle.
    """
    spark = nodes.sparkSession
    both = Rounds(spark, "edges").next(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct())
    rounds = Rounds(spark, "labels")
    labels = rounds.next(nodes.select("node", F.col("node").alias("component"), F.lit(True).alias("moved")))
    halves = Rounds(spark, "near-labels")
    while not labels.filter("moved").isEmpty():
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        stepped = labels.select("node", F.col("component").alias("had")).join(near, "node", "left")
        stepped = halves.next(stepped.select("node", "had", F.least("had", F.coalesce("near", "had")).alias("component")))
        above = stepped.select(F.col("node").alias("component"), F.col("component").alias("above"))
        labels = rounds.next(stepped.join(above, "component").select("node", F.col("above").alias("component"), (F.col("above") < F.col("had")).alias("moved")))
    return labels.select("node", "component")


def numbered(rows: DataFrame, *order: Column | str, first: int = 1, name: str = "nth") -> DataFrame:
    """``rows`` with dense numbers from ``first`` on in the order given, without a window over all of them.

    Rows are dealt out by range and sorted there; each takes its place in its range, and the sum of the ranges before it.
    ``order`` should be unique, else equal rows are numbered in any order.
    """
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    dealt = Rounds(rows.sparkSession, "numbered").next(dealt)
    part = F.shiftright("__at", 33)
    counts = dealt.groupBy(part.alias("__part")).agg(F.count("*").alias("n"))
    # one row a range
    before = F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(counts.select("__part", before.alias("__before")))
    found = dealt.withColumn("__part", part).join(offsets, "__part")
    return found.withColumn(name, F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + first).drop("__at", "__part", "__before")
