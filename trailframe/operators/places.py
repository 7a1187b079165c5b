"""Place index operators: grid joins, merging, vocabulary, ranked search, checks.

The nearest place is found by branch and bound over cells (``nearest``). Nothing is cross joined.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .nearest import nearest


def nearest_within(left: DataFrame, right: DataFrame, radius_m: int) -> DataFrame:
    """``(id, near_id, distance_mm)``: the nearest place of ``right`` strictly within ``radius_m``, never itself (JOIN-05).

    Distances are flat, with the cosine of the left latitude. The two nearest are asked for, since one of them may be the row itself.
    """
    met = nearest(left, right, 2, reach_m=radius_m).filter((F.col("mm") < radius_m * 1000) & (F.col("id") != F.col("near_id")))
    best = met.groupBy("id").agg(F.min(F.struct(F.col("mm").alias("distance_mm"), "near_id")).alias("best"))
    return best.select("id", "best.near_id", "best.distance_mm")


def merged_by_identity(inputs: Sequence[DataFrame], keys: Sequence[str], importance: str) -> DataFrame:
    """Rows of several extracts, the first of each identity kept with the greatest importance (SET-03).

    Rows with a null in their keys have no identity: each is passed on by itself.
    """
    tagged = [d.withColumn("input", F.lit(i)) for i, d in enumerate(inputs)]
    both = tagged[0]
    for more in tagged[1:]:
        both = both.unionByName(more, allowMissingColumns=True)
    rest = [c for c in both.columns if c not in (*keys, importance, "input")]
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    best = both.filter(known).groupBy(*keys).agg(F.min_by(F.struct(*rest), "input").alias("first"), F.max(importance).alias(importance), F.count("*").alias("n_inputs"))
    apart = both.filter(~known).select(*keys, *rest, importance, F.lit(1).cast("long").alias("n_inputs"))
    return best.select(*keys, "first.*", importance, "n_inputs").unionByName(apart)


def tokens(text: str = "text"):
    return F.filter(F.split(F.lower(F.col(text)), r"[^a-z0-9]+"), lambda w: w != "")


def vocabulary(rows: DataFrame, text: str = "text") -> DataFrame:
    """Rows that hold each term (AGG-18)."""
    return rows.select(F.explode(F.array_distinct(tokens(text))).alias("term")).groupBy("term").agg(F.count("*").alias("docs"))


def search(rows: DataFrame, words: Sequence[str], limit: int) -> DataFrame:
    """Rows ranked by the number of their distinct query words, then shorter text, then id; top ``limit`` (SRT-02, SRT-03)."""
    hits = F.size(F.array_intersect(F.array_distinct(tokens()), F.array(*map(F.lit, words))))
    found = rows.select("doc_id", hits.cast("int").alias("hits"), F.length("text").alias("chars")).filter("hits > 0")
    return found.orderBy(F.desc("hits"), "chars", "doc_id").limit(limit)


def orphans(rows: DataFrame, key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose reference is missing (JOIN-03)."""
    return rows.join(parents.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")


def taking_turns(rows: DataFrame, kind: str, *order, limit: int) -> DataFrame:
    """Kinds take turns: the best of each, then the second of each, within a turn by the same order (WIN-01)."""
    turn = F.row_number().over(Window.partitionBy(kind).orderBy(*order))
    # a row beyond turn ``limit`` is never among the first ``limit``
    return rows.withColumn("turn", turn).filter(F.col("turn") <= limit).orderBy("turn", *order).limit(limit)
