"""Stored rides, routes and places: changes, merges by version, first rows. Equi-joins and map-side combined groups only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upserted(stored: DataFrame, incoming: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """``(key, values, version)``: incoming rows replace or join the stored ones and raise the version (SET-05)."""
    new = incoming.select(F.col(key), F.struct(*values).alias("new"))
    both = stored.select(key, "version", F.struct(*values).alias("old")).join(new, key, "full_outer")
    version = F.coalesce("version", F.lit(0)) + F.col("new").isNotNull().cast("int")
    return both.select(key, *[F.when(F.col("new").isNotNull(), F.col(f"new.{v}")).otherwise(F.col(f"old.{v}")).alias(v) for v in values], version.cast("int").alias("version"))


def changes(before: DataFrame, after: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """``(key, change)`` of rows that were added, removed or differ in a listed column, nulls being equal (SET-06)."""
    b, a = before.select(key, F.struct(*values).alias("b")), after.select(key, F.struct(*values).alias("a"))
    kind = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return b.join(a, key, "full_outer").select(key, kind.alias("change")).filter("change IS NOT NULL")


def applied(local: DataFrame, remote: DataFrame, key: str, value: str) -> DataFrame:
    """Outcome for each remote record: the same change, the local one wins (not yet sent and newer), or written (SET-07).

    ``local`` has ``dirty`` and ``changed_at``, ``remote`` has ``changed_at``.
    """
    mine = local.select(key, F.col(value).alias("mine"), "dirty", F.col("changed_at").alias("at"))
    met = remote.select(key, value, "changed_at").join(mine, key, "left")
    known = F.col("dirty").isNotNull()
    outcome = F.when(known & ~F.col("dirty") & (F.col("at") == F.col("changed_at")), "same_change").when(known & F.col("dirty") & (F.col("at") > F.col("changed_at")), "local_wins").otherwise("written")
    return met.withColumn("outcome", outcome).select(key, "outcome", F.when(F.col("outcome") == "written", F.col(value)).otherwise(F.col("mine")).alias(value))


def first_of_each(rows: DataFrame, keys: Sequence, order: str) -> DataFrame:
    """The first row by ``order`` (unique) of each key, without a window (SET-11)."""
    return rows.groupBy(*keys).agg(F.min(order).alias(order))


def nearest_of_each_kind(places: DataFrame, lat_e7: int, lon_e7: int, most: int) -> DataFrame:
    """The nearest place of each kind, at most ``most`` of them, nearest first (WIN-21)."""
    d2 = (F.col("lat_e7") - lat_e7) * (F.col("lat_e7") - lat_e7) + (F.col("lon_e7") - lon_e7) * (F.col("lon_e7") - lon_e7)
    best = places.groupBy("kind").agg(F.min(F.struct(d2.alias("d2"), F.col("id"))).alias("x"))
    return best.select("kind", "x.id", "x.d2").orderBy("d2", "id").limit(most)


def with_fallback(own: DataFrame, fallback: DataFrame, key: str) -> DataFrame:
    """Own rows, and fallback rows of the keys that have none (SET-12)."""
    return own.unionByName(fallback.join(own.select(key).distinct(), key, "left_anti"))


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that only one side has, with the side (SET-02)."""
    return left.subtract(right).withColumn("side", F.lit("left")).unionByName(right.subtract(left).withColumn("side", F.lit("right")))


def in_force(rows: DataFrame, key: str, start: str, tie: str, day: str) -> DataFrame:
    """The row with the newest start up to ``day`` of each key; of equal starts the smallest ``tie`` (AGG-29)."""
    newest = F.max_by(F.struct(start, tie), F.struct(F.col(start), -F.col(tie)))
    return rows.filter(F.col(start) <= F.lit(day).cast("date")).groupBy(key).agg(newest.alias("x")).select(key, F.col(f"x.{tie}").alias(tie))


def digest(rows: DataFrame, *columns: str) -> DataFrame:
    """``(n, folded, summed)`` of a table of any size: its rows, the XOR of a part of each row's hash and the sum of another, modulo 2**48 (AGG-27).

    It does not depend on the order of rows, and repeated rows count. A row is hashed with each value's length before it and
    a mark for null, so that no two rows run together; ``columns`` (all, if none is named) are taken in their order, as text.
    """
    part = lambda c: F.when(F.col(c).isNull(), "-").otherwise(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")))
    row = F.sha2(F.concat(*map(part, columns or rows.columns)), 256)
    piece = lambda i: F.conv(F.substr(row, F.lit(i), F.lit(12)), 16, 10)
    summed = F.coalesce(F.sum(piece(13).cast("decimal(20,0)")), F.lit(0).cast("decimal(20,0)")) % F.lit(1 << 48)
    return rows.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(piece(1).cast("long")), F.lit(0)).alias("folded"), summed.cast("long").alias("summed"))
