"""Weather along a route: interpolation in time, class shares, the best departure (JOIN-16, AGG-21, SRT-07)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOUR_S = 3600


def hourly(values: DataFrame) -> DataFrame:
    """Mean of each hour in thousandths, ``(hour, milli)``; combined map-side."""
    return values.groupBy(F.floor(F.col("s") / HOUR_S).cast("long").alias("hour")).agg(F.floor(F.sum(F.floor(F.col("value") * 1000)) / F.count("*")).cast("long").alias("milli"))


def interpolated(samples: DataFrame, hours: DataFrame) -> DataFrame:
    """Value between the full hours around each sample; null where either is missing."""
    at = samples.withColumn("hour", F.floor(F.col("s") / HOUR_S).cast("long"))
    low = hours.select("hour", F.col("milli").alias("low"))
    high = hours.select((F.col("hour") - 1).alias("hour"), F.col("milli").alias("high"))
    met = at.join(low, "hour", "left").join(high, "hour", "left")
    share = F.col("s") - F.col("hour") * HOUR_S
    return met.withColumn("milli", F.floor((F.col("low") * (HOUR_S - share) + F.col("high") * share) / HOUR_S).cast("long"))


def best_departure(scored: DataFrame, gain_percent: int = 20) -> DataFrame:
    """Of departures ``(route, step, score)``, the first of least score if it is ``gain_percent`` better than step 0."""
    best = scored.groupBy("route").agg(F.min(F.struct("score", "step")).alias("b"), F.max(F.when(F.col("step") == 0, F.col("score"))).alias("now"))
    better = F.col("b.score") * 100 <= F.col("now") * (100 - gain_percent)
    return best.select("route", F.when(better, F.col("b.step")).otherwise(0).cast("int").alias("step"), F.when(better, F.col("b.score")).otherwise(F.col("now")).alias("score"))
