"""Windows over live fixes: the same functions serve ``readStream`` and batch tables.

On a stream, set a watermark first (``late``); state is then kept per (key, open window) only and is dropped when the
watermark passes. A fix that is later than the watermark is dropped, as the recorder drops fixes that go back in time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def late(fixes: DataFrame, delay: str) -> DataFrame:
    return fixes.withWatermark("at", delay)


def once(fixes: DataFrame, *keys: str) -> DataFrame:
    """Each event once, with state bounded by the watermark (STM-07, STM-15)."""
    return fixes.dropDuplicatesWithinWatermark(list(keys)) if fixes.isStreaming else fixes.dropDuplicates(list(keys))


def sessions(fixes: DataFrame, key: str, gap: str) -> DataFrame:
    """``(key, from_us, to_us, n_fixes)``: a pause longer than ``gap`` starts a new session (STM-05)."""
    found = fixes.groupBy(key, F.session_window("at", gap)).agg(F.min("at").alias("lo"), F.max("at").alias("hi"), F.count("*").alias("n_fixes"))
    return found.select(key, F.unix_micros("lo").alias("from_us"), F.unix_micros("hi").alias("to_us"), "n_fixes")


def limited(requests: DataFrame, key: str, width: str, most: int) -> DataFrame:
    """``(key, window_us, n, refused)``: requests of each fixed window, and how many are over the limit (STM-10)."""
    counted = requests.groupBy(key, F.window("at", width)).agg(F.count("*").alias("n"))
    return counted.select(key, F.unix_micros("window.start").alias("window_us"), "n", F.greatest(F.col("n") - most, F.lit(0)).alias("refused"))


def sliding(fixes: DataFrame, key: str, width: str, slide: str) -> DataFrame:
    """``(key, window_us, n)``: counts of overlapping windows (STM-15)."""
    counted = fixes.groupBy(key, F.window("at", width, slide)).agg(F.count("*").alias("n"))
    return counted.select(key, F.unix_micros("window.start").alias("window_us"), "n")
