"""The window functions give a stream the rows that they give the whole table."""

from pyspark.sql import functions as F

from trailframe.streaming import live


def fixes(spark):
    # seconds from minute 10 on (the first watermark is 0, and what is not after it is late) of three users: pauses of exactly a gap, longer ones, a repeated event
    rows = [(1, 1, 0), (1, 2, 30), (1, 3, 61), (2, 4, 5), (2, 4, 5), (3, 5, 90), (3, 6, 95)]
    return spark.createDataFrame(rows, "user long, event long, s long").select("user", "event", F.timestamp_seconds(F.col("s") + 600).alias("at"))


def streamed(spark, tmp_path, build, mode, name):
    source = str(tmp_path / name)
    fixes(spark).coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(fixes(spark).schema).parquet(source)
    query = build(live.late(stream, "10 seconds")).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return sorted(tuple(r) for r in spark.table(name).collect())


def test_limits_on_a_stream(spark, tmp_path):
    build = lambda d: live.limited(d, "user", "1 minute", 1)
    found = streamed(spark, tmp_path, build, "complete", "limited")
    assert found == sorted(tuple(r) for r in build(fixes(spark)).collect())
    assert (1, 600 * 10**6, 2, 1) in found


def test_sessions_split_after_longer_pauses_only(spark):
    found = sorted((r.user, r.from_us // 10**6 - 600, r.to_us // 10**6 - 600, r.n_fixes) for r in live.sessions(fixes(spark), "user", "30 seconds").collect())
    assert found == [(1, 0, 30, 2), (1, 61, 61, 1), (2, 5, 5, 2), (3, 90, 95, 2)]


def test_each_event_once(spark, tmp_path):
    found = streamed(spark, tmp_path, lambda d: live.once(d, "event").select("user", "event"), "append", "once")
    assert found == [(1, 1), (1, 2), (1, 3), (2, 4), (3, 5), (3, 6)]
