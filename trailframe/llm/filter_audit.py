"""How five filters act upon each other: what each step of each order removes, part by part.

Every document gets five failure flags. A ``CUBE`` over the flags and the part, taken over the few combinations that
occur, holds the survivors of every subset of filters: the rows whose selected flags are all false. A step that applies
filter f after the set S removes survivors(S) - survivors(S and f), so pairs of subsets joined give all 120 orders.

Defined results: a null text counts as empty, a null part as the empty string. A row whose id is null has no smaller
id, so it never repeats another, and is never the one that others repeat; it carries no label. Rows that share an id
are counted one by one and do not repeat each other. Several labels of one id count as their union. Other columns are
ignored, and an empty table gives no rows.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

FILTERS = "ABCDE"
BLANKS = r"[\x20\x09-\x0D]+"
MEASURES = ("kept", "good", "toxic")


def failures(text: Column, words: Column) -> dict[str, Column]:
    """The four failure conditions that a text alone decides."""
    n, distinct = F.size(words).cast("long"), F.size(F.array_distinct(words)).cast("long")
    capitals = F.length(text).cast("long") - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {"A": n < 100, "B": 100 * distinct < 80 * n, "C": 100 * capitals > 10 * F.length(text).cast("long"), "D": text.rlike("[#$%&*|]")}


def flagged(docs: DataFrame, labels: DataFrame, part: str) -> DataFrame:
    """``(part, A .. E, good, toxic)`` of every document."""
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    cut = read.withColumn("words", F.array_remove(F.split("text", BLANKS), ""))
    failed = failures(F.col("text"), F.col("words"))
    judged = cut.select("doc_id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), *[c.alias(k) for k, c in failed.items()])
    judged = materialize(judged, "flags")
    known = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")
    )
    # only texts that repeat; counted with combining before the shuffle, and written, so that Spark may split the join on a hot text
    first = judged.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("rows")).filter("rows > 1").select("digest", "first")
    first = materialize(first, "first-ids")
    whole = judged.join(first, "digest", "left").join(known, "doc_id", "left")
    no = F.lit(False)
    found = whole.select("part", *"ABCD", F.coalesce(F.col("doc_id") > F.col("first"), no).alias("E"), F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))
    found.written = (judged, first)
    return found


def survivors(flags: DataFrame) -> DataFrame:
    """``(part, mask, kept, good, toxic)`` of every part and subset of filters, zeros included; bit i of mask is filter i."""
    seen = flags.groupBy("part", *FILTERS).agg(F.count("*").alias("kept"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))
    mask = sum(((1 - F.grouping(f).cast("int")) * (1 << i) for i, f in enumerate(FILTERS)), F.lit(0))
    cubed = seen.cube(*FILTERS, "part").agg(mask.alias("mask"), F.grouping("part").alias("over_parts"), *[F.sum(m).alias(m) for m in MEASURES])
    none_failed = ~F.coalesce(F.greatest(*FILTERS), F.lit(False))
    some = cubed.filter((F.col("over_parts") == 0) & none_failed).select("part", "mask", *MEASURES)
    parts = seen.select("part").distinct()
    grid = parts.select("part", F.explode(F.sequence(F.lit(0), F.lit((1 << len(FILTERS)) - 1))).alias("mask"))
    return grid.join(some, ["part", "mask"], "left").fillna(0, MEASURES)


def steps() -> list[tuple[str, int, int, int]]:
    """(filter_order, step, filter, filters before) of every step of every order; a fixed number of rows."""
    return [("".join(FILTERS[i] for i in order), k + 1, f, sum(1 << i for i in order[:k])) for order in permutations(range(len(FILTERS))) for k, f in enumerate(order)]


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """A row for each part, filter order and step."""
    spark, every = docs.sparkSession, (1 << len(FILTERS)) - 1
    flags = flagged(docs, labels, part)
    found = materialize(survivors(flags), "survivors")
    discard(*flags.written)
    # the survivors before and after filter f, for each set that does not hold f
    before = found.select("part", F.col("mask").alias("before"), *[F.col(m).alias(f"{m}_before") for m in MEASURES], F.explode(F.sequence(F.lit(0), F.lit(len(FILTERS) - 1))).alias("f"))
    before = before.withColumn("bit", F.expr("shiftleft(1, f)")).filter("before & bit = 0").withColumn("mask", F.expr("before | bit")).drop("bit")
    lost = {"kept": "removed", "good": "good_lost", "toxic": "toxic_lost"}
    pairs = before.join(found, ["part", "mask"]).select("part", "f", "before", "kept", *[(F.col(f"{m}_before") - F.col(m)).alias(name) for m, name in lost.items()])
    # as many of all orders reach filter f with exactly this set before it
    n, size = len(FILTERS), F.bit_count("before")
    orders = F.get(F.array(*[F.lit(factorial(k) * factorial(n - 1 - k)) for k in range(n)]), size.cast("int"))
    alone = pairs.groupBy("part", "f").agg(
        F.max(F.when(F.col("before") == 0, F.col("removed"))).alias("failing"),
        F.max(F.when(F.col("before").bitwiseOR(F.expr("shiftleft(1, f)")) == every, F.col("removed"))).alias("unique_fails"),
        F.sum(F.col("removed") * orders).alias("shapley"),
    )
    listed = spark.createDataFrame(steps(), "filter_order string, step int, f int, before int")
    joined = pairs.join(F.broadcast(listed), ["f", "before"]).join(alone, ["part", "f"])
    return joined.select(
        "part", "filter_order", "step", "kept", "removed", (F.col("failing") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley"
    )


SQL = r"""
WITH RECURSIVE judged AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
known AS (
  SELECT doc_id, max(coalesce(quality, 0) = 1) AS good, max(coalesce(toxic, 0) = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
flags AS (
  SELECT part,
    (len(words) < 100)::INT AS fa,
    (100 * len(list_distinct(words)) < 80 * len(words))::INT AS fb,
    (100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 10 * length(text))::INT AS fc,
    regexp_matches(text, '[#$%&*|]')::INT AS fd,
    coalesce(j.doc_id > min(j.doc_id) OVER (PARTITION BY text), false)::INT AS fe,
    coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM judged j LEFT JOIN known k ON j.doc_id = k.doc_id),
masks AS (SELECT part, fa + 2 * fb + 4 * fc + 8 * fd + 16 * fe AS failed, good, toxic FROM flags),
orders AS (
  SELECT '' AS filter_order, 0 AS used
  UNION ALL
  SELECT filter_order || f, used + bit FROM orders, (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(f, bit) WHERE used & bit = 0),
steps AS (
  SELECT filter_order, s.step::INT AS step, 1 << (ascii(substr(filter_order, s.step::INT, 1)) - 65) AS bit,
    list_sum(list_transform(range(1, s.step), lambda i: 1 << (ascii(substr(filter_order, i::INT, 1)) - 65))) AS before
  FROM orders, (SELECT unnest(range(1, 6)) AS step) s WHERE used = 31),
counted AS (
  SELECT part, filter_order, step, bit,
    count(*) FILTER (failed & (coalesce(before, 0)::BIGINT | bit) = 0) AS kept,
    count(*) FILTER (failed & coalesce(before, 0)::BIGINT = 0 AND failed & bit > 0) AS removed,
    count(*) FILTER (failed & coalesce(before, 0)::BIGINT > 0 AND failed & bit > 0) AS redundant,
    count(*) FILTER (failed = bit) AS unique_fails,
    count(*) FILTER (failed & coalesce(before, 0)::BIGINT = 0 AND failed & bit > 0 AND good) AS good_lost,
    count(*) FILTER (failed & coalesce(before, 0)::BIGINT = 0 AND failed & bit > 0 AND toxic) AS toxic_lost
  FROM masks, steps GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley
FROM counted
"""
