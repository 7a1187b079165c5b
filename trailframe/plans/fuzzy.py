"""Queries of fuzzy words, rings, calories and units, named by their number, with SQL counterparts where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fuzzy, text
from ..functions.text import FROM, TO, WORD
from ..sources.adapters import table

#: Words of the vocabulary, each as it could be typed: the same, cut, without vowels, two letters swapped, one wrong, turned round.
_TYPED = """CASE (length(term) * 7 + docs) % 6 WHEN 0 THEN term WHEN 1 THEN left(term, CAST(ceil(length(term) / 2.0) AS INT)) WHEN 2 THEN {no_vowels}
  WHEN 3 THEN concat(left(term, 1), substr(term, 3, 1), substr(term, 2, 1), substr(term, 4)) WHEN 4 THEN concat(left(term, 1), 'x', substr(term, 3)) ELSE reverse(term) END"""
_SPARK_TYPED = _TYPED.format(no_vowels="regexp_replace(term, '[aeiou]', '')")
_VOCABULARY = f"""v AS (SELECT term, count(*) AS docs FROM (SELECT unnest(list_distinct(regexp_extract_all(translate(lower(text), '{FROM}', '{TO}'), '{WORD}'))) AS term FROM documents) GROUP BY term),
  p AS (SELECT term, {_TYPED.format(no_vowels="regexp_replace(term, '[aeiou]', '', 'g')")} AS typed FROM v)"""


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = table(spark, sf_dir, "documents").select(F.explode(F.array_distinct(text.words(text.fold(F.col("text"))))).alias("term"))
    return terms.groupBy("term").agg(F.count("*").alias("docs"))


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _terms(spark, sf_dir).select("term", F.expr(_SPARK_TYPED).alias("typed"))


def str_05_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With 1 as the most, where the restricted distance is the unrestricted one that SQL has."""
    return _typed(spark, sf_dir).select("term", "typed", fuzzy.edit_distance(F.col("typed"), F.col("term"), 1).alias("distance"))


def str_07_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _typed(spark, sf_dir).select("term", "typed", F.floor(fuzzy.word_match(F.col("typed"), F.col("term")) * 10000 + 0.5).cast("long").alias("score"))


_RING = [(0, 0), (100, 0), (100, 100), (50, 40), (0, 100)]


def prj_07_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as points near the ring of their nation, a square with a notch."""
    nations = table(spark, sf_dir, "nation").select("n_nationkey", F.array(*[F.struct((F.col("n_nationkey") * 100 + x).alias("x"), F.lit(y).cast("long").alias("y")) for x, y in _RING]).alias("ring"))
    points = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 25).alias("n_nationkey"), (F.col("o_custkey") * 37 % 110 - 5).alias("dx"), (F.col("o_orderkey") * 13 % 110 - 5).alias("y"))
    x = F.col("n_nationkey") * 100 + F.col("dx")
    return points.join(nations, "n_nationkey").select("o_orderkey", fuzzy.ring_contains(F.col("ring"), x, F.col("y")).alias("inside"), fuzzy.polygon_contains(F.col("ring"), x, F.col("y")).alias("within"))


_RIDES = """SELECT o_orderkey, CASE WHEN o_orderkey % 17 <> 0 THEN CAST(50 + o_custkey % 40 AS DOUBLE) END AS weight, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(20 + o_custkey % 50 AS INT) END AS age,
  CASE o_orderkey % 3 WHEN 0 THEN 'male' WHEN 1 THEN 'female' ELSE 'unspecified' END AS sex, o_orderkey % 2 = 0 AS estimate, o_orderkey % 23 * 1000000000 AS moving_us, o_custkey % 25 * 1000000000 AS power_us,
  CAST(o_custkey * 3 AS DOUBLE) AS power_kj, o_custkey * 7 % 40 * 1000000000 AS heart_us, CAST(o_custkey * 7 % 40 * 1000 * (90 + o_orderkey % 80) AS DOUBLE) AS beat_s, o_orderkey * 11 % 30 * 1000000000 AS estimated_us,
  CAST(o_custkey * 2 AS DOUBLE) AS estimated_kj, CAST(o_orderkey % 90 AS DOUBLE) AS met_hours FROM orders"""


def agg_12_calories(spark: SparkSession, sf_dir: str) -> DataFrame:
    rides = spark.sql(_RIDES.replace("FROM orders", "FROM {rows}"), rows=table(spark, sf_dir, "orders"))
    kcal, source = fuzzy.calories({c: F.col(c) for c in rides.columns})
    return rides.select("o_orderkey", kcal.alias("kcal"), source.alias("source"))


def num_04_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("o_custkey") * 7 % 3001 - 1500.0
    feet = [fuzzy.feet(m, step).alias(name) for step, name in ((1, "feet"), (10, "ten_feet"), (100, "hundred_feet"))]
    tenth = lambda c: fuzzy.nearest_whole(c * 10)
    return table(spark, sf_dir, "orders").select("o_orderkey", *feet, tenth(fuzzy.fahrenheit(m / 50)).alias("f_tenths"), tenth(fuzzy.miles_an_hour(m / 100)).alias("mph_tenths"))


QUERIES = {f.__name__: f for f in (str_05_distances, str_07_scores, prj_07_within, agg_12_calories, num_04_units)}

_EDGES = ", ".join(f"({ax}, {ay}, {bx}, {by})" for (ax, ay), (bx, by) in zip(_RING[-1:] + _RING[:-1], _RING, strict=True))
_WHOLE = "CAST(sign({0}) * floor(abs({0}) / {1} + 0.5) * {1} AS BIGINT)"
_KJ = "greatest(0, (({0}::DOUBLE + {1}::DOUBLE * weight + {2}::DOUBLE * age) * (heart_us / 60e6) + {3}::DOUBLE * (beat_s / 60))) / 4.184::DOUBLE"

#: SQL measures bytes, so letters of two bytes become capitals, which no folded word has.
_DISTANCE = "damerau_levenshtein(translate({0}, 'ßæœ', 'SEO'), translate({1}, 'ßæœ', 'SEO'))"

ORACLE = {
    "str_05_distances": f"WITH {_VOCABULARY} SELECT term, typed, CAST(least({_DISTANCE.format('typed', 'term')}, 2) AS INT) AS distance FROM p",
    "str_07_scores": f"""WITH {_VOCABULARY}, q AS (SELECT term, typed, length(typed) AS n, CASE WHEN length(typed) < 4 THEN 0 WHEN length(typed) <= 5 THEN 1 ELSE 2 END AS e, {_DISTANCE.format('typed', 'term')} AS d FROM p)
      SELECT term, typed, CAST(floor(10000 * CASE WHEN typed = term THEN 1.0::DOUBLE WHEN typed = '' THEN 0 WHEN starts_with(term, typed) THEN 0.8::DOUBLE + 0.18::DOUBLE * n / length(term)
        ELSE greatest(CASE WHEN n >= 2 AND n < length(term) AND left(typed, 1) = left(term, 1) AND regexp_matches(term, array_to_string(string_split(typed, ''), '.*')) THEN CASE WHEN n <= 4 THEN 0.72::DOUBLE ELSE 0.6::DOUBLE END ELSE 0 END,
          CASE WHEN e > 0 AND d <= e THEN 0.8::DOUBLE - 0.12::DOUBLE * d ELSE 0 END, CASE WHEN e > 0 AND length(term) > n AND {_DISTANCE.format('typed', 'left(term, n)')} <= 1 THEN 0.62::DOUBLE ELSE 0 END) END + 0.5) AS BIGINT) AS score FROM q""",
    "prj_07_within": f"""WITH p AS (SELECT o_orderkey, o_custkey * 37 % 110 - 5 AS x, o_orderkey * 13 % 110 - 5 AS y FROM orders), e AS (SELECT * FROM (VALUES {_EDGES}) AS t(x1, y1, x2, y2)),
      s AS (SELECT *, (x2 - x1) * (y - y1) - (x - x1) * (y2 - y1) AS side FROM p, e)
      SELECT o_orderkey, count(*) FILTER (CASE WHEN (y1 > y) <> (y2 > y) THEN x < (x1 - x2) * (y - y2) / (y1 - y2)::DOUBLE + x2 ELSE false END) % 2 = 1 AS inside,
        count(*) FILTER (side = 0 AND x BETWEEN least(x1, x2) AND greatest(x1, x2) AND y BETWEEN least(y1, y2) AND greatest(y1, y2)) > 0
          OR count(*) FILTER (y1 <= y AND y2 > y AND side > 0) <> count(*) FILTER (y1 > y AND y2 <= y AND side < 0) AS within FROM s GROUP BY o_orderkey""",
    "agg_12_calories": f"""WITH r AS ({_RIDES}), s AS (SELECT *, CASE WHEN weight IS NULL OR moving_us <= 0 THEN NULL WHEN power_us >= 0.9::DOUBLE * moving_us THEN 'power' WHEN sex <> 'unspecified' AND age IS NOT NULL AND heart_us >= 0.9::DOUBLE * moving_us THEN 'heartRate'
        WHEN estimate AND estimated_us >= 0.9::DOUBLE * moving_us THEN 'estimatedPower' ELSE 'speed' END AS source FROM r)
      SELECT o_orderkey, CAST(floor(0.5 + CASE source WHEN 'power' THEN power_kj WHEN 'estimatedPower' THEN estimated_kj WHEN 'speed' THEN met_hours * weight
        WHEN 'heartRate' THEN CASE sex WHEN 'male' THEN {_KJ.format(*fuzzy.BEAT_LINES["male"])} ELSE {_KJ.format(*fuzzy.BEAT_LINES["female"])} END END) AS BIGINT) AS kcal, source FROM s""",
    "num_04_units": "WITH m AS (SELECT o_orderkey, o_custkey * 7 % 3001 - 1500.0::DOUBLE AS m FROM orders) SELECT o_orderkey, "
    + ", ".join(f"{_WHOLE.format('(m / 0.3048::DOUBLE)', step)} AS {name}" for step, name in ((1, "feet"), (10, "ten_feet"), (100, "hundred_feet")))
    + f", {_WHOLE.format('((m / 50 * 9 / 5 + 32) * 10)', 1)} AS f_tenths, {_WHOLE.format('(m / 100 * 3600 / 1609.344::DOUBLE * 10)', 1)} AS mph_tenths FROM m",
}
