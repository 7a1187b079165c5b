"""Edit distances and candidates against plain Python; scores, rings, calories and units by hand."""

import itertools

import pytest
from pyspark.sql import functions as F

from trailframe.functions import fuzzy
from trailframe.operators.typos import typo_candidates


def osa(a, b):
    d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i * j}
    for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
        d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
        if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
            d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


WORDS = ["", "a", "ca", "ac", "abc", "acb", "bca", "cab", "abcd", "badc", "street", "steret", "strete", "stret", "strasse", "öl", "lö"]


def test_edit_distance_is_the_restricted_one(spark):
    pairs = list(itertools.product(WORDS, WORDS))
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", fuzzy.edit_distance(F.col("a"), F.col("b"), 3).alias("d"))
    assert {(r.a, r.b): r.d for r in df.collect()} == {p: min(osa(*p), 4) for p in pairs}
    assert osa("ca", "abc") == 3


def test_null_words_have_no_distance(spark):
    df = spark.createDataFrame([("a", None), (None, None)], "a string, b string")
    assert [r[0] for r in df.select(fuzzy.edit_distance(F.col("a"), F.col("b"), 2)).collect()] == [None, None]


def test_candidates_against_all_pairs(spark):
    terms = [("street", 9), ("stretch", 2), ("strand", 5), ("stern", 5), ("tsreet", 1), ("sxreet", 1), ("treets", 3), ("abbey", 1), ("abbot", 7), ("s", 1)]
    words = ["steret", "street", "abbye", "abb", "sttern", "street", "zzzz", "axbex"]
    found = typo_candidates(spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame(terms, "term string, docs long")).collect()
    want = set()
    for w in set(words):
        edits = 0 if len(w) < 4 else 1 if len(w) <= 5 else 2
        near = {(osa(w, t), -n, t) for t, n in terms if w != t and osa(w, t) <= edits}
        two = {x for x in near if x[2][:2] in (w[:2], w[1] + w[0], w[0] + w[2])}
        if not any(x[0] <= 1 for x in two):
            two |= {x for x in near if x[2][0] == w[0]}
        want |= {(w, t, -n, d, i + 1) for i, (d, n, t) in enumerate(sorted(two)[:5])} if edits else set()
    assert {(r.word, r.term, r.docs, r.distance, r.place) for r in found} == want and want


@pytest.mark.parametrize(
    ("typed", "name", "score"),
    [("road", "road", 1), ("str", "strasse", 0.8 + 0.18 * 3 / 7), ("rd", "road", 0.72), ("blvrd", "boulevard", 0.6), ("steret", "street", 0.68), ("brookyl", "brooklyn", 0.62), ("rx", "road", 0), ("", "a", 0), ("abcx", "abcdefg", 0.62)],
)
def test_word_scores(spark, typed, name, score):
    row = spark.createDataFrame([(typed, name)], "a string, b string").select(fuzzy.word_match(F.col("a"), F.col("b"))).collect()
    assert row[0][0] == pytest.approx(score)


def test_rings(spark):
    ring = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in [(0, 0), (10, 0), (10, 10), (5, 4), (0, 10)]])
    df = spark.createDataFrame([(5, 2), (5, 8), (5, 4), (0, 5), (11, 5), (10, 0)], "x long, y long")
    got = [tuple(r) for r in df.select(fuzzy.ring_contains(ring, F.col("x"), F.col("y")), fuzzy.polygon_contains(ring, F.col("x"), F.col("y"))).collect()]
    assert [g[1] for g in got] == [True, False, True, True, False, True]
    assert [got[i][0] for i in (0, 1, 4)] == [True, False, False]
    none = F.array().cast("array<struct<x:bigint,y:bigint>>")
    assert df.select(fuzzy.polygon_contains(none, F.col("x"), F.col("y")).alias("w")).filter("w").count() == 0


def test_calories_by_source(spark):
    names = ["weight", "age", "sex", "estimate", "moving_us", "power_us", "power_kj", "heart_us", "beat_s", "estimated_us", "estimated_kj", "met_hours"]
    hour = 3_600_000_000
    rows = [
        (70.0, 40, "male", True, hour, hour * 9 // 10, 500.4, hour, 3600.0 * 140, hour, 1.0, 8.0),
        (70.0, 40, "male", True, hour, 0, 0.0, hour, 3600.0 * 140, hour, 1.0, 8.0),
        (70.0, None, "male", True, hour, 0, 0.0, hour, 3600.0 * 140, hour, 300.5, 8.0),
        (70.0, None, "unspecified", False, hour, 0, 0.0, hour, 0.0, hour, 1.0, 8.0),
        (None, 40, "male", True, hour, hour, 1.0, hour, 0.0, hour, 1.0, 8.0),
        (70.0, 40, "female", True, hour, 0, 0.0, hour, 0.0, hour, 1.0, 8.0),
    ]
    types = "weight double, age int, sex string, estimate boolean, moving_us long, power_us long, power_kj double, heart_us long, beat_s double, estimated_us long, estimated_kj double, met_hours double"
    got = [tuple(r) for r in spark.createDataFrame(rows, types).select(*fuzzy.calories({n: F.col(n) for n in names})).collect()]
    # heart: (-55.0969 + 13.916 + 8.068) * 60 + 0.6309 * 140 * 60 = 3312.786 kJ
    assert got == [(500, "power"), (792, "heartRate"), (301, "estimatedPower"), (560, "speed"), (None, None), (0, "heartRate")]


def test_units(spark):
    m = spark.createDataFrame([(100.0,), (-100.0,)], "m double")
    assert [tuple(r) for r in m.select(fuzzy.feet(F.col("m")), fuzzy.feet(F.col("m"), 10), fuzzy.feet(F.col("m"), 100)).collect()] == [(328, 330, 300), (-328, -330, -300)]
    assert m.select(fuzzy.fahrenheit(F.col("m"))).first()[0] == 212.0
