"""Typed queries, read by hand."""

import pytest
from pyspark.sql import functions as F

from trailframe.functions import queries

CASES = [
    ("12 Main Street", ["Main", "Street"], "12", 12), ("Main Street 12a", ["Main", "Street"], "12a", 12), ("Main Street 12 bis", ["Main", "Street"], "12 bis", 12), ("12/3, Main", ["Main"], "12/3", 12),
    ("92-10 Main", ["Main"], "92-10", 92), ("42nd Street", ["42nd", "Street"], None, None), ("400w 42nd", ["w", "42nd"], "400", 400), ("400west 42nd 7", ["west", "42nd", "7"], "400", 400),
    ("12", ["12"], None, None), ("12345 Town", ["Town"], None, None), ("12345", ["12345"], None, None), ("1012 AB Lane 5", ["Lane"], "5", 5), ("Rue d'Or; 5e", ["Rue", "d", "Or", "5e"], None, None),
    ("Straße 1. 3", ["Straße", "1"], "3", 3), ("Lane 7 9", ["Lane", "9"], "7", 7), ("", [], None, None), (None, [], None, None), ("a b c d e f g h i j", None, None, None),
]


@pytest.fixture(scope="module")
def read(spark):
    rows = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, text string").withColumn("t", queries.tokens(F.col("text")))
    return {r.i: r for r in rows.select("i", queries.parsed(F.col("t")).alias("p"), queries.parsed(F.col("t"), True).alias("n")).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_words_and_numbers(read, i):
    _, words, house, number = CASES[i]
    got = read[i].p
    if words is not None:
        assert got.words == words
    else:
        assert len(got.words) == 8
    assert (got.house_number, got.number) == (house, number)


def test_a_number_that_is_a_name(read):
    assert (read[0].n.words, read[0].n.house_number) == (["12", "Main", "Street"], None)
    assert (read[14].n.words, read[14].n.number) == (["Lane", "7"], 9)
