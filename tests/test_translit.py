"""Names in Latin letters and scores of places, by hand."""

import math

import pytest
from pyspark.sql import functions as F

from trailframe.functions import translit as T


@pytest.mark.parametrize(
    ("name", "latin", "held"),
    [
        ("София", "sofiya", "sofiya"), ("Щъркелово Ю", "shtarkelovo yu", "shtarkelovo yu"), ("Київ", "kiyiv", "kiyiv kyiv"), ("Ґ", "g", "g"), ("Єва Їжа", "yeva yizha", "yeva yizha"), ("Μπάρ ουζο Αθήνα", "bar ouzo athina", "bar ouzo athina"),
        ("Λίμνη ντ εντ", "limni d ent", "limni d ent"), ("Main Straße", "main straße", "main straße"), ("", "", ""), ("Мельник", "melnik", "melnik"), ("Харків", "harkiv", "harkiv kharkiv"),
    ],
)
def test_names(spark, name, latin, held):
    row = spark.createDataFrame([(name,)], "n string").select(T.translit(F.col("n")).alias("t"), T.index_text(F.col("n")).alias("i")).first()
    assert (row.t, row.i) == (latin, held)


def test_scores(spark):
    df = spark.createDataFrame([(0.9, 2, 3.0, "city", 999_999, 12, True), (0.5, 0, None, None, None, None, False), (0.5, 0, 0.0, "hamlet", None, 5, None)], "q double, r int, km double, kind string, pop long, imp int, addr boolean")
    got = [r[0] for r in df.select(T.place_score(*map(F.col, df.columns))).collect()]
    assert got == pytest.approx([0.9 - 0.002 - 0.12 + 0.1 + 0.09 + 0.04 * math.log2(8) + 0.25, 0.5, 0.51])
