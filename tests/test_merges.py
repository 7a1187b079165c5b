"""Merges with rows without identity."""


def test_rows_without_identity_stay_apart(spark):
    from trailframe.operators import places as P

    one = spark.createDataFrame([(1, "a", 5), (None, "b", 6), (None, "c", 7)], "id long, name string, importance long")
    two = spark.createDataFrame([(1, "z", 9), (None, "b", 6)], "id long, name string, importance long")
    found = sorted(map(str, (tuple(r) for r in P.merged_by_identity([one, two], ["id"], "importance").collect())))
    assert found == sorted(map(str, [(1, "a", 9, 2), (None, "b", 6, 1), (None, "b", 6, 1), (None, "c", 7, 1)]))
