"""Typed words and the word index against brute force and answers worked out by hand."""

import math
import random

from pyspark.sql import functions as F
from test_fuzzy import osa

from trailframe.operators import postings, typos
from trailframe.sources.shared import new_path


def test_near_terms_find_every_pair(spark):
    """Short terms by their deletions, long ones by their parts, and pairs on the border of both."""
    draw = random.Random(3)
    terms = {"".join(draw.choice("abc") for _ in range(draw.choice((2, 3, 4, 5, 6, 7, 19, 20, 21, 22, 30)))) for _ in range(400)}
    words = set()
    for t in sorted(terms):
        for _ in range(2):
            w = list(t)
            for _ in range(draw.randint(1, 3)):
                i = draw.randrange(len(w))
                what = draw.randrange(4)
                if what == 0 and len(w) > 1:
                    del w[i]
                elif what == 1:
                    w.insert(i, draw.choice("abc"))
                elif what == 2:
                    w[i] = draw.choice("abc")
                elif i + 1 < len(w):
                    w[i], w[i + 1] = w[i + 1], w[i]
            words.add("".join(w))
    found = typos.near_terms(spark.createDataFrame([(w,) for w in words] + [(None,)], "word string"), spark.createDataFrame([(t, 1) for t in terms] + [(None, 1)], "term string, docs long"))
    got = {(r.word, r.term): r.distance for r in found.collect()}
    want = {}
    for w in words:
        edits = 0 if len(w) < 4 else 1 if len(w) <= 5 else 2
        for t in terms:
            if edits and w != t and abs(len(w) - len(t)) <= edits and (d := osa(w, t)) <= edits:
                want[w, t] = d
    assert got == want and any(len(t) > 20 for _, t in want) and any(len(t) <= 20 < len(w) for w, t in want)


def index(spark):
    rows = [(1, "Straße am Park"), (2, "park park"), (3, "Parkway"), (4, None), (5, "Öl und park ÖL"), (None, "park"), (6, "")]
    path = new_path(spark, "postings")
    postings.write_index(spark.createDataFrame(rows, "id long, name string"), path, "id", "name", buckets=4)
    return path


def found(spark, path, text, **more):
    queries = spark.createDataFrame([(7, text)], "query_id long, text string")
    return {r.id: r.rank_e6 for r in postings.search_index(spark, path, queries, buckets=4, **more).collect()}


def test_ranks_by_hand(spark):
    path = index(spark)
    # 6 rows have an id; "park" is in 1, 2 and 5, what begins with it in 3 as well
    idf = math.log((6 - 3 + 0.5) / (3 + 0.5))
    assert idf == 0
    assert found(spark, path, "park", last_is_prefix=False) == {1: 1, 2: 1, 5: 1}  # the least weight, in millionths
    olive = math.log((6 - 1 + 0.5) / 1.5)
    assert found(spark, path, "ol", last_is_prefix=False) == {5: int(olive * 2 * 2.2 / 3.2 * 1e6 + 0.5)}
    mean = 10 / 6
    norm = 1.2 * (0.25 + 0.75 * 4 / mean)
    assert found(spark, path, "ol", last_is_prefix=False, b=0.75) == {5: int(olive * 2 * 2.2 / (2 + norm) * 1e6 + 0.5)}


def test_all_words_and_the_last_as_a_prefix(spark):
    path = index(spark)
    assert set(found(spark, path, "park")) == {1, 2, 3, 5}
    assert set(found(spark, path, "park ö")) == {5}
    assert set(found(spark, path, "AM straß")) == {1}
    assert found(spark, path, "park missing") == {} and found(spark, path, "") == {} and found(spark, path, None) == {}


def test_search_reads_postings_only_of_its_buckets(spark):
    path = index(spark)
    plan = postings.search_index(spark, path, spark.createDataFrame([(1, "park")], "query_id long, text string"), buckets=4)._jdf.queryExecution().optimizedPlan().toString()
    assert "dynamicpruning" in plan.lower() or "bucket" in plan
    assert "name" not in plan.replace("lastname", "")


def test_places_of_equal_ranks(spark):
    rows = spark.createDataFrame([(1, 5, 10), (1, 4, 10), (1, 6, 11), (2, 9, 1)], "query_id int, id int, rank_e6 long")
    got = [(r.query_id, r.place, r.id) for r in postings.best(rows, F.col("id"), limit=2).orderBy("query_id", "place").collect()]
    assert got == [(1, 1, 6), (1, 2, 4), (2, 1, 9)]


def test_words_met_are_shuffled_once(spark):
    path = index(spark)
    df = postings.search_index(spark, path, spark.createDataFrame([(1, "park"), (2, "am str")], "query_id long, text string"), buckets=4)
    assert sorted((r.query_id, r.id) for r in df.collect()) == [(1, 1), (1, 2), (1, 3), (1, 5), (2, 1)]
    final = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].split("\n")
    dealt = [line for line in final if "Exchange hashpartitioning(id" in line]
    assert len(dealt) == 2 and sum("ReusedExchange" in line for line in dealt) == 1


def test_ranks_against_a_plain_loop(spark, monkeypatch):
    draw = random.Random(3)
    terms = ["park", "par", "parkway", "see", "seeweg", "am", "berg", "bergpark"]
    rows = [(i, " ".join(draw.choice(terms) for _ in range(draw.randrange(12)))) for i in range(60)]
    queries = [(q, " ".join(draw.choice(terms) for _ in range(draw.randrange(1, 4)))[: draw.randrange(2, 14)]) for q in range(25)]
    path = new_path(spark, "postings")
    postings.write_index(spark.createDataFrame(rows, "id long, name string"), path, "id", "name", buckets=8)
    held = {i: text.split() for i, text in rows}
    mean = sum(map(len, held.values())) / len(held)
    want = {}
    for q, text in queries:
        typed = text.split()
        n = [{i: c for i, ws in held.items() if (c := sum(t.startswith(w) if k + 1 == len(typed) else t == w for t in ws))} for k, w in enumerate(typed)]
        idf = [math.log((len(rows) - len(d) + 0.5) / (len(d) + 0.5)) for d in n]
        for i, ws in held.items():
            if all(i in d for d in n):
                parts = [(x if x > 0 else 1e-6) * d[i] * 2.2 / (d[i] + 1.2 * (0.25 + 0.75 * len(ws) / mean)) for x, d in zip(idf, n, strict=True)]
                want[q, i] = (len(ws), sum(int(p * 1e6 + 0.5) for p in parts))
    asked = spark.createDataFrame(queries, "query_id long, text string")
    for few in (postings.FEW_SLOTS, 20):  # 20: words are merged and queries taken in passes
        monkeypatch.setattr(postings, "FEW_SLOTS", few)
        got = {(r.query_id, r.id): (r["words"], r.rank_e6) for r in postings.search_index(spark, path, asked, b=0.75, buckets=8).collect()}
        assert got.keys() == want.keys() and len(got) > 100
        assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) <= 3 for k in want)
