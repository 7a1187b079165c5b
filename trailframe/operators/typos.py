"""Stored words that a mistyped word may stand for, found by an index of deletions (SRT-10).

Two words that are ``k`` edits apart, a swap of neighbours being one edit, share a word that is left of each after at
most ``k`` of its letters are taken out. Every term is therefore laid under the hashes of what is left of it, a typed
word under its own, and the two meet by an equi-join; the exact distance decides. A long term has too many deletions:
it is cut into ``PARTS`` parts instead, of which ``k`` edits, each of which touches two at most, leave one whole, and a
typed word looks for that part near its place. No key has more than the terms that are near each other, and no
group of words is compared pair by pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fuzzy import edit_distance
from ..functions.text import allowed_edits

MOST_EDITS = 2
#: Terms beyond this length are cut into parts; two edits touch four parts at most.
LONG = 20
PARTS = 2 * MOST_EDITS + 1


def _cut(word: Column, i: Column) -> Column:
    """The word without its i-th letter."""
    return F.concat(F.left(word, i - 1), F.substr(word, i + 1))


def deletions(word: Column, most: Column) -> Column:
    """``(left, deleted)`` of a word: itself, and what is left after one or two deletions, ``most`` at most."""
    n = F.length(word)
    kept = lambda deleted: lambda w: F.struct(F.xxhash64(w).alias("left"), F.lit(deleted).alias("deleted"))
    upto = lambda lo, hi: F.when(hi >= lo, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))
    one = F.transform(upto(F.lit(1), n), lambda i: _cut(word, i))
    # the later letter first, so that the place of the earlier one stays
    two = F.flatten(F.transform(upto(F.lit(2), n), lambda j: F.transform(F.sequence(F.lit(1), j - 1), lambda i: _cut(_cut(word, j), i))))
    none = F.array().cast("array<struct<left: bigint, deleted: int>>")
    listed = [F.array(kept(0)(word))] + [F.when(most >= k, F.transform(F.array_distinct(words), kept(k))).otherwise(none) for k, words in ((1, one), (2, two))]
    return F.concat(*listed)


def _by_deletions(typed: DataFrame, terms: DataFrame) -> DataFrame:
    # a typed word has 4 letters for one edit and 6 for two, so that shorter remains can meet none
    n = F.length("term")
    most = F.when(n >= 6, 2).when(n >= 4, 1).otherwise(0)
    index = terms.filter(n.between(3, LONG)).select("term", "docs", F.inline(deletions(F.col("term"), most)))
    asked = typed.filter(F.length("word") <= LONG + MOST_EDITS).select("word", "edits", F.inline(deletions(F.col("word"), F.col("edits"))))
    met = asked.withColumnRenamed("deleted", "taken").join(index, "left").filter("deleted <= edits")
    return met.select("word", "edits", "term", "docs")


def _by_parts(typed: DataFrame, terms: DataFrame) -> DataFrame:
    n = F.length("term")
    long = terms.filter(n > LONG).withColumn("n", n).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    begin = lambda part: F.floor(part * F.col("n") / PARTS).cast("int") + 1
    index = long.select("term", "docs", "n", "part", F.xxhash64(F.substr("term", begin(F.col("part")), begin(F.col("part") + 1) - begin(F.col("part")))).alias("left"))
    asked = typed.filter(F.length("word") > LONG - MOST_EDITS).withColumn("n", F.explode(F.sequence(F.length("word") - F.col("edits"), F.length("word") + F.col("edits"))))
    asked = asked.filter(F.col("n") > LONG).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))).withColumn("shift", F.explode(F.sequence(-F.col("edits"), F.col("edits"))))
    at = begin(F.col("part")) + F.col("shift")
    size = begin(F.col("part") + 1) - begin(F.col("part"))
    asked = asked.filter((at >= 1) & (at + size - 1 <= F.length("word"))).select("word", "edits", "n", "part", F.xxhash64(F.substr("word", at, size)).alias("left"))
    return asked.distinct().join(index, ["n", "part", "left"]).select("word", "edits", "term", "docs")


def near_terms(words: DataFrame, terms: DataFrame, kept: Column | None = None) -> DataFrame:
    """``(word, term, docs, edits, distance)`` of all stored terms within the edits that a typed word's length allows, itself left out.

    ``kept`` is a condition on ``word`` and ``term`` that is looked at before distances are.
    """
    typed = words.select("word").distinct().withColumn("edits", allowed_edits(F.col("word"))).filter("edits > 0")
    stored = terms.groupBy("term").agg(F.max("docs").alias("docs"))
    met = _by_deletions(typed, stored).unionByName(_by_parts(typed, stored)).filter("word <> term AND abs(length(word) - length(term)) <= edits")
    met = (met if kept is None else met.filter(kept)).distinct().withColumn("plain", F.levenshtein("word", "term")).filter("plain <= 2 * edits")
    # a swap is two plain edits and changes no letter, any other edit changes one: elsewhere both distances are one
    letters = [F.array_join(F.array_sort(F.split(c, "")), "") for c in ("word", "term")]
    swapped = (F.col("plain") >= 2) & (F.levenshtein(*letters) <= F.when(F.col("plain") == 3, 2).otherwise(0))
    exact = F.when(swapped, edit_distance(F.col("word"), F.col("term"), F.col("edits"))).otherwise(F.col("plain"))
    return met.select("word", "term", "docs", "edits", exact.alias("distance")).filter("distance <= edits")


def typo_candidates(words: DataFrame, terms: DataFrame, most: int = 5) -> DataFrame:
    """The best stored ``terms (term, docs)`` for each typed ``word``: by distance, then most documents, then name (SRT-10).

    Candidates begin with the word's first two letters, these swapped, or its first and third; where none of them is one
    edit away, all terms with its first letter are. Null words and terms meet none; repeated words are one, and a term
    that is listed twice counts with its most documents.
    """
    at = lambda i: F.substr("word", F.lit(i), F.lit(1))
    head = F.left("term", F.lit(2))
    close = head.isin(F.concat(at(1), at(2)), F.concat(at(2), at(1)), F.concat(at(1), at(3)))
    met = near_terms(words, terms, close | (F.left("term", F.lit(1)) == at(1))).withColumn("close", close)
    of_word = Window.partitionBy("word")
    met = met.withColumn("found", F.max(F.col("close") & (F.col("distance") <= 1)).over(of_word)).filter("close OR NOT found")
    place = F.row_number().over(of_word.orderBy("distance", F.desc("docs"), "term"))
    return met.select("word", "term", "docs", "distance", place.alias("place")).filter(F.col("place") <= most)
