"""Benchmark decontamination: a prefix-filtered containment join, in DataFrame functions only.

A benchmark item gives windows of ``window`` consecutive words (a shorter item is one window). A window is
a set of word shingles with positions; since all of them must be in the document, one necessary prefix
token is enough: the window's rarest shingle, by its count over all documents.

1. Document shingles are hashed and joined with the benchmark's shingles; what is left (``hits``) is a small
   table. Each document also gives one row with its number of words.
2. Shingle counts from ``hits`` order every window's shingles by rarity; windows with a shingle that no
   document has are dropped.
3. Hits on a prefix shingle give candidate starts; a start before word 0 or an end past the last word is out.
4. Candidates meet the whole text again and the window's words are compared one by one.

The benchmark side is broadcast only when a count shows it small, else it is shuffled. Counts are combined
map-side. Nulls: a null text has no words; an item without words gives no window; a null item id marks
words as hit but is in no id list. Repeated rows, rows that share an id and rows with a null id are answered row by row
(a row is known by its id and text). Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, hint_small, materialize

#: Everything in ASCII but 0-9 and a-z separates words.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
SHINGLE = 3


def words_of(col: Column | str) -> Column:
    """Lower-cased words of a text; null for a null text."""
    return F.filter(F.split(ascii_lower(col), NOT_WORD), lambda w: w != "")


def _places(words: Column, n: Column, k: int) -> Column:
    """Hashes of the ``k``-word shingles of ``n >= k`` words, in order."""
    return F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(*(F.get(words, i + j) for j in range(k))))


def benchmark_windows(items: DataFrame, window: int) -> DataFrame:
    """``(item_id, window, size, words)``: every window of every item."""
    w = items.select("item_id", words_of("text").alias("w")).filter(F.size("w") > 0)
    size = F.least(F.lit(window), F.size("w"))
    starts = w.select("item_id", "w", size.alias("size"), F.explode(F.sequence(F.lit(1), F.size("w") - size + 1)).alias("i"))
    return starts.select("item_id", "size", F.slice("w", F.col("i"), F.col("size")).alias("words")).withColumn("window", F.array_join("words", " "))


def window_shingles(windows: DataFrame, shingle: int) -> DataFrame:
    """``(window, size, k, h, offset)`` of every distinct window; k is below ``shingle`` only for shorter windows."""
    one = windows.select("window", "size", "words").dropDuplicates(["window"])
    parts = [
        one.filter((F.size("words") == k) if k < shingle else (F.size("words") >= k)).select(
            "window", "size", F.lit(k).alias("k"),
            F.posexplode(_places(F.col("words"), F.size("words"), k)).alias("offset", "h"),
        )
        for k in range(1, shingle + 1)
    ]
    return reduce(DataFrame.unionByName, parts)


def document_hits(docs: DataFrame, tokens: DataFrame, sizes: list[int]) -> DataFrame:
    """``(doc_id, row_key, n, k, pos, h)``: places of the benchmark's shingles, and one row (k = 0) a document."""
    w = docs.select("doc_id", F.xxhash64("text").alias("row_key"), words_of("text").alias("w"))
    w = w.withColumn("n", F.greatest(F.coalesce(F.size("w"), F.lit(0)), F.lit(0)))

    def places(k: int) -> Column:
        return F.when(F.col("n") >= k, _places(F.col("w"), F.col("n"), k)).otherwise(F.array().cast("array<bigint>"))

    parts = []
    for order, k in enumerate(sizes or [SHINGLE]):
        marked = F.concat(F.array(F.lit(0).cast("bigint")), places(k))
        part = w.select("doc_id", "row_key", "n", F.posexplode(marked).alias("at", "h")).withColumn("k", F.when(F.col("at") == 0, F.lit(0)).otherwise(F.lit(k)))
        parts.append(part if order == 0 else part.filter("at > 0"))
    rows = reduce(DataFrame.unionByName, parts)
    return rows.join(tokens, ["k", "h"]).select("doc_id", "row_key", "n", "k", (F.col("at") - 1).alias("pos"), "h")


def contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, row_key, n_words, n_hit, n_items, item_ids, contaminated)`` for every row of ``docs``; row_key is the hash of its text."""
    spark = docs.sparkSession
    windows = materialize(benchmark_windows(items, window), "windows")
    tokens = materialize(window_shingles(windows, shingle), "window-shingles")
    sizes = sorted(r.k for r in tokens.select("k").distinct().collect())  # at most ``shingle`` values
    keys = tokens.select("k", "h").distinct().union(spark.sql("SELECT 0 AS k, 0L AS h"))
    hits = materialize(document_hits(docs, hint_small(keys), sizes), "hits")

    counts = hits.filter("k > 0").groupBy("k", "h").agg(F.count("*").alias("seen"))
    ranked = tokens.join(counts, ["k", "h"], "left").fillna(0, ["seen"])
    prefix = (
        ranked.groupBy("window", "size")
        .agg(F.min(F.struct("seen", "h", "offset", "k")).alias("rarest"))
        .filter("rarest.seen > 0")
        .select("window", "size", "rarest.h", "rarest.offset", "rarest.k")
    )
    candidates = (
        hits.filter("k > 0")
        .join(hint_small(prefix), ["k", "h"])
        .withColumn("start", F.col("pos") - F.col("offset"))
        .filter("start >= 0 AND start + size <= n")
        .groupBy("doc_id", "row_key")
        .agg(F.collect_set(F.struct("start", "size", "window")).alias("found"))
    )
    texts = docs.select("doc_id", F.xxhash64("text").alias("row_key"), "text").filter(F.col("text").isNotNull())
    found = (
        texts.join(candidates.withColumnRenamed("doc_id", "d").withColumnRenamed("row_key", "r"), F.expr("doc_id <=> d AND row_key = r"))
        .select("doc_id", "row_key", words_of("text").alias("w"), "found")
        .select("doc_id", "row_key", F.filter("found", lambda c: F.array_join(F.slice("w", c["start"] + 1, c["size"]), " ") == c["window"]).alias("found"))
        .filter(F.size("found") > 0)
        .dropDuplicates(["doc_id", "row_key"])
    )
    spans = found.select(
        "doc_id", "row_key",
        F.size(F.array_distinct(F.flatten(F.transform("found", lambda c: F.sequence(c["start"], c["start"] + c["size"] - 1))))).cast("long").alias("n_hit"),
        F.array_distinct(F.transform("found", lambda c: c["window"])).alias("windows"),
    )
    owners = windows.select("window", F.col("item_id").cast("string").alias("item_id")).distinct()
    of_doc = (
        spans.select("doc_id", "row_key", "n_hit", F.explode("windows").alias("window"))
        .join(hint_small(owners), "window")
        .groupBy("doc_id", "row_key", "n_hit")
        .agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))
    )
    every = hits.filter("k = 0").select("doc_id", "row_key", F.col("n").cast("long").alias("n_words"))
    none = F.array().cast("array<string>")
    return (
        every.join(of_doc.withColumnRenamed("doc_id", "d").withColumnRenamed("row_key", "r"), F.expr("doc_id <=> d AND row_key = r"), "left")
        .select(
            "doc_id", "row_key", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("item_ids", none).alias("item_ids"),
        )
        .withColumn("n_items", F.size("item_ids").cast("long"))
        .withColumn("contaminated", F.col("n_hit") > 0)
    )


SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
places AS (SELECT doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') AS win
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM win) WHERE len(w) >= size)),
found AS (SELECT doc_id, i, size, item_id FROM places JOIN win USING (size, win)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM found) GROUP BY 1),
own AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM found) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN own USING (doc_id)
"""
