"""A word index that is written once and read by term: postings, terms and totals (SRT-02, SRT-03, STR-10).

``postings (bucket, term, id, n, words)`` has a row for each term of each row, cut by a hash of the term, so that a search
reads the buckets of its own terms; within a bucket, files are shares of the ids sorted by (term, id), so that a term that most
rows hold lies in many files. ``terms (term, docs)`` is sorted by term for prefixes. ``totals (docs, words)`` has one row.
A search joins these tables alone; no text is read. Postings are shuffled once when they are written, and those that a search
meets once when it gathers them by row; all else of a search is done beside these, against the few words that are asked for.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geo import whole
from ..functions.text import fold, words
from ..sources.shared import written

BUCKETS = 256
#: Files of a bucket.
SHARES = 8
#: Words or slots that every task may hold; more words are merged, more slots taken in several passes.
FEW_SLOTS = 200_000
#: Fixed values of the rank: saturation of repeats, and the weight of a word that half of all rows hold.
K1 = 1.2
LEAST_IDF = 1e-6


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def write_index(rows: DataFrame, path: str, id_col: str, text_col: str, buckets: int = BUCKETS) -> None:
    """Index ``rows``; ids are unique. A null id or text, or one without words, has no postings, but counts as a row if it has an id."""
    cut = rows.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), words(fold(F.coalesce(text_col, F.lit("")))).alias("terms"))
    cut.agg(F.count("*").alias("docs"), F.coalesce(F.sum(F.size("terms")), F.lit(0)).cast("long").alias("words")).coalesce(1).write.parquet(f"{path}/totals")
    # a row's terms are counted where it is: each run of equal ones among the sorted terms ends where the next differs
    lined = cut.filter(F.size("terms") > 0).select("id", F.size("terms").alias("words"), F.array_sort("terms").alias("s"))
    at = lambda i: F.get("s", i)
    lined = lined.withColumn("ends", F.filter(F.sequence(F.lit(0), F.col("words") - 1), lambda i: (i + 1 == F.col("words")) | (at(i) != at(i + 1))))
    run = lambda i, k: F.struct(at(i).alias("term"), (i - F.when(k > 0, F.get("ends", k - 1)).otherwise(-1)).cast("int").alias("n"))
    counted = lined.select("id", "words", F.explode(F.transform("ends", run)).alias("t")).select("t.term", "id", "t.n", "words")
    bucket = _bucket(F.col("term"), buckets)
    dealt = counted.repartition(bucket, F.pmod(F.xxhash64("id"), F.lit(SHARES))).withColumn("bucket", bucket)
    dealt.sortWithinPartitions("bucket", "term", "id").select("term", "id", "n", "words", "bucket").write.partitionBy("bucket").parquet(f"{path}/postings")
    stored = rows.sparkSession.read.parquet(f"{path}/postings")
    stored.groupBy("term").agg(F.count("*").alias("docs")).repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{path}/terms")


def slots(queries: DataFrame, last_is_prefix: bool = True) -> DataFrame:
    """``(query_id, slot, word, prefix)`` of ``queries (query_id, text)``: every word must be met, the last one by any word that it begins (STR-10)."""
    cut = queries.select("query_id", words(fold(F.col("text"))).alias("terms"))
    return cut.select("query_id", F.posexplode("terms").alias("slot", "word"), F.size("terms").alias("n")).select(
        "query_id", "slot", "word", ((F.col("slot") + 1 == F.col("n")) & F.lit(last_is_prefix)).alias("prefix")
    )


def _asked_for(rows: DataFrame, wanted: DataFrame, lengths: list[int]) -> DataFrame:
    """``rows (term, ...)`` with the ``wanted (word, prefix, w)`` that each term is or, for prefixes of these lengths, begins with."""
    begun = [F.when(F.length("term") >= n, F.struct(F.left("term", F.lit(n)).alias("word"), F.lit(True).alias("prefix"))) for n in lengths]
    forms = F.array(F.struct(F.col("term").alias("word"), F.lit(False).alias("prefix")), *begun)
    return rows.withColumn("form", F.explode(forms)).withColumns({"word": F.col("form.word"), "prefix": F.col("form.prefix")}).drop("form").join(wanted, ["word", "prefix"])


def search_index(spark: SparkSession, path: str, queries: DataFrame, b: float = 0.0, last_is_prefix: bool = True, buckets: int = BUCKETS) -> DataFrame:
    """``(query_id, id, words, rank_e6)`` of the rows that hold all words of a query; the greater the rank, the better.

    The rank is BM25 in millionths, with the row's length weighed by ``b`` (0: not at all). A query begins with its rarest
    word; its other words are looked up for those rows only. A query without words finds nothing.
    """
    asked = slots(queries, last_is_prefix)
    distinct = written(asked.select("word", "prefix").distinct().withColumn("w", F.monotonically_increasing_id()), "asked-words")
    wanted = distinct.hint("broadcast" if distinct.count() <= FEW_SLOTS else "merge")
    lengths = [n for (n,) in distinct.filter("prefix").select(F.length("word")).distinct().collect()]
    terms = _asked_for(spark.read.parquet(f"{path}/terms"), wanted, lengths).select("term")
    read = [k for (k,) in terms.select(_bucket(F.col("term"), buckets)).distinct().collect()]
    postings = spark.read.parquet(f"{path}/postings").filter(F.col("bucket").isin(read))
    raw = _asked_for(postings.select("term", "id", "n", "words"), wanted, lengths).select("id", "w", "n", "words").repartition("id")
    # a row to itself with all its words that are asked for
    held = raw.groupBy("id", "w").agg(F.sum("n").alias("n"), F.first("words").alias("words")).groupBy("id").agg(F.collect_list(F.struct("w", "n", "words")).alias("hits"))
    docs = held.select(F.explode("hits.w").alias("w")).groupBy("w").agg(F.count("*").alias("docs"))
    totals = F.broadcast(spark.read.parquet(f"{path}/totals").select(F.col("docs").alias("total"), (F.col("words") / F.col("docs")).alias("mean")))  # one row
    weighed = asked.join(wanted, ["word", "prefix"]).join(docs, "w", "left").crossJoin(totals)
    idf = F.ln((F.col("total") - F.col("docs") + 0.5) / (F.col("docs") + 0.5))
    weighed = weighed.select("query_id", "slot", "w", "docs", "mean", F.when(idf > 0, idf).otherwise(LEAST_IDF).alias("idf"))
    # a query with a word that no row holds finds nothing
    ready = weighed.groupBy("query_id").agg(
        F.min(F.struct("docs", "slot", "w")).alias("rarest"), F.collect_list(F.struct("w", "idf")).alias("slots"), F.first("mean").alias("mean"), F.count("*").alias("n"), F.count("docs").alias("met")
    ).filter("met = n").select("query_id", "slots", "mean", F.col("rarest.w").alias("w"))
    each = held.select("id", F.map_from_arrays("hits.w", "hits.n").alias("ns"), F.explode("hits").alias("hit")).select("id", "ns", "hit.w", "hit.words")
    norm = 1 - b + b * F.col("words") / F.col("mean")

    def score(slot: Column) -> Column:
        n = F.try_element_at("ns", slot["w"])
        # whole millionths of each word, so that the sum does not depend on its order; null without the word
        return whole(slot["idf"] * n * (K1 + 1) / (n + K1 * norm), 1e6)

    found = []
    passes = max(1, -(-asked.count() // FEW_SLOTS))
    for k in range(passes):
        own = ready.filter(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == k) if passes > 1 else ready
        rank = F.aggregate("slots", F.lit(0).cast("long"), lambda sum_, slot: sum_ + score(slot))
        found.append(each.join(F.broadcast(own), "w").select("query_id", "id", "words", rank.alias("rank_e6")).filter("rank_e6 IS NOT NULL"))
    return reduce(DataFrame.unionByName, found)


def best(found: DataFrame, *order, limit: int = 60) -> DataFrame:
    """The first ``limit`` rows of each query by rank, then ``order``, with their ``place`` from 1 (SRT-02, SRT-03)."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rank_e6"), *order))
    return found.withColumn("place", place).filter(F.col("place") <= limit)
