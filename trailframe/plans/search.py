"""Queries of the word index and of typed words, named by their number, with SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import queries as read
from ..functions import translit as latin
from ..functions.text import FROM, TO, WORD, fold, words
from ..operators import postings, typos
from ..sources.adapters import table
from ..sources.shared import new_path



def _words(text: str) -> str:
    return f"regexp_extract_all(translate(lower({text}), '{FROM}', '{TO}'), '{WORD}')"


def _vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "documents").select(F.explode(F.array_distinct(words(fold(F.col("text"))))).alias("term"))
    return held.groupBy("term").agg(F.count("*").alias("docs"))


#: A word with its second and third letters swapped, without its second, with its third twice, with an x for its third, with its last letters swapped and its second gone.
_MISTYPED = (
    "concat(left(w, 1), substr(w, 3, 1), substr(w, 2, 1), substr(w, 4))", "concat(left(w, 1), substr(w, 3))", "concat(left(w, 3), substr(w, 3))",
    "concat(left(w, 2), 'x', substr(w, 4))", "concat(left(w, 1), substr(w, 3, length(w) - 4), right(w, 1), substr(w, length(w) - 1, 1))",
)


def srt_10_typos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of ``benchmark`` mistyped in five ways, against all words of ``documents``."""
    held = table(spark, sf_dir, "benchmark").select(F.explode(F.array_distinct(words(fold(F.col("text"))))).alias("w")).filter("length(w) >= 4").distinct()
    typed = held.select(F.explode(F.array(*map(F.expr, _MISTYPED))).alias("word"))
    return typos.typo_candidates(typed, _vocabulary(spark, sf_dir)).select("word", "term", "docs", "distance", "place")


def srt_02_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three queries an item of ``benchmark``, of three words each, the last one half typed: the 60 best documents of each."""
    path = new_path(spark, "postings")
    docs = table(spark, sf_dir, "documents")
    postings.write_index(docs, path, "doc_id", "text")
    items = table(spark, sf_dir, "benchmark").select("item_id", words(fold(F.col("text"))).alias("w")).withColumn("k", F.explode(F.array(F.lit(1), F.lit(3), F.lit(5))))
    at = lambda i: F.try_element_at("w", F.col("k") + i)
    text = F.concat_ws(" ", at(0), at(1), F.left(at(2), F.lit(2)))
    asked = items.select(F.concat_ws("-", "item_id", "k").alias("query_id"), text.alias("text"))
    found = postings.search_index(spark, path, asked, b=0.75)
    return postings.best(found, "words", "id").select("query_id", "place", F.col("id").alias("doc_id"), "words", "rank_e6")


def srt_03_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts by half-typed queries: rank, then length of the name, then size, then distance from the asker, then id."""
    path = new_path(spark, "postings")
    parts = table(spark, sf_dir, "part")
    postings.write_index(parts, path, "p_partkey", "p_name")
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("query_id"), (F.col("n_nationkey") * 80).alias("at"))
    asked = nations.withColumn("text", F.element_at(F.array(*map(F.lit, ("blue b", "ring", "red WIDGET", "smäll ri", "b", "green small", "gizmo", ""))), F.col("query_id") % 8 + 1))
    found = postings.search_index(spark, path, asked).join(parts, F.col("id") == F.col("p_partkey")).join(nations, "query_id")
    away = F.abs(F.col("p_partkey") - F.col("at"))
    ranked = postings.best(found.withColumn("away", away), F.length("p_name"), F.desc("p_size"), "away", "id")
    return ranked.select("query_id", "place", "p_partkey", "p_name", "rank_e6", "away")


#: What a rider may type for a part: numbers, ordinals, postcodes and suffixes at all places.
_TYPED = """SELECT p_partkey AS id, CASE p_partkey % 13 WHEN 0 THEN concat('12 ', p_name) WHEN 1 THEN concat(p_name, ' 12a') WHEN 2 THEN concat('400w 42nd ', p_name) WHEN 3 THEN concat('1012 AB ', p_name, ' 7')
  WHEN 4 THEN concat(p_name, ', ', p_size, ' bis') WHEN 5 THEN concat('92-10; ', p_name) WHEN 6 THEN concat('12345 ', p_name) WHEN 7 THEN concat('5e ', p_name, ' 3/B') WHEN 8 THEN '12' WHEN 9 THEN concat(p_name, ' 70 71')
  WHEN 10 THEN concat(p_size, 'west ', p_name) WHEN 11 THEN concat(p_name, ' 1. 2º c') ELSE concat(p_name, ' a b c d e f g h') END AS text FROM {rows}"""


def str_09_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(_TYPED, rows=table(spark, sf_dir, "part")).withColumn("t", read.tokens(F.col("text")))
    return rows.select("id", read.parsed(F.col("t")).alias("p")).select("id", F.array_join("p.words", "|").alias("words"), "p.house_number", "p.number")


_ABC = "abcdefghijklmnopqrstuvwxyz"
#: Names of parts in Bulgarian, Ukrainian and Greek letters.
_FOREIGN = f"""SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN translate(p_name, '{_ABC}', 'абцдефгхийклмнопярстувщшъз') WHEN 1 THEN concat(translate(p_name, '{_ABC}', 'абцдефгґиїклмнопярстувєшьх'), ' І')
  ELSE concat('Μπαρ ', translate(p_name, '{_ABC}', 'αβχδεφγηιξκλμνοπθρστυωψζύς'), ' ουζο') END AS name FROM {{rows}}"""


def str_03_latin(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(_FOREIGN, rows=table(spark, sf_dir, "part"))
    return rows.select("id", latin.translit(F.col("name")).alias("latin"), latin.index_text(F.col("name")).alias("held"))


def srt_04_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as places of several kinds, scored and ranked in their nation; ten thousandths."""
    rows = table(spark, sf_dir, "customer").select(
        "c_custkey", "c_nationkey", (F.col("c_custkey") % 11 / 10).alias("q"), (F.col("c_custkey") % 3).alias("r"), F.when(F.col("c_custkey") % 5 > 0, F.col("c_custkey") % 64 + 0.0).alias("km"),
        F.get(F.array(*map(F.lit, ("city", "town", "village", "hamlet", "isle"))), (F.col("c_custkey") % 7).cast("int")).alias("kind"),
        (F.col("c_custkey") * 37).alias("people"), (F.col("c_custkey") % 40).alias("fame"), (F.col("c_custkey") % 9 == 0).alias("address"),
    )
    score = latin.place_score(*map(F.col, ("q", "r", "km", "kind", "people", "fame", "address")))
    return rows.select("c_custkey", "c_nationkey", F.floor(score * 10000 + 0.5).cast("long").alias("score"))


QUERIES = {f.__name__: f for f in (str_03_latin, srt_04_scores, str_09_parsed, srt_10_typos, srt_02_ranked, srt_03_ordered)}


def _ranked_sql(rows: str, queries: str, b: str, tail: str) -> str:
    """BM25 of ``rows (id, text)`` for ``queries (query_id, text)``."""
    return f"""WITH d AS (SELECT id, {_words("coalesce(text, '')")} AS ws FROM ({rows})), t AS (SELECT count(*) AS total, sum(len(ws)) / count(*) AS mean FROM d),
      q AS (SELECT query_id, {_words('text')} AS qs FROM ({queries})),
      s AS (SELECT query_id, i AS slot, len(qs) AS slots, qs[i] AS word, i = len(qs) AS prefix FROM (SELECT *, unnest(range(1, len(qs) + 1)) AS i FROM q)),
      w AS (SELECT id, len(ws) AS words, unnest(ws) AS term FROM d),
      h AS (SELECT query_id, slot, slots, id, words, count(*) AS n FROM s JOIN w ON CASE WHEN prefix THEN starts_with(term, word) ELSE term = word END GROUP BY ALL),
      f AS (SELECT *, count(*) OVER (PARTITION BY query_id, slot) AS docs FROM h),
      x AS (SELECT *, CASE WHEN ln((total - docs + 0.5::DOUBLE) / (docs + 0.5::DOUBLE)) > 0 THEN ln((total - docs + 0.5::DOUBLE) / (docs + 0.5::DOUBLE)) ELSE 1e-6::DOUBLE END AS idf FROM f, t),
      r AS (SELECT query_id, id, any_value(words)::INT AS words, sum(CAST(floor(idf * n * 2.2::DOUBLE / (n + 1.2::DOUBLE * (1 - {b} + {b} * words / mean)) * 1e6::DOUBLE + 0.5) AS BIGINT))::BIGINT AS rank_e6 FROM x GROUP BY query_id, id HAVING count(*) = any_value(slots))
      {tail}"""


def _matches(token: str, pattern: str) -> str:
    return f"regexp_matches({token}, '{pattern}')"


_IS_WORD = f"({_matches('t', read.ORDINAL)} OR ({_matches('t', chr(92) + 'p{L}')} AND NOT {_matches('t', read.HOUSE)} AND NOT {_matches('t', read.SUFFIX)}))"
def _replaced(text: str, starts: dict[str, str], groups: dict[str, str], letters: dict[str, str]) -> str:
    for k, v in starts.items():
        text = f"regexp_replace({text}, '(^|[^{chr(92)}p{{L}}]){k}', '{chr(92)}1{v}', 'g')"
    for k, v in {**groups, **letters}.items():
        text = f"replace({text}, '{k}', '{v}')"
    return text


_LATIN = _replaced("lower(name)", latin.STARTS, latin.DIGRAPHS, latin.LETTERS)
_SECOND = _replaced(_replaced("lower(name)", latin.STARTS_UK, {}, latin.LETTERS_UK), latin.STARTS, latin.DIGRAPHS, latin.LETTERS)
ORACLE = {
    "str_03_latin": f"""WITH t AS ({_FOREIGN.replace('{rows}', 'part')}), l AS (SELECT id, name, {_LATIN} AS latin, {_SECOND} AS second FROM t),
      w AS (SELECT *, list_distinct(list_filter(regexp_extract_all(second, '{WORD}'), lambda x: NOT list_contains(regexp_extract_all(latin, '{WORD}'), x))) AS extra, regexp_extract_all(second, '{WORD}') AS ordered FROM l)
      SELECT id, latin, CASE WHEN regexp_matches(name, '{latin.ONLY_UKRAINIAN}') AND len(extra) > 0 THEN latin || ' ' || array_to_string(list_filter(list_transform(range(1, len(ordered) + 1), lambda i: CASE WHEN list_contains(extra, ordered[i]) AND list_position(ordered, ordered[i]) = i THEN ordered[i] END), lambda x: x IS NOT NULL), ' ') ELSE latin END AS held FROM w""",
    "srt_04_scores": """WITH t AS (SELECT c_custkey, c_nationkey, c_custkey % 11 / 10::DOUBLE AS q, c_custkey % 3 AS r, CASE WHEN c_custkey % 5 > 0 THEN c_custkey % 64 END AS km, ['city', 'town', 'village', 'hamlet', 'isle'][c_custkey % 7 + 1] AS kind, c_custkey * 37 AS people, c_custkey % 40 AS fame FROM customer)
      SELECT c_custkey, c_nationkey, CAST(floor((q - r * 0.001::DOUBLE - coalesce(0.06::DOUBLE * log2(1 + km), 0) + CASE kind WHEN 'city' THEN 0.1::DOUBLE WHEN 'town' THEN 0.07::DOUBLE WHEN 'village' THEN 0.04::DOUBLE WHEN 'hamlet' THEN 0.01::DOUBLE ELSE 0 END
        + CASE WHEN kind IS NULL THEN 0 ELSE least(0.1::DOUBLE, 0.015::DOUBLE * log10(1 + people)) END + CASE WHEN fame > 5 THEN least(0.25::DOUBLE, 0.04::DOUBLE * log2(fame - 4)) ELSE 0 END + CASE WHEN c_custkey % 9 = 0 THEN 0.25::DOUBLE ELSE 0 END) * 10000 + 0.5) AS BIGINT) AS score FROM t""",
    "str_09_parsed": f"""WITH RECURSIVE q AS ({_TYPED.replace('{rows}', 'part')}),
      a AS (SELECT id, unnest(list_filter(regexp_split_to_array(text, '{read.APART}'), lambda t: t <> '')) AS t, generate_subscripts(list_filter(regexp_split_to_array(text, '{read.APART}'), lambda t: t <> ''), 1) AS i FROM q),
      g AS (SELECT id, i, unnest(CASE WHEN {_matches('t', read.GLUED)} AND NOT {_matches('t', read.ORDINAL)} THEN [regexp_extract(t, '{read.GLUED}', 1), regexp_extract(t, '{read.GLUED}', 2)] ELSE [t] END) AS t, unnest(CASE WHEN {_matches('t', read.GLUED)} AND NOT {_matches('t', read.ORDINAL)} THEN [1, 2] ELSE [1] END) AS j FROM a),
      n AS (SELECT id, t, row_number() OVER w AS k, lead(t) OVER w AS t2, lag(t) OVER w AS t0, bool_or({_IS_WORD}) OVER (PARTITION BY id) AS named FROM g WINDOW w AS (PARTITION BY id ORDER BY i, j)),
      f AS (SELECT *, coalesce({_matches('t', read.FOUR)} AND {_matches('t2', read.TWO)}, false) OR coalesce({_matches('t0', read.FOUR)} AND {_matches('t', read.TWO)}, false) AS dutch, coalesce({_matches('t', read.PLAIN)} AND {_matches('t2', read.SUFFIX)}, false) AS suffixed,
        {_matches('t', read.HOUSE)} AND NOT {_matches('t', read.ORDINAL)} AS house_like, {_matches('t', read.POSTCODE)} AS long FROM n),
      r AS (SELECT id, 0::BIGINT AS k, []::VARCHAR[] AS words, NULL::VARCHAR AS house, NULL::INT AS number, false AS skip FROM q
        UNION ALL
        SELECT f.id, f.k, CASE WHEN skip OR named AND (dutch OR house IS NULL AND house_like OR long) THEN words ELSE list_concat(words, regexp_extract_all(t, '{WORD}')) END,
          CASE WHEN NOT skip AND named AND NOT dutch AND house IS NULL AND house_like THEN CASE WHEN suffixed THEN t || ' ' || t2 ELSE t END ELSE house END,
          CASE WHEN NOT skip AND named AND NOT dutch AND house IS NULL AND house_like THEN regexp_extract(t, '{read.HOUSE}', 1)::INT ELSE number END,
          NOT skip AND named AND NOT dutch AND house IS NULL AND house_like AND suffixed FROM r JOIN f ON f.id = r.id AND f.k = r.k + 1)
      SELECT id, array_to_string(arg_max(words, k)[1:8], '|') AS words, arg_max(struct_pack(h := house), k).h AS house_number, arg_max(struct_pack(h := number), k).h AS number FROM r GROUP BY id""",
    "srt_10_typos": f"""WITH RECURSIVE v AS (SELECT term, count(*) AS docs FROM (SELECT unnest(list_distinct({_words('text')})) AS term FROM documents) GROUP BY term),
      b AS (SELECT DISTINCT w FROM (SELECT unnest({_words('text')}) AS w FROM benchmark) WHERE length(w) >= 4),
      q AS (SELECT DISTINCT word, CASE WHEN length(word) < 4 THEN 0 WHEN length(word) <= 5 THEN 1 ELSE 2 END AS edits FROM (SELECT unnest([{', '.join(_MISTYPED)}]) AS word FROM b)),
      m AS (SELECT word, edits, term, docs FROM q JOIN v ON left(term, 1) = left(word, 1) WHERE edits > 0 AND abs(length(term) - length(word)) <= edits
        UNION ALL SELECT word, edits, term, docs FROM q JOIN v ON left(term, 2) = concat(word[2], word[1]) WHERE edits > 0 AND word[1] <> word[2] AND abs(length(term) - length(word)) <= edits),
      n AS (SELECT * FROM m WHERE word <> term AND damerau_levenshtein(translate(word, 'ßæœ', 'SEO'), translate(term, 'ßæœ', 'SEO')) <= edits),
      o AS (SELECT word, term, 0 AS i, []::BIGINT[] AS before, range(0, length(term) + 1) AS prev FROM n
        UNION ALL
        SELECT word, term, i + 1, prev, list_transform(range(0, length(term) + 1), lambda j: j + list_min(list_transform(range(0, j + 1), lambda k:
          CASE WHEN k = 0 THEN i + 1 ELSE least(prev[k + 1] + 1, prev[k] + (word[i + 1] <> term[k])::INT, CASE WHEN i >= 1 AND k >= 2 AND word[i + 1] = term[k - 1] AND word[i] = term[k] THEN before[k - 1] + 1 ELSE 1000 END) END - k)))
        FROM o WHERE i < length(word)),
      e AS (SELECT n.*, prev[length(n.term) + 1] AS distance FROM n JOIN o ON o.word = n.word AND o.term = n.term AND o.i = length(n.word)),
      c AS (SELECT *, left(term, 2) IN (concat(word[1], word[2]), concat(word[2], word[1]), concat(word[1], word[3])) AS close FROM e WHERE distance <= edits),
      g AS (SELECT *, bool_or(close AND distance <= 1) OVER (PARTITION BY word) AS found FROM c)
      SELECT word, term, docs, distance::INT AS distance, row_number() OVER (PARTITION BY word ORDER BY distance, docs DESC, term)::INT AS place
      FROM g WHERE close OR (left(term, 1) = left(word, 1) AND NOT found) QUALIFY place <= 5""",
    "srt_02_ranked": _ranked_sql(
        "SELECT doc_id AS id, text FROM documents",
        f"SELECT concat_ws('-', item_id, k) AS query_id, concat_ws(' ', w[k], w[k + 1], left(w[k + 2], 2)) AS text FROM (SELECT item_id, {_words('text')} AS w, unnest([1, 3, 5]) AS k FROM benchmark)",
        "0.75::DOUBLE",
        "SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank_e6 DESC, words, id)::INT AS place, id AS doc_id, words, rank_e6 FROM r QUALIFY place <= 60",
    ),
    "srt_03_ordered": _ranked_sql(
        "SELECT p_partkey AS id, p_name AS text FROM part",
        "SELECT n_nationkey AS query_id, ['blue b', 'ring', 'red WIDGET', 'smäll ri', 'b', 'green small', 'gizmo', ''][n_nationkey % 8 + 1] AS text FROM nation",
        "0",
        """SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank_e6 DESC, length(p_name), p_size DESC, abs(p_partkey - query_id * 80), id)::INT AS place, p_partkey, p_name, rank_e6,
          abs(p_partkey - query_id * 80) AS away FROM r JOIN part ON p_partkey = id QUALIFY place <= 60""",
    ),
}
