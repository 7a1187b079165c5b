"""Secret scans: candidate strings judged by a random forest, in DataFrame functions and MLlib only.

Candidates are runs of 16 and more token characters inside words, and, at any length, what rules name: values
assigned to password, secret, token or key names (in one word or in the words beside), passwords of URLs, tokens of
parts joined by dots, and PEM blocks of private keys. The forest judges all of them but PEM blocks, which are always
secrets. Short ones are replaced only where they stand alone, not inside longer words. Features of a candidate: length, shares of
digits, capitals and small letters, changes between these classes, hexadecimal and distinct characters, the
share covered by a dictionary (the most frequent short words of all documents), the path it was found in, and
the words beside it. The forest is trained from labelled findings, whose rows have the same context columns;
``generated_findings`` makes a bounded set of them from rules, for corpora that have no reviewed ones.

Documents are read twice: once for word counts and candidates, once to redact. Candidates of a document meet
it again by id; the text is otherwise not shuffled. Null and empty texts have no candidates. Repeated rows and
rows that share an id are redacted alike. Null paths count as empty. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize

LEAST_LENGTH = 16
DICTIONARY_WORDS = 300
TREES, DEPTH = 40, 8
CORE = r"[A-Za-z0-9+/_\-]{16,}"
NAME = r"(?:passw(?:or)?d|passwort|passwd|pwd|passphrase|secret|token|api[_\-]?key|access[_\-]?key|auth[_\-]?key|private[_\-]?key|credentials?)"
#: A value in the word of its name; its end is a quote, a bracket, a separator of parameters or the word's end.
ASSIGNED = rf"""(?i){NAME}[\w\-]*["']?\]?(?:=>|:=|[=:])["']?([^\s"'`,;&<>()\[\]{{}}]+)"""
#: A name and its sign at the end of the words before a value.
ASSIGNS = rf"""(?i){NAME}[\w\-]*["']?\]?\s?(?:=>|:=|[=:])\s?$"""
VALUE = r"""^["']?([^\s"'`,;&<>()\[\]{}]+)"""
CREDENTIAL = r"(?i)(?:[a-z][a-z0-9+.\-]*://[^\s/:@]*|^[\w.\-]+):([^\s/@:][^\s/@]*)@[\w\[]"
DOTTED = r"[A-Za-z0-9+/_\-]{4,}(?:\.[A-Za-z0-9+/_\-]{4,}){2,}"
PEM = r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----[\s\S]+?-----END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----"
KEYWORDS = r"(?i)(passw|pwd|secret|token|api.?key|apikey|auth|bearer|credential|private|access.?key|aws)"
HARMLESS = r"(?i)(commit|sha|md5|hash|checksum|uuid|digest|example|sample|dummy|placeholder|isbn|order|card|phone|page|version)"
TEST_PATH = r"(?i)(test|example|mock|fixture|sample|lock)"
MARK = "[SECRET]"
FEATURES = (
    "size", "digits", "capitals", "smalls", "changes", "hexadecimal", "distinct", "vowels", "covered", "test_path",
    "keyword_before", "keyword_beside", "harmless_beside", "assigned", "quoted", "lead_size",
)


def candidates(docs: DataFrame, path: str = "source") -> DataFrame:
    """``(doc_id, row_key, at, path, word, core, before2, before, after)``: each candidate with its word and neighbours.

    ``row_key`` is a hash of the text, so that rows without an id, or with a shared one, are told apart; ``at`` is the place of the
    word, below 0 for a key block.
    """
    row = [F.col("doc_id"), F.xxhash64("text").alias("row_key"), F.coalesce(F.col(path), F.lit("")).alias("path")]
    # no filter stands over w: Spark would push it below, with the split inside the lambda, once a word
    w = docs.select(*row, F.split("text", r"\s+").alias("w"))
    at = F.sequence(F.lit(0), F.greatest(F.size("w"), F.lit(1)) - 1)
    near = lambda i, d: F.coalesce(F.get("w", i + d), F.lit(""))

    def hit(i: Column) -> Column:
        word, before = F.get("w", i), near(i, -1)
        long = (F.length(word) >= LEAST_LENGTH) & word.rlike(CORE)
        beside = before.rlike("[=:]$") & F.concat(near(i, -2), F.lit(" "), before).rlike(ASSIGNS)
        return long | (word.rlike("[=:.]") & (word.rlike(ASSIGNED) | word.rlike(CREDENTIAL) | word.rlike(DOTTED))) | beside

    hits = F.filter(at, hit)
    spots = F.transform(hits, lambda i: F.struct(i.alias("at"), F.get("w", i).alias("word"), near(i, -2).alias("before2"), near(i, -1).alias("before"), near(i, 1).alias("after")))
    own = ("doc_id", "row_key", "path")
    one = w.select(*own, F.explode_outer(spots).alias("s")).filter("s IS NOT NULL").select(*own, "s.*")
    pem = docs.filter(F.contains("text", F.lit("PRIVATE KEY"))).select(*row, F.posexplode(F.regexp_extract_all("text", F.lit(PEM), F.lit(0))).alias("nth", "core"))
    none = [F.lit("").alias(c) for c in ("before2", "before", "after")]
    return one.select("*", F.explode(cores()).alias("core")).unionByName(pem.select(*own, (-1 - F.col("nth")).alias("at"), F.col("core").alias("word"), *none, "core"))


def cores() -> Column:
    """The candidate strings of a word with its neighbours."""
    every = lambda pattern, group: F.regexp_extract_all("word", F.lit(pattern), F.lit(group))
    beside = F.when(F.concat("before2", F.lit(" "), "before").rlike(ASSIGNS), F.array(F.regexp_extract("word", VALUE, 1))).otherwise(F.array().cast("array<string>"))
    # a run inside a longer candidate that a rule names is a part of it
    ruled = F.filter(F.array_distinct(F.concat(every(ASSIGNED, 1), every(CREDENTIAL, 1), every(DOTTED, 0), beside)), lambda c: c != "")
    return F.array_union(ruled, F.filter(every(CORE, 0), lambda c: ~F.exists(ruled, lambda r: F.contains(r, c))))


def dictionary(docs: DataFrame, words: int = DICTIONARY_WORDS) -> list[str]:
    """The most frequent words of three to six small letters, counted over all documents."""
    w = docs.select(F.explode(F.split("text", r"\s+")).alias("w")).filter(F.length("w").between(3, 6)).filter(F.col("w").rlike("^[a-z]+$"))
    return [r.w for r in w.groupBy("w").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(words).collect()]


def with_features(found: DataFrame, words: list[str]) -> DataFrame:
    core, size = F.col("core"), F.length("core").cast("double")
    count = lambda pattern: F.length(F.regexp_replace(core, pattern, "")).cast("double")
    share = lambda kept: count(f"[^{kept}]") / size
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(core, "[0-9]", "0"), "[A-Z]", "1"), "[a-z]", "2"), r"[+/_\-]", "3")
    runs = F.regexp_replace(classes, r"(.)\1+", "$1")
    covered = 1 - F.length(F.regexp_replace(F.lower(core), "(" + "|".join(sorted(words, key=lambda x: (-len(x), x)) or ["(?!)"]) + ")", "")) / size
    lead = F.expr("substring_index(word, core, 1)")
    flag = lambda c: c.cast("double")
    return found.select(
        "*", size.alias("size"), share("0-9").alias("digits"), share("A-Z").alias("capitals"), share("a-z").alias("smalls"),
        ((F.length(runs) - 1) / size).alias("changes"), share("0-9a-fA-F").alias("hexadecimal"),
        (F.size(F.array_distinct(F.split(core, ""))) / size).alias("distinct"), share("aeiouAEIOU").alias("vowels"), covered.alias("covered"),
        flag(F.col("path").rlike(TEST_PATH)).alias("test_path"), flag(lead.rlike(KEYWORDS)).alias("keyword_before"),
        flag(F.concat_ws(" ", "before2", "before").rlike(KEYWORDS)).alias("keyword_beside"),
        flag(F.concat_ws(" ", "before2", "before", lead, "after").rlike(HARMLESS)).alias("harmless_beside"),
        flag(lead.rlike("[=:]") | F.col("before").rlike("[=:]$")).alias("assigned"), flag(lead.rlike("[\"']$")).alias("quoted"), F.length(lead).cast("double").alias("lead_size"),
    )


def generated_findings(spark: SparkSession, rows: int = 7600) -> DataFrame:
    """Labelled findings from rules: keys, tokens and passwords (1), and what is taken for them (0)."""
    base = spark.range(0, rows, 1, 4).withColumn("kind", (F.col("id") % 19).cast("int")).withColumn("h", F.sha2(F.col("id").cast("string"), 256))
    base = base.withColumn("g", F.sha2(F.concat("h", F.lit("!")), 256))
    # paths of both sorts for both labels
    base = base.withColumn("path", F.element_at(F.array(*map(F.lit, ("", "src/app.py", "tests/test_app.py", "conf/prod.env", "docs/example.md"))), (F.floor(F.col("id") / 19) % 5 + 1).cast("int")))
    upper = F.translate(F.upper("h"), "0123456789", "GHJKLMNPQ7")
    mixed = F.concat(F.substr("h", F.lit(1), F.lit(9)), F.substr(upper, F.lit(10), F.lit(9)), F.substr(F.translate("g", "0a1b", "XzQk"), F.lit(1), F.lit(18)))
    letters = F.translate("h", "0123456789", "inorstlmuv")
    digits = F.translate("h", "abcdef", "123456")
    quote, empty = F.lit('"'), F.lit("")
    part = lambda c, n: F.substr(c, F.lit(1), F.lit(n))
    filler = F.element_at(F.array(*map(F.lit, ("and", "the", "see", "with", "value", "for"))), (F.col("id") % 6 + 1).cast("int"))
    # (label, word, the word before, the one before that)
    kinds: list[tuple[int, Column, Column, Column]] = [
        (1, F.concat(F.lit("AKIA"), part(upper, 16)), filler, filler),
        (1, F.concat(quote, part("h", 40), quote), F.lit("="), F.lit("token")),
        (1, F.concat(F.lit("password="), part("h", 18)), filler, filler),
        (1, F.concat(F.lit("ghp_"), mixed), filler, filler),
        (1, F.concat(F.lit("secret_key='"), mixed, F.lit("/+'")), filler, filler),
        (1, mixed, F.lit("bearer"), F.lit("authorization:")),
        (0, F.concat(F.lit("4"), part(digits, 15)), filler, filler),
        (0, F.concat(F.upper(part(letters, 20)), F.lit("!!")), filler, filler),
        (0, F.concat(part(letters, 10), F.lit("-"), filler, F.lit("-"), F.substr(letters, F.lit(20), F.lit(8))), filler, filler),
        (0, part("h", 40), F.lit("commit"), filler),
        (0, F.concat_ws("-", part("h", 8), part("g", 4), F.substr("h", F.lit(9), F.lit(4)), F.substr("g", F.lit(9), F.lit(4)), F.substr("h", F.lit(20), F.lit(12))), F.lit("uuid"), filler),
        (0, F.when(F.col("id") % 24 < 12, F.repeat(F.lit("-"), (F.col("id") % 40 + 16).cast("int"))).otherwise(F.concat(part(letters, 22), F.lit("."))), filler, empty),
    ]
    # short values with a name, in dots or in a URL, and what stands in such places in prose and tests
    short = F.concat(part(letters, 6), F.substr(digits, F.lit(3), (F.col("id") % 5 + 1).cast("int")), F.when(F.col("id") % 3 == 0, F.lit("!")).otherwise(empty), F.when(F.col("id") % 5 < 2, part(F.upper("g"), 4)).otherwise(empty))
    name = F.element_at(F.array(*map(F.lit, ("password", "secret", "api_key", "token", "db_passwd"))), (F.col("id") % 5 + 1).cast("int"))
    sign = F.when(F.col("id") % 7 < 3, F.lit("=")).otherwise(F.lit(":"))
    plain = F.concat(part(letters, 4), F.substr(letters, F.lit(9), (F.col("id") % 4 + 1).cast("int")))
    tested = F.col("path").rlike(TEST_PATH).cast("int")
    dotted = F.concat(F.lit("eyJ"), part(mixed, 14), F.lit("."), F.substr(mixed, F.lit(10), F.lit(22)), F.lit("."), part(F.reverse(mixed), 18))
    kinds += [
        (1, F.concat(name, sign, short), filler, filler),
        (1, short, F.concat(name, sign), filler),
        (1, F.concat(F.lit("https://user:"), short, F.lit("@host.net/x")), filler, filler),
        (1, dotted, filler, filler),
        (0, plain, F.concat(name, sign), filler),
        (0, F.concat(part(letters, 7), F.lit("."), F.substr(letters, F.lit(11), F.lit(6)), F.lit("."), F.substr(letters, F.lit(21), F.lit(5))), filler, filler),
        (1 - tested, F.concat(name, F.lit("=\""), plain, quote), filler, filler),
    ]
    pick = lambda i: F.element_at(F.array(*(k[i] if isinstance(k[i], Column) else F.lit(k[i]) for k in kinds)), F.col("kind") + 1)
    rows_ = base.select(pick(0).alias("label"), "path", pick(1).alias("word"), pick(3).alias("before2"), pick(2).alias("before"), filler.alias("after"))
    return rows_.withColumn("core", F.get(cores(), F.lit(0))).filter("core <> ''")


def train(findings: DataFrame, words: list[str], trees: int = TREES, depth: int = DEPTH):
    """A random forest over the labelled findings."""
    from pyspark.ml.classification import RandomForestClassifier

    rows = materialize(_vectors(with_features(findings, words)).select("label", "features"), "findings")
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=11, labelCol="label", featuresCol="features").fit(rows)


def _vectors(found: DataFrame) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(found)


def judged(docs: DataFrame, findings: DataFrame | None = None, path: str = "source", threshold: float = 0.5) -> DataFrame:
    """Every candidate with its probability and whether it counts as a secret."""
    from pyspark.ml.functions import vector_to_array

    words = dictionary(docs)
    model = train(findings if findings is not None else generated_findings(docs.sparkSession), words)
    found = _vectors(with_features(materialize(candidates(docs, path), "candidates"), words))
    scored = model.transform(found).withColumn("probability", vector_to_array("probability")[1])
    return scored.select("doc_id", "row_key", "at", "path", "word", "core", "before2", "before", "after", "probability").withColumn("secret", (F.col("probability") >= threshold) | F.startswith("core", F.lit("-----BEGIN ")))


def redacted(docs: DataFrame, findings: DataFrame | None = None, path: str = "source") -> DataFrame:
    """``docs`` with every secret replaced by a mark, and ``n_candidates, n_secrets`` (distinct strings) of each row.

    Columns of ``docs`` that have these two names are replaced. A row is known by its id and text: rows that share or lack an
    id keep their own counts, and repeated rows have equal ones.
    """
    kept = [c for c in docs.columns if c not in ("n_candidates", "n_secrets")]
    # repeated rows give each candidate several times
    once = judged(docs, findings, path).groupBy(F.col("doc_id").alias("__doc"), F.col("row_key").alias("__key"), "at", "core").agg(F.max("secret").alias("secret"))
    per_doc = once.groupBy("__doc", "__key").agg(F.count("*").alias("__candidates"), F.collect_set(F.when(F.col("secret"), F.col("core"))).alias("__secrets"))
    # longer secrets first: one may hold another
    order = F.array_sort("__secrets", lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).when(a < b, -1).when(a > b, 1).otherwise(0))
    # this side grows with the table: never broadcast; texts need no sort
    met = docs.select(*kept).join(per_doc.withColumn("__secrets", order).hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.xxhash64("text") == F.col("__key")), "left").drop("__doc", "__key")
    # a short one only where no letter or digit is beside it
    alone = lambda s: F.concat(F.lit(r"(?<![A-Za-z0-9])\Q"), F.replace(s, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?![A-Za-z0-9])"))
    mark = lambda t, s: F.when(F.length(s) >= LEAST_LENGTH, F.replace(t, s, F.lit(MARK))).otherwise(F.regexp_replace(t, alone(s), F.lit(MARK)))
    text = F.when(F.size("__secrets") > 0, F.aggregate("__secrets", F.col("text"), mark)).otherwise(F.col("text"))
    return met.select(
        *[text.alias("text") if c == "text" else F.col(c) for c in kept],
        F.coalesce("__candidates", F.lit(0)).cast("long").alias("n_candidates"), F.greatest(F.coalesce(F.size("__secrets"), F.lit(0)), F.lit(0)).cast("long").alias("n_secrets"),
    )
