"""WARC archives: writing records with revisits, and reading them back by verifying the chain of boundaries.

Writing uses Spark's text sink with the record separator as line separator, so every task writes whole
records of its own to any file system that Spark can write.

Reading splits the files at ``CRLF CRLF WARC/``. That sequence may also stand in a payload, so a piece is only
a candidate: its header gives the offset of its successor. Offsets come from a running sum of piece lengths
in each file (lengths only, no payload). Candidates whose successor is the next candidate are joined to
segments; pointer jumping over segments, from the start of each file, doubles the reach each round and
retains the records that the chain really visits. Payloads that hold the separator are put together again
from their pieces.

Equal payloads of at least ``least_bytes`` are written once: the record with the largest page id is the
response, others revisit it. Payload counts are combined map-side. A null payload is empty, a null url has no
target URI, a null page id no record id (such a record is a response). Rows that repeat the largest id are
responses too. An empty table gives no records.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, hint_small, materialize

CRLF = "\r\n"
BREAK = CRLF + CRLF
SEPARATOR = BREAK + "WARC/"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(col: Column) -> Column:
    """SHA-1 in upper-case base32: 20 bits, five hex digits, at a time."""
    digits = F.sha1(col)
    groups = [F.lpad(F.conv(F.substring(digits, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*groups)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def with_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Adds payload, payload_bytes, payload_digest and refers_to (null for responses).

    Only the digests of two and more pages are joined with the payloads, broadcast where they are proved small.
    """
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"))
    p = p.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", base32_sha1(F.col("payload").cast("binary")))
    equal = p.filter(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
    first = materialize(equal.filter("n > 1 AND first IS NOT NULL").drop("n"), "equal-payloads")
    p = p.join(hint_small(first), ["payload_digest", "payload_bytes"], "left")
    return p.withColumn("refers_to", F.when(F.col("page_id") != F.col("first"), F.col("first"))).drop("first")


def record_text(date: str) -> Column:
    """The record of a row of ``with_revisits``, without the closing blank lines."""
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(BREAK))
    block = F.when(revisit, http).otherwise(F.concat(http, "payload"))
    url = F.regexp_replace("url", r"[\r\n]", "%0A")
    head = F.concat_ws(
        CRLF,
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.col("page_id").cast("string"), F.lit(">")),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), "payload_digest"),
        F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">")),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    )
    return F.concat(head, F.lit(BREAK), block)


def write_archive(pages: DataFrame, path: str, least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """One WARC file a task in ``path``."""
    with_revisits(pages, least_bytes).select(record_text(date).alias("value")).write.option("lineSep", BREAK).text(path)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """Pieces between separators, numbered in file order; ``lead`` is the magic that the split took away."""
    raw = spark.read.option("lineSep", SEPARATOR).text(path)
    raw = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    return raw.withColumn("bytes", F.octet_length("value").cast("long"))


def _parsed(pieces: DataFrame) -> DataFrame:
    """Header and, where the piece may be the whole record, digest and length of the payload."""
    head = F.substring_index("value", BREAK, 1)
    p = pieces.withColumn("head", head).withColumn("head_bytes", F.octet_length("head").cast("long"))
    field = lambda name: F.nullif(F.regexp_extract("head", rf"(?i)\r\n{name}:[ \t]*([^\r\n]*)", 1), F.lit(""))
    p = p.withColumn("content", F.try_to_number(F.nullif(F.regexp_extract("head", r"(?i)\r\nContent-Length:[ \t]*(\d{1,18})[ \t]*(?:\r\n|$)", 1), F.lit("")), F.lit("999999999999999999")).cast("long"))
    block = F.substr(F.col("value").cast("binary"), (F.col("head_bytes") + 5).cast("int"))
    p = p.withColumn("body", block)
    return p.select(
        "file", "block", "at", "bytes", "head_bytes", "content", F.col("head").rlike(r"^(WARC/)?1\.[01]\r\n").alias("magic"),
        field("WARC-Type").alias("record_type"), field("WARC-Record-ID").alias("record_id"), field("WARC-Target-URI").alias("target_uri"),
        field("WARC-Refers-To").alias("refers"), field("WARC-Payload-Digest").alias("stated_digest"),
        (F.length("body") >= F.col("content")).alias("whole"), F.substr("body", F.lit(1), F.col("content").cast("int")).alias("body"),
    )


def _with_payload(records: DataFrame) -> DataFrame:
    """Payload facts of records whose block is in ``body``: HTTP length, digest of the bytes after the HTTP head."""
    http = F.substring_index(F.col("body").cast("string"), BREAK, 1)
    r = records.withColumn("http", http)
    payload = F.substr(F.col("body"), (F.octet_length("http") + 5).cast("int"))
    stated = F.regexp_replace("stated_digest", "^sha1:", "")
    return (
        r.withColumn("payload", payload)
        .withColumn("payload_bytes", F.try_to_number(F.nullif(F.regexp_extract("http", r"(?i)\r\nContent-Length:[ \t]*(\d{1,18})", 1), F.lit("")), F.lit("999999999999999999")).cast("long"))
        .withColumn("payload_digest", F.when(F.col("record_type") == "revisit", stated).otherwise(base32_sha1(F.col("payload"))))
        .withColumn("stated_digest", stated)
        .drop("http", "body")
    )


def reachable(candidates: DataFrame) -> DataFrame:
    """Candidates ``(file, start, next, ...)`` that the chain from the start of their file visits."""
    w = Window.partitionBy("file").orderBy("start")
    c = candidates.withColumn("broken", F.coalesce(F.lag("next").over(w) != F.col("start"), F.lit(True)))
    c = c.withColumn("leaves", F.coalesce(F.lead("broken").over(w), F.lit(True)))
    targets = c.filter("leaves").select("file", F.col("next").alias("start"), F.lit(True).alias("entered")).distinct()
    c = c.join(targets, ["file", "start"], "left")
    c = c.withColumn("segment", F.max(F.when(F.col("broken") | F.coalesce("entered", F.lit(False)), F.col("start"))).over(w))
    c = materialize(c.drop("broken", "leaves", "entered"), "candidates")

    jump = materialize(c.groupBy("file", "segment").agg(F.max_by("next", "start").alias("next")), "jumps")
    reach = materialize(jump.filter("segment = 0").select("file", "segment"), "reach")
    while True:
        step = reach.join(jump, ["file", "segment"]).select("file", F.col("next").alias("segment"))
        grown = materialize(reach.union(step).distinct().join(jump.select("file", "segment"), ["file", "segment"], "left_semi"), "reach")
        if grown.count() == reach.count():
            discard(jump, reach)
            chain = materialize(c.join(grown, ["file", "segment"], "left_semi"), "chain")
            discard(c, grown)
            return chain
        further = jump.select(F.col("file"), F.col("segment").alias("next"), F.col("next").alias("beyond"))
        doubled = materialize(jump.join(further, ["file", "next"], "left").select("file", "segment", F.coalesce("beyond", "next").alias("next")), "jumps")
        discard(jump, reach)
        jump, reach = doubled, grown


def read_archive(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records of the archives in ``path``: type, ids, target URI, payload length and digest[, payload]."""
    parsed = _with_payload(_parsed(_pieces(spark, path)))
    facts = parsed.drop("payload") if not payloads else parsed
    light = materialize(facts.drop("payload"), "pieces")
    w = Window.partitionBy("file").orderBy("block", "at")
    # a piece after the first begins behind the five bytes of its magic
    before = F.coalesce(F.sum(F.col("bytes") + len(SEPARATOR)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = light.withColumn("begin", before).withColumn("start", F.greatest(F.col("begin") - 5, F.lit(0)))
    placed = placed.withColumn("next", F.col("begin") + F.col("head_bytes") + 4 + F.col("content") + 4)
    candidates = placed.filter(F.col("magic") & F.col("content").isNotNull())
    chain = reachable(candidates)
    whole = chain.filter("whole")
    split = chain.filter("NOT whole")
    columns = ["file", "start", "record_type", "record_id", "target_uri", "refers", "stated_digest", "payload_bytes", "payload_digest"]
    if payloads:
        body = parsed.select("file", "block", "at", "payload")
        whole = whole.join(body, ["file", "block", "at"])
        columns.append("payload")
    parts = [whole.select(*columns)]
    if split.limit(1).count():
        parts.append(_joined(spark, path, placed, split).select(*columns))
    return reduce(DataFrame.unionByName, parts)


def _joined(spark: SparkSession, path: str, placed: DataFrame, split: DataFrame) -> DataFrame:
    """Records whose block holds the separator, from all pieces between their start and their successor."""
    spans = split.select("file", F.col("start").alias("first"), F.col("next").alias("end"))
    inner = placed.select("file", "block", "at", "begin").join(spans, "file").filter("begin >= first AND begin < end").select("file", "block", "at", "begin", "first")
    texts = _pieces(spark, path).select("file", "block", "at", F.col("value").cast("binary").alias("value")).join(inner, ["file", "block", "at"])
    whole = texts.groupBy("file", F.col("first").alias("start")).agg(F.sort_array(F.collect_list(F.struct("begin", "value"))).alias("parts"))
    text = F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["value"])), SEPARATOR.encode().hex()))
    records = split.drop("payload_bytes", "payload_digest").join(whole.withColumn("text", text).drop("parts"), ["file", "start"])
    body = F.substr("text", (F.col("head_bytes") + 5).cast("int"), F.col("content").cast("int"))
    return _with_payload(records.withColumn("body", body))


SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, upper(sha1(html)) AS hex FROM p),
b AS (SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, list_transform(range(0, 32), lambda i:
  list_reduce(list_transform(range(0, 5), lambda k: CAST(strpos('0123456789ABCDEF', hex[1 + (5 * i + k) // 4]) - 1 AS BIGINT) // CAST(pow(2, 3 - (5 * i + k) % 4) AS BIGINT) % 2), lambda x, y: 2 * x + y)) AS five FROM d),
e AS (SELECT page_id, payload_bytes, array_to_string(list_transform(five, lambda v: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[v + 1]), '') AS payload_digest FROM b)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id = max(page_id) OVER (PARTITION BY payload_digest) THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> max(page_id) OVER (PARTITION BY payload_digest) THEN max(page_id) OVER (PARTITION BY payload_digest) END AS refers_to
FROM e
"""
