"""The registered corpus queries: each applies one operator, with production parameters, to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, decontam, filter_audit, jaccard, prefix_trie, rans, secrets, suffixes, token_counts, toxicity, urls, warc
from .common import scratch_path, table

END_ID = 2
TOKEN_LIMIT = 1024
URL_RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def op2_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a label says whether the page of its number was good
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), (1 - F.col("quality")).alias("bad"))
    judged = urls.judged(table(spark, sf_dir, "pages"), outcomes, URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op3_toxicity_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, toxicity.severity_grades(table(spark, sf_dir, "labels"))))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.redacted(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_candidates", "n_secrets", F.sha2(F.col("text").cast("binary"), 256).alias("redacted_sha256"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(table(spark, sf_dir, "documents"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    rans.write_tokens(table(spark, sf_dir, "documents"), path, vocabulary("byte_bpe_50k.json"), END_ID)
    return rans.read_tokens(spark, path, keep_ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.deduplicated(table(spark, sf_dir, "documents")).drop("kept")


def op8_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.filter(F.col("vec_id") % 20 == 0), k=20)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_archive(table(spark, sf_dir, "pages"), path, least_bytes=0)
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    records = warc.read_archive(spark, path, payloads=False)
    return records.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers").alias("refers_to"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = vocabulary("byte_bpe_50k.tiktoken")
    return bpe.digest(bpe.encode(table(spark, sf_dir, "documents"), ranks), ranks)


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counted(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), TOKEN_LIMIT)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_benchmark_decontamination": op1_benchmark_decontamination,
    "op2_url_reputation": op2_url_reputation,
    "op3_toxicity_severity": op3_toxicity_severity,
    "op4_secret_scan": op4_secret_scan,
    "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
    "op6_token_files": op6_token_files,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_nearest_vectors": op8_nearest_vectors,
    "op9_warc": op9_warc,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_token_counts": op11_token_counts,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_filter_audit": op13_filter_audit,
}

ORACLE: dict[str, str] = {
    "op1_benchmark_decontamination": decontam.SQL,
    "op2_url_reputation": urls.SQL,
    "op9_warc": warc.SQL,
    "op12_prefix_trie": prefix_trie.SQL,
    "op13_filter_audit": filter_audit.SQL,
}
