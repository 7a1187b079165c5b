"""The corpus pipeline: five stages over whole documents, each written as Parquet and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailframe.llm import bpe, decontam, jaccard, secrets, toxicity
from trailframe.llm.common import scratch_path, table
from trailframe.llm.queries import vocabulary
from trailframe.shipping import ship

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model does not reject, row by row; a null or empty text is not toxic."""
    ship(spark)
    model = toxicity.train(docs, toxicity.severity_grades(table(spark, sf_dir, "labels")))
    return toxicity.score(docs, model, kept=COLUMNS).filter("NOT toxic").select(*COLUMNS)


def keep_one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that near-duplicate links join, the one with the smallest id.

    Rows with a null id, a null text or no words are linked with nothing and stay; rows that repeat an id stay or go together.
    """
    others = jaccard.classes(docs).filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(others, "doc_id", "left_anti").select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item, row by row (a row is known by its id and text)."""
    hit = decontam.contaminated(docs, table(spark, sf_dir, "benchmark")).filter("contaminated")
    hit = hit.select(F.col("doc_id").alias("hit_id"), F.col("row_key").alias("hit_key")).distinct()
    return docs.join(hit, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.xxhash64("text") == F.col("hit_key")), "left_anti").select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark; null texts stay null."""
    return secrets.redacted(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def encode_and_decode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and fingerprints of the kept documents."""
    ranks = vocabulary("byte_bpe_50k.tiktoken")
    return bpe.digest(bpe.encode(docs, ranks), ranks)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", keep_one_of_each_class),
    ("benchmark_decontamination", drop_contaminated),
    ("secret_scans", redact_secrets),
    ("byte_level_bpe", encode_and_decode),
]

#: The toxicity model and the forest are not expressible in SQL; tests/llm/test_pipeline.py compares the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
