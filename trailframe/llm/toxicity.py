"""Toxicity by cumulative-link (proportional odds) regression over sparse text features.

A document's features are the words it has and their beginnings of four to eight letters. One weight vector is
shared by all thresholds: P(grade >= k) = sigmoid(f(x) - b_k) with b_1 < b_2 < ...; the score is the expected
grade. The classifier is fitted on a bounded sample of labelled rows (``TRAIN_ROWS``, the rows of least hash)
with the ``FEATURES`` features that tell the grades apart best; both bounds are parameters. Scoring covers
every document: tasks keep a chunk's distinct words, look each up once and add the weights up by document.

Null and empty texts have no features and get the score of the thresholds alone. Labels of unknown documents,
null grades and repeated labels (the largest counts) do no harm; without labels of at least two grades every
score is 0. Repeated rows are scored row by row; extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import give_back, materialize
from .wordpieces import chunks

TRAIN_ROWS = 12_000
FEATURES = 2048
LEAST_DOCUMENTS = 5
CHUNK_BYTES = 16 << 20
#: Chunks that are scored carry the columns that are kept, texts too.
SCORE_BYTES = 6 << 20
#: A grade is given from this probability on: a missed toxic document costs more than twice a wrong rejection.
LEAST_ODDS = 0.3


def features_of(word: str) -> list[str]:
    """The word and its beginnings, if it is of letters."""
    word = word.strip().lower()
    if len(word) < 3 or not word.isalpha():
        return []
    return [f"{word}$", *(word[:n] for n in range(4, 9) if len(word) >= n)]


@dataclass
class Model:
    names: list[str]
    weights: np.ndarray
    bounds: np.ndarray

    def at_least(self, logits: np.ndarray) -> np.ndarray:
        """P(grade >= k) for each row and k = 1..K."""
        return 1 / (1 + np.exp(-np.clip(logits[:, None] - self.bounds, -40, 40)))


def fit(rows: np.ndarray, columns: np.ndarray, grades: np.ndarray, names: list[str], rounds: int = 400, l2: float = 0.01, rate: float = 0.1) -> Model:
    """Weights and ordered bounds of greatest likelihood; features are present (1) or not."""
    top = int(grades.max()) if len(grades) else 0
    n, share = len(grades), np.array([(grades >= k).mean() for k in range(1, top + 1)]) if len(grades) else np.zeros(0)
    if top == 0 or share[0] >= 1:
        return Model([], np.zeros(0), np.full(max(1, top), np.inf))
    w = np.zeros(len(names))
    first = np.log((1 - share[0]) / share[0])
    gaps = np.full(top - 1, 0.5)
    params = np.concatenate([w, [first], gaps])
    m, v = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, rounds + 1):
        w, first, gaps = params[: len(names)], params[len(names)], params[len(names) + 1 :]
        bounds = first + np.concatenate([[0], np.cumsum(np.exp(gaps))])
        f = np.bincount(rows, w[columns], n)
        s = 1 / (1 + np.exp(-np.clip(f[:, None] - bounds, -40, 40)))
        upper = np.concatenate([np.ones((n, 1)), s], axis=1)[np.arange(n), grades]
        lower = np.concatenate([s, np.zeros((n, 1))], axis=1)[np.arange(n), grades]
        p = np.maximum(upper - lower, 1e-9)
        slope_f = (upper * (1 - upper) - lower * (1 - lower)) / p
        grad_b = np.zeros(top)
        for k in range(top):
            grad_b[k] = -((grades == k + 1) * upper * (1 - upper) / p).sum() + ((grades == k) * lower * (1 - lower) / p).sum()
        grad_w = np.bincount(columns, slope_f[rows], len(names)) / n - l2 * w / np.sqrt(n)
        tail = np.cumsum(grad_b[::-1])[::-1] / n
        g = np.concatenate([grad_w, [tail[0]], tail[1:] * np.exp(gaps)])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        params = params + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    w, first, gaps = params[: len(names)], params[len(names)], params[len(names) + 1 :]
    return Model(names, w, first + np.concatenate([[0], np.cumsum(np.exp(gaps))]))


def _present(chunk: dict, index: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) pairs of a chunk, each once."""
    of_word: list[list[int]] = [[index[x] for x in features_of(w.decode()) if x in index] for w in chunk["words"].to_pylist()]
    sizes = np.fromiter(map(len, of_word), np.int64, len(of_word))
    flat = np.fromiter((x for own in of_word for x in own), np.int64, int(sizes.sum()))
    at = np.cumsum(sizes) - sizes
    doc = np.repeat(np.arange(len(chunk["counts"])), chunk["counts"])
    known = sizes[chunk["codes"]] > 0
    doc, codes = doc[known], chunk["codes"][known]
    n = sizes[codes]
    feature = flat[np.repeat(at[codes] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
    pairs = np.unique(np.repeat(doc, n) << 32 | feature)
    return pairs >> 32, pairs & 0xFFFFFFFF


def train(docs: DataFrame, grades: DataFrame, train_rows: int = TRAIN_ROWS, features: int = FEATURES) -> Model:
    """The model of ``docs(doc_id, text)`` and ``grades(doc_id, grade)``."""
    known = grades.filter("doc_id IS NOT NULL AND grade IS NOT NULL").groupBy("doc_id").agg(F.max("grade").cast("int").alias("grade"))
    order = F.xxhash64(F.lit("train"), "doc_id")
    picked = known.orderBy(order, "doc_id").limit(train_rows)
    sample = materialize(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").dropDuplicates(["doc_id"]), "train")  # at most train_rows rows

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in chunks(batches, "grade", "text", CHUNK_BYTES):
            of_word = [features_of(w.decode()) for w in c["words"].to_pylist()]
            ends = np.cumsum(c["counts"])
            for grade, a, b in zip(c["ids"].to_pylist(), ends - c["counts"], ends, strict=True):
                found = sorted({x for code in np.unique(c["codes"][a:b]).tolist() for x in of_word[code]})
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([int(grade > 0)] * len(found), pa.int64())], names=["name", "bad"])

    base = sample.agg(F.count("*").alias("n"), F.sum((F.col("grade") > 0).cast("int")).alias("bad")).first()
    if not base.n or base.bad in (0, base.n):
        return Model([], np.zeros(0), np.array([np.inf]))
    p = base.bad / base.n
    counted = sample.select("grade", "text").mapInArrow(names, "name string, bad bigint").groupBy("name").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))
    z = F.abs(F.col("bad") - F.col("n") * p) / F.sqrt(F.col("n") * p * (1 - p))
    chosen = [r.name for r in counted.filter(F.col("n") >= LEAST_DOCUMENTS).orderBy(z.desc(), "name").limit(features).collect()]
    index = {x: i for i, x in enumerate(chosen)}

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in chunks(batches, "doc_id", "text", CHUNK_BYTES):
            doc, feature = _present(c, index)
            cuts = np.searchsorted(doc, np.arange(len(c["ids"]) + 1))
            yield pa.RecordBatch.from_arrays([c["ids"], pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(feature))], names=["doc_id", "features"])

    found = sample.select("doc_id", "text").mapInArrow(sparse, "doc_id bigint, features array<bigint>").join(F.broadcast(picked), "doc_id").collect()
    found.sort(key=lambda r: r.doc_id)
    rows = np.repeat(np.arange(len(found)), [len(r.features) for r in found])
    columns = np.array([x for r in found for x in r.features], np.int64)
    return fit(rows, columns, np.array([r.grade for r in found]), chosen)


def score(docs: DataFrame, model: Model, least: float = LEAST_ODDS, kept: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Columns ``kept`` with ``severity, grade, toxic``: expected grade, the largest grade of probability ``least``, whether that is above 0.

    Rows are scored where they are read; nothing is shuffled.
    """
    index = {x: i for i, x in enumerate(model.names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in chunks(batches, "row", "words", SCORE_BYTES):
            doc, feature = _present(c, index)
            p = model.at_least(np.bincount(doc, model.weights[feature], len(c["ids"])) if len(doc) else np.zeros(len(c["ids"])))
            grade = (p >= least).sum(axis=1)
            found = [pa.array(p.sum(axis=1)), pa.array(grade.astype(np.int32)), pa.array(grade > 0)]
            yield pa.RecordBatch.from_arrays([*c["ids"].flatten(), *found], names=[*kept, "severity", "grade", "toxic"])
            del c, doc, feature, p, grade, found
            give_back()

    rows = docs.select(F.struct(*kept).alias("row"), F.col("text").alias("words"))
    return rows.mapInArrow(run, StructType([*docs.select(*kept).schema.fields, *_FOUND.fields]))


_FOUND = StructType().add("severity", "double").add("grade", "integer").add("toxic", "boolean")


def severity_grades(labels: DataFrame) -> DataFrame:
    """0: not toxic, 1: toxic, 2: toxic and of low quality.

    The labels hold no severity; low quality stands in for the second grade.
    """
    return labels.select("doc_id", F.when(F.col("toxic") == 0, 0).when(F.col("toxic") == 1, F.when(F.col("quality") == 0, 2).otherwise(1)).alias("grade"))
