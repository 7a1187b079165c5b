"""Tokens of whole texts, counted once for each distinct pre-token of the corpus; no token id is laid out.

Arrow tasks cut the texts into pre-tokens and write, chunk by chunk, how often each document holds each of the chunk's
distinct pre-tokens, and these pre-tokens themselves, packed by ranges of their hash. The packs of one range meet in one
task: there every distinct pre-token is tokenized once, and its number of pieces goes back to all chunks that hold it. A
document's count is the sum of frequency times pieces. A chunk is bounded by ``chunk_bytes`` (or one text), and a
pre-token goes to its range once a chunk, so that neither depends on how often a word or a document is repeated.

Defined results: a null text counts as empty (0 bytes, 0 tokens); rows that repeat an id, or have none, are
counted row by row; other columns are ignored; an empty table gives no rows; strings of the tokenizer's added
tokens inside a text are one token each, as the library has it by default.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, give_back, materialize
from .rans import _added_tokens, _tokenizer
from .wordpieces import chunks

CHUNK_BYTES = 32 << 20
#: Ranges of hashes; a task holds the distinct pre-tokens of one range.
RANGES = 1024

FREQUENCIES = "chunk bigint, ids array<bigint>, n_bytes array<bigint>, distinct int, steps binary, freqs binary, packs array<binary>"


def _pack(values: np.ndarray) -> bytes:
    """Whole numbers, their bytes plane by plane, compressed."""
    wide = np.ascontiguousarray(values, "<i8")
    return zlib.compress(wide.view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<i8").ravel()


def _pack_words(words: pa.Array, bounds: np.ndarray, begin: int, end: int) -> bytes:
    """Words ``begin`` to ``end``: their number, lengths and bytes, compressed."""
    sizes = np.diff(bounds[begin : end + 1]).astype("<u4")
    return zlib.compress(np.uint32(end - begin).tobytes() + sizes.tobytes() + bytes(memoryview(words.buffers()[2])[bounds[begin] : bounds[end]]), 1) if end > begin else b""


def _unpack_words(data: bytes) -> list[bytes]:
    raw = zlib.decompress(data)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    ends = (4 + 4 * n + np.cumsum(np.frombuffer(raw, "<u4", n, 4).astype(np.int64))).tolist()
    return [raw[a:b] for a, b in zip([4 + 4 * n, *ends[:-1]], ends, strict=True)]


def frequencies(docs: DataFrame, tokenizer_path: str, id_col: str, text_col: str, chunk_bytes: int) -> DataFrame:
    """A row a chunk: ids and bytes of its documents, (document, code, frequency) in order, and the distinct pre-tokens by code, packed by range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 32
        for number, c in enumerate(chunks(batches, id_col, text_col, chunk_bytes, _added_tokens(tokenizer_path))):
            words, counts = c["words"].cast(pa.large_binary()), c["counts"].astype(np.int64)
            n_docs, distinct = len(counts), len(words)
            ranges = np.fromiter((zlib.crc32(w) % RANGES for w in words.to_pylist()), np.int64, distinct)
            order = np.argsort(ranges, kind="stable")
            words = words.take(pa.array(order))
            code = np.empty(distinct, np.int64)
            code[order] = np.arange(distinct)
            key = np.repeat(np.arange(n_docs, dtype=np.int64) * max(1, distinct), counts)
            key += code[c["codes"]]
            key, freqs = np.unique(key, return_counts=True)
            doc, held = np.divmod(key, max(1, distinct))
            bounds = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + distinct + 1]
            sizes = np.diff(bounds)[held] * freqs
            ends = np.searchsorted(ranges[order], np.arange(RANGES + 1))
            packs = [_pack_words(words, bounds, a, b) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([part | number], pa.int64()),
                    pa.ListArray.from_arrays(pa.array([0, n_docs], pa.int32()), c["ids"].cast(pa.int64())),
                    pa.array([np.bincount(doc, sizes, n_docs).astype(np.int64)], pa.list_(pa.int64())),
                    pa.array([distinct], pa.int32()),
                    pa.array([_pack(np.diff(key, prepend=0))], pa.binary()),
                    pa.array([_pack(freqs)], pa.binary()),
                    pa.array([packs], pa.list_(pa.binary())),
                ],
                names=["chunk", "ids", "n_bytes", "distinct", "steps", "freqs", "packs"],
            )
            del words, key, freqs, doc, held, sizes, packs, c
            give_back()

    return docs.select(F.col(id_col).cast("long").alias(id_col), text_col).mapInArrow(run, FREQUENCIES)


def piece_counts(packs: DataFrame, tokenizer_path: str) -> DataFrame:
    """``(chunk, range, pieces)`` of ``packs (range, chunk, pack)``: the tokens of each pre-token of a pack, each distinct one tokenized once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, _ = _tokenizer(tokenizer_path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        known: dict[bytes, int] = {}
        now = None
        for batch in batches:
            ranges, blobs = batch.column(0).to_pylist(), batch.column(2)
            out, begin = [], 0
            while begin < len(ranges):
                end = begin
                while end < len(ranges) and ranges[end] == ranges[begin]:
                    end += 1
                if ranges[begin] != now:
                    now, known = ranges[begin], {}
                listed = [_unpack_words(blobs[i].as_py()) for i in range(begin, end)]
                new = list({w for words in listed for w in words if w not in known})
                found = tokenizer.encode_batch_fast([w.decode() for w in new], add_special_tokens=False)
                known.update(zip(new, map(len, found), strict=True))
                out += [_pack(np.fromiter((known[w] for w in words), np.int64, len(words))) for words in listed]
                begin = end
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(0), pa.array(out, pa.binary())], names=["chunk", "range", "pieces"])

    together = packs.repartition("range").sortWithinPartitions("range").select("range", "chunk", "pack")
    return together.mapInArrow(run, "chunk bigint, range int, pieces binary")


def _summed(frequency: pa.Table, pieces: pa.Table) -> pa.Table:
    """Documents of one chunk with their sums; ``pieces`` has a row for each range in which the chunk has pre-tokens."""
    packed = dict(zip(pieces["range"].to_pylist(), pieces["pieces"].to_pylist(), strict=True))
    by_code = np.concatenate([np.zeros(0, np.int64), *[_unpack(packed[r]) for r in sorted(packed)]])
    row = {name: frequency[name].combine_chunks()[0] for name in frequency.column_names}
    n_docs = len(row["ids"])
    doc, code = np.divmod(np.cumsum(_unpack(row["steps"].as_py())), max(1, row["distinct"].as_py()))
    totals = np.bincount(doc, by_code[code] * _unpack(row["freqs"].as_py()), n_docs)  # doubles, exact far beyond any text
    return pa.table({"doc_id": row["ids"].values, "n_bytes": row["n_bytes"].values, "n_tokens": totals.astype(np.int64)})


def counted(docs: DataFrame, tokenizer_path: str, limit: int, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``(id_col, n_bytes, n_tokens, over_limit)`` of every row; ``over_limit``: more than ``limit`` tokens."""
    written = materialize(frequencies(docs, tokenizer_path, id_col, text_col, chunk_bytes), "frequencies")
    packs = written.select("chunk", F.posexplode("packs").alias("range", "pack")).filter(F.octet_length("pack") > 0)
    pieces = materialize(piece_counts(packs, tokenizer_path), "pieces")
    held = docs.sparkSession.read.schema(written.schema).parquet(written.scratch_path).drop("packs")
    found = held.groupBy("chunk").cogroup(pieces.groupBy("chunk")).applyInArrow(lambda a, b: _summed(a, b), "doc_id bigint, n_bytes bigint, n_tokens bigint")
    found = materialize(found, "token-counts")
    discard(written, pieces)
    return found.select(F.col("doc_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
