"""Token ids in a binary file format coded with static range asymmetric numeral systems.

``write_tokens`` puts documents in ascending id order, encodes whole texts with the tokenizers library and
writes shard rows (Parquet as container). Added tokens of the tokenizer in a text get their ids. A shard holds up to ``SHARD_TOKENS`` ids and carries

* one frequency table, shared by all its blocks (zlib; token deltas and frequencies that sum to 2**SCALE),
* its blocks, each independent: magic, counts, a CRC-32 of the ids, the lane states at every checkpoint with
  the word offset to resume from, and the interleaved 32-bit words,
* document ids and lengths, and the number of ids before the shard within its part.

Lane ``p % LANES`` codes position ``p`` of a block, so one numpy operation advances all lanes. A decoder
may start at any checkpoint of any block. ``read_tokens`` decodes and checks every block.

One shuffle (range by id) moves the texts; tables are made per shard, so nothing is gathered on the
driver and a lost task is recomputed from its own range. Null texts are empty; every document ends with
the end id. Repeated ids keep one row each, ordered by text. An empty table gives no shard.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import hint_small
from .wordpieces import chunks, lay_out

SCALE = 20
LOW = np.uint64(1 << 31)
LANES = 2048
BLOCK_TOKENS = 1 << 20
SHARD_TOKENS = 1 << 22
CHECKPOINT_STEPS = 128
MAGIC = b"TKR1"
#: Words whose ids a Python worker keeps between chunks; about 150 bytes each.
KEPT_WORDS = 500_000

SHARD = "part int, shard int, first bigint, doc_ids array<bigint>, lens array<bigint>, tokens bigint, freqs binary, blocks array<binary>"


class Frequencies:
    """Frequencies of the present ids scaled to sum to 2**SCALE, each at least 1."""

    def __init__(self, ids: np.ndarray, freqs: np.ndarray):
        self.ids, self.freqs = ids.astype(np.int64), freqs.astype(np.uint64)
        self.base = np.concatenate([[0], np.cumsum(self.freqs)[:-1]]).astype(np.uint64) if len(ids) else self.freqs

    @classmethod
    def of(cls, tokens: np.ndarray) -> Frequencies:
        counts = np.bincount(tokens)
        ids = np.flatnonzero(counts)
        if len(ids) >= 1 << SCALE:
            raise ValueError("more distinct ids than slots")
        share = counts[ids].astype(np.float64) * ((1 << SCALE) - len(ids)) / max(1, counts.sum())
        freqs = 1 + np.floor(share).astype(np.int64)
        if len(ids):
            freqs[np.argmax(counts[ids])] += (1 << SCALE) - freqs.sum()
        return cls(ids, freqs)

    def pack(self) -> bytes:
        body = np.diff(self.ids, prepend=0).astype("<u4").tobytes() + self.freqs.astype("<u4").tobytes()
        return struct.pack("<I", len(self.ids)) + zlib.compress(body, 6)

    @classmethod
    def unpack(cls, data: bytes) -> Frequencies:
        (n,) = struct.unpack_from("<I", data)
        body = zlib.decompress(data[4:])
        return cls(np.cumsum(np.frombuffer(body, "<u4", n)), np.frombuffer(body, "<u4", n, 4 * n))

    def dense(self) -> np.ndarray:
        out = np.zeros(int(self.ids[-1]) + 1 if len(self.ids) else 0, np.int64)
        out[self.ids] = np.arange(len(self.ids))
        return out

    def slots(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ids), dtype=np.int32), self.freqs.astype(np.int64))


def encode_block(tokens: np.ndarray, table: Frequencies, dense: np.ndarray) -> bytes:
    """One independent block of ids."""
    symbols = dense[tokens]
    freq, base = table.freqs[symbols], table.base[symbols]
    limit = freq << np.uint64(63 - SCALE)
    n, steps = len(tokens), -(-len(tokens) // LANES)
    state = np.full(LANES, LOW, np.uint64)
    words, sizes = [], np.zeros(steps, np.int64)
    states = {}
    for t in range(steps - 1, -1, -1):
        a, b = t * LANES, min(n, (t + 1) * LANES)
        x, f = state[: b - a], freq[a:b]
        full = x >= limit[a:b]
        out = x[full].astype(np.uint32)
        x = np.where(full, x >> np.uint64(32), x)
        q = x // f
        state[: b - a] = (q << np.uint64(SCALE)) + (x - q * f) + base[a:b]
        words.append(out)
        sizes[t] = len(out)
        if t % CHECKPOINT_STEPS == 0:
            states[t] = state.copy()
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    marks = sorted(states)
    head = MAGIC + struct.pack("<IIII", n, len(marks), int(offsets[-1]), zlib.crc32(tokens.astype("<u4").tobytes()))
    body = b"".join(struct.pack("<II", t, int(offsets[t])) + states[t].astype("<u8").tobytes() for t in marks)
    stream = np.concatenate(words[::-1]).astype("<u4").tobytes() if words else b""
    return head + body + stream


def decode_block(data: bytes, table: Frequencies, slots: np.ndarray, begin: int = 0, stop: int | None = None) -> np.ndarray:
    """Ids of a block from its checkpoint ``begin`` on, to about the id ``stop`` (null: all); the checksum is verified for whole blocks."""
    if data[:4] != MAGIC:
        raise ValueError("not a block")
    n, marks, total, crc = struct.unpack_from("<IIII", data, 4)
    if not n:
        return np.zeros(0, np.uint32)
    at = 20 + begin * (8 + 8 * LANES)
    step, offset = struct.unpack_from("<II", data, at)
    state = np.frombuffer(data, "<u8", LANES, at + 8).copy()
    stream = np.frombuffer(data, "<u4", total, 20 + marks * (8 + 8 * LANES)).astype(np.uint64)
    n = n if stop is None else min(n, -(-stop // LANES) * LANES)
    out = np.empty(max(0, n - step * LANES), np.int32)
    mask, low = np.uint64((1 << SCALE) - 1), LOW
    for t in range(step, -(-n // LANES)):
        size = min(LANES, n - t * LANES)
        x = state[:size]
        slot = x & mask
        symbol = slots[slot.astype(np.int64)]
        out[(t - step) * LANES : (t - step) * LANES + size] = symbol
        x = table.freqs[symbol] * (x >> np.uint64(SCALE)) + slot - table.base[symbol]
        need = np.flatnonzero(x < low)
        x[need] = (x[need] << np.uint64(32)) | stream[offset : offset + len(need)]
        offset += len(need)
        state[:size] = x
    ids = table.ids[out].astype("<u4")
    if not begin and stop is None and zlib.crc32(ids.tobytes()) != crc:
        raise ValueError("checksum of a block differs")
    return ids


def decode_between(data: bytes, table: Frequencies, slots: np.ndarray, first: int, stop: int) -> np.ndarray:
    """Ids ``first`` to ``stop`` of a block, decoded from the last checkpoint before them."""
    mark = first // (LANES * CHECKPOINT_STEPS)
    return decode_block(data, table, slots, mark, stop)[first - mark * LANES * CHECKPOINT_STEPS : stop - mark * LANES * CHECKPOINT_STEPS]


def shards(docs: Iterator[tuple[int, np.ndarray]], part: int) -> Iterator[dict]:
    """Shard rows of one part; documents come in order with their ids (end id included)."""
    held: list[np.ndarray] = []
    ids: list[int] = []
    size = first = number = 0

    def flush() -> dict:
        flat = np.concatenate(held)
        table = Frequencies.of(flat)
        dense = table.dense()
        return {
            "part": part, "shard": number, "first": first, "doc_ids": ids, "lens": [len(x) for x in held], "tokens": size, "freqs": table.pack(),
            "blocks": [encode_block(flat[i : i + BLOCK_TOKENS], table, dense) for i in range(0, len(flat), BLOCK_TOKENS)],
        }

    for doc, tokens in docs:
        held.append(tokens)
        ids.append(doc)
        size += len(tokens)
        if size >= SHARD_TOKENS:
            yield flush()
            first, number, held, ids, size = first + size, number + 1, [], [], 0
    if held:
        yield flush()


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread a task; Spark has the cores
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path), {}


@lru_cache(maxsize=2)
def _added_tokens(path: str) -> re.Pattern[bytes] | None:
    """A pattern of the tokenizer's added tokens, the longest first; the tokenizer cuts texts at them before it splits words."""
    tokens = _tokenizer(path)[0].get_added_tokens_decoder().values()
    if any(t.single_word or t.lstrip or t.rstrip for t in tokens):
        raise ValueError("added tokens that take in or look at their neighbours are not supported")
    listed = sorted((t.content.encode() for t in tokens), key=len, reverse=True)
    return re.compile(b"|".join(map(re.escape, listed))) if listed else None


def word_ids(words: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, lens, flat) of the ids of distinct words; ids of words met before come from a bounded table."""
    tokenizer, kept = _tokenizer(path)
    listed = words.to_pylist()
    out = [kept.get(w) for w in listed]
    new = [i for i, x in enumerate(out) if x is None]
    for lo in range(0, len(new), 20_000):
        group = new[lo : lo + 20_000]
        for i, e in zip(group, tokenizer.encode_batch_fast([listed[i].decode() for i in group], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, "<u4").tobytes()
            if len(kept) < KEPT_WORDS:
                kept[listed[i]] = out[i]
    lens = np.fromiter(map(len, out), np.int64, len(out)) // 4
    return np.concatenate([[0], np.cumsum(lens)])[:-1], lens, np.frombuffer(b"".join(out), "<u4")


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = 32 << 20) -> None:
    """Encode whole texts in ascending id order and write the shards to ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], np.uint32)

        def documents() -> Iterator[tuple[int, np.ndarray]]:
            for c in chunks(batches, id_col, text_col, chunk_bytes, _added_tokens(tokenizer_path)):
                ids = c["ids"].to_pylist()
                starts, lens, flat = word_ids(c["words"], tokenizer_path)
                for doc, stop, ends, values in lay_out(c["counts"], c["codes"], starts, lens, flat):
                    for k, tokens in zip(ids[doc:stop], np.split(values, ends[:-1]), strict=True):
                        yield k, np.concatenate([tokens, end])

        for row in shards(documents(), TaskContext.get().partitionId()):
            yield pa.RecordBatch.from_pylist([row], schema=ARROW_SHARD)

    ordered = docs.select(F.col(id_col).cast("long").alias(id_col), F.coalesce(text_col, F.lit("")).alias(text_col)).repartitionByRange(id_col).sortWithinPartitions(id_col, text_col)
    ordered.mapInArrow(run, SHARD).write.option("compression", "none").option("parquet.block.size", str(32 << 20)).parquet(path)


ARROW_SHARD = pa.schema(
    [("part", pa.int32()), ("shard", pa.int32()), ("first", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lens", pa.list_(pa.int64())),
     ("tokens", pa.int64()), ("freqs", pa.binary()), ("blocks", pa.list_(pa.binary()))]
)


def read_tokens(spark: SparkSession, path: str, keep_ids: bool = True) -> DataFrame:
    """Documents of the files: ``(doc_id, start, n_tokens, ids_crc32[, ids])``, every block decoded and checked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(j)[i] for j, n in enumerate(batch.schema.names)}
                table = Frequencies.unpack(row["freqs"].as_py())
                slots = table.slots()
                flat = np.concatenate([decode_block(b.as_py(), table, slots) for b in row["blocks"].values])
                lens = np.asarray(row["lens"].values)
                ends = np.cumsum(lens)
                begins = ends - lens
                raw = memoryview(flat.tobytes())
                crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                n = len(lens)
                columns = [pa.array(np.full(n, row["part"].as_py(), np.int32)), row["doc_ids"].values, pa.array(begins + row["first"].as_py()), pa.array(lens), pa.array(crcs, pa.int64())]
                names = ["part", "doc_id", "start", "n_tokens", "ids_crc32"]
                if keep_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(flat.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    stored = spark.read.schema(SHARD).parquet(path)
    kinds = "part int, doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * keep_ids
    found = stored.mapInArrow(run, kinds)
    # one row a written part, so this window sees no more rows than the write had tasks
    parts = stored.groupBy("part").agg(F.sum("tokens").alias("tokens"))
    before = F.coalesce(F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = hint_small(parts.select("part", before.alias("before")))
    return found.join(parts, "part").withColumn("start", F.col("start") + F.col("before")).drop("part", "before")


def read_between(spark: SparkSession, path: str, first: int, stop: int) -> DataFrame:
    """``(start, ids)``: the ids ``first`` to ``stop`` of all that the files hold, in pieces with their start.

    Only blocks that hold some of them are decoded, each from the last checkpoint before what is wanted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                base, freqs, blocks = (batch.column(j)[i] for j in range(3))
                at, table, starts, found = base.as_py(), Frequencies.unpack(freqs.as_py()), [], []
                slots = table.slots()
                for b in blocks.values:
                    size = struct.unpack_from("<I", b.as_py(), 4)[0]
                    lo, hi = max(first - at, 0), min(stop - at, size)
                    if lo < hi:
                        starts.append(at + lo)
                        found.append(decode_between(b.as_py(), table, slots, lo, hi).astype(np.int32))
                    at += size
                yield pa.RecordBatch.from_arrays([pa.array(starts, pa.int64()), pa.array(found, pa.list_(pa.int32()))], names=["start", "ids"])

    stored = spark.read.schema(SHARD).parquet(path)
    parts = stored.groupBy("part").agg(F.sum("tokens").alias("tokens"))
    before = F.coalesce(F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a written part
    placed = stored.join(hint_small(parts.select("part", before.alias("before"))), "part").withColumn("base", F.col("first") + F.col("before"))
    return placed.filter((F.col("base") < stop) & (F.col("base") + F.col("tokens") > first)).select("base", "freqs", "blocks").mapInArrow(run, "start bigint, ids array<int>")
