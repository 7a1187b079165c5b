"""Byte-level BPE encoding and decoding with Spark higher-order functions.

Encoding: Arrow tasks cut whole texts into words and keep each chunk's distinct words as byte arrays;
``aggregate`` folds the ranked merges over the byte array of every distinct word, reading a literal rank
map; the word ids are then laid out along the documents. Decoding looks every id's bytes up in a literal
array and concatenates the pieces. No shuffle is needed: chunks are independent, so the plan is two stages
without an exchange at any input size, with the chunks' codes and folded words written in between.

The rank map is the vocabulary file's, so its size is fixed. A map lookup in Spark walks all keys; the map
is therefore laid out as arrays: the pair (left id, right id) sits in slot ``(shift[left] + right) % slots``,
whose owner must be ``left``.

A word that is itself a token has that token's id and is not merged: the library looks whole words up first, and for
a vocabulary with tokens that no merge gives this is a different result.

Null texts encode as empty (no ids). Empty texts give no ids. Repeated rows and repeated ids are encoded
row by row. Words over ``LONG_WORD`` bytes (runs without any break) are merged with a heap in the Arrow
task, because the fold copies its arrays at each merge; the result is the same.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, materialize
from .wordpieces import chunks, lay_out

CHUNK_BYTES = 16 << 20
LONG_WORD = 256
SLOTS = 1 << 19
ID_BITS = 20
NO_RANK = 1 << 20

CHUNK_SCHEMA = "ids array<bigint>, counts binary, codes binary, words array<array<tinyint>>, long_codes array<int>, long_tokens array<array<int>>, whole_codes array<int>, whole_ids array<int>"


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=1)
def whole_tokens(path: str) -> tuple[pa.Array, np.ndarray]:
    """All tokens and their ids: a word that is a token has its id and is not merged, as in the library."""
    ranks = load_ranks(path)
    return pa.array(list(ranks), pa.large_binary()), np.fromiter(ranks.values(), np.int32, len(ranks))


def pair_table(ranks: dict[bytes, int], slots: int = SLOTS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shift by left id, owner by slot, merged id by slot) of every pair of tokens that forms a token."""
    rows: dict[int, dict[int, int]] = {}
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            left, right = ranks.get(token[:i]), ranks.get(token[i:])
            if left is not None and right is not None:
                rows.setdefault(left, {})[right] = rank
    shift = np.zeros(max(ranks.values()) + 1, np.int64)
    owner, merged = np.full(slots, -1, np.int64), np.full(slots, -1, np.int64)
    step = np.random.default_rng(0)
    for left, row in sorted(rows.items(), key=lambda x: (-len(x[1]), x[0])):
        rights = np.fromiter(row, np.int64, len(row))
        while True:
            at = (int(step.integers(slots)) + rights) % slots
            if (owner[at] < 0).all():
                break
        shift[left] = (at[0] - rights[0]) % slots
        owner[at], merged[at] = left, np.fromiter(row.values(), np.int64, len(row))
    return shift, owner, merged


def literal_ints(values) -> Column:
    """A literal int array: one string literal that the optimizer folds into an array before execution."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold_merges(word: Column, tables: Column) -> Column:
    """Ids of one word (array<tinyint>): the lowest-ranked adjacent pair is merged until none is left.

    The state is one array<bigint>: element i is ``rank << ID_BITS | id``, with the rank of the pair that
    its id makes with the next one (``NO_RANK``: none), so the smallest element is the next merge.
    """
    shift, owner, merged, of_byte = (tables[x] for x in ("shift", "owner", "merged", "of_byte"))
    mask, none = F.lit((1 << ID_BITS) - 1).cast("bigint"), F.lit(NO_RANK << ID_BITS).cast("bigint")

    def cell(left: Column, right: Column) -> Column:
        """The element of ``left`` before ``right`` (null: last)."""
        slot = (F.get(shift, left) + right).bitwiseAND(F.lit(SLOTS - 1)).cast("int")
        rank = F.when(F.get(owner, slot) == left, F.get(merged, slot).cast("bigint"))
        return F.coalesce(F.shiftleft(rank, ID_BITS), none).bitwiseOR(left.cast("bigint"))

    def part(state: Column, i: Column) -> Column:
        return F.get(state, i).bitwiseAND(mask).cast("int")

    def merge(state: Column, best: Column) -> Column:
        new = F.shiftright(best, ID_BITS).cast("int")

        def at(i: Column) -> Column:
            last = cell(new, part(state, i + 1))
            pair = F.when(i > 1, F.array(cell(part(state, i - 2), new), last)).otherwise(F.array(last))
            return F.concat(F.slice(state, F.lit(1), F.greatest(i - 2, F.lit(0))), pair, F.slice(state, i + 2, F.size(state)))

        return let(F.array_position(state, best).cast("int"), at)

    bytes_ = F.transform(word, lambda b: F.get(of_byte, b.cast("int") + 128))
    begin = let(bytes_, lambda p: F.zip_with(p, F.slice(p, F.lit(2), F.size(p)), cell))
    steps = F.when(F.size(word) > 1, F.sequence(F.lit(2), F.size(word))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(
        steps,
        begin,
        lambda state, _: F.when(F.array_min(state) >= none, state).otherwise(let(F.array_min(state), lambda best: merge(state, best))),
        lambda state: F.transform(state, lambda x: x.bitwiseAND(mask).cast("int")),
    )


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges for one very long word, with a heap of pairs over a linked list of parts."""
    n = len(word)
    end, before, after = [i + 1 for i in range(n)], list(range(-1, n - 1)), list(range(1, n + 1))
    alive = bytearray(b"\1") * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or after[i] >= n or end[after[i]] != stop:
            continue
        j = after[i]
        alive[j], end[i], after[i] = 0, stop, after[j]
        if after[i] < n:
            before[after[i]] = i
            if (r := ranks.get(word[i : end[after[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[after[i]]))
        if before[i] >= 0 and (r := ranks.get(word[before[i] : stop])) is not None:
            heapq.heappush(heap, (r, before[i], stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = after[i]
    return out


def distinct_words(docs: DataFrame, id_col: str, text_col: str, rank_path: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row a chunk: document ids, words of each, word codes, and the chunk's distinct words as byte arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in chunks(batches, id_col, text_col, chunk_bytes):
            words = c["words"]
            bounds = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
            sizes = np.diff(bounds)
            tokens, token_ids = whole_tokens(rank_path)
            found = pc.index_in(words.cast(pa.large_binary()), value_set=tokens)
            whole = np.asarray(found.is_valid())
            whole_codes, whole_ids = np.flatnonzero(whole), token_ids[np.asarray(found.drop_null())]
            late = np.flatnonzero((sizes > LONG_WORD) & ~whole)
            fixed: list[list[int]] = []
            if len(late):
                ranks = load_ranks(rank_path)
                fixed = [merge_long(words[int(i)].as_py(), ranks) for i in late]
            words = pc.if_else(pa.array(whole | (sizes > LONG_WORD)), pa.scalar(b"", words.type), words)
            bounds = np.frombuffer(words.buffers()[1], np.int64)[: len(words) + 1]
            body = words.buffers()[2]
            flat = np.frombuffer(body, np.int8)[bounds[0] : bounds[-1]] if body is not None else np.zeros(0, np.int8)
            column = pa.ListArray.from_arrays(pa.array((bounds - bounds[0]).astype(np.int32)), pa.array(flat))
            one = lambda values, kind: pa.array([values], pa.list_(kind))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.ListArray.from_arrays(pa.array([0, len(c["ids"])], pa.int32()), c["ids"].cast(pa.int64())),
                    pa.array([c["counts"].astype("<i4").tobytes()], pa.binary()),
                    pa.array([c["codes"].astype("<i4").tobytes()], pa.binary()),
                    pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column),
                    one([int(i) for i in late], pa.int32()),
                    one(fixed, pa.list_(pa.int32())),
                    one(whole_codes, pa.int32()),
                    one(whole_ids, pa.int32()),
                ],
                names=["ids", "counts", "codes", "words", "long_codes", "long_tokens", "whole_codes", "whole_ids"],
            )
            del c, words, bounds, sizes, body, flat, column, found, whole
            give_back()

    return docs.select(F.col(id_col).cast("long").alias(id_col), text_col).mapInArrow(run, CHUNK_SCHEMA)


def _lay_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word ids along the documents."""
    for batch in batches:
        for row in range(batch.num_rows):
            col = {n: batch.column(i)[row] for i, n in enumerate(batch.schema.names)}
            ids, counts, codes = col["ids"].values, np.frombuffer(col["counts"].as_py(), "<i4"), np.frombuffer(col["codes"].as_py(), "<i4")
            tokens = col["tokens"].values
            flat = np.asarray(tokens.flatten()).astype(np.int32, copy=False)
            lens = np.asarray(tokens.value_lengths()).astype(np.int32)
            starts = np.concatenate([[0], np.cumsum(lens[:-1], dtype=np.int64)]) if len(lens) else np.zeros(0, np.int64)
            whole, whole_ids = (np.asarray(col[n].values) for n in ("whole_codes", "whole_ids"))
            starts[whole], lens[whole] = len(flat) + np.arange(len(whole)), 1
            flat = np.concatenate([flat, whole_ids.astype(np.int32, copy=False)])
            for code, fixed in zip(col["long_codes"].as_py(), col["long_tokens"].as_py(), strict=True):
                starts[code], lens[code] = len(flat), len(fixed)
                flat = np.concatenate([flat, np.array(fixed, np.int32)])
            for doc, stop, doc_ends, values in lay_out(counts, codes, starts, lens, flat):
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(doc, stop - doc), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], doc_ends]).astype(np.int32)), pa.array(values))],
                    names=["id", "ids"],
                )
            del col, ids, counts, codes, tokens, flat, lens, starts
            give_back()


def encode(docs: DataFrame, rank_path: str, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``(id_col, ids array<int>)`` of every row: the ids of its whole text by the ranks in ``rank_path``."""
    ranks = load_ranks(rank_path)
    shift, owner, merged = pair_table(ranks)
    tables = F.struct(
        literal_ints(shift).alias("shift"),
        literal_ints(owner).alias("owner"),
        literal_ints(merged).alias("merged"),
        literal_ints([ranks[bytes([b & 255])] for b in range(-128, 128)]).alias("of_byte"),
    )
    del shift, owner, merged
    give_back()  # what laid the pairs out is several times the table, and this is the driver
    words = distinct_words(docs, id_col, text_col, rank_path, chunk_bytes)
    tokens = let(tables, lambda t: F.transform(F.col("words"), lambda w: fold_merges(w, t)))
    # written, so that the splitting and the laying out do not hold Python workers in one task, and a lost task folds nothing twice
    laid = materialize(words.select("ids", "counts", "codes", tokens.alias("tokens"), "long_codes", "long_tokens", "whole_codes", "whole_ids"), "folded")
    return laid.mapInArrow(_lay_out, "id bigint, ids array<int>").select(F.col("id").alias(id_col), F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))


def decode(col: Column, rank_path: str) -> Column:
    """Bytes of an array of ids: the literal piece of each id, concatenated."""
    by_id = {b: a for a, b in load_ranks(rank_path).items()}
    pieces = F.split(F.lit(",".join(by_id[i].hex() if i in by_id else "" for i in range(max(by_id) + 1))), ",")
    return F.unhex(let(pieces, lambda p: F.array_join(F.transform(col, lambda i: F.get(p, i)), "")))


def digest(encoded: DataFrame, rank_path: str, id_col: str = "doc_id") -> DataFrame:
    """``(id, n_tokens, ids_sha256, decoded_sha256)``: fingerprints of the ids and of the decoded bytes."""
    return encoded.select(
        id_col,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast(T.ArrayType(T.StringType())), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(decode(F.col("ids"), rank_path), 256).alias("decoded_sha256"),
    )
