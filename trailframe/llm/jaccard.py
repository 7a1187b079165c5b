"""N-gram Jaccard join by parity sketches, and the classes its links form.

A document is the set of its distinct ``WIDTH``-word shingles. Shingles are compared by 64-bit hashes, of their words
and then of the word hashes; two different shingles are taken for one with a chance of about 2**-64. Two sets of sizes
a and b with Jaccard similarity of at least 3/4 differ in at most ``(a + b) / 7`` shingles. The join:

* Documents with equal sets are one class by a digest of the set; only the first of them goes on.
* Per size band (sizes 2**k to 2**(k+1); a set that may have partners above its band sketches for both) shingles fall
  into parts by hash, ``SPARE`` times as many as may differ in the band, and a part's sketch is the XOR of its
  shingles' hashes. A differing shingle changes one part, so of the first ``d + 1`` non-empty parts of a set (``d``:
  the bound over all partner sizes) one is unchanged in the partner: pigeonhole. Only those sketches are emitted as
  keys. A set with fewer parts that are not empty can only miss partners that lack parts as well; these few are
  joined among themselves once more, with a part for each shingle.
* The order of parts is free as long as all sets share it. Shingles of very many documents get parts of their own at
  the end, so that passages and lines that many documents share are hardly ever keys. Which ones are at the end
  changes cost only, never the links; that list is therefore bounded.
* Keys of up to ``RUN`` documents give pairs. A key of more documents inside a task is written once as a run, and
  only its smallest document goes on to meet other tasks, so that no key gathers a large group in one task.
* Pairs are tested by size, by whole parity sketches (two bits or more a shingle by size band; their Hamming distance
  is at most the symmetric difference), and those that are left are verified from whole texts.
* Longer runs give a star around their smallest document, verified with the pairs. Runs whose members are then in one
  class are settled. Documents of the others are grouped by runs that they share; each group is compared sketch by
  sketch in blocks, first for the nearest document of another class until that links nothing, then for all
  documents of other classes that sizes and sketches still allow. Groups over ``GROUP`` documents are compared run by
  run instead.

Null texts and texts without words have no shingles and link with nothing. A text of fewer words is one shingle. Rows
that share an id are one document with the links of all its texts; repeated rows change nothing. Rows with a null id
are answered with a null component and link with nothing. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, contracted_components, give_back, hint_small, materialize

WIDTH = 5
#: Shingles that go to the end of the order of parts at most: 8 bytes each in every task.
COMMON_SHINGLES = 100_000
COMMON_FROM = 40
CHUNK_BYTES = 8 << 20
LEAST_BITS = 512
BLOCK = 512
KEYS_A_BUCKET = 2_000_000
SPARE = 1.25
RUN = 8
GROUP = 4096
KEY_BYTES = 5
PIECE = 1 << 20

U = np.uint64
_ODD = [U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (multiply and shift)."""
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base, inverse = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
    out = []
    for b in (base, inverse):
        p = np.full(n, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


@lru_cache(maxsize=1)
def _byte_tables() -> tuple[np.ndarray, np.ndarray]:
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    blank = np.zeros(256, bool)
    blank[[32, *range(9, 14)]] = True
    return lower, blank


def _word_hashes(raw: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first byte) of each word; no word crosses ``edges``."""
    lower, blank = _byte_tables()
    gap = blank[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[edges] = True
    begin = ~gap
    begin[1:] &= gap[:-1] | edge[1:-1]
    close = ~gap
    close[:-1] &= gap[1:] | edge[1:-1]
    a, b = np.flatnonzero(begin), np.flatnonzero(close)
    power, inverse = _powers(1 << max(20, int(len(raw)).bit_length()))
    total = np.cumsum((lower[raw].astype(np.uint64) + U(1)) * power[: len(raw)])
    return mix((total[b] - np.where(a > 0, total[a - 1], U(0))) * inverse[a]), a


def _pieces(raw: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cuts of one long text into about ``PIECE`` bytes, each before a blank (a longer word stays whole)."""
    blank, lo = _byte_tables()[1], 0
    while lo < len(raw):
        hi = lo + PIECE
        while hi < len(raw):
            gaps = np.flatnonzero(blank[raw[hi : hi + PIECE]])
            if len(gaps):
                hi += int(gaps[0])
                break
            hi += PIECE
        yield lo, min(hi, len(raw))
        lo = hi


def _slice_shingles(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes, number of shingles of each document) of concatenated texts."""
    docs = len(offsets) - 1
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(docs, np.int64)
    if docs == 1 and len(raw) > 2 * PIECE:
        parts = [_word_hashes(raw[a:b], np.array([0, b - a])) for a, b in _pieces(raw)]
        words = np.concatenate([w for w, _ in parts])
        ends = np.array([0, len(words)])
    else:
        words, a = _word_hashes(raw, offsets)
        ends = np.searchsorted(a, offsets)
    counts = np.diff(ends)
    per_doc = np.where(counts >= WIDTH, counts - WIDTH + 1, (counts > 0).astype(np.int64))
    out = np.zeros(int(per_doc.sum()), np.uint64)
    to = np.cumsum(per_doc) - per_doc
    n = len(words)
    if n >= WIDTH:
        full = np.zeros(n - WIDTH + 1, np.uint64)
        for j in range(WIDTH):
            full += words[j : n - WIDTH + 1 + j] * _ODD[j]
        long = np.flatnonzero(counts >= WIDTH)
        m = per_doc[long]
        step = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
        out[np.repeat(to[long], m) + step] = full[np.repeat(ends[long], m) + step]
    for d in np.flatnonzero((counts > 0) & (counts < WIDTH)):
        own = words[ends[d] : ends[d + 1]]
        out[to[d]] = np.add.reduce(own * np.array(_ODD[: len(own)])) + U(len(own))
    return mix(out), per_doc


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text, about a megabyte of texts at a time."""
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    doc = 0
    while doc < len(texts):
        stop = max(doc + 1, int(np.searchsorted(offsets, offsets[doc] + (1 << 19), "right")) - 1)
        base = offsets[doc]
        found, counts = _slice_shingles(raw[base : offsets[stop]], offsets[doc : stop + 1] - base)
        at = 0
        for n in counts.tolist():
            own = np.sort(found[at : at + n])
            at += n
            yield own[np.concatenate([[True], own[1:] != own[:-1]])] if n > 1 else own
        doc = stop


def set_key(own: np.ndarray) -> bytes:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def parity_sketch(own: np.ndarray) -> np.ndarray:
    """At least two bits for each shingle, a power of two by size band; each shingle flips one."""
    bits = max(LEAST_BITS, 1 << (2 * len(own) - 1).bit_length()) if len(own) else LEAST_BITS
    bit = mix(own ^ U(77)) & U(bits - 1)
    odd = (np.bincount(bit.astype(np.int64), minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.uint64)


def folded(sketches: np.ndarray, width: int) -> np.ndarray:
    """Rows of a wider band as the sketches of ``width`` words that their sets have."""
    return np.bitwise_xor.reduce(sketches.reshape(len(sketches), -1, width), axis=1)


def most_differing(n: int | np.ndarray) -> int | np.ndarray:
    """Shingles in which a set of size n and a partner of any size may differ at most."""
    return (n + 4 * n // 3) // 7


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Similarity of at least 3/4, in integers."""
    if not len(a) or not len(b):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= 75 * (len(a) + len(b) - both)


def describe(docs: DataFrame) -> DataFrame:
    """``(doc_id, text_key, n, set_key, sketch)`` of each row, and rows with a chunk's common shingles (``hashes, counts``)."""
    schema = pa.schema(
        [("doc_id", pa.int64()), ("text_key", pa.int64()), ("n", pa.int64()), ("set_key", pa.binary()), ("sketch", pa.binary()), ("hashes", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def common() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            often = np.flatnonzero(counts >= 4)
            often = often[np.argsort(-counts[often], kind="stable")[:20_000]]
            none = [pa.array([None], f.type) for f in list(schema)[:5]]
            return pa.RecordBatch.from_arrays([*none, pa.array([values[often].view(np.int64)], pa.list_(pa.int64())), pa.array([counts[often]], pa.list_(pa.int64()))], schema=schema)

        held, size = [], 0
        for batch in batches:
            n, keys, sketches = [], [], []
            for own in shingle_sets(batch.column(2)):
                n.append(len(own))
                keys.append(set_key(own) if len(own) else None)
                sketches.append(parity_sketch(own).tobytes() if len(own) else None)
                held.append(own)
                size += len(own)
                if size > 1_000_000:
                    yield common()
                    held, size = [], 0
                    give_back()
            empty = pa.array([None] * len(n), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sketches, pa.binary()), empty, empty], schema=schema)
        if held:
            yield common()
        del held
        give_back()

    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(
        run, "doc_id bigint, text_key bigint, n bigint, set_key binary, sketch binary, hashes array<bigint>, counts array<bigint>"
    )


def _emit(ids: np.ndarray, sets: list[np.ndarray], common: np.ndarray, buckets: int, singles: bool) -> Iterator[dict]:
    """Packed keys of a chunk by bucket (kind 0), its long runs (1), documents without enough parts (2), keys of long runs (3)."""
    sizes = np.array([len(s) for s in sets], np.int64)
    band = np.frexp(sizes.astype(np.float64))[1] - 1
    above = np.flatnonzero(4 * sizes // 3 >= (1 << (band + 1)))
    owner = np.concatenate([np.arange(len(sets)), above])
    level = np.concatenate([band, band[above] + 1])
    n = sizes[owner]
    flat = np.concatenate([sets[i] for i in owner])
    row = np.repeat(np.arange(len(owner)), n)
    if singles:
        part = flat >> U(26)
    else:
        parts = np.ceil(SPARE * (most_differing(2 << level) + 1)).astype(np.uint64)
        part = mix(flat ^ U(5)) % parts[row]
    if len(common):
        at = np.minimum(np.searchsorted(common["hash"], flat), len(common) - 1)
        late = common["hash"][at] == flat
        part = np.where(late, U(1 << 38) + common["order"][at].astype(np.uint64), part)
    order = np.argsort((row.astype(np.uint64) << U(40)) | part, kind="stable") if len(flat) else np.zeros(0, np.int64)
    row, part, flat = row[order], part[order], flat[order]
    first = np.ones(len(row), bool)
    first[1:] = (row[1:] != row[:-1]) | (part[1:] != part[:-1])
    starts = np.flatnonzero(first)
    word = np.bitwise_xor.reduceat(flat, starts)
    row, part = row[starts], part[starts]
    head = np.searchsorted(row, np.arange(len(owner)))
    need = most_differing(n) + 1
    loose = np.unique(ids[owner[np.bincount(row, minlength=len(owner)) < need]])
    if len(loose):
        yield {"bucket": int(loose[0]) % buckets, "kind": 2, "keys": b"", "docs": loose.astype("<i8").tobytes(), "lens": b""}
    keep = np.arange(len(row)) - head[row] < need[row]
    row, part, word = row[keep], part[keep], word[keep]
    key = mix(word ^ mix(part ^ (level[row].astype(np.uint64) << U(48))))
    doc = ids[owner[row]]
    order = np.lexsort((doc, key))
    key, doc = key[order], doc[order]
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    starts = np.flatnonzero(first)
    lens = np.diff(np.append(starts, len(key)))
    many = np.flatnonzero(lens > RUN)
    inside = np.repeat(lens > RUN, lens)
    for lo in range(0, len(many), 20_000):
        some = many[lo : lo + 20_000]
        chosen = np.zeros(len(starts), bool)
        chosen[some] = True
        yield {
            "bucket": int(key[starts[some[0]]] % U(buckets)), "kind": 1, "keys": _key_name(key[starts[some]] // U(buckets), key[starts[some]] % U(buckets)).astype("<u8").tobytes(),
            "docs": doc[np.repeat(chosen, lens) & inside].astype("<i8").tobytes(), "lens": lens[some].astype("<i4").tobytes(),
        }
    for kind, own_key, own_doc in ((0, key[~inside], doc[~inside]), (3, key[starts[many]], doc[starts[many]])):
        bucket = (own_key % U(buckets)).astype(np.int64)
        order = np.lexsort((own_doc, bucket))
        own_key, own_doc, bucket = own_key[order], own_doc[order], bucket[order]
        if not len(own_key):
            continue
        cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        for a, b in zip(cuts, [*cuts[1:], len(own_key)], strict=True):
            own = own_doc[a:b]
            heads = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            narrow = (own_key[a:b] // U(buckets)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES]
            yield {"bucket": int(bucket[a]), "kind": kind, "keys": narrow.tobytes(), "docs": own[heads].astype("<i8").tobytes(), "lens": np.diff(np.append(heads, b - a)).astype("<u4").tobytes()}


def _key_name(rest: np.ndarray, bucket: np.ndarray | np.uint64) -> np.ndarray:
    """The name of a key in runs, of its bytes that are shuffled and its bucket; long runs of all tasks must share it."""
    return mix((rest & U((1 << 8 * KEY_BYTES) - 1)) * U(0x9E3779B97F4A7C15) + bucket)


PACKED = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("keys", pa.binary()), ("docs", pa.binary()), ("lens", pa.binary())])


def _packed_keys(docs: DataFrame, common: np.ndarray, buckets: int, singles: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> Iterator[pa.RecordBatch]:
            for r in _emit(np.array(ids, np.int64), sets, common, buckets, singles):
                yield pa.RecordBatch.from_pylist([r], schema=PACKED)

        ids: list[int] = []
        sets: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for doc, own in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1)), strict=True):
                if not len(own) or doc is None:
                    continue
                ids.append(doc)
                sets.append(own)
                size += len(own)
                if size * 6 >= CHUNK_BYTES:
                    yield from flush()
                    ids, sets, size = [], [], 0
                    give_back()
        if ids:
            yield from flush()
        give_back()

    return docs.select("doc_id", "text").mapInArrow(run, "bucket int, kind int, keys binary, docs binary, lens binary")


MET = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of documents of one key (kind 0), members ``b`` of long runs with the run's smallest ``a`` (1), loose documents (2)."""

    def rows(kind: int, key: np.ndarray, a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(a), 1 << 18):
            cut = slice(lo, lo + (1 << 18))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a[cut]), kind, np.int32)), pa.array(key[cut].view(np.int64)), pa.array(a[cut]), pa.array(b[cut])], schema=MET)

    held: dict[int, list[tuple[np.ndarray, np.ndarray, int]]] = {}
    for batch in batches:
        for r in batch.to_pylist():
            docs = np.frombuffer(r["docs"], "<i8")
            if r["kind"] in (0, 3):
                narrow = np.frombuffer(r["keys"], np.uint8).reshape(-1, KEY_BYTES)
                wide = np.zeros((len(narrow), 8), np.uint8)
                wide[:, :KEY_BYTES] = narrow
                held.setdefault(r["bucket"], []).append((wide.view("<u8").ravel(), np.repeat(docs, np.frombuffer(r["lens"], "<u4")), r["kind"]))
            elif r["kind"] == 1:
                lens = np.frombuffer(r["lens"], "<i4")
                yield from rows(1, np.repeat(np.frombuffer(r["keys"], "<u8"), lens), np.repeat(docs[np.cumsum(lens) - lens], lens), docs)
            else:
                yield from rows(2, np.zeros(len(docs), np.uint64), docs, docs)
    for bucket in list(held):
        entries = held.pop(bucket)
        key, doc = np.concatenate([k for k, _, _ in entries]), np.concatenate([d for _, d, _ in entries])
        long = np.repeat([kind == 3 for _, _, kind in entries], [len(k) for k, _, _ in entries])
        order = np.argsort(key, kind="stable")
        key, doc, long = key[order], doc[order], long[order]
        same = np.zeros(len(key) + 1, bool)
        same[1:-1] = key[1:] == key[:-1]
        inside = same[:-1] | same[1:]
        key, doc, long = key[inside], doc[inside], long[inside]
        if not len(key):
            continue
        order = np.lexsort((doc, key))
        key, doc, long = key[order], doc[order], long[order]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        lens = np.diff(np.append(starts, len(key)))
        wide = (lens > RUN) | np.logical_or.reduceat(long, starts)
        run = np.repeat(wide, lens)
        yield from rows(1, _key_name(key[run], U(bucket)), np.repeat(doc[starts], lens)[run], doc[run])
        # pairs of a short run: each document with the ones 1, 2, ... places after it
        left = np.repeat(starts + lens, lens) - np.arange(len(key)) - 1
        left[run] = 0
        for step in range(1, RUN):
            at = np.flatnonzero(left >= step)
            other = doc[at + step]
            apart = doc[at] != other
            yield from rows(0, np.zeros(int(apart.sum()), np.uint64), doc[at][apart], other[apart])
    give_back()


def allowed(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` whose sizes and parity sketches allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = np.asarray(batch.column(2)), np.asarray(batch.column(4))
            keep = 4 * np.minimum(n, m) >= 3 * np.maximum(n, m)
            left, right = _Sketches(batch.column(3)), _Sketches(batch.column(5))
            width = np.minimum(left.width, right.width)
            for w, v in {*zip(left.width[keep].tolist(), right.width[keep].tolist(), strict=True)}:
                at = np.flatnonzero(keep & (left.width == w) & (right.width == v))
                for some in (at[i : i + 4096] for i in range(0, len(at), 4096)):
                    k = int(width[some[0]])
                    apart = np.bitwise_count(left.rows(some, k) ^ right.rows(some, k)).sum(axis=1, dtype=np.int64)
                    keep[some] = 7 * apart <= n[some] + m[some]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], names=["a", "b"])
            del batch, left, right
            give_back()

    a, b = (sketches.select(F.col("doc_id").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}")) for x in "ab")
    return pairs.join(a, "a").join(b, "b").select("a", "b", "n_a", "sketch_a", "n_b", "sketch_b").mapInArrow(run, "a bigint, b bigint").distinct()


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` that link, decided on whole texts of ``docs``; ``pairs`` is a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            keep = []
            for i, other in enumerate(shingle_sets(batch.column(4))):
                key = (a[i], batch.column(2)[i].as_py())
                if key != last:
                    last, own = key, next(shingle_sets(batch.column(3).slice(i, 1)))
                if linked(own, other):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], pa.int64()), pa.array([b[i] for i in keep], pa.int64())], names=["a", "b"])
            del batch
            give_back()

    involved = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = materialize(docs.join(hint_small(involved), "doc_id", "left_semi").select("doc_id", "text", F.xxhash64("text").alias("k")), "texts")
    second = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    first = second.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"), F.col("k").alias("k_a")), "a")
    return first.select("a", "b", "k_a", "text_a", "text_b").mapInArrow(run, "a bigint, b bigint").distinct()


class _Sketches:
    """A binary column of sketches of several widths."""

    def __init__(self, column: pa.Array):
        column = column.cast(pa.large_binary())
        self.offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
        self.data = np.frombuffer(column.buffers()[2], np.uint8) if len(column) else np.zeros(0, np.uint8)
        self.width = np.diff(self.offsets) // 8

    def rows(self, at: np.ndarray, width: int) -> np.ndarray:
        """The sketches of these rows, all of one width, folded to ``width``."""
        own = int(self.width[at[0]])
        return folded(self.data[self.offsets[at][:, None] + np.arange(8 * own)].view(np.uint64), width)


def _block_pairs(nearest: bool):
    """Pairs of different classes in two blocks whose sizes and sketches allow a link; or only each document's nearest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                # a pair of blocks at a time: only the batch itself is held whole
                sides = []
                for c in (0, 1):
                    fields = batch.column(c).slice(row, 1).flatten().flatten()
                    sides.append((*(np.asarray(f) for f in fields[:3]), _Sketches(fields[3])))
                (da, la, na, sa), (db, lb, nb, sb) = sides
                mine, others = np.arange(len(da)), np.arange(len(db))
                once = np.array_equal(da, db)  # a block with itself
                # sizes within 3/4 of each other are of one band or of neighbouring ones
                for wa in np.unique(sa.width[mine]).tolist():
                    for wb in np.unique(sb.width[others]).tolist():
                        if wa > 2 * wb or wb > 2 * wa:
                            continue
                        width, y = min(wa, wb), others[sb.width[others] == wb]
                        second = sb.rows(y, width)
                        step = max(1, (1 << 21) // (len(y) * width))
                        left = mine[sa.width[mine] == wa]
                        for x in (left[i : i + step] for i in range(0, len(left), step)):
                            apart = np.bitwise_count(sa.rows(x, width)[:, None] ^ second).sum(axis=2, dtype=np.int64)
                            n, m = na[x][:, None], nb[y]
                            i, j = np.nonzero((la[x][:, None] < lb[y] if once else la[x][:, None] != lb[y]) & (7 * apart <= n + m) & (4 * np.minimum(n, m) >= 3 * np.maximum(n, m)))
                            if nearest and len(i):
                                far = apart[i, j] / (na[x[i]] + nb[y[j]])
                                best = []
                                for own in (i, j):
                                    order = np.lexsort((far, own))
                                    best.append(order[np.concatenate([[True], own[order][1:] != own[order][:-1]])])
                                some = np.unique(np.concatenate(best))
                                i, j = i[some], j[some]
                            if len(i):
                                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(da[x[i]], db[y[j]])), pa.array(np.maximum(da[x[i]], db[y[j]]))], names=["a", "b"])
            del batch
            give_back()

    return run


def _relabelled(rows: DataFrame, grown: DataFrame) -> DataFrame:
    """``rows(doc, ...)`` with ``label``: the class of the document so far."""
    now = grown.select(F.col("node").alias("doc"), "component")
    return rows.drop("label").join(now, "doc", "left").withColumn("label", F.coalesce("component", "doc")).drop("component")


def unsettled(met: DataFrame, grown: DataFrame) -> DataFrame:
    """``(key, doc)``: documents to compare, by the groups or long runs in which several classes meet."""
    runs = met.filter("kind = 1").select("key", "a", F.col("b").alias("doc"))
    spread = _relabelled(runs.select("key", "doc"), grown).groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("key")
    open_runs = materialize(runs.join(spread, "key", "left_semi"), "open-runs")
    if not open_runs.limit(1).count():
        return open_runs.select("key", "doc")
    groups = contracted_components(open_runs.select("a", F.col("doc").alias("b"))).select(F.col("node").alias("doc"), F.col("component").alias("group"))
    large = materialize(groups.groupBy("group").agg(F.count("*").alias("m")).filter(F.col("m") > GROUP).select("group"), "large-groups")
    grouped = groups.join(large, "group", "left_anti").select(F.col("group").alias("key"), "doc")
    if not large.limit(1).count():
        return grouped
    inside = groups.join(large, "group", "left_semi").select("doc")
    rest = open_runs.join(inside, "doc", "left_semi").select("key", "doc").distinct()
    # runs of the same documents (each twice hashed, in any order) are one
    same = [F.bit_xor(F.xxhash64("doc", F.lit(i))).alias(f"same{i}") for i in (1, 2)]
    one = rest.groupBy("key").agg(F.count("*").alias("m"), *same).groupBy("m", "same1", "same2").agg(F.min("key").alias("key")).select("key")
    return grouped.unionByName(rest.join(one, "key", "left_semi").select(F.xxhash64("key", F.lit("run")).alias("key"), "doc"))


def cross_pairs(members: DataFrame, sketches: DataFrame, nearest: bool) -> DataFrame:
    """Pairs ``(a, b)`` of different classes among ``members(key, doc, label)`` of one key that size and sketch allow."""
    sizes = members.groupBy("key").agg(F.count("*").alias("m"), F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi")
    many = members.join(sizes.select("key", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks")), "key")
    many = many.join(sketches, F.col("doc") == F.col("doc_id")).withColumn("own", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
    placed = many.select("key", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"), F.struct("doc", "label", "n", "sketch").alias("x"))
    i, j = F.least("own", "other"), F.greatest("own", "other")
    left = F.when(F.col("own") <= F.col("other"), F.col("x"))
    right = F.when(F.col("own") >= F.col("other"), F.col("x"))
    blocks = placed.groupBy("key", i.alias("i"), j.alias("j")).agg(F.collect_list(left).alias("left"), F.collect_list(right).alias("right"))
    return blocks.select("left", "right").mapInArrow(_block_pairs(nearest), "a bigint, b bigint").distinct()


def _common_shingles(described: DataFrame) -> np.ndarray:
    counted = (
        described.filter("hashes IS NOT NULL")
        .select(F.explode(F.arrays_zip("hashes", "counts")).alias("x"))
        .groupBy(F.col("x.hashes").alias("hash"))
        .agg(F.sum("x.counts").alias("seen"))
        .filter(F.col("seen") >= COMMON_FROM)
        .orderBy(F.desc("seen"), "hash")
        .limit(COMMON_SHINGLES)
        .collect()
    )
    common = np.zeros(len(counted), [("hash", np.uint64), ("order", np.int64)])
    common["hash"] = np.array([r.hash for r in counted], np.int64).view(np.uint64)
    common["order"] = np.arange(len(counted))[::-1]  # the most frequent last
    common.sort(order="hash")
    return common


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for every row of ``docs``."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    described = materialize(describe(docs), "sets")
    own = described.filter("hashes IS NULL")
    common = _common_shingles(described)

    # equal sets: one class without pairs
    linkable = own.filter("set_key IS NOT NULL AND doc_id IS NOT NULL")
    firsts = materialize(linkable.groupBy("set_key").agg(F.min("doc_id").alias("label"), F.count("*").alias("m")).filter("m > 1").drop("m"), "firsts")
    copies = materialize(linkable.select("doc_id", "text_key", "set_key").join(firsts, "set_key").filter("doc_id <> label").select("doc_id", "text_key", "label"), "copies")
    again = hint_small(copies.select("doc_id", "text_key").distinct())
    first_docs = docs.withColumn("text_key", F.xxhash64("text")).join(again, ["doc_id", "text_key"], "left_anti").select("doc_id", "text")
    sketches = linkable.select("doc_id", "n", "sketch")

    total = own.agg(F.sum("n")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // (2 * KEYS_A_BUCKET)))

    def found(some: DataFrame, singles: bool) -> DataFrame:
        packed = _packed_keys(some, common, buckets, singles).repartition(buckets, "bucket")
        return materialize(packed.mapInArrow(_met, "kind int, key bigint, a bigint, b bigint"), "met")

    met = found(first_docs, False)
    loose = met.filter("kind = 2").select(F.col("b").alias("doc_id")).distinct()
    if loose.limit(1).count():
        met = met.unionByName(found(first_docs.join(hint_small(loose), "doc_id", "left_semi"), True).filter("kind < 2"))

    pairs = materialize(met.filter("kind < 2 AND a <> b").select("a", "b").distinct(), "pairs")
    tried = materialize(allowed(pairs, sketches), "allowed")
    # an id with several texts ties their classes
    tied = linkable.select("doc_id", "text_key").join(copies, ["doc_id", "text_key"], "left").select("doc_id", F.coalesce("label", "doc_id").alias("label")).distinct()
    tied = materialize(tied, "classes")
    edges = tied.groupBy("doc_id").agg(F.min("label").alias("a"), F.collect_set("label").alias("all")).filter(F.size("all") > 1).select("a", F.explode("all").alias("b"))
    edges = edges.unionByName(materialize(verified(tried, docs), "links"))
    grown = components(edges)

    members = materialize(unsettled(met, grown), "members")
    nearest = bool(members.limit(1).count())
    while members.limit(1).count():
        more = cross_pairs(materialize(_relabelled(members, grown), "members"), sketches, nearest)
        more = materialize(more.join(tried, ["a", "b"], "left_anti"), "pairs")
        links = materialize(verified(more, docs), "links")
        linked_now = bool(links.limit(1).count())
        if linked_now:
            grown = components(links.unionByName(grown.select(F.col("node").alias("a"), F.col("component").alias("b"))))
        if not nearest:  # all that was left has been tried
            break
        nearest = linked_now
        tried = tried.unionByName(more)

    whole = tied.groupBy("doc_id").agg(F.min("label").alias("label")).join(grown, F.col("label") == F.col("node"), "left")
    whole = whole.select(F.col("doc_id").alias("d"), F.coalesce("component", "label").alias("component"))
    return own.join(whole, F.col("doc_id") == F.col("d"), "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
