"""Removal of repeated byte strings with suffix arrays built by two-stage sorting.

A byte is removed if some ``LENGTH``-byte string over it also starts anywhere else in the corpus.

1. Anchors. Of the ``GRAM``-byte grams in a ``LENGTH``-byte string the one with the least hash is its
   anchor, so equal strings have equal anchors at equal offsets. Consecutive starts with one anchor form a
   context: the bytes that their strings cover. Only anchors that occur at least twice matter; they are found
   by a shuffle of packed hashes. Copies of a context inside a task go on as one entry with a count of two.
2. Contexts. Every different context of such an anchor is cut from its document once and sent to the bucket
   of its anchor. All places where one string occurs meet in one bucket, and no text is sent whole.
3. Suffix arrays. In a bucket the contexts are joined to one text (a context with copies twice). Only the
   suffixes that are smaller than their successors are sorted directly, to ``LENGTH`` bytes; all others are
   induced from them by one scan over the first-byte buckets. Adjacent suffixes with a common prefix of
   ``LENGTH`` bytes or more are repeats.
4. Repeats become byte ranges of documents; ranges of a document are united and cut out.

A bucket holds about ``BUCKET_BYTES`` of input, so tasks stay the same size as the input grows. Equality of
contexts is taken from two 64-bit hashes, everything between different contexts from the bytes themselves.

Null and empty texts have no bytes and keep none. A row is known by a 64-bit hash of its id and text, so rows that share
an id or have none are answered each for itself; repeated rows repeat each other's strings. Extra columns are ignored.
An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .jaccard import U, _powers, mix

LENGTH = 200
GRAM = 32
BUCKET_BYTES = 8 << 20
SEGMENT = 1 << 19
POSITION_BITS = 20

ENTRY = np.dtype([("hash", "<u8"), ("digest", "<u8"), ("doc", "<i8"), ("start", "<i8"), ("count", "<u4"), ("copies", "u1")])


def window_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values."""
    n = len(values)
    rows = -(-n // width)
    full = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    full[:n] = values
    grid = full.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, first start, number of starts, anchor hash, context digest) of texts joined in ``raw``.

    ``raw`` is shorter than 2**POSITION_BITS. Starts are counted within ``raw``.
    """
    n = len(raw)
    if n < LENGTH:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    power, inverse = _powers(1 << 20)
    total = np.concatenate([[U(0)], np.cumsum((raw.astype(np.uint64) + U(1)) * power[:n])])
    grams = mix((total[GRAM:] - total[:-GRAM]) * inverse[: n - GRAM + 1])
    low = U((1 << POSITION_BITS) - 1)
    best = window_min((grams & ~low) | np.arange(len(grams), dtype=np.uint64), LENGTH - GRAM + 1)
    at = (best & low).astype(np.int64)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(at)]
    valid = np.arange(len(at)) + LENGTH <= offsets[doc + 1]
    first = np.ones(len(at), bool)
    first[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1]) | (valid[1:] != valid[:-1])
    starts = np.flatnonzero(first)
    counts = np.diff(np.append(starts, len(at)))
    keep = valid[starts]
    starts, counts = starts[keep], counts[keep]
    ends = starts + counts - 1 + LENGTH
    digest = mix((total[ends] - total[starts]) * inverse[starts] + mix(counts.astype(np.uint64)))
    return doc[starts], starts, counts, grams[at[starts]], digest


def document_anchors(ids: list[int], texts: pa.Array) -> Iterator[np.ndarray]:
    """Entries of all texts of a batch; texts over ``SEGMENT`` bytes are walked in overlapping pieces."""
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    numbers = np.array(ids, np.int64)

    def entries(lo: int, hi: int, bounds: np.ndarray, docs: np.ndarray, begins: np.ndarray) -> np.ndarray:
        doc, start, count, anchor, digest = anchors(raw[lo:hi], bounds)
        out = np.zeros(len(doc), ENTRY)
        out["hash"], out["digest"], out["doc"], out["start"], out["count"], out["copies"] = anchor, digest, docs[doc], start + lo - begins[doc], count, 1
        return out

    doc = 0
    while doc < len(texts):
        if offsets[doc + 1] - offsets[doc] > SEGMENT:
            for lo in range(offsets[doc], offsets[doc + 1], SEGMENT):
                hi = min(lo + SEGMENT + LENGTH - 1, offsets[doc + 1])
                yield entries(lo, hi, np.array([0, hi - lo]), numbers[doc : doc + 1], offsets[doc : doc + 1])
            doc += 1
            continue
        stop = max(doc + 1, int(np.searchsorted(offsets, offsets[doc] + SEGMENT, "right")) - 1)
        yield entries(offsets[doc], offsets[stop], offsets[doc : stop + 1] - offsets[doc], numbers[doc:stop], offsets[doc:stop])
        doc = stop


def _groups(*keys: np.ndarray) -> np.ndarray:
    """True where a new combination of sorted keys begins."""
    first = np.ones(len(keys[0]), bool)
    first[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return first


def _anchor_rows(docs: DataFrame, buckets: int) -> DataFrame:
    """Packed entries by bucket, and (bucket -1) the ranges of contexts that a task itself has twice."""
    schema = pa.schema([("bucket", pa.int32()), ("entries", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> Iterator[pa.RecordBatch]:
            e = np.concatenate(held)
            e = e[np.lexsort((e["start"], e["doc"], e["digest"], e["hash"]))]
            starts = np.flatnonzero(_groups(e["hash"], e["digest"]))
            sizes = np.diff(np.append(starts, len(e)))
            twice = np.repeat(sizes > 1, sizes)
            if twice.any():
                yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([e[twice].tobytes()], pa.binary())], schema=schema)
            e = e[starts]
            e["copies"] = np.minimum(sizes, 2)
            bucket = (e["hash"] % U(buckets)).astype(np.int32)
            order = np.lexsort((e["doc"], bucket))
            e, bucket = e[order], bucket[order]
            cuts = np.flatnonzero(_groups(bucket))
            rows = [e[a:b].tobytes() for a, b in zip(cuts, [*cuts[1:], len(e)], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts]), pa.array(rows, pa.binary())], schema=schema)

        held, size = [], 0
        for batch in batches:
            for e in document_anchors(batch.column(0).to_pylist(), batch.column(1)):
                held.append(e)
                size += len(e)
                if size > 500_000:
                    yield from flush()
                    held, size = [], 0
        if size:
            yield from flush()

    return docs.mapInArrow(run, "bucket int, entries binary")


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> dict[int, list[dict]]:
    held: dict[int, list[dict]] = {}
    for batch in batches:
        for r in batch.to_pylist():
            held.setdefault(r["bucket"], []).append(r)
    return held


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of anchors that occur twice or more; ``owner`` marks one place a different context."""
    for bucket, rows in _by_bucket(batches).items():
        e = np.concatenate([np.frombuffer(r["entries"], ENTRY) for r in rows])
        e = e[np.lexsort((e["start"], e["doc"], e["digest"], e["hash"]))]
        starts = np.flatnonzero(_groups(e["hash"]))
        total = np.add.reduceat(e["copies"].astype(np.int64), starts)
        e = e[np.repeat(total > 1, np.diff(np.append(starts, len(e))))].copy()
        if not len(e):
            continue
        starts = np.flatnonzero(_groups(e["hash"], e["digest"]))
        copies = np.minimum(np.add.reduceat(e["copies"].astype(np.int64), starts), 2)
        e["copies"] = np.repeat(copies, np.diff(np.append(starts, len(e))))
        yield pa.RecordBatch.from_arrays(
            [pa.array([bucket], pa.int32()), pa.array([e.tobytes()], pa.binary()), pa.array([e[starts].tobytes()], pa.binary())], names=["bucket", "members", "owners"]
        )


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than their successors; the last position counts as not."""
    n = len(text)
    differs = np.flatnonzero(text[1:] != text[:-1])
    nxt = np.searchsorted(differs, np.arange(n))
    known = nxt < len(differs)
    out = np.zeros(n, bool)
    at = differs[nxt[known]]
    out[known] = text[at + 1] > text[at]
    return out


def cut_contexts(text: bytes, entries: np.ndarray) -> list[tuple[int, bytes]]:
    """(positions to sort, bytes) of contexts of one document, each up to a suffix that is sorted directly."""
    padded = np.frombuffer(text + b"\x00\xff" + b"\x00" * LENGTH, np.uint8)
    small = np.flatnonzero(smaller_than_next(padded[: len(text) + 2]))
    last = entries["start"] + entries["count"].astype(np.int64) - 1
    stop = small[np.searchsorted(small, last)]
    return [(int(e - s + 1), padded[s : e + LENGTH].tobytes()) for s, e in zip(entries["start"].tolist(), stop.tolist(), strict=True)]


def two_stage_order(text: np.ndarray, live: np.ndarray, small: np.ndarray) -> np.ndarray:
    """Live positions in the order of their suffixes (to LENGTH bytes).

    ``small``: suffixes that are smaller than their successors. They are sorted directly; each other live
    position must be followed by a live one, and is placed when the scan passes its successor.
    """
    direct = np.flatnonzero(live & small)
    view = np.lib.stride_tricks.as_strided(text, (len(text) - LENGTH + 1, LENGTH), (1, 1))
    keys = np.ascontiguousarray(view[direct]).view(f"S{LENGTH}").ravel()
    direct = direct[np.argsort(keys, kind="stable")]
    bounds = np.searchsorted(text[direct], np.arange(257))
    placed: list[list[np.ndarray]] = [[] for _ in range(256)]
    induced = live & ~small
    order: list[np.ndarray] = []

    def pass_on(scanned: np.ndarray, byte: int) -> np.ndarray:
        """Places the induced predecessors; returns those that begin with ``byte`` as well."""
        before = scanned[scanned > 0] - 1
        before = before[induced[before]]
        first = text[before]
        for c in np.unique(first):
            if c != byte:
                placed[c].append(before[first == c])
        return before[first == byte]

    for byte in range(256):
        wave = np.concatenate(placed[byte]) if placed[byte] else np.zeros(0, np.int64)
        while len(wave):
            order.append(wave)
            wave = pass_on(wave, byte)
        own = direct[bounds[byte] : bounds[byte + 1]]
        if len(own):
            order.append(own)
            pass_on(own, byte)
    return np.concatenate(order) if order else np.zeros(0, np.int64)


def common_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray, limit: int = LENGTH) -> np.ndarray:
    """Length of the common prefix of suffixes a and b, up to ``limit`` (a multiple of 8), in steps of 8 bytes."""
    words = np.lib.stride_tricks.as_strided(text, (len(text) - 7, 8), (1, 1))
    out = np.zeros(len(a), np.int64)
    going = np.arange(len(a))
    for step in range(0, limit, 8):
        x = np.ascontiguousarray(words[a[going] + step]).view(np.uint64).ravel()
        y = np.ascontiguousarray(words[b[going] + step]).view(np.uint64).ravel()
        going = going[x == y]
        out[going] = step + 8
        if not len(going):
            break
    return out


def repeated_ranges(contexts: list[tuple[int, int, int, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, first, last) ranges of starts whose strings repeat, from (starts, copies, positions, bytes)."""
    pieces, begin, live_n, starts_n, of = [], [], [], [], []
    at = 0
    for i, (count, copies, positions, data) in enumerate(contexts):
        for _ in range(copies):
            pieces.append(data)
            begin.append(at)
            live_n.append(positions)
            starts_n.append(count)
            of.append(i)
            at += len(data)
    text = np.frombuffer(b"".join(pieces) + b"\x00" * 8, np.uint8)
    begin, live_n, starts_n, of = (np.array(x, np.int64) for x in (begin, live_n, starts_n, of))
    owner = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(text))))
    inside = np.arange(len(text)) - begin[owner]
    live = inside < live_n[owner]
    # a context ends at a suffix that is sorted directly; runs before it take its type
    small = np.zeros(len(text), bool)
    step = np.zeros(len(text), np.int8)
    step[:-1] = np.sign(text[1:].astype(np.int16) - text[:-1].astype(np.int16))
    step[begin + live_n - 1] = 1
    known = np.flatnonzero(step)
    nxt = np.searchsorted(known, np.arange(len(text)))
    ok = nxt < len(known)
    small[ok] = step[known[nxt[ok]]] > 0
    order = two_stage_order(text, live, small)
    order = order[inside[order] < starts_n[owner[order]]]
    equal = common_prefix(text, order[:-1], order[1:]) >= LENGTH
    hit = np.zeros(len(text), bool)
    hit[order[:-1][equal]] = True
    hit[order[1:][equal]] = True
    found = np.flatnonzero(hit)
    context, start = of[owner[found]], inside[found]
    pairs = np.unique(context << 32 | start)
    context, start = pairs >> 32, pairs & 0xFFFFFFFF
    if not len(pairs):
        return context, start, start
    first = np.ones(len(pairs), bool)
    first[1:] = pairs[1:] != pairs[:-1] + 1
    heads = np.flatnonzero(first)
    tails = np.append(heads[1:], len(pairs)) - 1
    return context[heads], start[heads], start[tails]


def _cut(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Context bytes of documents, packed by bucket."""
    schema = pa.schema([("bucket", pa.int32()), ("entries", pa.binary()), ("positions", pa.binary()), ("sizes", pa.binary()), ("data", pa.binary())])
    held: dict[int, list[tuple[bytes, int, bytes]]] = {}
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for bucket, rows in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([bucket], pa.int32()), pa.array([b"".join(r[0] for r in rows)], pa.binary()), pa.array([np.array([r[1] for r in rows], "<i4").tobytes()], pa.binary()),
                 pa.array([np.array([len(r[2]) for r in rows], "<i4").tobytes()], pa.binary()), pa.array([b"".join(r[2] for r in rows)], pa.binary())], schema=schema)

    for batch in batches:
        for text, parts in zip(batch.column(0), batch.column(1), strict=True):
            raw = text.as_buffer().to_pybytes()
            e = np.frombuffer(b"".join(parts.as_py()), ENTRY)
            fits = e["start"] + e["count"] - 1 + LENGTH <= len(raw)
            e = e[fits]
            for bucket, one, (positions, data) in zip((e["hash"] % U(buckets)).astype(np.int64).tolist(), e, cut_contexts(raw, e), strict=True):
                held.setdefault(bucket, []).append((one.tobytes(), positions, data))
                size += len(data)
            if size > 24 << 20:
                yield from flush()
                held, size = {}, 0
    yield from flush()


def _sort_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges of documents that the suffix arrays of a partition's buckets mark."""
    for rows in _by_bucket(batches).values():
        contexts, keys = [], []
        for r in rows:
            if r["data"] is None:
                continue
            e, at = np.frombuffer(r["entries"], ENTRY), 0
            for one, positions, n in zip(e, np.frombuffer(r["positions"], "<i4").tolist(), np.frombuffer(r["sizes"], "<i4").tolist(), strict=True):
                contexts.append((int(one["count"]), int(one["copies"]), positions, r["data"][at : at + n]))
                keys.append((int(one["hash"]), int(one["digest"])))
                at += n
        if not contexts:
            continue
        where, first, last = repeated_ranges(contexts)
        ranges: dict[tuple[int, int], list[int]] = {}
        for i, c in enumerate(where.tolist()):
            ranges.setdefault(keys[c], []).append(i)
        for r in rows:
            if r["data"] is not None:
                continue
            e = np.frombuffer(r["entries"], ENTRY)
            picked = [ranges.get(k, ()) for k in zip(e["hash"].tolist(), e["digest"].tolist(), strict=True)]
            n = np.fromiter(map(len, picked), np.int64, len(picked))
            i = np.fromiter((x for p in picked for x in p), np.int64, int(n.sum()))
            start = np.repeat(e["start"], n)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(e["doc"], n)), pa.array(start + first[i]), pa.array(start + last[i] + LENGTH)], names=["doc_id", "begin", "end"])


def _own_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            e = np.frombuffer(r["entries"], ENTRY)
            yield pa.RecordBatch.from_arrays([pa.array(e["doc"]), pa.array(e["start"]), pa.array(e["start"] + e["count"].astype(np.int64) - 1 + LENGTH)], names=["doc_id", "begin", "end"])


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: dict[str, list] = {k: [] for k in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
        for doc, text, begins, ends in zip(batch.column(0).to_pylist(), batch.column(1), *(batch.column(i).to_pylist() for i in (2, 3)), strict=True):
            raw = text.as_buffer().to_pybytes() if text.is_valid else b""
            a, b = np.minimum(np.array(begins or [], np.int64), len(raw)), np.minimum(np.array(ends or [], np.int64), len(raw))
            order = np.argsort(a)
            a, b = a[order], np.maximum.accumulate(b[order]) if len(b) else b
            heads = np.flatnonzero(np.concatenate([[True], a[1:] > b[:-1]])) if len(a) else np.zeros(0, np.int64)
            lo, hi = a[heads], b[np.append(heads[1:], len(a)) - 1] if len(a) else b
            wide = hi > lo
            lo, hi = lo[wide].tolist(), hi[wide].tolist()
            kept = b"".join(raw[x:y] for x, y in zip([0, *hi], [*lo, len(raw)], strict=True))
            for k, v in zip(out, (doc, len(raw), len(raw) - len(kept), len(lo), hashlib.sha256(kept).hexdigest(), kept), strict=True):
                out[k].append(v)
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())]))


def repeats(docs: DataFrame) -> DataFrame:
    """``(doc_id, begin, end)``: byte ranges of ``docs(doc_id, text)`` that repeated strings cover; they may overlap."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_BYTES))
    packed = _anchor_rows(docs, buckets)
    packed = packed.withColumn("at", F.when(F.col("bucket") < 0, -1 - F.pmod(F.xxhash64("entries"), F.lit(buckets))).otherwise(F.col("bucket")).cast("int")).repartition(buckets, "at")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _by_bucket(batches)
        for r in held.pop(-1, []):
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([r["entries"]], pa.binary()), pa.array([None], pa.binary())], names=["bucket", "members", "owners"])
        yield from _repeated([pa.RecordBatch.from_pylist(rows) for rows in held.values()])

    found = materialize(packed.select("bucket", "entries").mapInArrow(gather, "bucket int, members binary, owners binary"), "anchors")

    def owners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                e = np.frombuffer(r["owners"], ENTRY)
                e = e[np.argsort(e["doc"], kind="stable")]
                cuts = np.flatnonzero(_groups(e["doc"]))
                parts = [e[a:b].tobytes() for a, b in zip(cuts, [*cuts[1:], len(e)], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(e["doc"][cuts]), pa.array(parts, pa.binary())], names=["d", "part"])

    wanted = found.filter("bucket >= 0").select("owners").mapInArrow(owners, "d bigint, part binary").groupBy("d").agg(F.collect_list("part").alias("parts"))
    texts = docs.filter(F.octet_length("text") >= LENGTH).join(wanted, F.col("doc_id") == F.col("d")).select("text", "parts")
    cut = texts.mapInArrow(lambda it: _cut(it, buckets), "bucket int, entries binary, positions binary, sizes binary, data binary")
    members = found.filter("bucket >= 0").select("bucket", F.col("members").alias("entries"))
    meet = cut.unionByName(members, allowMissingColumns=True).repartition(buckets, "bucket")
    ranges = "doc_id bigint, begin bigint, end bigint"
    between = meet.mapInArrow(_sort_buckets, ranges)
    within = found.filter("bucket < 0").select(F.col("members").alias("entries")).mapInArrow(_own_ranges, ranges)
    return between.unionByName(within)


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept)``: each text without its repeated bytes."""
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    docs = docs.withColumn("doc_id", F.xxhash64("id", "text"))
    ranges = repeats(docs.select("doc_id", "text")).groupBy(F.col("doc_id").alias("d")).agg(F.collect_list("begin").alias("begins"), F.collect_list("end").alias("ends"))
    whole = docs.join(ranges, F.col("doc_id") == F.col("d"), "left").select(F.col("id").alias("doc_id"), "text", "begins", "ends")
    return whole.mapInArrow(_remove, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
