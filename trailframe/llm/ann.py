"""Approximate nearest neighbours by inner product over balanced posting lists.

The index maps each vector x to (x, sqrt(M**2 - |x|**2)), scaled by M, so that the nearest by distance is the largest
by inner product (for unit vectors the added component is 0). M is the largest norm, or ``GIANT`` times the 99 % quantile
where single norms are far beyond it; vectors over M are kept in lists of their own that every query meets.

* Centroids: k-means on a bounded sample (``SAMPLE_ROWS``), one for about ``LIST_ROWS`` vectors; lists with more than
  twice the mean share of the sample are split in two until none is. Their number is bounded by about ``MAX_LISTS``,
  so that centroids and their graph fit in each task; beyond that lists have more rows and are cut into sublists.
* Posting lists: a vector goes to its nearest centroid and to those within ``BOUNDARY`` of that distance, at most
  ``REPLICAS`` in all. A list with more than ``SUBLIST`` rows by its share of the sample (near copies cannot be split
  by centroids) is dealt over sublists, and its queries meet each of them: no task holds a whole large list.
* Search: each query walks the centroid graph (best first) and probes the lists whose distance is within ``RATIO`` of
  that of the ``REFERENCE``-th nearest, so that a query on a centroid does not end with one list. A walk whose beam ends before
  the ratio does goes on with a wider one; only a beam of all lists is replaced by one matrix product. A task joins the
  blocks of a list, multiplies them with the list's queries and keeps the best ``k`` of each query over all its lists, so
  a query has one row a task in the shuffle that follows. A query with fewer than k found probes all lists.

Copies of a vector share one entry with their k + 1 smallest ids: a larger id cannot be in a result. Every row is in
the index this way.

Vectors that are null, empty, zero or with null or non-finite components take no part. A shorter vector counts as
filled up with zeros. Scores are double-precision inner products of the original vectors, ties go to the smaller id; a
score that overflows is infinite, one that is no number comes last. Rows that share an id count as one (the smallest
vector); rows with a null id take no part. Fewer candidates than asked give shorter lists; an empty table none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

SAMPLE_ROWS = 20_000
LIST_ROWS = 200
MAX_LISTS = 4096
SUBLIST = 8 * LIST_ROWS
REPLICAS = 4
BOUNDARY = 1.15
BEAM = 96
REFERENCE = 24
RATIO = 1.05
NEIGHBOURS = 24
BLOCK_ROWS = 2048
BUFFER_ROWS = 32_768
GIANT = 4.0


class Centroids:
    """Centroids and the graph over them; lives in the memory of every task."""

    def __init__(self, sample: np.ndarray, lists: int, rows: int = 0, rounds: int = 8, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.points = sample[rng.choice(len(sample), lists, replace=False)].copy()
        for _ in range(rounds):
            near = self._exact(sample)
            sums = np.zeros_like(self.points)
            np.add.at(sums, near, sample)
            sizes = np.bincount(near, minlength=lists)
            used = sizes > 0
            self.points[used] = sums[used] / sizes[used, None]
            # an empty list takes a member of the largest ones
            for hole, big in zip(np.flatnonzero(~used), np.argsort(-sizes), strict=False):
                self.points[hole] = sample[rng.choice(np.flatnonzero(near == big))]
        self.points = np.array(self._balanced(sample, self._exact(sample), max(2, 2 * len(sample) // lists), rng))
        lists = len(self.points)
        share = np.bincount(self._exact(sample), minlength=lists) / len(sample)
        #: Sublists of each list, by its expected rows.
        self.sublists = np.maximum(1, np.ceil(share * rows / SUBLIST)).astype(np.int64)
        self.norms = (self.points**2).sum(axis=1)
        k = min(NEIGHBOURS + 1, lists)
        links = []
        for lo in range(0, lists, 512):
            d = self.norms - 2 * self.points[lo : lo + 512] @ self.points.T
            links.append(np.argpartition(d, k - 1, axis=1)[:, :k])
        near = np.concatenate(links)
        # a few far links keep the graph connected
        self.links = np.concatenate([near, rng.integers(0, lists, (lists, min(8, lists)))], axis=1)
        self.entries = rng.choice(lists, min(lists, 32), replace=False)

    def _balanced(self, sample: np.ndarray, near: np.ndarray, most: int, rng: np.random.Generator) -> list[np.ndarray]:
        """The centroids, those of more than ``most`` sample rows split in two as long as their rows differ."""
        order = np.argsort(near, kind="stable")
        cuts = np.searchsorted(near[order], np.arange(len(self.points) + 1))
        todo = [(self.points[i], order[cuts[i] : cuts[i + 1]]) for i in range(len(self.points))]
        out = []
        while todo:
            point, rows = todo.pop()
            x = sample[rows]
            spread = x.max(axis=0) - x.min(axis=0) if len(rows) > most else np.zeros(1)
            if spread.max() < 1e-9:
                out.append(point)
                continue
            pair = x[rng.choice(len(x), 2, replace=False)]
            for _ in range(4):
                side = ((x - pair[0]) ** 2).sum(axis=1) > ((x - pair[1]) ** 2).sum(axis=1)
                if side.all() or not side.any():  # equal seeds: cut at the middle of the widest component
                    wide = x[:, int(np.argmax(spread))]
                    side = wide > (wide.max() + wide.min()) / 2
                pair = np.array([x[~side].mean(axis=0), x[side].mean(axis=0)])
            todo += [(pair[0], rows[~side]), (pair[1], rows[side])]
        return out

    def _exact(self, x: np.ndarray) -> np.ndarray:
        norms = (self.points**2).sum(axis=1)
        return np.concatenate([np.argmin(norms - 2 * x[i : i + 4096] @ self.points.T, axis=1) for i in range(0, len(x), 4096)])

    def search(self, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """(centroids, distances), nearest first, that a best-first walk finds for each row."""
        # a walk that opens so many centroids sees most of them
        step = self._walk if 8 * beam < len(self.points) else self._ranked
        out = [step(x[i : i + 256], beam) for i in range(0, len(x), 256)]
        return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])

    def _ranked(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        distances = (x**2).sum(axis=1)[:, None] + self.norms - 2 * x @ self.points.T
        beam = min(beam, len(self.points))
        best = np.argpartition(distances, beam - 1, axis=1)[:, :beam]
        near = np.take_along_axis(distances, best, axis=1)
        order = np.argsort(near, axis=1)
        return np.take_along_axis(best, order, axis=1), np.sqrt(np.maximum(np.take_along_axis(near, order, axis=1), 0))

    def _walk(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Best-first over the graph, four centroids of a row at a time; a row holds its best ``beam`` and no more."""
        n, lists = len(x), len(self.points)
        beam, own = min(beam, lists), np.arange(n)[:, None]
        seen = np.zeros((n, lists), bool)
        square = (x**2).sum(axis=1)
        best, near, opened = np.zeros((n, 0), np.int64), np.zeros((n, 0)), np.zeros((n, 0), bool)

        def visit(nodes: np.ndarray) -> None:
            """Take in the nodes (a row each, -1: none) that a row has not met, and keep its nearest."""
            nonlocal best, near, opened
            nodes = np.sort(nodes, axis=1)
            fresh = nodes >= 0
            fresh[:, 1:] &= nodes[:, 1:] != nodes[:, :-1]
            fresh &= ~seen[own, nodes]
            rows, cols = np.nonzero(fresh)
            seen[rows, nodes[rows, cols]] = True
            distance = np.full(nodes.shape, np.inf)
            picked = nodes[rows, cols]
            distance[rows, cols] = square[rows] + self.norms[picked] - 2 * np.einsum("ij,ij->i", x[rows], self.points[picked])
            best, near = np.concatenate([best, nodes], axis=1), np.concatenate([near, distance], axis=1)
            opened = np.concatenate([opened, ~fresh], axis=1)
            if best.shape[1] > beam:
                kept = np.argpartition(near, beam - 1, axis=1)[:, :beam]
                best, near, opened = best[own, kept], near[own, kept], opened[own, kept]

        visit(np.tile(self.entries, (n, 1)))
        while not (opened | ~np.isfinite(near)).all():
            rank = np.where(opened, np.inf, near)
            pick = np.argpartition(rank, min(4, rank.shape[1]) - 1, axis=1)[:, :4]
            open_ = np.isfinite(rank[own, pick])
            opened[own, pick] = True
            visit(np.where(open_[:, :, None], self.links[best[own, pick]], -1).reshape(n, -1))
        order = np.argsort(near, axis=1)
        return best[own, order], np.sqrt(np.maximum(near[own, order], 0))

    def pruned(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, lists) to probe: those within ``RATIO`` of the distance of a row's ``REFERENCE``-th nearest list."""
        lists, beam, todo = len(self.points), BEAM, np.arange(len(x))
        rows, found = [], []
        while len(todo):
            step = self._walk if beam < lists else self._ranked
            late = []
            for lo in range(0, len(todo), 256):
                part = todo[lo : lo + 256]
                order, distance = step(x[part], beam)
                near = distance <= RATIO * distance[:, [min(REFERENCE, distance.shape[1]) - 1]] + 1e-12
                whole = ~near[:, -1] | (beam >= lists)  # the ratio ends within the beam
                i, j = np.nonzero(near & whole[:, None] & np.isfinite(distance))
                rows.append(part[i])
                found.append(order[i, j])
                late.append(part[~whole])
            todo, beam = np.concatenate(late), 2 * beam
        return np.concatenate(rows), np.concatenate(found)


def _floats(column: pa.Array, size: int) -> np.ndarray:
    """Rows of a list column as doubles, filled up with zeros to ``size``."""
    lens = np.asarray(column.value_lengths())
    flat = np.asarray(column.flatten(), np.float64)
    if (lens == size).all():
        return flat.reshape(len(lens), size)
    out = np.zeros((len(lens), size))
    out[np.arange(size) < lens[:, None]] = flat
    return out


def _lifted(x: np.ndarray, largest: float) -> np.ndarray:
    x = x / largest
    return np.concatenate([x, np.sqrt(np.maximum(1 - (x**2).sum(axis=1), 0))[:, None]], axis=1)


def _directed(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1)[:, None]
    return np.concatenate([x / np.linalg.norm(x, axis=1)[:, None], np.zeros((len(x), 1))], axis=1)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(vec_id, v, norm)`` of the vectors that take part."""
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).filter("vec_id IS NOT NULL AND size(v) > 0")
    v = v.filter(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    v = v.withColumn("top", F.array_max(F.transform("v", F.abs))).filter("top > 0")
    # squared after scaling, so that nothing over- or underflows
    norm = F.col("top") * F.sqrt(F.aggregate(F.transform("v", lambda x: x / F.col("top")), F.lit(0.0), lambda s, x: s + x * x))
    return v.groupBy("vec_id").agg(F.min(F.struct("v", norm.alias("norm"))).alias("x")).select("vec_id", "x.v", "x.norm")


def distinct_vectors(vectors: DataFrame, kept: int) -> DataFrame:
    """``(v, norm, ids)``: one row a different vector, with its ``kept`` smallest ids, smallest first."""
    # the limit of rank works before the shuffle too: a vector of very many rows sends ``kept`` of them a task
    keyed = vectors.withColumn("key", F.xxhash64("v"))
    first = keyed.withColumn("n", F.row_number().over(Window.partitionBy("key", "v").orderBy("vec_id"))).filter(F.col("n") <= kept)
    return first.groupBy("key", "v").agg(F.min("norm").alias("norm"), F.sort_array(F.collect_list("vec_id")).alias("ids")).select("v", "norm", "ids")


PLACED = "list int, sub int, kind int, ids binary, counts binary, data binary"
PLACED_ARROW = pa.schema([("list", pa.int32()), ("sub", pa.int32()), ("kind", pa.int32()), ("ids", pa.binary()), ("counts", pa.binary()), ("data", pa.binary())])


def _blocks(batches: Iterator[pa.RecordBatch], centroids: Centroids, largest: float, size: int, giants: int = 1, probes: str = "") -> Iterator[pa.RecordBatch]:
    """Packed rows by list: vectors (kind 1) of the lists they belong to, or queries (kind 0) of the lists they probe (``pruned`` or ``all``).

    Vectors beyond ``largest`` are in the list -1 of ``giants`` sublists.
    """

    def place(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if probes == "all":
            return np.repeat(np.arange(len(x)), len(centroids.points)), np.tile(np.arange(len(centroids.points)), len(x))
        if probes:
            return centroids.pruned(_directed(x))
        lists, distance = (c[:, :REPLICAS] for c in centroids.search(_lifted(x, largest)))
        chosen = distance <= BOUNDARY * distance[:, :1] + 1e-12
        return np.nonzero(chosen)[0], lists[chosen]

    def packed(ids: list[np.ndarray], x: np.ndarray) -> Iterator[pa.RecordBatch]:
        flat, counts = np.concatenate(ids), np.fromiter(map(len, ids), np.int64, len(ids))
        at = np.cumsum(counts) - counts
        if probes:
            row, lst = place(x)
            row, lst = np.concatenate([row, np.arange(len(x))]), np.concatenate([lst, np.full(len(x), -1)])
            many = np.where(lst >= 0, centroids.sublists[lst], giants)
            sub = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
            row, lst = np.repeat(row, many), np.repeat(lst, many)
        else:
            # by the norm that is in use: not over largest, up to rounding
            scaled = np.linalg.norm(x / max(largest, 1e-300), axis=1)
            low = np.flatnonzero(scaled <= 1 + 1e-9)
            row, lst = place(x[low]) if len(low) else (low, low)
            high = np.flatnonzero(scaled > 1 + 1e-9)
            row, lst = np.concatenate([low[row], high]), np.concatenate([lst, np.full(len(high), -1)])
            sub = flat[at][row] * 2654435761 % 4294967296 // 65536 % np.where(lst >= 0, centroids.sublists[lst], giants)
        order = np.lexsort((sub, lst))
        row, lst, sub = row[order], lst[order], sub[order]
        cuts = np.flatnonzero(np.concatenate([[True], (lst[1:] != lst[:-1]) | (sub[1:] != sub[:-1])]))
        rows = []
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(lst)], strict=True):
            for lo in range(a, b, BLOCK_ROWS):
                part = row[lo : min(b, lo + BLOCK_ROWS)]
                n = counts[part]
                own = flat[np.repeat(at[part] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
                rows.append((int(lst[a]), int(sub[a]), int(not probes), own.astype("<i8").tobytes(), n.astype("<i4").tobytes(), x[part].tobytes()))
        for lo in range(0, len(rows), 64):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[lo : lo + 64], strict=True), PLACED_ARROW, strict=True)], schema=PLACED_ARROW)

    held_ids: list[np.ndarray] = []
    held: list[np.ndarray] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column(0)
        held_ids += [np.array([i], np.int64) for i in ids.to_pylist()] if probes else [np.array(i, np.int64) for i in ids.to_pylist()]
        held.append(_floats(batch.column(1), size))
        if len(held_ids) >= BUFFER_ROWS:
            yield from packed(held_ids, np.concatenate(held))
            held_ids, held = [], []
    if held_ids:
        yield from packed(held_ids, np.concatenate(held))


def _scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products summed in one fixed order, so that equal vectors score exactly alike."""
    out = np.zeros(len(q))
    for i in range(q.shape[1]):
        out += q[:, i] * v[:, i]
    return out


def _top(query: np.ndarray, vec: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Rows of the best ``k`` of each query, in order, each vector once."""
    order = np.lexsort((vec, -score, query))
    q, v = query[order], vec[order]
    once = np.ones(len(q), bool)
    once[1:] = (q[1:] != q[:-1]) | (v[1:] != v[:-1])  # equal vectors of a query score alike
    order, q = order[once], q[once]
    return order[np.arange(len(q)) - np.searchsorted(q, q) < k]


class _Best:
    """The best ``k`` of each query that a task has met."""

    def __init__(self, k: int):
        self.k, self.least, self.size = k, {}, 0
        self.pool: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def meet(self, qids: np.ndarray, q: np.ndarray, ids: np.ndarray, counts: np.ndarray, v: np.ndarray) -> None:
        at = np.cumsum(counts) - counts
        m = min(self.k + 1, len(v))
        for lo in range(0, len(qids), step := max(1, (1 << 22) // len(v))):
            own, x = qids[lo : lo + step], q[lo : lo + step]
            near = x @ v.T
            near[np.isnan(near)] = -np.inf
            least = np.maximum(np.partition(near, len(v) - m, axis=1)[:, len(v) - m], [self.least.get(i, -np.inf) for i in own.tolist()])
            i, j = np.nonzero(near >= np.where(np.isfinite(least), least - 1e-9 * np.maximum(1, np.abs(least)), least)[:, None])
            score = _scores(x[i], v[j])
            n = counts[j]
            query, score = np.repeat(own[i], n), np.repeat(score, n)
            found = ids[np.repeat(at[j] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
            other = found != query
            self.pool.append((query[other], found[other], score[other]))
            self.size += int(other.sum())
            if self.size > 1 << 19:
                self.settle()

    def settle(self) -> None:
        if not self.pool:
            return
        query, vec, score = (np.concatenate(c) for c in zip(*self.pool, strict=True))
        kept = _top(query, vec, score, self.k)
        query, vec, score = query[kept], vec[kept], score[kept]
        self.pool, self.size = [(query, vec, score)], 0
        last = np.flatnonzero(np.append(query[1:] != query[:-1], True)) if len(query) else np.zeros(0, np.int64)
        full = np.diff(np.concatenate([[-1], last])) == self.k
        self.least = dict(zip(query[last[full]].tolist(), score[last[full]].tolist(), strict=True))

    def rows(self) -> Iterator[pa.RecordBatch]:
        self.settle()
        if not self.pool or not len(self.pool[0][0]):
            return
        query, vec, score = self.pool[0]
        cuts = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]]))
        ends = pa.array(np.append(cuts, len(query)).astype(np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(query[cuts]), pa.ListArray.from_arrays(ends, pa.array(vec)), pa.ListArray.from_arrays(ends, pa.array(score))], names=["query_id", "ids", "scores"])


def _match(batches: Iterator[pa.RecordBatch], k: int, size: int) -> Iterator[pa.RecordBatch]:
    """The best vectors of each query over the lists of a partition; rows come by list, queries first."""
    best, current = _Best(k), None
    asked: list[tuple[np.ndarray, np.ndarray]] = []
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def meet() -> None:
        if held and asked:
            qids, q = (np.concatenate(c) for c in zip(*asked, strict=True))
            best.meet(qids, q, *(np.concatenate(c) for c in zip(*held, strict=True)))
        held.clear()

    with np.errstate(all="ignore"):
        for batch in batches:
            for i in range(batch.num_rows):
                lst, sub, kind, ids, counts, data = (batch.column(c)[i].as_py() for c in range(6))
                if (lst, sub) != current:
                    meet()
                    current, asked = (lst, sub), []
                x = np.frombuffer(data, np.float64).reshape(-1, size)
                if kind == 0:
                    asked.append((np.frombuffer(ids, "<i8"), x))
                elif asked:
                    held.append((np.frombuffer(ids, "<i8"), np.frombuffer(counts, "<i4").astype(np.int64), x))
                    if sum(len(h[1]) for h in held) >= BLOCK_ROWS:
                        meet()
        meet()
        yield from best.rows()


def _merged(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The best ``k`` of the queries of a partition, ranked; rows come by query."""

    def ranked() -> Iterator[pa.RecordBatch]:
        query, vec, score = (np.concatenate(c) for c in zip(*held, strict=True))
        kept = _top(query, vec, score, k)
        query, vec, score = query[kept], vec[kept], score[kept]
        rank = np.arange(len(query)) - np.searchsorted(query, query) + 1
        yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(rank.astype(np.int32)), pa.array(vec), pa.array(score)], names=["query_id", "rank", "vec_id", "score"])

    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size, last = 0, None
    for batch in batches:
        ids = np.asarray(batch.column(0))
        lens = np.asarray(batch.column(1).value_lengths())
        cuts = np.concatenate([[0], np.cumsum(lens)])
        query, vec, score = np.repeat(ids, lens), np.asarray(batch.column(1).flatten()), np.asarray(batch.column(2).flatten())
        at = 0
        while size + len(query) - at > 1 << 19:  # a query is settled where the next one begins
            heads = np.flatnonzero(np.concatenate([[ids[0] != last], ids[1:] != ids[:-1]]))
            heads = heads[cuts[heads] > at]
            if not len(heads):
                break
            cut = int(cuts[heads[-1]])
            held.append((query[at:cut], vec[at:cut], score[at:cut]))
            yield from ranked()
            held, size, at = [], 0, cut
        held.append((query[at:], vec[at:], score[at:]))
        size += len(query) - at
        last = ids[-1] if len(ids) else last
    if held:
        yield from ranked()


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest vectors found for each row of ``queries`` but itself."""
    spark = vectors.sparkSession
    base = usable(vectors, id_col, vector_col)
    one = materialize(distinct_vectors(base, k + 1), "distinct")
    asked = materialize(usable(queries, id_col, vector_col), "queries")
    facts = one.agg(F.count("*").alias("n"), F.max("norm").alias("largest"), F.percentile_approx("norm", 0.99).alias("usual"), F.max(F.size("v")).alias("size")).first()
    longest = max(facts.size or 0, asked.agg(F.max(F.size("v"))).first()[0] or 0)
    if not facts.n or not longest:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    largest = min(float(facts.largest), GIANT * float(facts.usual))
    giants = 1 if largest == facts.largest else max(1, -(-one.filter(F.col("norm") > largest).count() // SUBLIST))
    share = min(1.0, SAMPLE_ROWS / facts.n)
    usual = one.filter(F.col("norm") <= largest)
    rows = usual.filter(F.pmod(F.xxhash64("v"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) + 1)).orderBy(F.xxhash64("v")).limit(SAMPLE_ROWS).select("v").collect()
    x = np.zeros((max(1, len(rows)), longest))
    for i, r in enumerate(rows):
        x[i, : len(r.v)] = r.v
    sample = _lifted(x, largest)
    centroids = Centroids(sample, max(1, min(MAX_LISTS, len(sample), facts.n // LIST_ROWS)), facts.n)

    listed = materialize(one.select("ids", "v").mapInArrow(lambda it: _blocks(it, centroids, largest, longest, giants), PLACED), "lists")

    def found(some: DataFrame, probes: str) -> DataFrame:
        probing = some.select("vec_id", "v").mapInArrow(lambda it: _blocks(it, centroids, largest, longest, giants, probes), PLACED)
        met = listed.unionByName(probing).repartition("list", "sub").sortWithinPartitions("list", "sub", "kind")
        best = met.mapInArrow(lambda it: _match(it, k, longest), "query_id bigint, ids array<bigint>, scores array<double>")
        return best.repartition("query_id").sortWithinPartitions("query_id").mapInArrow(lambda it: _merged(it, k), "query_id bigint, rank int, vec_id bigint, score double")

    first = materialize(found(asked, "pruned"), "nearest")
    full = first.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"))
    short = materialize(asked.join(full, "vec_id", "left_anti"), "short")
    if not short.limit(1).count():
        return first
    again = found(short, "all")
    return first.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(again)
