"""A trie of conversation prefixes, and what sharing each prefix would save, rolled up by pointer jumping.

A node is a distinct sequence of first turns. Its key is the depth and the XOR of one 128-bit hash a turn (of the
turn's place, role and text), so the key of a parent is the child's without the last turn, and the prefixes of a very
long conversation are found block by block: turns are dealt out by range of (conversation, turn), each block is
numbered and folded by itself, and blocks hand on their sums. Leaves and savings reach all ancestors in
doubling rounds: after round k a node holds what lies less than 2^k below it and points to its ancestor 2^k above.

Defined results: null role and text count as empty. A null turn comes first; equal turns are ordered by role, then by
the digest of role and text. Rows with a null conversation id belong to no conversation. Repeated rows are repeated
turns. Other columns are ignored; an empty table gives no rows. Remainders of negative ids are those of SQL. Two
different prefixes have one key with a chance of 2^-128 a pair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize

KEY = ["x", "y", "depth"]
FAMILY = 20
HEADS = 4
#: Ids of one piece of a list of members; pieces bound what a task holds of a list.
PIECE_BITS = 8


def _no_null(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def dealt_turns(conversations: DataFrame) -> DataFrame:
    """Turns in order, dealt out by range: ``(conv_id, turn, role, digest, row, words, pid)``, ``pid`` ascending with the order."""
    role, text = _no_null("role"), _no_null("text")
    turns = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"),
        F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)).alias("digest"),
        F.size(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")).cast("long").alias("words"),
        F.monotonically_increasing_id().alias("row"),  # rows that are equal in all else can still be dealt out
    )
    dealt = turns.repartitionByRange("conv_id", "turn", "role", "digest", "row")
    return materialize(dealt.withColumn("pid", F.spark_partition_id()), "turns")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations with their rebuilt length, rebuilt turns ``(conv_id, pid, place, digest, words, last)``)."""
    turns = dealt_turns(conversations)
    blocks = turns.groupBy("conv_id", "pid").agg(F.count("*").alias("rows"))
    # a row for each conversation and range that it reaches into
    before = F.coalesce(F.sum("rows").over(Window.partitionBy("conv_id").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = materialize(blocks.withColumn("before", before), "blocks")
    sizes = blocks.groupBy("conv_id").agg(F.sum("rows").alias("own"))
    heads = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    convs = sizes.select("conv_id", "own", heads.alias("h"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"))
    convs = convs.join(sizes.select(F.col("conv_id").alias("base"), F.col("own").alias("base_own")), "base", "left")
    taken = F.least("h", F.coalesce("base_own", F.lit(0)))
    convs = convs.select("conv_id", "base", "h", taken.alias("taken"), (taken + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length"))
    convs = materialize(convs, "convs")

    in_block = Window.partitionBy("conv_id", "pid").orderBy("turn", "role", "digest", "row")
    placed = turns.join(blocks.select("conv_id", "pid", "before").join(convs.drop("base"), "conv_id"), ["conv_id", "pid"])
    placed = placed.withColumn("at", F.col("before") + F.row_number().over(in_block) - 1)
    tails = placed.filter("at >= h").select("conv_id", "pid", (F.col("at") - F.col("h") + F.col("taken")).alias("place"), "digest", "words", "length")
    firsts = placed.filter(f"conv_id % {FAMILY} = 0").filter(f"at < {HEADS - 1}").select(F.col("conv_id").alias("base"), "at", "digest", "words")
    lent = convs.filter("taken > 0").join(firsts, "base").filter("at < taken").select("conv_id", F.lit(-1).alias("pid"), F.col("at").alias("place"), "digest", "words", "length")
    rows = tails.unionByName(lent).withColumn("last", F.col("place") + 1 == F.col("length")).drop("length")
    rows.scratch_path, convs.blocks = turns.scratch_path, blocks
    return convs, rows


def prefixes(turns: DataFrame) -> DataFrame:
    """``(conv_id, depth, x, y, px, py, words, last)``: the key of each prefix that ends with a turn, and its parent's."""
    hashed = turns.select("conv_id", "pid", "place", "words", "last", F.xxhash64(F.lit(1), "place", "digest").alias("hx"), F.xxhash64(F.lit(2), "place", "digest").alias("hy"))
    so_far = Window.partitionBy("conv_id", "pid").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    folded = materialize(hashed.withColumn("x", F.bit_xor("hx").over(so_far)).withColumn("y", F.bit_xor("hy").over(so_far)), "folded-turns")
    earlier = Window.partitionBy("conv_id").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    blocks = folded.groupBy("conv_id", "pid").agg(F.bit_xor("hx").alias("bx"), F.bit_xor("hy").alias("by"))
    carried = blocks.select("conv_id", "pid", *[F.coalesce(F.bit_xor(b).over(earlier), F.lit(0)).alias(c) for b, c in (("bx", "cx"), ("by", "cy"))])
    x, y = F.col("x").bitwiseXOR(F.col("cx")), F.col("y").bitwiseXOR(F.col("cy"))
    found = folded.join(carried, ["conv_id", "pid"]).select(
        "conv_id", (F.col("place") + 1).cast("long").alias("depth"), x.alias("x"), y.alias("y"), x.bitwiseXOR(F.col("hx")).alias("px"), y.bitwiseXOR(F.col("hy")).alias("py"), "words", "last"
    )
    found.scratch_path = folded.scratch_path
    return found


def _list_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's comma-joined pieces; the rows of a node follow one another, so nothing is held but the running hash."""
    key, running, done = None, None, []

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=[*KEY, "ends_sha256"])

    for batch in batches:
        for *node, ids in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if node == key:
                running.update(b"," + ids.encode())
                continue
            if key is not None:
                done.append((*key, running.hexdigest()))
            key, running = node, hashlib.sha256(ids.encode())
        if len(done) > 10_000:
            yield out()
            done = []
    if key is not None:
        done.append((*key, running.hexdigest()))
    if done:
        yield out()


def end_digests(ends: DataFrame) -> DataFrame:
    """``(x, y, depth, ends_sha256)`` of ``ends(x, y, depth, conv_id)``: the hash of each node's ids in ascending order.

    Ids are joined within pieces of neighbouring ids before they are dealt out by node. The hash itself takes a node's
    pieces one after the other in one task, which holds one batch of them.
    """
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    pieces = ends.groupBy(*KEY, F.shiftright("conv_id", PIECE_BITS).alias("piece")).agg(ids.alias("ids"))
    ordered = pieces.repartition(*KEY).sortWithinPartitions(*KEY, "piece").select(*KEY, "ids")
    return ordered.mapInArrow(_list_digests, "x bigint, y bigint, depth bigint, ends_sha256 string")


def rolled_up(nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``leaves`` and ``saved`` summed over each node's subtree.

    ``nodes`` has x, y, depth, px, py (key of the parent; depth is one less), leaves and saved. As many rounds as the
    logarithm of the greatest depth; nodes without an ancestor that far above take part in no join of pointers.
    """
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    state, step = nodes.withColumnsRenamed({"px": "jx", "py": "jy"}), 1
    written: DataFrame | None = None
    while step < deepest:
        far = state.filter(F.col("depth") > step)
        more = far.groupBy(F.col("jx").alias("x"), F.col("jy").alias("y"), (F.col("depth") - step).alias("depth")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        up = state.select(F.col("x").alias("jx"), F.col("y").alias("jy"), (F.col("depth") + step).alias("depth"), F.col("jx").alias("next_x"), F.col("jy").alias("next_y"))
        farther = state.filter(F.col("depth") > 2 * step).join(up, ["jx", "jy", "depth"]).drop("jx", "jy").withColumnsRenamed({"next_x": "jx", "next_y": "jy"})
        stepped = state.filter(F.col("depth") <= 2 * step).unionByName(farther).join(more, KEY, "left")
        stepped = stepped.withColumns({c: F.col(c) + F.coalesce(f"more_{c}", F.lit(0)) for c in ("leaves", "saved")}).drop("more_leaves", "more_saved")
        state = materialize(stepped, "rolled-up")
        if written is not None:
            discard(written)
        written, step = state, 2 * step
    return state.drop("jx", "jy")


def trie(conversations: DataFrame) -> DataFrame:
    """A row for each node, the root included."""
    convs, turns = rebuilt(conversations)
    every = prefixes(turns)
    nodes = every.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("px").alias("px"), F.min("py").alias("py"), F.min("words").alias("words"))
    nodes = materialize(nodes, "nodes")
    ends = every.filter("last").select(*KEY, "conv_id").unionByName(convs.filter("length = 0").select(*[F.lit(0).cast("long").alias(k) for k in KEY], "conv_id"))
    digests = materialize(end_digests(ends), "ends")
    first, members = convs.agg(F.min("conv_id"), F.count("*")).first()  # the root's row

    parent = {"x": F.col("px"), "y": F.col("py"), "depth": F.col("depth") - 1}
    children = nodes.filter("depth > 1").groupBy(*[c.alias(k) for k, c in parent.items()]).agg(F.count("*").alias("n_children"))
    own = nodes.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    own = own.withColumns({"leaves": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("words")}).drop("words")
    # children of the root, whose number grows with the input, meet it without a join
    above = nodes.select(F.col("x").alias("px"), F.col("y").alias("py"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"))
    below = own.filter("depth > 1").join(above, ["px", "py", "depth"])
    top = own.filter("depth = 1").withColumn("parent_conv_id", F.lit(first).cast("long"))
    linked = materialize(below.unionByName(top), "linked-nodes")
    root = linked.agg(F.count_if(F.col("depth") == 1).alias("n_children"), F.greatest(F.coalesce(F.sum("leaves"), F.lit(0)), F.lit(1)).alias("leaves"), F.coalesce(F.sum("saved"), F.lit(0)).alias("saved"))
    root = root.select(*[F.lit(0).cast("long").alias(k) for k in KEY], F.lit(first).cast("long").alias("conv_id"), F.lit(members).cast("long").alias("n_convs"), "n_children", "leaves", "saved", F.lit(None).cast("long").alias("parent_conv_id"))
    rolled = rolled_up(linked).unionByName(root.filter("n_convs > 0")).join(digests, KEY, "left")
    found = materialize(
        rolled.select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
            F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
        ), "trie",
    )
    discard(turns, convs, convs.blocks, every, nodes, digests, linked)
    return found


SQL = r"""
WITH own AS (
  SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS seq
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
bits AS (
  SELECT conv_id, seq, list_concat([4294967295::BIGINT], flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda d: list_concat([ascii(d)::BIGINT], list_transform(range(8), lambda i: -1::BIGINT))))) AS codes FROM own),
headed AS (
  SELECT conv_id, seq, (4294967295 - list_reduce(codes, lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) ELSE xor(c >> 1, (c & 1) * 3988292384) END)) % 4 AS h FROM bits),
rebuilt AS (
  SELECT a.conv_id, list_concat(coalesce(b.seq[1:a.h], []), a.seq[a.h + 1:]) AS seq FROM headed a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 20),
prefixes AS (SELECT conv_id, len(seq) AS size, seq, unnest(range(0, len(seq) + 1)) AS depth FROM rebuilt),
nodes AS (
  SELECT seq[1:depth] AS prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (size = depth), '') AS ends
  FROM prefixes GROUP BY ALL),
linked AS (
  SELECT n.*, p.conv_id AS parent_conv_id, coalesce(c.n_children, 0) AS n_children,
    CASE WHEN n.depth = 0 THEN 0 ELSE (n.n_convs - 1) * len(regexp_extract_all(n.prefix[n.depth].text, '[^\x20\x09-\x0D]+')) END AS saved
  FROM nodes n LEFT JOIN nodes p ON n.depth > 0 AND p.prefix = n.prefix[1:n.depth - 1]
  LEFT JOIN (SELECT prefix[1:depth - 1] AS prefix, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL) c ON c.prefix = n.prefix),
above AS (SELECT prefix, n_children, saved, unnest(range(0, depth + 1)) AS up FROM linked),
sums AS (SELECT prefix[1:up] AS prefix, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM above GROUP BY ALL)
SELECT conv_id, depth::BIGINT AS depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, sha256(ends) AS ends_sha256
FROM linked JOIN sums USING (prefix)
"""
