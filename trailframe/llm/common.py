"""Helpers shared by the corpus operators: tables, shared scratch space, graph components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructType

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: Rows and bytes of a side that may be broadcast; sides are counted before the hint is given.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col: Column | str) -> Column:
    """A-Z lower-cased, every other character left alone."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    A local session (tests on one machine) that names none gets a temporary one; a cluster must name it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        kept = spark.sparkContext._jsc.sc().getCheckpointDir()
        if kept.isDefined():
            found = kept.get()
        elif spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
            found = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found.scratch_path = path
    return found


def discard(*written: DataFrame) -> None:
    """Delete tables of ``materialize`` that nothing to come reads."""
    for df in written:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def give_back() -> None:
    """Return freed memory of a Python worker to the system: workers live on between tasks, beside the executor's heap."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def hint_small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint only when a count of rows and bytes proves the side small; else the plain side for a shuffle join."""
    wide = [f.name for f in df.schema.fields if isinstance(f.dataType, (StringType, BinaryType))]
    if any(isinstance(f.dataType, (ArrayType, MapType, StructType)) for f in df.schema.fields):
        raise ValueError("only flat tables are measured")
    width = F.lit(16 + 8 * len(df.columns))
    for c in wide:
        width = width + F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0))
    size = df.limit(BROADCAST_ROWS + 1).agg(F.count("*").alias("rows"), F.coalesce(F.sum(width), F.lit(0)).alias("bytes")).first()
    return F.broadcast(df) if size.rows <= BROADCAST_ROWS and size.bytes <= most else df


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)``: ``(node, component)`` with the smallest reachable node.

    Each round takes the smallest label among neighbours and then follows one pointer (label of the
    label), so chains halve; every round is a written table. Labels only shrink, and the loop ends when
    no label moved. Only nodes that have an edge appear. A node with very many edges is aggregated
    map-side before its shuffle; the joins on it are plain equi-joins that adaptive execution may split.
    """
    edges = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a <> b")
    both = materialize(edges.union(edges.select("b", "a")).distinct(), "edges")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component"))
    written = materialize(labels, "labels")
    labels = written
    while True:
        near = (
            both.join(labels, both.b == labels.node)
            .groupBy("a")
            .agg(F.min("component").alias("near"))
        )
        stepped = labels.join(near, labels.node == near.a).select(
            "node", F.col("component").alias("before"), F.least("component", "near").alias("component")
        )
        stepped = materialize(stepped, "labels")
        up = stepped.select(F.col("node").alias("up"), F.col("component").alias("above"))
        jumped = stepped.join(up, stepped.component == up.up).select(
            "node", F.least("component", "above").alias("component"), (F.least("component", "above") != F.col("before")).alias("moved")
        )
        jumped = materialize(jumped, "labels")
        discard(written, stepped)
        written, labels = jumped, jumped.select("node", "component")
        if jumped.filter("moved").limit(1).count() == 0:
            discard(both)
            return labels


def contracted_components(edges: DataFrame) -> DataFrame:
    """``components`` of many edges on few nodes: first of one edge a node, then of what still joins different ones."""
    edges = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    found = components(edges.groupBy("b").agg(F.min("a").alias("a")))
    la, lb = (found.select(F.col("node").alias(x), F.col("component").alias(f"l{x}")) for x in "ab")
    rest = edges.join(la, "a", "left").join(lb, "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")).filter("a <> b").distinct()
    rest = materialize(rest, "edges")
    discard(edges)
    if not rest.limit(1).count():
        return found
    more = materialize(components(rest), "components")
    up = more.select(F.col("node").alias("up"), F.col("component").alias("above"))
    joined = found.join(up, F.col("component") == F.col("up"), "left").select("node", F.coalesce("above", "component").alias("component"))
    return joined.unionByName(more.join(found.select("node"), "node", "left_anti"))
