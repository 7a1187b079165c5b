"""Tables that a job writes for its own later steps, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a local session that names none gets a temporary one, a cluster must name it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, *paths: str) -> None:
    context = spark.sparkContext
    for path in paths:
        p = context._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(context._jsc.hadoopConfiguration()).delete(p, True)


class Rounds:
    """Tables of an iteration: each is written and read back, which cuts its lineage and outlives lost executors; older ones are deleted.

    With ``final``, a boolean column that is never null, the rows for which it is true stay when their table is deleted.
    """

    def __init__(self, spark: SparkSession, name: str, keep: int = 1, final: str | None = None):
        self.spark, self.name, self.keep, self.final, self.paths = spark, name, keep, final, []

    def next(self, df: DataFrame) -> DataFrame:
        path = new_path(self.spark, self.name)
        df.write.option("compression", "zstd").partitionBy(*([self.final] if self.final else [])).parquet(path)
        self.paths.append(path)
        while len(self.paths) > self.keep:
            older = self.paths.pop(0)
            delete(self.spark, f"{older}/{self.final}=false" if self.final else older)
        return self.spark.read.schema(df.schema).parquet(path)


def written(df: DataFrame, name: str) -> DataFrame:
    return Rounds(df.sparkSession, name).next(df)
