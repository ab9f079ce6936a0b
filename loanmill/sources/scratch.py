"""Intermediate tables in the shared folder the cluster names for checkpoints."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


def shared_folder(spark: SparkSession) -> str:
    """`spark.checkpoint.dir` of the session; a folder of our own only on a local master."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.conf.get("spark.master", "")
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _own_folder()


class Scratch:
    """A folder of written tables that cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.root = root or f"{shared_folder(spark)}/loanmill-{uuid.uuid4().hex}"

    def inner(self, name: str) -> Scratch:
        return Scratch(self.spark, self.path(name))

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
        """Writes `df` and returns it as read back."""
        writer = df.write.partitionBy(partition_by) if partition_by else df.write
        writer.parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self) -> None:
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self.root)
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_exc) -> None:
        self.drop()


def session_scratch(spark: SparkSession) -> Scratch:
    """Intermediate tables of a lazy result: they go when the application ends."""
    scratch = Scratch(spark)
    folder = spark._jvm.org.apache.hadoop.fs.Path(scratch.root)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(folder)
    files.deleteOnExit(folder)
    return scratch
