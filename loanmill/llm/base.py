"""What the operators share: tables, intermediate tables, word patterns, global order."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loanmill.sources.scratch import Scratch, session_scratch  # noqa: F401

#: A word is a run of anything but these six white-space characters.
SPACES = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_shipped: set[str] = set()
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers of executors, once per application.

    The archive lies with the driver, which serves it to them. Batches hold four megabytes of
    texts then, where the session doesn't say how many; ten thousand long texts take too much
    memory on both sides.
    """
    if spark.conf.get(_BATCH_BYTES, None) is None:
        spark.conf.set(_BATCH_BYTES, str(4 << 20))
    if spark.sparkContext.applicationId not in _shipped:
        root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
        to = os.path.join(tempfile.mkdtemp(prefix="run-"), "loanmill")
        spark.sparkContext.addPyFile(shutil.make_archive(to, "zip", root, "loanmill"))
        _shipped.add(spark.sparkContext.applicationId)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def lower_ascii(text: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def numbered_in_order(
    rows: DataFrame, by: list, scratch: Scratch, name: str, within: str | None = None
) -> DataFrame:
    """Adds `place`, 0, 1, ... in the order of `by`, per value of `within` (its first key).

    Ranges of the order are dealt over the cluster and written; a row's place is its own in
    its range plus the rows of earlier ranges, so no task sees more than its range.
    """
    spread = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    written = scratch.keep(
        rows.repartitionByRange(spread, *by)
        .sortWithinPartitions(*by)
        .select(
            F.struct("*").alias("row"),
            F.spark_partition_id().alias("part"),
            F.monotonically_increasing_id().alias("at"),
        ),
        name,
    )
    group = F.col(f"row.{within}") if within else F.lit(0)
    ranges = written.groupBy(group.alias("group"), "part").agg(
        F.min("at").alias("first"), F.count("*").alias("n")
    )
    earlier = Window.partitionBy("group").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = scratch.keep(
        ranges.select(
            "group", "part", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")
        ),
        f"{name}_ranges",
    )
    return (
        written.withColumn("group", group)
        .join(ranges, ["group", "part"])
        .select("row.*", (F.col("at") - F.col("first") + F.col("before")).alias("place"))
    )
