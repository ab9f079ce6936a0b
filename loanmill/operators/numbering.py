"""Row numbers without bringing the rows into one task."""

from __future__ import annotations

from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


# Files up to which their offsets are sent to every task: some 20 MB of paths and counts.
_FILES_SENT = 100_000


def numbered(written: DataFrame, column: str, after: int = 0) -> DataFrame:
    """Numbers the rows of a written Parquet table `after`+1, `after`+2, ...

    A row's number is the count of rows in earlier files plus its place in its own, so it
    is the same in every retry. Only one count per file passes through the driver.
    """
    file = F.col("_metadata.file_path")
    files = sorted(written.groupBy(file.alias("file")).count().collect())
    starts = accumulate((n for _, n in files), initial=after)
    offsets = pa.table(
        {
            "file": pa.array([f for f, _ in files], pa.string()),
            "start": pa.array(list(starts)[:-1], pa.int64()),
        }
    )
    table = written.sparkSession.createDataFrame(offsets)
    # Beyond that, the join deals both sides by file, which Spark splits where one is large.
    table = F.broadcast(table) if len(files) <= _FILES_SENT else table
    rows = written.select("*", file.alias("file"), F.col("_metadata.row_index").alias("place"))
    return (
        rows.join(table, "file")
        .withColumn(column, F.col("start") + F.col("place") + 1)
        .drop("file", "start", "place")
    )
