"""Line deduplication over levelled sorted runs of line hashes.

A store holds runs: tables of (line hash, documents that hold it, largest doc_id), bucketed
and sorted by the hash. A batch of documents becomes a new run of level 0; `fan` runs of a
level are merged into one of the next, so an entry is rewritten once per level. Batches come
in falling order of doc_id. A line that some run already counts `enough` documents for is
settled: its holder is known and later documents cannot change it, so each batch is
anti-joined with the settled entries, bucket by bucket, before the rest is added.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanmill.llm.base import SPACES, lower_ascii
from loanmill.sources.scratch import Scratch


class LineRuns:
    """Levelled sorted runs of `hash`, `docs`, `last`, kept under the scratch folder."""

    def __init__(self, scratch: Scratch, enough: int, fan: int = 4, buckets: int | None = None):
        self.scratch, self.spark, self.enough, self.fan = scratch, scratch.spark, enough, fan
        self.buckets = buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]

    def names(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def _write(self, entries: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        (
            entries.write.bucketBy(self.buckets, "hash")
            .sortBy("hash")
            .option("path", self.scratch.path(name))
            .saveAsTable(name)
        )
        return name

    def _merged(self, names: list[str]) -> DataFrame:
        # Read by path: a union of bucketed scans takes itself for partitioned by the hash,
        # and its groups then stay apart.
        paths = (self.scratch.path(name) for name in names)
        runs = self.spark.read.schema("hash string, docs long, last long").parquet(*paths)
        return runs.groupBy("hash").agg(F.sum("docs").alias("docs"), F.max("last").alias("last"))

    def add(self, batch: DataFrame) -> None:
        """Adds a batch of (`doc_id`, `hash`), once per document; ids below those before."""
        entries = batch.groupBy("hash").agg(
            F.count("*").alias("docs"), F.max("doc_id").alias("last")
        )
        for name in self.names():
            settled = self.spark.table(name).where(F.col("docs") >= self.enough).select("hash")
            entries = entries.join(settled, "hash", "left_anti")
        self.levels[0].append(self._write(entries))
        self._compact()

    def _compact(self) -> None:
        for depth, level in enumerate(self.levels):
            if len(level) < self.fan:
                break
            merged = self._write(self._merged(level))
            for name in level:
                self.spark.sql(f"DROP TABLE {name}")
            level.clear()
            if depth + 1 == len(self.levels):
                self.levels.append([])
            self.levels[depth + 1].append(merged)

    def repeated(self) -> DataFrame:
        """`hash`, `last` of the lines that enough documents hold."""
        return self._merged(self.names()).where(F.col("docs") >= self.enough).select("hash", "last")

    def forget(self) -> None:
        for name in self.names():
            self.spark.sql(f"DROP TABLE {name}")
        self.levels = [[]]


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_hash(line: Column, shortest: int) -> Column:
    """128-bit digest of the line's key; null where the key is too short to count."""
    key = lower_ascii(F.btrim(line, F.lit(SPACES)))
    return F.when(F.char_length(key) >= shortest, F.md5(key))


def drop_repeated_lines(
    docs: DataFrame,
    scratch: Scratch,
    enough: int = 5,
    shortest: int = 40,
    batches: int = 8,
    fan: int = 4,
) -> DataFrame:
    """`row` (all columns), `lines` (the text split at line feeds) and `kept` (those that stay).

    A key (white space stripped at both ends, A-Z lower-cased) of at least `shortest` code
    points that at least `enough` documents hold loses its lines in all documents but those
    with the largest doc_id holding it. Every row counts as a document, repeated rows too;
    a null doc_id is below all others. A null or empty text is one empty line, which stays.
    An empty table gives no rows.
    """
    digest = F.xxhash64("text")
    hashes = F.transform(_lines(F.col("text")), lambda line: line_hash(line, shortest))
    shares = [i / batches for i in range(1, batches)]
    edges = docs.agg(F.percentile_approx("doc_id", shares, 10_000)).first()[0] or []
    below = [F.when(F.col("doc_id") >= e, 0).otherwise(1) for e in sorted(set(edges))]
    batch = F.coalesce(reduce(lambda a, b: a + b, below, F.lit(0)), F.lit(len(below)))
    lines = scratch.keep(
        docs.select("doc_id", digest.alias("digest"), hashes.alias("hashes"), batch.alias("batch")),
        "lines",
        partition_by="batch",
    )
    store = LineRuns(scratch, enough, fan)
    once = F.explode(F.array_distinct(F.filter("hashes", lambda h: h.isNotNull())))
    for i in range(len(below) + 1):
        store.add(lines.where(F.col("batch") == i).select("doc_id", once.alias("hash")))
    repeated = scratch.keep(store.repeated(), "repeated")
    store.forget()

    gone = (
        lines.select("doc_id", "digest", F.posexplode("hashes").alias("pos", "hash"))
        .join(repeated, "hash")
        .where(~F.col("doc_id").eqNullSafe(F.col("last")))
        .groupBy(F.col("doc_id").alias("gone_id"), F.col("digest").alias("gone_digest"))
        .agg(F.collect_set("pos").alias("gone"))
    )
    rows = docs.select(F.struct("*").alias("row"), "doc_id", digest.alias("digest"))
    split = _lines(F.col("row.text"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    kept = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(
        F.transform(stay, lambda i: F.get("lines", i))
    )
    same = F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("digest") == F.col("gone_digest"))
    return (
        rows.join(gone, same, "left")
        .select("row", "gone", split.alias("lines"))
        .select("row", "lines", kept.alias("kept"))
    )
