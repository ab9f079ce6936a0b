"""Large CSV files whose quoted cells hold line breaks, read by many tasks.

Where a chunk of such a file begins, nobody can tell whether a quote is open. But each chunk,
read once, tells how it would end after either beginning, and these answers, put together in
the order of the chunks, give the true beginning of every chunk. With those known a second
pass cuts each chunk into records. Only the pieces of records that run over a chunk's end are
moved.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import Scratch

# Executors have no copy of this package.
register_pickle_by_value(sys.modules[__name__])

_KIND = "file string, block long, first boolean, begins boolean, record string"


def open_after(line: str, inside: bool) -> bool:
    """Whether a quote is open at the end of a line that began `inside` one or at a record's
    start. A quote opens a cell only as its first character; two in a quoted cell are one."""
    at = 0
    while True:
        if not inside:
            if not line.startswith('"', at):
                at = line.find(",", at) + 1
                if not at:
                    return False
                continue
            at += 1
        close = line.find('"', at)
        if close < 0:
            return True
        if line.startswith('"', close + 1):
            at, inside = close + 2, True
            continue
        at, inside = line.find(",", close + 1) + 1, False
        if not at:
            return False


def _lines(spark: SparkSession, files: list[str]) -> DataFrame:
    """Lines, and the chunk in which they begin; tasks read whole chunks in order."""
    return spark.read.option("lineSep", "\n").text(files).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"), "value",
    )


def _by_chunk(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], list[str]]]:
    """Lines of one chunk at a time; a chunk may come in several lists."""
    for batch in batches:
        files, blocks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        lines, start = batch.column(2).to_pylist(), 0
        for i in range(1, len(lines) + 1):
            if i == len(lines) or (files[i], blocks[i]) != (files[start], blocks[start]):
                yield (files[start], blocks[start]), lines[start:i]
                start = i


def _batch(rows: list[tuple], schema: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(schema)
    arrays = [pa.array(values, kind) for values, (_, kind) in zip(columns, schema)]
    return pa.RecordBatch.from_arrays(arrays, names=[name for name, _ in schema])


def _ends(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per chunk, whether a quote is open at its end: after a record's start, after a quote."""
    ends: dict[tuple, tuple[bool, bool]] = {}
    for chunk, lines in _by_chunk(batches):
        plain, quoted = ends.get(chunk, (False, True))
        for line in lines:
            if '"' in line:
                plain, quoted = open_after(line, plain), open_after(line, quoted)
        ends[chunk] = plain, quoted
    kinds = [("file", pa.string()), ("block", pa.int64()), ("plain", pa.bool_()), ("quoted", pa.bool_())]
    yield _batch([(*chunk, *end) for chunk, end in ends.items()], kinds)


def _begin_inside(ends: DataFrame) -> set[tuple[str, int]]:
    """Chunks that begin inside a quoted cell.

    A chunk forgets how it began, keeps it, or turns it over. So a chunk begins as the last
    forgetful one before it ended, turned over as often as chunks in between do.
    """
    so_far = Window.partitionBy("file").orderBy("block")
    before = so_far.rowsBetween(Window.unboundedPreceding, -1)
    turns = F.sum((F.col("plain") & ~F.col("quoted")).cast("int"))
    told = F.when(
        F.col("plain") == F.col("quoted"),
        F.struct(F.col("plain").cast("int").alias("end"), F.col("turns").alias("turns")),
    )
    known = (
        ends.withColumn("turns", turns.over(so_far))
        .withColumn("turned", F.coalesce(turns.over(before), F.lit(0)))
        .withColumn("told", F.last(told, ignorenulls=True).over(before))
    )
    end, since = F.coalesce("told.end", F.lit(0)), F.col("turned") - F.coalesce("told.turns", F.lit(0))
    inside = known.where((end + since) % 2 == 1).select("file", "block")
    return {(r.file, r.block) for r in inside.collect()}


def _cut(inside: set[tuple[str, int]]):
    """Records of every chunk, and the pieces of those that are open at one of its ends."""
    kinds = [("file", pa.string()), ("block", pa.int64()), ("first", pa.bool_()),
             ("begins", pa.bool_()), ("record", pa.string())]

    def cut(batches):
        chunk, held, quoted, first, begins = None, [], False, False, True
        for here, lines in _by_chunk(batches):
            rows = []
            if here != chunk:
                if held:
                    rows.append((*chunk, first, begins, "\n".join(held)))
                chunk, held, quoted, first = here, [], here in inside, here[1] == 0
                begins = not quoted
            for line in lines:
                if '"' in line:
                    quoted = open_after(line, quoted)
                if not quoted and not held and begins:
                    if line in ("", "\r"):
                        continue
                    rows.append((*chunk, first, None, line.removesuffix("\r")))
                    first = False
                    continue
                held.append(line)
                if not quoted:
                    # The end of a record: of one that began here, or in an earlier chunk.
                    record = "\n".join(held)
                    whole = (first, None, record.removesuffix("\r")) if begins else (False, False, record)
                    rows.append((*chunk, *whole))
                    held, first, begins = [], first and not begins, True
            yield _batch(rows, kinds)
        if held:
            yield _batch([(*chunk, first, begins, "\n".join(held))], kinds)

    return cut


def records(spark: SparkSession, files: list[str], scratch: Scratch) -> DataFrame:
    """`record`: the text of every record but the first of each file, its header.

    Lines end with a line feed, or a carriage return and a line feed; inside quotes both stay.
    Empty lines are left out. A quote never closed takes the rest of its file along.
    """
    lines = _lines(spark, files)
    ends = lines.mapInArrow(_ends, "file string, block long, plain boolean, quoted boolean")
    inside = _begin_inside(ends)
    pieces = scratch.keep(lines.mapInArrow(_cut(inside), _KIND), "pieces")
    whole = pieces.where("begins IS NULL AND NOT first").select("record")
    if not inside:
        # No chunk begins inside quotes; a quote left open can only reach the end of its file.
        return whole.union(pieces.where("begins AND NOT first").select("record"))
    order = Window.partitionBy("file").orderBy("block", "begins")
    piece = F.struct("block", "begins", "record")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(piece)), lambda p: p["record"]), "\n")
    joined = (
        pieces.where("begins IS NOT NULL")
        .withColumn("number", F.sum(F.col("begins").cast("int")).over(order))
        .groupBy("file", "number")
        .agg(F.max("first").alias("first"), F.regexp_replace(text, "\r$", "").alias("record"))
        .where("NOT first")
    )
    return whole.union(joined.select("record"))
