"""Uploaded CSV files: reading, the column contract and the step to landing text."""

from __future__ import annotations

import csv
import io
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import LOAN_COLUMNS
from . import quoted_csv
from .scratch import session_scratch

# Cell texts read as missing.
MISSING_TEXTS = [
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
]
# Fixed value: how a missing cell is written to the landing table.
MISSING = "nan"


class ContractError(ValueError):
    """An upload without exactly the required columns."""


_LINE, _MARK = "_line", "\x01end\x01"
# Bytes of a file read at a time for its header; headers read at a time.
_PEEK, _HEADERS_AT_ONCE = 1 << 16, 16


def _files(spark: SparkSession, path: str) -> list[str]:
    """The files behind a path, a folder or a pattern; their content isn't read."""
    files = spark.read.format("binaryFile").load(path).select("path").orderBy("path")
    return [r.path for r in files.collect()]


def _open(text: str) -> bool:
    """Whether a quote is open after these lines."""
    return reduce(lambda inside, line: quoted_csv.open_after(line, inside), text.split("\n"), False)


def _first_record(spark: SparkSession, file: str) -> str:
    """The header's text; only the beginning of the file is read."""
    hadoop, conf = spark._jvm.org.apache.hadoop, spark._jsc.hadoopConfiguration()
    path = hadoop.fs.Path(spark._jvm.java.net.URI(file))
    codec = hadoop.io.compress.CompressionCodecFactory(conf).getCodec(path)
    stream = path.getFileSystem(conf).open(path)
    if codec is not None:
        stream = codec.createInputStream(stream)
    try:
        data, at = b"", 0
        while True:
            more = bytes(stream.readNBytes(_PEEK))
            data += more
            while True:
                end = data.find(b"\n", at)
                if end < 0 and more:
                    break
                text = (data if end < 0 else data[:end]).decode("utf-8-sig").removesuffix("\r")
                if end < 0 or (text.strip() and not _open(text)):
                    return text.lstrip("\r\n")
                at = end + 1
    finally:
        stream.close()


def _header(spark: SparkSession, file: str) -> tuple[str, ...]:
    """Names of the columns: an empty one by its place, one met before with its place added."""
    text = _first_record(spark, file)
    cells = next(csv.reader(io.StringIO(text, newline="")), [])
    names = [cell.strip() or f"_c{i}" for i, cell in enumerate(cells)]
    return tuple(n if n not in names[:i] else f"{n}{i}" for i, n in enumerate(names))


def _read_alike(
    spark: SparkSession, files: list[str], header: tuple[str, ...], multi_line: bool
) -> DataFrame:
    """Files with the same header. Records that don't fill it exactly are parsed with a mark
    appended: where the mark ends up is the number of their cells."""
    line, names = F.col(_LINE), [f"c{i}" for i in range(len(header) + 1)]
    options = {"escape": '"', "multiLine": str(multi_line).lower()}
    marked = F.concat(line, F.lit(f",{_MARK}"))
    again = F.from_csv(marked, F.lit(", ".join(f"{c} STRING" for c in names)), options)
    if multi_line:
        # Parsed once a record: a filter isn't pushed below a generator.
        records = quoted_csv.records(spark, files, session_scratch(spark))
        table = records.withColumnRenamed("record", _LINE).select(_LINE, F.inline(F.array(again)))
        met = [F.col(c) == _MARK for c in names]
    else:
        texts = [T.StructField(c, T.StringType()) for c in names[:-1]]
        kind = T.StructType([*texts, T.StructField(_LINE, T.StringType())])
        reader = spark.read.options(
            header=True, escape='"', columnPruning=False, columnNameOfCorruptRecord=_LINE
        )
        table = reader.schema(kind).csv(files)
        met = [again[c] == _MARK for c in names]
    fits = reduce(lambda a, b: a | b, (F.coalesce(m, F.lit(False)) for m in met))
    checked = F.when(line.isNull() | fits, True).otherwise(
        F.raise_error(F.concat(F.lit("more cells than columns: "), line)).cast("boolean")
    )
    return table.where(checked).select(
        *(
            F.when(~F.col(c).isin([*MISSING_TEXTS, _MARK]), F.col(c)).alias(name)
            for c, name in zip(names, header)
        )
    )


def read_csv(spark: SparkSession, path: str, multi_line: bool) -> list[DataFrame]:
    """An upload as texts, one table per order of columns among its files; header names
    trimmed, missing cells null. A line with more cells than its file's header fails the
    read, a shorter one is filled up with missing cells.

    `multi_line` says whether quoted line breaks occur. Huge files are split either way; where
    such breaks occur they are read twice, the first time to learn where quotes are open.
    """
    files = _files(spark, path)
    with ThreadPool(_HEADERS_AT_ONCE) as pool:
        headers = pool.map(lambda file: _header(spark, file), files)
    alike: dict[tuple[str, ...], list[str]] = {}
    for file, header in zip(files, headers):
        alike.setdefault(header, []).append(file)
    return [_read_alike(spark, files, header, multi_line) for header, files in alike.items()]


def check_contract(columns: list[str]) -> None:
    missing = [c for c in LOAN_COLUMNS if c not in columns]
    extra = [c for c in columns if c not in LOAN_COLUMNS]
    if missing:
        raise ContractError(f"upload lacks the columns {missing}")
    if extra:
        raise ContractError(f"upload has unknown columns {extra}")


def project(table: DataFrame) -> DataFrame:
    return table.select(*LOAN_COLUMNS)


def preview(table: DataFrame, rows: int = 5) -> DataFrame:
    return table.limit(rows)


def as_text(table: DataFrame) -> DataFrame:
    return table.select(
        *(F.coalesce(F.col(c).cast("string"), F.lit(MISSING)).alias(c) for c in table.columns)
    )


def drop_empty(table: DataFrame) -> DataFrame:
    return table.na.drop(how="all")


def ingest(spark: SparkSession, *paths: str, multi_line: bool) -> DataFrame:
    """Uploads as landing rows. Every file is checked and ordered by its own header; one
    that breaks the contract refuses the whole upload."""
    tables = [table for path in paths for table in read_csv(spark, path, multi_line)]
    for table in tables:
        check_contract(table.columns)
    return reduce(DataFrame.unionByName, (drop_empty(as_text(project(t))) for t in tables))


def run_query(spark: SparkSession, sql: str, params: dict | None = None) -> DataFrame:
    """Any SELECT with `:name` parameters."""
    return spark.sql(sql, args=params or {})
