"""The loan tables as Parquet folders under one root.

Every upload and every run writes folders of its own. A row in `uploads` makes an upload
visible and a numbered file in `commits`, moved there whole, makes a run visible; readers name
visible folders only, so half-written ones are never seen. A number is taken once: of runs that
began with the same commits one gets the next number, and the others must look again. A store
for bare objects, which cannot refuse to replace a file, lets one run at a time in.

Every so many commits one file in `states` repeats all of them, so that opening a store reads
that one and the few commits since. `packs` name folders that hold the loans of many runs.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..operators import dashboard
from ..operators.clean import moment
from ..schemas import FACT_SCHEMA, LOAN_COLUMNS, LOG_SCHEMA, RAW_SCHEMA, REJECT_SCHEMA
from .numbered_files import LostRace, NumberedFiles

_UPLOADS = T.StructType(
    [
        T.StructField("upload_id", T.StringType()),
        T.StructField("uploaded_at", T.TimestampNTZType()),
    ]
)
_COMMITS = T.StructType(
    [
        T.StructField("number", T.LongType()),
        T.StructField("run_id", T.StringType()),
        T.StructField("date_time", T.TimestampNTZType()),
        T.StructField("uploads", T.ArrayType(T.StringType())),
        T.StructField("last_loan_id", T.LongType()),
        T.StructField("success_count", T.LongType()),
        T.StructField("reject_count", T.LongType()),
        T.StructField("unclassified_count", T.LongType()),
        T.StructField("late_count", T.LongType()),
    ]
)
_LOG = T.StructType([T.StructField("run_id", T.StringType()), *LOG_SCHEMA.fields])
# The last row holds: how many buckets the key table has, and in which folder it is.
_SETTINGS = T.StructType(
    [T.StructField("generation", T.IntegerType()), T.StructField("key_buckets", T.IntegerType())]
)
# Commits after which they are repeated in one file.
_STATE_EVERY = 100

SUCCESS, FAILED = "SUCCESS", "FAILED"


def now() -> dt.datetime:
    return dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)


@dataclass(frozen=True)
class Committed:
    """What the successful runs so far have done."""

    number: int
    runs: list[str]
    uploads: set[str]
    mark: dt.datetime | None
    last_loan_id: int


class LoanStore:
    """Opens the tables under `root`, creating the missing ones."""

    def __init__(self, spark: SparkSession, root: str, key_buckets: int | None = None):
        self.spark, self.root = spark, root
        buckets = key_buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self._create("settings", _SETTINGS, [(0, buckets)])
        self._create("uploads", _UPLOADS)
        self._create("etl_log", _LOG)
        self._commit_files = NumberedFiles(spark, root, "commits")
        self._states = NumberedFiles(spark, root, "states")
        self._views = NumberedFiles(spark, root, "views")
        self._packs = NumberedFiles(spark, root, "packs")
        self._open_keys()

    def _open_keys(self) -> None:
        # Bucketed, so a run shuffles its new records to the old keys and not the reverse.
        rows = self._table("settings", _SETTINGS).collect()
        self.generation, self.key_buckets = max(map(tuple, rows))
        folder = f"{self.root}/seen_keys_{self.generation}"
        self.keys = "seen_keys_" + hashlib.md5(folder.encode()).hexdigest()
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.keys} (record_key BINARY, run_id STRING)"
            f" USING parquet CLUSTERED BY (record_key) INTO {self.key_buckets} BUCKETS"
            f" LOCATION '{folder}'"
        )

    def _rows(self, schema: T.StructType, rows: list[tuple]) -> DataFrame:
        columns = list(zip(*rows)) or [()] * len(schema)
        arrow = to_arrow_schema(schema)
        arrays = [pa.array(values, field.type) for values, field in zip(columns, arrow)]
        table = pa.Table.from_arrays(arrays, schema=arrow)
        return self.spark.createDataFrame(table, schema).coalesce(1)

    def _create(self, name: str, schema: T.StructType, rows: list[tuple] = ()) -> None:
        self._rows(schema, list(rows)).write.mode("ignore").parquet(f"{self.root}/{name}")

    def _table(self, name: str, schema: T.StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")

    def _append(self, name: str, schema: T.StructType, row: tuple) -> None:
        self._rows(schema, [row]).write.mode("append").parquet(f"{self.root}/{name}")

    def _folders(self, name: str, key: str, ids: list[str], schema: T.StructType) -> DataFrame:
        if not ids:
            return self.spark.createDataFrame([], schema)
        paths = [f"{self.root}/{name}/{key}={i}" for i in ids]
        return self.spark.read.schema(schema).parquet(*paths)

    # --- landing table -------------------------------------------------------

    def append_raw(
        self, rows: DataFrame, at: dt.datetime | None = None, upload_id: str | None = None
    ) -> str:
        """Lands an upload. Rows that carry no time of their own get the upload's: the time
        when it became visible, so that no run finished meanwhile can make them late.

        A caller who may have to repeat an upload names it; what an earlier try left behind
        without becoming visible is replaced.
        """
        upload_id = upload_id or f"{now():%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex[:8]}"
        if "uploaded_at" not in rows.columns:
            rows = rows.withColumn("uploaded_at", moment(None))
        folder = f"{self.root}/raw_loans/upload_id={upload_id}"
        rows.select(*LOAN_COLUMNS, "uploaded_at").write.mode("overwrite").parquet(folder)
        self._append("uploads", _UPLOADS, (upload_id, at or now()))
        return upload_id

    def uploads(self) -> list[str]:
        rows = self._table("uploads", _UPLOADS).orderBy("upload_id").collect()
        return [r.upload_id for r in rows]

    def raw(self, uploads: list[str] | None = None) -> DataFrame:
        """The landing table, or the named uploads of it."""
        ids = self.uploads() if uploads is None else uploads
        if not ids:
            return self.spark.createDataFrame([], RAW_SCHEMA)
        base = f"{self.root}/raw_loans"
        named = T.StructType([*RAW_SCHEMA.fields, T.StructField("upload_id", T.StringType())])
        rows = self.spark.read.schema(named).option("basePath", f"{base}/").parquet(
            *(f"{base}/upload_id={i}" for i in ids)
        )
        stamps = self._table("uploads", _UPLOADS).withColumnRenamed("uploaded_at", "landed_at")
        return rows.join(stamps, "upload_id", "left").select(
            *LOAN_COLUMNS, F.coalesce("uploaded_at", "landed_at").alias("uploaded_at")
        )

    # --- runs ------------------------------------------------------------------

    def _commits(self) -> DataFrame:
        """All commits: the last state and what came after it."""
        state = self._states.numbers()[-1:]
        later = [n for n in self._commit_files.numbers() if n > max(state, default=0)]
        files = [*map(self._states.file, state), *map(self._commit_files.file, later)]
        if not files:
            return self.spark.createDataFrame([], _COMMITS)
        return self.spark.read.schema(_COMMITS).json(files)

    def _keep_state(self) -> None:
        """Repeats all commits in one file, once there are enough since the last one."""
        state, taken = self._states.numbers()[-1:], self._commit_files.numbers()
        later = [n for n in taken if n > max(state, default=0)]
        if len(later) < _STATE_EVERY:
            return
        lines = self._states.lines(*state) + self._commit_files.lines(*later)
        try:
            self._states.add(later[-1], "\n".join(lines))
        except LostRace:
            pass  # Another run has kept the same commits.

    def committed(self, upto: int | None = None) -> Committed:
        """State left by the successful runs, or the first `upto` of them. Failed ones do not
        move the mark."""
        done = self._commits().orderBy("number").collect()
        done = done if upto is None else done[:upto]
        return Committed(
            number=len(done),
            runs=[r.run_id for r in done],
            uploads={u for r in done for u in r.uploads},
            mark=max((r.date_time for r in done), default=None),
            last_loan_id=max((r.last_loan_id for r in done), default=0),
        )

    def write_loans(self, run_id: str, loans: DataFrame) -> None:
        """Writes a run's loans, and how many there are per cell of the dashboard."""
        loans.select(*FACT_SCHEMA.names).write.parquet(f"{self.root}/loans/run_id={run_id}")
        written = self._folders("loans", "run_id", [run_id], FACT_SCHEMA)
        for name, cells in dashboard.cells(written).items():
            cells.coalesce(1).write.parquet(f"{self.root}/{name}/run_id={run_id}")

    def write_rejects(self, run_id: str, rejects: DataFrame) -> None:
        folder = f"{self.root}/loans_rejects/run_id={run_id}"
        rejects.select(*REJECT_SCHEMA.names).write.parquet(folder)

    def write_keys(self, run_id: str, keys: DataFrame) -> None:
        """One file per bucket and run."""
        (
            keys.select("record_key", F.lit(run_id).alias("run_id"))
            .repartition(self.key_buckets, "record_key")
            .write.insertInto(self.keys)
        )

    def seen_keys(self, runs: list[str]) -> DataFrame:
        return self.spark.table(self.keys).where(F.col("run_id").isin(runs)).select("record_key")

    def compact_keys(self, key_buckets: int | None = None) -> None:
        """Rewrites the keys of committed runs as one file per bucket, in as many buckets as
        asked for. The new table counts once the settings name it.
        """
        buckets, old = key_buckets or self.key_buckets, self.keys
        runs = self.committed().runs
        name = f"compacting_{uuid.uuid4().hex}"
        (
            self.spark.table(old).where(F.col("run_id").isin(runs))
            .repartition(buckets, "record_key").write.bucketBy(buckets, "record_key")
            .option("path", f"{self.root}/seen_keys_{self.generation + 1}").saveAsTable(name)
        )
        self._append("settings", _SETTINGS, (self.generation + 1, buckets))
        self.spark.sql(f"DROP TABLE {name}")
        self.spark.sql(f"DROP TABLE {old}")
        self._open_keys()

    def commit(
        self, run_id: str, at: dt.datetime, after: Committed, uploads: list[str], last_loan_id: int,
        counts: dict,
    ) -> None:
        """Makes a run visible as the next after those of `after`; LostRace where another one
        is that already."""
        entry = {
            "number": after.number + 1, "run_id": run_id, "date_time": at.isoformat(),
            "uploads": uploads, "last_loan_id": last_loan_id, "success_count": counts["valid"],
            "reject_count": counts["reject"], "unclassified_count": counts["unclassified"],
            "late_count": counts["late"],
        }
        self._commit_files.add(entry["number"], json.dumps(entry))
        self._keep_state()

    def log_failure(self, run_id: str, at: dt.datetime, message: str) -> None:
        self._append("etl_log", _LOG, (run_id, at, FAILED, 0, 0, message))

    # --- readers -----------------------------------------------------------------

    def _loan_folders(self, done: Committed) -> list[str]:
        """Folders with the loans of these runs: packs, and the runs since the last of them."""
        packs = [n for n in self._packs.numbers() if n <= done.number]
        if not packs:
            return done.runs
        return json.loads(self._packs.lines(packs[-1])[0]) + done.runs[packs[-1] :]

    def pack_loans(self) -> None:
        """Puts the loans of the runs since the last pack into one folder, whose files are as
        large as a task reads, and their cells into one. Nothing is shuffled, earlier packs
        aren't touched, and the runs' own folders stay for views of fewer commits.
        """
        done = self.committed()
        number = (self._packs.numbers() or [0])[-1]
        if number == done.number:
            return
        folders = self._loan_folders(done)
        since, pack = done.runs[number:], f"pack-{done.number}-{uuid.uuid4().hex[:8]}"
        self._folders("loans", "run_id", since, FACT_SCHEMA).write.parquet(
            f"{self.root}/loans/run_id={pack}"
        )
        for name in dashboard.CELLS:
            merged = dashboard.merged(self._cells(name, since))
            merged.coalesce(1).write.parquet(f"{self.root}/{name}/run_id={pack}")
        earlier = folders[: len(folders) - len(since)]
        self._packs.add(done.number, json.dumps([*earlier, pack]))

    def loans(self) -> DataFrame:
        folders = self._loan_folders(self.committed())
        return self._folders("loans", "run_id", folders, FACT_SCHEMA)

    def _cells(self, name: str, folders: list[str]) -> DataFrame:
        return self._folders(name, "run_id", folders, dashboard.CELLS[name])

    def cells(self) -> dict[str, DataFrame]:
        """The cells of the view: what the dashboard adds up instead of scanning all loans."""
        folders = self._view_folders()
        return {name: dashboard.merged(self._cells(name, folders)) for name in dashboard.CELLS}

    def rejects(self) -> DataFrame:
        return self._folders("loans_rejects", "run_id", self.committed().runs, REJECT_SCHEMA)

    def upload_history(self) -> DataFrame:
        """One row per finished run: the committed ones and those that failed."""
        done = self._commits().select(
            "date_time", F.lit(SUCCESS).alias("status"), "success_count", "reject_count",
            F.lit(None).cast("string").alias("error_message"),
        )
        return done.union(self._table("etl_log", _LOG).drop("run_id"))

    def refresh_view(self) -> DataFrame:
        """Makes the view a snapshot of the loans of the runs committed so far.

        A file named after their number stands for it, and the folders of those runs never
        change; nothing is copied, later runs stay outside until the next refresh, and every
        session sees the same.
        """
        try:
            self._views.add(self.committed().number, json.dumps(now().isoformat()))
        except LostRace:
            pass  # The same commits are shown already.
        return self.view()

    def _view_folders(self) -> list[str]:
        shown = self._views.numbers()
        return self._loan_folders(self.committed(shown[-1])) if shown else []

    def view(self) -> DataFrame:
        """The loans as of the last refresh; none before the first."""
        return self._folders("loans", "run_id", self._view_folders(), FACT_SCHEMA)
