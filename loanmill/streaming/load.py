"""Uploads that follow a folder, and cleaning runs that follow the uploads, by themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.etl import run_etl
from ..sources import upload
from ..sources.store import LoanStore, now

_FOUND = "path string, modificationTime timestamp, length long, content binary"


def follow_uploads(store: LoanStore, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Starts a run whenever uploads have been added to the store.

    The stream reads the small table of uploads, not the records: a run finds its pending
    uploads itself, and first-seen deduplication has no time bound a watermark could use.
    A batch repeated after a crash finds nothing pending and adds an empty run. Without an
    interval the query takes what is there and ends.
    """

    def run(batch: DataFrame, _batch_id: int) -> None:
        if not batch.isEmpty():
            run_etl(store)

    uploads = store.spark.readStream.schema("upload_id string").parquet(f"{store.root}/uploads")
    writer = uploads.writeStream.option("checkpointLocation", checkpoint).foreachBatch(run)
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return writer.trigger(**trigger).start()


def follow_folder(
    store: LoanStore,
    folder: str,
    checkpoint: str,
    name: str,
    multi_line: bool,
    files_at_once: int = 1000,
    interval: str | None = None,
) -> StreamingQuery:
    """Lands the CSV files that appear in a folder, one upload per micro-batch.

    The upload is named after the stream's `name`, which belongs to its checkpoint, and the
    batch's number, so a batch repeated after a crash lands nothing twice. A batch with a file
    that breaks the column contract is refused whole and leaves a FAILED row; the stream goes
    on. The stream itself reads the files' names only. Without an interval the query takes
    what is there and ends.
    """

    def land(batch: DataFrame, number: int) -> None:
        upload_id = f"{name}-{number:012d}"
        paths = [r.path for r in batch.select("path").collect()]
        if not paths or upload_id in store.uploads():
            return
        try:
            rows = upload.ingest(store.spark, *paths, multi_line=multi_line)
        except upload.ContractError as refused:
            store.log_failure(upload_id, now(), str(refused))
            return
        store.append_raw(rows, upload_id=upload_id)

    found = (
        store.spark.readStream.format("binaryFile")
        .schema(_FOUND)
        .option("maxFilesPerTrigger", files_at_once)
        .load(folder)
        .select("path")
    )
    writer = found.writeStream.option("checkpointLocation", checkpoint).foreachBatch(land)
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return writer.trigger(**trigger).start()
