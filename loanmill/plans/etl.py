"""The cleaning run: landed uploads to loans, rejects and an audit row."""

from __future__ import annotations

import datetime as dt
import uuid
from dataclasses import dataclass

from pyspark.sql import functions as F

from ..operators import clean
from ..operators.numbering import numbered
from ..schemas import LOAN_COLUMNS
from ..sources.scratch import Scratch
from ..sources.store import LoanStore, LostRace, now

# New keys of a bucket that a task may hold in memory, some 200 MB.
_HASHED_KEYS = 2_000_000

_OUTCOMES = ("valid", "reject", "unclassified", "late")


@dataclass(frozen=True)
class RunResult:
    run_id: str
    success_count: int
    reject_count: int
    unclassified_count: int


def run_etl(store: LoanStore, at: dt.datetime | None = None) -> RunResult:
    """Loads what the successful runs have not taken in yet.

    A record counts as new when its earliest upload lies after the mark, the time of the
    last successful run. Instead of deduplicating all history again, the pending uploads
    are deduplicated and held against the keys of every record met before. A run that finds
    another one committed meanwhile starts again with what is left. A failed run leaves only
    its FAILED row; the error is raised again.
    """
    at = at or now()
    while True:
        run_id = f"{at:%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex[:8]}"
        try:
            result = _load(store, run_id, at)
            break
        except LostRace:
            continue
        except Exception as error:
            store.log_failure(run_id, at, str(error))
            raise
    # Committed: a refresh that fails is raised, but the run has not failed.
    store.refresh_view()
    return result


def _load(store: LoanStore, run_id: str, at: dt.datetime) -> RunResult:
    done = store.committed()
    pending = [u for u in store.uploads() if u not in done.uploads]
    counts = dict.fromkeys(_OUTCOMES, 0)
    last_id = done.last_loan_id
    with Scratch(store.spark) as scratch:
        if pending:
            records = scratch.keep(
                clean.with_key(clean.keep_earliest(store.raw(pending))), "records"
            )
            unseen = records
            if done.runs:
                few = records.count() <= _HASHED_KEYS * store.key_buckets
                unseen = clean.not_seen(records, store.seen_keys(done.runs), few)
            checked = clean.classify(unseen)
            if done.mark is not None:
                # Stamped up to the mark but landed after that run: seen, never loaded.
                late = F.col("uploaded_at") <= clean.moment(done.mark)
                checked = checked.withColumn("outcome", F.when(late, "late").otherwise(F.col("outcome")))
            staged = scratch.keep(checked, "checked", partition_by="outcome")
            # Counted on what was written, so no retried task counts twice; only file
            # footers are read.
            counts |= dict(staged.groupBy("outcome").count().collect())
            valid = staged.where("outcome = 'valid'")
            loans = numbered(valid, "loan_id", after=last_id)
            store.write_loans(run_id, loans.select("loan_id", *clean.typed_columns()))
            rejects = staged.where("outcome = 'reject'")
            store.write_rejects(run_id, rejects.select(*LOAN_COLUMNS, "error_reason"))
            store.write_keys(run_id, staged)
            last_id += counts["valid"]
        else:
            empty = store.raw([])
            store.write_loans(run_id, clean.valid_rows(empty).withColumn("loan_id", F.lit(0)))
            store.write_rejects(run_id, clean.reject_rows(empty))
    store.commit(run_id, at, done, pending, last_id, counts)
    return RunResult(run_id, counts["valid"], counts["reject"], counts["unclassified"])
