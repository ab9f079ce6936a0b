"""Deduplication, incremental selection, validation and typing of landed records."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import RULES, all_hold, failure_number, failure_text, outcome
from ..functions.scalars import trimmed_lower
from ..schemas import LOAN_COLUMNS


def moment(value: dt.datetime | None) -> Column:
    """A zone-free timestamp literal."""
    return F.lit(value.isoformat() if value else None).cast("timestamp_ntz")


def keep_earliest(raw: DataFrame) -> DataFrame:
    """One row per distinct record with its earliest upload time; nulls count as equal.

    Every kept column is part of the key, so an aggregate does it: copies collapse before
    the shuffle and a record with very many copies costs no more than any other.
    """
    return raw.groupBy(*LOAN_COLUMNS).agg(F.min("uploaded_at").alias("uploaded_at"))


def newer_than(deduplicated: DataFrame, mark: dt.datetime | None) -> DataFrame:
    """Records first uploaded strictly after the mark; all of them without a mark.

    Belongs after `keep_earliest`: the other way round, a re-upload of an old record
    would look new.
    """
    if mark is None:
        return deduplicated
    return deduplicated.where(F.col("uploaded_at") > moment(mark))


def record_key() -> Column:
    """32-byte digest of the 14 texts; length prefixes keep it unambiguous, nulls equal."""
    parts = [
        F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), F.col(c)), F.lit("-"))
        for c in LOAN_COLUMNS
    ]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def with_key(records: DataFrame) -> DataFrame:
    return records.withColumn("record_key", record_key())


def not_seen(keyed: DataFrame, seen_keys: DataFrame, few: bool = True) -> DataFrame:
    """Records whose `record_key` is not among those already taken in.

    The history streams past a hash table of the new keys, where these are few enough to be
    held bucket by bucket, and is neither sorted nor shuffled; only its hits are held against
    the records. More of them are merged with it in order, which spills.
    """
    new = keyed.select("record_key").hint("shuffle_hash" if few else "merge")
    return keyed.join(seen_keys.join(new, "record_key", "left_semi"), "record_key", "left_anti")


def classify(records: DataFrame) -> DataFrame:
    """Adds `error_reason` and `outcome`, checking each record once."""
    number = F.col("failure")
    return (
        records.withColumn("failure", failure_number())
        .withColumns({"error_reason": failure_text(number), "outcome": outcome(number)})
        .drop("failure")
    )


def typed_columns() -> list[Column]:
    """The 14 columns as the fact table types them."""
    checked = {r.column: r.typed() for r in RULES}
    flag = "previous_loan_defaults_on_file"
    return [
        checked.get(c, trimmed_lower(F.col(c)) if c == flag else F.col(c)).alias(c)
        for c in LOAN_COLUMNS
    ]


def valid_rows(records: DataFrame) -> DataFrame:
    return records.where(all_hold()).select(*typed_columns())


def reject_rows(records: DataFrame) -> DataFrame:
    number = F.col("failure")
    return (
        records.withColumn("failure", failure_number())
        .where(number.isNotNull())
        .select(*LOAN_COLUMNS, failure_text(number).alias("error_reason"))
    )


def outcome_counts() -> list[Column]:
    """Aggregates over classified rows for the audit log."""
    return [
        F.count_if(F.col("outcome") == kind).alias(f"{kind}_count")
        for kind in ("valid", "reject", "unclassified")
    ]
