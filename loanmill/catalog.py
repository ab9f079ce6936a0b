"""Every operator as a named query over the given tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures
from .functions import scalars
from .functions.rules import DECIMAL_TEXT, FLAG_TEXT, INTEGER_TEXT, RULES
from .operators import clean, dashboard
from .operators.numbering import numbered
from .schemas import LOAN_COLUMNS
from .sources import upload
from .sources.scratch import Scratch

Query = Callable[[SparkSession, str], DataFrame]
MARK = dt.datetime(2000, 1, 1)


def records(spark: SparkSession, sf: str) -> DataFrame:
    """The landed records, one per distinct record."""
    return clean.keep_earliest(fixtures.raw_loans(spark, sf))


def loans(spark: SparkSession, sf: str) -> DataFrame:
    """The cleaned loans of a first run."""
    return clean.valid_rows(records(spark, sf))


def training_loans(spark: SparkSession, sf: str, scratch: Scratch) -> DataFrame:
    """Cleaned loans with a key and a label worth learning."""
    written = scratch.keep(fixtures.noisy_loans(loans(spark, sf)), "training_loans")
    return numbered(written, "loan_id")


def clear_loans(spark: SparkSession, sf: str, scratch: Scratch) -> DataFrame:
    """Cleaned loans with a key; their label hangs on one column alone."""
    return numbered(scratch.keep(loans(spark, sf), "clear_loans"), "loan_id")


def _formats(pattern: str, columns: list[str]) -> Query:
    def query(spark, sf):
        raw = fixtures.raw_loans(spark, sf)
        return raw.select(
            *columns, *(F.col(c).rlike(pattern).alias(f"{c}_ok") for c in columns)
        )

    return query


def _columns_with(pattern: str) -> list[str]:
    return [r.column for r in RULES if r.pattern == pattern]


# --- sources -----------------------------------------------------------------


def contract_project(spark, sf):
    return upload.project(fixtures.raw_loans(spark, sf))


def preview(spark, sf):
    ordered = fixtures.raw_loans(spark, sf).orderBy(*LOAN_COLUMNS, "uploaded_at")
    return upload.preview(ordered)


def raw_text(spark, sf):
    return upload.as_text(upload.project(fixtures.raw_loans(spark, sf)))


def drop_all_null(spark, sf):
    raw = fixtures.raw_loans(spark, sf)
    whole = F.col("person_age").isNotNull() & (F.col("loan_amnt") != "0")
    blanked = raw.select(*(F.when(whole, F.col(c)).alias(c) for c in LOAN_COLUMNS))
    return upload.drop_empty(blanked)


def param_query(spark, sf):
    loans(spark, sf).createOrReplaceTempView("loans_for_query")
    return upload.run_query(
        spark,
        "SELECT person_education, count(*) AS n, max(loan_amnt) AS largest FROM loans_for_query"
        " WHERE credit_score >= :floor AND loan_status = :status GROUP BY person_education",
        {"floor": 600, "status": 1},
    )


# --- cleaning ----------------------------------------------------------------


def dedupe_earliest(spark, sf):
    return records(spark, sf)


def incremental_new(spark, sf):
    return clean.newer_than(records(spark, sf), MARK)


def typed_cast(spark, sf):
    return fixtures.raw_loans(spark, sf).select(*(r.typed().alias(r.column) for r in RULES))


def range_check(spark, sf):
    checks = [r.value_ok().alias(f"{r.column}_ok") for r in RULES if r.accepts]
    return fixtures.raw_loans(spark, sf).select(*(r.column for r in RULES if r.accepts), *checks)


def valid_rows(spark, sf):
    return clean.valid_rows(clean.newer_than(records(spark, sf), MARK))


def reject_rows(spark, sf):
    return clean.reject_rows(records(spark, sf)).drop("error_reason")


def norm_flag(spark, sf):
    flag = F.col("previous_loan_defaults_on_file")
    return fixtures.raw_loans(spark, sf).select(
        flag.alias("given"), scalars.trimmed_lower(flag).alias("flag")
    )


def reject_reason(spark, sf):
    return clean.reject_rows(records(spark, sf))


def run_counts(spark, sf):
    new = clean.newer_than(records(spark, sf), MARK)
    return clean.classify(new).agg(*clean.outcome_counts())


# --- scalar functions ----------------------------------------------------------


def dti_bucket(spark, sf):
    ratio = F.col("loan_percent_income")
    return loans(spark, sf).select(ratio, scalars.dti_bucket(ratio).alias("dti_bucket"))


def default_flag(spark, sf):
    status = F.col("loan_status").try_cast("int")
    return fixtures.raw_loans(spark, sf).select(
        "loan_status", scalars.default_flag(status).alias("is_default")
    )


def exp_years(spark, sf):
    months = F.col("person_emp_exp")
    return loans(spark, sf).select(months, scalars.whole_years(months).alias("emp_exp_years"))


def to_number_strict(spark, sf):
    text = F.col("person_income")
    return fixtures.raw_loans(spark, sf).select(text, scalars.number_or_error(text).alias("number"))


def to_number_lenient(spark, sf):
    text = F.col("person_age")
    return fixtures.raw_loans(spark, sf).select(text, scalars.number_or_null(text).alias("number"))


def norm_gender(spark, sf):
    # Education texts stand in for unknown values.
    given = F.explode(F.array("person_gender", "person_education", F.upper("person_gender")))
    raw = fixtures.raw_loans(spark, sf).select(given.alias("given"))
    return raw.select("given", scalars.gender_code(F.col("given")).alias("gender"))


def age_bucket(spark, sf):
    age = F.col("person_age")
    return fixtures.raw_loans(spark, sf).select(age, scalars.age_bucket(age).alias("age_bucket"))


def exp_bucket(spark, sf):
    months = F.col("person_emp_exp")
    return fixtures.raw_loans(spark, sf).select(
        months, scalars.experience_bucket(months).alias("exp_bucket")
    )


# --- dashboard -----------------------------------------------------------------


def _breakdown(key: str) -> Query:
    return lambda spark, sf: dashboard.default_breakdown(loans(spark, sf), key)


def _measure(measure: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: measure(loans(spark, sf))


def kpis_empty(spark, sf):
    return dashboard.kpis(loans(spark, sf).where("loan_amnt < 0"))


QUERIES: dict[str, Query] = {
    "contract_project": contract_project,
    "preview": preview,
    "raw_text": raw_text,
    "drop_all_null": drop_all_null,
    "param_query": param_query,
    "dedupe_earliest": dedupe_earliest,
    "incremental_new": incremental_new,
    "fmt_int": _formats(INTEGER_TEXT, _columns_with(INTEGER_TEXT)),
    "fmt_decimal": _formats(DECIMAL_TEXT, _columns_with(DECIMAL_TEXT)),
    "fmt_flag": _formats(FLAG_TEXT, _columns_with(FLAG_TEXT)),
    "typed_cast": typed_cast,
    "range_check": range_check,
    "valid_rows": valid_rows,
    "reject_rows": reject_rows,
    "norm_flag": norm_flag,
    "reject_reason": reject_reason,
    "run_counts": run_counts,
    "dti_bucket": dti_bucket,
    "default_flag": default_flag,
    "exp_years": exp_years,
    "to_number_strict": to_number_strict,
    "to_number_lenient": to_number_lenient,
    "norm_gender": norm_gender,
    "age_bucket": age_bucket,
    "exp_bucket": exp_bucket,
    "kpis": _measure(dashboard.kpis),
    "defaults_by_gender": _measure(dashboard.defaults_by_gender),
    "gender_share": _measure(dashboard.gender_share),
    "age_by_gender": _measure(dashboard.age_by_gender),
    "age_histogram": _measure(dashboard.age_histogram),
    "by_education": _breakdown("person_education"),
    "by_exp_years": _breakdown("emp_exp_years"),
    "by_dti": _breakdown("dti_bucket"),
    "by_prev_default": _measure(dashboard.previous_default_breakdown),
    "kpis_empty": kpis_empty,
    "overview": _measure(dashboard.overview),
}


def all_queries() -> dict[str, Query]:
    from . import catalog_jobs

    return {**QUERIES, **catalog_jobs.QUERIES}
