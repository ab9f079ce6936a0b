"""Bounds and value lists for loan applications."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Lowest and highest number allowed, and the choices offered.
BOUNDS = {
    "person_age": (18, 100),
    "person_income": (0, None),
    "person_emp_exp": (0, None),
    "loan_amnt": (0, None),
    "loan_int_rate": (0, 100),
    "loan_percent_income": (0, None),
    "cb_person_cred_hist_length": (0, None),
    "credit_score": (300, 850),
}
CHOICES = {
    "person_gender": ["Male", "Female"],
    "person_education": ["High School", "Bachelor", "Master", "PhD", "Other"],
    "person_home_owner": ["Rent", "Own", "Mortgage", "Other"],
    "loan_intent": ["Personal", "Education", "Medical", "Venture", "Home", "Other"],
    "previous_loan_defaults_on_file": ["yes", "no"],
}


def check_applications(applications: DataFrame) -> DataFrame:
    """Adds the names of the fields out of bounds and whether there are none."""
    fits = {}
    for c, (low, high) in BOUNDS.items():
        # Spark orders NaN above infinity, so one bound keeps out both.
        top = F.col(c) < float("inf") if high is None else F.col(c) <= high
        fits[c] = (F.col(c) >= low) & top
    for c, choices in CHOICES.items():
        fits[c] = F.col(c).isin(choices)
    names = (F.when(~F.coalesce(ok, F.lit(False)), F.lit(c)) for c, ok in fits.items())
    return applications.withColumn("invalid_fields", F.concat_ws(", ", *names)).withColumn(
        "is_valid", F.col("invalid_fields") == ""
    )
