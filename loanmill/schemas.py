"""Column names, roles and table schemas."""

from pyspark.sql import types as T

# The upload contract, in landing order.
LOAN_COLUMNS = [
    "person_age",
    "person_gender",
    "person_education",
    "person_income",
    "person_emp_exp",
    "person_home_owner",
    "loan_amnt",
    "loan_intent",
    "loan_int_rate",
    "loan_percent_income",
    "cb_person_cred_hist_length",
    "credit_score",
    "previous_loan_defaults_on_file",
    "loan_status",
]

LABEL = "loan_status"
FEATURES = [c for c in LOAN_COLUMNS if c != LABEL]

# How the models use the features.
NUMERIC = [
    "person_income",
    "loan_amnt",
    "loan_int_rate",
    "loan_percent_income",
    "cb_person_cred_hist_length",
    "credit_score",
]
CATEGORICAL = [c for c in FEATURES if c not in NUMERIC]

INTEGER_COLUMNS = ["person_age", "person_emp_exp", "cb_person_cred_hist_length", "loan_status"]
DOUBLE_COLUMNS = [c for c in NUMERIC if c not in INTEGER_COLUMNS]


def _fact_type(name: str) -> T.DataType:
    if name in INTEGER_COLUMNS:
        return T.IntegerType()
    if name in DOUBLE_COLUMNS:
        return T.DoubleType()
    return T.StringType()


_TEXTS = [T.StructField(c, T.StringType()) for c in LOAN_COLUMNS]

# Times carry no zone, so results do not depend on the session's time zone.
RAW_SCHEMA = T.StructType(_TEXTS + [T.StructField("uploaded_at", T.TimestampNTZType())])
REJECT_SCHEMA = T.StructType(_TEXTS + [T.StructField("error_reason", T.StringType())])
FACT_SCHEMA = T.StructType(
    [T.StructField("loan_id", T.LongType())]
    + [T.StructField(c, _fact_type(c)) for c in LOAN_COLUMNS]
)
LOG_SCHEMA = T.StructType(
    [
        T.StructField("date_time", T.TimestampNTZType()),
        T.StructField("status", T.StringType()),
        T.StructField("success_count", T.LongType()),
        T.StructField("reject_count", T.LongType()),
        T.StructField("error_message", T.StringType()),
    ]
)
