import pytest
from pyspark.sql import functions as F

from loanmill.functions import scalars
from loanmill.operators import clean, dashboard
from loanmill.operators.applications import check_applications
from loanmill.schemas import LOAN_COLUMNS
from loanmill.sources import upload
from loanmill.streaming.load import follow_uploads
from loanmill.sources.store import LoanStore
from test_store import START, frame, record

# One changed field and the reason expected: None for valid rows, ... for vanishing ones.
CASES = [
    ({}, None),
    ({"person_age": "25\n"}, "Invalid person_age format: 25\n"),
    ({"person_age": "99999999999"}, "Invalid person_age value: 99999999999"),
    ({"person_age": "-1"}, "Invalid person_age format: -1"),
    ({"person_age": "+1"}, "Invalid person_age format: +1"),
    ({"person_age": "25.0"}, "Invalid person_age format: 25.0"),
    ({"person_age": "nan"}, "Invalid person_age format: nan"),
    ({"person_age": "٣"}, "Invalid person_age format: ٣"),
    ({"person_age": "007"}, None),
    ({"person_income": "1."}, "Invalid person_income format: 1."),
    ({"person_income": ".5"}, "Invalid person_income format: .5"),
    ({"person_income": "1e3"}, "Invalid person_income format: 1e3"),
    ({"person_income": "9" * 400}, "Invalid person_income value: " + "9" * 400),
    ({"person_income": "0"}, None),
    ({"person_emp_exp": " 3"}, "Invalid person_emp_exp format:  3"),
    ({"loan_amnt": "0"}, "Invalid loan_amnt value: 0"),
    ({"loan_amnt": "0.00"}, "Invalid loan_amnt value: 0.00"),
    ({"loan_amnt": "0.01"}, None),
    ({"credit_score": "300"}, None),
    ({"credit_score": "850"}, None),
    ({"credit_score": "299.9"}, "Invalid credit_score range: 299.9"),
    ({"credit_score": "850.1"}, "Invalid credit_score range: 850.1"),
    ({"loan_status": "2"}, "Invalid loan_status: 2"),
    ({"loan_status": "1\n"}, "Invalid loan_status: 1\n"),
    ({"loan_status": "01"}, "Invalid loan_status: 01"),
    ({"person_gender": None, "loan_intent": ""}, None),
    ({"person_age": None}, ...),
    ({"loan_status": None}, ...),
    ({"person_age": None, "loan_amnt": "0"}, "Invalid loan_amnt value: 0"),
    ({"credit_score": "abc", "person_age": "x"}, "Invalid person_age format: x"),
    ({"loan_status": "5", "credit_score": None}, "Invalid loan_status: 5"),
]


def test_reasons(spark):
    rows = frame(spark, *(record(**changes) for changes, _ in CASES))
    numbered = rows.coalesce(1).withColumn("n", F.monotonically_increasing_id())
    got = {r.n: (r.outcome, r.error_reason) for r in clean.classify(numbered).collect()}
    for n, (changes, expected) in enumerate(CASES):
        outcome = {None: "valid", ...: "unclassified"}.get(expected, "reject")
        reason = expected if outcome == "reject" else None
        assert got[n] == (outcome, reason), changes
    valid = sum(e is None for _, e in CASES)
    reject = sum(isinstance(e, str) for _, e in CASES)
    assert clean.valid_rows(rows).count() == valid
    assert clean.reject_rows(rows).count() == reject


def test_record_key_tells_nulls_and_borders_apart(spark):
    rows = frame(
        spark, record(person_age=None), record(person_age="-"), record(person_age=""),
        record(person_age="1", person_gender="2:x"), record(person_age="1:2", person_gender="x"),
        record(person_age="12", person_gender="3"), record(person_age="1", person_gender="23"),
    )
    assert rows.select(clean.record_key().alias("k")).distinct().count() == 7


def test_dedupe_treats_nulls_as_equal(spark):
    rows = frame(spark, record(person_age=None), record(person_age=None), record())
    assert clean.keep_earliest(rows.withColumn("uploaded_at", clean.moment(START))).count() == 2


def values(spark, function, *given, type="string"):
    rows = [(i, x) for i, x in enumerate(given)]
    df = spark.createDataFrame(rows, f"i int, x {type}")
    return [r[0] for r in df.orderBy("i").select(function(F.col("x"))).collect()]


def test_scalars(spark):
    assert values(spark, scalars.age_bucket, "17", "18", "30", "31", "50", "51", "80", "81", " 25 ",
                  "25.9", None, "x") == [
        "VERY-OLD", "YOUNG", "YOUNG", "MIDDLE-AGE", "MIDDLE-AGE", "OLD", "OLD", "VERY-OLD",
        "YOUNG", "VERY-OLD", "VERY-OLD", "VERY-OLD"]
    assert values(spark, scalars.age_bucket, 30.9, float("nan"), type="double") == [
        "YOUNG", "VERY-OLD"]
    assert values(spark, scalars.experience_bucket, "-5", "24", "25", "48", "49", "96", "97", "x",
                  None) == ["FRESH", "FRESH", "LOW", "LOW", "MEDIUM", "MEDIUM", "HIGH", "HIGH",
                            "HIGH"]
    assert values(spark, scalars.gender_code, "\tMale\n", "m", "F", "female ", "x", "", None) == [
        "M", "M", "F", "F", "U", "U", "U"]
    assert values(spark, scalars.trimmed_lower, " Yes ", "\tNo") == ["yes", "\tno"]
    assert values(spark, scalars.dti_bucket, 0.2, 0.35, 0.43, 0.5, 0.51, None, float("nan"),
                  type="double") == ["Low Leverage", "Moderate Leverage", "Medium Risk",
                                     "High Risk"] + ["Very High Risk"] * 3
    assert values(spark, scalars.number_or_null, "1e3", "1d", " 2 ", "x", "", None, ".5", "5.") == [
        1000.0, None, 2.0, None, None, None, 0.5, 5.0]
    assert values(spark, scalars.whole_years, 0, 11, 12, 35, type="int") == [0, 0, 1, 2]
    half = lambda x: scalars.round_half_even(x, 2)
    assert values(spark, half, 0.125, 0.375, type="double") == [0.12, 0.38]
    with pytest.raises(Exception, match="not a number: x"):
        values(spark, scalars.number_or_error, "1", "x")


@pytest.mark.parametrize("low, high, width", [(18, 90, 5), (18, 40, 1), (18, 18, 1), (0, 30, 2),
                                              (0, 31, 2), (0, 3000, 200), (18, 2_000_000, 100_000),
                                              (0, 2**31 - 1, 100_000_000)])
def test_histogram_bins(spark, low, high, width):
    ages = spark.createDataFrame([(low,), (high,)], "person_age int").selectExpr(
        "person_age", "0.1D AS loan_percent_income", "1 AS person_emp_exp", "1 AS loan_status")
    bins = {r.bin_start for r in dashboard.age_histogram(ages).collect()}
    assert bins == {low // width * width, high // width * width}


def test_dashboard_without_loans_or_columns(spark):
    empty = spark.createDataFrame(
        [], "person_age int, loan_percent_income double, person_emp_exp int, loan_status int,"
        " person_gender string, person_education string")
    assert dashboard.kpis(empty).first().asDict() == {
        "total_loans": 0, "total_defaults": 0, "default_rate": None}
    assert dashboard.gender_share(empty).count() == 0
    assert dashboard.age_histogram(empty).count() == 0
    assert dashboard.default_breakdown(empty, "person_education").count() == 0
    assert dashboard.previous_default_breakdown(empty) is None


def test_null_keys_are_left_out(spark):
    rows = spark.createDataFrame(
        [("a", 1), (None, 1)], "person_gender string, loan_status int").selectExpr(
        "*", "person_gender AS person_education", "20 AS person_age", "5 AS person_emp_exp",
        "0.1D AS loan_percent_income", "person_gender AS previous_loan_defaults_on_file")
    assert dashboard.default_breakdown(rows, "person_education").count() == 1
    assert dashboard.defaults_by_gender(rows).count() == 1
    parts = {(r.breakdown, r.key): r.total_loans for r in dashboard.overview(rows).collect()}
    assert parts[("all", None)] == 2 and parts[("person_education", "a")] == 1
    assert ("person_education", None) not in parts


def test_application_bounds(spark):
    fine = dict(
        person_age=18, person_gender="Male", person_education="PhD", person_income=0.0,
        person_emp_exp=0, person_home_owner="Own", loan_amnt=0.0, loan_intent="Home",
        loan_int_rate=100.0, loan_percent_income=0.0, cb_person_cred_hist_length=0,
        credit_score=850, previous_loan_defaults_on_file="no")
    bad = {**fine, "person_age": 101, "credit_score": None, "loan_intent": "Boat"}
    rows = spark.createDataFrame([fine, bad])
    got = check_applications(rows).orderBy("person_age").collect()
    assert (got[0].is_valid, got[0].invalid_fields) == (True, "")
    assert (got[1].is_valid, got[1].invalid_fields) == (
        False, "person_age, credit_score, loan_intent")


def test_query_parameters(spark):
    frame(spark, record(), record(person_age="50")).createOrReplaceTempView("some_loans")
    sql = "SELECT count(*) AS n FROM some_loans WHERE person_age = :age"
    assert upload.run_query(spark, sql, {"age": "50"}).first().n == 1
    assert upload.run_query(spark, "SELECT count(*) AS n FROM some_loans").first().n == 2


def test_runs_follow_uploads(spark, folder):
    store = LoanStore(spark, f"{folder}/store")

    def drain():
        follow_uploads(store, f"{folder}/checkpoint").awaitTermination()

    store.append_raw(frame(spark, record(), record(person_age="x")))
    drain()
    assert (store.loans().count(), store.rejects().count()) == (1, 1)
    store.append_raw(frame(spark, record(), record(person_age="44")))
    drain()
    drain()
    assert store.loans().count() == 2
    assert [r.success_count for r in store.upload_history().orderBy("date_time").collect()] == [1, 1]
    assert set(store.loans().columns) == {"loan_id", *LOAN_COLUMNS}
