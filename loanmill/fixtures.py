"""Loan records derived from the orders and customer tables, and the same in plain SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import LOAN_COLUMNS


def _money(x: Column) -> Column:
    # Through a decimal: engines do not print doubles alike.
    return x.cast("decimal(18,2)").cast("string")


def raw_loans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order of a known customer as one uploaded record; every tenth is uploaded
    again 400 days later. Holds bad formats, bad values, nulls and untrimmed texts."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    k, ck = F.col("o_orderkey"), F.col("c_custkey")
    fields = {
        "person_age": F.when(k % 97 == 0, "abc")
        .when(k % 101 == 0, None)
        .otherwise((18 + ck % 73).cast("string")),
        "person_gender": F.when(ck % 3 == 0, "male").when(ck % 3 == 1, "female").otherwise("M"),
        "person_education": F.col("o_orderpriority"),
        "person_income": _money(F.col("c_acctbal")),
        "person_emp_exp": (ck % 120).cast("string"),
        "person_home_owner": F.col("o_orderstatus"),
        "loan_amnt": F.when(k % 89 == 0, "0").otherwise(_money(F.col("o_totalprice"))),
        "loan_intent": F.col("c_mktsegment"),
        "loan_int_rate": ((k % 2000) / 100.0).cast("decimal(6,2)").cast("string"),
        "loan_percent_income": ((k * 7 % 70) / 100.0).cast("decimal(4,2)").cast("string"),
        "cb_person_cred_hist_length": (ck % 30).cast("string"),
        "credit_score": (280 + k % 600).cast("string"),
        "previous_loan_defaults_on_file": F.when(k % 2 == 0, " Yes").otherwise("No "),
        "loan_status": F.when(k % 83 == 0, "2")
        .when(F.col("o_orderstatus") == "F", "1")
        .otherwise("0"),
    }
    once = F.struct(*LOAN_COLUMNS, "uploaded_at")
    again = F.struct(*LOAN_COLUMNS, F.expr("uploaded_at + INTERVAL 400 DAY").alias("uploaded_at"))
    uploads = F.when(F.col("twice"), F.array(once, again)).otherwise(F.array(once))
    # The records come out of the generator, so conditions on them are checked against
    # finished columns and not against the expressions above.
    return (
        orders.join(customer, F.col("o_custkey") == ck)
        .select(
            *(fields[c].alias(c) for c in LOAN_COLUMNS),
            F.col("o_orderdate").cast("timestamp_ntz").alias("uploaded_at"),
            (k % 10 == 0).alias("twice"),
        )
        .select(F.inline(uploads))
    )


def noisy_loans(loans: DataFrame) -> DataFrame:
    """Cleaned loans with a label that does not simply repeat another column, for training."""
    risky = (F.col("credit_score") < 400) | (F.col("loan_percent_income") > 0.62)
    flipped = F.round(F.col("loan_amnt") * 100).cast("bigint") % 10 == 0
    return loans.withColumn("loan_status", (risky != flipped).cast("int"))


def gappy_loans(raw: DataFrame) -> DataFrame:
    """Landed records in which zero amounts are missing and low scores unreadable."""
    return raw.withColumns(
        {
            "loan_amnt": F.when(F.col("loan_amnt") != "0", F.col("loan_amnt")),
            "credit_score": F.when(F.col("credit_score") < "300", "n/a").otherwise(
                F.col("credit_score")
            ),
        }
    )


def applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order of a known customer as a loan application, some out of bounds."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    k, ck = F.col("o_orderkey"), F.col("c_custkey")

    def one_of(n: Column, *values: str) -> Column:
        return F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))

    return orders.join(customer, F.col("o_custkey") == ck).select(
        k.alias("application_id"),
        (15 + ck % 90).cast("int").alias("person_age"),
        one_of(ck, "Male", "Female").alias("person_gender"),
        one_of(ck, "High School", "Bachelor", "Master", "PhD", "Other", "None").alias(
            "person_education"
        ),
        F.col("c_acctbal").alias("person_income"),
        (ck % 120).cast("int").alias("person_emp_exp"),
        one_of(k, "Rent", "Own", "Mortgage", "Other").alias("person_home_owner"),
        F.col("o_totalprice").alias("loan_amnt"),
        one_of(k, "Personal", "Education", "Medical", "Venture", "Home", "Other").alias(
            "loan_intent"
        ),
        (k % 2100 / 20.0).alias("loan_int_rate"),
        (k * 7 % 70 / 100.0).alias("loan_percent_income"),
        (ck % 30).cast("int").alias("cb_person_cred_hist_length"),
        F.when(k % 101 != 0, (280 + k % 600).cast("double")).alias("credit_score"),
        one_of(k, "yes", "no", "Yes").alias("previous_loan_defaults_on_file"),
    )


RAW_LOANS_SQL = """
WITH base AS (
  SELECT o.o_orderkey AS k, c.c_custkey AS ck, o.o_orderdate AS d, o.o_orderstatus AS st,
         o.o_orderpriority AS pr, c.c_mktsegment AS seg, o.o_totalprice AS tp, c.c_acctbal AS ab
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey),
r AS (
  SELECT k,
    CASE WHEN k % 97 = 0 THEN 'abc' WHEN k % 101 = 0 THEN NULL
         ELSE CAST(18 + ck % 73 AS STRING) END AS person_age,
    CASE ck % 3 WHEN 0 THEN 'male' WHEN 1 THEN 'female' ELSE 'M' END AS person_gender,
    pr AS person_education,
    CAST(CAST(ab AS DECIMAL(18,2)) AS STRING) AS person_income,
    CAST(ck % 120 AS STRING) AS person_emp_exp,
    st AS person_home_owner,
    CASE WHEN k % 89 = 0 THEN '0' ELSE CAST(CAST(tp AS DECIMAL(18,2)) AS STRING) END AS loan_amnt,
    seg AS loan_intent,
    CAST(CAST((k % 2000) / 100.0 AS DECIMAL(6,2)) AS STRING) AS loan_int_rate,
    CAST(CAST(((k * 7) % 70) / 100.0 AS DECIMAL(4,2)) AS STRING) AS loan_percent_income,
    CAST(ck % 30 AS STRING) AS cb_person_cred_hist_length,
    CAST(280 + k % 600 AS STRING) AS credit_score,
    CASE WHEN k % 2 = 0 THEN ' Yes' ELSE 'No ' END AS previous_loan_defaults_on_file,
    CASE WHEN k % 83 = 0 THEN '2' WHEN st = 'F' THEN '1' ELSE '0' END AS loan_status,
    d AS uploaded_at
  FROM base)
SELECT * EXCLUDE (k) FROM r
UNION ALL
SELECT * EXCLUDE (k) REPLACE (uploaded_at + INTERVAL 400 DAY AS uploaded_at) FROM r
WHERE k % 10 = 0
"""

APPLICATIONS_SQL = """
SELECT o_orderkey AS application_id, CAST(15 + c_custkey % 90 AS INTEGER) AS person_age,
  ['Male', 'Female'][c_custkey % 2 + 1] AS person_gender,
  ['High School', 'Bachelor', 'Master', 'PhD', 'Other', 'None'][c_custkey % 6 + 1]
    AS person_education,
  c_acctbal AS person_income, CAST(c_custkey % 120 AS INTEGER) AS person_emp_exp,
  ['Rent', 'Own', 'Mortgage', 'Other'][o_orderkey % 4 + 1] AS person_home_owner,
  o_totalprice AS loan_amnt,
  ['Personal', 'Education', 'Medical', 'Venture', 'Home', 'Other'][o_orderkey % 6 + 1]
    AS loan_intent,
  o_orderkey % 2100 / 20.0::DOUBLE AS loan_int_rate,
  o_orderkey * 7 % 70 / 100.0::DOUBLE AS loan_percent_income,
  CAST(c_custkey % 30 AS INTEGER) AS cb_person_cred_hist_length,
  CASE WHEN o_orderkey % 101 <> 0 THEN CAST(280 + o_orderkey % 600 AS DOUBLE) END AS credit_score,
  ['yes', 'no', 'Yes'][o_orderkey % 3 + 1] AS previous_loan_defaults_on_file
FROM orders JOIN customer ON o_custkey = c_custkey
"""
