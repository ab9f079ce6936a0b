"""The queries of the catalog again, as plain SQL over the given tables."""

from __future__ import annotations

from .fixtures import APPLICATIONS_SQL, RAW_LOANS_SQL
from .functions.rules import RULES
from .schemas import LOAN_COLUMNS, NUMERIC

_ALL = ", ".join(LOAN_COLUMNS)
_MARK = "TIMESTAMP '2000-01-01 00:00:00'"
_INT = "'^[0-9]+$'"
_DEC = r"'^[0-9]+(\.[0-9]+)?$'"
_INTS = ["person_age", "person_emp_exp", "cb_person_cred_hist_length"]
_DECS = ["person_income", "loan_amnt", "loan_int_rate", "loan_percent_income", "credit_score"]


def _int(c: str) -> str:
    return f"TRY_CAST({c} AS INTEGER)"


def _dec(c: str) -> str:
    return f"TRY_CAST({c} AS DOUBLE)"


def _has(c: str, pattern: str) -> str:
    return f"regexp_matches({c}, {pattern})"


_VALUES = {
    "person_age": f"{_int('person_age')} >= 0",
    "person_income": f"{_dec('person_income')} >= 0",
    "person_emp_exp": f"{_int('person_emp_exp')} >= 0",
    "loan_amnt": f"{_dec('loan_amnt')} > 0",
    "loan_int_rate": f"{_dec('loan_int_rate')} >= 0",
    "loan_percent_income": f"{_dec('loan_percent_income')} >= 0",
    "cb_person_cred_hist_length": f"{_int('cb_person_cred_hist_length')} >= 0",
    "credit_score": f"{_dec('credit_score')} BETWEEN 300 AND 850",
}
_VALID = " AND ".join(
    [_has(c, _INT) for c in _INTS]
    + [_has(c, _DEC) for c in _DECS]
    + [_has("loan_status", "'^[0-1]$'")]
    + list(_VALUES.values())
)


def _reason() -> str:
    order = [
        "person_age", "person_income", "person_emp_exp", "loan_amnt", "loan_int_rate",
        "loan_percent_income", "cb_person_cred_hist_length", "credit_score",
    ]
    whens = []
    for c in order:
        pattern = _INT if c in _INTS else _DEC
        word = "range" if c == "credit_score" else "value"
        whens.append(f"WHEN NOT {_has(c, pattern)} THEN 'Invalid {c} format: ' || {c}")
        whens.append(f"WHEN NOT ({_VALUES[c]}) THEN 'Invalid {c} {word}: ' || {c}")
    status = _has("loan_status", "'^[0-1]$'")
    whens.append(f"WHEN NOT {status} THEN 'Invalid loan_status: ' || loan_status")
    return "CASE " + " ".join(whens) + " END"


_TYPED = ", ".join(
    f"{_int(c)} AS {c}" if c in _INTS or c == "loan_status"
    else f"{_dec(c)} AS {c}" if c in _DECS
    else f"lower(trim({c})) AS {c}" if c == "previous_loan_defaults_on_file"
    else c
    for c in LOAN_COLUMNS
)

_DTI = """CASE WHEN loan_percent_income <= 0.2 THEN 'Low Leverage'
 WHEN loan_percent_income <= 0.35 THEN 'Moderate Leverage'
 WHEN loan_percent_income <= 0.43 THEN 'Medium Risk'
 WHEN loan_percent_income <= 0.5 THEN 'High Risk' ELSE 'Very High Risk' END"""
_AGE = """CASE WHEN TRY_CAST(person_age AS BIGINT) BETWEEN 18 AND 30 THEN 'YOUNG'
 WHEN TRY_CAST(person_age AS BIGINT) BETWEEN 31 AND 50 THEN 'MIDDLE-AGE'
 WHEN TRY_CAST(person_age AS BIGINT) BETWEEN 51 AND 80 THEN 'OLD' ELSE 'VERY-OLD' END"""
_EXP = """CASE WHEN TRY_CAST(person_emp_exp AS BIGINT) <= 24 THEN 'FRESH'
 WHEN TRY_CAST(person_emp_exp AS BIGINT) <= 48 THEN 'LOW'
 WHEN TRY_CAST(person_emp_exp AS BIGINT) <= 96 THEN 'MEDIUM' ELSE 'HIGH' END"""


def _gender(x: str) -> str:
    return (
        f"CASE WHEN lower(trim({x})) IN ('male', 'm') THEN 'M'"
        f" WHEN lower(trim({x})) IN ('female', 'f') THEN 'F' ELSE 'U' END"
    )


# Steps the queries build on, each with the ones before it.
_STEPS = {
    "raw_loans": RAW_LOANS_SQL,
    "records": f"""SELECT DISTINCT ON ({_ALL}) {_ALL}, uploaded_at FROM raw_loans
        ORDER BY {_ALL}, uploaded_at ASC""",
    "fresh": f"SELECT * FROM records WHERE uploaded_at > {_MARK}",
    "loans": f"SELECT {_TYPED} FROM records WHERE {_VALID}",
    "measured": f"""SELECT *, {_DTI} AS dti_bucket,
        CASE WHEN loan_status = 1 THEN 1 ELSE 0 END AS is_default,
        person_emp_exp // 12 AS emp_exp_years FROM loans""",
}


def _with(last: str, query: str, **more: str) -> str:
    names = list(_STEPS)
    steps = {n: _STEPS[n] for n in names[: names.index(last) + 1]} | more
    return "WITH " + ",\n".join(f"{n} AS ({s})" for n, s in steps.items()) + "\n" + query


def _pct(part: str, whole: str) -> str:
    return f"round_even({part} / {whole} * 100 * 100, 0) / 100"


def _breakdown(key: str) -> str:
    return _with(
        "measured",
        f"""SELECT {key}, CAST(sum(is_default) AS BIGINT) AS total_default,
        count(*) AS total_loans, {_pct('sum(is_default)', 'count(*)')} AS pct_default
        FROM measured WHERE {key} IS NOT NULL GROUP BY {key}""",
    )


def _kpis(where: str = "TRUE") -> str:
    return _with(
        "measured",
        f"""SELECT count(*) AS total_loans,
        CAST(coalesce(sum(is_default), 0) AS BIGINT) AS total_defaults,
        CASE WHEN count(*) > 0 THEN {_pct('sum(is_default)', 'count(*)')} END AS default_rate
        FROM measured WHERE {where}""",
    )


def _formats(columns: list[str], pattern: str) -> str:
    flags = ", ".join(f"{_has(c, pattern)} AS {c}_ok" for c in columns)
    return _with("raw_loans", f"SELECT {', '.join(columns)}, {flags} FROM raw_loans")


def _overview() -> str:
    keys = {
        "person_education": "person_education",
        "emp_exp_years": "CAST(emp_exp_years AS VARCHAR)",
        "dti_bucket": "dti_bucket",
        "previous_loan_defaults_on_file": "previous_loan_defaults_on_file",
    }
    parts = ["SELECT 'all' AS breakdown, CAST(NULL AS VARCHAR) AS key, is_default FROM measured"]
    parts += [
        f"SELECT '{k}', {text}, is_default FROM measured WHERE {k} IS NOT NULL"
        for k, text in keys.items()
    ]
    return _with(
        "measured",
        f"""SELECT breakdown, key, CAST(sum(is_default) AS BIGINT) AS total_default,
        count(*) AS total_loans, {_pct('sum(is_default)', 'count(*)')} AS pct_default
        FROM long GROUP BY ALL""",
        long=" UNION ALL ".join(parts),
    )


_BY_GENDER = """SELECT person_gender, count(*) AS count FROM loans
    WHERE loan_status = 1 AND person_gender IS NOT NULL GROUP BY person_gender"""

ORACLES: dict[str, str] = {
    "contract_project": _with("raw_loans", f"SELECT {_ALL} FROM raw_loans"),
    "preview": _with(
        "raw_loans",
        "SELECT * FROM raw_loans ORDER BY "
        + ", ".join(f"{c} ASC NULLS FIRST" for c in [*LOAN_COLUMNS, "uploaded_at"])
        + " LIMIT 5",
    ),
    "raw_text": _with(
        "raw_loans",
        "SELECT " + ", ".join(f"coalesce({c}, 'nan') AS {c}" for c in LOAN_COLUMNS)
        + " FROM raw_loans",
    ),
    "drop_all_null": _with(
        "raw_loans",
        f"SELECT {_ALL} FROM raw_loans WHERE person_age IS NOT NULL AND loan_amnt <> '0'",
    ),
    "param_query": _with(
        "loans",
        """SELECT person_education, count(*) AS n, max(loan_amnt) AS largest FROM loans
        WHERE credit_score >= 600 AND loan_status = 1 GROUP BY person_education""",
    ),
    "scan_view": _with("loans", "SELECT * FROM loans"),
    "row_count": _with("loans", "SELECT count(*) AS count FROM loans"),
    "dedupe_earliest": _with("records", "SELECT * FROM records"),
    "incremental_new": _with("fresh", "SELECT * FROM fresh"),
    "fmt_int": _formats(_INTS, _INT),
    "fmt_decimal": _formats([r.column for r in RULES if r.column in _DECS], _DEC),
    "fmt_flag": _formats(["loan_status"], "'^[0-1]$'"),
    "typed_cast": _with(
        "raw_loans",
        "SELECT "
        + ", ".join(f"{_int(c)} AS {c}" for c in [*_INTS, "loan_status"])
        + ", " + ", ".join(f"{_dec(c)} AS {c}" for c in _DECS)
        + " FROM raw_loans",
    ),
    "range_check": _with(
        "raw_loans",
        f"SELECT {', '.join(_VALUES)}, "
        + ", ".join(
            f"CASE WHEN {c} IS NOT NULL THEN coalesce({v}, FALSE) END AS {c}_ok"
            for c, v in _VALUES.items()
        )
        + " FROM raw_loans",
    ),
    "valid_rows": _with("fresh", f"SELECT {_TYPED} FROM fresh WHERE {_VALID}"),
    "reject_rows": _with("records", f"SELECT {_ALL} FROM records WHERE NOT ({_VALID})"),
    "norm_flag": _with(
        "raw_loans",
        """SELECT previous_loan_defaults_on_file AS given,
        lower(trim(previous_loan_defaults_on_file)) AS flag FROM raw_loans""",
    ),
    "reject_reason": _with(
        "records", f"SELECT {_ALL}, {_reason()} AS error_reason FROM records WHERE NOT ({_VALID})"
    ),
    "run_counts": _with(
        "fresh",
        f"""SELECT count(*) FILTER ({_VALID}) AS valid_count,
        count(*) FILTER (NOT ({_VALID})) AS reject_count,
        count(*) FILTER (({_VALID}) IS NULL) AS unclassified_count FROM fresh""",
    ),
    "dti_bucket": _with("loans", f"SELECT loan_percent_income, {_DTI} AS dti_bucket FROM loans"),
    "default_flag": _with(
        "raw_loans",
        """SELECT loan_status, CASE WHEN TRY_CAST(loan_status AS INTEGER) = 1 THEN 1 ELSE 0 END
        AS is_default FROM raw_loans""",
    ),
    "exp_years": _with(
        "loans", "SELECT person_emp_exp, person_emp_exp // 12 AS emp_exp_years FROM loans"
    ),
    "to_number_strict": _with(
        "raw_loans", "SELECT person_income, CAST(person_income AS DOUBLE) AS number FROM raw_loans"
    ),
    "to_number_lenient": _with(
        "raw_loans", "SELECT person_age, TRY_CAST(person_age AS DOUBLE) AS number FROM raw_loans"
    ),
    "norm_gender": _with(
        "raw_loans",
        f"SELECT given, {_gender('given')} AS gender FROM given",
        given="""SELECT unnest([person_gender, person_education, upper(person_gender)]) AS given
        FROM raw_loans""",
    ),
    "age_bucket": _with("raw_loans", f"SELECT person_age, {_AGE} AS age_bucket FROM raw_loans"),
    "exp_bucket": _with("raw_loans", f"SELECT person_emp_exp, {_EXP} AS exp_bucket FROM raw_loans"),
    "kpis": _kpis(),
    "defaults_by_gender": _with("loans", _BY_GENDER),
    "gender_share": _with(
        "loans",
        f"""SELECT *, {_pct('count', '(SELECT sum(count) FROM counts)')} AS share FROM counts""",
        counts=_BY_GENDER,
    ),
    "age_by_gender": _with(
        "measured",
        """SELECT person_gender, CASE is_default WHEN 1 THEN 'Yes' ELSE 'No' END AS "default",
        min(person_age) AS min, max(person_age) AS max, avg(person_age) AS mean
        FROM measured WHERE person_gender IS NOT NULL GROUP BY ALL""",
    ),
    "age_histogram": _with(
        "loans",
        """SELECT floor(person_age / width) * width AS bin_start, count(*) AS count
        FROM loans, width WHERE person_age IS NOT NULL GROUP BY ALL""",
        span="SELECT min(person_age) AS low, max(person_age) AS high FROM loans",
        width="""SELECT min(CAST(s * pow(10, e) AS DOUBLE)) AS width FROM span,
            (VALUES (1), (2), (5)) a(s), range(0, 18) b(e)
            WHERE floor(high / (s * pow(10, e))) - floor(low / (s * pow(10, e))) < 30""",
    ),
    "by_education": _breakdown("person_education"),
    "by_exp_years": _breakdown("emp_exp_years"),
    "by_dti": _breakdown("dti_bucket"),
    "by_prev_default": _breakdown("previous_loan_defaults_on_file"),
    "kpis_empty": _kpis("loan_amnt < 0"),
    "overview": _overview(),
}

# --- stored tables, features and models -------------------------------------------

_STATES = f"""SELECT ({_VALID}) AS ok, uploaded_at > {_MARK} AS second FROM records"""
_RUN_COUNTS = """CAST(count(*) FILTER (ok) AS BIGINT) AS success_count,
    CAST(count(*) FILTER (NOT ok) AS BIGINT) AS reject_count"""


def _log(second_run: str, columns: str = "", extra: str = "") -> str:
    # A record first uploaded up to the mark belongs to the first run, the rest to the second.
    return _with(
        "records",
        f"""SELECT {_MARK} AS date_time, 'SUCCESS' AS status, {_RUN_COUNTS} {columns}
        FROM states WHERE NOT second
        UNION ALL SELECT {second_run}, 'SUCCESS', {_RUN_COUNTS} {columns}
        FROM states WHERE second {extra}""",
        states=_STATES,
    )


_ENCODED = f"""SELECT {_AGE} AS person_age, {_gender('person_gender')} AS person_gender,
    person_education, person_income, {_EXP} AS person_emp_exp, person_home_owner, loan_amnt,
    loan_intent, loan_int_rate, loan_percent_income, cb_person_cred_hist_length::DOUBLE
    AS cb_person_cred_hist_length, credit_score, previous_loan_defaults_on_file, loan_status
    FROM loans"""
_CATEGORIES = [c for c in LOAN_COLUMNS if c not in NUMERIC and c != "loan_status"]
# Number of levels each categorical feature has in the given tables.
_LEVELS = dict(zip(_CATEGORIES, (4, 2, 5, 4, 3, 5, 2)))


def _round(x: str) -> str:
    return f"round_even(({x}) * 1000000.0::DOUBLE, 0) / 1000000.0::DOUBLE"


def _scaled(c: str) -> str:
    return f"(ln(1 + {c}) - avg(ln(1 + {c})) OVER ()) / stddev_pop(ln(1 + {c})) OVER ()"


def _hot(c: str, level: int) -> str:
    return f"CAST(dense_rank() OVER (ORDER BY {c}) = {level} AS INTEGER)"


_NOISY = """SELECT CAST(((credit_score < 400 OR loan_percent_income > 0.62)
    <> (CAST(round(loan_amnt * 100) AS BIGINT) % 10 = 0)) AS INTEGER) AS loan_status FROM loans"""
_LISTS = {
    "person_age": "person_age BETWEEN 18 AND 100",
    "person_income": "person_income >= 0",
    "person_emp_exp": "person_emp_exp >= 0",
    "loan_amnt": "loan_amnt >= 0",
    "loan_int_rate": "loan_int_rate BETWEEN 0 AND 100",
    "loan_percent_income": "loan_percent_income >= 0",
    "cb_person_cred_hist_length": "cb_person_cred_hist_length >= 0",
    "credit_score": "credit_score BETWEEN 300 AND 850",
    "person_gender": "person_gender IN ('Male', 'Female')",
    "person_education": "person_education IN ('High School', 'Bachelor', 'Master', 'PhD', 'Other')",
    "person_home_owner": "person_home_owner IN ('Rent', 'Own', 'Mortgage', 'Other')",
    "loan_intent": """loan_intent IN
        ('Personal', 'Education', 'Medical', 'Venture', 'Home', 'Other')""",
    "previous_loan_defaults_on_file": "previous_loan_defaults_on_file IN ('yes', 'no')",
}
_INVALID = "concat_ws(', ', " + ", ".join(
    f"CASE WHEN NOT coalesce({ok}, FALSE) THEN '{c}' END" for c, ok in _LISTS.items()
) + ")"

_TEST = "loan_status, loan_status AS prediction, n - train AS count"
_MODELS = "(VALUES ('Logistic Regression'), ('Random Forest')) m(model)"


def _parts(select: str, labels: str) -> str:
    """A query on `cut`: per class its rows and how many of them are for training."""
    return _with(
        "loans",
        select,
        labels=labels,
        sizes="""SELECT loan_status, count(*) AS n, CAST(sum(count(*)) OVER () AS BIGINT) AS total
        FROM labels GROUP BY loan_status""",
        shares="""SELECT *, total - CAST(ceil(total / 5) AS BIGINT) AS kept FROM sizes""",
        floors="""SELECT *, n * kept // total AS base, n * kept % total AS rest FROM shares""",
        cut="""SELECT *, base + CAST(row_number() OVER (ORDER BY rest DESC, loan_status)
            <= kept - sum(base) OVER () AS BIGINT) AS train FROM floors""",
    )


ORACLES |= {
    "csv_ingest": ORACLES["raw_text"],
    "contract_check": _with(
        "raw_loans",
        """SELECT 'exact' AS upload, CAST(NULL AS VARCHAR) AS error, count(*) AS accepted_rows
        FROM raw_loans UNION ALL
        SELECT 'short', 'upload lacks the columns [''loan_status'']', 0 UNION ALL
        SELECT 'long', 'upload has unknown columns [''uploaded_at'']', 0""",
    ),
    "raw_append": _with(
        "raw_loans", f"SELECT {_ALL}, TIMESTAMP '2003-01-01' AS uploaded_at FROM raw_loans"
    ),
    "upload_history": _log(
        "TIMESTAMP '2003-01-01'", ", CAST(NULL AS VARCHAR) AS error_message"
    ),
    "high_water_mark": _with(
        "records",
        f"""SELECT status, max(date_time) AS latest, status = 'SUCCESS' AS is_mark FROM log
        GROUP BY status""",
        log=f"""SELECT {_MARK} AS date_time, 'SUCCESS' AS status
        UNION ALL SELECT TIMESTAMP '2003-01-01', 'FAILED'
        UNION ALL SELECT TIMESTAMP '2004-01-01', 'SUCCESS'""",
    ),
    "fact_load": ORACLES["scan_view"],
    "loan_ids": _with(
        "loans",
        """SELECT count(*) AS n, count(*) AS different, CAST(1 AS BIGINT) AS lowest,
        count(*) AS highest FROM loans""",
    ),
    "reject_load": ORACLES["reject_reason"],
    "audit_log": _with(
        "records",
        f"SELECT 'SUCCESS' AS status, CAST(2 AS BIGINT) AS runs, {_RUN_COUNTS} FROM states",
        states=_STATES,
    ),
    "audit_failed": _log(
        "TIMESTAMP '2004-01-01'",
        extra="UNION ALL SELECT TIMESTAMP '2003-01-01', 'FAILED', 0, 0",
    ),
    "mv_refresh": ORACLES["scan_view"],
    "run_etl": ORACLES["scan_view"],
    "rerun_noop": """SELECT TIMESTAMP '2004-01-01' + INTERVAL 1 DAY * d AS date_time,
        'SUCCESS' AS status, CAST(0 AS BIGINT) AS success_count, CAST(0 AS BIGINT) AS reject_count
        FROM (VALUES (0), (1)) t(d)""",
    "log1p_features": _with(
        "loans",
        "SELECT " + ", ".join(f"{_round(f'ln(1 + {c})')} AS {c}" for c in NUMERIC) + " FROM loans",
    ),
    "train_contract": _with(
        "loans",
        """SELECT count(*) AS "rows",
        'training needs the columns [''loan_status'']' AS refusal FROM loans""",
    ),
    "drop_incomplete": _with(
        "raw_loans",
        "SELECT " + ", ".join(f"{_dec(c)} AS {c}" if c in NUMERIC else c for c in LOAN_COLUMNS)
        + " FROM raw_loans WHERE loan_amnt <> '0' AND credit_score >= '300'",
    ),
    "features": _with("loans", "SELECT * FROM encoded", encoded=_ENCODED),
    "scale_features": _with(
        "loans",
        "SELECT " + ", ".join(f"{_round(_scaled(c))} AS {c}" for c in NUMERIC) + " FROM loans",
    ),
    "one_hot": _with(
        "loans",
        f"SELECT {', '.join(_CATEGORIES)}, "
        + ", ".join(
            f"{_hot(c, i)} AS {c}_{i}" for c, n in _LEVELS.items() for i in range(1, n + 1)
        )
        + " FROM encoded",
        encoded=_ENCODED,
    ),
    "assemble": _with(
        "loans",
        "SELECT " + ", ".join(
            f"{x} AS f{n}" for n, x in enumerate(
                [_round(_scaled(c)) for c in NUMERIC]
                + [f"{_hot(c, i)}::DOUBLE" for c, n in _LEVELS.items() for i in range(1, n + 1)],
                start=1,
            )
        ) + " FROM encoded",
        encoded=_ENCODED,
    ),
    "stratified_split": _parts(
        """SELECT part, loan_status, CASE part WHEN 'train' THEN train ELSE n - train END AS n
        FROM cut, (VALUES ('train'), ('test')) p(part)""",
        _NOISY,
    ),
    "logreg_fit": _parts(
        f"SELECT {_TEST}, TRUE AS at_minimum FROM cut", "SELECT loan_status FROM loans"
    ),
    "rf_fit": _parts(f"SELECT {_TEST} FROM cut", "SELECT loan_status FROM loans"),
    "pipeline_fit": _with(
        "loans",
        """SELECT loan_status AS logistic, loan_status AS prediction, count(*) AS count FROM loans
        GROUP BY ALL""",
    ),
    "predict": _with(
        "loans", "SELECT *, loan_status AS prediction FROM encoded", encoded=_ENCODED
    ),
    "decision": _with(
        "loans",
        """SELECT loan_status, loan_status AS prediction,
        CASE loan_status WHEN 0 THEN 'Approved' ELSE 'Denied' END AS decision FROM loans""",
    ),
    "score_lookup": _with("loans", f"SELECT model, count(*) > 0 AS same FROM loans, {_MODELS} GROUP BY model"),
    "train_job": _with(
        "loans",
        f"""SELECT model, 1.0::DOUBLE AS accuracy, count(*) AS labelled_rows,
        count(*) AS available_rows FROM loans, {_MODELS} GROUP BY model""",
    ),
    "batch_score": f"""WITH given AS ({APPLICATIONS_SQL}), applications AS (
        SELECT * REPLACE (lower(previous_loan_defaults_on_file) AS previous_loan_defaults_on_file)
        FROM given)
        SELECT application_id, {_INVALID} AS invalid_fields, {_INVALID} = '' AS decided,
        TRUE AS consistent FROM applications""",
    "smote": _with(
        "loans",
        f"""SELECT loan_status AS label, FALSE AS synthetic, n,
        {len(NUMERIC) + sum(_LEVELS.values())} AS width FROM sizes
        UNION ALL SELECT loan_status, TRUE, (SELECT max(n) FROM sizes) - n,
        {len(NUMERIC) + sum(_LEVELS.values())} FROM sizes WHERE n < (SELECT max(n) FROM sizes)""",
        noisy=_NOISY,
        sizes="SELECT loan_status, count(*) AS n FROM noisy GROUP BY loan_status",
    ),
    "model_roundtrip": _with(
        "loans", "SELECT TRUE AS same, CAST(ceil(count(*) / 5) AS BIGINT) AS count FROM loans"
    ),
    "accuracy": _with(
        "loans",
        """SELECT avg(CAST((loan_percent_income > 0.43) = (loan_status = 1) AS DOUBLE)) AS accuracy
        FROM loans""",
    ),
    "score_input_check": f"""WITH applications AS ({APPLICATIONS_SQL})
        SELECT *, {_INVALID} AS invalid_fields, {_INVALID} = '' AS is_valid FROM applications""",
    "refresh_job": _with(
        "records", f"SELECT {_RUN_COUNTS}, 2 AS models FROM states",
        # In text form a missing age reads 'nan', which is a format failure.
        states=f"SELECT coalesce(({_VALID}), FALSE) AS ok FROM records",
    ),
}

# What cells add up to is what a scan of all loans gives.
ORACLES |= {
    f"{measure}_of_cells": ORACLES[measure]
    for measure in ("kpis", "overview", "gender_share", "age_by_gender", "age_histogram")
}
