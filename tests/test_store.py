import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import SF
from loanmill import fixtures
from loanmill.operators import clean
from loanmill.plans import etl
from loanmill.plans.etl import run_etl
from loanmill.schemas import FACT_SCHEMA, LOAN_COLUMNS
from loanmill.sources import upload
from loanmill.sources.store import LoanStore, LostRace, now
from oracle import spark_bag

DAY = dt.timedelta(days=1)
START = dt.datetime(2001, 1, 1)


def record(**changes):
    row = {
        "person_age": "30", "person_gender": "male", "person_education": "Master",
        "person_income": "50000", "person_emp_exp": "12", "person_home_owner": "Rent",
        "loan_amnt": "1000.5", "loan_intent": "Home", "loan_int_rate": "7.5",
        "loan_percent_income": "0.2", "cb_person_cred_hist_length": "4", "credit_score": "650",
        "previous_loan_defaults_on_file": "No", "loan_status": "0",
    }
    return {**row, **changes}


def frame(spark, *rows):
    schema = ", ".join(f"{c} string" for c in LOAN_COLUMNS)
    return spark.createDataFrame([tuple(r[c] for c in LOAN_COLUMNS) for r in rows], schema)


def test_incremental_run_equals_full_history(spark, folder):
    raw = fixtures.raw_loans(spark, SF)
    mark = dt.datetime(2000, 1, 1)
    store = LoanStore(spark, folder)
    old = F.col("uploaded_at") <= clean.moment(mark)
    store.append_raw(raw.where(old))
    first = run_etl(store, at=mark)
    store.append_raw(raw.where(~old))
    second = run_etl(store, at=START)
    assert (second.success_count, second.reject_count, second.unclassified_count) == (2939, 690, 31)
    both = clean.keep_earliest(raw)
    assert spark_bag(store.loans().drop("loan_id")) == spark_bag(clean.valid_rows(both))
    assert spark_bag(store.rejects()) == spark_bag(clean.reject_rows(both))
    ids = store.loans().agg(F.min("loan_id"), F.max("loan_id"), F.countDistinct("loan_id")).first()
    total = first.success_count + second.success_count
    assert tuple(ids) == (1, total, total)
    assert store.loans().schema == FACT_SCHEMA
    again = run_etl(store, at=START + DAY)
    assert (again.success_count, again.reject_count) == (0, 0)
    log = store.upload_history().orderBy("date_time").collect()
    assert [r.status for r in log] == ["SUCCESS"] * 3
    assert [r.success_count for r in log] == [first.success_count, 2939, 0]


def test_reupload_of_known_records_loads_nothing(spark, folder):
    store = LoanStore(spark, folder)
    rows = frame(spark, record(), record(person_age="x"), record(person_age="31"))
    store.append_raw(rows, at=START)
    assert run_etl(store, at=START + DAY).success_count == 2
    store.append_raw(rows, at=START + 2 * DAY)
    result = run_etl(store, at=START + 3 * DAY)
    assert (result.success_count, result.reject_count) == (0, 0)
    assert store.raw().count() == 6


def test_failed_run_is_logged_and_loses_nothing(spark, folder, monkeypatch):
    store = LoanStore(spark, folder)
    store.append_raw(frame(spark, record()), at=START)
    run_etl(store, at=START + DAY)
    store.append_raw(frame(spark, record(person_age="40"), record(person_age="")), at=START + 2 * DAY)

    def broken(self, run_id, rejects):
        raise OSError("disk full")

    with monkeypatch.context() as patch:
        patch.setattr(LoanStore, "write_rejects", broken)
        with pytest.raises(OSError):
            run_etl(store, at=START + 3 * DAY)
    assert store.loans().count() == 1  # the loans that run did write stay unseen
    failed = store.upload_history().where("status = 'FAILED'").first()
    assert (failed.success_count, failed.reject_count, failed.error_message) == (0, 0, "disk full")
    result = run_etl(store, at=START + 4 * DAY)
    assert (result.success_count, result.reject_count) == (1, 1)
    assert store.loans().count() == 2


def test_late_records_are_never_loaded(spark, folder):
    store = LoanStore(spark, folder)
    store.append_raw(frame(spark, record()), at=START)
    run_etl(store, at=START + 5 * DAY)
    late = record(person_age="50")
    store.append_raw(frame(spark, late), at=START + 2 * DAY)
    assert run_etl(store, at=START + 6 * DAY).success_count == 0
    store.append_raw(frame(spark, late), at=START + 7 * DAY)
    assert run_etl(store, at=START + 8 * DAY).success_count == 0
    full = clean.newer_than(clean.keep_earliest(store.raw()), START + 6 * DAY)
    assert full.count() == 0


def test_view_is_a_snapshot(spark, folder):
    store = LoanStore(spark, folder)
    assert store.view().count() == 0
    store.append_raw(frame(spark, record()), at=START)
    run_etl(store, at=START + DAY)
    before = store.view()
    store.append_raw(frame(spark, record(person_age="33")), at=START + 2 * DAY)
    run_etl(store, at=START + 3 * DAY)
    assert before.count() == 1
    assert store.view().count() == 2


def test_views_belong_to_their_store(spark, folder):
    store = LoanStore(spark, f"{folder}/a")
    store.append_raw(frame(spark, record()), at=START)
    run_etl(store, at=START + DAY)
    other = LoanStore(spark, f"{folder}/b")
    assert (store.view().count(), other.view().count()) == (1, 0)
    assert LoanStore(spark, f"{folder}/a").view().count() == 1


def test_a_failing_refresh_is_no_failed_run(spark, folder, monkeypatch):
    store = LoanStore(spark, folder)
    store.append_raw(frame(spark, record()), at=START)
    monkeypatch.setattr(LoanStore, "refresh_view", lambda self: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        run_etl(store, at=START + DAY)
    assert [r.status for r in store.upload_history().collect()] == ["SUCCESS"]


def test_a_run_during_the_landing_makes_nothing_late(spark, folder, monkeypatch):
    store = LoanStore(spark, folder)
    append = LoanStore._append

    def slow(self, name, schema, row):
        if name == "uploads":  # the rows are written, the upload isn't visible yet
            monkeypatch.setattr(LoanStore, "_append", append)
            assert run_etl(store).success_count == 0
            row = (row[0], now())
        append(self, name, schema, row)

    monkeypatch.setattr(LoanStore, "_append", slow)
    store.append_raw(frame(spark, record()))
    assert run_etl(store).success_count == 1


def test_of_two_runs_at_once_one_takes_the_uploads(spark, folder, monkeypatch):
    """Another store commits the same uploads, and one more, while the first run is loading."""
    store, other = LoanStore(spark, folder), LoanStore(spark, folder)
    store.append_raw(frame(spark, record(), record(person_age="41"), record(person_age="x")), at=START)
    commit, results = LoanStore.commit, []

    def slow(self, *args):
        monkeypatch.setattr(LoanStore, "commit", commit)
        results.append(run_etl(other, at=START + DAY))
        other.append_raw(frame(spark, record(person_age="50")), at=START + 2 * DAY)
        with pytest.raises(LostRace):
            commit(self, *args)
        raise LostRace

    monkeypatch.setattr(LoanStore, "commit", slow)
    results.append(run_etl(store, at=START + 3 * DAY))
    assert [(r.success_count, r.reject_count) for r in results] == [(2, 1), (1, 0)]
    done = store.committed()
    assert (done.number, len(done.uploads), done.last_loan_id) == (2, 2, 3)
    assert sorted(r.loan_id for r in store.view().collect()) == [1, 2, 3]
    assert store.rejects().count() == 1 and store.seen_keys(done.runs).count() == 4
    assert [r.status for r in store.upload_history().collect()] == ["SUCCESS"] * 2


def test_compacted_keys(spark, folder):
    store = LoanStore(spark, folder, key_buckets=3)
    for i in range(3):
        store.append_raw(frame(spark, record(), record(person_age=str(30 + i))), at=START + 2 * i * DAY)
        run_etl(store, at=START + (2 * i + 1) * DAY)
    store.compact_keys(key_buckets=5)
    store = LoanStore(spark, folder)
    runs = store.committed().runs
    assert (store.key_buckets, store.seen_keys(runs).count()) == (5, 3)
    store.append_raw(frame(spark, record(person_age="31"), record(person_age="50")), at=START + 8 * DAY)
    assert run_etl(store, at=START + 9 * DAY).success_count == 1


def test_reopened_store_keeps_its_buckets(spark, folder):
    store = LoanStore(spark, folder, key_buckets=3)
    store.append_raw(frame(spark, record(), record(person_age="41")), at=START)
    run_etl(store, at=START + DAY)
    spark.sql(f"DROP TABLE {store.keys}")
    store = LoanStore(spark, folder, key_buckets=5)
    assert store.key_buckets == 3
    assert store.seen_keys(store.committed().runs).count() == 2
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        keyed = clean.with_key(store.raw())
        plan = clean.not_seen(keyed, store.seen_keys(store.committed().runs))
        text = plan._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    over_history = text[: text.index(store.keys)].rpartition("ShuffledHashJoin")[2]
    assert over_history and "Sort" not in over_history and "Exchange" not in over_history


def test_many_new_keys_are_merged_with_the_history(spark, folder, monkeypatch):
    monkeypatch.setattr(etl, "_HASHED_KEYS", 0)
    asked, not_seen = [], clean.not_seen
    monkeypatch.setattr(clean, "not_seen", lambda *args: asked.append(args[2]) or not_seen(*args))
    store = LoanStore(spark, folder)
    for day, rows in enumerate([(record(),), (record(), record(person_age="41"))]):
        store.append_raw(frame(spark, *rows), at=START + 2 * day * DAY)
        assert run_etl(store, at=START + (2 * day + 1) * DAY).success_count == 1
    assert asked == [False]  # the first run has no history to ask
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = not_seen(clean.with_key(store.raw()), store.seen_keys(store.committed().runs), False)
        assert "ShuffledHashJoin" not in plan._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def write_csv(path, text):
    with open(path, "w", newline="") as f:
        f.write(text)


def test_csv_upload(spark, folder):
    header = ", ".join(reversed(LOAN_COLUMNS))
    good = record(person_education='a "b", c', person_gender="two\nlines", person_age="NA")
    cells = ['"' + good[c].replace('"', '""') + '"' for c in reversed(LOAN_COLUMNS)]
    write_csv(f"{folder}/a.csv", f" {header} \n{','.join(cells)}\n")
    plain = record(loan_intent="")
    write_csv(
        f"{folder}/b.csv",
        ",".join(LOAN_COLUMNS) + "\n" + ",".join(plain[c] for c in LOAN_COLUMNS) + "\n",
    )
    rows = upload.ingest(spark, f"{folder}/a.csv", f"{folder}/b.csv", multi_line=True).collect()
    assert rows[0].asDict() == {**good, "person_age": "nan"}
    assert rows[1].asDict() == {**plain, "loan_intent": "nan"}


def test_contract_names_missing_before_extra(spark, folder):
    with pytest.raises(upload.ContractError, match=r"lacks the columns \['loan_status'\]"):
        upload.check_contract([*LOAN_COLUMNS[:-1], "bonus"])
    with pytest.raises(upload.ContractError, match=r"unknown columns \['bonus'\]"):
        upload.check_contract([*LOAN_COLUMNS, "bonus"])
    write_csv(f"{folder}/c.csv", "person_age\n1\n")
    with pytest.raises(upload.ContractError, match="lacks"):
        upload.ingest(spark, f"{folder}/c.csv", multi_line=True)


@pytest.mark.parametrize("end", [",1", ",", ",,LOST", ',"x\ny"'])
@pytest.mark.parametrize("multi_line", [True, False])
def test_line_with_too_many_cells_fails(spark, folder, end, multi_line):
    line = ",".join(record()[c] for c in LOAN_COLUMNS)
    write_csv(f"{folder}/d.csv", ",".join(LOAN_COLUMNS) + f"\n{line}\n{line}{end}\n")
    table = upload.ingest(spark, f"{folder}/d.csv", multi_line=multi_line)
    with pytest.raises(Exception, match="more cells than columns"):
        table.collect()
    with pytest.raises(Exception, match="more cells than columns"):
        table.select("person_age").collect()


def test_short_lines_are_filled(spark, folder):
    line = ",".join(record()[c] for c in LOAN_COLUMNS[:-2])
    write_csv(f"{folder}/e.csv", ",".join(LOAN_COLUMNS) + f"\n{line}\n{line},\n")
    rows = upload.ingest(spark, f"{folder}/e.csv", multi_line=False).collect()
    assert [tuple(r)[-2:] for r in rows] == [("nan", "nan")] * 2
    assert all(tuple(r)[:-2] == tuple(record()[c] for c in LOAN_COLUMNS[:-2]) for r in rows)


def test_files_of_a_folder_keep_their_own_headers(spark, folder):
    for name, columns in (("a", LOAN_COLUMNS), ("b", LOAN_COLUMNS[::-1]), ("c", LOAN_COLUMNS)):
        cells = ",".join(f"{name}{LOAN_COLUMNS.index(c)}" for c in columns)
        write_csv(f"{folder}/{name}.csv", ",".join(columns) + f"\n{cells}\n")
    rows = upload.ingest(spark, folder, multi_line=False).collect()
    assert sorted(tuple(r) for r in rows) == [tuple(f"{n}{i}" for i in range(14)) for n in "abc"]
    write_csv(f"{folder}/d.csv", "person_age\n1\n")
    with pytest.raises(upload.ContractError):
        upload.ingest(spark, f"{folder}/*.csv", multi_line=False)


def test_drop_empty(spark):
    rows = spark.createDataFrame([(None, None), ("a", None)], "x string, y string")
    assert upload.drop_empty(rows).count() == 1
    assert upload.drop_empty(upload.as_text(rows)).count() == 2
