"""State that many runs, trainings and uploads leave, and what reads it."""

import csv
import datetime as dt
import io
import random

import pytest

from conftest import SF
from loanmill import fixtures
from loanmill.operators import dashboard
from loanmill.plans import training
from loanmill.plans.etl import run_etl
from loanmill.schemas import LOAN_COLUMNS
from loanmill.sources import quoted_csv, store as stores, upload
from loanmill.sources.numbered_files import LostRace, NumberedFiles
from loanmill.sources.scratch import Scratch
from loanmill.sources.store import LoanStore
from loanmill.streaming.load import follow_folder
from oracle import spark_bag
from test_store import DAY, START, frame, record, write_csv


def test_a_number_is_taken_once(spark, folder):
    files = NumberedFiles(spark, folder, "n")
    assert files.numbers() == [] and files.lines() == []
    files.add(1, "a\nb")
    with pytest.raises(LostRace):
        files.add(1, "c")
    assert files.add_next("d") == 2
    assert (files.numbers(), sorted(files.lines(1)), files.lines(2)) == ([1, 2], ["a", "b"], ["d"])


def test_many_runs_open_with_few_reads(spark, folder, monkeypatch):
    monkeypatch.setattr(stores, "_STATE_EVERY", 10)
    store = LoanStore(spark, folder)
    counts = {"valid": 1, "reject": 0, "unclassified": 0, "late": 0}
    done, marks = stores.Committed(0, [], set(), None, 0), []
    for i in range(1, 36):
        marks.append(START + i * DAY + dt.timedelta(microseconds=i))
        store.commit(f"r{i}", marks[-1], done, [f"u{i}"], i, counts)
        done = stores.Committed(i, [], set(), None, i)
    assert store._states.numbers() == [10, 20, 30]
    assert len(store._commits().inputFiles()) == 6
    again = LoanStore(spark, folder)
    assert again.committed() == stores.Committed(
        35, [f"r{i}" for i in range(1, 36)], {f"u{i}" for i in range(1, 36)}, marks[-1], 35
    )
    assert again.committed(12).runs == [f"r{i}" for i in range(1, 13)]
    assert again.upload_history().count() == 35


def test_packed_loans_and_cells(spark, folder):
    store = LoanStore(spark, folder)
    store.pack_loans()
    raw, views = fixtures.raw_loans(spark, SF).drop("uploaded_at"), []
    for i, part in enumerate(raw.randomSplit([1.0] * 4, seed=3)):
        if i == 3:
            store.append_raw(frame(spark, record(person_gender="other", person_age="101")))
        store.append_raw(part)
        run_etl(store, at=START + i * DAY)
        views.append((store.view(), store.loans().count()))
        if i in (1, 2):
            before = spark_bag(store.loans())
            store.pack_loans()
            store.pack_loans()
            assert spark_bag(store.loans()) == before
    assert store._packs.numbers() == [2, 3]
    folders = store._loan_folders(store.committed())
    assert [f.startswith("pack-") for f in folders] == [True, True, False]
    assert [v.count() for v, _ in views] == [n for _, n in views]
    assert store._loan_folders(store.committed(1)) == store.committed(1).runs
    loans, cells = store.view(), store.cells()
    ages, breakdowns = cells["age_cells"], cells["breakdown_cells"]
    for kept, scanned in (
        (dashboard.kpis_of(ages), dashboard.kpis(loans)),
        (dashboard.kpis_of(breakdowns), dashboard.kpis(loans)),
        (dashboard.overview_of(breakdowns), dashboard.overview(loans)),
        (dashboard.default_breakdown_of(breakdowns, "dti_bucket"),
         dashboard.default_breakdown(loans, "dti_bucket")),
        (dashboard.gender_share_of(ages), dashboard.gender_share(loans)),
        (dashboard.age_by_gender_of(ages), dashboard.age_by_gender(loans)),
        (dashboard.age_histogram_of(ages), dashboard.age_histogram(loans)),
    ):
        assert kept.columns == scanned.columns
        assert spark_bag(kept) == spark_bag(scanned)


def test_cells_before_the_first_run(spark, folder):
    cells = LoanStore(spark, folder).cells()
    assert dashboard.kpis_of(cells["age_cells"]).first().asDict() == {
        "total_loans": 0, "total_defaults": 0, "default_rate": None,
    }
    assert dashboard.age_histogram_of(cells["age_cells"]).isEmpty()


def test_models_and_scores_change_together(spark, folder, monkeypatch):
    rows = fixtures.noisy_loans(fixtures_loans(spark)).coalesce(1).selectExpr(
        "monotonically_increasing_id() AS loan_id", "*"
    )
    with Scratch(spark) as scratch:
        rows = scratch.keep(rows, "rows")
        one = {training.LOGISTIC: training.logistic}
        training.train_and_save(spark, folder, rows, classifiers=one)
        first = training.current_version(spark, folder)
        monkeypatch.setattr(training, "save_scores", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            training.train_and_save(spark, folder, rows, classifiers=one)
        assert training.current_version(spark, folder) == first
        assert training.load_model(spark, folder, training.LOGISTIC).stages
        monkeypatch.undo()
        training.train_and_save(spark, folder, rows, classifiers=one)
        assert training.current_version(spark, folder) != first
        assert training.load_scores(spark, folder).count() == 1


def fixtures_loans(spark):
    from loanmill import catalog

    return catalog.loans(spark, SF)


# --- quoted line breaks ---------------------------------------------------------


def test_open_after():
    assert [quoted_csv.open_after(line, False) for line in ('a,"b', 'a 5" b,c', '"a""', '"a"",', '"a",b')] == [
        True, False, True, True, False,
    ]
    assert [quoted_csv.open_after(line, True) for line in ("a,b", 'a"', 'a""', 'a"","b', '","')] == [
        True, False, True, False, True,
    ]


def _odd_cell(draw) -> str:
    kinds = ['x', 'a "q" b', "two\nlines", "three\r\n\n", ',",\n",', '"', "", "é" * 40, "\n" * 30]
    return draw.choice(kinds)


@pytest.mark.parametrize("end, chunk", [("\n", 23), ("\r\n", 50), ("\n", 400), ("\r\n", 1 << 20)])
def test_chunks_give_the_records_of_one_read(spark, folder, end, chunk):
    draw, expected = random.Random(chunk), []
    for name in "ab":
        out = io.StringIO()
        writer = csv.writer(out, lineterminator=end)
        writer.writerow(["k", 'p "q"', "two\nlines"])
        for i in range(60 if chunk >= 400 else 8):
            row = [f"{name}{i}", _odd_cell(draw), _odd_cell(draw)]
            writer.writerow(row)
            expected.append(tuple(row))
            if i % 3 == 0:
                out.write(end)
        write_csv(f"{folder}/{name}.csv", out.getvalue())
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(chunk))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        with Scratch(spark) as scratch:
            files = [f"{folder}/a.csv", f"{folder}/b.csv"]
            got = [r.record for r in quoted_csv.records(spark, files, scratch).collect()]
        (table,) = upload.read_csv(spark, folder, multi_line=True)
        assert table.columns == ["k", 'p "q"', "two\nlines"]
        cells = sorted(tuple(c or "" for c in r) for r in table.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted(tuple(next(csv.reader(io.StringIO(r, newline="")))) for r in got) == sorted(expected)
    assert cells == sorted(expected)


def test_a_quote_never_closed(spark, folder):
    write_csv(f"{folder}/a.csv", 'k,v\n1,a\n2,"b\n3,c\n')
    with Scratch(spark) as scratch:
        got = quoted_csv.records(spark, [f"{folder}/a.csv"], scratch).collect()
    assert sorted(r.record for r in got) == ["1,a", '2,"b\n3,c']


def test_headers_of_odd_files(spark, folder):
    long = "x" * (1 << 17)
    write_csv(f"{folder}/a.csv", f'﻿a,"b\r\nc", d ,,a,{long}\r\n1,2,3,4,5,6\r\n')
    assert upload._header(spark, f"file:{folder}/a.csv") == ("a", "b\r\nc", "d", "_c3", "a4", long)
    write_csv(f"{folder}/b.csv", "\n\r\n a ,b")
    assert upload._header(spark, f"file:{folder}/b.csv") == ("a", "b")
    write_csv(f"{folder}/c.csv", "")
    assert upload._header(spark, f"file:{folder}/c.csv") == ()


# --- uploads that follow a folder ------------------------------------------------


def test_a_folder_lands_once(spark, folder, monkeypatch):
    store, files = LoanStore(spark, f"{folder}/store"), f"{folder}/in"
    spark._jvm.java.io.File(files).mkdirs()

    def put(name, *ages, columns=LOAN_COLUMNS):
        lines = [",".join(record(person_age=a)[c] for c in columns) for a in ages]
        write_csv(f"{files}/{name}.csv", "\n".join([",".join(columns), *lines, ""]))

    def follow():
        query = follow_folder(store, files, f"{folder}/checkpoint", "march", multi_line=False)
        query.awaitTermination()

    put("a", "30", "31")
    append = LoanStore._append
    # Dies when the rows are written and not yet visible, and once more when they are.
    with monkeypatch.context() as patch:
        patch.setattr(LoanStore, "_append", lambda *_: 1 / 0)
        with pytest.raises(Exception, match="ZeroDivision"):
            follow()
    assert store.uploads() == []

    def append_and_die(self, name, *rest):
        append(self, name, *rest)
        raise OSError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(LoanStore, "_append", append_and_die)
        with pytest.raises(Exception, match="lost"):
            follow()
    follow()
    assert store.uploads() == ["march-000000000000"] and store.raw().count() == 2
    put("b", "1", columns=LOAN_COLUMNS[:-1])
    follow()
    assert [r.status for r in store.upload_history().collect()] == ["FAILED"]
    put("c", "32")
    follow()
    assert len(store.uploads()) == 2 and store.raw().count() == 3
    assert run_etl(store).success_count == 3
