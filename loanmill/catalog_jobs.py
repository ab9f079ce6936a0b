"""Named queries for the stored tables, the features and the models."""

from __future__ import annotations

import datetime as dt
from contextlib import suppress

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import catalog, fixtures
from .functions import scalars
from .operators import applications, clean, dashboard, features, sampling
from .operators.oversample import balance
from .plans import training
from .plans.etl import run_etl
from .plans.refresh import refresh
from .schemas import CATEGORICAL, FEATURES, LABEL, LOAN_COLUMNS, NUMERIC
from .sources import upload
from .sources.scratch import session_scratch
from .sources.store import LoanStore

FIRST_RUN, SECOND_RUN, THIRD_RUN = catalog.MARK, dt.datetime(2003, 1, 1), dt.datetime(2004, 1, 1)


def _uploads(spark, sf) -> tuple[DataFrame, DataFrame]:
    raw = fixtures.raw_loans(spark, sf)
    old = F.col("uploaded_at") <= clean.moment(FIRST_RUN)
    return raw.where(old), raw.where(~old)


def _two_runs(spark: SparkSession, sf: str) -> LoanStore:
    """A store after an upload and a run, and another upload and run."""
    store = LoanStore(spark, session_scratch(spark).path("store"))
    for rows, at in zip(_uploads(spark, sf), (FIRST_RUN, SECOND_RUN)):
        store.append_raw(rows, at)
        run_etl(store, at)
    return store


# --- uploads -------------------------------------------------------------------


def _written_csv(spark, sf) -> str:
    """The records as CSV files in one folder, half of them with their columns reversed."""
    path = session_scratch(spark).path("upload")
    keep = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False,
            "ignoreTrailingWhiteSpace": False}
    for names, half in ((LOAN_COLUMNS, 0), (LOAN_COLUMNS[::-1], 1)):
        rows = fixtures.raw_loans(spark, sf).where(F.pmod(F.xxhash64(*LOAN_COLUMNS), F.lit(2)) == half)
        rows.select(*names).write.mode("append").options(**keep).csv(path)
    return path


def csv_ingest(spark, sf):
    return upload.ingest(spark, _written_csv(spark, sf), multi_line=True)


def contract_check(spark, sf):
    """Three uploads of the same records: accepted, short of a column, with one too many."""
    raw = fixtures.raw_loans(spark, sf)
    said = []
    for name, table in (
        ("exact", raw.drop("uploaded_at")), ("short", raw.drop("uploaded_at", LABEL)), ("long", raw)
    ):
        try:
            upload.check_contract(table.columns)
            said.append((name, None, 1))
        except upload.ContractError as refused:
            said.append((name, str(refused), 0))
    rows = F.inline(F.array(*(F.struct(
        F.lit(n).alias("upload"), F.lit(e).cast("string").alias("error"), F.lit(ok).alias("ok")
    ) for n, e, ok in said)))
    counted = raw.agg(F.count(F.lit(1)).alias("n")).select("n", rows)
    return counted.select("upload", "error", (F.col("n") * F.col("ok")).alias("accepted_rows"))


def raw_append(spark, sf):
    store = LoanStore(spark, session_scratch(spark).path("store"))
    store.append_raw(fixtures.raw_loans(spark, sf).drop("uploaded_at"), SECOND_RUN)
    return store.raw()


# --- stored tables ---------------------------------------------------------------


def upload_history(spark, sf):
    return _two_runs(spark, sf).upload_history()


def scan_view(spark, sf):
    return _two_runs(spark, sf).view().drop("loan_id")


def row_count(spark, sf):
    return _two_runs(spark, sf).view().agg(F.count(F.lit(1)).alias("count"))


def _from_cells(cells: str, measure) -> catalog.Query:
    """A measure of the dashboard from the cells that two runs have written."""
    return lambda spark, sf: measure(_two_runs(spark, sf).cells()[cells])


def high_water_mark(spark, sf):
    """Latest run by outcome, over good and failed runs; the mark is that of the good ones."""
    store = _with_failure(spark, sf)
    mark = clean.moment(store.committed().mark)
    return store.upload_history().groupBy("status").agg(F.max("date_time").alias("latest")).select(
        "status", "latest", (F.col("latest") == mark).alias("is_mark")
    )


def fact_load(spark, sf):
    return _two_runs(spark, sf).loans().drop("loan_id")


def loan_ids(spark, sf):
    """Count, distinct count and range of the keys."""
    return _two_runs(spark, sf).loans().agg(
        F.count("loan_id").alias("n"), F.countDistinct("loan_id").alias("different"),
        F.min("loan_id").alias("lowest"), F.max("loan_id").alias("highest"),
    )


def reject_load(spark, sf):
    return _two_runs(spark, sf).rejects()


def audit_log(spark, sf):
    return _two_runs(spark, sf).upload_history().groupBy("status").agg(
        F.count(F.lit(1)).alias("runs"), F.sum("success_count").alias("success_count"),
        F.sum("reject_count").alias("reject_count"),
    )


def mv_refresh(spark, sf):
    return _two_runs(spark, sf).view().drop("loan_id")


def run_etl_query(spark, sf):
    """Loans of a first run over everything."""
    store = LoanStore(spark, session_scratch(spark).path("store"))
    store.append_raw(fixtures.raw_loans(spark, sf), FIRST_RUN)
    run_etl(store, FIRST_RUN)
    return store.loans().drop("loan_id")


def _with_failure(spark, sf) -> LoanStore:
    """A run over an upload whose files are gone, between two good runs."""
    store = LoanStore(spark, session_scratch(spark).path("store"))
    first, second = _uploads(spark, sf)
    store.append_raw(first, FIRST_RUN)
    run_etl(store, FIRST_RUN)
    second_id = store.append_raw(second, SECOND_RUN)
    hidden = LoanStore(spark, store.root)
    hidden.uploads = lambda: [second_id + "-lost"]
    with suppress(Exception):
        run_etl(hidden, SECOND_RUN)
    run_etl(store, THIRD_RUN)
    return store


def audit_failed(spark, sf):
    return _with_failure(spark, sf).upload_history().drop("error_message")


def rerun_noop(spark, sf):
    """The same records uploaded once more, and a run without any upload."""
    store = _two_runs(spark, sf)
    store.append_raw(fixtures.raw_loans(spark, sf).drop("uploaded_at"), THIRD_RUN)
    run_etl(store, THIRD_RUN)
    run_etl(store, THIRD_RUN + dt.timedelta(days=1))
    late = F.col("date_time") >= clean.moment(THIRD_RUN)
    return store.upload_history().where(late).drop("error_message")


# --- features --------------------------------------------------------------------


def _table(spark, sf) -> DataFrame:
    return features.training_table(catalog.loans(spark, sf), key=None)


def log1p_features(spark, sf):
    logged = features.log_features(_table(spark, sf))
    return logged.select(*(scalars.round_half_even(F.col(f"{c}_log"), 6).alias(c) for c in NUMERIC))


def train_contract(spark, sf):
    """What the check says about the complete table and about one without its label."""
    table = catalog.loans(spark, sf)
    features.check_columns(table.columns, [*FEATURES, LABEL])
    try:
        features.check_columns(table.drop(LABEL).columns, [*FEATURES, LABEL])
    except ValueError as refused:
        return table.agg(F.count(F.lit(1)).alias("rows"), F.lit(str(refused)).alias("refusal"))


def drop_incomplete(spark, sf):
    gappy = fixtures.gappy_loans(fixtures.raw_loans(spark, sf))
    return features.drop_incomplete(gappy).drop("uploaded_at")


def features_query(spark, sf):
    return _table(spark, sf)


def _kept_table(spark, sf) -> DataFrame:
    """The training table, written once: fitting and transforming read it."""
    return session_scratch(spark).keep(_table(spark, sf), "table")


def scale_features(spark, sf):
    table = _kept_table(spark, sf)
    scaled = features.fit_scaler(table).transform(table)
    return scaled.select(
        *(scalars.round_half_even(F.col(f"{c}_scaled"), 6).alias(c) for c in NUMERIC)
    )


def one_hot(spark, sf):
    table = _kept_table(spark, sf)
    model = features.one_hot().fit(table)
    coded = model.transform(table)
    indexer = model.stages[0]
    slots = [
        (vector_to_array(f"{c}_hot")[i].cast("int").alias(f"{c}_{i + 1}"))
        for c, levels in zip(CATEGORICAL, indexer.labelsArray)
        for i in range(len(levels))
    ]
    return coded.select(*CATEGORICAL, *slots)


def assemble(spark, sf):
    """The slots of the feature vector, rounded: numbers first, then the one-hot levels."""
    table = _kept_table(spark, sf)
    rows = features.fit_preprocessor(table).transform(table)
    slots = vector_to_array("features")
    width = rows.schema["features"].metadata["ml_attr"]["num_attrs"]
    return rows.select(
        *(scalars.round_half_even(slots[i], 6).alias(f"f{i + 1}") for i in range(width))
    )


# --- models ------------------------------------------------------------------------


def _prepared(spark, sf) -> training.Prepared:
    scratch = session_scratch(spark)
    return training.prepare(catalog.clear_loans(spark, sf, scratch), scratch)


def _fitted(prepared: training.Prepared, name: str) -> PipelineModel:
    return training.fit(prepared, training.CLASSIFIERS[name](prepared.balanced_rows))


def _trained(spark, sf) -> str:
    """Folder with kept models."""
    scratch = session_scratch(spark)
    folder = scratch.path("models")
    training.train_and_save(spark, folder, catalog.clear_loans(spark, sf, scratch))
    return folder


def stratified_split(spark, sf):
    table = catalog.training_loans(spark, sf, session_scratch(spark))
    train, test = sampling.stratified_split(table, LABEL, "loan_id")
    parts = train.select(LABEL, F.lit("train").alias("part")).unionByName(
        test.select(LABEL, F.lit("test").alias("part"))
    )
    return parts.groupBy("part", LABEL).agg(F.count(F.lit(1)).alias("n"))


def smote(spark, sf):
    """Rows per class before and after growing the minority."""
    scratch = session_scratch(spark)
    table = features.training_table(catalog.training_loans(spark, sf, scratch))
    kept = scratch.keep(table, "table")
    preprocessor = features.fit_preprocessor(kept)
    ready = training.feature_rows(preprocessor, kept, "loan_id")
    grown = balance(scratch.keep(ready, "ready"), scratch)
    slots = features.sparse_features(features.level_counts(preprocessor))
    return grown.groupBy(F.col("label").cast("int").alias("label"), "synthetic").agg(
        F.count(F.lit(1)).alias("n"), F.max(slots["size"]).alias("width")
    )


def logreg_fit(spark, sf):
    """Predictions on the test part, and whether the weights are where the loss is least."""
    prepared = _prepared(spark, sf)
    model = _fitted(prepared, training.LOGISTIC)
    weights = model.stages[-1]
    steepest = training.steepest_slope(prepared.balanced, weights, 1.0 / prepared.balanced_rows)
    return (
        training.predict(model, prepared.test).groupBy(LABEL, "prediction").count()
        .withColumn("at_minimum", F.lit(steepest < 1e-3))
    )


def rf_fit(spark, sf):
    prepared = _prepared(spark, sf)
    predicted = training.predict(_fitted(prepared, training.FOREST), prepared.test)
    return predicted.groupBy(LABEL, "prediction").count()


def pipeline_fit(spark, sf):
    """Both fitted chains over the complete rows, not only over the test part."""
    table, prepared = _kept_table(spark, sf), _prepared(spark, sf)
    both = training.predict(_fitted(prepared, training.LOGISTIC), table)
    return training.predict(
        _fitted(prepared, training.FOREST), both.withColumnRenamed("prediction", "logistic")
    ).groupBy("logistic", "prediction").count()


def predict(spark, sf):
    return training.predict(_fitted(_prepared(spark, sf), training.FOREST), _kept_table(spark, sf))


def decision(spark, sf):
    model = _fitted(_prepared(spark, sf), training.LOGISTIC)
    return training.predict(model, _kept_table(spark, sf)).select(
        LABEL, "prediction", scalars.decision(F.col("prediction")).alias("decision")
    )


def accuracy(spark, sf):
    """The measure itself, on predictions by a fixed rule."""
    rule = (F.col("loan_percent_income") > 0.43).cast("int")
    return training.accuracy(catalog.loans(spark, sf).withColumn("prediction", rule))


def score_lookup(spark, sf):
    """Whether the score looked up by name is what the kept model scores afresh."""
    folder, table = _trained(spark, sf), _kept_table(spark, sf)
    rows = []
    for name in training.CLASSIFIERS:
        model = training.load_model(spark, folder, name)
        afresh = training.accuracy(training.predict(model, table)).first().accuracy
        rows.append((name, training.score_of(spark, folder, name) == afresh))
    return spark.createDataFrame(rows, "model string, same boolean")


def train_job(spark, sf):
    return training.load_scores(spark, _trained(spark, sf))


def model_roundtrip(spark, sf):
    """Predictions of a kept model against those of the model kept."""
    path = session_scratch(spark).path("model")
    prepared = _prepared(spark, sf)
    fitted = _fitted(prepared, training.LOGISTIC)
    fitted.write().overwrite().save(path)
    first = training.predict(fitted, prepared.test).withColumnRenamed("prediction", "first")
    again = training.predict(PipelineModel.load(path), first)
    return again.groupBy((F.col("first") == F.col("prediction")).alias("same")).count()


def batch_score(spark, sf):
    scored = training.score(
        fixtures.applications(spark, sf), _trained(spark, sf), training.FOREST
    )
    return scored.select(
        "application_id", "invalid_fields", F.col("decision").isNotNull().alias("decided"),
        (F.col("prediction").isNull() == F.col("decision").isNull()).alias("consistent"),
    )


def score_input_check(spark, sf):
    return applications.check_applications(fixtures.applications(spark, sf))


def refresh_job(spark, sf):
    """An uploaded file through to models; the run's counts and the number of models."""
    scratch = session_scratch(spark)
    store = LoanStore(spark, scratch.path("store"))
    _, scores = refresh(store, _written_csv(spark, sf), scratch.path("models"), multi_line=False)
    return store.upload_history().select(
        "success_count", "reject_count", F.lit(len(scores)).alias("models")
    )


QUERIES = {
    "csv_ingest": csv_ingest,
    "contract_check": contract_check,
    "raw_append": raw_append,
    "upload_history": upload_history,
    "scan_view": scan_view,
    "row_count": row_count,
    "kpis_of_cells": _from_cells("age_cells", dashboard.kpis_of),
    "overview_of_cells": _from_cells("breakdown_cells", dashboard.overview_of),
    "gender_share_of_cells": _from_cells("age_cells", dashboard.gender_share_of),
    "age_by_gender_of_cells": _from_cells("age_cells", dashboard.age_by_gender_of),
    "age_histogram_of_cells": _from_cells("age_cells", dashboard.age_histogram_of),
    "high_water_mark": high_water_mark,
    "fact_load": fact_load,
    "loan_ids": loan_ids,
    "reject_load": reject_load,
    "audit_log": audit_log,
    "audit_failed": audit_failed,
    "mv_refresh": mv_refresh,
    "run_etl": run_etl_query,
    "rerun_noop": rerun_noop,
    "log1p_features": log1p_features,
    "train_contract": train_contract,
    "drop_incomplete": drop_incomplete,
    "features": features_query,
    "scale_features": scale_features,
    "one_hot": one_hot,
    "assemble": assemble,
    "stratified_split": stratified_split,
    "smote": smote,
    "logreg_fit": logreg_fit,
    "rf_fit": rf_fit,
    "pipeline_fit": pipeline_fit,
    "predict": predict,
    "decision": decision,
    "accuracy": accuracy,
    "score_lookup": score_lookup,
    "train_job": train_job,
    "model_roundtrip": model_roundtrip,
    "batch_score": batch_score,
    "score_input_check": score_input_check,
    "refresh_job": refresh_job,
}
