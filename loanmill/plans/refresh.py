"""From an uploaded file to retrained models."""

from __future__ import annotations

from collections.abc import Callable

from ..sources import upload
from ..sources.store import LoanStore
from .etl import RunResult, run_etl
from .training import CLASSIFIERS, train_and_save


def refresh(
    store: LoanStore,
    csv_path: str,
    model_folder: str,
    multi_line: bool,
    classifiers: dict[str, Callable] = CLASSIFIERS,
) -> tuple[RunResult, dict[str, float]]:
    """Lands the upload, cleans it and retrains; stops at the first step that fails."""
    store.append_raw(upload.ingest(store.spark, csv_path, multi_line=multi_line))
    result = run_etl(store)
    return result, train_and_save(store.spark, model_folder, store.view(), classifiers=classifiers)
