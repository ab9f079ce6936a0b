"""Quality scores from random Fourier features of document statistics.

A text becomes a short vector of statistics, standardised; cosines of random projections of
it approximate a Gaussian kernel. Ridge regression on those is fitted from normal equations
that every partition sums for itself, in folds, so that the penalty and the isotonic
calibration are chosen on scores of rows the fit didn't see. Only sums reach the driver.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanmill.llm.base import ship
from loanmill.llm.wordbytes import slices, words
from loanmill.sources.scratch import Scratch

#: Labelled rows the fit may use; of more, those with the smallest hashes are taken.
MAX_LABELLED = 500_000
_FEATURES, _FOLDS, _BINS = 256, 5, 2000
_PENALTIES = [0.1, 1.0, 10.0, 100.0, 1000.0]

_BYTES = np.arange(256)
_KINDS = [
    (_BYTES >= ord("A")) & (_BYTES <= ord("Z")),
    (_BYTES >= ord("a")) & (_BYTES <= ord("z")),
    (_BYTES >= ord("0")) & (_BYTES <= ord("9")),
    np.isin(_BYTES, [*b" \t\x0b\x0c\r"]),
    _BYTES == ord("\n"),
    np.isin(_BYTES, [*b".,;:"]),
    np.isin(_BYTES, [*b"!?"]),
    np.isin(_BYTES, [*b"\"#$%&'()*+-/<=>@[\\]^_`{|}~"]),
    (_BYTES >= 0x80) & (_BYTES < 0xC0),
    _BYTES >= 0xC0,
]
_KIND_OF = np.zeros(256, np.uint8)
for _i, _kind in enumerate(_KINDS):
    _KIND_OF[_kind] = _i + 1
N_STATS = 24


def _of_words(w: np.ndarray) -> list[float]:
    """Repetition and balance of the words of one text."""
    n = len(w)
    if not n:
        return [0.0] * 8
    values, counts = np.unique(w, return_counts=True)
    share = np.sort(counts)[::-1] / n
    pairs = np.unique(w[:-1] * np.uint64(3) + w[1:]) if n > 1 else values
    triples = (
        np.unique(w[:-2] * np.uint64(5) + w[1:-1] * np.uint64(3) + w[2:]) if n > 2 else values
    )
    same_next = float((w[1:] == w[:-1]).mean()) if n > 1 else 0.0
    return [
        np.log1p(n), len(values) / n, len(values) / np.sqrt(n), share[0], share[:5].sum(),
        float(-(share * np.log(share)).sum()) / np.log(n + 1.0), len(pairs) / n + same_next,
        len(triples) / n - same_next,
    ]


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of statistics per text; null counts as empty."""
    out = []
    for _, data, offsets in slices(texts):
        sizes = np.diff(offsets).astype(float)
        kinds = _KIND_OF[data]
        counts = np.empty((len(sizes), len(_KINDS)))
        for i in range(len(_KINDS)):
            upto = np.r_[0, np.cumsum(kinds == i + 1)]
            counts[:, i] = upto[offsets[1:]] - upto[offsets[:-1]]
        chars = np.maximum(1.0, sizes - counts[:, 8])
        w, doc = words(data, offsets)
        bounds = np.searchsorted(doc, np.arange(len(sizes) + 1))
        n_words = np.maximum(1, np.diff(bounds))
        letters = chars - counts[:, 3] - counts[:, 4]
        by_char = counts / chars[:, None]
        plain = np.column_stack(
            [
                np.log1p(sizes), by_char, letters / n_words, counts[:, 4] / n_words,
                np.minimum(counts[:, 0], n_words) / n_words, counts[:, 5] / n_words,
                np.log1p(counts[:, 4]),
            ]
        )
        rest = np.array([_of_words(w[a:b]) for a, b in zip(bounds[:-1], bounds[1:])])
        out.append(np.column_stack([plain, rest]))
    return np.concatenate(out) if out else np.zeros((0, N_STATS))


@dataclass(frozen=True)
class QualityModel:
    """Means and deviations of the statistics, ridge weights, and the calibration's knots."""

    mean: np.ndarray
    deviation: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    rates: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        return fourier((stats - self.mean) / self.deviation)

    def score(self, stats: np.ndarray) -> np.ndarray:
        raw = self.features(stats) @ self.weights
        return np.clip(np.interp(raw, self.knots, self.rates), 0.0, 1.0)


@functools.cache
def _projection(width: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(20)
    spread = np.sqrt(width)
    return random.normal(size=(width, _FEATURES)) / spread, random.uniform(0, 2 * np.pi, _FEATURES)


def fourier(x: np.ndarray) -> np.ndarray:
    """Random Fourier features of a Gaussian kernel, and a constant."""
    w, phase = _projection(x.shape[1])
    waves = np.cos(np.clip(x, -8, 8) @ w + phase) * np.sqrt(2 / _FEATURES)
    return np.column_stack([waves, np.ones(len(x))])


def isotonic(x: np.ndarray, total: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots (mean x) and rising rates of the blocks."""
    blocks: list[list[float]] = []
    for xi, t, n in zip(x * weight, total, weight):
        blocks.append([xi, t, n])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    made = np.array(blocks)
    return made[:, 0] / made[:, 2], made[:, 1] / made[:, 2]


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, N_STATS))


def _summed(rows: DataFrame, run, shape: tuple[int, ...]) -> dict[int, np.ndarray]:
    """Per fold the sum of what `run` gives for each batch; sums are made in the partitions."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((_FOLDS, *shape))
        for batch in batches:
            fold, y = (batch.column(i).to_numpy() for i in (0, 1))
            x = _matrix(batch.column(2))
            for i in range(_FOLDS):
                sums[i] += run(x[fold == i], y[fold == i])
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(_FOLDS), pa.int64()), pa.array([s.tobytes() for s in sums], pa.binary())],
            names=["fold", "sums"],
        )

    def total(frame: pd.DataFrame) -> pd.DataFrame:
        every = sum(np.frombuffer(s) for s in frame["sums"])
        return pd.DataFrame({"fold": frame["fold"].iloc[:1], "sums": [every.tobytes()]})

    kind = "fold long, sums binary"
    table = rows.select("fold", "label", "stats").mapInArrow(partial, kind)
    rows = table.groupBy("fold").applyInPandas(total, kind).collect()
    return {r.fold: np.frombuffer(r.sums).reshape(shape) for r in rows}


def _moments(x: np.ndarray, _y: np.ndarray) -> np.ndarray:
    return np.vstack([np.full(x.shape[1], len(x)), x.sum(0), (x**2).sum(0)])


def may_teach(doc_id: Column) -> Column:
    """Whether a row's label may be learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 != 0, F.lit(False))


def fit(
    docs: DataFrame, labels: DataFrame, scratch: Scratch, max_labelled: int = MAX_LABELLED
) -> QualityModel:
    """Fits on documents whose doc_id has a quality label and passes `may_teach`.

    Of several labels of a document the mean counts; null labels don't. Without labels, or
    with labels of one kind only, every score is their mean (0.5 without any).
    """
    ship(docs.sparkSession)
    known = labels.where(may_teach(F.col("doc_id"))).groupBy("doc_id").agg(
        F.avg("quality").alias("label")
    ).where("label IS NOT NULL")
    n_known = known.count()
    part = min(1.0, max_labelled / max(1, n_known))
    order = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(6)), 11) / F.lit(2.0**53)

    def measured(batches):
        for batch in batches:
            stats = statistics(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(list(stats), pa.list_(pa.float64()))],
                names=["doc_id", "stats"],
            )

    all_stats = docs.where(may_teach(F.col("doc_id"))).select("doc_id", "text").mapInArrow(
        measured, "doc_id long, stats array<double>"
    )
    sample = scratch.keep(
        all_stats.join(known.where(order < part), "doc_id").select(
            F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(_FOLDS)).alias("fold"), "label", "stats"
        ),
        "labelled",
    )
    moments = sum(_summed(sample, _moments, (3, N_STATS)).values(), np.zeros((3, N_STATS)))
    n = moments[0, 0]
    mean = moments[1] / max(n, 1)
    deviation = np.sqrt(np.maximum(moments[2] / max(n, 1) - mean**2, 0)) + 1e-9
    blank = QualityModel(mean, deviation, np.zeros(_FEATURES + 1), np.zeros(1), np.array([0.5]))

    def equations(x, y):
        z = blank.features(x)
        return np.vstack([z.T @ z, z.T @ y, np.r_[y @ y, y.sum(), np.zeros(_FEATURES - 1)]])

    size = _FEATURES + 1
    sums = _summed(sample, equations, (size + 2, size))
    every = sum(sums.values(), np.zeros((size + 2, size)))
    positive = every[size + 1, 1]
    if n == 0 or positive in (0, n):
        rate = positive / n if n else 0.5
        return QualityModel(mean, deviation, blank.weights, np.zeros(1), np.array([rate]))

    def solved(s, penalty):
        keep = np.eye(size) * penalty
        keep[-1, -1] = 1e-6
        return np.linalg.solve(s[:size] + keep, s[size])

    def loss(penalty):
        """Squared error on each fold of the weights from the others, from the sums alone."""
        lost = 0.0
        for s in sums.values():
            w = solved(every - s, penalty)
            lost += s[size + 1, 0] - 2 * w @ s[size] + w @ s[:size] @ w
        return lost

    penalty = min(_PENALTIES, key=loss)
    unseen = np.array([solved(every - sums[i], penalty) if i in sums else np.zeros(size) for i in range(_FOLDS)])

    def binned(batches):
        for batch in batches:
            fold, y = (batch.column(i).to_numpy() for i in (0, 1))
            raw = (blank.features(_matrix(batch.column(2))) * unseen[fold]).sum(1)
            place = np.floor((np.clip(raw, -1, 2) + 1) / 3 * _BINS).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(place), pa.array(raw), pa.array(y)], names=["bin", "raw", "label"]
            )

    bins = (
        sample.select("fold", "label", "stats").mapInArrow(binned, "bin long, raw double, label double")
        .groupBy("bin").agg(F.avg("raw").alias("x"), F.sum("label").alias("t"), F.count("*").alias("n"))
        .orderBy("bin").toPandas()
    )
    knots, rates = isotonic(bins["x"].to_numpy(), bins["t"].to_numpy(), bins["n"].to_numpy())
    return QualityModel(mean, deviation, solved(every, penalty), knots, rates)


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """`row` (all columns of the document) and `score`, the rate of label 1 to expect.

    Whole texts are scored, null as empty; an empty table gives no rows.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.struct("*").alias("row"), "text")

    def run(batches):
        for batch in batches:
            scores = model.score(statistics(batch.column(1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64())], names=["row", "score"]
            )

    kind = T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(run, kind)
