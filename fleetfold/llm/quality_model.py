"""Quality classifier from trusted positives and unlabelled text (non-negative PU learning).

The risk of a classifier is written with positives and unlabelled text alone: the positives' own loss,
weighted by the class prior, plus the loss of calling unlabelled text negative, less the share of it that
the positives among it explain. That difference is an estimate of a loss, so a step that would take it
below zero is shortened. The prior is estimated from the same two sets: a classifier is fitted between
them, and above any score the share of unlabelled text over that of positives bounds the prior; the
least bound is taken. Negative labels are never read.

Every round is one scan of the stored measures of all training text; tasks send sums.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetfold.llm.common import held_out, stored, whole_text

ROUNDS, SETTLED, PENALTY, LONGEST_STEP = 40, 1e-3, 1e-3, 2.0
# bins of the scores, and the shares of positives above a score between which the prior is read off
BINS, FEWEST, MOST = 1000, 0.25, 0.9
SYMBOLS, STOPS = b"#*$%&|<>@^~=+{}[]\\_", b".,;:!?"
THRESHOLD = 0.3


class Model(NamedTuple):
    center: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float


def measures(text: bytes) -> np.ndarray:
    """Shares and logs that describe the shape of a text, not its content or language."""
    counts = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256) if text else np.zeros(256)
    size = max(1, len(text))
    words = text.split()
    n = max(1, len(words))
    lines = [line for line in text.split(b"\n") if line.strip()]
    of = lambda chars: counts[np.frombuffer(chars, dtype=np.uint8)].sum()
    symbols, stops = of(SYMBOLS), of(STOPS)
    return np.array(
        [
            np.log1p(len(words)),
            min(symbols / n, 4.0),
            float(symbols > 0.05 * n),
            min(stops / n, 1.0),
            float(stops < 0.01 * n),
            counts[48:58].sum() / size,
            counts[65:91].sum() / size,
            counts[128:].sum() / size,
            min((size - counts[32] - counts[9:14].sum()) / n, 30.0),
            len(set(words)) / n,
            1 - len(set(lines)) / max(1, len(lines)),
            np.log1p(n / max(1, len(lines))),
            float(len(words) < 5),
            min(counts[124] / n, 2.0),
        ]
    )


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [measures(t.as_py()) for t in batch.column(0)]
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "x"])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _totals(measured: DataFrame, of) -> dict[bool, np.ndarray]:
    """Sum of ``of(rows)`` over all trusted rows (True) and over all rows (False), by one aggregation.

    A trusted document is unlabelled text as well, so its sums count in both.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[bool, np.ndarray] = {}
        for batch in batches:
            trusted = batch.column(0).to_numpy(zero_copy_only=False)
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(trusted), -1)
            for flag in (True, False):
                if (trusted == flag).any():
                    sums[flag] = sums.get(flag, 0.0) + of(x[trusted == flag])
        for flag, values in sums.items():
            columns = [pa.array(np.full(len(values), flag)), pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values)]
            yield pa.RecordBatch.from_arrays(columns, ["trusted", "slot", "value"])

    parts = measured.select("trusted", "x").mapInArrow(task, "trusted boolean, slot int, value double")
    totals: dict[bool, dict[int, float]] = {}
    for r in parts.groupBy("trusted", "slot").agg(F.sum("value").alias("value")).collect():
        totals.setdefault(r.trusted, {})[r.slot] = r.value
    sums = {flag: np.array([v[i] for i in range(len(v))]) for flag, v in totals.items()}
    if True in sums:
        sums[False] = sums[True] + sums.get(False, 0.0)
    return sums


def risk_sums(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Rows, loss as a negative, scores times rows, rows, and curvature, summed; ``weights`` end in the bias."""
    z = np.c_[x, np.ones(len(x))]
    margin = z @ weights
    score = _sigmoid(margin)
    curved = (z.T * (score * (1 - score))) @ z
    return np.concatenate([[len(x), np.logaddexp(0, margin).sum()], z.T @ score, z.sum(axis=0), curved.ravel()])


def _parts(sums: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Means per row: loss as a negative, gradient, row, curvature."""
    d = int(round((-2 + math.sqrt(4 + 4 * (len(sums) - 2))) / 2))
    mean = sums / sums[0]
    return mean[1], mean[2 : 2 + d], mean[2 + d : 2 + 2 * d], mean[2 + 2 * d :].reshape(d, d)


def descend(sums_at, prior: float | None, size: int) -> np.ndarray:
    """Weights of the least risk by Newton steps over ``sums_at(weights)``, sums of positives and of unlabelled rows.

    Without a prior the two sets are told apart at equal weight. With one, a step that makes the
    estimated loss of the negatives negative is halved instead of taken.
    """
    weights, step = np.zeros(size), np.zeros(size)
    ridge = PENALTY * np.r_[np.ones(size - 1), 0.0]
    for _ in range(ROUNDS):
        (loss_p, gradient_p, row_p, curve_p), (loss_u, gradient_u, _, curve_u) = map(_parts, sums_at(weights))
        if prior is None:
            gradient, curve = (gradient_p - row_p + gradient_u) / 2, (curve_p + curve_u) / 2
        elif loss_u < prior * loss_p:
            step = step / 2
            if np.abs(step).max() < SETTLED:
                return weights - step
            weights = weights - step
            continue
        else:
            # logistic loss: a positive's loss less its loss as a negative is minus its margin
            gradient, curve = gradient_u - prior * row_p, curve_u
        step = -np.linalg.solve(curve + np.diag(ridge + 1e-9), gradient + ridge * weights)
        step *= min(1.0, LONGEST_STEP / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < SETTLED:
            break
        weights = weights + step
    return weights


def least_bound(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Class prior from histograms of the scores of both sets: the least share of unlabelled over positives above a score."""
    above_p, above_u = (np.cumsum(h[::-1])[::-1] / max(1, h.sum()) for h in (positive, unlabelled))
    usable = (above_p >= FEWEST) & (above_p <= MOST)
    if not usable.any():
        usable = above_p > 0
    return float(np.clip((above_u[usable] / above_p[usable]).min(), 0.01, 0.99))


def fit_quality(docs: DataFrame, labels: DataFrame) -> Model | None:
    """A model from all good training documents and all training text; None without good ones or without text.

    A document counts as good once if any of its labels says so; rows without a label or a key are unlabelled text.
    """
    good = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id", 5, 0))
    keys = stored(good.select(F.col("doc_id").alias("label_doc")).distinct().withColumn("good", F.lit(True)))
    text = docs.where(~held_out("doc_id", 5, 0)).select(whole_text().cast("binary").alias("text"), F.col("doc_id").cast("string").alias("doc_id"))
    # the join sees measures, no texts
    rows = text.mapInArrow(_measured, "doc_id string, x array<double>")
    same = F.col("doc_id") == F.col("label_doc").cast("string")
    measured = stored(rows.join(keys, same, "left").select("x", F.coalesce("good", F.lit(False)).alias("trusted")))
    first = _totals(measured, lambda x: np.concatenate([[len(x)], x.sum(axis=0), (x * x).sum(axis=0)]))
    if True not in first:
        return None
    d = (len(first[False]) - 1) // 2
    mean = first[False][1:] / first[False][0]
    center, spread = mean[:d], np.sqrt(np.maximum(mean[d:] - mean[:d] ** 2, 0.0))
    spread = np.where(spread < 1e-9, 1.0, spread)

    def sums_at(weights: np.ndarray):
        sums = _totals(measured, lambda x: risk_sums((x - center) / spread, weights))
        return sums[True], sums[False]

    apart = descend(sums_at, None, d + 1)
    counts = _totals(measured, lambda x: np.bincount((_sigmoid((x - center) / spread @ apart[:-1] + apart[-1]) * (BINS - 1)).astype(int), minlength=BINS).astype(float))
    prior = least_bound(counts[True], counts[False])
    weights = descend(sums_at, prior, d + 1)
    return Model(center, spread, weights[:-1], float(weights[-1]), prior)


def quality_scores(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, score, predicted for every document.

    A null text counts as empty. Without a model every score is 0.5. Repeated rows and null keys are rows
    like others.
    """
    rows = docs.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), whole_text().cast("binary").alias("text"))
    if model is None:
        return rows.select("doc_id", "held_out", F.lit(0.5).alias("score"), F.lit(1).alias("predicted"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.stack([measures(t.as_py()) for t in batch.column(2)])
            z = (x - model.center) / model.spread @ model.weights + model.bias
            score = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"],
            )

    key = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(task, f"doc_id {key}, held_out boolean, score double, predicted int")
