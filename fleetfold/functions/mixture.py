"""Gaussian mixture regression as column expressions.

A fitted mixture over (predictors, target) is a handful of small matrices. They are inverted on the
driver and enter the plan as literals, so prediction runs inside generated code on every executor
and needs no Python workers.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Mixture:
    """Weights (k), means (k, d) and covariances (k, d, d) over the named columns."""

    columns: tuple[str, ...]
    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray

    def positions(self, names: Sequence[str]) -> list[int]:
        return [self.columns.index(n) for n in names]

    def rows(self) -> list[tuple[int, float, list[float], list[float]]]:
        """One row per component, for storing the mixture as a table."""
        return [
            (i, float(w), [float(v) for v in m], [float(v) for v in c.ravel()])
            for i, (w, m, c) in enumerate(zip(self.weights, self.means, self.covariances))
        ]

    @classmethod
    def from_rows(cls, columns: Sequence[str], rows) -> Mixture:
        ordered = sorted(rows, key=lambda r: r[0])
        d = len(columns)
        return cls(
            tuple(columns),
            np.array([r[1] for r in ordered]),
            np.array([r[2] for r in ordered]),
            np.array([np.reshape(r[3], (d, d)) for r in ordered]),
        )


def _total(terms: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)


def _stable(matrix: np.ndarray) -> np.ndarray:
    """Add a little to the diagonal where a component is flat in some direction."""
    jitter = 1e-9 * max(1.0, float(np.trace(matrix)) / len(matrix))
    for _ in range(8):
        if np.linalg.eigvalsh(matrix).min() > 0:
            return matrix
        matrix = matrix + jitter * np.eye(len(matrix))
        jitter *= 10
    return matrix


def log_densities(mixture: Mixture, names: Sequence[str]) -> list[Column]:
    """log(weight * density) of each component over the columns ``names`` (others marginalised)."""
    at = mixture.positions(names)
    out = []
    for weight, mean, covariance in zip(mixture.weights, mixture.means, mixture.covariances):
        block = _stable(covariance[np.ix_(at, at)])
        precision = np.linalg.inv(block)
        _, log_det = np.linalg.slogdet(block)
        constant = math.log(max(weight, 1e-300)) - 0.5 * (len(at) * math.log(2 * math.pi) + log_det)
        centred = [F.col(n) - float(mean[i]) for n, i in zip(names, at)]
        quadratic = []
        for a in range(len(at)):
            quadratic.append(centred[a] * centred[a] * float(precision[a, a]))
            quadratic += [
                centred[a] * centred[b] * float(2 * precision[a, b]) for b in range(a + 1, len(at))
            ]
        out.append(F.lit(float(constant)) - _total(quadratic) * 0.5)
    return out


def responsibilities(mixture: Mixture, names: Sequence[str]) -> list[Column]:
    """Probability of each component, computed from log densities shifted by their maximum."""
    logs = log_densities(mixture, names)
    top = F.greatest(*logs) if len(logs) > 1 else logs[0]
    shifted = [F.exp(v - top) for v in logs]
    norm = _total(shifted)
    return [v / norm for v in shifted]


def hard_label(mixture: Mixture, names: Sequence[str]) -> Column:
    """Position (from 1) of the most likely component."""
    logs = F.array(*log_densities(mixture, names))
    return F.array_position(logs, F.array_max(logs)).cast("int")


def conditional_mean(mixture: Mixture, target: str, names: Sequence[str]) -> Column:
    """E[target | names]; null as soon as one predictor is null."""
    at = mixture.positions(names)
    y = mixture.columns.index(target)
    terms = []
    for share, mean, covariance in zip(
        responsibilities(mixture, names), mixture.means, mixture.covariances
    ):
        block = _stable(covariance[np.ix_(at, at)])
        slopes = np.linalg.solve(block, covariance[at, y])
        linear = [
            (F.col(n) - float(mean[i])) * float(b) for n, i, b in zip(names, at, slopes)
        ]
        terms.append(share * (F.lit(float(mean[y])) + _total(linear)))
    return _total(terms)


def conditional_mean_with_gaps(
    mixture: Mixture, target: str, required: Sequence[str], optional: Sequence[str]
) -> Column:
    """Like ``conditional_mean``, but a null among ``optional`` is marginalised out of the row."""
    patterns = range(2 ** len(optional))
    prediction = F
    for pattern in patterns:
        present = [n for i, n in enumerate(optional) if not pattern >> i & 1]
        missing = [n for n in optional if n not in present]
        test = reduce(
            lambda a, b: a & b,
            [F.col(n).isNotNull() for n in present] + [F.col(n).isNull() for n in missing],
            F.lit(True),
        )
        names = [c for c in mixture.columns if c in (*required, *present)]
        prediction = prediction.when(test, conditional_mean(mixture, target, names))
    return prediction
