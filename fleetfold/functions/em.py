"""Sums of one round of expectation and maximisation over a block of rows, for many mixtures at once."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

# executors get these functions by value and need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROWS_AT_ONCE = 16384


@dataclass
class Parameters:
    """Weights (k), means (k, d) and covariances (k, d, d) of one mixture."""

    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray


def log_densities(x: np.ndarray, model: Parameters) -> np.ndarray:
    """(rows, k): log of weight times density."""
    out = np.empty((len(x), len(model.weights)))
    for c, (weight, mean, covariance) in enumerate(zip(model.weights, model.means, model.covariances)):
        root = np.linalg.cholesky(covariance)
        z = np.linalg.solve(root, (x - mean).T)
        out[:, c] = np.log(max(weight, 1e-300)) - 0.5 * (z * z).sum(axis=0) - np.log(np.diag(root)).sum() - 0.5 * x.shape[1] * np.log(2 * np.pi)
    return out


def layout(k: int, d: int) -> int:
    """Numbers that one mixture sends: the likelihood, then counts, sums and sums of products."""
    return 1 + k * (1 + d + d * d)


def sums_of(x: np.ndarray, model: Parameters) -> np.ndarray:
    """Log-likelihood and weighted sums of the rows, about the means of the mixture."""
    logs = log_densities(x, model)
    top = logs.max(axis=1, keepdims=True)
    shares = np.exp(logs - top)
    total = shares.sum(axis=1, keepdims=True)
    shares /= total
    parts = [[float((top + np.log(total)).sum())], shares.sum(axis=0)]
    moments, products = [], []
    for c, mean in enumerate(model.means):
        # about the present mean, so that large values do not cancel
        off = x - mean
        weighted = off * shares[:, c : c + 1]
        moments.append(weighted.sum(axis=0))
        products.append((weighted.T @ off).ravel())
    return np.concatenate([*parts, *moments, *products])


def improved(sums: np.ndarray, model: Parameters, least: np.ndarray) -> tuple[float, Parameters]:
    """Log-likelihood under ``model`` and the parameters that its sums lead to.

    A covariance narrower than ``least`` in some direction is widened by it; components without rows stay.
    """
    k, d = model.means.shape
    n = sums[1 : 1 + k]
    moments = sums[1 + k : 1 + k + k * d].reshape(k, d)
    products = sums[1 + k + k * d :].reshape(k, d, d)
    weights, means, covariances = n / n.sum(), model.means.copy(), model.covariances.copy()
    for c in range(k):
        if n[c] > 1e-8:
            shift = moments[c] / n[c]
            means[c] = model.means[c] + shift
            covariance = products[c] / n[c] - np.outer(shift, shift)
            covariance = (covariance + covariance.T) / 2
            scaled = covariance / np.sqrt(np.outer(least, least))
            covariances[c] = covariance if np.linalg.eigvalsh(scaled).min() > 1 else covariance + np.diag(least)
    return float(sums[0]), Parameters(weights, means, covariances)


def round_sums(models: Sequence[tuple[int, Parameters]]):
    """Task function: (model, slot, value), the sums over all rows of the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros(layout(*m.means.shape)) for _, m in models]
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
            for first in range(0, len(x), ROWS_AT_ONCE):
                for total, (_, model) in zip(totals, models):
                    total += sums_of(x[first : first + ROWS_AT_ONCE], model)
        names = np.concatenate([np.full(len(t), number) for t, (number, _) in zip(totals, models)])
        slots = np.concatenate([np.arange(len(t)) for t in totals])
        yield pa.RecordBatch.from_arrays([pa.array(names.astype(np.int32)), pa.array(slots.astype(np.int32)), pa.array(np.concatenate(totals))], ["model", "slot", "value"])

    return run


def seeded(sample: np.ndarray, k: int, rng: np.random.Generator, least: np.ndarray) -> Parameters:
    """A start: distant rows of ``sample`` as means, refined by a few rounds of averaging."""
    scaled = sample / np.sqrt(np.maximum(sample.var(axis=0), 1e-300))
    means = [scaled[rng.integers(len(scaled))]]
    for _ in range(k - 1):
        nearest = np.min([((scaled - m) ** 2).sum(axis=1) for m in means], axis=0)
        share = nearest / nearest.sum() if nearest.sum() > 0 else np.full(len(scaled), 1 / len(scaled))
        means.append(scaled[rng.choice(len(scaled), p=share)])
    means = np.array(means)
    for _ in range(5):
        label = np.argmin([((scaled - m) ** 2).sum(axis=1) for m in means], axis=0)
        means = np.array([scaled[label == c].mean(axis=0) if (label == c).any() else means[c] for c in range(k)])
    label = np.argmin([((scaled - m) ** 2).sum(axis=1) for m in means], axis=0)
    whole = np.cov(sample.T, bias=True).reshape(len(least), len(least)) + np.diag(least)
    groups = [sample[label == c] for c in range(k)]
    weights = np.array([max(len(g), 1) for g in groups], dtype=float)
    centres = np.array([g.mean(axis=0) if len(g) else sample[rng.integers(len(sample))] for g in groups])
    spreads = [np.cov(g.T, bias=True).reshape(whole.shape) + np.diag(least) if len(g) > 2 * len(least) else whole for g in groups]
    return Parameters(weights / weights.sum(), centres, np.array(spreads))
