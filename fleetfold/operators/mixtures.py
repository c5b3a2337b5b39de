"""Gaussian mixtures of several sizes and starts, fitted side by side.

Every round is one scan: each task sums up its rows for all mixtures that still change, the sums are
added in one grouping, and the driver keeps a few hundred numbers per mixture. A mixture rests as soon
as its likelihood per row does.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetfold.functions.em import Parameters, improved, layout, round_sums, seeded
from fleetfold.functions.mixture import Mixture
from fleetfold.session import settle

# starts of each size, rounds after which only the best of them goes on, rounds at most; a fit rests
# when a round adds less than this share of its likelihood
STARTS, SHORT_ROUNDS, ROUNDS, TOLERANCE = 3, 8, 100, 1e-5
SAMPLE_ROWS = 4096  # starts are sought among this many rows; the fit itself reads all rows
NARROWEST = 1e-9  # least variance of a component, as a share of that of all rows


@dataclass(frozen=True)
class FittedMixture:
    mixture: Mixture
    log_likelihood: float
    n: int
    rounds: int

    @property
    def bic(self) -> float:
        k, d = self.mixture.means.shape
        free = k * (1 + d + d * (d + 1) / 2) - 1
        return -2 * self.log_likelihood + free * math.log(self.n)


def _summed(rows: DataFrame, models: dict[int, Parameters]) -> dict[int, np.ndarray]:
    """The sums of one round, per mixture."""
    parts = rows.mapInArrow(round_sums(sorted(models.items())), "model int, slot int, value double")
    sums = {m: np.zeros(layout(*p.means.shape)) for m, p in models.items()}
    for r in parts.groupBy("model", "slot").agg(F.sum("value").alias("value")).collect():
        sums[r.model][r.slot] = r.value
    return sums


def fit_mixtures(
    df: DataFrame,
    columns: Sequence[str],
    sizes: Sequence[int],
    starts: int = STARTS,
    seed: int = 11,
    max_rounds: int = ROUNDS,
    tolerance: float = TOLERANCE,
) -> dict[int, FittedMixture]:
    """The best of several starts for every size, by the likelihood of all rows after a few rounds.

    Rows with a null or NaN are left out; no row at all is an error. A constant column gets a small variance.
    """
    x = [F.col(c).cast("double") for c in columns]
    names = [f"x{i}" for i in range(len(columns))]
    rows = settle(df.select(*(F.nanvl(v, F.lit(None).cast("double")).alias(n) for v, n in zip(x, names))).dropna())
    spread = rows.agg(F.count(F.lit(1)).alias("n"), *(F.avg(n).alias(f"m_{n}") for n in names), *(F.var_pop(n).alias(f"v_{n}") for n in names)).first()
    if spread.n == 0:
        raise ValueError("no row with all columns")
    variance = np.array([spread[f"v_{n}"] for n in names])
    least = NARROWEST * np.where(variance > 0, variance, 1.0)
    # a digest of the row and not its place, so that reruns start alike
    picked = rows.orderBy(F.xxhash64(F.lit(seed), *names), *names).limit(SAMPLE_ROWS).collect()
    sample = np.array([tuple(r) for r in picked])
    kinds = [(k, s) for k in sizes for s in range(starts if k > 1 else 1)]
    models = {i: seeded(sample, k, np.random.default_rng([seed, k, s]), least) for i, (k, s) in enumerate(kinds)}
    likelihood, rounds, resting = dict.fromkeys(models, -math.inf), dict.fromkeys(models, 0), {}
    while models:
        sums, going = _summed(rows, models), {}
        for i, model in models.items():
            now, better = improved(sums[i], model, least)
            settled = now - likelihood[i] < tolerance * (1 + abs(now)) and rounds[i] > (1 if kinds[i][0] == 1 else 2)
            likelihood[i] = now
            if settled or rounds[i] >= max_rounds:
                resting[i] = model
            else:
                going[i], rounds[i] = better, rounds[i] + 1
        if going and max(rounds[i] for i in going) == SHORT_ROUNDS:
            leader = {k: max((i for i in likelihood if kinds[i][0] == k), key=lambda i: likelihood[i]) for k in sizes}
            going = {i: m for i, m in going.items() if leader[kinds[i][0]] == i}
        models = going
    best = {}
    for i in resting:
        k = kinds[i][0]
        if k not in best or likelihood[i] > likelihood[best[k]]:
            best[k] = i
    return {
        k: FittedMixture(Mixture(tuple(columns), resting[i].weights, resting[i].means, resting[i].covariances), likelihood[i], spread.n, rounds[i])
        for k, i in best.items()
    }
