"""Tail probabilities for the few test statistics a report holds.

The statistics themselves come out of Spark aggregations; these vectorised helpers only turn the
resulting handful of numbers into p-values.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# executors get these functions by value and need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def normal_upper(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2.0))


def beta_regularised(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by numerical integration on a transformed grid."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - beta_regularised(b, a, 1.0 - x)
    # u = t**a removes the singularity at 0; Gauss-Legendre on panels of the log-scaled integrand
    nodes, weights = np.polynomial.legendre.leggauss(32)
    log_norm = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    edges = np.linspace(-60.0, 0.0, 241) / max(a, 1e-3)
    left, right = edges[:-1, None], edges[1:, None]
    s = 0.5 * (right - left) * nodes[None, :] + 0.5 * (right + left)
    t = x * np.exp(s)
    log_f = a * np.log(t) + (b - 1.0) * np.log1p(-t) + log_norm
    return float(np.sum(0.5 * (right - left) * weights[None, :] * np.exp(log_f)))


def f_upper(f: float, df1: float, df2: float) -> float:
    if not f > 0:
        return 1.0
    return beta_regularised(df2 / 2.0, df1 / 2.0, df2 / (df2 + df1 * f))


def t_two_sided(t: float, df: float) -> float:
    return beta_regularised(df / 2.0, 0.5, df / (df + t * t))


def studentised_range_upper(q: float, k: int, df: float) -> float:
    """P(Q > q) for ``k`` means and ``df`` degrees of freedom."""
    if not q > 0:
        return 1.0
    nodes, weights = np.polynomial.legendre.leggauss(64)
    z = np.linspace(-8.0, 8.0, 801)
    step = z[1] - z[0]
    density = np.exp(-0.5 * z * z) / math.sqrt(2 * math.pi)
    cdf = np.vectorize(lambda v: 0.5 * math.erfc(-v / math.sqrt(2.0)))
    phi_z = cdf(z)

    def range_cdf(width: float) -> float:
        inner = np.clip(phi_z - cdf(z - width), 0.0, 1.0) ** (k - 1)
        return float(min(1.0, k * step * np.sum(density * inner)))

    # scale s of the pooled deviation: df * s**2 is chi-square with df degrees of freedom; the panel
    # narrows as df grows, and the density is taken relative to s = 1 so that nothing cancels
    spread = 1.0 / math.sqrt(2.0 * df)
    low, high = max(1e-6, 1.0 - 8 * spread), 1.0 + 8 * spread + 4.0 / df
    s = 0.5 * (high - low) * nodes + 0.5 * (high + low)
    off = s - 1.0
    log_density = (df - 1.0) * np.log1p(off) - df * (off + off * off / 2.0)
    mass = weights * np.exp(log_density - log_density.max())
    return float(max(0.0, 1.0 - np.sum(mass * np.array([range_cdf(q * v) for v in s])) / mass.sum()))


def _per_value(function, *series: pd.Series) -> pd.Series:
    frame = pd.concat(series, axis=1)
    out = [
        None if any(pd.isna(v) for v in row) else function(*row)
        for row in frame.itertuples(index=False, name=None)
    ]
    return pd.Series(out, dtype="float64")


@F.pandas_udf(DoubleType())
def f_pvalue(f: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    return _per_value(f_upper, f, df1, df2)


@F.pandas_udf(DoubleType())
def t_pvalue(t: pd.Series, df: pd.Series) -> pd.Series:
    return _per_value(t_two_sided, t, df)


@F.pandas_udf(DoubleType())
def tukey_pvalue(q: pd.Series, k: pd.Series, df: pd.Series) -> pd.Series:
    return _per_value(lambda a, b, c: studentised_range_upper(a, int(b), c), q, k, df)


@F.pandas_udf(DoubleType())
def normal_upper_pvalue(z: pd.Series) -> pd.Series:
    return _per_value(normal_upper, z)


def studentised_range_quantile(p: float, k: int, df: float) -> float:
    """Value exceeded with probability 1 - p, by bisection."""
    low, high = 0.0, 8.0
    while studentised_range_upper(high, k, df) > 1.0 - p:
        low, high = high, 2.0 * high
    for _ in range(60):
        middle = 0.5 * (low + high)
        if studentised_range_upper(middle, k, df) > 1.0 - p:
            low = middle
        else:
            high = middle
    return 0.5 * (low + high)


@F.pandas_udf(DoubleType())
def tukey_critical(k: pd.Series, df: pd.Series) -> pd.Series:
    cache: dict[tuple[int, float], float] = {}

    def value(groups: float, freedom: float) -> float:
        key = (int(groups), float(freedom))
        if key not in cache:
            cache[key] = studentised_range_quantile(0.95, *key)
        return cache[key]

    return _per_value(value, k, df)
