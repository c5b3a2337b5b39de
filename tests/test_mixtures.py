"""Mixtures fitted side by side: likelihoods, known components and regression errors."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetfold.functions.em import Parameters, improved, log_densities, sums_of
from fleetfold.functions.mixture import conditional_mean
from fleetfold.operators.mixtures import fit_mixtures


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(3)
    low = rng.multivariate_normal([10.0, 1.0], [[4.0, 1.0], [1.0, 1.0]], 700)
    high = rng.multivariate_normal([40.0, 30.0], [[9.0, -4.0], [-4.0, 4.0]], 300)
    rows = [tuple(map(float, r)) for r in np.r_[low, high]] + [(None, 1.0), (3.0, float("nan"))]
    return spark.createDataFrame(rows, "x double, y double").repartition(5)


def test_sums_of_blocks_add_up_and_the_likelihood_never_falls():
    rng = np.random.default_rng(1)
    x = np.r_[rng.normal(0, 1, (200, 3)), rng.normal(4, 2, (100, 3))]
    model = Parameters(np.array([0.3, 0.7]), rng.normal(size=(2, 3)), np.array([np.eye(3), 2 * np.eye(3)]))
    assert np.allclose(sums_of(x, model), sums_of(x[:130], model) + sums_of(x[130:], model))
    likelihoods = []
    for _ in range(30):
        likelihood, model = improved(sums_of(x, model), model, np.full(3, 1e-9))
        likelihoods.append(likelihood)
    assert all(b >= a - 1e-9 for a, b in zip(likelihoods, likelihoods[1:]))
    direct = np.log(np.exp(log_densities(x, model)).sum(axis=1)).sum()
    assert math.isclose(direct, improved(sums_of(x, model), model, np.full(3, 1e-9))[0])


def test_sweep_finds_the_two_components(points):
    fits = fit_mixtures(points, ["x", "y"], [1, 2, 3, 4])
    assert min(fits, key=lambda k: fits[k].bic) == 2 and {f.n for f in fits.values()} == {1000}
    found = fits[2].mixture
    first, second = np.argsort(found.means[:, 0])
    assert np.allclose(found.means[[first, second]], [[10, 1], [40, 30]], atol=0.5)
    assert np.allclose(found.weights[[first, second]], [0.7, 0.3], atol=0.01)
    assert all(fits[k].log_likelihood <= fits[k + 1].log_likelihood + 5 for k in (1, 2, 3))


def test_reruns_agree(points):
    one, two = (fit_mixtures(df, ["x", "y"], [2])[2] for df in (points, points.repartition(3)))
    assert np.allclose(one.mixture.means, two.mixture.means, atol=1e-6)


def test_regression_beats_a_constant(points):
    mixture = fit_mixtures(points.where("x is not null"), ["x", "y"], [2])[2].mixture
    kept = points.where("x is not null and not isnan(y)").withColumn("p", conditional_mean(mixture, "y", ["x"]))
    row = kept.agg(F.avg(F.pow(F.col("y") - F.col("p"), 2)).alias("error"), F.var_pop("y").alias("spread")).first()
    assert row.error < row.spread / 50


def test_constant_columns_few_rows_and_no_rows(spark):
    few = spark.createDataFrame([(1.0, 5.0), (1.0, 6.0), (1.0, 7.0)], "x double, y double")
    fits = fit_mixtures(few, ["x", "y"], [1, 2])
    assert all(np.isfinite(f.log_likelihood) for f in fits.values())
    with pytest.raises(ValueError, match="no row"):
        fit_mixtures(few.limit(0), ["x", "y"], [1])
