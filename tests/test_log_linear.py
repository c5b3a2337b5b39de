"""Log-linear fits, also where predictors are constant or depend on each other."""

import math

import pytest
from pyspark.sql import functions as F

from fleetfold.operators import models

ROWS = [(math.exp(1.0 + 0.5 * i + (-1) ** i * 0.1), float(i), 0.0, 3.0 - 2.0 * i) for i in range(8)]
FIELDS = "value double, a double, zero double, b double"


def fitted(df, *names):
    return {r.term: r for r in models.log_linear_fit(df, "value", {n: F.col(n) for n in names}).collect()}


def test_predictors_without_information_have_null_coefficients(spark):
    df = spark.createDataFrame(ROWS, FIELDS)
    plain, full = fitted(df, "a"), fitted(df, "zero", "a", "b")
    assert list(full) == ["zero", "a", "b", "(intercept)"]
    for term in ("a", "(intercept)"):
        assert full[term][1:] == pytest.approx(plain[term][1:])
        assert full[term].std_error > 0 and full[term].p_value < 0.05
    assert full["zero"][1:5] == full["b"][1:5] == (None,) * 4


def test_only_a_constant_predictor_leaves_the_mean(spark):
    rows = fitted(spark.createDataFrame(ROWS, FIELDS), "zero")
    logs = [math.log(r[0]) for r in ROWS]
    mean = sum(logs) / 8
    error = math.sqrt(sum((v - mean) ** 2 for v in logs) / 7 / 8)
    assert rows["zero"].estimate is None
    assert rows["(intercept)"][1:4] == pytest.approx((mean, error, mean / error))
    assert rows["(intercept)"].r2 == 0


def test_two_rows_and_no_rows(spark):
    df = spark.createDataFrame(ROWS, FIELDS)
    two, none = fitted(df.where("a < 2"), "a"), fitted(df.where("a < 0"), "a")
    assert two["a"].estimate == pytest.approx(0.3) and two["a"].std_error is None
    assert [r.estimate for r in none.values()] == [None, None]
