"""Exact quantiles and ranks by counting, against sorting."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetfold.operators import ordering

PROBS = {"p0": 0.0, "q1": 0.25, "half": 0.5, "p999": 0.999, "p1": 1.0}


def same(a, b):
    return (a is None and b is None) or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12)


def expected(values):
    known = np.array([v for v in values if v is not None and not math.isnan(v)])
    if not len(known):
        return [0] + [None] * (4 + len(PROBS))
    quantiles = [float(np.quantile(known, p)) for p in PROBS.values()]
    sd = float(known.std(ddof=1)) if len(known) > 1 else None
    return [len(known), float(known.mean()), sd, float(known.min()), float(known.max()), *quantiles]


def groups():
    rng = random.Random(2)
    yield "many", [rng.gauss(50, 20) for _ in range(3000)]
    yield "spread", [rng.choice([-1, 1]) * 10 ** rng.uniform(-100, 100) for _ in range(400)]
    yield "near", [1e9 + k * 2**-23 for k in rng.sample(range(5000), 900)]
    yield "ties", [rng.choice([0.0, -0.0, 1.0, 2.5]) for _ in range(700)]
    yield "one", [7.25]
    yield "two", [3.0, 4.0]
    yield "none", [None, float("nan")]
    yield None, [1.0, None, 2.0, 9.0]


def test_quantiles_and_moments_of_every_group(spark):
    rows = [(k, v) for k, values in groups() for v in values]
    df = spark.createDataFrame(rows, "k string, v double").repartition(6)
    got = {r.k: list(r)[1:] for r in ordering.quantile_table(df, "v", PROBS, ["k"]).collect()}
    assert set(got) == {k for k, _ in groups()}
    for k, values in groups():
        want = expected(values)
        if k == "near":  # a deviation of a few units in the last place of the values
            assert math.isclose(got[k][2], want[2], rel_tol=1e-3)
            got[k][2] = want[2]
        assert all(same(a, b) for a, b in zip(got[k], want)), (k, got[k], want)


def test_without_keys_and_without_rows(spark):
    values = [float(x) for x in np.random.default_rng(1).normal(size=2000)]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(4)
    row = ordering.quantile_table(df, "v", PROBS).first()
    assert all(same(a, b) for a, b in zip(row, expected(values)))
    assert ordering.exact_quantiles(df.limit(0), "v", PROBS).count() == 0
    assert ordering.exact_quantiles(df.limit(0).withColumn("k", F.lit(1)), "v", PROBS, ["k"]).count() == 0


def test_one_key_with_a_million_values(spark):
    n = 1_000_003
    df = spark.range(n).select((F.col("id") * 7919 % n).cast("double").alias("v"), F.lit("hot").alias("k"))
    row = ordering.quantile_table(df, "v", {"half": 0.5, "q": 0.3}, ["k"]).first()
    assert (row.n, row.half, row.min, row.max) == (n, (n - 1) / 2, 0.0, n - 1.0)
    assert same(row.q, 0.3 * (n - 1))


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_ranks(spark, keys):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), None if rng.random() < 0.05 else rng.randrange(300)) for _ in range(4000)]
    df = spark.createDataFrame(rows, "k string, v int").repartition(5)
    got = ordering.value_ranks(df, "v", keys, [F.sum(F.col("v") * 2).alias("twice")]).collect()
    of = lambda k: [v for key, v in rows if v is not None and (not keys or key == k)]
    assert len(got) == len({(k if keys else 0, v) for k, v in rows if v is not None})
    for r in got:
        mine = of(r.k if keys else None)
        assert (r.n, r.n_below) == (mine.count(r.v), sum(v < r.v for v in mine))
        assert r.twice == 2 * r.v * r.n
    assert ordering.value_ranks(df.limit(0), "v", keys).count() == 0
