"""Boosted trees against an exhaustive tree, in one block and in several."""

import datetime as dt
import itertools

import numpy as np
import pytest

from fleetfold.functions.boosting import boost, grow_tree
from fleetfold.operators import boosted, models


def exhaustive(rows, y, depth, least_rows):
    """Predictions of the tree that tries every cut of every feature and both sides for missing values."""
    if depth == 0 or len(rows) < 2 * least_rows:
        return {i: y[rows].mean() for i in rows}, 0.0
    best = None
    for f in range(X.shape[1]):
        present = sorted({X[i, f] for i in rows if X[i, f] > 0})
        for cut, missing_left in itertools.product([0, *present], (True, False)):
            left = [i for i in rows if (X[i, f] > 0 and X[i, f] <= cut) or (X[i, f] == 0 and missing_left)]
            right = [i for i in rows if i not in set(left)]
            if min(len(left), len(right)) < least_rows:
                continue
            error = sum(((y[p] - y[p].mean()) ** 2).sum() for p in (left, right))
            if best is None or error < best[0] - 1e-9:
                best = error, left, right
    whole = ((y[rows] - y[rows].mean()) ** 2).sum()
    if best is None or whole - best[0] < 1e-9:
        return {i: y[rows].mean() for i in rows}, whole
    return {**exhaustive(best[1], y, depth - 1, least_rows)[0], **exhaustive(best[2], y, depth - 1, least_rows)[0]}, best[0]


X = np.random.default_rng(4).integers(0, 9, (60, 3)).astype(np.uint8)


@pytest.mark.parametrize("depth, least_rows", [(1, 1), (2, 1), (3, 2), (4, 5)])
def test_one_tree_equals_exhaustive_search(depth, least_rows):
    y = np.random.default_rng(depth).normal(size=60) + X[:, 0] + (X[:, 1] == 0) * 5
    width = 9
    flat = X.astype(np.int64) + np.arange(3) * width
    heap = grow_tree(flat, X, y, np.arange(60), np.arange(3), depth, 0.0, least_rows, width)
    want, _ = exhaustive(list(range(60)), y, depth, least_rows)
    assert np.allclose(heap[3][heap[5]], [want[i] for i in range(60)])


def test_prediction_repeats_what_growing_found():
    y = X @ np.array([1.0, -2.0, 0.5])
    training = np.arange(60) % 4 > 0
    point = {"maxDepth": 3, "stepSize": 0.3, "subsamplingRate": 0.7, "featureSubsetStrategy": 0.6, "minInfoGain": 1e-4, "minInstancesPerNode": 2}
    trees, prediction = boost(X, y, training, point, 40, 1)
    assert np.allclose(trees.predict(X), prediction)
    assert np.abs(prediction - y)[training].mean() < np.abs(y - y[training].mean())[training].mean() / 3
    nothing, constant = boost(X, y, np.zeros(60, dtype=bool), point, 5, 1)
    assert np.allclose(nothing.predict(X), constant) and (constant == 0).all()


def test_growing_ends_when_other_rows_do_not_gain():
    rng = np.random.default_rng(5)
    y, training = rng.normal(size=60), np.arange(60) % 3 > 0
    point = {"maxDepth": 4, "stepSize": 0.5}
    long, _ = boost(X, y, training, point, 200, 1)
    short, prediction = boost(X, y, training, point, 200, 1, patience=10)
    assert len(long.feature) == 200 and len(short.feature) < 50
    assert np.allclose(short.predict(X), prediction)
    errors = [np.square(y - boost(X, y, training, point, n, 1)[1])[~training].sum() for n in range(len(short.feature) + 11)]
    assert int(np.argmin(errors)) == len(short.feature)


@pytest.fixture(scope="module")
def table(spark):
    rng, start = np.random.default_rng(9), dt.date(2024, 1, 1)
    rows = []
    for i in range(900):
        a, b = float(rng.integers(0, 20)), float(rng.normal())
        kind = "wet" if rng.random() < 0.5 else "dry"
        y = float(3 * a + (10 if kind == "wet" else 0) + 5 * np.sin(b) + rng.normal(0, 0.3))
        rows.append((start + dt.timedelta(days=i % 30), a, None if i % 11 == 0 else b, None if i % 97 == 0 else kind, None if i % 50 == 7 else y))
    return spark.createDataFrame(rows, "date date, a double, b double, kind string, y double").repartition(4)


GRID = [
    {"maxDepth": 1, "stepSize": 0.01},
    {"maxDepth": 4, "stepSize": 0.1, "subsamplingRate": 0.8},
    {"maxDepth": 3, "stepSize": 0.05, "minInstancesPerNode": 5},
]


def rmse(model, df):
    rows = [r for r in model.transform(df).collect() if r.y is not None]
    return np.sqrt(np.mean([(r.y - r.prediction) ** 2 for r in rows]))


def test_tuning_in_one_and_in_several_blocks(table):
    whole = boosted.tune_boosted_trees(table, ["a", "b"], ["kind"], "y", GRID, 60, 3)
    assert len(whole.errors) == 3 and whole.errors[0] == max(whole.errors)
    assert whole.bestModel.point == GRID[int(np.argmin(whole.errors))]
    assert rmse(whole.bestModel, table) < 2
    again = boosted.tune_boosted_trees(table.repartition(3), ["a", "b"], ["kind"], "y", GRID, 60, 3)
    assert again.errors == whole.errors
    parts = boosted.tune_boosted_trees(table, ["a", "b"], ["kind"], "y", GRID, 60, 3, block_rows=250)
    assert len(parts.bestModel.blocks) == 4 and rmse(parts.bestModel, table) < 3
    shares = whole.bestModel.importances()
    assert max(shares, key=shares.get) == "a" and abs(sum(shares.values()) - 1) < 1e-9
    assert set(shares) == {"a", "b", "kind_dry", "kind_wet"}


def test_unknown_levels_and_missing_values_are_predicted(spark, table):
    model = boosted.tune_boosted_trees(table, ["a", "b"], ["kind"], "y", GRID[1:2], 40, 3).bestModel
    odd = spark.createDataFrame([(None, None, "other", None), (3.0, float("nan"), "wet", None)], "a double, b double, kind string, y double")
    assert all(r.prediction is not None and np.isfinite(r.prediction) for r in model.transform(odd).collect())
    assert model.transform(odd.limit(0)).count() == 0
    side = models.predict_with(odd, {"p": model}, ["a", "b"])
    assert side.columns == [*odd.columns, "p"] and all(r.p >= 0 for r in side.collect())
    top = models.top_importances(spark, model, 2, "kind").collect()
    assert top[0].feature == "a" and not any(r.feature.startswith("kind") for r in top)


def test_tables_without_targets_are_refused(table):
    with pytest.raises(ValueError, match="no row"):
        boosted.tune_boosted_trees(table.where("y is null"), ["a"], [], "y", GRID, 5, 2)
    with pytest.raises(ValueError, match="levels"):
        boosted.tune_boosted_trees(table.selectExpr("date", "a", "y", "concat(cast(y as string), cast(b as string)) as kind"), ["a"], ["kind"], "y", GRID, 5, 2)
