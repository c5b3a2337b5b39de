"""The model queries fit what the operators fit by default, not a cut of it."""

import pytest

from fleetfold.catalog import all_queries, jobs
from fleetfold.operators import models

QUERIES = all_queries()


class Called(Exception):
    pass


def caught(monkeypatch, place, name):
    def stand_in(*args, **options):
        raise Called(args, options)

    monkeypatch.setattr(place, name, stand_in)


@pytest.mark.parametrize("name", ["m07_elastic_net", "m09_predict_side_by_side", "s16_model_round_trip"])
def test_whole_penalty_grid(spark, sample, monkeypatch, name):
    caught(monkeypatch, models, "fit_elastic_net")
    with pytest.raises(Called) as call:
        QUERIES[name](spark, sample)
    args, options = call.value.args
    assert len(args) == 4 and not options


@pytest.mark.parametrize("name", ["m08_boosted_trees", "m09_predict_side_by_side", "m20_feature_importance"])
def test_whole_forest(spark, sample, monkeypatch, name):
    monkeypatch.setattr(models, "fit_elastic_net", lambda *args, **options: None)
    caught(monkeypatch, models, "fit_boosted_trees")
    with pytest.raises(Called) as call:
        QUERIES[name](spark, sample)
    args, options = call.value.args
    assert len(args) == 4 and not options


@pytest.mark.parametrize(
    "name, size",
    [("m11_mixture_regression", 5), ("m12_mixture_with_missing_predictors", 4), ("m13_bias_by_component", 4), ("m14_apply_seasonal_mixture", 4)],
)
def test_whole_mixture(spark, sample, monkeypatch, name, size):
    caught(monkeypatch, models, "fit_mixture")
    with pytest.raises(Called) as call:
        QUERIES[name](spark, sample)
    args, options = call.value.args
    assert args[2:] == (size,) and not options


def test_whole_sweep(spark, sample, monkeypatch):
    caught(monkeypatch, models, "mixture_bic_sweep")
    with pytest.raises(Called) as call:
        QUERIES["m10_mixture_size_by_bic"](spark, sample)
    args, options = call.value.args
    assert list(args[2]) == list(range(1, 16)) and not options


@pytest.mark.parametrize("name", ["m17_impute_from_fleet", "m18_impute_from_all_monitors"])
def test_whole_imputation(spark, sample, monkeypatch, name):
    caught(monkeypatch, models, "fit_boosted_trees")
    with pytest.raises(Called) as call:
        QUERIES[name](spark, sample)
    args, options = call.value.args
    assert args[4] == models.imputation_grid() and options == {"trees": 300, "folds": 3}


@pytest.mark.parametrize(
    "name, job, cuts",
    [
        ("job_reference_calibration_daily", "calibrate_to_reference", {"components", "max_iter"}),
        ("job_imputation_daily", "impute_hours", {"candidates", "trees", "folds"}),
    ],
)
def test_whole_jobs(spark, sample, monkeypatch, name, job, cuts):
    caught(monkeypatch, jobs, job)
    with pytest.raises(Called) as call:
        QUERIES[name](spark, sample)
    assert not cuts & set(call.value.args[1])
