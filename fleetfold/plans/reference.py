"""Calibration of device hours against a reference instrument by mixture regression."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetfold.functions.columns import clamp_at_zero
from fleetfold.functions.mixture import Mixture, conditional_mean
from fleetfold.operators.mixtures import ROUNDS
from fleetfold.operators.models import (
    SEASONAL_PREDICTORS,
    apply_mixture,
    fit_mixture,
    hours_to_calibrate,
    model_table,
    with_time_features,
)
from fleetfold.operators.rollup import daily_two_ways
from fleetfold.operators.stats import error_metrics
from fleetfold.session import cut_lineage


@dataclass(frozen=True)
class ReferenceTables:
    model_rows: DataFrame
    mixture: Mixture
    test_metrics: DataFrame
    hourly: DataFrame
    daily: DataFrame


def calibrate_to_reference(
    batches: Sequence[DataFrame],
    reference: DataFrame,
    target: str,
    channels: Mapping[str, DataFrame],
    components: int = 4,
    predictors: Sequence[str] = SEASONAL_PREDICTORS,
    raw: str = "mod_pm25",
    season: Column | None = None,
    starts: DataFrame | None = None,
    min_hours: int = 18,
    max_iter: int = ROUNDS,
) -> ReferenceTables:
    """Fit on the training days, report the held-out error, calibrate every hour, summarise days.

    The model table feeds the fit and the test, so it is written once to the shared folder.
    """
    rows = cut_lineage(model_table(batches, reference, target, starts, season))
    train = rows.where(F.col("split_day_block") == "train")
    test = rows.where(F.col("split_day_block") == "test")
    mixture = fit_mixture(train, [*predictors, target], components, max_iter=max_iter)
    predicted = clamp_at_zero(conditional_mean(mixture, target, list(predictors)))
    metrics = error_metrics(test.withColumn("prediction", predicted), target, "prediction")
    hours = with_time_features(hours_to_calibrate(channels), season)
    hourly = apply_mixture(hours, mixture, target, list(predictors), raw)
    daily = daily_two_ways(hourly, raw, "pm25_fem_gmr", min_hours=min_hours)
    return ReferenceTables(rows, mixture, metrics, hourly, daily)
