"""Filling missing hours from the rest of the fleet with boosted trees."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetfold.functions.calendar import date_hour
from fleetfold.functions.columns import canonical_monitor
from fleetfold.operators.boosted import TunedTrees
from fleetfold.operators.completeness import daily_hour_share
from fleetfold.operators.impute import fill_gaps, leave_one_out
from fleetfold.operators.merge import combine_channels, stack_batches
from fleetfold.operators.models import fit_boosted_trees, imputation_grid, predict_with
from fleetfold.operators.ordering import day_block_split
from fleetfold.operators.rollup import daily_filled
from fleetfold.operators.stats import error_metrics
from fleetfold.session import cut_lineage

KEYS = ["monitor", "date", "hour"]
FEATURES = ("fleet_avg", "hour", "month", "dow", "mean_met_temp", "mean_met_rh")


@dataclass(frozen=True)
class ImputationTables:
    model: TunedTrees
    test_metrics: DataFrame
    hourly: DataFrame
    daily: DataFrame
    completeness_before: DataFrame
    completeness_after: DataFrame


def combine_hours(batches: Mapping[str, Sequence[DataFrame]]) -> DataFrame:
    """Hourly means of several measures side by side under canonical monitor ids.

    ``batches`` maps a mean column to its (possibly overlapping) batches; earlier batches win.
    """
    channels = {}
    for name, parts in batches.items():
        cleaned = [
            p.select(canonical_monitor("monitor").alias("monitor"), "date", "hour", name)
            for p in parts
        ]
        channels[name] = stack_batches(cleaned, KEYS, [F.col(name).asc_nulls_last()])
    wide = combine_channels(channels, KEYS).where(F.col("hour").isNotNull())
    return wide.withColumn("timestamp", date_hour("date", "hour"))


def with_fleet_features(hours: DataFrame, value: str = "mean_pm25") -> DataFrame:
    scored = leave_one_out(hours, value, mode="others")
    return scored.withColumns({"month": F.month("date"), "dow": F.weekday("date")})


def impute_hours(
    batches: Mapping[str, Sequence[DataFrame]],
    value: str = "mean_pm25",
    features: Sequence[str] = FEATURES,
    candidates: int = 8,
    trees: int = 300,
    folds: int = 3,
    seed: str = "222",
) -> ImputationTables:
    rows = cut_lineage(with_fleet_features(combine_hours(batches), value))
    known = day_block_split(rows.where(F.col(value).isNotNull()), "date", seed=seed)
    train = known.where(F.col("split_day_block") == "train")
    test = known.where(F.col("split_day_block") == "test")
    model = fit_boosted_trees(
        train, features, ["monitor"], value, imputation_grid(candidates), trees, folds
    )
    best = {"pred_pm25": model.bestModel}
    metrics = error_metrics(predict_with(test, best, features), value, "pred_pm25")
    hourly = fill_gaps(predict_with(rows, best, features), value, "pred_pm25")
    daily = daily_filled(hourly, "pm25_filled", "pm25_was_imputed", "pm25")
    return ImputationTables(
        model,
        metrics,
        hourly,
        daily,
        daily_hour_share(rows, value),
        daily_hour_share(hourly, "pm25_filled"),
    )
