"""Particulate matter: merge feeds, fit and apply calibrations, roll up, combine."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from fleetfold.config import RollupRules, Settings
from fleetfold.operators.calibrate import apply_calibration, calibrate_windows
from fleetfold.operators.merge import left_join_summaries, merge_feeds
from fleetfold.operators.rollup import summarize
from fleetfold.session import settle
from fleetfold.sources.tables import cloud_channel, store_by_date

HOURLY = ["monitor", "date", "hour"]
DAILY = ["monitor", "date"]


@dataclass(frozen=True)
class ParticulateTables:
    merged: dict[str, DataFrame]
    calibration: DataFrame
    corrected: dict[str, DataFrame]
    hourly: dict[str, DataFrame]
    daily: dict[str, DataFrame]
    hourly_wide: DataFrame
    daily_wide: DataFrame


def process_particulates(
    cloud: DataFrame,
    card: DataFrame,
    settings: Settings,
    rosters: Mapping[str, DataFrame],
    pollutants: Sequence[str] = ("pm25", "pm1", "pm10"),
    rules: RollupRules = RollupRules(),
    baseline: DataFrame | None = None,
    unique: bool = False,
    require_calibrated: bool = False,
    fitted_on: Column | None = None,
    files_per_day: int = 16,
) -> ParticulateTables:
    """The first pollutant leads: wide tables keep its hours and days.

    The merged readings are stored by date: fits read the days of their window only, and the merge
    runs once. The calibration table is settled (a few rows per monitor), so correcting the minutes is a
    map-only pass with a broadcast lookup.
    """
    merged = {
        p: store_by_date(
            merge_feeds(cloud_channel(cloud, p), card, p, unique=unique), files_per_day
        )
        for p in pollutants
    }
    calibration = settle(calibrate_windows(merged, settings, rosters, baseline, fitted_on))
    corrected = {p: apply_calibration(merged[p], calibration, p) for p in pollutants}
    hourly, daily = {}, {}
    for p in pollutants:
        flag = f"calibrated_{p}" if require_calibrated else None
        hourly[p], daily[p] = summarize(corrected[p], p, rules, calibrated=flag)
    return ParticulateTables(
        merged,
        calibration,
        corrected,
        hourly,
        daily,
        _side_by_side(hourly, pollutants, HOURLY),
        _side_by_side(daily, pollutants, DAILY),
    )


def _side_by_side(
    summaries: Mapping[str, DataFrame], pollutants: Sequence[str], keys: Sequence[str]
) -> DataFrame:
    narrow = [
        summaries[p].select(*keys, f"mean_{p}", f"fleet_average_{p}") for p in pollutants
    ]
    return left_join_summaries(narrow[0], narrow[1:], keys)
