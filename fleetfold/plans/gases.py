"""Gases: merge, combine, calibrate against a reference device, correct, roll up."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetfold.config import GasRules, RollupRules
from fleetfold.functions.columns import is_gas_device
from fleetfold.operators.calibrate import (
    apply_gas_calibration,
    gas_regressions,
    with_reference_channels,
)
from fleetfold.operators.merge import combine_naturally, merge_feeds
from fleetfold.operators.ordering import first_per_key
from fleetfold.operators.reshape import to_long
from fleetfold.operators.rollup import summarize
from fleetfold.session import settle
from fleetfold.sources.tables import cloud_channel, store_by_date


@dataclass(frozen=True)
class GasTables:
    combined: DataFrame
    coefficients: DataFrame
    corrected: DataFrame
    hourly: DataFrame
    daily: DataFrame


def process_gases(
    cloud: DataFrame,
    card: DataFrame,
    gas: GasRules,
    community_from,
    rules: RollupRules = RollupRules(),
    tie_break: list[Column] | None = None,
    files_per_day: int = 16,
) -> GasTables:
    """All gases go through one long-form roll-up, keyed by gas.

    ``tie_break`` orders duplicate minutes of a feed; by default the smaller value comes first.
    """
    devices = cloud.where(is_gas_device("monitor"))
    channels = {}
    for name in gas.gases:
        order = tie_break or [F.col(name).asc_nulls_last()]
        feed = merge_feeds(
            cloud_channel(devices, name), card, name, how="left", label="source", unique=False
        )
        channels[name] = first_per_key(feed, ["monitor", "timestamp"], order)
    combined = store_by_date(combine_naturally(channels), files_per_day)
    colocated = combined.where(F.col("date").between(F.lit(gas.start), F.lit(gas.end)))
    paired = with_reference_channels(colocated, gas.reference_monitor, gas.gases)
    coefficients = settle(gas_regressions(paired, gas.gases, gas.min_points, gas.min_r2))
    community = combined.where(F.col("date") >= F.lit(community_from))
    corrected = apply_gas_calibration(community, coefficients, gas.gases)
    long = to_long(corrected, ["monitor", "timestamp"], gas.gases, "gas", "value")
    hourly, daily = summarize(long, "value", rules, keys=("gas",))
    return GasTables(combined, coefficients, corrected, hourly, daily)
