"""Colocation regressions and their application."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetfold.config import FitRules, Settings, Window
from fleetfold.functions.columns import inverse_linear, null_below, usable_slope
from fleetfold.operators.merge import restrict_to
from fleetfold.operators.ordering import attach, first_per_key
from fleetfold.operators.reshape import coefficients_wide
from fleetfold.session import settle

CALIBRATION_SCHEMA = (
    "monitor string, pollutant string, slope double, intercept double, r2 double, rmse double, "
    "n_points bigint, method string, reference_monitor string, colocation_start timestamp_ntz, "
    "colocation_end timestamp_ntz, fitted_on date, window_name string"
)
CALIBRATION_COLUMNS = [part.strip().split(" ")[0] for part in CALIBRATION_SCHEMA.split(",")]


def least_squares(df: DataFrame, y: str, x: str, keys: Sequence[str] = ("monitor",)) -> DataFrame:
    """y ~ x per group from running sums: n, slope, intercept, r2 and root mean squared residual."""
    yc, xc = F.col(y), F.col(x)
    syy, sxx, sxy = F.regr_syy(yc, xc), F.regr_sxx(yc, xc), F.regr_sxy(yc, xc)
    residual = F.greatest(F.when(sxx != 0, syy - sxy * sxy / sxx), F.lit(0.0))
    n = F.regr_count(yc, xc)
    return (
        df.where(yc.isNotNull() & xc.isNotNull())
        .groupBy(*keys)
        .agg(
            n.alias("n_points"),
            F.regr_slope(yc, xc).alias("slope"),
            F.regr_intercept(yc, xc).alias("intercept"),
            F.regr_r2(yc, xc).alias("r2"),
            F.when(sxx != 0, F.sqrt(residual / n)).alias("rmse"),
        )
    )


def regression_table(
    df: DataFrame, y: str, x: str, keys: Sequence[str] = ("monitor",), digits: int = 2
) -> DataFrame:
    """Fit, root mean squared and mean absolute error per group, rounded for a report."""
    rows = df.where(F.col(y).isNotNull() & F.col(x).isNotNull())
    fit = least_squares(rows, y, x, keys).select(*keys, "slope", "intercept")
    miss = F.col(y) - (F.col("slope") * F.col(x) + F.col("intercept"))
    return (
        attach(rows, fit, list(keys), "inner")
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("N"),
            F.bround(F.max("slope"), digits).alias("slope"),
            F.bround(F.max("intercept"), digits).alias("intercept"),
            F.bround(F.sqrt(F.avg(miss * miss)), digits).alias("RMSE"),
            F.bround(F.avg(F.abs(miss)), digits).alias("AME"),
        )
    )


def fleet_average(
    df: DataFrame, value: str, min_active: int, roster: DataFrame | None = None,
    time: str = "timestamp",
) -> DataFrame:
    """Average of the monitors reporting at each time step; steps with too few are dropped."""
    rows = df if roster is None else restrict_to(df, roster)
    n = F.count(value)
    return (
        rows.groupBy(time)
        .agg(n.alias("n_active"), F.avg(value).alias("fleet_avg"))
        .where((F.col("n_active") >= min_active) & F.col("fleet_avg").isNotNull())
    )


def _in_window(df: DataFrame, window: Window) -> DataFrame:
    return df.where(F.col("date").between(F.lit(window.start), F.lit(window.end)))


def _with_provenance(
    fits: DataFrame,
    pollutant: str,
    window: Window,
    rules: FitRules,
    method: str,
    fitted_on: Column,
) -> DataFrame:
    kept = fits.where((F.col("n_points") >= rules.min_points) & (F.col("r2") >= rules.min_r2))
    return kept.select(
        "monitor",
        F.lit(pollutant).alias("pollutant"),
        "slope",
        "intercept",
        "r2",
        "rmse",
        "n_points",
        F.lit(method).alias("method"),
        F.lit(window.reference_monitor).cast("string").alias("reference_monitor"),
        F.lit(window.start).cast("timestamp_ntz").alias("colocation_start"),
        F.lit(window.end).cast("timestamp_ntz").alias("colocation_end"),
        fitted_on.alias("fitted_on"),
        F.lit(window.name).alias("window_name"),
    )


def calibrate_on_fleet(
    df: DataFrame,
    value: str,
    window: Window,
    rules: FitRules,
    roster: DataFrame | None = None,
    fitted_on: Column | None = None,
) -> DataFrame:
    """Fit every monitor of a colocation against the average of the colocated fleet."""
    rows = _in_window(df, window)
    targets = rows if roster is None else restrict_to(rows, roster)
    pairs = targets.join(fleet_average(rows, value, rules.min_active_monitors, roster), "timestamp")
    fits = least_squares(pairs, value, "fleet_avg")
    day = F.current_date() if fitted_on is None else fitted_on
    return _with_provenance(fits, value, window, rules, "fleet_avg", day)


def recency(cal: DataFrame) -> list[Column]:
    """Latest fit first; ties by number of points, then by r2."""
    latest = F.coalesce(F.col("fitted_on"), F.to_date("colocation_end"))
    return [latest.desc_nulls_last(), F.col("n_points").desc_nulls_last(),
            F.col("r2").desc_nulls_last()]


def most_recent_fit(cal: DataFrame, pollutant: str | None = None) -> DataFrame:
    """One calibration per monitor (and pollutant, if none is named)."""
    if pollutant is not None:
        return first_per_key(cal.where(F.col("pollutant") == pollutant), ["monitor"], recency(cal))
    return first_per_key(cal, ["pollutant", "monitor"], recency(cal))


def reference_coefficients(cal: DataFrame, monitor: str, pollutant: str) -> DataFrame:
    """Latest coefficients of the reference monitor: at most one row."""
    mine = cal.where(F.col("monitor") == monitor)
    return most_recent_fit(mine, pollutant).select("slope", "intercept")


def corrected_reference(
    rows: DataFrame, value: str, monitor: str, baseline: DataFrame
) -> DataFrame:
    """Readings of the reference monitor, corrected; fails if it has no usable coefficients.

    The coefficients are one row, read before the plan is built, so the error does not wait for a
    reading of the reference monitor and the plan does not carry the fits they come from.
    """
    prior = reference_coefficients(baseline, monitor, value)
    found = prior.where(usable_slope("slope") & F.col("intercept").isNotNull()).first()
    if found is None:
        raise ValueError(f"no usable baseline coefficients for {monitor} ({value})")
    corrected = (F.col(value) - F.lit(found.intercept)) / F.lit(found.slope)
    return rows.where(F.col("monitor") == monitor).select("timestamp", corrected.alias("ref_corr"))


def calibrate_on_reference(
    df: DataFrame,
    value: str,
    window: Window,
    rules: FitRules,
    baseline: DataFrame,
    roster: DataFrame | None = None,
    fitted_on: Column | None = None,
) -> DataFrame:
    """Fit every monitor of a colocation against one already calibrated monitor."""
    if window.reference_monitor is None:
        raise ValueError(f"window {window.name!r} names no reference monitor")
    rows = _in_window(df, window)
    targets = rows if roster is None else restrict_to(rows, roster)
    reference = corrected_reference(rows, value, window.reference_monitor, baseline)
    fits = least_squares(targets.join(reference, "timestamp"), value, "ref_corr")
    day = F.current_date() if fitted_on is None else fitted_on
    return _with_provenance(fits, value, window, rules, "coloc_vs_corrected_ref", day)


def calibrate_windows(
    frames: Mapping[str, DataFrame],
    settings: Settings,
    rosters: Mapping[str, DataFrame],
    baseline: DataFrame | None = None,
    fitted_on: Column | None = None,
) -> DataFrame:
    """All windows of all pollutants in order; a later window may use the fits of an earlier one.

    Each fit is a small table of coefficients and is settled, so plans grow with the windows, not by
    a factor for each one that builds on another.
    """
    parts: list[DataFrame] = [] if baseline is None else [baseline]
    for window in settings.windows:
        roster = rosters.get(window.group) if window.group else None
        fresh = []
        for pollutant, df in frames.items():
            if window.reference_monitor is None:
                fit = calibrate_on_fleet(df, pollutant, window, settings.fit, roster, fitted_on)
            else:
                if not parts:
                    raise ValueError(f"window {window.name!r} needs a baseline calibration")
                known = reduce(DataFrame.unionByName, parts)
                fit = calibrate_on_reference(
                    df, pollutant, window, settings.fit, known, roster, fitted_on
                )
            fresh.append(settle(fit))
        parts.extend(fresh)
    return reduce(DataFrame.unionByName, parts)


def apply_calibration(
    df: DataFrame,
    cal: DataFrame,
    value: str,
    flag: str | None = None,
    min_valid: float = 1.0,
    keep_raw: bool = True,
) -> DataFrame:
    """(raw - intercept) / slope where the slope is usable, the raw value elsewhere.

    Corrected and raw values below ``min_valid`` become null; the flag says that usable
    coefficients exist and the raw value survived that cut.
    """
    flag = flag or f"calibrated_{value}"
    coefs = settle(most_recent_fit(cal, value).select("monitor", "slope", "intercept"))
    usable = usable_slope("slope")
    corrected = F.when(usable, (F.col(value) - F.col("intercept")) / F.col("slope")).otherwise(
        F.col(value)
    )
    raw = null_below(value, min_valid)
    out = df.join(coefs, "monitor", "left").select(
        "monitor",
        "timestamp",
        "date",
        "hour",
        "source",
        (usable & raw.isNotNull()).alias(flag),
        raw.alias(f"{value}_raw"),
        null_below(corrected, min_valid).alias(value),
    )
    return out if keep_raw else out.drop(f"{value}_raw")


def replacement_counts(
    df: DataFrame, cal: DataFrame, value: str, min_valid: float = 1.0
) -> DataFrame:
    """How many corrected and raw values the minimum removes."""
    coefs = settle(most_recent_fit(cal, value).select("monitor", "slope", "intercept"))
    corrected = F.when(
        usable_slope("slope"), (F.col(value) - F.col("intercept")) / F.col("slope")
    ).otherwise(F.col(value))
    return df.join(coefs, "monitor", "left").agg(
        F.count_if(corrected < min_valid).alias("n_low_corrected"),
        F.count_if(F.col(value) < min_valid).alias("n_low_raw"),
    )


def with_reference_channels(
    df: DataFrame, monitor: str, gases: Sequence[str], time: str = "timestamp"
) -> DataFrame:
    """Add reference_<gas> columns: the readings of one monitor at the same time."""
    reference = df.where(F.col("monitor") == monitor).select(
        time, *[F.col(g).alias(f"reference_{g}") for g in gases]
    )
    return df.join(reference, time, "left")


def gas_regressions(
    df: DataFrame, gases: Sequence[str], min_points: int, min_r2: float | None
) -> DataFrame:
    """gas ~ reference_gas per monitor and gas, all in one grouping of the long form.

    Too few pairs null everything; too low an r2 nulls the coefficients but is reported.
    """
    pairs = df.select(
        "monitor",
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(g).alias("gas"),
                        F.col(g).cast("double").alias("y"),
                        F.col(f"reference_{g}").cast("double").alias("x"),
                    )
                    for g in gases
                ]
            )
        ).alias("p"),
    ).select("monitor", "p.*")
    y, x = F.col("y"), F.col("x")
    n = F.regr_count(y, x)
    fits = pairs.groupBy("monitor", "gas").agg(
        n.alias("_n"),
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("R2"),
    )
    enough = F.col("_n") >= min_points
    good = enough if min_r2 is None else enough & (F.col("R2") >= min_r2)
    return fits.select(
        "monitor",
        "gas",
        F.when(good, F.col("slope")).alias("slope"),
        F.when(good, F.col("intercept")).alias("intercept"),
        F.when(enough, F.col("R2")).alias("R2"),
    )


def apply_gas_calibration(df: DataFrame, coefs: DataFrame, gases: Sequence[str]) -> DataFrame:
    """Correct all gases; a missing coefficient makes the value null."""
    wide = settle(coefficients_wide(coefs, gases))
    return df.join(wide, "monitor", "left").select(
        "monitor",
        "timestamp",
        "date",
        "hour",
        *[inverse_linear(g, f"{g}_slope", f"{g}_intercept").alias(g) for g in gases],
        "source",
    )


def use_raw_for(df: DataFrame, value: str, corrected_roster: DataFrame, name: str) -> DataFrame:
    """Corrected values for the monitors of the roster, raw ones for all others."""
    known = corrected_roster.select("monitor", F.lit(True).alias("_listed")).distinct()
    chosen = F.when(F.col("_listed"), F.col(value)).otherwise(F.col(f"{value}_raw"))
    return df.join(settle(known), "monitor", "left").withColumn(name, chosen).drop("_listed")


def tag_fleet_phase(
    df: DataFrame, groups: DataFrame, original: Window, new: Window
) -> DataFrame:
    """Label rows by fleet (original / new / unknown) and phase (colocation / community / other).

    ``groups`` has (group, monitor) with groups 'original' and 'new'; original wins.
    """
    fleets = groups.groupBy("monitor").agg(
        F.when(F.max(F.col("group") == "original"), "original")
        .when(F.max(F.col("group") == "new"), "new")
        .alias("fleet")
    )
    day = F.col("date")

    def phases(chain, fleet: str, window: Window, label: str):
        mine = F.col("fleet") == fleet
        return chain.when(
            mine & day.between(F.lit(window.start), F.lit(window.end)), label
        ).when(mine & (day > F.lit(window.end)), "community")

    chain = phases(phases(F, "original", original, "w1_colocation"), "new", new, "w2_colocation")
    return (
        df.join(settle(fleets), "monitor", "left")
        .withColumn("fleet", F.coalesce("fleet", F.lit("unknown")))
        .withColumn("phase", chain.otherwise("other"))
    )
