"""Minutes to hours to days under completeness rules, with guarded fleet averages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetfold.config import RollupRules
from fleetfold.functions.calendar import truncate
from fleetfold.functions.columns import guarded_ratio, within


def mean_if(value: str, count: Column, minimum: int) -> Column:
    return F.when(count >= minimum, F.avg(value))


def hourly_means(
    df: DataFrame,
    value: str,
    min_minutes: int = 45,
    keys: Sequence[str] = ("monitor",),
    calibrated: str | None = None,
) -> DataFrame:
    """Non-null minutes and mean of each monitor hour; too few minutes give a null mean.

    Calendar columns come from the timestamp. Duplicate minutes count as often as they occur.
    With ``calibrated``, only rows whose flag is true take part.
    """
    rows = df if calibrated is None else df.where(F.col(calibrated))
    n = F.count(value)
    return rows.groupBy(
        *keys, F.to_date("timestamp").alias("date"), F.hour("timestamp").alias("hour")
    ).agg(n.alias("n_minute_obs"), mean_if(value, n, min_minutes).alias(f"mean_{value}"))


def daily_means(
    hourly: DataFrame, value: str, min_hours: int = 18, keys: Sequence[str] = ("monitor",)
) -> DataFrame:
    """Mean of the hourly means of each monitor day with enough complete hours."""
    mean = f"mean_{value}"
    n = F.count(mean)
    return hourly.groupBy(*keys, "date").agg(
        n.alias("n_complete_hours"), mean_if(mean, n, min_hours).alias(mean)
    )


def fleet_means(
    summary: DataFrame, value: str, by: Sequence[str], min_active: int | None = 10
) -> DataFrame:
    """Average over the monitors of each hour or day; ``min_active=None`` applies no guard."""
    mean, fleet = f"mean_{value}", f"fleet_average_{value}"
    if min_active is None:
        return summary.groupBy(*by).agg(F.avg(mean).alias(fleet))
    n = F.count(mean)
    return summary.groupBy(*by).agg(
        n.alias("n_active"), mean_if(mean, n, min_active).alias(fleet)
    )


def with_fleet_means(
    summary: DataFrame, value: str, by: Sequence[str], min_active: int | None = 10
) -> DataFrame:
    """``fleet_means`` on the rows they were made from.

    A summary holds a monitor once per hour or day, so a window over ``by`` sees a fleet-sized
    group and saves the join back.
    """
    mean, fleet = f"mean_{value}", f"fleet_average_{value}"
    peers = Window.partitionBy(*by)
    average = F.avg(mean).over(peers)
    if min_active is None:
        return summary.withColumn(fleet, average)
    n = F.count(mean).over(peers)
    return summary.withColumn("n_active", n).withColumn(
        fleet, F.when(F.col("n_active") >= min_active, average)
    )


def summarize(
    df: DataFrame,
    value: str,
    rules: RollupRules = RollupRules(),
    keys: Sequence[str] = (),
    calibrated: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Hourly and daily summaries with fleet averages; ``keys`` are further groups, e.g. pollutant."""
    who = (*keys, "monitor")
    hourly = hourly_means(df, value, rules.min_minutes_per_hour, who, calibrated)
    daily = daily_means(hourly, value, rules.min_hours_per_day, who)
    return (
        with_fleet_means(hourly, value, (*keys, "date", "hour"), rules.min_active_monitors),
        with_fleet_means(daily, value, (*keys, "date"), rules.min_active_monitors),
    )


def strict_hourly_reference(
    df: DataFrame, channels: Sequence[str], ts: str = "time", status: str | None = "status"
) -> DataFrame:
    """Hourly means of a beta-attenuation instrument.

    Only rows in good state count; one null in the hour nulls its mean, and hours with
    implausible PM2.5 are dropped.
    """
    rows = df if status is None else df.where(F.col(status) == "00000")
    every = F.count(F.lit(1))
    hourly = rows.groupBy(truncate(ts, "hour").alias("date_hour")).agg(
        *[F.when(F.count(c) == every, F.avg(c)).alias(f"mean_{c}") for c in channels]
    )
    return hourly.where(within("mean_pm25", 0.0, 500.0, False, False))


def reference_hours(
    df: DataFrame,
    channels: dict[str, str],
    valid: Sequence[str],
    ts: str = "datetime",
    min_rows: int = 45,
) -> DataFrame:
    """Hourly means of the optical reference instrument; enough *valid* rows are required.

    ``channels`` maps input to output names; a row is valid if any of ``valid`` is not null.
    """
    hour = truncate(ts, "hour")
    good = F.count_if(F.coalesce(*valid).isNotNull())
    return (
        df.groupBy(hour.alias("date_hour"), F.to_date(ts).alias("date"))
        .agg(good.alias("_valid"), *[F.avg(c).alias(n) for c, n in channels.items()])
        .where(F.col("_valid") >= min_rows)
        .drop("_valid")
    )


def reference_days(
    hours: DataFrame, channels: Sequence[str], valid: Sequence[str], min_hours: int = 18
) -> DataFrame:
    good = F.count_if(F.coalesce(*valid).isNotNull())
    return (
        hours.groupBy("date")
        .agg(good.alias("_valid"), *[F.avg(c).alias(c) for c in channels])
        .where(F.col("_valid") >= min_hours)
        .drop("_valid")
    )


def daily_two_ways(
    df: DataFrame, raw: str, adjusted: str, label: str = "gmr", min_hours: int = 18
) -> DataFrame:
    """Daily means of raw and calibrated hours, each under its own hour count, and their change."""
    n_raw, n_adjusted = F.count(raw), F.count(adjusted)
    raw_mean, adjusted_mean = f"mean_{raw}", f"mean_{adjusted}"
    daily = df.groupBy("monitor", "date").agg(
        n_raw.alias("n_complete_hours_raw"),
        mean_if(raw, n_raw, min_hours).alias(raw_mean),
        n_adjusted.alias(f"n_complete_hours_{label}"),
        mean_if(adjusted, n_adjusted, min_hours).alias(adjusted_mean),
    )
    return daily.withColumns(
        {
            f"delta_daily_{label}": F.col(adjusted_mean) - F.col(raw_mean),
            f"ratio_daily_{label}": guarded_ratio(adjusted_mean, raw_mean),
        }
    )


def daily_filled(
    df: DataFrame, filled: str, imputed: str, value: str, min_hours: int = 18
) -> DataFrame:
    """Days of a gap-filled series with enough hours, and how much of them is imputed."""
    hours, made = f"n_hours_{value}", "n_imputed_hours"
    return (
        df.groupBy("monitor", "date")
        .agg(
            F.count(filled).alias(hours),
            F.avg(filled).alias(f"daily_mean_{value}"),
            F.count_if(imputed).alias(made),
        )
        .where(F.col(hours) >= min_hours)
        .withColumns(
            {
                "pct_hours_present": F.col(hours) / 24,
                "pct_hours_imputed": F.col(made) / F.col(hours),
            }
        )
    )
