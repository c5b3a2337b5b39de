"""How complete feeds, hours, days and weeks are."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetfold.functions.calendar import days_since, truncate, week_start
from fleetfold.functions.columns import as_column
from fleetfold.operators.merge import full_calendar, on_calendar
from fleetfold.operators.ordering import rank_by
from fleetfold.operators.reshape import to_long, to_wide


def enough(count: Column | str, minimum: int, strict: bool = False) -> Column:
    """1 where a count reaches (or, ``strict``, exceeds) the minimum, else 0."""
    count = as_column(count)
    return F.when(count > minimum if strict else count >= minimum, 1).otherwise(0)


def distinct_hours(hour: Column | str) -> Column:
    """Distinct hours of day in a group: a bit per hour, so one ordinary aggregate suffices."""
    bits = F.bit_or(F.when(as_column(hour).isNotNull(), F.expr("shiftleft(1, hour)")))
    return F.coalesce(F.bit_count(bits), F.lit(0))


# --- missing and available shares ---------------------------------------------------------------


def missing_rate(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Percentage of null rows and its complement per group, or overall."""
    missing = F.avg(F.col(value).isNull().cast("int")) * 100
    return (
        df.groupBy(*keys)
        .agg(missing.alias("missing_rate"))
        .withColumn("percent_complete", 100 - F.col("missing_rate"))
    )


def source_share(df: DataFrame, keys: Sequence[str] = ("monitor",)) -> DataFrame:
    """Rows by source as a share of all rows of the monitor, rows without a source counted in.

    The window works on the few counts of a monitor, not on its rows.
    """
    counts = df.groupBy(*keys, "source").agg(F.count(F.lit(1)).alias("count"))
    peers = Window.partitionBy(*keys)
    shares = counts.withColumn("full_count", F.sum("count").over(peers)).withColumn(
        "percentage", F.col("count") / F.col("full_count") * 100
    )
    return shares.where(F.col("source").isNotNull()).withColumn(
        "total_percentage", F.sum("percentage").over(peers)
    )


def order_by_coverage(shares: DataFrame, key: str = "monitor") -> DataFrame:
    """Order number of each monitor by its total share, largest first."""
    totals = shares.groupBy(key).agg(F.sum("percentage").alias("total"))
    return rank_by(totals, "total", "position")


def coverage_ratio(first: DataFrame, second: DataFrame, key: str = "monitor") -> DataFrame:
    """Coverage of one season divided by that of the other, for monitors present in both."""

    def total(shares: DataFrame, name: str) -> DataFrame:
        return shares.groupBy(key).agg(F.max("total_percentage").alias(name))

    joined = total(first, "first_coverage").join(total(second, "second_coverage"), key)
    return joined.withColumn("ratio", F.col("first_coverage") / F.col("second_coverage"))


def availability(df: DataFrame, channels: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Share of non-null rows of every channel per group, in long form."""
    shares = df.groupBy(*keys).agg(
        *[(F.count(c) / F.count(F.lit(1))).alias(c) for c in channels]
    )
    return to_long(shares, keys, channels, "pollutant", "availability")


def weekly_rate(df: DataFrame, channels: Sequence[str], minutes: int = 10080) -> DataFrame:
    """Non-null readings per monitor and week against the minutes of a week."""
    weekly = df.groupBy("monitor", week_start("date").alias("week")).agg(
        *[F.count(c).alias(f"complete_{c}") for c in channels]
    )
    return weekly.withColumns(
        {f"rate_{c}_complete": F.col(f"complete_{c}") / minutes for c in channels}
    )


# --- hours, days, weeks -------------------------------------------------------------------------


def hour_counts(
    df: DataFrame, ts: str = "timestamp", value: str | None = None, name: str = "obs_in_hour"
) -> DataFrame:
    counted = F.count(F.lit(1)) if value is None else F.count(value)
    return df.groupBy("monitor", truncate(ts, "hour").alias("date_hour")).agg(counted.alias(name))


def complete_days(
    hours: DataFrame,
    flag: str,
    min_hours: int = 18,
    strict: bool = True,
    keys: Sequence[str] = ("monitor",),
) -> DataFrame:
    """Complete hours of each day, and whether they are enough."""
    n = F.coalesce(F.sum(flag), F.lit(0))
    return (
        hours.groupBy(*keys, F.to_date("date_hour").alias("date"))
        .agg(n.alias("complete_hours"))
        .withColumn("day_complete", enough("complete_hours", min_hours, strict))
    )


def complete_weeks(
    days: DataFrame, first: str = "sunday", keys: Sequence[str] = ("monitor",)
) -> DataFrame:
    return days.groupBy(*keys, week_start("date", first).alias("week")).agg(
        F.sum("day_complete").alias("days_with_data")
    )


def both_feeds_by_hour(card: DataFrame, cloud: DataFrame) -> DataFrame:
    """Hour flags of the two feeds side by side; null where a feed has no such hour."""
    return card.select("monitor", "date_hour", "hour_complete_sd").join(
        cloud.select("monitor", "date_hour", "hour_complete_cloud"),
        ["monitor", "date_hour"],
        "full",
    )


def either_feed(hours: DataFrame) -> DataFrame:
    """1 if either feed completes the hour; null only if that cannot be told."""
    sd, cloud = F.col("hour_complete_sd") == 1, F.col("hour_complete_cloud") == 1
    known = (sd | cloud).isNotNull()
    return hours.withColumn(
        "hour_complete", F.when(known, F.when(sd | cloud, 1).otherwise(0))
    )


def complete_weeks_by_feed(
    hours: DataFrame, min_hours: int = 18, strict: bool = True, first: str = "sunday"
) -> DataFrame:
    """Complete days per week of each feed and of either feed, in one pass over joined hours."""
    flags = F.array(
        *[
            F.struct(F.lit(feed).alias("feed"), F.col(flag).alias("flag"), known.alias("known"))
            for feed, flag, known in (
                ("sd", "hour_complete_sd", F.col("hour_complete_sd").isNotNull()),
                ("cloud", "hour_complete_cloud", F.col("hour_complete_cloud").isNotNull()),
                ("either", "hour_complete", F.lit(True)),
            )
        ]
    )
    long = (
        either_feed(hours)
        .select("monitor", "date_hour", F.explode(flags).alias("f"))
        .where("f.known")
        .select("f.feed", "monitor", "date_hour", "f.flag")
    )
    keys = ("feed", "monitor")
    return complete_weeks(complete_days(long, "flag", min_hours, strict, keys), first, keys)


def feed_summary(hours: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """First and last hour, complete hours, days and percentages of each feed and of both.

    Days are collapsed first, so no distinct count is needed.
    """
    rows = hours.withColumn("date", F.to_date("date_hour")).where(
        F.col("date").between(F.lit(start), F.lit(end))
    )
    sd, cloud = F.col("hour_complete_sd"), F.col("hour_complete_cloud")
    per_day = rows.groupBy("monitor", "date").agg(
        F.min(F.when(sd.isNotNull(), F.col("date_hour"))).alias("sd_first"),
        F.max(F.when(sd.isNotNull(), F.col("date_hour"))).alias("sd_last"),
        F.sum(sd).alias("sd_hours"),
        F.min(F.when(cloud.isNotNull(), F.col("date_hour"))).alias("cloud_first"),
        F.max(F.when(cloud.isNotNull(), F.col("date_hour"))).alias("cloud_last"),
        F.sum(cloud).alias("cloud_hours"),
        F.sum(F.greatest(sd, cloud)).alias("any_hours"),
        F.max(F.greatest(sd, cloud)).alias("any_day"),
    )
    possible = (end - start).days * 24

    def percent(hours_column: str) -> Column:
        return F.bround(F.try_divide(F.col(hours_column), F.lit(possible)) * 100, 2)

    totals = per_day.groupBy("monitor").agg(
        F.min("sd_first").alias("sd_earliest_timestamp"),
        F.max("sd_last").alias("sd_latest_timestamp"),
        F.coalesce(F.sum("sd_hours"), F.lit(0)).alias("sd_total_hours_represented"),
        F.count("sd_first").alias("sd_total_days_represented"),
        F.min("cloud_first").alias("cloud_earliest_timestamp"),
        F.max("cloud_last").alias("cloud_latest_timestamp"),
        F.coalesce(F.sum("cloud_hours"), F.lit(0)).alias("cloud_total_hours_represented"),
        F.count("cloud_first").alias("cloud_total_days_represented"),
        F.coalesce(F.sum("any_hours"), F.lit(0)).alias("combined_total_hours_represented"),
        F.count_if(F.col("any_day") == 1).alias("combined_total_days_represented"),
    )
    feeds = ("sd", "cloud", "combined")
    shares = totals.withColumns(
        {f"{f}_percent_data_available": percent(f"{f}_total_hours_represented") for f in feeds}
    )
    return shares.withColumns(
        {
            f"{f}_percent_missing_data": F.bround(100 - F.col(f"{f}_percent_data_available"), 2)
            for f in feeds
        }
    )


def hours_on_calendar(
    df: DataFrame, value: str, start: Column, end: Column, min_minutes: int = 45,
    ts: str = "timestamp",
) -> DataFrame:
    """Minutes with a value in every hour of the calendar of every monitor, and the hour flag."""
    counts = hour_counts(df, ts, value, "minutes_in_hour")
    calendar = full_calendar(counts, "date_hour", start, end, "1 hour")
    filled = on_calendar(counts, calendar, ["monitor", "date_hour"], {"minutes_in_hour": 0})
    return filled.withColumns(
        {
            "hour": F.hour("date_hour"),
            "hour_complete": enough("minutes_in_hour", min_minutes),
        }
    )


def by_hour_of_day(hours: DataFrame) -> DataFrame:
    return hours.groupBy("monitor", "hour").agg(
        F.count(F.lit(1)).alias("n_possible"),
        F.sum("hour_complete").alias("n_complete"),
        F.avg("hour_complete").alias("p_complete"),
    )


def fleet_by_hour_of_day(per_monitor: DataFrame) -> DataFrame:
    return per_monitor.groupBy("hour").agg(F.avg("p_complete").alias("fleet_complete"))


def zero_week_ranking(weeks: DataFrame) -> DataFrame:
    """Weeks without any complete day per monitor, and the order number by that count."""
    zeros = weeks.groupBy("monitor").agg(
        F.count_if(F.col("days_with_data") == 0).alias("zero_weeks")
    )
    return rank_by(zeros, "zero_weeks", "position")


def missing_hours_per_day(df: DataFrame, value: str, max_missing: int = 30) -> DataFrame:
    """Hours of each monitor day in which more than ``max_missing`` minutes are null."""
    hours = df.groupBy("monitor", "date", "hour").agg(
        F.count_if(F.col(value).isNull()).alias("no_data")
    )
    return hours.groupBy("monitor", "date").agg(
        F.count_if(F.col("no_data") > max_missing).alias("hours_missing_day")
    )


def missing_hours_wide(df: DataFrame, value: str, days: Sequence[dt.date], max_missing: int = 30):
    daily = missing_hours_per_day(df, value, max_missing)
    return to_wide(
        daily.withColumn("date", F.col("date").cast("string")),
        ["monitor"],
        "date",
        "hours_missing_day",
        [d.isoformat() for d in days],
    )


def daily_source_status(card_days: DataFrame, cloud_days: DataFrame) -> DataFrame:
    """Which feed covers each day of the common calendar: both, sd_only, cloud_only or none.

    ``card_days`` lists (monitor, date) with a file, ``cloud_days`` has day_complete.
    """
    card = card_days.select("monitor", "date").distinct().withColumn("_sd", F.lit(True))
    cloud = cloud_days.select("monitor", "date", (F.col("day_complete") == 1).alias("_cloud"))
    known = card.select("monitor", "date").union(cloud.select("monitor", "date"))
    span = known.agg(F.min("date").alias("a"), F.max("date").alias("b"))
    calendar = full_calendar(
        known,
        "date",
        span.select("a").scalar(),
        span.select("b").scalar(),
        "1 day",
    )
    joined = calendar.join(card, ["monitor", "date"], "left").join(
        cloud, ["monitor", "date"], "left"
    )
    sd, net = F.coalesce("_sd", F.lit(False)), F.coalesce("_cloud", F.lit(False))
    return joined.select(
        "monitor",
        "date",
        sd.alias("sd_complete"),
        net.alias("cloud_complete"),
        F.when(sd & net, "both")
        .when(sd, "sd_only")
        .when(net, "cloud_only")
        .otherwise("none")
        .alias("source_status"),
    )


def weekly_source_status(daily: DataFrame) -> DataFrame:
    status = F.col("source_status")
    return daily.groupBy("monitor", week_start("date", "monday").alias("week")).agg(
        F.count_if(status != "none").alias("days_any"),
        F.count_if(status == "sd_only").alias("days_sd_only"),
        F.count_if(status == "cloud_only").alias("days_cloud_only"),
        F.count_if(status == "both").alias("days_both"),
    )


def files_per_week(inventory: DataFrame) -> DataFrame:
    return inventory.groupBy("monitor", week_start("date").alias("week")).agg(
        F.count(F.lit(1)).alias("days_with_data")
    )


def daily_hour_share(df: DataFrame, value: str) -> DataFrame:
    """Distinct hours with a value of each monitor day, and their share of 24."""
    return (
        df.where(F.col(value).isNotNull())
        .groupBy("monitor", "date")
        .agg(distinct_hours("hour").alias("n_hours"))
        .withColumn("pct_complete", F.col("n_hours") / 24)
    )


def last_readings(df: DataFrame, value: str, today: dt.date) -> DataFrame:
    latest = df.where(F.col(value).isNotNull()).groupBy("monitor").agg(
        F.max("timestamp").alias("recent_reading")
    )
    return latest.withColumns(
        {
            "reading_date": F.to_date("recent_reading"),
            "time_since_reading": days_since("recent_reading", today),
        }
    )


def duplicate_count(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows beyond the first of each key."""
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicates"))


def share_of_span(days: DataFrame, span_days: int = 185) -> DataFrame:
    """Complete days of a monitor as a percentage of a fixed span."""
    return (
        days.groupBy("monitor")
        .agg(F.sum("day_complete").alias("days_complete"))
        .withColumn("percent_complete", F.bround(F.col("days_complete") / span_days * 100, 1))
    )


def offline_filter(summary: DataFrame, value: str, by: Sequence[str], max_offline: int) -> DataFrame:
    """Rows with a value from hours or days in which fewer than ``max_offline`` monitors are off.

    A summary has a monitor once per hour, so the window sees one fleet at a time.
    """
    off = F.count_if(F.col(value).isNull()).over(Window.partitionBy(*by))
    return summary.withColumn("offline_monitors", off).where(
        (F.col("offline_monitors") < max_offline) & F.col(value).isNotNull()
    )
