"""Time columns. Timestamps stay ``timestamp_ntz``, so results do not depend on the session zone."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetfold.functions.columns import as_column


def moment(value: dt.date | dt.datetime) -> Column:
    """Literal of a wall-clock time (or midnight of a date), whatever the session zone."""
    return F.lit(value.isoformat()).cast("timestamp_ntz")


def truncate(ts: Column | str, unit: str) -> Column:
    """Start of the minute, hour, month (or Monday week) that holds ``ts``."""
    return F.date_trunc(unit, as_column(ts)).cast("timestamp_ntz")


def week_start(day: Column | str, first: str = "sunday") -> Column:
    """Date of the first day of the week; reports use Sunday, one of them Monday."""
    day = as_column(day)
    if first == "monday":
        return F.date_sub(day, F.weekday(day))
    return F.date_sub(day, F.dayofweek(day) - 1)


def month_start(day: Column | str) -> Column:
    return F.trunc(as_column(day), "month")


def calendar_parts(ts: Column | str) -> dict[str, Column]:
    """date, hour, day, month, year and weekday (Monday = 0)."""
    ts = as_column(ts)
    return {
        "date": F.to_date(ts),
        "hour": F.hour(ts),
        "day": F.dayofmonth(ts),
        "month": F.month(ts),
        "year": F.year(ts),
        "dow": F.weekday(ts),
    }


def date_hour(day: Column | str, hour: Column | str) -> Column:
    """Timestamp of an hour given its date and hour of day."""
    day = as_column(day)
    return F.make_timestamp_ntz(
        F.year(day), F.month(day), F.dayofmonth(day), as_column(hour), F.lit(0), F.lit(0)
    )


def shift_hours(ts: Column | str, hours: int) -> Column:
    """Local device clock to the clock of the table."""
    return as_column(ts) + F.make_interval(hours=F.lit(hours))


def dry_season_flag(month: Column | str) -> Column:
    """1 in December, January and February."""
    return F.when(as_column(month).isin(12, 1, 2), 1).otherwise(0)


def season_between(
    day: Column | str, start: dt.date, end: dt.date, inside: str, outside: str
) -> Column:
    """Season label by date range, both bounds inclusive; a null date is outside."""
    return F.when(as_column(day).between(F.lit(start), F.lit(end)), inside).otherwise(outside)


def cooking_period(hour: Column | str) -> Column:
    """Three classes of hours; 3 am is the control hour."""
    hour = as_column(hour)
    return (
        F.when(hour.between(15, 18), "Active Cooking Hours")
        .when(hour == 3, "Control Hour")
        .when(hour.isNotNull(), "Non-Active Cooking Hours")
    )


def cooking_period_detailed(hour: Column | str) -> Column:
    """Four classes of hours, mornings and evenings apart."""
    hour = as_column(hour)
    return (
        F.when(hour.between(16, 19), "Evening Cooking Hours")
        .when(hour.between(5, 8), "Morning Cooking Hours")
        .when(hour == 3, "Control Hour")
        .when(hour.isNotNull(), "Other Hours")
    )


def in_cook_time(hour: Column | str, start: int = 16, stop: int = 20) -> Column:
    hour = as_column(hour)
    return (hour >= start) & (hour < stop)


def hour_angle(hour: Column | str) -> tuple[Column, Column]:
    """Sine and cosine of the hour on a 24 h circle."""
    angle = as_column(hour) * (2 * F.pi() / 24)
    return F.sin(angle), F.cos(angle)


def days_since(last: Column | str, today: Column | dt.date) -> Column:
    today = F.lit(today) if isinstance(today, dt.date) else today
    return F.datediff(today, F.to_date(as_column(last)))
