"""Roll-ups, completeness, trends and error summaries."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetfold.catalog import fixtures as fx
from fleetfold.catalog.joins import GAS_FIT_SQL, GAS_MIN_R2, gas_fits
from fleetfold.catalog.registry import query
from fleetfold.catalog.scalars import COOKING_SQL, EXTRAPOLATION_SQL, flagged
from fleetfold.catalog.sources import external_wind, optical_files
from fleetfold.config import RollupRules
from fleetfold.functions.calendar import cooking_period, moment
from fleetfold.operators import (
    calibrate,
    completeness,
    impute,
    merge,
    rollup,
    spatial,
    stats,
    trends,
)
from fleetfold.operators.reshape import mean_of_numeric
from fleetfold.sources.logs import optical_readings

RULES = RollupRules(2, 18, 3)


def rounded(df, *columns, digits=9):
    return df.select(
        *[F.round(c, digits).alias(c) if c in columns else F.col(c) for c in df.columns]
    )


@query(
    "a01_hourly_completeness",
    """SELECT monitor, date, hour, n_minute_obs, round(mean_pm25, 9) AS mean_pm25, n_active,
              round(fleet_average_pm25, 9) AS fleet_average_pm25 FROM hourly""",
)
def a01(spark, sf):
    hourly, _ = rollup.summarize(fx.readings(spark, sf), "pm25", RULES)
    return rounded(hourly, "mean_pm25", "fleet_average_pm25")


@query(
    "a01_hourly_calibrated_only",
    """SELECT monitor, date, hour, count(pm25) AS n_minute_obs,
              round(CASE WHEN count(pm25) >= 2 THEN avg(pm25) END, 9) AS mean_pm25
       FROM readings WHERE event_id % 4 <> 0 GROUP BY 1, 2, 3""",
)
def a01_calibrated(spark, sf):
    df = fx.readings(spark, sf).withColumn("calibrated_pm25", F.col("event_id") % 4 != 0)
    return rounded(
        rollup.hourly_means(df, "pm25", 2, calibrated="calibrated_pm25"), "mean_pm25"
    )


@query(
    "a01_hourly_all_pollutants",
    """SELECT pollutant, monitor, date, hour, count(value) AS n_minute_obs,
              round(CASE WHEN count(value) >= 2 THEN avg(value) END, 9) AS mean_value
       FROM (SELECT monitor, date, hour, 'pm1' AS pollutant, pm1 AS value FROM readings
             UNION ALL SELECT monitor, date, hour, 'pm25', pm25 FROM readings
             UNION ALL SELECT monitor, date, hour, 'pm10', pm10 FROM readings WHERE pm10 <= 1500)
       GROUP BY 1, 2, 3, 4""",
)
def a01_long(spark, sf):
    from fleetfold.sources.tables import cloud_channels

    long = cloud_channels(fx.readings(spark, sf), ["pm1", "pm25", "pm10"])
    return rounded(
        rollup.hourly_means(long, "value", 2, ("pollutant", "monitor")), "mean_value"
    )


@query(
    "a02_daily_of_hourly",
    """SELECT monitor, date, n_complete_hours, round(mean_pm25, 9) AS mean_pm25, n_active,
              round(fleet_average_pm25, 9) AS fleet_average_pm25 FROM daily""",
)
def a02(spark, sf):
    _, daily = rollup.summarize(fx.readings(spark, sf), "pm25", RULES)
    return rounded(daily, "mean_pm25", "fleet_average_pm25")


@query(
    "a03_fleet_hourly",
    """SELECT date, hour, count(mean_pm25) AS n_active,
              round(CASE WHEN count(mean_pm25) >= 3 THEN avg(mean_pm25) END, 9)
                AS fleet_average_pm25 FROM hourly GROUP BY 1, 2""",
)
def a03(spark, sf):
    hours = rollup.hourly_means(fx.readings(spark, sf), "pm25", 2)
    return rounded(
        rollup.fleet_means(hours, "pm25", ["date", "hour"], 3), "fleet_average_pm25"
    )


@query(
    "a04_fleet_daily",
    """SELECT date, count(mean_pm25) AS n_active,
              round(CASE WHEN count(mean_pm25) >= 3 THEN avg(mean_pm25) END, 9)
                AS fleet_average_pm25 FROM daily GROUP BY 1""",
)
def a04(spark, sf):
    hours = rollup.hourly_means(fx.readings(spark, sf), "pm25", 2)
    days = rollup.daily_means(hours, "pm25", 18)
    return rounded(rollup.fleet_means(days, "pm25", ["date"], 3), "fleet_average_pm25")


@query(
    "a05_fleet_average_by_time",
    """SELECT timestamp, count(pm25) AS n_active, round(avg(pm25), 9) AS fleet_avg FROM coloc
       WHERE monitor IN (SELECT monitor FROM groups WHERE "group" = 'original')
       GROUP BY 1 HAVING count(pm25) >= 3""",
)
def a05(spark, sf):
    return rounded(
        calibrate.fleet_average(fx.coloc(spark, sf), "pm25", 3, fx.roster(spark, sf)), "fleet_avg"
    )


@query(
    "a06_unguarded_fleet_average",
    """SELECT monitor, date, hour, round(mean_pm25, 9) AS mean_pm25,
              round(avg(mean_pm25) OVER (PARTITION BY date, hour), 9) AS fleet_average_pm25
       FROM hourly""",
)
def a06(spark, sf):
    hours = fx.hourly(spark, sf).select("monitor", "date", "hour", "mean_pm25")
    return rounded(
        rollup.with_fleet_means(hours, "pm25", ["date", "hour"], None),
        "mean_pm25", "fleet_average_pm25",
    )


@query(
    "a07_least_squares_by_monitor",
    """SELECT monitor, count(*) AS n_points, round(regr_slope(y, x), 8) AS slope,
              round(regr_intercept(y, x), 8) AS intercept, round(regr_r2(y, x), 8) AS r2,
              round(sqrt((regr_syy(y, x) - pow(regr_sxy(y, x), 2) / regr_sxx(y, x)) / count(*)), 8)
                AS rmse
       FROM (SELECT monitor, mean_pm25 AS y, fleet_average_pm25 AS x FROM hourly)
       WHERE y IS NOT NULL AND x IS NOT NULL GROUP BY 1""",
)
def a07(spark, sf):
    fits = calibrate.least_squares(fx.hourly(spark, sf), "mean_pm25", "fleet_average_pm25")
    return rounded(fits, "slope", "intercept", "r2", "rmse", digits=8)


@query(
    "a07_feed_against_feed",
    """SELECT c.monitor, CAST(regr_count(s.pm25, c.pm25) AS BIGINT) AS n_points,
              round(regr_slope(s.pm25, c.pm25), 6) AS slope, round(regr_r2(s.pm25, c.pm25), 6) AS r2
       FROM cloud c JOIN card s ON c.monitor = s.monitor AND c.timestamp = s.timestamp_iso
       GROUP BY 1""",
)
def a07_feeds(spark, sf):
    cloud = fx.cloud(spark, sf).select("monitor", "timestamp", F.col("pm25").alias("x"))
    card = fx.card(spark, sf).select(
        "monitor", F.col("timestamp_iso").alias("timestamp"), F.col("pm25").alias("y")
    )
    fits = calibrate.least_squares(cloud.join(card, ["monitor", "timestamp"]), "y", "x")
    return rounded(fits, "slope", "r2", digits=6).select("monitor", "n_points", "slope", "r2")


@query(
    "a08_regression_table",
    """SELECT f.monitor, count(*) AS "N", round_even(any_value(slope), 2) AS slope,
              round_even(any_value(intercept), 2) AS intercept,
              round_even(sqrt(avg(pow(y - slope * x - intercept, 2))), 2) AS "RMSE",
              round_even(avg(abs(y - slope * x - intercept)), 2) AS "AME"
       FROM (SELECT monitor, mean_pm25 AS y, fleet_average_pm25 AS x FROM hourly
             WHERE mean_pm25 IS NOT NULL AND fleet_average_pm25 IS NOT NULL) d
       JOIN (SELECT monitor, regr_slope(mean_pm25, fleet_average_pm25) AS slope,
                    regr_intercept(mean_pm25, fleet_average_pm25) AS intercept
             FROM hourly GROUP BY 1) f ON d.monitor = f.monitor GROUP BY 1""",
)
def a08(spark, sf):
    return calibrate.regression_table(
        fx.hourly(spark, sf), "mean_pm25", "fleet_average_pm25"
    )


@query(
    "a08_gas_regressions_against_reference",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS gas, g.monitor, count(*) AS "N",
              CASE WHEN count(*) > 1 THEN round_even(regr_slope(g.{c}, r.{c}), 2) END AS slope,
              CASE WHEN count(*) > 1 THEN round_even(regr_intercept(g.{c}, r.{c}), 2) END
                AS intercept
            FROM gas_hours g
            JOIN gas_hours r ON g.timestamp = r.timestamp AND r.monitor = 'MOD-00000'
            WHERE g.{c} IS NOT NULL AND r.{c} IS NOT NULL GROUP BY g.monitor"""
        for c in fx.GASES
    ),
)
def a08_gas(spark, sf):
    paired = calibrate.with_reference_channels(fx.gas_hours(spark, sf), fx.REFERENCE, fx.GASES)
    gases = [
        F.struct(F.lit(g).alias("gas"), F.col(g).alias("y"), F.col(f"reference_{g}").alias("x"))
        for g in fx.GASES
    ]
    long = paired.select("monitor", F.explode(F.array(*gases)).alias("p")).select("monitor", "p.*")
    return calibrate.regression_table(long, "y", "x", ["gas", "monitor"]).select(
        "gas", "monitor", "N", "slope", "intercept"
    )


@query(
    "a09_gas_regressions",
    f"""SELECT monitor, gas, round(slope, 8) AS slope, round(intercept, 8) AS intercept,
               round("R2", 8) AS "R2" FROM ({GAS_FIT_SQL.format(r2=GAS_MIN_R2)})""",
)
def a09(spark, sf):
    return rounded(gas_fits(spark, sf), "slope", "intercept", "R2", digits=8)


OPTICAL_HOURS_SQL = """
    SELECT date_trunc('hour', ts) AS date_hour, CAST(ts AS DATE) AS date, avg(value) AS ref_pm25,
           avg(value * 2) AS ref_pm10 FROM events GROUP BY 1, 2 HAVING count(*) >= 10"""


@query(
    "a10_reference_days",
    f"""SELECT date, round(avg(ref_pm25), 9) AS ref_pm25, round(avg(ref_pm10), 9) AS ref_pm10
        FROM ({OPTICAL_HOURS_SQL}) GROUP BY 1 HAVING count(*) >= 18""",
)
def a10(spark, sf):
    channels = {"pm25": "ref_pm25", "pm10": "ref_pm10"}
    hours = rollup.reference_hours(
        optical_readings(optical_files(spark, sf)), channels, ["pm25", "temp_c"], min_rows=10
    )
    days = rollup.reference_days(hours, list(channels.values()), ["ref_pm25"], 18)
    return rounded(days, "ref_pm25", "ref_pm10")


@query(
    "a11_attenuation_hourly",
    """SELECT date_hour, round(mean_pm25, 9) AS mean_pm25 FROM (
         SELECT date_trunc('hour', timestamp) AS date_hour,
                CASE WHEN count(*) = count(pm25) THEN avg(pm25) END AS mean_pm25
         FROM readings WHERE event_type IN ('click', 'view') GROUP BY 1)
       WHERE mean_pm25 > 0 AND mean_pm25 < 500""",
)
def a11(spark, sf):
    df = fx.readings(spark, sf).withColumn(
        "status", F.when(F.col("event_type").isin("click", "view"), "00000").otherwise("00001")
    )
    return rounded(rollup.strict_hourly_reference(df, ["pm25"], "timestamp"), "mean_pm25")


@query(
    "a12_modal_location",
    """SELECT monitor, geo_lat, geo_lon, n FROM (
         SELECT monitor, met_rh AS geo_lat, wd AS geo_lon, count(*) AS n FROM readings
         GROUP BY 1, 2, 3)
       QUALIFY row_number() OVER (PARTITION BY monitor ORDER BY n DESC, geo_lat, geo_lon) = 1""",
)
def a12(spark, sf):
    return spatial.modal_location(
        fx.readings(spark, sf).withColumnsRenamed({"met_rh": "geo_lat", "wd": "geo_lon"})
    )


@query(
    "a13_population_by_village",
    """SELECT upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS village,
              count(*) AS households, CAST(sum(c_nationkey) AS BIGINT) AS population
       FROM customer GROUP BY 1""",
)
def a13(spark, sf):
    from fleetfold.sources.tables import village_population

    sheet = fx.table(spark, sf, "customer").select(
        F.col("c_mktsegment").alias("village"), F.lit(1).alias("households"),
        F.col("c_nationkey").alias("population"),
    )
    return village_population(sheet, {})


MISSING = {
    "overall": [],
    "by_monitor": ["monitor"],
    "by_date": ["date"],
    "by_hour": ["hour"],
    "by_hour_monitor": ["hour", "monitor"],
    "by_monitor_date": ["monitor", "date"],
}


def _missing(keys):
    def run(spark, sf):
        return rounded(
            completeness.missing_rate(fx.readings(spark, sf), "pm25", keys),
            "missing_rate", "percent_complete",
        )

    return run


for _name, _keys in MISSING.items():
    _columns = "".join(f"{k}, " for k in _keys)
    _rate = "100.0::DOUBLE * count(*) FILTER (pm25 IS NULL) / count(*)"
    query(
        f"a14_missing_rate_{_name}",
        f"""SELECT {_columns} round({_rate}, 9) AS missing_rate,
                   round(100 - {_rate}, 9) AS percent_complete
            FROM readings {"GROUP BY " + _columns.rstrip(", ") if _keys else ""}""",
    )(_missing(_keys))


@query(
    "a15_source_share",
    """SELECT monitor, source, n AS count, CAST(full_n AS BIGINT) AS full_count,
              round(100.0::DOUBLE * n / full_n, 9) AS percentage,
              round(sum(100.0::DOUBLE * n / full_n) OVER (PARTITION BY monitor), 9)
                AS total_percentage
       FROM (SELECT monitor, source, count(*) AS n,
                    sum(count(*)) OVER (PARTITION BY monitor) AS full_n FROM merged GROUP BY 1, 2)
       WHERE source IS NOT NULL""",
)
def a15(spark, sf):
    return rounded(
        completeness.source_share(fx.merged(spark, sf)), "percentage", "total_percentage"
    )


PERIODS = {
    "month": ("CAST(date_trunc('month', date) AS DATE)", lambda: F.trunc("date", "month")),
    "week": (
        "CAST(date - CAST(extract(dow FROM date) AS INTEGER) AS DATE)",
        lambda: F.date_sub("date", F.dayofweek("date") - 1),
    ),
}


def _availability(period, keys):
    def run(spark, sf):
        df = fx.readings(spark, sf).withColumn("period", PERIODS[period][1]())
        return rounded(
            completeness.availability(df, ["pm1", "pm25", "pm10"], [*keys, "period"]),
            "availability",
        )

    return run


for _period in PERIODS:
    for _keys in ([], ["monitor"]):
        _columns = "".join(f"{k}, " for k in _keys)
        query(
            f"a16_availability_{'monitor_' if _keys else ''}{_period}",
            " UNION ALL ".join(
                f"""SELECT {_columns} {PERIODS[_period][0]} AS period, '{c}' AS pollutant,
                           round(count({c}) / CAST(count(*) AS DOUBLE), 9) AS availability
                    FROM readings GROUP BY ALL"""
                for c in ("pm1", "pm25", "pm10")
            ),
        )(_availability(_period, _keys))


@query(
    "a17_weekly_wind_completeness",
    """SELECT monitor, CAST(date - CAST(extract(dow FROM date) AS INTEGER) AS DATE) AS week,
              count(ws) AS complete_ws, count(wd) FILTER (wd <= 360) AS complete_wd,
              round(count(ws) / 10080.0::DOUBLE, 9) AS rate_ws_complete,
              round(count(wd) FILTER (wd <= 360) / 10080.0::DOUBLE, 9) AS rate_wd_complete
       FROM readings GROUP BY 1, 2""",
)
def a17(spark, sf):
    df = fx.readings(spark, sf).withColumn("wd", F.when(F.col("wd") <= 360, F.col("wd")))
    return rounded(
        completeness.weekly_rate(df, ["ws", "wd"]), "rate_ws_complete", "rate_wd_complete"
    )


FEED_HOURS_SQL = """
    SELECT coalesce(s.monitor, c.monitor) AS monitor, coalesce(s.h, c.h) AS date_hour,
           CASE WHEN s.n > 1 THEN 1 WHEN s.n IS NOT NULL THEN 0 END AS hour_complete_sd,
           CASE WHEN c.n >= 2 THEN 1 WHEN c.n IS NOT NULL THEN 0 END AS hour_complete_cloud
    FROM (SELECT monitor, date_trunc('hour', timestamp_iso) AS h, count(*) AS n FROM card
          GROUP BY 1, 2) s
    FULL JOIN (SELECT monitor, date_trunc('hour', timestamp) AS h, count(*) AS n FROM cloud
               WHERE pm25 IS NOT NULL GROUP BY 1, 2) c
      ON s.monitor = c.monitor AND s.h = c.h"""


def feed_hours(spark, sf):
    card = completeness.hour_counts(fx.card(spark, sf), "timestamp_iso").withColumn(
        "hour_complete_sd", completeness.enough("obs_in_hour", 1, True)
    )
    cloud = completeness.hour_counts(
        fx.cloud(spark, sf).where("pm25 IS NOT NULL")
    ).withColumn("hour_complete_cloud", completeness.enough("obs_in_hour", 2))
    return completeness.both_feeds_by_hour(card, cloud)


WEEKS_SQL = f"""
    SELECT monitor, CAST(date - CAST(extract(dow FROM date) AS INTEGER) AS DATE) AS week,
           sum(CASE WHEN hours > 6 THEN 1 ELSE 0 END) AS days_with_data
    FROM (SELECT monitor, CAST(date_hour AS DATE) AS date, sum({{flag}}) AS hours
          FROM ({FEED_HOURS_SQL}) WHERE {{where}} GROUP BY 1, 2) GROUP BY 1, 2"""
EITHER_SQL = """CASE WHEN hour_complete_sd = 1 OR hour_complete_cloud = 1 THEN 1
    WHEN hour_complete_sd IS NULL OR hour_complete_cloud IS NULL THEN NULL ELSE 0 END"""


@query(
    "a18_weekly_calendar_by_feed",
    " UNION ALL ".join(
        f"""SELECT '{feed}' AS feed, m.monitor, g.week,
                   CAST(coalesce(days_with_data, 0) AS BIGINT) AS days_with_data
            FROM (SELECT DISTINCT monitor FROM readings) m,
                 (SELECT CAST(unnest(generate_series(TIMESTAMP '2023-12-24', TIMESTAMP '2024-02-04',
                    INTERVAL 7 DAY)) AS DATE) AS week) g
            LEFT JOIN ({WEEKS_SQL.format(flag=flag, where=where)}) w
              ON w.monitor = m.monitor AND w.week = g.week"""
        for feed, flag, where in (
            ("sd", "hour_complete_sd", "hour_complete_sd IS NOT NULL"),
            ("cloud", "hour_complete_cloud", "hour_complete_cloud IS NOT NULL"),
            ("either", EITHER_SQL, "TRUE"),
        )
    ),
)
def a18(spark, sf):
    weeks = completeness.complete_weeks_by_feed(feed_hours(spark, sf), 6, True)
    feeds = F.explode(F.array(*[F.lit(f) for f in ("sd", "cloud", "either")]))
    calendar = merge.full_calendar(
        fx.readings(spark, sf), "week", F.lit(dt.date(2023, 12, 24)), F.lit(dt.date(2024, 2, 4)),
        "7 days",
    ).select("monitor", "week", feeds.alias("feed"))
    return merge.on_calendar(
        weeks, calendar, ["feed", "monitor", "week"], {"days_with_data": 0}
    )


_POSSIBLE = "(27 * 24)"


@query(
    "a19_feed_summary",
    f"""SELECT monitor, min(CASE WHEN hour_complete_sd IS NOT NULL THEN date_hour END)
               AS sd_earliest_timestamp,
             max(CASE WHEN hour_complete_sd IS NOT NULL THEN date_hour END) AS sd_latest_timestamp,
             CAST(coalesce(sum(hour_complete_sd), 0) AS BIGINT) AS sd_total_hours_represented,
             count(DISTINCT CASE WHEN hour_complete_sd IS NOT NULL THEN CAST(date_hour AS DATE) END)
               AS sd_total_days_represented,
             min(CASE WHEN hour_complete_cloud IS NOT NULL THEN date_hour END)
               AS cloud_earliest_timestamp,
             max(CASE WHEN hour_complete_cloud IS NOT NULL THEN date_hour END)
               AS cloud_latest_timestamp,
             CAST(coalesce(sum(hour_complete_cloud), 0) AS BIGINT) AS cloud_total_hours_represented,
             count(DISTINCT CASE WHEN hour_complete_cloud IS NOT NULL
                            THEN CAST(date_hour AS DATE) END) AS cloud_total_days_represented,
             CAST(sum(greatest(hour_complete_sd, hour_complete_cloud)) AS BIGINT)
               AS combined_total_hours_represented,
             count(DISTINCT CASE WHEN hour_complete_sd = 1 OR hour_complete_cloud = 1
                            THEN CAST(date_hour AS DATE) END) AS combined_total_days_represented,
             round_even(sum(hour_complete_sd) / {_POSSIBLE}::DOUBLE * 100, 2)
               AS sd_percent_data_available,
             round_even(sum(hour_complete_cloud) / {_POSSIBLE}::DOUBLE * 100, 2)
               AS cloud_percent_data_available,
             round_even(sum(greatest(hour_complete_sd, hour_complete_cloud)) / {_POSSIBLE}::DOUBLE
               * 100, 2) AS combined_percent_data_available,
             round_even(100 - round_even(sum(hour_complete_sd) / {_POSSIBLE}::DOUBLE * 100, 2), 2)
               AS sd_percent_missing_data,
             round_even(100 - round_even(sum(hour_complete_cloud) / {_POSSIBLE}::DOUBLE * 100, 2), 2)
               AS cloud_percent_missing_data,
             round_even(100 - round_even(sum(greatest(hour_complete_sd, hour_complete_cloud))
               / {_POSSIBLE}::DOUBLE * 100, 2), 2) AS combined_percent_missing_data
        FROM ({FEED_HOURS_SQL})
        WHERE CAST(date_hour AS DATE) BETWEEN DATE '2024-01-02' AND DATE '2024-01-29'
        GROUP BY monitor""",
)
def a19(spark, sf):
    return completeness.feed_summary(feed_hours(spark, sf), dt.date(2024, 1, 2), dt.date(2024, 1, 29))


HOUR_GRID_SQL = """
    SELECT m.monitor, CAST(extract(hour FROM g.date_hour) AS INTEGER) AS hour,
           CASE WHEN coalesce(n, 0) >= 2 THEN 1 ELSE 0 END AS complete
    FROM (SELECT DISTINCT monitor FROM readings) m,
         (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31',
                 INTERVAL 1 HOUR)) AS date_hour) g
    LEFT JOIN (SELECT monitor, date_trunc('hour', timestamp) AS date_hour, count(pm25) AS n
               FROM readings GROUP BY 1, 2) c
      ON c.monitor = m.monitor AND c.date_hour = g.date_hour"""


def hours_on_calendar(spark, sf):
    return completeness.hours_on_calendar(
        fx.readings(spark, sf), "pm25",
        moment(dt.datetime(2024, 1, 1)), moment(dt.datetime(2024, 1, 31)), 2,
    )


@query(
    "a20_hour_of_day_completeness",
    f"""SELECT monitor, hour, count(*) AS n_possible, CAST(sum(complete) AS BIGINT) AS n_complete,
               round(avg(complete), 9) AS p_complete FROM ({HOUR_GRID_SQL}) GROUP BY 1, 2""",
)
def a20(spark, sf):
    return rounded(completeness.by_hour_of_day(hours_on_calendar(spark, sf)), "p_complete")


@query(
    "a20_hour_of_day_fleet",
    f"""SELECT hour, round(avg(p), 9) AS fleet_complete FROM (
          SELECT monitor, hour, avg(complete) AS p FROM ({HOUR_GRID_SQL}) GROUP BY 1, 2)
        GROUP BY 1""",
)
def a20_fleet(spark, sf):
    per_monitor = completeness.by_hour_of_day(hours_on_calendar(spark, sf))
    return rounded(completeness.fleet_by_hour_of_day(per_monitor), "fleet_complete")


@query(
    "a21_zero_week_ranking",
    """SELECT monitor, zero_weeks, rank() OVER (ORDER BY zero_weeks DESC) AS position FROM (
         SELECT monitor, count(*) FILTER (days = 0) AS zero_weeks FROM (
           SELECT monitor, date - CAST(extract(dow FROM date) AS INTEGER) AS week,
                  sum(CASE WHEN n_complete_hours >= 19 THEN 1 ELSE 0 END) AS days
           FROM daily GROUP BY 1, 2) GROUP BY 1)""",
)
def a21(spark, sf):
    days = fx.daily(spark, sf).withColumn(
        "day_complete", completeness.enough("n_complete_hours", 19)
    )
    return completeness.zero_week_ranking(completeness.complete_weeks(days))


MISSING_DAY_SQL = """
    SELECT monitor, date, count(*) FILTER (missing > 0) AS hours_missing_day FROM (
      SELECT monitor, date, hour, count(*) FILTER (pm25 IS NULL) AS missing FROM readings
      GROUP BY 1, 2, 3) GROUP BY 1, 2"""


MONTH = [dt.date(2024, 1, day) for day in range(1, 32)]


@query("a22_missing_hours_per_day", MISSING_DAY_SQL)
def a22(spark, sf):
    return completeness.missing_hours_per_day(fx.readings(spark, sf), "pm25", 0)


@query(
    "a22_missing_hours_wide",
    f"""SELECT monitor, {", ".join(f"max(n) FILTER (d = '{d}') AS \"{d}\"" for d in MONTH)}
        FROM (SELECT monitor, CAST(date AS VARCHAR) AS d, hours_missing_day AS n
              FROM ({MISSING_DAY_SQL})) GROUP BY monitor""",
)
def a22_wide(spark, sf):
    return completeness.missing_hours_wide(fx.readings(spark, sf), "pm25", MONTH, 0)


STATUS_SQL = """
    SELECT m.monitor, g.date, s.monitor IS NOT NULL AS sd_complete,
           coalesce(c.n >= 8, FALSE) AS cloud_complete,
           CASE WHEN s.monitor IS NOT NULL AND coalesce(c.n >= 8, FALSE) THEN 'both'
                WHEN s.monitor IS NOT NULL THEN 'sd_only'
                WHEN coalesce(c.n >= 8, FALSE) THEN 'cloud_only' ELSE 'none' END AS source_status
    FROM (SELECT DISTINCT monitor FROM readings) m,
         (SELECT CAST(unnest(generate_series(CAST(min(date) AS TIMESTAMP),
                 CAST(max(date) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS date FROM readings) g
    LEFT JOIN (SELECT DISTINCT monitor, date FROM readings WHERE event_id % 10 = 0) s
      ON s.monitor = m.monitor AND s.date = g.date
    LEFT JOIN (SELECT monitor, date, count(*) FILTER (event_type = 'click') AS n
               FROM readings GROUP BY 1, 2) c ON c.monitor = m.monitor AND c.date = g.date"""


def daily_status(spark, sf):
    df = fx.readings(spark, sf)
    cloud = df.groupBy("monitor", "date").agg(
        F.count_if(F.col("event_type") == "click").alias("n")
    )
    return completeness.daily_source_status(
        df.where("event_id % 10 = 0"),
        cloud.withColumn("day_complete", completeness.enough("n", 8)),
    )


@query("a23_daily_source_status", STATUS_SQL)
def a23(spark, sf):
    return daily_status(spark, sf)


@query(
    "a23_weekly_source_status",
    f"""SELECT monitor, CAST(date - CAST(isodow(date) - 1 AS INTEGER) AS DATE) AS week,
               count(*) FILTER (source_status <> 'none') AS days_any,
               count(*) FILTER (source_status = 'sd_only') AS days_sd_only,
               count(*) FILTER (source_status = 'cloud_only') AS days_cloud_only,
               count(*) FILTER (source_status = 'both') AS days_both
        FROM ({STATUS_SQL}) GROUP BY 1, 2""",
)
def a23_weekly(spark, sf):
    return completeness.weekly_source_status(daily_status(spark, sf))


@query(
    "a23_files_per_week",
    """SELECT 'MOD-PM-' || lpad(CAST(user_id AS VARCHAR), 5, '0') AS monitor,
              CAST(CAST(ts AS DATE) - CAST(extract(dow FROM ts) AS INTEGER) AS DATE) AS week,
              count(DISTINCT CAST(ts AS DATE)) AS days_with_data
       FROM events WHERE event_type <> 'error' GROUP BY 1, 2""",
)
def a23_files(spark, sf):
    from fleetfold.catalog.sources import card_paths
    from fleetfold.sources.logs import file_inventory

    return completeness.files_per_week(file_inventory(card_paths(spark, sf)))


@query(
    "a24_monitor_statistics",
    """SELECT monitor, round(avg(pm25), 9) AS mean_value, round(stddev_samp(pm25), 9) AS sd_value,
              round(median(pm25), 9) AS median_value FROM readings GROUP BY 1""",
)
def a24(spark, sf):
    return rounded(
        trends.monitor_statistics(fx.readings(spark, sf), "pm25"),
        "mean_value", "sd_value", "median_value",
    )


@query(
    "a25_grand_daily_means",
    """WITH d AS (SELECT date, avg(pm1) AS a, avg(pm25) AS b, avg(pm10) AS c FROM readings GROUP BY 1),
         l AS (SELECT date, 'Mean PM 1' AS pollutant, a AS m FROM d
               UNION ALL SELECT date, 'Mean PM 2.5', b FROM d
               UNION ALL SELECT date, 'Mean PM 10', c FROM d),
         o AS (SELECT pollutant, avg(m) AS m FROM l GROUP BY 1)
       SELECT pollutant, date, round(l.m, 9) AS measurement,
              round_even(o.m * pow(10.0::DOUBLE, 2 - floor(log10(o.m))), 0)
                / pow(10.0::DOUBLE, 2 - floor(log10(o.m))) AS mean_measurement
       FROM l JOIN o USING (pollutant)""",
)
def a25(spark, sf):
    means = trends.grand_daily_means(
        fx.readings(spark, sf),
        {"pm1": "Mean PM 1", "pm25": "Mean PM 2.5", "pm10": "Mean PM 10"},
    )
    return rounded(means, "measurement")


@query(
    "a26_quartile_table",
    """SELECT device_class, round_even(min(pm25), 2) AS min, round_even(avg(pm25), 2) AS mean,
              round_even(max(pm25), 2) AS max, round_even(quantile_cont(pm25, 0.25), 2) AS q1,
              round_even(median(pm25), 2) AS median, round_even(quantile_cont(pm25, 0.75), 2) AS q3
       FROM (SELECT CASE WHEN contains(monitor, 'MOD-PM') THEN 'MOD-PM' ELSE 'MOD' END
               AS device_class, round(pm25 * 0.77, 3) AS pm25 FROM readings) GROUP BY 1""",
)
def a26(spark, sf):
    df = trends.by_device_class(fx.readings(spark, sf)).withColumn(
        "pm25", F.round(F.col("pm25") * 0.77, 3)
    )
    return trends.quartile_table(df, "pm25", ["device_class"])


SEASON_SQL = "CASE WHEN extract(day FROM date) > 20 THEN 'dry' ELSE 'wet' END"


def seasonal(spark, sf):
    return fx.hourly(spark, sf).withColumns(
        {
            "season": F.when(F.dayofmonth("date") > 20, "dry").otherwise("wet"),
            "cooking_period": cooking_period("hour"),
        }
    )


@query(
    "a27_season_cooking_period",
    f"""SELECT season, cooking_period, count(mean_pm25) AS n, round(avg(mean_pm25), 9) AS mean_value,
               round(stddev_samp(mean_pm25), 9) AS sd_value
        FROM (SELECT mean_pm25, {SEASON_SQL} AS season, {COOKING_SQL} AS cooking_period FROM hourly)
        GROUP BY 1, 2""",
)
def a27(spark, sf):
    return rounded(
        trends.mean_and_spread(seasonal(spark, sf), "mean_pm25", ["season", "cooking_period"]),
        "mean_value", "sd_value",
    )


@query(
    "a28_heat_table",
    """SELECT date, hour, round(m, 9) AS mean_pm25, CAST(extract(day FROM date) AS INTEGER) AS day,
              CAST(extract(month FROM date) AS INTEGER) AS month,
              CAST(extract(year FROM date) AS INTEGER) AS year,
              round(CASE WHEN m > 0 THEN ln(m) END, 9) AS log_mean_pm25
       FROM (SELECT date, hour, avg(mean_pm25) AS m FROM hourly GROUP BY 1, 2)""",
)
def a28(spark, sf):
    return rounded(
        trends.heat_table(fx.hourly(spark, sf), "mean_pm25"), "mean_pm25", "log_mean_pm25"
    )


@query(
    "a29_daily_means_cook_time",
    """SELECT 'all' AS kind, monitor, date, round(avg(pm25), 9) AS mean_pm25 FROM readings
       GROUP BY 1, 2, 3
       UNION ALL SELECT 'cook time', monitor, date, round(avg(pm25), 9) FROM readings
         WHERE hour >= 16 AND hour < 20 GROUP BY 1, 2, 3
       UNION ALL SELECT 'fleet', NULL, date, round(avg(pm25), 9) FROM readings GROUP BY 1, 2, 3""",
)
def a29(spark, sf):
    df = fx.readings(spark, sf)
    kinds = {
        "all": trends.daily_mean(df, "pm25"),
        "cook time": trends.daily_mean(df, "pm25", cook_time=True),
        "fleet": trends.daily_mean(df, "pm25", ()),
    }
    out = None
    for kind, part in kinds.items():
        labelled = rounded(part, "mean_pm25").withColumn("kind", F.lit(kind))
        out = labelled if out is None else out.unionByName(labelled, allowMissingColumns=True)
    return out


@query(
    "a30_diurnal_profile",
    f"""SELECT {SEASON_SQL} AS season, hour, round(avg(pm25), 9) AS mean_pm25,
               round(avg(met_temp), 9) AS mean_temp FROM readings GROUP BY 1, 2""",
)
def a30(spark, sf):
    df = fx.readings(spark, sf).withColumn(
        "season", F.when(F.dayofmonth("date") > 20, "dry").otherwise("wet")
    )
    return rounded(
        trends.diurnal_profile(df, {"pm25": "mean_pm25", "met_temp": "mean_temp"}),
        "mean_pm25", "mean_temp",
    )


@query(
    "a31_daily_measures",
    """SELECT date, round(mean_o3, 9) AS mean_o3, round(mean_temp, 9) AS mean_temp,
              round(mean_pm25, 9) AS mean_pm25
       FROM (SELECT date, avg(pm25) AS mean_o3 FROM readings WHERE event_type = 'purchase' GROUP BY 1)
       LEFT JOIN (SELECT date, avg(met_temp) AS mean_temp FROM readings
                  WHERE date > DATE '2024-01-03' AND date < DATE '2024-01-20' GROUP BY 1) USING (date)
       LEFT JOIN (SELECT date, avg(pm25) AS mean_pm25 FROM readings GROUP BY 1) USING (date)""",
)
def a31(spark, sf):
    df = fx.readings(spark, sf)
    temp = df.where("date > DATE '2024-01-03' AND date < DATE '2024-01-20'")
    table = trends.daily_measures(
        df.where("event_type = 'purchase'").groupBy("date").agg(F.avg("pm25").alias("mean_o3")),
        [
            temp.groupBy("date").agg(F.avg("met_temp").alias("mean_temp")),
            df.groupBy("date").agg(F.avg("pm25").alias("mean_pm25")),
        ],
    )
    return rounded(table, "mean_o3", "mean_temp", "mean_pm25")


@query(
    "a32_numeric_means_by_class",
    """SELECT CASE WHEN contains(monitor, 'MOD-PM') THEN 'MOD-PM' ELSE 'MOD' END AS device_class,
              date, round(avg(n_complete_hours), 9) AS n_complete_hours_mean,
              round(avg(mean_pm25), 9) AS mean_pm25_mean, round(avg(n_active), 9) AS n_active_mean,
              round(avg(fleet_average_pm25), 9) AS fleet_average_pm25_mean
       FROM daily GROUP BY 1, 2""",
)
def a32(spark, sf):
    table = mean_of_numeric(
        trends.by_device_class(fx.daily(spark, sf)), ["device_class", "date"]
    )
    return rounded(table, *table.columns[2:])


SHARES = ("any_extrapolation", "out_pm25", "out_met_temp")
SHARES_SQL = ", ".join(
    f"round_even(100.0::DOUBLE * count(*) FILTER ({c}) / count(*), 2) AS pct_{c}" for c in SHARES
)


@query(
    "a33_extrapolation_overall",
    f"""SELECT count(*) AS n, {SHARES_SQL}
        FROM (SELECT *, out_pm25 OR out_met_temp AS any_extrapolation FROM ({EXTRAPOLATION_SQL}))""",
)
def a33(spark, sf):
    return trends.extrapolation_share(flagged(spark, sf), ["pm25", "met_temp"])


@query(
    "a33_extrapolation_by_monitor",
    f"""SELECT monitor, count(*) AS n, {SHARES_SQL}
        FROM (SELECT *, out_pm25 OR out_met_temp AS any_extrapolation FROM ({EXTRAPOLATION_SQL}))
        GROUP BY 1""",
)
def a33_monitor(spark, sf):
    return trends.extrapolation_share(
        flagged(spark, sf), ["pm25", "met_temp"], ["monitor"]
    ).orderBy(F.desc("pct_any_extrapolation"))


def changed(spark, sf):
    """Hours with a made-up calibrated value, as the calibration reports expect them."""
    adjusted = F.col("mod_pm25") * 0.8 + F.col("mod_temp") / 10
    return fx.model_hours(spark, sf).withColumn("pm25_fem", adjusted).withColumns(
        {
            "delta": F.col("pm25_fem") - F.col("mod_pm25"),
            "ratio": F.when(F.col("mod_pm25") > 0, F.col("pm25_fem") / F.col("mod_pm25")),
        }
    )


CHANGED_SQL = """
    SELECT *, fem - mod_pm25 AS delta, CASE WHEN mod_pm25 > 0 THEN fem / mod_pm25 END AS ratio
    FROM (SELECT *, mod_pm25 * 0.8 + mod_temp / 10 AS fem FROM model_hours)"""


@query(
    "a34_calibration_change",
    f"""SELECT monitor, count(*) AS n, round_even(avg(mod_pm25), 2) AS mean_raw,
               round_even(avg(fem), 2) AS mean_adjusted, round_even(avg(delta), 2) AS mean_delta,
               round_even(median(ratio), 2) AS median_ratio FROM ({CHANGED_SQL}) GROUP BY 1""",
)
def a34(spark, sf):
    return trends.calibration_change(
        changed(spark, sf), "mod_pm25", "pm25_fem", "delta", "ratio"
    ).orderBy(F.desc(F.abs("mean_delta")))


@query(
    "a35_daily_two_ways",
    """SELECT monitor, date, nr AS n_complete_hours_raw, round(mr, 9) AS mean_mod_pm25,
              ng AS n_complete_hours_gmr, round(mg, 9) AS mean_pm25_fem,
              round(mg - mr, 9) AS delta_daily_gmr,
              round(CASE WHEN mr > 0 THEN mg / mr END, 9) AS ratio_daily_gmr
       FROM (SELECT monitor, date, count(mod_pm25) AS nr, count(fem) AS ng,
                    CASE WHEN count(mod_pm25) >= 18 THEN avg(mod_pm25) END AS mr,
                    CASE WHEN count(fem) >= 18 THEN avg(fem) END AS mg
             FROM (SELECT *, CASE WHEN hour % 11 <> 0 THEN mod_pm25 * 0.8 + mod_temp / 10 END AS fem
                   FROM model_hours) GROUP BY 1, 2)""",
)
def a35(spark, sf):
    df = changed(spark, sf).withColumn(
        "pm25_fem", F.when(F.col("hour") % 11 != 0, F.col("pm25_fem"))
    )
    table = rollup.daily_two_ways(df, "mod_pm25", "pm25_fem")
    return rounded(
        table, "mean_mod_pm25", "mean_pm25_fem", "delta_daily_gmr", "ratio_daily_gmr"
    )


@query(
    "a36_training_ranges",
    """SELECT round(min(mod_pm25), 9) AS mod_pm25_min, round(max(mod_pm25), 9) AS mod_pm25_max,
              round(min(mod_temp), 9) AS mod_temp_min, round(max(mod_temp), 9) AS mod_temp_max
       FROM model_hours""",
)
def a36(spark, sf):
    ranges = trends.training_ranges(fx.model_hours(spark, sf), ["mod_pm25", "mod_temp"])
    return rounded(ranges, *ranges.columns)


METRICS_SQL = """
    SELECT {key} count(*) AS n, round(1 - sum(pow(p - y, 2)) / regr_syy(y, p), 8) AS r2,
           round(sqrt(avg(pow(p - y, 2))), 8) AS rmse, round(avg(abs(p - y)), 8) AS mae,
           round(avg(p - y), 8) AS bias,
           round(sum(abs(p - y - b)) / sum(y), 8) AS cvmae, round(sum(p - y) / sum(y), 8) AS mnb,
           round(sum(abs(p - y)) / sum(y), 8) AS nmae,
           round(sqrt(avg(pow(p - y, 2))) / avg(y) * 100, 8) AS nrmse_pct,
           round(regr_r2(y, p), 8) AS pearson_r2, round(regr_slope(y, p), 8) AS cal_slope,
           round(regr_intercept(y, p), 8) AS cal_intercept
    FROM (SELECT *, avg(p - y) OVER ({part}) AS b FROM (
            SELECT monitor, mod_pm25 AS p, ref_pm25 AS y FROM model_hours)) {group}"""


@query("a37_error_metrics", METRICS_SQL.format(key="", part="", group=""))
def a37(spark, sf):
    table = stats.error_metrics(fx.model_hours(spark, sf), "ref_pm25", "mod_pm25")
    return rounded(table, *table.columns[1:], digits=8)


@query(
    "a37_error_metrics_by_monitor",
    METRICS_SQL.format(key="monitor,", part="PARTITION BY monitor", group="GROUP BY monitor"),
)
def a37_monitor(spark, sf):
    table = stats.error_metrics(fx.model_hours(spark, sf), "ref_pm25", "mod_pm25", ["monitor"])
    return rounded(table, *table.columns[2:], digits=8)


@query(
    "a38_bland_altman",
    """SELECT round(m, 8) AS mean_diff, round(s, 8) AS sd_diff, round(m - 1.96 * s, 8) AS lower,
              round(m + 1.96 * s, 8) AS upper
       FROM (SELECT avg(mod_pm25 - ref_pm25) AS m, stddev_samp(mod_pm25 - ref_pm25) AS s
             FROM model_hours)""",
)
def a38(spark, sf):
    table = stats.bland_altman(fx.model_hours(spark, sf), "mod_pm25", "ref_pm25")
    return rounded(table, *table.columns, digits=8)


@query(
    "a39_monitor_pairs",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS gas, a.monitor AS monitor_x, b.monitor AS monitor_y, count(*) AS n,
              round(corr(a.{c}, b.{c}), 7) AS correlation,
              round(regr_slope(b.{c}, a.{c}), 7) AS slope
            FROM gas_hours a JOIN gas_hours b ON a.timestamp = b.timestamp
            WHERE a.{c} IS NOT NULL AND b.{c} IS NOT NULL GROUP BY 2, 3"""
        for c in fx.GASES
    ),
)
def a39(spark, sf):
    pairs = trends.monitor_pairs(fx.gas_hours(spark, sf), fx.GASES).withColumnRenamed("measure", "gas")
    return rounded(pairs, "correlation", "slope", digits=7)


@query(
    "a40_daily_hour_share",
    """SELECT monitor, date, CAST(count(DISTINCT hour) AS INTEGER) AS n_hours,
              round(count(DISTINCT hour) / 24.0::DOUBLE, 9) AS pct_complete
       FROM readings WHERE pm25 IS NOT NULL GROUP BY 1, 2""",
)
def a40(spark, sf):
    return rounded(
        completeness.daily_hour_share(fx.readings(spark, sf), "pm25"), "pct_complete"
    )


@query(
    "a41_daily_filled",
    """SELECT monitor, date, n_hours_pm25, round(m, 9) AS daily_mean_pm25, n_imputed_hours,
              round(n_hours_pm25 / 24.0::DOUBLE, 9) AS pct_hours_present,
              round(n_imputed_hours / CAST(n_hours_pm25 AS DOUBLE), 9) AS pct_hours_imputed
       FROM (SELECT monitor, date, count(coalesce(mean_pm25, g)) AS n_hours_pm25,
                    avg(coalesce(mean_pm25, g)) AS m,
                    count(*) FILTER (mean_pm25 IS NULL AND g IS NOT NULL) AS n_imputed_hours
             FROM (SELECT *, CASE WHEN n_reporting > 2 THEN
                     sum(mean_pm25) OVER (PARTITION BY timestamp) / n_reporting END AS g FROM loo)
             GROUP BY 1, 2) WHERE n_hours_pm25 >= 18""",
)
def a41(spark, sf):
    filled = impute.fill_gaps(fx.loo(spark, sf, "others"), "mean_pm25", "fleet_avg")
    table = rollup.daily_filled(filled, "pm25_filled", "pm25_was_imputed", "pm25")
    return rounded(table, "daily_mean_pm25", "pct_hours_present", "pct_hours_imputed")


@query(
    "a42_last_readings",
    """SELECT monitor, max(timestamp) AS recent_reading, CAST(max(timestamp) AS DATE)
                AS reading_date,
              CAST(date_diff('day', CAST(max(timestamp) AS DATE), DATE '2024-09-01') AS INTEGER)
                AS time_since_reading
       FROM readings WHERE pm25 IS NOT NULL GROUP BY 1""",
)
def a42(spark, sf):
    return completeness.last_readings(fx.readings(spark, sf), "pm25", dt.date(2024, 9, 1))


@query(
    "a43_duplicate_count",
    """SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT monitor, timestamp FROM readings))
                AS n_duplicates FROM readings""",
)
def a43(spark, sf):
    return completeness.duplicate_count(fx.readings(spark, sf), ["monitor", "timestamp"])


ROSE_SQL = """
    SELECT sector, speed, n, round(n / CAST(sum(n) OVER () AS DOUBLE), 9) AS share FROM (
      SELECT CAST(CAST(floor((wd + 9) / 18) AS BIGINT) % 20 * 18 AS INTEGER) AS sector,
             CASE WHEN ws <= 2 THEN '0-2' WHEN ws <= 4 THEN '2-4' WHEN ws <= 6 THEN '4-6'
                  ELSE '>6' END AS speed, count(*) AS n
      FROM ({rows}) WHERE wd >= 0 AND wd <= 360 AND ws > 0 AND ws < 40 GROUP BY 1, 2)"""


@query("a44_wind_rose", ROSE_SQL.format(rows="SELECT * FROM readings"))
def a44(spark, sf):
    return rounded(trends.wind_rose(fx.readings(spark, sf)), "share")


_SPAN = "date > DATE '2024-01-05' AND date < DATE '2024-01-25'"
_DEVICE = f"SELECT ws, wd FROM readings WHERE monitor = 'MOD-00000' AND {_SPAN}"
_STATION = """SELECT ws, wd FROM readings WHERE pm25 IS NOT NULL
    AND timestamp > TIMESTAMP '2024-01-05' AND timestamp < TIMESTAMP '2024-01-25'"""


@query(
    "a44_overlap_wind_roses",
    f"""SELECT 'MOD-00000' AS station, * FROM ({ROSE_SQL.format(rows=_DEVICE)})
        UNION ALL SELECT 'external', * FROM ({ROSE_SQL.format(rows=_STATION)})""",
)
def a44_overlap(spark, sf):
    device = fx.readings(spark, sf).where(F.col("monitor") == fx.REFERENCE)
    roses = trends.overlap_wind_roses(
        device, external_wind(spark, sf), dt.date(2024, 1, 5), dt.date(2024, 1, 25)
    )
    return rounded(roses, "share")


@query(
    "a45_share_of_span",
    """SELECT monitor, count(*) FILTER (n_complete_hours > 18) AS days_complete,
              round_even(count(*) FILTER (n_complete_hours > 18) / 185.0::DOUBLE * 100, 1)
                AS percent_complete FROM daily GROUP BY 1""",
)
def a45(spark, sf):
    days = fx.daily(spark, sf).withColumn(
        "day_complete", completeness.enough("n_complete_hours", 18, True)
    )
    return completeness.share_of_span(days)
