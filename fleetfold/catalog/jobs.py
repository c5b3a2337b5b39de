"""The whole jobs of ``fleetfold.plans`` on the sample tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from fleetfold.catalog import fixtures as fx
from fleetfold.catalog.aggregates import rounded
from fleetfold.catalog.joins import GAS_FIT_SQL
from fleetfold.catalog.modelling import FIRST, FLEET_FIT_SQL, dry, fitted_on
from fleetfold.catalog.registry import query
from fleetfold.config import FitRules, GasRules, RollupRules, Settings
from fleetfold.functions.calendar import truncate
from fleetfold.plans.gases import process_gases
from fleetfold.plans.imputation import impute_hours
from fleetfold.plans.particulate import process_particulates
from fleetfold.plans.reference import calibrate_to_reference

HOURS = RollupRules(1, 18, 3)
MERGED_FIT_SQL = FLEET_FIT_SQL.replace("coloc", "merged_hours")


def hourly_cloud(spark, sf):
    """Cloud rows on whole hours, so that monitors meet in time as minute data of a fleet do."""
    hours = fx.coloc(spark, sf).withColumn("pm1", F.col("pm25") * 0.6)
    return hours.withColumn("pm10", F.col("pm25") * 5.0)


def hourly_card(spark, sf):
    card = fx.card(spark, sf)
    return (
        card.groupBy("monitor", truncate("timestamp_iso", "hour").alias("timestamp_iso"))
        .agg(F.avg("pm25").alias("pm25"))
        .withColumns({"pm1": F.col("pm25") * 0.6, "pm10": F.col("pm25") * 5.0})
    )


JOB_SQL = f"""
    WITH k AS (SELECT monitor, date_trunc('hour', timestamp_iso) AS timestamp, avg(pm25) AS pm25
               FROM card GROUP BY 1, 2),
    merged_hours AS (SELECT coalesce(c.monitor, k.monitor) AS monitor,
                 coalesce(c.timestamp, k.timestamp) AS timestamp, c.date,
                 coalesce(c.pm25, k.pm25) AS pm25
          FROM coloc c FULL JOIN k ON c.monitor = k.monitor AND c.timestamp = k.timestamp),
    f AS ({MERGED_FIT_SQL}),
    x AS (SELECT m.monitor, CAST(m.timestamp AS DATE) AS date,
                 CAST(extract(hour FROM m.timestamp) AS INTEGER) AS hour,
                 CASE WHEN f.slope IS NULL THEN m.pm25 ELSE (m.pm25 - f.intercept) / f.slope END
                   AS v
          FROM merged_hours m LEFT JOIN f ON m.monitor = f.monitor),
    h AS (SELECT monitor, date, hour, count(CASE WHEN v >= 1 THEN v END) AS n_minute_obs,
                 avg(CASE WHEN v >= 1 THEN v END) AS mean_pm25 FROM x GROUP BY 1, 2, 3)
    SELECT monitor, date, hour, n_minute_obs, round(mean_pm25, 6) AS mean_pm25,
           count(mean_pm25) OVER w AS n_active,
           round(CASE WHEN count(mean_pm25) OVER w >= 3 THEN avg(mean_pm25) OVER w END, 6)
             AS fleet_average_pm25
    FROM h WINDOW w AS (PARTITION BY date, hour)"""


@query("job_particulates_hourly", JOB_SQL)
def job_particulates(spark, sf):
    tables = process_particulates(
        hourly_cloud(spark, sf),
        hourly_card(spark, sf),
        Settings(FitRules(3, 300, 0.08), (FIRST,)),
        {"original": fx.roster(spark, sf)},
        ("pm25",),
        HOURS,
        fitted_on=fitted_on(),
        files_per_day=1,
    )
    return rounded(tables.hourly["pm25"], "mean_pm25", "fleet_average_pm25", digits=6)


@query("job_particulates_daily_wide")
def job_particulates_wide(spark, sf):
    tables = process_particulates(
        hourly_cloud(spark, sf),
        hourly_card(spark, sf),
        Settings(FitRules(3, 300, 0.08), (FIRST,)),
        {"original": fx.roster(spark, sf)},
        ("pm25", "pm1"),
        HOURS,
        files_per_day=1,
    )
    return tables.daily_wide


GAS_JOB_SQL = f"""
    WITH w AS (SELECT monitor, gas, slope, intercept FROM ({GAS_FIT_SQL.format(r2=0.0)})),
    l AS (SELECT monitor, date, hour, 'co' AS gas, co AS y FROM gas_hours
          UNION ALL SELECT monitor, date, hour, 'no', no FROM gas_hours
          UNION ALL SELECT monitor, date, hour, 'no2', no2 FROM gas_hours
          UNION ALL SELECT monitor, date, hour, 'o3', o3 FROM gas_hours),
    c AS (SELECT l.gas, l.monitor, l.date, l.hour, (y - intercept) / slope AS v
          FROM l LEFT JOIN w ON l.monitor = w.monitor AND l.gas = w.gas
          WHERE l.date >= DATE '2024-01-05' AND l.monitor LIKE 'MOD-0%')
    SELECT gas, monitor, date, hour, n_minute_obs, round(m, 4) AS mean_value,
           count(m) OVER (PARTITION BY gas, date, hour) AS n_active,
           round(CASE WHEN count(m) OVER (PARTITION BY gas, date, hour) >= 2
                 THEN avg(m) OVER (PARTITION BY gas, date, hour) END, 4) AS fleet_average_value
    FROM (SELECT gas, monitor, date, hour, count(v) AS n_minute_obs, avg(v) AS m FROM c
          GROUP BY 1, 2, 3, 4)"""


@query("job_gases_hourly", GAS_JOB_SQL)
def job_gases(spark, sf):
    from fleetfold.sources.tables import GAS_CARD_SCHEMA, empty_table

    rules = GasRules(
        fx.REFERENCE, dt.date(2024, 1, 1), dt.date(2024, 1, 31), fx.GASES, 100, 0.0
    )
    tables = process_gases(
        fx.gas_hours(spark, sf), empty_table(spark, GAS_CARD_SCHEMA), rules, dt.date(2024, 1, 5),
        RollupRules(1, 18, 2),
        files_per_day=1,
    )
    return rounded(tables.hourly, "mean_value", "fleet_average_value", digits=4)


@query("job_reference_calibration_daily")
def job_reference(spark, sf):
    hours = fx.model_hours(spark, sf)
    day = F.dayofmonth("date")
    devices = hours.drop("ref_pm25", "season_binary")
    reference = hours.groupBy("date", "hour").agg(F.max("ref_pm25").alias("ref_pm25"))
    channels = {c: hours.select("monitor", "date", "hour", c)
                for c in ("mod_pm25", "mod_temp", "mod_rh")}
    tables = calibrate_to_reference(
        [devices.where(day <= 18), devices.where(day >= 15)], reference, "ref_pm25", channels,
        season=dry(devices), min_hours=12,
    )
    return tables.daily


@query("job_imputation_daily")
def job_imputation(spark, sf):
    hours = fx.hourly(spark, sf).select("monitor", "date", "hour", "mean_pm25")
    weather = fx.readings(spark, sf).groupBy("monitor", "date", "hour").agg(
        F.avg("met_temp").alias("mean_met_temp"), F.avg("met_rh").alias("mean_met_rh")
    )
    day = F.dayofmonth("date")
    tables = impute_hours(
        {
            "mean_pm25": [hours.where(day <= 20), hours.where(day >= 15)],
            "mean_met_temp": [weather.select("monitor", "date", "hour", "mean_met_temp")],
            "mean_met_rh": [weather.select("monitor", "date", "hour", "mean_met_rh")],
        }
    )
    return tables.daily
