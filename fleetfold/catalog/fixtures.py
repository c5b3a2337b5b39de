"""Sensor tables derived from the sample tables, once as DataFrames and once as SQL."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetfold.functions.calendar import truncate
from fleetfold.operators.ordering import first_per_key
from fleetfold.operators.rollup import daily_means, hourly_means, with_fleet_means

GASES = ("co", "no", "no2", "o3")
GAS_OF_EVENT = {"click": "co", "view": "no", "signup": "no2", "purchase": "o3"}
REFERENCE = "MOD-00000"

SQL: dict[str, str] = {
    "readings": """
        SELECT event_id, user_id, event_type,
               CASE WHEN user_id % 10 < 3 THEN 'MOD-0000' ELSE 'MOD-PM-0000' END
                 || CAST(user_id % 10 AS VARCHAR) AS monitor,
               date_trunc('minute', ts) AS timestamp, CAST(ts AS DATE) AS date,
               CAST(extract(hour FROM ts) AS INTEGER) AS hour,
               CASE WHEN event_id % 7 <> 0 THEN value END AS pm25,
               CASE WHEN event_id % 11 <> 0 THEN value * 0.6 END AS pm1,
               CASE WHEN event_id % 13 <> 0 THEN value * 5.0 END AS pm10,
               20 + value / 20 AS met_temp, CAST(event_id % 100 AS DOUBLE) AS met_rh,
               value / 8 AS ws, CAST((event_id * 37) % 375 AS DOUBLE) AS wd, value AS raw_value
        FROM events""",
    "cloud": """
        SELECT monitor, timestamp, date, hour, pm25, pm1, pm10, met_temp, met_rh, ws, wd,
               CASE WHEN pm25 IS NOT NULL THEN 'cloud' END AS source
        FROM readings WHERE event_id % 3 <> 0
        QUALIFY row_number() OVER (PARTITION BY monitor, timestamp ORDER BY event_id) = 1""",
    "card": """
        SELECT monitor, timestamp AS timestamp_iso, raw_value * 1.1 AS pm25, met_temp, met_rh, ws,
               wd, 'sd_card' AS source
        FROM readings WHERE event_id % 3 <> 1
        QUALIFY row_number() OVER (PARTITION BY monitor, timestamp ORDER BY event_id) = 1""",
    "merged": """
        SELECT coalesce(c.monitor, s.monitor) AS monitor,
               coalesce(c.timestamp, s.timestamp_iso) AS timestamp, c.date, c.hour,
               coalesce(c.pm25, s.pm25) AS pm25,
               CASE WHEN c.pm25 IS NOT NULL THEN 'cloud'
                    WHEN s.pm25 IS NOT NULL THEN 'sd_card' END AS source
        FROM cloud c FULL JOIN card s
          ON c.monitor = s.monitor AND c.timestamp = s.timestamp_iso""",
    "gas_long": """
        SELECT monitor, timestamp, date, hour,
               CASE event_type WHEN 'click' THEN 'co' WHEN 'view' THEN 'no'
                    WHEN 'signup' THEN 'no2' WHEN 'purchase' THEN 'o3' END AS gas,
               pm25 AS value, CASE WHEN event_id % 2 = 0 THEN 'cloud' ELSE 'sd_card' END AS source
        FROM readings WHERE event_type IN ('click', 'view', 'signup', 'purchase')
        QUALIFY row_number() OVER (
          PARTITION BY monitor, timestamp, event_type ORDER BY event_id) = 1""",
    "gas_hours": """
        SELECT monitor, date_trunc('hour', timestamp) AS timestamp, date, hour,
               avg(CASE WHEN gas = 'co' THEN value END) AS co,
               avg(CASE WHEN gas = 'no' THEN value END) AS no,
               avg(CASE WHEN gas = 'no2' THEN value END) AS no2,
               avg(CASE WHEN gas = 'o3' THEN value END) AS o3, 'cloud' AS source
        FROM gas_long GROUP BY 1, 2, 3, 4""",
    "hourly": """
        SELECT *, CASE WHEN n_active >= 3 THEN avg(mean_pm25) OVER (PARTITION BY date, hour) END
                    AS fleet_average_pm25
        FROM (SELECT *, count(mean_pm25) OVER (PARTITION BY date, hour) AS n_active
              FROM (SELECT monitor, date, hour, count(pm25) AS n_minute_obs,
                           CASE WHEN count(pm25) >= 2 THEN avg(pm25) END AS mean_pm25
                    FROM readings GROUP BY monitor, date, hour))""",
    "daily": """
        SELECT *, CASE WHEN n_active >= 3 THEN avg(mean_pm25) OVER (PARTITION BY date) END
                    AS fleet_average_pm25
        FROM (SELECT *, count(mean_pm25) OVER (PARTITION BY date) AS n_active
              FROM (SELECT monitor, date, count(mean_pm25) AS n_complete_hours,
                           CASE WHEN count(mean_pm25) >= 18 THEN avg(mean_pm25) END AS mean_pm25
                    FROM hourly GROUP BY monitor, date))""",
    "coloc": """
        SELECT monitor, date_trunc('hour', timestamp) AS timestamp, date, hour, avg(pm25) AS pm25,
               'cloud' AS source
        FROM readings GROUP BY 1, 2, 3, 4""",
    "groups": """
        SELECT DISTINCT CASE WHEN user_id % 10 < 6 THEN 'original' ELSE 'new' END AS "group", monitor
        FROM readings WHERE user_id % 10 < 8""",
    "sites": """
        SELECT 'S' || CAST(s_suppkey AS VARCHAR) AS monitor,
               -3 + (s_suppkey * 37 % 101) / 50.0::DOUBLE AS x,
               7 + (s_suppkey * 53 % 103) / 50.0::DOUBLE AS y,
               CASE WHEN s_suppkey % 9 <> 0 THEN s_acctbal END AS value
        FROM supplier""",
    "roads": """
        SELECT p_partkey AS road_id,
               CASE p_partkey % 4 WHEN 0 THEN 'trunk' WHEN 1 THEN 'residential'
                    WHEN 2 THEN 'tertiary' ELSE 'track' END AS highway,
               -3 + (p_partkey * 17 % 101) / 50.0::DOUBLE AS x1,
               7 + (p_partkey * 29 % 103) / 50.0::DOUBLE AS y1,
               -3 + (p_partkey * 17 % 101) / 50.0::DOUBLE + p_size / 1000.0::DOUBLE AS x2,
               7 + (p_partkey * 29 % 103) / 50.0::DOUBLE + p_size / 1000.0::DOUBLE AS y2
        FROM part""",
    "cal": """
        SELECT 'MOD-0000' || CAST(u AS VARCHAR) AS monitor, pollutant,
               CASE WHEN u % 4 = 3 THEN NULL ELSE 1 + s / 100 END AS slope, i AS intercept,
               0.7 + (n % 10) / 50.0::DOUBLE AS r2, n AS n_points, fitted_on, colocation_end
        FROM (SELECT user_id % 3 AS u, 'pm25' AS pollutant,
                     CASE WHEN event_type <> 'view'
                          THEN DATE '2024-02-01' + CAST(count(*) % 2 AS INTEGER) END AS fitted_on,
                     max(timestamp) AS colocation_end, count(*) AS n,
                     CAST(count(*) % 13 AS DOUBLE) AS s, CAST(count(*) % 3 AS DOUBLE) AS i,
                     event_type
              FROM readings WHERE event_type <> 'error'
              GROUP BY user_id % 3, event_type)""",
    "loo": """
        SELECT monitor, date, hour, timestamp, mean_pm25, n_reporting,
               CASE WHEN n_reporting > 2 THEN (total - mean_pm25) / (n_reporting - 1) END AS fleet_avg
        FROM (SELECT monitor, date, hour,
                     CAST(date AS TIMESTAMP) + to_hours(CAST(hour AS BIGINT)) AS timestamp,
                     mean_pm25, count(mean_pm25) OVER (PARTITION BY date, hour) AS n_reporting,
                     sum(mean_pm25) OVER (PARTITION BY date, hour) AS total
              FROM hourly)""",
    "model_hours": """
        SELECT d.monitor, d.date, d.hour, d.mod_pm25, d.mod_temp, d.mod_rh, r.ref_pm25,
               CASE WHEN extract(day FROM d.date) > 20 THEN 1 ELSE 0 END AS season_binary
        FROM (SELECT monitor, date, hour, avg(pm25) AS mod_pm25, avg(met_temp) AS mod_temp,
                     avg(met_rh) AS mod_rh
              FROM readings WHERE pm25 IS NOT NULL AND user_id % 10 <> 0 GROUP BY 1, 2, 3) d
        JOIN (SELECT date, hour, avg(raw_value) AS ref_pm25
              FROM readings GROUP BY 1, 2) r
          USING (date, hour)""",
}


def with_fixtures(sql: str) -> str:
    """Prefix a statement with the fixture tables it mentions, directly or through others."""
    wanted: set[str] = set()

    def visit(text: str) -> None:
        for name in SQL:
            if name not in wanted and re.search(rf"\b{name}\b", text):
                wanted.add(name)
                visit(SQL[name])

    visit(sql)
    parts = [f"{name} AS ({SQL[name]})" for name in SQL if name in wanted]
    if not parts:
        return sql
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {', '.join(parts)}, {body[5:]}"
    return f"WITH {', '.join(parts)} {body}"


# Types of the sample tables: with them, opening a table needs no job that reads a footer.
SCHEMAS = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, "
    "props string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
    "c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
    "p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    reader = spark.read.schema(SCHEMAS[name]) if name in SCHEMAS else spark.read
    return reader.parquet(f"{sf}/{name}.parquet")


def monitor_of(number: Column) -> Column:
    prefix = F.when(number < 3, "MOD-0000").otherwise("MOD-PM-0000")
    return F.concat(prefix, number.cast("string"))


def readings(spark: SparkSession, sf: str) -> DataFrame:
    value, event = F.col("value"), F.col("event_id")
    return table(spark, sf, "events").select(
        "event_id",
        "user_id",
        "event_type",
        monitor_of(F.col("user_id") % 10).alias("monitor"),
        truncate("ts", "minute").alias("timestamp"),
        F.to_date("ts").alias("date"),
        F.hour("ts").alias("hour"),
        F.when(event % 7 != 0, value).alias("pm25"),
        F.when(event % 11 != 0, value * 0.6).alias("pm1"),
        F.when(event % 13 != 0, value * 5.0).alias("pm10"),
        (20 + value / 20).alias("met_temp"),
        (event % 100).cast("double").alias("met_rh"),
        (value / 8).alias("ws"),
        ((event * 37) % 375).cast("double").alias("wd"),
        value.alias("raw_value"),
    )


def _first_minute(df: DataFrame) -> DataFrame:
    return first_per_key(df, ["monitor", "timestamp"], [F.col("event_id")])


def cloud(spark: SparkSession, sf: str) -> DataFrame:
    rows = _first_minute(readings(spark, sf).where(F.col("event_id") % 3 != 0))
    return rows.select(
        "monitor", "timestamp", "date", "hour", "pm25", "pm1", "pm10", "met_temp", "met_rh", "ws",
        "wd", F.when(F.col("pm25").isNotNull(), "cloud").alias("source"),
    )


def card(spark: SparkSession, sf: str) -> DataFrame:
    rows = _first_minute(readings(spark, sf).where(F.col("event_id") % 3 != 1))
    return rows.select(
        "monitor", F.col("timestamp").alias("timestamp_iso"),
        (F.col("raw_value") * 1.1).alias("pm25"), "met_temp", "met_rh", "ws", "wd",
        F.lit("sd_card").alias("source"),
    )


def merged(spark: SparkSession, sf: str) -> DataFrame:
    from fleetfold.operators.merge import merge_feeds

    return merge_feeds(cloud(spark, sf), card(spark, sf), "pm25")


def gas_long(spark: SparkSession, sf: str) -> DataFrame:
    gas = F
    for event, name in GAS_OF_EVENT.items():
        gas = gas.when(F.col("event_type") == event, name)
    rows = readings(spark, sf).withColumn("gas", gas).where(F.col("gas").isNotNull())
    return first_per_key(rows, ["monitor", "timestamp", "gas"], [F.col("event_id")]).select(
        "monitor", "timestamp", "date", "hour", "gas", F.col("pm25").alias("value"),
        F.when(F.col("event_id") % 2 == 0, "cloud").otherwise("sd_card").alias("source"),
    )


def gas_channel(spark: SparkSession, sf: str, gas: str) -> DataFrame:
    return gas_long(spark, sf).where(F.col("gas") == gas).select(
        "monitor", "timestamp", "date", "hour", F.col("value").alias(gas), "source"
    )


def gas_hours(spark: SparkSession, sf: str) -> DataFrame:
    return (
        gas_long(spark, sf)
        .groupBy("monitor", truncate("timestamp", "hour").alias("timestamp"), "date", "hour")
        .agg(*[F.avg(F.when(F.col("gas") == g, F.col("value"))).alias(g) for g in GASES])
        .withColumn("source", F.lit("cloud"))
    )


def hourly(spark: SparkSession, sf: str) -> DataFrame:
    return with_fleet_means(
        hourly_means(readings(spark, sf), "pm25", 2), "pm25", ["date", "hour"], 3
    )


def daily(spark: SparkSession, sf: str) -> DataFrame:
    return with_fleet_means(daily_means(hourly(spark, sf), "pm25", 18), "pm25", ["date"], 3)


def coloc(spark: SparkSession, sf: str) -> DataFrame:
    return (
        readings(spark, sf)
        .groupBy("monitor", truncate("timestamp", "hour").alias("timestamp"), "date", "hour")
        .agg(F.avg("pm25").alias("pm25"))
        .withColumn("source", F.lit("cloud"))
    )


def groups(spark: SparkSession, sf: str) -> DataFrame:
    number = F.col("user_id") % 10
    return readings(spark, sf).where(number < 8).select(
        F.when(number < 6, "original").otherwise("new").alias("group"), "monitor"
    ).distinct()


def roster(spark: SparkSession, sf: str, group: str = "original") -> DataFrame:
    return groups(spark, sf).where(F.col("group") == group).select("monitor")


def sites(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(
        F.concat(F.lit("S"), key.cast("string")).alias("monitor"),
        (-3 + (key * 37 % 101) / 50.0).alias("x"),
        (7 + (key * 53 % 103) / 50.0).alias("y"),
        F.when(key % 9 != 0, F.col("s_acctbal")).alias("value"),
    )


def roads(spark: SparkSession, sf: str) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size") / 1000.0
    x, y = -3 + (key * 17 % 101) / 50.0, 7 + (key * 29 % 103) / 50.0
    kind = (
        F.when(key % 4 == 0, "trunk")
        .when(key % 4 == 1, "residential")
        .when(key % 4 == 2, "tertiary")
        .otherwise("track")
    )
    return table(spark, sf, "part").select(
        key.alias("road_id"), kind.alias("highway"), x.alias("x1"), y.alias("y1"),
        (x + size).alias("x2"), (y + size).alias("y2"),
    )


def cal(spark: SparkSession, sf: str) -> DataFrame:
    """Several calibrations per monitor with ties in date and number of points."""
    n = F.count(F.lit(1))
    counted = (
        readings(spark, sf)
        .where(F.col("event_type") != "error")
        .groupBy((F.col("user_id") % 3).alias("u"), "event_type")
        .agg(n.alias("n_points"), F.max("timestamp").alias("colocation_end"))
    )
    count = F.col("n_points")
    return counted.select(
        F.concat(F.lit("MOD-0000"), F.col("u").cast("string")).alias("monitor"),
        F.lit("pm25").alias("pollutant"),
        F.when(F.col("u") % 4 != 3, 1 + (count % 13).cast("double") / 100).alias("slope"),
        (count % 3).cast("double").alias("intercept"),
        (0.7 + (count % 10) / 50.0).alias("r2"),
        "n_points",
        F.when(
            F.col("event_type") != "view",
            F.date_add(F.lit("2024-02-01").cast("date"), (count % 2).cast("int")),
        ).alias("fitted_on"),
        "colocation_end",
    )


def loo(spark: SparkSession, sf: str, mode: str = "compat") -> DataFrame:
    from fleetfold.functions.calendar import date_hour
    from fleetfold.operators.impute import leave_one_out

    base = hourly(spark, sf).select(
        "monitor", "date", "hour", date_hour("date", "hour").alias("timestamp"), "mean_pm25"
    )
    return leave_one_out(base, "mean_pm25", mode=mode)


def model_hours(spark: SparkSession, sf: str) -> DataFrame:
    """Hours of the devices next to the mean of all raw values as the reference."""
    base = readings(spark, sf)
    devices = (
        base.where(F.col("pm25").isNotNull() & (F.col("user_id") % 10 != 0))
        .groupBy("monitor", "date", "hour")
        .agg(
            F.avg("pm25").alias("mod_pm25"),
            F.avg("met_temp").alias("mod_temp"),
            F.avg("met_rh").alias("mod_rh"),
        )
    )
    reference = base.groupBy("date", "hour").agg(F.avg("raw_value").alias("ref_pm25"))
    return devices.join(reference, ["date", "hour"]).withColumn(
        "season_binary", F.when(F.dayofmonth("date") > 20, 1).otherwise(0)
    )
