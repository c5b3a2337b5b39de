"""Projections, filters and scalar functions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from fleetfold.catalog import fixtures as fx
from fleetfold.catalog.registry import query
from fleetfold.config import Window
from fleetfold.functions import calendar as cal
from fleetfold.functions import columns as col
from fleetfold.operators import calibrate, merge, ordering, reshape, trends


@query(
    "p01_project_known_columns",
    "SELECT monitor, timestamp AS timestamp_iso, pm25 AS value FROM readings",
)
def p01(spark, sf):
    known = reshape.select_known(fx.readings(spark, sf), ["monitor", "timestamp", "pm25", "pm4"])
    return known.withColumnsRenamed({"timestamp": "timestamp_iso", "pm25": "value"})


@query(
    "p02_plausibility_filters",
    """SELECT event_id, pm25, pm10, ws, wd FROM readings
       WHERE pm10 <= 1500 AND pm25 > 0 AND pm25 < 500 AND ws > 0 AND ws < 40
         AND wd >= 0 AND wd <= 360""",
)
def p02(spark, sf):
    return fx.readings(spark, sf).where(
        col.within("pm10", high=1500)
        & col.within("pm25", 0, 500, False, False)
        & col.within("ws", 0, 40, False, False)
        & col.within("wd", 0, 360)
    ).select("event_id", "pm25", "pm10", "ws", "wd")


@query(
    "p03_device_class",
    """SELECT event_id, CASE WHEN contains(monitor, 'MOD-PM') THEN 'MOD-PM' ELSE 'MOD' END
                AS device_class,
              regexp_matches(monitor, '^MOD-[^P]') AS has_gas,
              regexp_matches(monitor, '^MOD-\\d+$') AS plain
       FROM readings""",
)
def p03(spark, sf):
    return fx.readings(spark, sf).select(
        "event_id",
        col.device_class("monitor").alias("device_class"),
        col.is_gas_device("monitor").alias("has_gas"),
        F.col("monitor").rlike(col.PLAIN_DEVICE_PATTERN).alias("plain"),
    )


@query(
    "p04_canonical_monitor",
    """SELECT event_id, regexp_replace(translate(upper(trim(dirty)), '‐–—_', '----'), '\\s+', '', 'g')
                AS monitor
       FROM (SELECT event_id,
                    '  ' || lower(replace(monitor, '-', CASE event_id % 4 WHEN 0 THEN '–'
                      WHEN 1 THEN '_' WHEN 2 THEN '—' ELSE '- ' END)) || ' ' AS dirty
             FROM readings)""",
)
def p04(spark, sf):
    kind = F.col("event_id") % 4
    dash = F.when(kind == 0, "–").when(kind == 1, "_").when(kind == 2, "—").otherwise("- ")
    dirty = F.concat(
        F.lit("  "), F.lower(F.replace("monitor", F.lit("-"), dash)), F.lit(" ")
    )
    return fx.readings(spark, sf).select(
        "event_id", col.canonical_monitor(dirty).alias("monitor")
    )


@query(
    "p05_truncate_to_minute",
    "SELECT event_id, date_trunc('minute', ts) AS minute FROM events",
)
def p05(spark, sf):
    return fx.table(spark, sf, "events").select(
        "event_id", cal.truncate("ts", "minute").alias("minute")
    )


@query("p06_shift_local_time", "SELECT event_id, ts + INTERVAL 3 HOUR AS local_ts FROM events")
def p06(spark, sf):
    return fx.table(spark, sf, "events").select(
        "event_id", cal.shift_hours("ts", 3).alias("local_ts")
    )


@query(
    "p07_floor_to_period",
    """SELECT event_id, date_trunc('hour', ts) AS hour_start,
              CAST(ts AS DATE) - CAST(extract(dow FROM ts) AS INTEGER) AS sunday_week,
              CAST(ts AS DATE) - (CAST(isodow(ts) AS INTEGER) - 1) AS monday_week,
              CAST(date_trunc('month', ts) AS DATE) AS month_start
       FROM events""",
)
def p07(spark, sf):
    day = F.to_date("ts")
    return fx.table(spark, sf, "events").select(
        "event_id",
        cal.truncate("ts", "hour").alias("hour_start"),
        cal.week_start(day).alias("sunday_week"),
        cal.week_start(day, "monday").alias("monday_week"),
        cal.month_start(day).alias("month_start"),
    )


@query(
    "p08_calendar_parts",
    """SELECT event_id, CAST(ts AS DATE) AS date, CAST(extract(hour FROM ts) AS INTEGER) AS hour,
              CAST(extract(day FROM ts) AS INTEGER) AS day,
              CAST(extract(month FROM ts) AS INTEGER) AS month,
              CAST(extract(year FROM ts) AS INTEGER) AS year,
              CAST(isodow(ts) - 1 AS INTEGER) AS dow
       FROM events""",
)
def p08(spark, sf):
    parts = cal.calendar_parts("ts")
    return fx.table(spark, sf, "events").select(
        "event_id", *[c.alias(n) for n, c in parts.items()]
    )


@query(
    "p09_compose_date_hour",
    """SELECT event_id, CAST(date AS TIMESTAMP) + to_hours(CAST(hour AS BIGINT)) AS date_hour
       FROM readings""",
)
def p09(spark, sf):
    return fx.readings(spark, sf).select(
        "event_id", cal.date_hour("date", "hour").alias("date_hour")
    )


@query(
    "p10_dry_season_flag",
    """SELECT o_orderkey, CASE WHEN extract(month FROM o_orderdate) IN (12, 1, 2) THEN 1 ELSE 0 END
                AS season_binary FROM orders""",
)
def p10(spark, sf):
    return fx.table(spark, sf, "orders").select(
        "o_orderkey", cal.dry_season_flag(F.month("o_orderdate")).alias("season_binary")
    )


@query(
    "p11_season_by_dates",
    """SELECT o_orderkey, CASE WHEN CAST(o_orderdate AS DATE) BETWEEN DATE '1996-12-01'
                AND DATE '1997-03-01' THEN 'dry' ELSE 'wet' END AS season FROM orders""",
)
def p11(spark, sf):
    season = cal.season_between(
        F.to_date("o_orderdate"), dt.date(1996, 12, 1), dt.date(1997, 3, 1), "dry", "wet"
    )
    return fx.table(spark, sf, "orders").select("o_orderkey", season.alias("season"))


COOKING_SQL = """CASE WHEN hour BETWEEN 15 AND 18 THEN 'Active Cooking Hours'
    WHEN hour = 3 THEN 'Control Hour' ELSE 'Non-Active Cooking Hours' END"""


@query("p12_cooking_period", f"SELECT event_id, {COOKING_SQL} AS cooking_period FROM readings")
def p12(spark, sf):
    return fx.readings(spark, sf).select(
        "event_id", cal.cooking_period("hour").alias("cooking_period")
    )


@query(
    "p13_cooking_period_detailed",
    """SELECT event_id, CASE WHEN hour BETWEEN 16 AND 19 THEN 'Evening Cooking Hours'
         WHEN hour BETWEEN 5 AND 8 THEN 'Morning Cooking Hours'
         WHEN hour = 3 THEN 'Control Hour' ELSE 'Other Hours' END AS cooking_period,
         CAST(CASE WHEN hour BETWEEN 16 AND 19 THEN 1 WHEN hour BETWEEN 5 AND 8 THEN 2
              WHEN hour = 3 THEN 3 ELSE 4 END AS INTEGER) AS position
       FROM readings""",
)
def p13(spark, sf):
    label = cal.cooking_period_detailed("hour")
    order = ["Evening Cooking Hours", "Morning Cooking Hours", "Control Hour", "Other Hours"]
    return fx.readings(spark, sf).select(
        "event_id", label.alias("cooking_period"), trends.order_labels(label, order).alias("position")
    )


@query(
    "p14_cook_time_filter",
    """SELECT event_id, hour, hour >= 15 AND hour < 18 AS early FROM readings
       WHERE hour >= 16 AND hour < 20""",
)
def p14(spark, sf):
    return fx.readings(spark, sf).where(cal.in_cook_time("hour")).select(
        "event_id", "hour", cal.in_cook_time("hour", 15, 18).alias("early")
    )


@query(
    "p15_aqi_class",
    """SELECT event_id, CASE WHEN pm25 < 9 THEN 'Good' WHEN pm25 < 35.4 THEN 'Moderate'
         WHEN pm25 < 55.4 THEN 'Unhealthy for Sensitive Groups' WHEN pm25 < 125.4 THEN 'Unhealthy'
         WHEN pm25 < 225.4 THEN 'Very Unhealthy' WHEN pm25 IS NOT NULL THEN 'Hazardous' END
         AS aqi FROM readings""",
)
def p15(spark, sf):
    return fx.readings(spark, sf).select("event_id", col.aqi_class("pm25").alias("aqi"))


@query(
    "p16_hour_angle",
    """SELECT event_id, round(sin(2 * pi() * hour / 24), 8) + 0.0 AS sin_hour,
              round(cos(2 * pi() * hour / 24), 8) + 0.0 AS cos_hour FROM readings""",
)
def p16(spark, sf):
    sine, cosine = cal.hour_angle("hour")
    return fx.readings(spark, sf).select(
        "event_id",
        (F.round(sine, 8) + 0.0).alias("sin_hour"),
        (F.round(cosine, 8) + 0.0).alias("cos_hour"),
    )


@query(
    "p17_coalesce_channels",
    "SELECT event_id, coalesce(pm25, pm1, pm10) AS best FROM readings",
)
def p17(spark, sf):
    df = fx.readings(spark, sf)
    return df.select(
        "event_id", reshape.coalesce_known(df, ["pm4", "pm25", "pm1", "pm10"]).alias("best")
    )


@query(
    "p18_inverse_linear",
    """SELECT event_id, (pm25 - 1.5) / nullif(CAST(event_id % 5 AS DOUBLE) / 2, 0) AS corrected
       FROM readings""",
)
def p18(spark, sf):
    slope = (F.col("event_id") % 5).cast("double") / 2
    return fx.readings(spark, sf).select(
        "event_id", col.inverse_linear("pm25", slope, F.lit(1.5)).alias("corrected")
    )


CORRECTED_SQL = """
    recent AS (SELECT * FROM cal QUALIFY row_number() OVER (PARTITION BY monitor
        ORDER BY coalesce(fitted_on, CAST(colocation_end AS DATE)) DESC NULLS LAST,
                 n_points DESC NULLS LAST, r2 DESC NULLS LAST) = 1),
    corrected AS (SELECT m.*, c.slope IS NOT NULL AND c.slope <> 0 AS usable,
        CASE WHEN c.slope IS NOT NULL AND c.slope <> 0 THEN (m.pm25 - c.intercept) / c.slope
             ELSE m.pm25 END AS value
        FROM merged m LEFT JOIN recent c ON m.monitor = c.monitor)"""


@query(
    "p19_minimum_value_counts",
    f"""WITH {CORRECTED_SQL}
        SELECT count(*) FILTER (value < 1) AS n_low_corrected,
               count(*) FILTER (pm25 < 1) AS n_low_raw FROM corrected""",
)
def p19(spark, sf):
    return calibrate.replacement_counts(fx.merged(spark, sf), fx.cal(spark, sf), "pm25")


@query(
    "p20_clamp_delta_ratio",
    """SELECT event_id, greatest(pm25 - 30, 0.0::DOUBLE) AS clamped,
              greatest(pm25 - 30, 0.0::DOUBLE) - pm1 AS delta,
              CASE WHEN pm1 > 0 THEN greatest(pm25 - 30, 0.0::DOUBLE) / pm1 END AS ratio
       FROM readings WHERE pm25 IS NOT NULL""",
)
def p20(spark, sf):
    clamped = col.clamp_at_zero(F.col("pm25") - 30)
    return fx.readings(spark, sf).where("pm25 IS NOT NULL").select(
        "event_id",
        clamped.alias("clamped"),
        (clamped - F.col("pm1")).alias("delta"),
        col.guarded_ratio(clamped, "pm1").alias("ratio"),
    )


@query(
    "p21_nan_to_null",
    "SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN pm25 END AS pm25 FROM readings",
)
def p21(spark, sf):
    broken = F.when(F.col("event_id") % 5 == 0, float("nan")).otherwise(F.col("pm25"))
    return fx.readings(spark, sf).select("event_id", col.nan_to_null(broken).alias("pm25"))


@query(
    "p22_source_null_if_all_null",
    """SELECT event_id, CASE WHEN coalesce(pm25, pm1, pm10) IS NOT NULL THEN event_type END AS source
       FROM readings""",
)
def p22(spark, sf):
    return fx.readings(spark, sf).select(
        "event_id", col.null_if_all_null("event_type", ["pm25", "pm1", "pm10"]).alias("source")
    )


@query(
    "p23_gps_repair",
    """SELECT s_suppkey, round_even(lat, 4) AS geo_lat, round_even(fixed, 4) AS geo_lon
       FROM (SELECT s_suppkey, s_acctbal / 700 AS lat,
                    CASE WHEN s_suppkey % 10 = 1 THEN -1.73058 ELSE s_acctbal / 3000 - 2 END AS fixed
             FROM supplier)
       WHERE round_even(lat, 4) BETWEEN 4 AND 12 AND round_even(fixed, 4) BETWEEN -4 AND 2""",
)
def p23(spark, sf):
    broken = F.when(F.col("s_suppkey") % 10 == 1, -173058.0).otherwise(
        F.col("s_acctbal") / 3000 - 2
    )
    lat, lon = col.repair_position(F.col("s_acctbal") / 700, broken, {-173058.0: -1.73058})
    fixed = fx.table(spark, sf, "supplier").select(
        "s_suppkey", lat.alias("geo_lat"), lon.alias("geo_lon")
    )
    return fixed.where(col.in_box("geo_lat", "geo_lon", (4, 12, -4, 2)))


@query(
    "p24_place_names",
    """SELECT n_nationkey, CASE WHEN village = 'China' THEN 'Chinaa' ELSE village END AS village,
              CASE WHEN contains(n_name, 'I') THEN village || ', Town' ELSE village END AS label
       FROM (SELECT n_nationkey, n_name, array_to_string(list_transform(string_split(n_name, ' '),
                    lambda w: upper(w[1]) || lower(w[2:])), ' ') AS village FROM nation)""",
)
def p24(spark, sf):
    raw = F.concat(F.lower("n_name"), F.lit(" (old site)"))
    plain = col.clean_place(raw, {})
    return fx.table(spark, sf, "nation").select(
        "n_nationkey",
        col.clean_place(raw, {"China": "Chinaa"}).alias("village"),
        F.when(F.contains("n_name", F.lit("I")), F.concat_ws(", ", plain, F.lit("Town")))
        .otherwise(plain)
        .alias("label"),
    )


@query(
    "p25_raw_or_corrected_by_fleet",
    """SELECT event_id, CASE WHEN r.monitor IN (SELECT monitor FROM groups WHERE "group" = 'original')
                THEN pm25 ELSE pm1 END AS chosen FROM readings r""",
)
def p25(spark, sf):
    df = fx.readings(spark, sf).withColumn("pm25_raw", F.col("pm1"))
    chosen = calibrate.use_raw_for(df, "pm25", fx.roster(spark, sf), "chosen")
    return chosen.select("event_id", "chosen")


FIRST = Window("first", dt.date(2024, 1, 3), dt.date(2024, 1, 10), "original")
SECOND = Window("second", dt.date(2024, 1, 12), dt.date(2024, 1, 20), "new")

PHASE_SQL = """
    SELECT event_id, fleet, CASE
      WHEN fleet = 'original' AND date BETWEEN DATE '2024-01-03' AND DATE '2024-01-10'
        THEN 'w1_colocation'
      WHEN fleet = 'original' AND date > DATE '2024-01-10' THEN 'community'
      WHEN fleet = 'new' AND date BETWEEN DATE '2024-01-12' AND DATE '2024-01-20'
        THEN 'w2_colocation'
      WHEN fleet = 'new' AND date > DATE '2024-01-20' THEN 'community' ELSE 'other' END AS phase
    FROM (SELECT r.event_id, r.date, coalesce(g."group", 'unknown') AS fleet
          FROM readings r LEFT JOIN groups g ON r.monitor = g.monitor)"""


@query("p26_tag_fleet_phase", PHASE_SQL)
def p26(spark, sf):
    return calibrate.tag_fleet_phase(
        fx.readings(spark, sf), fx.groups(spark, sf), FIRST, SECOND
    ).select("event_id", "fleet", "phase")


@query("p27_community_rows", f"SELECT * FROM ({PHASE_SQL}) WHERE phase IN ('community', 'other')")
def p27(spark, sf):
    return p26(spark, sf).where(F.col("phase").isin("community", "other"))


@query(
    "p28_log_significant",
    """SELECT event_id, round(ln(raw_value), 8) AS log_value, round_even(raw_value, 1) AS rounded,
              round_even(raw_value * pow(10.0::DOUBLE, 2 - floor(log10(abs(raw_value)))), 0)
                / pow(10.0::DOUBLE, 2 - floor(log10(abs(raw_value)))) AS signif
       FROM readings""",
)
def p28(spark, sf):
    return fx.readings(spark, sf).select(
        "event_id",
        F.round(F.log("raw_value"), 8).alias("log_value"),
        F.bround("raw_value", 1).alias("rounded"),
        col.significant("raw_value", 3).alias("signif"),
    )


# a model is trained on the device hours of four days of five, and applied to all readings
TRAINING_DAYS_SQL = """
    SELECT date FROM (SELECT date, row_number() OVER (ORDER BY md5('123|' || CAST(date AS VARCHAR)))
                               > floor(0.2 * count(*) OVER ()) AS training
                      FROM (SELECT DISTINCT date FROM model_hours)) WHERE training"""

EXTRAPOLATION_SQL = f"""
    SELECT r.event_id, r.monitor, pm25 IS NOT NULL AND (pm25 < lp OR pm25 > hp) AS out_pm25,
           met_temp < lt OR met_temp > ht AS out_met_temp
    FROM readings r, (SELECT min(mod_pm25) AS lp, max(mod_pm25) AS hp, min(mod_temp) AS lt,
                             max(mod_temp) AS ht
                      FROM model_hours WHERE date IN ({TRAINING_DAYS_SQL})) t"""


@query(
    "p29_extrapolation_flags",
    f"SELECT *, out_pm25 OR out_met_temp AS any_extrapolation FROM ({EXTRAPOLATION_SQL})",
)
def p29(spark, sf):
    return flagged(spark, sf).select(
        "event_id", "monitor", "out_pm25", "out_met_temp", "any_extrapolation"
    )


def flagged(spark, sf):
    df = fx.readings(spark, sf)
    names = ["pm25", "met_temp"]
    hours = fx.model_hours(spark, sf).select("date", F.col("mod_pm25").alias("pm25"), F.col("mod_temp").alias("met_temp"))
    train = ordering.day_block_split(hours, "date").where(F.col("split_day_block") == "train")
    ranges = trends.training_ranges(train, names)
    return trends.flag_extrapolation(df, ranges, names)


@query(
    "p30_bit_unpack",
    """SELECT event_id,
              CAST(hi * 4 + (lo & 3) AS INTEGER) AS adc1,
              CAST(hi * 4 + ((lo >> 2) & 3) AS INTEGER) AS adc2,
              CAST(hi * 4 + ((lo >> 6) & 3) AS INTEGER) AS adc4,
              ((hi * 4 + (lo & 3)) * 10 / 1024::DOUBLE - 2.0::DOUBLE) * 20 AS temp_c
       FROM (SELECT event_id, CAST(event_id % 256 AS INTEGER) AS lo,
                    CAST(user_id % 200 AS INTEGER) AS hi FROM events)""",
)
def p30(spark, sf):
    low = (F.col("event_id") % 256).cast("int")
    high = (F.col("user_id") % 200).cast("int")
    first = col.adc_value(low, high, 1)
    return fx.table(spark, sf, "events").select(
        "event_id",
        first.alias("adc1"),
        col.adc_value(low, high, 2).alias("adc2"),
        col.adc_value(low, high, 4).alias("adc4"),
        ((col.adc_volts(first) - 2.0) * 20).alias("temp_c"),
    )


@query(
    "p31_complete_flags",
    """SELECT monitor, date, hour, CAST(n_minute_obs > 2 AS INTEGER) AS strict,
              CAST(n_minute_obs >= 2 AS INTEGER) AS loose FROM hourly""",
)
def p31(spark, sf):
    from fleetfold.operators.completeness import enough

    return fx.hourly(spark, sf).select(
        "monitor", "date", "hour",
        enough("n_minute_obs", 2, True).alias("strict"),
        enough("n_minute_obs", 2).alias("loose"),
    )


@query(
    "p32_road_groups",
    """SELECT road_id, CASE WHEN highway IN ('secondary', 'trunk', 'tertiary') THEN 'City Connection'
         WHEN highway = 'residential' THEN 'Residential' ELSE 'Other' END AS road_group,
         CASE WHEN highway IN ('track') THEN 'Not Main Road' ELSE 'Main Road' END AS main_road
       FROM roads""",
)
def p32(spark, sf):
    return fx.roads(spark, sf).select(
        "road_id",
        col.road_group("highway").alias("road_group"),
        F.when(F.col("highway").isin("track"), "Not Main Road")
        .otherwise("Main Road")
        .alias("main_road"),
    )


@query(
    "p33_days_since",
    """SELECT event_id, CAST(date_diff('day', CAST(ts AS DATE), DATE '2024-09-01') AS INTEGER)
                AS days FROM events""",
)
def p33(spark, sf):
    return fx.table(spark, sf, "events").select(
        "event_id", cal.days_since("ts", dt.date(2024, 9, 1)).alias("days")
    )


@query(
    "p34_manual_positions",
    """SELECT monitor, CASE WHEN monitor IN ('S9', 'S18') AND value IS NULL THEN 8.06::DOUBLE
                ELSE value END AS geo_lat,
              CASE WHEN monitor IN ('S9', 'S18') AND value IS NULL THEN -1.73::DOUBLE
                ELSE value END AS geo_lon,
              CASE WHEN monitor = 'S9' THEN 'manual_match' WHEN monitor = 'S18' THEN 'manual_fallback'
                END AS coord_source
       FROM sites""",
)
def p34(spark, sf):
    known = fx.sites(spark, sf).select(
        "monitor",
        F.col("value").alias("geo_lat"),
        F.col("value").alias("geo_lon"),
        F.lit(None).cast("string").alias("coord_source"),
    )
    return merge.override_positions(
        known, {"S9": (8.06, -1.73, "manual_match"), "S18": (8.06, -1.73, "manual_fallback")}
    )
