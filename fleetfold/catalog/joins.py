"""Merging feeds, joining channels and dimensions, set operations, reshaping."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from fleetfold.catalog import fixtures as fx
from fleetfold.catalog.registry import query
from fleetfold.functions.calendar import moment
from fleetfold.operators import calibrate, completeness, merge, ordering, reshape, rollup, spatial
from fleetfold.operators.models import hours_to_calibrate
from fleetfold.session import settle


@query("j01_merge_full_priority", "SELECT * FROM merged")
def j01(spark, sf):
    return fx.merged(spark, sf)


@query(
    "j01_merge_full_with_duplicates",
    """SELECT coalesce(c.monitor, s.monitor) AS monitor, coalesce(c.timestamp, s.timestamp)
                AS timestamp, c.date, c.hour, coalesce(c.pm25, s.pm25) AS pm25,
              CASE WHEN c.pm25 IS NOT NULL THEN 'cloud' WHEN s.pm25 IS NOT NULL THEN 'sd_card' END
                AS source
       FROM (SELECT * FROM readings WHERE event_id % 3 <> 0) c
       FULL JOIN (SELECT * FROM readings WHERE event_id % 3 <> 1) s
         ON c.monitor = s.monitor AND c.timestamp = s.timestamp""",
)
def j01_duplicates(spark, sf):
    df = fx.readings(spark, sf)
    card = df.where("event_id % 3 <> 1").withColumnRenamed("timestamp", "timestamp_iso")
    return merge.merge_feeds(df.where("event_id % 3 <> 0"), card, "pm25", unique=False)


LEFT_SQL = """
    SELECT c.monitor, c.timestamp, c.date, c.hour, coalesce(c.{v}, s.{v}) AS {v},
           coalesce(c.source, s.source) AS source
    FROM cloud c LEFT JOIN card s ON c.monitor = s.monitor AND c.timestamp = s.timestamp_iso"""


@query("j02_merge_left_gas", LEFT_SQL.format(v="pm25"))
def j02(spark, sf):
    return merge.merge_feeds(
        fx.cloud(spark, sf), fx.card(spark, sf), "pm25", how="left", label="source"
    )


@query("j03_merge_left_weather", LEFT_SQL.format(v="met_temp"))
def j03(spark, sf):
    return merge.merge_feeds(
        fx.cloud(spark, sf), fx.card(spark, sf), "met_temp", how="left", label="source"
    )


@query(
    "j04_merge_full_with_calendar",
    """SELECT monitor, timestamp, CAST(timestamp AS DATE) AS date,
              CAST(extract(hour FROM timestamp) AS INTEGER) AS hour, pm25, source FROM merged""",
)
def j04(spark, sf):
    return merge.merge_feeds(
        fx.cloud(spark, sf), fx.card(spark, sf), "pm25", derive_calendar=True
    )


@query(
    "j05_combine_any_source",
    """SELECT monitor, timestamp, co, no, no2, o3, coalesce(s1, s2, s3, s4) AS source_any
       FROM (SELECT monitor, timestamp, value AS co, source AS s1 FROM gas_long WHERE gas = 'co') a
       FULL JOIN (SELECT monitor, timestamp, value AS no, source AS s2 FROM gas_long
                  WHERE gas = 'no') b USING (monitor, timestamp)
       FULL JOIN (SELECT monitor, timestamp, value AS no2, source AS s3 FROM gas_long
                  WHERE gas = 'no2') c USING (monitor, timestamp)
       FULL JOIN (SELECT monitor, timestamp, value AS o3, source AS s4 FROM gas_long
                  WHERE gas = 'o3') d USING (monitor, timestamp)""",
)
def j05(spark, sf):
    return merge.combine_with_any_source({g: fx.gas_channel(spark, sf, g) for g in fx.GASES})


@query(
    "j06_natural_full_join",
    """SELECT monitor, timestamp, date, hour, co, no, no2, o3,
              CASE WHEN coalesce(co, no, no2, o3) IS NOT NULL THEN source END AS source
       FROM (SELECT monitor, timestamp, date, hour, source, value AS co FROM gas_long
             WHERE gas = 'co') a
       FULL JOIN (SELECT monitor, timestamp, date, hour, source, value AS no FROM gas_long
             WHERE gas = 'no') b USING (monitor, timestamp, date, hour, source)
       FULL JOIN (SELECT monitor, timestamp, date, hour, source, value AS no2 FROM gas_long
             WHERE gas = 'no2') c USING (monitor, timestamp, date, hour, source)
       FULL JOIN (SELECT monitor, timestamp, date, hour, source, value AS o3 FROM gas_long
             WHERE gas = 'o3') d USING (monitor, timestamp, date, hour, source)""",
)
def j06(spark, sf):
    return merge.combine_naturally({g: fx.gas_channel(spark, sf, g) for g in fx.GASES})


def _hour_table(spark, sf, value, minimum=2):
    return rollup.hourly_means(fx.readings(spark, sf), value, minimum).drop("n_minute_obs")


@query(
    "j07_left_join_summaries",
    """SELECT monitor, date, hour, round(a.m, 9) AS mean_pm25, round(b.m, 9) AS mean_pm1,
              round(c.m, 9) AS mean_pm10
       FROM (SELECT monitor, date, hour, CASE WHEN count(pm25) >= 2 THEN avg(pm25) END AS m
             FROM readings GROUP BY ALL) a
       LEFT JOIN (SELECT monitor, date, hour, CASE WHEN count(pm1) >= 2 THEN avg(pm1) END AS m
             FROM readings GROUP BY ALL) b USING (monitor, date, hour)
       LEFT JOIN (SELECT monitor, date, hour, CASE WHEN count(pm10) >= 2 THEN avg(pm10) END AS m
             FROM readings GROUP BY ALL) c USING (monitor, date, hour)""",
)
def j07(spark, sf):
    joined = merge.left_join_summaries(
        _hour_table(spark, sf, "pm25"),
        [_hour_table(spark, sf, "pm1"), _hour_table(spark, sf, "pm10")],
        ["monitor", "date", "hour"],
    )
    return joined.select(
        "monitor", "date", "hour",
        *[F.round(c, 9).alias(c) for c in ("mean_pm25", "mean_pm1", "mean_pm10")],
    )


@query(
    "j08_outer_chain_hours",
    """SELECT monitor, date, hour, round(mod_pm25, 9) AS mod_pm25, round(mod_temp, 9) AS mod_temp,
              round(mod_rh, 9) AS mod_rh
       FROM (SELECT monitor, date, hour, avg(pm25) AS mod_pm25 FROM readings
             WHERE event_type = 'click' AND pm25 IS NOT NULL GROUP BY ALL) a
       FULL JOIN (SELECT monitor, date, hour, avg(met_temp) AS mod_temp FROM readings
             WHERE event_type = 'view' GROUP BY ALL) b USING (monitor, date, hour)
       FULL JOIN (SELECT monitor, date, hour, avg(met_rh) AS mod_rh FROM readings
             WHERE event_type = 'signup' GROUP BY ALL) c USING (monitor, date, hour)""",
)
def j08(spark, sf):
    df = fx.readings(spark, sf)

    def hours(event, value, name):
        rows = df.where(F.col("event_type") == event)
        return rows.groupBy("monitor", "date", "hour").agg(F.avg(value).alias(name))

    wide = hours_to_calibrate(
        {
            "mod_pm25": hours("click", "pm25", "mod_pm25"),
            "mod_temp": hours("view", "met_temp", "mod_temp"),
            "mod_rh": hours("signup", "met_rh", "mod_rh"),
        }
    )
    return wide.select(
        "monitor", "date", "hour",
        *[F.round(c, 9).alias(c) for c in ("mod_pm25", "mod_temp", "mod_rh")],
    )


RECENT_SQL = """
    SELECT monitor, slope, intercept, r2, n_points FROM cal
    QUALIFY row_number() OVER (PARTITION BY monitor
      ORDER BY coalesce(fitted_on, CAST(colocation_end AS DATE)) DESC, n_points DESC, r2 DESC) = 1"""


@query(
    "j09_coefficient_lookup",
    f"""SELECT r.event_id, c.slope, c.intercept FROM readings r
        LEFT JOIN ({RECENT_SQL}) c ON r.monitor = c.monitor""",
)
def j09(spark, sf):
    coefs = calibrate.most_recent_fit(fx.cal(spark, sf), "pm25")
    return (
        fx.readings(spark, sf)
        .join(settle(coefs.select("monitor", "slope", "intercept")), "monitor", "left")
        .select("event_id", "slope", "intercept")
    )


@query(
    "j10_readings_with_fleet_average",
    """SELECT c.monitor, c.timestamp, round(c.pm25, 9) AS pm25, f.n_active, round(f.fleet_avg, 9) AS fleet_avg
       FROM coloc c JOIN (SELECT timestamp, count(pm25) AS n_active, avg(pm25) AS fleet_avg
                          FROM coloc GROUP BY 1 HAVING count(pm25) >= 3) f USING (timestamp)""",
)
def j10(spark, sf):
    df = fx.coloc(spark, sf)
    joined = df.join(calibrate.fleet_average(df, "pm25", 3), "timestamp")
    return joined.select(
        "monitor", "timestamp", F.round("pm25", 9).alias("pm25"), "n_active",
        F.round("fleet_avg", 9).alias("fleet_avg"),
    )


@query(
    "j11_readings_with_corrected_reference",
    f"""SELECT c.monitor, c.timestamp, round(c.pm25, 9) AS pm25,
               round((r.pm25 - p.intercept) / p.slope, 9) AS ref_corr
        FROM coloc c JOIN coloc r ON c.timestamp = r.timestamp AND r.monitor = 'MOD-00000'
        JOIN ({RECENT_SQL}) p ON p.monitor = 'MOD-00000'""",
)
def j11(spark, sf):
    df = fx.coloc(spark, sf)
    reference = calibrate.corrected_reference(df, "pm25", fx.REFERENCE, fx.cal(spark, sf))
    return df.join(reference, "timestamp").select(
        "monitor", "timestamp", F.round("pm25", 9).alias("pm25"),
        F.round("ref_corr", 9).alias("ref_corr"),
    )


@query(
    "j12_reference_monitor_channels",
    """SELECT g.monitor, g.timestamp, round(g.co, 9) AS co, round(g.o3, 9) AS o3,
              round(r.co, 9) AS reference_co, round(r.o3, 9) AS reference_o3
       FROM gas_hours g LEFT JOIN gas_hours r
         ON g.timestamp = r.timestamp AND r.monitor = 'MOD-00000'""",
)
def j12(spark, sf):
    joined = calibrate.with_reference_channels(
        fx.gas_hours(spark, sf), fx.REFERENCE, ["co", "o3"]
    )
    values = ("co", "o3", "reference_co", "reference_o3")
    return joined.select("monitor", "timestamp", *[F.round(c, 9).alias(c) for c in values])


@query(
    "j13_restrict_to_fleet",
    """SELECT event_id, monitor FROM readings
       WHERE monitor IN (SELECT monitor FROM groups WHERE "group" = 'original')""",
)
def j13(spark, sf):
    return merge.restrict_to(fx.readings(spark, sf), fx.roster(spark, sf)).select(
        "event_id", "monitor"
    )


@query(
    "j14_new_monitors",
    """SELECT DISTINCT monitor FROM readings
       WHERE date BETWEEN DATE '2024-01-05' AND DATE '2024-01-12'
         AND monitor NOT IN (SELECT monitor FROM groups WHERE "group" = 'original')""",
)
def j14(spark, sf):
    return merge.new_monitors(
        fx.readings(spark, sf), fx.roster(spark, sf), dt.date(2024, 1, 5), dt.date(2024, 1, 12)
    )


@query(
    "j15_missing_from_feed",
    """SELECT DISTINCT monitor, date FROM readings WHERE user_id % 10 < 7
       UNION ALL SELECT DISTINCT monitor, NULL::DATE FROM readings WHERE user_id % 10 >= 7""",
)
def j15(spark, sf):
    df = fx.readings(spark, sf)
    inventory = df.where("user_id % 10 < 7").select("monitor", "date").distinct()
    return merge.with_missing_monitors(inventory, df)


@query(
    "j16_fleet_average_back_join",
    """SELECT monitor, date, hour, n_minute_obs, round(mean_pm25, 9) AS mean_pm25, n_active,
              round(fleet_average_pm25, 9) AS fleet_average_pm25 FROM hourly""",
)
def j16(spark, sf):
    hours = rollup.hourly_means(fx.readings(spark, sf), "pm25", 2)
    fleet = rollup.fleet_means(hours, "pm25", ["date", "hour"], 3)
    return hours.join(fleet, ["date", "hour"], "left").select(
        "monitor", "date", "hour", "n_minute_obs", F.round("mean_pm25", 9).alias("mean_pm25"),
        "n_active", F.round("fleet_average_pm25", 9).alias("fleet_average_pm25"),
    )


@query(
    "j17_valid_since",
    """SELECT event_id, r.monitor, date FROM readings r LEFT JOIN
         (SELECT monitor, min(date) + CAST(count(*) % 15 AS INTEGER) AS start_date FROM readings
          WHERE user_id % 10 < 5 GROUP BY monitor) s ON r.monitor = s.monitor
       WHERE date >= start_date OR start_date IS NULL""",
)
def j17(spark, sf):
    df = fx.readings(spark, sf)
    starts = (
        df.where("user_id % 10 < 5")
        .groupBy("monitor")
        .agg(
            F.date_add(F.min("date"), (F.count(F.lit(1)) % 15).cast("int")).alias("start_date")
        )
    )
    return merge.valid_since(df, starts).select("event_id", "monitor", "date")


@query(
    "j18_device_and_reference_hours",
    """SELECT monitor, date, hour, round(mod_pm25, 9) AS mod_pm25, round(ref_pm25, 9) AS ref_pm25
       FROM model_hours""",
)
def j18(spark, sf):
    return fx.model_hours(spark, sf).select(
        "monitor", "date", "hour",
        *[F.round(c, 9).alias(c) for c in ("mod_pm25", "ref_pm25")],
    )


@query(
    "j19_dimension_right_join",
    """SELECT d.monitor, c.n FROM (SELECT monitor, count(*) AS n FROM readings
         WHERE user_id % 10 < 6 GROUP BY 1) c
       RIGHT JOIN (SELECT DISTINCT monitor FROM readings) d ON c.monitor = d.monitor""",
)
def j19(spark, sf):
    df = fx.readings(spark, sf)
    counts = df.where("user_id % 10 < 6").groupBy("monitor").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(df.select("monitor").distinct(), "monitor", "right")


def _site_table(spark, sf):
    """Suppliers as sites: every third one is the '(new)' twin of another and lacks a position."""
    key = F.col("s_suppkey")
    twin = key % 3 == 0
    return fx.table(spark, sf, "supplier").select(
        F.concat(F.lit("S"), key.cast("string")).alias("monitor"),
        F.concat(
            F.lit("place "), (key / 3).cast("bigint").cast("string"), F.when(twin, " (new)").otherwise("")
        ).alias("description"),
        F.when(~twin, F.col("s_acctbal")).alias("geo_lat"),
        F.when(~twin, -F.col("s_acctbal")).alias("geo_lon"),
        F.when(~twin, key).alias("households"),
        (key * 2).alias("population"),
        F.when(~twin, "monitor_data").alias("coord_source"),
    )


@query(
    "j20_site_fallback",
    """WITH s AS (SELECT 'S' || CAST(s_suppkey AS VARCHAR) AS monitor,
           'place ' || CAST(CAST(floor(s_suppkey / 3) AS BIGINT) AS VARCHAR)
             || CASE WHEN s_suppkey % 3 = 0 THEN ' (new)' ELSE '' END AS description,
           CASE WHEN s_suppkey % 3 <> 0 THEN s_acctbal END AS geo_lat,
           CASE WHEN s_suppkey % 3 <> 0 THEN -s_acctbal END AS geo_lon,
           CASE WHEN s_suppkey % 3 <> 0 THEN s_suppkey END AS households,
           s_suppkey * 2 AS population,
           CASE WHEN s_suppkey % 3 <> 0 THEN 'monitor_data' END AS coord_source FROM supplier),
         b AS (SELECT *, replace(description, ' (new)', '') AS base FROM s),
         l AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY description ORDER BY monitor) = 1)
       SELECT b.monitor, b.description, coalesce(b.geo_lat, l.geo_lat) AS geo_lat,
              coalesce(b.geo_lon, l.geo_lon) AS geo_lon,
              coalesce(b.households, l.households) AS households,
              coalesce(b.population, l.population) AS population,
              CASE WHEN b.coord_source IS NULL AND coalesce(b.geo_lat, l.geo_lat) IS NOT NULL
                     AND coalesce(b.geo_lon, l.geo_lon) IS NOT NULL AND b.description <> b.base
                   THEN 'matched_to_same_site' ELSE b.coord_source END AS coord_source
       FROM b LEFT JOIN l ON b.base = l.description""",
)
def j20(spark, sf):
    sites = _site_table(spark, sf)
    replacements = (
        sites.where(F.col("description").contains("(new)"))
        .select(
            "description",
            F.replace("description", F.lit(" (new)"), F.lit("")).alias("base_description"),
        )
        .distinct()
    )
    return merge.fill_from_same_site(sites, replacements)


@query(
    "j21_full_calendar",
    """SELECT m.monitor, g.date, coalesce(n, 0) AS n
       FROM (SELECT DISTINCT monitor FROM readings) m,
            (SELECT CAST(unnest(generate_series(TIMESTAMP '2023-12-25', TIMESTAMP '2024-02-05',
                    INTERVAL 1 DAY)) AS DATE) AS date) g
       LEFT JOIN (SELECT monitor, date, count(pm25) AS n FROM readings GROUP BY 1, 2) c
         ON c.monitor = m.monitor AND c.date = g.date""",
)
def j21(spark, sf):
    df = fx.readings(spark, sf)
    counts = df.groupBy("monitor", "date").agg(F.count("pm25").alias("n"))
    calendar = merge.full_calendar(
        df, "date", F.lit(dt.date(2023, 12, 25)), F.lit(dt.date(2024, 2, 5)), "1 day"
    )
    return merge.on_calendar(counts, calendar, ["monitor", "date"], {"n": 0})


@query(
    "j21_own_calendar",
    """SELECT s.monitor, s.date, c.n FROM (
         SELECT monitor, CAST(unnest(generate_series(CAST(min(date) AS TIMESTAMP),
                CAST(max(date) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS date
         FROM readings GROUP BY monitor) s
       LEFT JOIN (SELECT monitor, date, count(*) AS n FROM readings GROUP BY 1, 2) c
         ON c.monitor = s.monitor AND c.date = s.date""",
)
def j21_own(spark, sf):
    counts = (
        fx.readings(spark, sf).groupBy("monitor", "date")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    calendar = merge.own_calendar(counts, "date", "1 day")
    return merge.on_calendar(counts, calendar, ["monitor", "date"], {})


SEGMENT_SQL = """
    SELECT s.monitor, r.road_id, r.highway, r.x1, r.y1, r.x2, r.y2, s.x, s.y,
           least(greatest(((s.x - r.x1) * (r.x2 - r.x1) + (s.y - r.y1) * (r.y2 - r.y1))
             / ((r.x2 - r.x1) * (r.x2 - r.x1) + (r.y2 - r.y1) * (r.y2 - r.y1)), 0), 1) AS t
    FROM sites s, roads r"""


@query(
    "j22_nearest_road",
    f"""SELECT monitor, road_id, highway, round(d, 9) AS distance_to_road
        FROM (SELECT *, sqrt(pow(x - x1 - t * (x2 - x1), 2) + pow(y - y1 - t * (y2 - y1), 2)) AS d
              FROM ({SEGMENT_SQL}))
        QUALIFY row_number() OVER (PARTITION BY monitor ORDER BY round(d, 12), road_id) = 1""",
)
def j22(spark, sf):
    near = spatial.nearest_segment(fx.sites(spark, sf), fx.roads(spark, sf))
    return near.select(
        "monitor", "road_id", "highway", F.round("distance_to_road", 9).alias("distance_to_road")
    )


@query(
    "j23_road_length_nearby",
    """SELECT s.monitor, round(coalesce(sum(CASE WHEN a > 0 AND b * b - a * c > 0 THEN
           sqrt(a) * greatest(least((-b + sqrt(b * b - a * c)) / a, 1)
                              - greatest((-b - sqrt(b * b - a * c)) / a, 0), 0) END), 0), 9)
         AS total_length
       FROM sites s LEFT JOIN (
         SELECT s.monitor, pow(r.x2 - r.x1, 2) + pow(r.y2 - r.y1, 2) AS a,
                (r.x2 - r.x1) * (r.x1 - s.x) + (r.y2 - r.y1) * (r.y1 - s.y) AS b,
                pow(r.x1 - s.x, 2) + pow(r.y1 - s.y, 2) - 0.05::DOUBLE * 0.05::DOUBLE AS c
         FROM sites s, roads r) p ON p.monitor = s.monitor AND a > 0 AND b * b - a * c > 0
       GROUP BY s.monitor""",
)
def j23(spark, sf):
    near = spatial.road_length_within(fx.sites(spark, sf), fx.roads(spark, sf), 0.05)
    return near.select("monitor", F.round("total_length", 9).alias("total_length"))


@query(
    "j24_nearest_neighbours",
    """SELECT monitor, neighbour, rank, round(distance, 9) AS distance FROM (
         SELECT a.monitor, b.monitor AS neighbour, CAST(row_number() OVER (PARTITION BY a.monitor
                  ORDER BY sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), b.monitor) AS INTEGER)
                  AS rank,
                sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS distance
         FROM sites a JOIN sites b ON a.monitor <> b.monitor) WHERE rank <= 5""",
)
def j24(spark, sf):
    near = spatial.nearest_neighbours(fx.sites(spark, sf), 5)
    return near.select("monitor", "neighbour", "rank", F.round("distance", 9).alias("distance"))


@query(
    "j25_offline_filter",
    """SELECT monitor, date, hour, offline_monitors, round(mean_pm25, 9) AS mean_pm25
       FROM (SELECT *, count(*) FILTER (mean_pm25 IS NULL) OVER (PARTITION BY date, hour)
               AS offline_monitors FROM hourly)
       WHERE offline_monitors < 4 AND mean_pm25 IS NOT NULL""",
)
def j25(spark, sf):
    rows = completeness.offline_filter(
        fx.hourly(spark, sf), "mean_pm25", ["date", "hour"], 4
    )
    return rows.select(
        "monitor", "date", "hour", "offline_monitors", F.round("mean_pm25", 9).alias("mean_pm25")
    )


SHARE_SQL = """
    SELECT monitor, sum(100.0::DOUBLE * n / full_n) AS total FROM (
      SELECT monitor, source, count(*) AS n, sum(count(*)) OVER (PARTITION BY monitor) AS full_n
      FROM merged WHERE {where} GROUP BY 1, 2) WHERE source IS NOT NULL GROUP BY 1"""


@query(
    "j26_season_coverage_ratio",
    f"""SELECT monitor, round(a.total, 9) AS first_coverage, round(b.total, 9) AS second_coverage,
               round(a.total / b.total, 9) AS ratio
        FROM ({SHARE_SQL.format(where="extract(day FROM timestamp) > 20")}) a
        JOIN ({SHARE_SQL.format(where="extract(day FROM timestamp) <= 20")}) b USING (monitor)""",
)
def j26(spark, sf):
    df = fx.merged(spark, sf)
    dry = F.dayofmonth("timestamp") > 20
    ratio = completeness.coverage_ratio(
        completeness.source_share(df.where(dry)), completeness.source_share(df.where(~dry))
    )
    return ratio.select(
        "monitor",
        *[F.round(c, 9).alias(c) for c in ("first_coverage", "second_coverage", "ratio")],
    )


# --- set operations and reshaping ---------------------------------------------------------------


@query(
    "u01_union_differing_columns",
    """SELECT monitor, timestamp, pm25, NULL::DOUBLE AS pm1 FROM readings WHERE event_id % 2 = 0
       UNION ALL SELECT monitor, timestamp, NULL, pm1 FROM readings WHERE event_id % 2 = 1""",
)
def u01(spark, sf):
    df = fx.readings(spark, sf)
    return df.where("event_id % 2 = 0").select("monitor", "timestamp", "pm25").unionByName(
        df.where("event_id % 2 = 1").select("monitor", "timestamp", "pm1"),
        allowMissingColumns=True,
    )


@query(
    "u02_overlapping_batches",
    """SELECT monitor, timestamp, event_id, pm25 FROM (
         SELECT *, 0 AS batch FROM readings WHERE extract(day FROM date) <= 20
         UNION ALL SELECT *, 1 FROM readings WHERE extract(day FROM date) >= 15)
       QUALIFY row_number() OVER (PARTITION BY monitor, timestamp ORDER BY batch, event_id) = 1""",
)
def u02(spark, sf):
    df = fx.readings(spark, sf).select("monitor", "timestamp", "event_id", "pm25", "date")
    day = F.dayofmonth("date")
    return merge.stack_batches(
        [df.where(day <= 20), df.where(day >= 15)], ["monitor", "timestamp"], [F.col("event_id")]
    ).drop("date")


@query(
    "u03_key_set_operations",
    """SELECT monitor, 'both' AS kind FROM (SELECT monitor FROM a INTERSECT SELECT monitor FROM b)
       UNION ALL SELECT monitor, 'only_first' FROM (SELECT monitor FROM a EXCEPT SELECT monitor FROM b)
       UNION ALL SELECT monitor, 'any' FROM (SELECT monitor FROM a UNION SELECT monitor FROM b)"""
    .replace("FROM a", "FROM (SELECT monitor FROM readings WHERE user_id % 10 < 6)")
    .replace("FROM b", "FROM (SELECT monitor FROM readings WHERE user_id % 10 > 3)"),
)
def u03(spark, sf):
    df = fx.readings(spark, sf)
    first = df.where("user_id % 10 < 6").select("monitor")
    second = df.where("user_id % 10 > 3").select("monitor")
    return (
        first.intersect(second).withColumn("kind", F.lit("both"))
        .union(first.subtract(second).withColumn("kind", F.lit("only_first")))
        .union(first.union(second).distinct().withColumn("kind", F.lit("any")))
    )


@query("u04_distinct_monitors", "SELECT DISTINCT monitor FROM readings")
def u04(spark, sf):
    return fx.readings(spark, sf).select("monitor").distinct()


@query(
    "r01_pivot_longer",
    """SELECT event_id, 'pm1' AS channel, pm1 AS value FROM readings
       UNION ALL SELECT event_id, 'pm25', pm25 FROM readings
       UNION ALL SELECT event_id, 'pm10', pm10 FROM readings""",
)
def r01(spark, sf):
    return reshape.to_long(
        fx.readings(spark, sf), ["event_id"], ["pm1", "pm25", "pm10"], "channel", "value"
    )


EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


@query(
    "r02_pivot_wider",
    f"""SELECT date, hour,
               {", ".join(f"max(pm25) FILTER (event_type = '{e}') AS {e}" for e in EVENT_TYPES)}
        FROM readings GROUP BY 1, 2""",
)
def r02(spark, sf):
    return reshape.to_wide(
        fx.readings(spark, sf), ["date", "hour"], "event_type", "pm25", EVENT_TYPES
    )


GAS_FIT_SQL = """
    SELECT monitor, gas, CASE WHEN n >= 100 AND fit >= {r2} THEN slope END AS slope,
           CASE WHEN n >= 100 AND fit >= {r2} THEN intercept END AS intercept,
           CASE WHEN n >= 100 THEN fit END AS "R2"
    FROM (SELECT monitor, gas, regr_count(y, x) AS n, regr_slope(y, x) AS slope,
                 regr_intercept(y, x) AS intercept, regr_r2(y, x) AS fit
          FROM (SELECT g.monitor, 'co' AS gas, g.co AS y, r.co AS x FROM gas_hours g
                  LEFT JOIN gas_hours r ON g.timestamp = r.timestamp AND r.monitor = 'MOD-00000'
                UNION ALL SELECT g.monitor, 'no', g.no, r.no FROM gas_hours g
                  LEFT JOIN gas_hours r ON g.timestamp = r.timestamp AND r.monitor = 'MOD-00000'
                UNION ALL SELECT g.monitor, 'no2', g.no2, r.no2 FROM gas_hours g
                  LEFT JOIN gas_hours r ON g.timestamp = r.timestamp AND r.monitor = 'MOD-00000'
                UNION ALL SELECT g.monitor, 'o3', g.o3, r.o3 FROM gas_hours g
                  LEFT JOIN gas_hours r ON g.timestamp = r.timestamp AND r.monitor = 'MOD-00000')
          GROUP BY 1, 2)"""
GAS_MIN_R2 = 0.005


def gas_fits(spark, sf):
    paired = calibrate.with_reference_channels(fx.gas_hours(spark, sf), fx.REFERENCE, fx.GASES)
    return calibrate.gas_regressions(paired, fx.GASES, 100, GAS_MIN_R2)


WIDE_GAS_SQL = ", ".join(
    f"max({p}) FILTER (gas = '{g}') AS {g}_{p}" for g in fx.GASES for p in ("slope", "intercept")
)


@query(
    "r03_coefficients_wide",
    f"""SELECT monitor, {", ".join(f"round({g}_{p}, 9) AS {g}_{p}" for g in fx.GASES
                                   for p in ("slope", "intercept"))}
        FROM (SELECT monitor, {WIDE_GAS_SQL} FROM ({GAS_FIT_SQL.format(r2=GAS_MIN_R2)}) GROUP BY 1)""",
)
def r03(spark, sf):
    wide = reshape.coefficients_wide(gas_fits(spark, sf), fx.GASES)
    return wide.select("monitor", *[F.round(c, 9).alias(c) for c in wide.columns[1:]])


@query(
    "r04_complete_and_fill",
    """SELECT m.monitor, g.date_hour, coalesce(n, 0) AS minutes_in_hour
       FROM (SELECT DISTINCT monitor FROM readings) m,
            (SELECT unnest(generate_series(TIMESTAMP '2024-01-02', TIMESTAMP '2024-01-09',
                    INTERVAL 1 HOUR)) AS date_hour) g
       LEFT JOIN (SELECT monitor, date_trunc('hour', timestamp) AS date_hour, count(pm25) AS n
                  FROM readings GROUP BY 1, 2) c
         ON c.monitor = m.monitor AND c.date_hour = g.date_hour""",
)
def r04(spark, sf):
    start, end = dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 9)
    hours = completeness.hours_on_calendar(
        fx.readings(spark, sf), "pm25",
        moment(start), moment(end), 2,
    )
    return hours.select("monitor", "date_hour", "minutes_in_hour")


@query(
    "r05_nested_fits",
    """SELECT monitor, count(*) AS "N", round_even(regr_slope(y, x), 2) AS slope,
              round_even(regr_intercept(y, x), 2) AS intercept
       FROM (SELECT monitor, mean_pm25 AS y, fleet_average_pm25 AS x FROM hourly)
       WHERE y IS NOT NULL AND x IS NOT NULL GROUP BY monitor""",
)
def r05(spark, sf):
    return calibrate.regression_table(
        fx.hourly(spark, sf), "mean_pm25", "fleet_average_pm25"
    ).select("monitor", "N", "slope", "intercept")


MONITOR_COLUMNS = {
    **{f"MOD-0000{i}": f"pm25_{i}" for i in range(3)},
    **{f"MOD-PM-0000{i}": f"pm25_{i}" for i in range(3, 10)},
}


@query(
    "r06_others_matrix",
    f"""SELECT h.monitor, h.date, h.hour, round(h.mean_pm25, 9) AS mean_pm25,
               {", ".join(f"CASE WHEN h.monitor <> '{m}' THEN round({c}, 9) END AS {c}"
                          for m, c in MONITOR_COLUMNS.items())}
        FROM hourly h LEFT JOIN (SELECT date, hour,
               {", ".join(f"max(mean_pm25) FILTER (monitor = '{m}') AS {c}"
                          for m, c in MONITOR_COLUMNS.items())}
             FROM hourly GROUP BY 1, 2) w USING (date, hour)""",
)
def r06(spark, sf):
    df = fx.loo(spark, sf).select("monitor", "date", "hour", "timestamp", "mean_pm25")
    wide = reshape.others_matrix(df, MONITOR_COLUMNS, "mean_pm25")
    return wide.select(
        "monitor", "date", "hour", F.round("mean_pm25", 9).alias("mean_pm25"),
        *[F.round(c, 9).alias(c) for c in MONITOR_COLUMNS.values()],
    )


MONTH = [str(dt.date(2024, 1, day)) for day in range(1, 32)]


@query(
    "r08_completeness_matrix",
    f"""SELECT monitor, {", ".join(f"max(p) FILTER (d = '{d}') AS \"{d}\"" for d in MONTH)}
        FROM (SELECT monitor, CAST(date AS VARCHAR) AS d, count(DISTINCT hour) / 24.0::DOUBLE AS p
              FROM hourly WHERE mean_pm25 IS NOT NULL GROUP BY 1, 2) GROUP BY monitor""",
)
def r08(spark, sf):
    share = completeness.daily_hour_share(fx.hourly(spark, sf), "mean_pm25").withColumn(
        "date", F.col("date").cast("string")
    )
    return reshape.to_wide(share, ["monitor"], "date", "pct_complete", MONTH)


# --- windows and ordering -----------------------------------------------------------------------


@query(
    "w01_share_of_group",
    """SELECT monitor, source, n AS count, full_n AS full_count,
              round(100.0::DOUBLE * n / full_n, 9) AS percentage
       FROM (SELECT monitor, source, count(*) AS n,
                    CAST(sum(count(*)) OVER (PARTITION BY monitor) AS BIGINT) AS full_n
             FROM merged GROUP BY 1, 2) WHERE source IS NOT NULL""",
)
def w01(spark, sf):
    shares = completeness.source_share(fx.merged(spark, sf))
    return shares.select(
        "monitor", "source", "count", "full_count", F.round("percentage", 9).alias("percentage")
    )


@query("w02_most_recent_fit", RECENT_SQL)
def w02(spark, sf):
    return calibrate.most_recent_fit(fx.cal(spark, sf), "pm25").select(
        "monitor", "slope", "intercept", "r2", "n_points"
    )


@query(
    "w03_reference_coefficients",
    f"SELECT slope, intercept FROM ({RECENT_SQL}) WHERE monitor = 'MOD-00000'",
)
def w03(spark, sf):
    return calibrate.reference_coefficients(fx.cal(spark, sf), fx.REFERENCE, "pm25")


@query(
    "w04_first_row_per_key",
    """SELECT monitor, timestamp, event_id, event_type, pm25 FROM readings
       QUALIFY row_number() OVER (PARTITION BY monitor, timestamp ORDER BY event_id) = 1""",
)
def w04(spark, sf):
    rows = ordering.first_per_key(
        fx.readings(spark, sf), ["monitor", "timestamp"], [F.col("event_id")]
    )
    return rows.select("monitor", "timestamp", "event_id", "event_type", "pm25")


@query(
    "w04_distinct_rows",
    "SELECT DISTINCT monitor, date, hour, event_type FROM readings",
)
def w04_distinct(spark, sf):
    return fx.readings(spark, sf).select("monitor", "date", "hour", "event_type").dropDuplicates()


@query(
    "w05_top_location",
    """SELECT monitor, geo_lat, geo_lon, n FROM (
         SELECT monitor, round_even(4 + met_rh / 20, 1) AS geo_lat, hour / 10.0::DOUBLE AS geo_lon,
                count(*) AS n FROM readings GROUP BY 1, 2, 3)
       QUALIFY row_number() OVER (PARTITION BY monitor ORDER BY n DESC, geo_lat, geo_lon) = 1""",
)
def w05(spark, sf):
    df = fx.readings(spark, sf).select(
        "monitor", F.bround(4 + F.col("met_rh") / 20, 1).alias("geo_lat"),
        (F.col("hour") / 10.0).alias("geo_lon"),
    )
    return spatial.modal_location(df)


@query(
    "w06_leave_one_out",
    """SELECT monitor, timestamp, round(mean_pm25, 9) AS mean_pm25, n_reporting,
              round(fleet_avg, 9) AS fleet_avg FROM loo""",
)
def w06(spark, sf):
    return fx.loo(spark, sf).select(
        "monitor", "timestamp", F.round("mean_pm25", 9).alias("mean_pm25"), "n_reporting",
        F.round("fleet_avg", 9).alias("fleet_avg"),
    )


@query(
    "w06_leave_one_out_for_gaps",
    """SELECT monitor, timestamp, n_reporting, round(CASE WHEN n_reporting > 2 THEN
                CASE WHEN mean_pm25 IS NULL THEN total / n_reporting
                     ELSE (total - mean_pm25) / (n_reporting - 1) END END, 9) AS fleet_avg
       FROM (SELECT *, sum(mean_pm25) OVER (PARTITION BY timestamp) AS total FROM loo)""",
)
def w06_gaps(spark, sf):
    return fx.loo(spark, sf, "others").select(
        "monitor", "timestamp", "n_reporting", F.round("fleet_avg", 9).alias("fleet_avg")
    )


@query(
    "w07_group_total_on_rows",
    """SELECT monitor, source, round(sum(100.0::DOUBLE * n / full_n) OVER (PARTITION BY monitor), 9)
                AS total_percentage
       FROM (SELECT monitor, source, count(*) AS n,
                    sum(count(*)) OVER (PARTITION BY monitor) AS full_n
             FROM merged GROUP BY 1, 2) WHERE source IS NOT NULL""",
)
def w07(spark, sf):
    return completeness.source_share(fx.merged(spark, sf)).select(
        "monitor", "source", F.round("total_percentage", 9).alias("total_percentage")
    )


@query(
    "w08_positional_pairing",
    """SELECT 'U' || CAST(user_id AS VARCHAR) || '_' || strftime(ts, '%Y%m%d') || '.TXT' AS file,
              CAST(row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY event_id)
                AS INTEGER) AS ordinal, value AS pm25 FROM events""",
)
def w08(spark, sf):
    from fleetfold.catalog.sources import optical_files
    from fleetfold.sources.logs import file_name, pair_lines

    pairs = pair_lines(optical_files(spark, sf))
    return pairs.select(
        file_name("path").alias("file"),
        "ordinal",
        F.element_at(F.split("n_line", r"\s+"), 2).cast("double").alias("pm25"),
    )


@query(
    "w09_row_ids",
    """SELECT event_id, row_number() OVER (ORDER BY md5(CAST(event_id AS VARCHAR)), event_id)
                AS row_id FROM events""",
)
def w09(spark, sf):
    return ordering.row_ids(fx.table(spark, sf, "events"), ["event_id"]).select(
        "event_id", "row_id"
    )


@query(
    "w10_ranks_with_ties",
    """SELECT size, count(*) AS n, count(*) FILTER (d > 0) AS positive,
              min(r) - 1 AS n_below, (min(r) + max(r)) / 2.0::DOUBLE AS mean_rank
       FROM (SELECT d, abs(d) AS size, row_number() OVER (ORDER BY abs(d)) AS r
             FROM (SELECT round(pm25 - pm1, 1) AS d FROM readings) WHERE d <> 0) GROUP BY size""",
)
def w10(spark, sf):
    sized = (
        fx.readings(spark, sf)
        .select(F.round(F.col("pm25") - F.col("pm1"), 1).alias("d"))
        .where("d <> 0")
        .withColumn("size", F.abs("d"))
    )
    positive = F.count_if(F.col("d") > 0).alias("positive")
    return ordering.value_ranks(sized, "size", extra=[positive]).select(
        "size", "n", "positive", "n_below",
        (F.col("n_below") + (F.col("n") + 1) / 2).alias("mean_rank"),
    )


@query(
    "o01_multi_key_order",
    """SELECT monitor, n_points, r2, abs(slope - 1.05) AS change FROM cal
       ORDER BY change DESC NULLS LAST, n_points DESC, monitor""",
)
def o01(spark, sf):
    change = F.abs(F.col("slope") - 1.05)
    return (
        fx.cal(spark, sf)
        .select("monitor", "n_points", "r2", change.alias("change"))
        .orderBy(F.desc_nulls_last("change"), F.desc("n_points"), "monitor")
    )


@query(
    "o02_order_by_coverage",
    f"""SELECT monitor, round(total, 9) AS total, rank() OVER (ORDER BY total DESC) AS position
        FROM ({SHARE_SQL.format(where="TRUE")})""",
)
def o02(spark, sf):
    df = completeness.order_by_coverage(completeness.source_share(fx.merged(spark, sf)))
    return df.select("monitor", F.round("total", 9).alias("total"), "position")


@query(
    "o03_random_sample",
    """SELECT event_id, monitor, pm25 FROM readings
       ORDER BY md5('42|' || CAST(event_id AS VARCHAR)), event_id LIMIT 500""",
)
def o03(spark, sf):
    return ordering.random_sample(fx.readings(spark, sf), ["event_id"], 500, "42").select(
        "event_id", "monitor", "pm25"
    )


SPLIT_SQL = """
    SELECT date, season, CASE WHEN row_number() OVER (PARTITION BY season
             ORDER BY md5('123|' || CAST(date AS VARCHAR)))
             <= floor(0.2 * count(*) OVER (PARTITION BY season)) THEN 'test' ELSE 'train' END
             AS split_day_block
    FROM (SELECT DISTINCT date, CASE WHEN extract(day FROM date) > 20 THEN 'dry' ELSE 'wet' END
            AS season FROM readings)"""


@query(
    "o04_stratified_day_split",
    f"SELECT event_id, date, season, split_day_block FROM readings JOIN ({SPLIT_SQL}) USING (date)",
)
def o04(spark, sf):
    season = F.when(F.dayofmonth("date") > 20, "dry").otherwise("wet")
    df = fx.readings(spark, sf).withColumn("season", season)
    return ordering.day_block_split(df, "date", ["season"]).select(
        "event_id", "date", "season", "split_day_block"
    )


@query(
    "o05_day_split",
    """SELECT event_id, date, split_day_block FROM readings JOIN (
         SELECT date, CASE WHEN row_number() OVER (ORDER BY md5('222|' || CAST(date AS VARCHAR)))
                <= floor(0.2 * count(*) OVER ()) THEN 'test' ELSE 'train' END AS split_day_block
         FROM (SELECT DISTINCT date FROM readings)) USING (date)""",
)
def o05(spark, sf):
    df = fx.readings(spark, sf)
    return ordering.day_block_split(df, "date", seed="222").select(
        "event_id", "date", "split_day_block"
    )


@query(
    "o06_day_folds",
    """SELECT event_id, date, CAST(CAST('0x' || substr(md5('123|' || CAST(date AS VARCHAR)), 1, 7)
                AS BIGINT) % 5 AS INTEGER) AS fold FROM readings""",
)
def o06(spark, sf):
    return fx.readings(spark, sf).select(
        "event_id", "date", ordering.day_fold("date", 5).alias("fold")
    )
