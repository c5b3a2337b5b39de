"""Sources and sinks. File readers are queried on text that Spark derives from the sample tables."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from fleetfold.catalog import fixtures as fx
from fleetfold.catalog.registry import query
from fleetfold.operators.rollup import strict_hourly_reference
from fleetfold.sources import logs, tables


@query(
    "s01_cloud_channel_pm10",
    """SELECT monitor, timestamp, date, hour, pm10, 'cloud' AS source FROM readings
       WHERE pm10 <= 1500""",
)
def s01_pm10(spark, sf):
    return tables.cloud_channel(fx.readings(spark, sf), "pm10")


@query(
    "s01_cloud_channel_pm25",
    """SELECT monitor, timestamp, date, hour, pm25,
              CASE WHEN pm25 IS NOT NULL THEN 'cloud' END AS source FROM readings""",
)
def s01_pm25(spark, sf):
    return tables.cloud_channel(fx.readings(spark, sf), "pm25")


@query(
    "s02_cloud_channels_long",
    """SELECT monitor, timestamp, date, hour, 'pm1' AS pollutant, pm1 AS value, 'cloud' AS source
       FROM readings
       UNION ALL SELECT monitor, timestamp, date, hour, 'pm25', pm25, 'cloud' FROM readings
       UNION ALL SELECT monitor, timestamp, date, hour, 'pm10', pm10, 'cloud' FROM readings
                 WHERE pm10 <= 1500""",
)
def s02(spark, sf):
    return tables.cloud_channels(fx.readings(spark, sf), ["pm1", "pm25", "pm10"])


def _card_text(spark, sf):
    """Card rows as the text cells a CSV reader yields, with the path of their file."""
    return fx.readings(spark, sf).select(
        F.concat(
            F.lit("/cards/"), F.col("monitor"), F.lit("_"), F.col("date").cast("string"),
            F.lit(".csv"),
        ).alias("_path"),
        F.col("timestamp").cast("string").alias("timestamp_iso"),
        *[F.col(c).cast("string").alias(c) for c in ("pm1", "pm25", "pm10")],
        *[F.col("pm25").cast("string").alias(c) for c in ("co", "no", "no2", "o3")],
    )


@query(
    "s03_card_files_stacked",
    """SELECT timestamp AS timestamp_iso, monitor, NULL::DOUBLE AS pm1, pm25,
              NULL::DOUBLE AS pm10, NULL::DOUBLE AS co, NULL::DOUBLE AS no, NULL::DOUBLE AS no2,
              NULL::DOUBLE AS o3, 'sd_card' AS source FROM readings
       UNION ALL
       SELECT timestamp, monitor, pm1, NULL, NULL, NULL, NULL, NULL, NULL, 'sd_card'
       FROM readings WHERE event_id % 2 = 0""",
)
def s03(spark, sf):
    """Two sets of card files with different columns, written and read back by their headers."""
    df = fx.readings(spark, sf)
    time = F.col("timestamp").alias("timestamp_iso")
    first, second = scratch(spark, "cards"), scratch(spark, "cards")
    df.select(time, "monitor", "pm25").write.option("header", True).csv(first)
    df.where("event_id % 2 = 0").select("monitor", time, "pm1").write.option("header", True).csv(second)
    return tables.read_cards(spark, [first, second, f"{second}-absent"])


@query(
    "s04_merge_with_empty_card_table",
    "SELECT monitor, timestamp, date, hour, pm25, source FROM cloud",
)
def s04(spark, sf):
    from fleetfold.operators.merge import merge_feeds

    return merge_feeds(
        fx.cloud(spark, sf), tables.empty_table(spark, tables.CARD_SCHEMA), "pm25"
    )


@query(
    "s05_device_rows",
    """SELECT timestamp AS timestamp_iso, monitor, pm1, pm25, pm10 FROM readings
       WHERE pm10 < 5000""",
)
def s05(spark, sf):
    """Card files in one folder per device, written and read back; the folder names the monitor."""
    folder, channels = scratch(spark, "devices"), ["pm1", "pm25", "pm10"]
    rows = fx.readings(spark, sf).select("monitor", F.col("timestamp").alias("timestamp_iso"), *channels)
    spread = F.pmod(F.xxhash64("timestamp_iso"), F.lit(4))
    rows.repartition("monitor", spread).write.option("header", True).partitionBy("monitor").csv(folder)
    return tables.read_device_files(
        spark, [f"{folder}/*"], channels, monitor=lambda p: F.regexp_extract(p, "monitor=([^/]+)/", 1)
    )


@query(
    "s05_gas_card_rows",
    """SELECT timestamp, monitor, pm25 AS co, pm25 AS no, pm25 AS no2, pm25 AS o3, date, hour,
              'sd_card' AS source FROM readings""",
)
def s05_gas(spark, sf):
    return tables.gas_card_rows(_card_text(spark, sf))


@query(
    "s06_temperature_rows",
    """SELECT timestamp AS timestamp_iso, monitor, coalesce(pm1, met_temp) AS met_temp, met_rh,
              'sd_card' AS source FROM readings""",
)
def s06(spark, sf):
    df = fx.readings(spark, sf).select(
        F.col("timestamp").alias("timestamp_iso"), "monitor", F.col("pm1").alias("sample_temp"),
        "met_temp", "met_rh",
    )
    return tables.temperature_rows(df)


@query(
    "s07_wind_rows",
    """SELECT timestamp AS timestamp_iso, ws, wd, monitor, 'sd_card' AS source FROM readings
       WHERE timestamp >= TIMESTAMP '2024-01-15'
       QUALIFY row_number() OVER (PARTITION BY monitor, timestamp ORDER BY event_id) = 1""",
)
def s07(spark, sf):
    df = fx.readings(spark, sf).withColumn("timestamp_iso", F.col("timestamp"))
    return tables.wind_rows(df, dt.date(2024, 1, 15), [F.col("event_id")])


def _daily_files(rows, header: list[str], folder, line, order="event_id"):
    """One row per (folder, date) holding the text of a daily file."""
    body = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct(order, line.alias("line")))),
                    lambda s: s["line"]),
        "\n",
    )
    content = F.concat(F.lit("\n".join(header) + "\n"), body)
    return rows.groupBy(folder.alias("folder"), "date").agg(content.alias("content")).select(
        F.concat(
            "folder", F.lit("/DATA_"), F.date_format("date", "yyyyMMdd"), F.lit("@FW24.csv")
        ).alias("path"),
        "content",
    )


def _user_folder():
    """One folder per device, so a file holds one device day however large the table is."""
    return F.concat(
        F.lit("/sd/raw/MOD_PM_"), F.lpad(F.col("user_id").cast("string"), 5, "0")
    )


@query(
    "s08_raw_file_hours",
    """SELECT 'MOD-PM-' || lpad(CAST(user_id AS VARCHAR), 5, '0') AS monitor,
              date_trunc('hour', ts) AS date_hour, count(*) AS observation_count
       FROM events WHERE event_id % 10 <> 3
         AND date_trunc('hour', ts) > TIMESTAMP '2024-01-02'
         AND date_trunc('hour', ts) < TIMESTAMP '2024-01-28'
       GROUP BY 1, 2""",
)
def s08(spark, sf):
    events = fx.table(spark, sf, "events").withColumn("date", F.to_date("ts"))
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    line = (
        F.when(F.col("event_id") % 10 == 3, F.concat(F.lit("7,broken "), stamp))
        .when(F.col("event_id") % 10 == 4, F.concat(F.lit("7,µ"), stamp, F.lit(",1.5,extra")))
        .otherwise(F.concat(F.lit("7,"), stamp, F.lit(",1.5")))
    )
    files = _daily_files(
        events, ["deviceModel,x", "deviceSN,y", "", "id,timestamp_iso,pm25"], _user_folder(), line
    )
    monitor = F.translate(F.regexp_extract("path", r"MOD_PM_\d+", 0), "_", "-")
    return logs.raw_file_hours(files, monitor, dt.date(2024, 1, 2), dt.date(2024, 1, 28))


@query(
    "s09_attenuation_hours",
    """SELECT date_hour, round(mean_pm25, 9) AS mean_pm25, round(mean_temp, 9) AS mean_temp,
              round(mean_rh, 9) AS mean_rh
       FROM (SELECT date_trunc('hour', ts) AS date_hour,
                    CASE WHEN count(*) = count(CASE WHEN event_id % 29 <> 0 THEN value END)
                         THEN avg(value) END AS mean_pm25,
                    avg(value / 10) AS mean_temp, avg(event_id % 100) AS mean_rh
             FROM events WHERE event_type <> 'error' GROUP BY 1)
       WHERE mean_pm25 > 0 AND mean_pm25 < 500""",
)
def s09(spark, sf):
    events = fx.table(spark, sf, "events").withColumn("date", F.to_date("ts"))
    line = F.concat_ws(
        ",",
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss"),
        F.when(F.col("event_id") % 29 == 0, "").otherwise(F.col("value").cast("string")),
        (F.col("value") / 10).cast("string"),
        (F.col("event_id") % 100).cast("string"),
        F.when(F.col("event_type") == "error", "00100").otherwise("00000"),
    )
    files = _daily_files(
        events,
        ["Report", "Station", "Period", "", "Time,ConcHR(ug/m3),AT(C),RH(%),Status"],
        _user_folder(),
        line,
    )
    rows = logs.attenuation_rows(
        files, {"ConcHR(ug/m3)": "pm25", "AT(C)": "temp", "RH(%)": "rh"}
    )
    hours = strict_hourly_reference(rows, ["pm25", "temp", "rh"])
    return hours.select("date_hour", *[F.round(c, 9).alias(c) for c in hours.columns[1:]])


OPTICAL_SQL = """
    SELECT 'U' || CAST(user_id AS VARCHAR) || '_' || strftime(ts, '%Y%m%d') || '.TXT' AS file,
           row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY event_id) AS ordinal,
           date_trunc('minute', ts) AS datetime,
           CAST(0 AS INTEGER) AS error_code, event_id, value,
           CAST(event_id % 256 AS INTEGER) AS packed, CAST(100 + event_id % 60 AS INTEGER) AS ue1,
           CAST(event_id % 200 AS INTEGER) AS ue2, CAST(130 + event_id % 20 AS INTEGER) AS ue4
    FROM events"""


def optical_files(spark, sf):
    """Instrument text: every event is a P line and an N line, each file ends with a lone P line."""
    events = fx.table(spark, sf, "events").withColumn("date", F.to_date("ts"))
    key = F.col("event_id")
    p_line = F.concat_ws(
        " ",
        F.lit(" P  "), F.year("ts") - 2000, F.month("ts"), F.dayofmonth("ts"), F.hour("ts"),
        F.minute("ts"), F.lit("1 100 0 85 40"), key % 256, 130 + key % 20, key % 7, key % 200,
        100 + key % 60, F.lit("5"),
    )
    n_line = F.concat_ws("   ", F.lit("N_ "), F.col("value") * 2, F.col("value"))
    both = F.concat(p_line, F.lit("\nK1 0 0 0\n"), n_line)
    files = _daily_files(
        events, ["HEADER"], F.concat(F.lit("/logs/U"), F.col("user_id").cast("string")), both
    )
    return files.select(
        F.concat(
            F.lit("/optical/"),
            F.regexp_extract("path", "(U[0-9]+)", 1),
            F.lit("_"),
            F.regexp_extract("path", "DATA_([0-9]+)", 1),
            F.lit(".TXT"),
        ).alias("path"),
        F.concat("content", F.lit("\n P 24 1 1 1 1 1 100 0 85 40 1 1 1 1 1 1")).alias("content"),
    )


@query(
    "s10_optical_readings",
    f"""SELECT file, CAST(ordinal AS INTEGER) AS ordinal, datetime, error_code,
               round(((ue1 * 4 + (packed & 3)) * 10 / 1024::DOUBLE - 2.0::DOUBLE) * 20, 6) AS temp_c,
               round(((ue2 * 4 + ((packed >> 2) & 3)) * 10 / 1024::DOUBLE) * 20, 6) AS rh_percent,
               round(((ue4 * 4 + ((packed >> 6) & 3)) * 10 / 1024::DOUBLE - 0.275::DOUBLE)
                     * 176.21145::DOUBLE, 6) AS pressure_hpa,
               value * 2 AS pm10, value AS pm25
        FROM ({OPTICAL_SQL})""",
)
def s10(spark, sf):
    rows = logs.optical_readings(optical_files(spark, sf))
    rounded = ("temp_c", "rh_percent", "pressure_hpa")
    return rows.select(
        *[F.round(c, 6).alias(c) if c in rounded else F.col(c) for c in rows.columns]
    )


@query(
    "s10_pairs_of_split_files",
    """SELECT CAST(ts AS DATE) AS date,
              CAST(row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY event_id) AS INTEGER)
                AS ordinal, event_id, value * 2 AS pm10, value AS pm25 FROM events""",
)
def s10_split(spark, sf):
    """One text file per day of the whole fleet, written, read in blocks and paired by line numbers."""
    pieces = F.posexplode(
        F.array(F.concat(F.lit(" P  "), F.col("event_id").cast("string")), F.lit("K1 0 0 0"),
                F.concat_ws("   ", F.lit("N_ "), F.col("value") * 2, F.col("value")))
    ).alias("sub", "line")
    lines = fx.table(spark, sf, "events").select(F.to_date("ts").alias("date"), "event_id", pieces)
    path = scratch(spark, "optical")
    placed = lines.repartition("date").sortWithinPartitions("date", "event_id", "sub")
    placed.select("date", "line").write.partitionBy("date").text(path)
    pairs = logs.pair_lines(logs.read_lines(spark, path))
    values = F.split("n_line", r"\s+")
    return pairs.select(
        F.to_date(F.regexp_extract("path", "date=([0-9-]+)", 1)).alias("date"), "ordinal",
        F.col("p_line").cast("bigint").alias("event_id"),
        values[0].cast("double").alias("pm10"), values[1].cast("double").alias("pm25"),
    )


@query(
    "s11_audit_folders",
    """SELECT 'MOD_PM_' || lpad(CAST(user_id AS VARCHAR), 5, '0') AS folder,
              'MOD-PM-' || lpad(CAST(user_id AS VARCHAR), 5, '0') AS expected_sn,
              count(*) AS n_csv, coalesce(string_agg(DISTINCT sn, ', ' ORDER BY sn), '')
                AS device_sns,
              CAST(count(DISTINCT sn) AS INTEGER) AS n_unique_device_sn,
              count(DISTINCT sn) > 1 AS has_multiple_sns,
              count(DISTINCT sn) = 1 AND min(sn) <> 'MOD-PM-' || lpad(CAST(user_id AS VARCHAR), 5, '0')
                AS single_sn_mismatch,
              count(DISTINCT sn) = 0 AS missing_device_sn
       FROM (SELECT user_id, CASE WHEN user_id % 5 = 0 THEN NULL
                    ELSE 'MOD-PM-' || lpad(CAST(user_id + CASE WHEN user_id % 5 = 1 THEN 1
                       WHEN user_id % 5 = 2 THEN extract(day FROM ts) % 2 ELSE 0 END AS VARCHAR),
                       5, '0') END AS sn
             FROM events GROUP BY user_id, CAST(ts AS DATE), extract(day FROM ts), sn)
       GROUP BY user_id""",
)
def s11(spark, sf):
    days = fx.table(spark, sf, "events").select("user_id", F.to_date("ts").alias("date")).distinct()
    kind = F.col("user_id") % 5
    number = F.col("user_id") + F.when(kind == 1, 1).when(
        kind == 2, F.dayofmonth("date") % 2
    ).otherwise(0)
    serial = F.concat(F.lit("MOD_PM_"), F.lpad(number.cast("string"), 5, "0"))
    head = F.when(kind == 0, "firmware,24\n").otherwise(
        F.concat(F.lit('firmware,24\n DeviceSN ; "'), serial, F.lit('"\n'))
    )
    files = days.select(
        F.concat(
            _user_folder(), F.lit("/DATA_"), F.date_format("date", "yyyyMMdd"), F.lit("@FW24.csv")
        ).alias("path"),
        F.concat(head, F.lit("timestamp_iso,pm25\n")).alias("content"),
    )
    return logs.audit_folders(files)


@query(
    "s12_file_inventory",
    """SELECT DISTINCT 'MOD-PM-' || lpad(CAST(user_id AS VARCHAR), 5, '0') AS monitor,
              CAST(ts AS DATE) AS date FROM events WHERE event_type <> 'error'""",
)
def s12(spark, sf):
    return logs.file_inventory(card_paths(spark, sf))


def card_paths(spark, sf):
    log = F.when(F.col("event_type") == "error", "/logs").otherwise("")
    return fx.table(spark, sf, "events").select(
        F.concat(
            _user_folder(), log, F.lit("/DATA_"), F.date_format("ts", "yyyyMMdd"),
            F.lit("@FW24.csv"),
        ).alias("path")
    )


@query(
    "s13_external_weather",
    """SELECT timestamp AS "DateTime", ws AS "WindSpeed_ms", wd AS "WindDirection_A"
       FROM readings WHERE pm25 IS NOT NULL""",
)
def s13(spark, sf):
    return external_wind(spark, sf)


def external_wind(spark, sf):
    names = {"timestamp": "DateTime", "ws": "WindSpeed_ms", "wd": "WindDirection_A"}
    rows = fx.readings(spark, sf).where("pm25 IS NOT NULL").select("timestamp", "ws", "wd")
    return tables.external_weather(rows, names)


@query(
    "s14_village_population",
    """SELECT CASE WHEN village = 'Building' THEN 'Buildings' ELSE village END AS village,
              count(*) AS households, sum(c_custkey) AS population
       FROM (SELECT upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS village, c_custkey
             FROM customer) GROUP BY 1""",
)
def s14(spark, sf):
    sheet = fx.table(spark, sf, "customer").select(
        F.concat("c_mktsegment", F.lit(" ("), F.col("c_custkey").cast("string"), F.lit(")")).alias(
            "village"
        ),
        F.lit(1).alias("households"),
        F.col("c_custkey").alias("population"),
    )
    return tables.village_population(sheet, {"Building": "Buildings"}).select(
        "village", "households", F.col("population").cast("decimal(38,0)").alias("population")
    )


def scratch(spark, name: str) -> str:
    """A fresh folder in the shared checkpoint folder, or a local one where none is set."""
    from fleetfold.session import shared_folder

    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query(
    "s15_write_and_prune_by_date",
    """SELECT monitor, timestamp, hour, pm25, source, date FROM cloud
       WHERE date BETWEEN DATE '2024-01-05' AND DATE '2024-01-07'""",
)
def s15(spark, sf):
    path = scratch(spark, "readings")
    columns = ["monitor", "timestamp", "date", "hour", "pm25", "source"]
    tables.write_readings(fx.cloud(spark, sf).select(*columns), path)
    back = spark.read.parquet(path)
    return back.where(F.col("date").between(F.lit(dt.date(2024, 1, 5)), F.lit(dt.date(2024, 1, 7))))


@query(
    "s15_csv_round_trip",
    "SELECT monitor, date, n_complete_hours FROM daily",
)
def s15_csv(spark, sf):
    path = scratch(spark, "daily")
    tables.write_summary(
        fx.daily(spark, sf).select("monitor", "date", "n_complete_hours"), path, "csv"
    )
    return tables.read_typed(
        spark, path, "monitor string, date date, n_complete_hours bigint", "csv"
    )


@query(
    "s18_incremental_load",
    """SELECT monitor, timestamp AS timestamp_iso, pm25, date FROM readings
       WHERE NOT (date = DATE '2024-01-12' AND event_id % 3 = 0)""",
)
def s18(spark, sf):
    """Three loads of growing folders: the first days, all days but one late batch, a corrected file set."""
    from fleetfold.sources.loads import load_new_files, loaded_readings

    df = fx.readings(spark, sf)
    inbox, folder, day = scratch(spark, "inbox"), scratch(spark, "loaded"), F.dayofmonth("date")
    names = ["monitor", "timestamp_iso", "pm25"]
    cells = df.select("event_id", "date", "monitor", F.col("timestamp").alias("timestamp_iso"), "pm25")
    late = F.col("date") == F.lit(dt.date(2024, 1, 12))
    batches = [cells.where(day <= 10), cells.where((day > 10) & ~late), cells.where(late & (F.col("event_id") % 3 != 0))]

    def read(paths):
        raw = tables.read_by_header(spark, paths, names)
        time = F.to_timestamp("timestamp_iso").cast("timestamp_ntz").alias("timestamp_iso")
        return raw.select("monitor", time, F.col("pm25").cast("double").alias("pm25"), F.to_date("timestamp_iso").alias("date"), "_path")

    for number, batch in enumerate(batches):
        batch.select(*names).write.option("header", True).csv(f"{inbox}/{number}")
        load_new_files(spark, [f"{inbox}/*"], folder, read)
    return loaded_readings(spark, folder).drop("_path")


@query("s17_baseline_calibration", "SELECT monitor, slope, intercept FROM cal")
def s17(spark, sf):
    folder = scratch(spark, "calibration")
    tables.write_summary(fx.cal(spark, sf), f"{folder}/calibration_pm25.csv", "csv")
    found = tables.read_baseline(spark, folder, ["pm25", "pm10"])
    return found["pm25"].select("monitor", "slope", "intercept").unionByName(
        found["pm10"].select("monitor", "slope", "intercept")
    )


@query(
    "s10_optical_hours",
    f"""SELECT date_trunc('hour', datetime) AS date_hour, CAST(datetime AS DATE) AS date,
               round(avg(((ue1 * 4 + (packed & 3)) * 10 / 1024::DOUBLE - 2.0::DOUBLE) * 20), 6)
                 AS ref_temp,
               round(avg(value), 6) AS ref_pm25
        FROM ({OPTICAL_SQL}) GROUP BY 1, 2 HAVING count(*) >= 10""",
)
def s10_hours(spark, sf):
    from fleetfold.operators.rollup import reference_hours

    hours = reference_hours(
        logs.optical_readings(optical_files(spark, sf)),
        {"temp_c": "ref_temp", "pm25": "ref_pm25"},
        ["pm25", "temp_c"],
        min_rows=10,
    )
    return hours.select(
        "date_hour", "date", *[F.round(c, 6).alias(c) for c in ("ref_temp", "ref_pm25")]
    )

