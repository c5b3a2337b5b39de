"""Typed tables: cloud export, memory cards, calibrations, models, sinks."""

from __future__ import annotations

import csv
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from fleetfold.functions.calendar import moment
from fleetfold.functions.columns import (
    clean_place,
    monitor_from_path,
    nan_to_null,
    within,
)
from fleetfold.operators.calibrate import CALIBRATION_SCHEMA
from fleetfold.operators.ordering import first_per_key
from fleetfold.operators.reshape import coalesce_known, select_known
from fleetfold.session import settle, shared_folder

CHANNELS = ("pm1", "pm25", "pm10", "co", "no", "no2", "o3")
CLOUD_SCHEMA = (
    "monitor string, timestamp timestamp_ntz, local_timestamp timestamp_ntz, date date, hour int, "
    "geo_lat double, geo_lon double, pm1 double, pm25 double, pm10 double, co double, no double, "
    "no2 double, o3 double, met_temp double, met_rh double, ws double, wd double"
)
CARD_SCHEMA = (
    "timestamp_iso timestamp_ntz, monitor string, pm1 double, pm25 double, pm10 double, co double, "
    "no double, no2 double, o3 double, source string"
)
GAS_CARD_SCHEMA = (
    "timestamp_iso timestamp_ntz, monitor string, co double, no double, no2 double, o3 double, "
    "source string"
)
WEATHER_CARD_SCHEMA = (
    "timestamp_iso timestamp_ntz, monitor string, met_temp double, met_rh double, source string"
)

# Upper bounds of plausible PM10 in the cloud feed (inclusive) and on cards (exclusive).
CLOUD_PM10_MAX = 1500.0
CARD_PM10_LIMIT = 5000.0


def empty_table(spark: SparkSession, schema: str) -> DataFrame:
    """Typed table without rows, so that a merge still works when a source is absent."""
    return spark.createDataFrame([], schema)


def read_typed(
    spark: SparkSession, paths: str | Sequence[str], schema: str, kind: str = "parquet"
) -> DataFrame:
    """Read CSV or Parquet under a fixed schema; NaN readings become null.

    CSV columns are found by the header of each file, whatever their order; a column that a file
    lacks is null, others are not read.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    if kind == "csv":
        names = schema_names(schema)
        raw = read_by_header(spark, paths, names)
        return _typed(raw, names, schema)
    if kind == "parquet":
        return nulls_for_nan(spark.read.schema(schema).parquet(*paths))
    raise ValueError(f"unsupported file type {kind!r}")


def schema_names(schema: str) -> list[str]:
    return [part.strip().split(" ")[0] for part in schema.split(",")]


def _unique_names(header: Sequence[str]) -> list[str]:
    """Column names of a header line; unnamed and repeated ones get their position."""
    names: list[str] = []
    for i, cell in enumerate(header):
        name = cell.strip().removeprefix("\ufeff")
        taken = {n.lower() for n in names}
        names.append(f"_c{i}" if not name else f"{name}_{i}" if name.lower() in taken else name)
    return names


def read_by_header(
    spark: SparkSession, paths: Sequence[str], names: Sequence[str], **options
) -> DataFrame:
    """The columns ``names`` as text, and ``_path``, from CSV files that each have their own header.

    The header of every file is found in one job and kept as a table, which the lines join by path; the
    driver sees the different headers only. All lines are then read in one scan, split at any size, and
    parsed by the header of their file. Lines equal to their header are headers; blank lines are skipped.
    """
    start = F.col("_metadata.file_block_start")
    lines = spark.read.options(**options).text(list(paths)).select(
        F.col("_metadata.file_path").alias("_path"), start.alias("_start"), "value",
        F.monotonically_increasing_id().alias("_at"),
    )
    first = F.min_by("value", "_at").alias("_header")
    heads = settle(lines.where("_start = 0").groupBy(F.col("_path").alias("_file")).agg(first))
    headers = sorted(r[0] for r in heads.select("_header").distinct().collect())
    if not headers:
        return empty_table(spark, ", ".join(f"{n} string" for n in [*names, "_path"]))
    cell = F.lit(None).cast("string")
    parsed = F.lit(None)
    for header in headers:
        found = _unique_names(next(csv.reader([header.rstrip("\r")]), []))
        schema = StructType([StructField(n, StringType()) for n in found])
        cells = F.from_csv("value", schema.toDDL(), {"mode": "PERMISSIVE"})
        wanted = F.struct(*[(cells[n] if n in found else cell).alias(n) for n in names])
        parsed = F.when(F.col("_header") == F.lit(header), wanted).otherwise(parsed)
    # one header for all files needs no join
    named = lines.withColumn("_header", F.lit(headers[0]))
    if len(headers) > 1:
        named = lines.join(heads, F.col("_path") == F.col("_file"))
    rows = named.where((F.col("value") != F.col("_header")) & (F.trim("value") != ""))
    return rows.select(parsed.alias("_row"), "_path").select("_row.*", "_path")


def nulls_for_nan(df: DataFrame) -> DataFrame:
    floating = [name for name, kind in df.dtypes if kind in ("double", "float")]
    return df.withColumns({c: nan_to_null(c) for c in floating}) if floating else df


def cloud_channel(wide: DataFrame, channel: str) -> DataFrame:
    """One channel of the wide cloud table; the source is 'cloud' where there is a value.

    The plausibility bound of PM10 also drops its null minutes, those of other channels stay.
    """
    rows = wide.select("monitor", "timestamp", "date", "hour", channel)
    if channel == "pm10":
        rows = rows.where(within(channel, high=CLOUD_PM10_MAX))
    return rows.withColumn("source", F.when(F.col(channel).isNotNull(), "cloud"))


def cloud_channels(wide: DataFrame, channels: Sequence[str]) -> DataFrame:
    """All channels in long form from one scan, every row labelled 'cloud'."""
    long = wide.select("monitor", "timestamp", "date", "hour", *channels).unpivot(
        ["monitor", "timestamp", "date", "hour"], list(channels), "pollutant", "value"
    )
    plausible = (F.col("pollutant") != "pm10") | within("value", high=CLOUD_PM10_MAX)
    return long.where(plausible).withColumn("source", F.lit("cloud"))


def _existing(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """Those paths (or patterns) that match something, asked of the file system they live on."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    found = []
    for path in paths:
        location = jvm.org.apache.hadoop.fs.Path(path)
        matches = location.getFileSystem(conf).globStatus(location)
        if matches:
            found.append(path)
    return found


def read_cards(
    spark: SparkSession, paths: Sequence[str], schema: str = CARD_SCHEMA
) -> DataFrame:
    """Stack processed card files, each with its own columns; missing files are skipped, corrupt
    ones too. With no file at all the result is the empty template.

    Files are read by header name, so their column order may differ.
    """
    names = schema_names(schema)
    present = _existing(spark, paths)
    if not present:
        return empty_table(spark, schema).withColumn("source", F.lit("sd_card"))
    raw = read_by_header(
        spark, present, names, ignoreCorruptFiles=True, ignoreMissingFiles=True
    )
    return _typed(raw, names, schema).withColumn("source", F.lit("sd_card"))


def _typed(raw: DataFrame, names: Sequence[str], schema: str) -> DataFrame:
    kinds = dict(tuple(part.strip().split(" ")) for part in schema.split(","))

    def column(name: str) -> Column:
        if kinds[name] == "timestamp_ntz":
            text = F.regexp_replace(F.col(name), r"(?<=\d)T(?=\d)|Z$", " ")
            return F.try_to_timestamp(F.trim(text)).cast("timestamp_ntz")
        return F.col(name).try_cast(kinds[name])

    return nulls_for_nan(raw.select(*[column(n).alias(n) for n in names if n in raw.columns]))


def read_device_files(
    spark: SparkSession, paths: Sequence[str], channels: Sequence[str],
    limit_pm10: bool = True, monitor: Callable[[str], Column] = monitor_from_path,
) -> DataFrame:
    """Card files of one device class; the monitor id comes from the file name, or from the path as ``monitor`` says."""
    raw = read_by_header(spark, paths, ["timestamp_iso", *channels])
    return device_rows(raw, channels, limit_pm10=limit_pm10, monitor=monitor)


def device_rows(
    raw: DataFrame, channels: Sequence[str], path: str = "_path", limit_pm10: bool = True,
    monitor: Callable[[str], Column] = monitor_from_path,
) -> DataFrame:
    """Typed readings of card rows that carry the path of their file; ``monitor`` reads the id off it."""
    named = raw.select(
        F.col("timestamp_iso").try_cast("timestamp_ntz").alias("timestamp_iso"),
        monitor(path).alias("monitor"),
        *[F.col(c).try_cast("double").alias(c) for c in channels],
    )
    rows = nulls_for_nan(named)
    if limit_pm10 and "pm10" in channels:
        rows = rows.where(within("pm10", high=CARD_PM10_LIMIT, include_high=False))
    return rows


def gas_card_rows(raw: DataFrame, path: str = "_path") -> DataFrame:
    """Gas channels of card rows with their calendar, labelled 'sd_card'."""
    rows = device_rows(raw, ("co", "no", "no2", "o3"), path, False)
    return rows.select(
        F.col("timestamp_iso").alias("timestamp"),
        "monitor",
        "co",
        "no",
        "no2",
        "o3",
        F.to_date("timestamp_iso").alias("date"),
        F.hour("timestamp_iso").alias("hour"),
        F.lit("sd_card").alias("source"),
    )


def temperature_rows(raw: DataFrame) -> DataFrame:
    """Temperature and humidity from whichever of the allowed channels a file has."""
    return raw.select(
        "timestamp_iso",
        "monitor",
        coalesce_known(raw, ["sample_temp", "met_temp"]).alias("met_temp"),
        coalesce_known(raw, ["sample_rh", "met_rh"]).alias("met_rh"),
        F.lit("sd_card").alias("source"),
    )


def wind_rows(raw: DataFrame, start, tie_break: Sequence[Column] = ()) -> DataFrame:
    """Wind readings, one per monitor and time, from a start date on."""
    rows = raw.where(F.col("timestamp_iso") >= moment(start))
    order = list(tie_break) or [F.col("ws"), F.col("wd")]
    return first_per_key(rows, ["monitor", "timestamp_iso"], order).select(
        "timestamp_iso", "ws", "wd", "monitor", F.lit("sd_card").alias("source")
    )


def village_population(sheet: DataFrame, spelling: Mapping[str, str]) -> DataFrame:
    """Households and population per village after cleaning the names."""
    return sheet.groupBy(clean_place("village", spelling).alias("village")).agg(
        F.sum("households").alias("households"), F.sum("population").alias("population")
    )


def read_baseline(
    spark: SparkSession, folder: str, pollutants: Sequence[str], kind: str = "csv"
) -> dict[str, DataFrame]:
    """Calibration tables by pollutant; typed and empty where no file exists."""
    out = {}
    for pollutant in pollutants:
        path = f"{folder}/calibration_{pollutant}.{kind}"
        if _existing(spark, [path]):
            out[pollutant] = read_typed(spark, path, CALIBRATION_SCHEMA, kind)
        else:
            out[pollutant] = empty_table(spark, CALIBRATION_SCHEMA)
    return out


def external_weather(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Station or summary table under the names the reports use, without incomplete rows."""
    return select_known(df.withColumnsRenamed(dict(columns)), list(columns.values())).dropna()


def write_readings(
    df: DataFrame, path: str, kind: str = "parquet", mode: str = "overwrite", files_per_day: int = 16
):
    """Write readings partitioned by date, each day spread evenly over a few files.

    The spread hashes monitor and time, so a monitor that sends most of a day is split as well.
    """
    spread = F.pmod(F.xxhash64("monitor", "timestamp"), F.lit(files_per_day))
    writer = df.repartition("date", spread).write.mode(mode).partitionBy("date")
    if kind == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.parquet(path)


def store_by_date(df: DataFrame, files_per_day: int = 16) -> DataFrame:
    """Write an intermediate table of readings to the shared folder and read it back.

    What several later steps use is computed once, survives lost executors, and steps that need a
    span of days read only those.
    """
    path = f"{shared_folder(df.sparkSession)}/readings-{uuid.uuid4().hex}"
    write_readings(df, path, files_per_day=files_per_day)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def write_summary(df: DataFrame, path: str, kind: str = "parquet", mode: str = "overwrite"):
    writer = df.write.mode(mode)
    if kind == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.parquet(path)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
