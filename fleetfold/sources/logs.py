"""Text logs of instruments, parsed line by line with built-in expressions.

``read_lines`` numbers the lines of files of any size: a file is cut into blocks that different tasks
read, and a line's number is its place in the block plus the lines of the blocks before it. Functions
take such lines, or rows (path, content) of small whole files.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetfold.functions.calendar import moment, truncate
from fleetfold.functions.columns import FOLDER_ID_PATTERN, adc_value, adc_volts
from fleetfold.session import settle

# Fixed values of the optical reference instrument: factor and offset of each analogue channel.
TEMPERATURE = (20.0, 2.0)
HUMIDITY = (20.0, 0.0)
PRESSURE = (176.21145, 0.275)

TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss"
LINE_END = r"\r?\n"


def read_whole_files(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    return spark.read.text(
        paths if isinstance(paths, str) else list(paths), wholetext=True
    ).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def list_files(spark: SparkSession, pattern: str) -> DataFrame:
    """Paths below a pattern; file contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(pattern)
        .select("path")
    )


def read_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(path, block, number, line) of text files; numbers start at 1 in every file.

    The lines are stored once with an id that counts within a task, so the place within a block is a
    difference of two ids; only counts per block are summed up. Empty files have no lines.
    """
    raw = spark.read.text(paths if isinstance(paths, str) else list(paths)).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.regexp_replace("value", r"\r$", "").alias("line"),
        F.monotonically_increasing_id().alias("_at"),
    )
    lines = settle(raw)
    blocks = lines.groupBy("path", "block").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_lines"))
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = settle(
        blocks.select("path", "block", (F.coalesce(F.sum("_lines").over(earlier), F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    )
    numbered = lines.join(starts, ["path", "block"])
    return numbered.select("path", "block", (F.col("_at") + F.col("_shift")).alias("number"), "line")


def numbered_lines(files: DataFrame) -> DataFrame:
    """(path, block, number, line), also of small whole files given as (path, content)."""
    if "content" not in files.columns:
        return files.select("path", "block", "number", "line")
    split = files.select("path", F.posexplode(F.split("content", LINE_END)).alias("_i", "line"))
    return split.select("path", F.lit(0).cast("bigint").alias("block"), (F.col("_i") + 1).cast("bigint").alias("number"), "line")


def file_name(path: Column | str) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def folder_name(path: Column | str) -> Column:
    return F.try_element_at(F.split(path, "/"), F.lit(-2))


def _pairs_in_row(files: DataFrame) -> DataFrame:
    lines = F.split("content", LINE_END)
    p_lines = F.filter(lines, lambda v: v.rlike(r"^\s*P"))
    n_lines = F.filter(lines, lambda v: v.rlike(r"^\s*N_"))
    pairs = F.zip_with(
        F.slice(p_lines, F.lit(1), F.size(n_lines)),
        n_lines,
        lambda p, n: F.struct(p.alias("p"), n.alias("n")),
    )
    return (
        files.select("path", F.posexplode(pairs).alias("i", "pair"))
        .where(F.col("pair.p").isNotNull())
        .select(
            "path",
            (F.col("i") + 1).alias("ordinal"),
            F.regexp_replace(F.trim("pair.p"), r"^P\s+", "").alias("p_line"),
            F.regexp_replace(F.trim("pair.n"), r"^N_\s+", "").alias("n_line"),
        )
    )


def pair_lines(files: DataFrame) -> DataFrame:
    """Pair the i-th P line of a file with its i-th N line; lines without partner are dropped.

    Small whole files are paired within their row. Of lines of large files the kinds are counted per
    block and the counts summed over the blocks before, so a task orders the lines of one block at most.
    """
    if "content" in files.columns:
        return _pairs_in_row(files)
    line = F.col("line")
    kind = F.when(line.rlike(r"^\s*P"), "p").when(line.rlike(r"^\s*N_"), "n").alias("_kind")
    marked = numbered_lines(files).select("path", "block", "number", kind, "line").where("_kind IS NOT NULL")
    group = ["path", "block", "_kind"]
    counts = marked.groupBy(*group).agg(F.count(F.lit(1)).alias("_lines"))
    earlier = Window.partitionBy("path", "_kind").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = settle(counts.select(*group, F.coalesce(F.sum("_lines").over(earlier), F.lit(0)).alias("_before")))
    inside = F.row_number().over(Window.partitionBy(*group).orderBy("number"))
    ordinal = (F.col("_before") + F.col("_inside")).cast("int").alias("ordinal")
    placed = marked.withColumn("_inside", inside).join(before, group).select("path", ordinal, "_kind", "line")
    of = lambda k: F.max(F.when(F.col("_kind") == k, F.col("line"))).alias(f"_{k}")
    pairs = placed.groupBy("path", "ordinal").agg(of("p"), of("n")).where("_p IS NOT NULL AND _n IS NOT NULL")
    return pairs.select(
        "path",
        "ordinal",
        F.regexp_replace(F.trim("_p"), r"^P\s+", "").alias("p_line"),
        F.regexp_replace(F.trim("_n"), r"^N_\s+", "").alias("n_line"),
    )


def optical_readings(files: DataFrame) -> DataFrame:
    """Readings of the optical instrument: packed analogue values to °C, %RH and hPa, plus PM."""
    paired = pair_lines(files).withColumns(
        {"_p": F.split(F.trim("p_line"), r"\s+"), "_n": F.split(F.trim("n_line"), r"\s+")}
    )

    def field(position: int, kind: str = "int") -> Column:
        return F.try_element_at(F.col("_p"), F.lit(position + 1)).try_cast(kind)

    def channel(position: int, number: int, scale: tuple[float, float]) -> Column:
        volts = adc_volts(adc_value(field(10), field(position), number))
        factor, offset = scale
        return (volts - offset) * factor

    moment = F.make_timestamp_ntz(
        field(0) + 2000, field(1), field(2), field(3), field(4), F.lit(0)
    )
    return paired.select(
        file_name("path").alias("file"),
        "ordinal",
        moment.alias("datetime"),
        field(7).alias("error_code"),
        channel(14, 1, TEMPERATURE).alias("temp_c"),
        channel(13, 2, HUMIDITY).alias("rh_percent"),
        channel(11, 4, PRESSURE).alias("pressure_hpa"),
        F.try_element_at(F.col("_n"), F.lit(1)).try_cast("double").alias("pm10"),
        F.try_element_at(F.col("_n"), F.lit(2)).try_cast("double").alias("pm25"),
    )


def table_rows(files: DataFrame, columns: Sequence[str], preamble: int = 3) -> DataFrame:
    """Text cells of the named columns of delimited files whose header follows ``preamble`` lines.

    Small whole files are cut within their row; of lines the headers are a small table joined by path. Ragged rows give null cells; characters
    outside ASCII are removed; files without a column give null for it.
    """
    names = lambda line: F.transform(F.split(line, ","), lambda h: F.trim(F.replace(h, F.lit('"'), F.lit(""))))
    if "content" in files.columns:
        lines = F.split("content", LINE_END)
        first = F.coalesce(F.try_element_at(lines, F.lit(preamble + 1)), F.lit(""))
        rest = F.explode(F.slice(lines, F.lit(preamble + 2), F.size(lines))).alias("line")
        rows = files.select("path", names(first).alias("_header"), rest)
    else:
        lines = numbered_lines(files)
        heads = settle(lines.where(F.col("number") == preamble + 1).select("path", names(F.col("line")).alias("_header")))
        rows = lines.where(F.col("number") > preamble + 1).join(heads, "path")
    rows = rows.where(F.length(F.trim("line")) > 0)
    cells = F.split("line", ",")

    def cell(name: str) -> Column:
        at = F.array_position("_header", F.lit(name)).cast("int")
        found = F.when(at > 0, F.try_element_at(cells, F.when(at > 0, at)))
        ascii_only = F.regexp_replace(found, r"[^\x00-\x7F]", "")
        return F.trim(F.replace(ascii_only, F.lit('"'), F.lit(""))).alias(name)

    return rows.select("path", *[cell(c) for c in columns])


def raw_file_hours(files: DataFrame, monitor: Column, start, end, preamble: int = 3) -> DataFrame:
    """Observations per hour of raw device files; unreadable timestamps are dropped."""
    cells = table_rows(files, ["timestamp_iso"], preamble)
    moments = cells.select(
        "path",
        F.try_to_timestamp("timestamp_iso", F.lit(TIMESTAMP_FORMAT))
        .cast("timestamp_ntz")
        .alias("_ts"),
    ).where("_ts IS NOT NULL")
    return (
        moments.groupBy(monitor.alias("monitor"), truncate("_ts", "hour").alias("date_hour"))
        .agg(F.count(F.lit(1)).alias("observation_count"))
        .where(
            (F.col("date_hour") > moment(start)) & (F.col("date_hour") < moment(end))
        )
    )


def attenuation_rows(
    files: DataFrame, names: Mapping[str, str], status: str = "Status", time: str = "Time",
    preamble: int = 4,
) -> DataFrame:
    """Rows of the beta-attenuation export under the given output names."""
    cells = table_rows(files, [time, *names, status], preamble)
    return cells.select(
        F.try_to_timestamp(F.col(f"`{time}`"), F.lit(TIMESTAMP_FORMAT))
        .cast("timestamp_ntz")
        .alias("time"),
        *[F.col(f"`{c}`").try_cast("double").alias(n) for c, n in names.items()],
        F.col(f"`{status}`").alias("status"),
    )


def device_serials(files: DataFrame, header_lines: int | None = None) -> DataFrame:
    """(path, folder, serial) of each file: a filter on its lines finds the ``deviceSN`` ones, the first counts.

    Only the first ``header_lines`` lines count if given. Files that have none get a null serial.
    """
    label = r"^\s*devicesn\s*[,;\t]\s*"
    lines = numbered_lines(files)
    named = F.lower("line").rlike(label)
    if header_lines is not None:
        named = named & (F.col("number") <= header_lines)
    value = F.trim(F.regexp_replace("line", f"(?i){label}", ""))
    serial = F.translate(F.regexp_replace(value, '^"|"$', ""), "_", "-")
    found = F.when(named, F.struct("number", F.when(serial != "", serial).alias("serial")))
    first = lines.groupBy("path").agg(F.min(found).alias("_first"))
    return first.select("path", folder_name("path").alias("folder"), F.col("_first.serial").alias("serial"))


def audit_folders(files: DataFrame, header_lines: int | None = None) -> DataFrame:
    """Serial numbers found in each folder against the one its name promises."""
    expected = F.regexp_extract("folder", FOLDER_ID_PATTERN, 0)
    folders = device_serials(
        files.where(~F.col("path").contains("/logs/")), header_lines
    ).groupBy("folder").agg(
        F.count(F.lit(1)).alias("n_csv"), F.array_sort(F.collect_set("serial")).alias("serials")
    )
    n = F.size("serials")
    promised = F.when(expected != "", F.translate(expected, "_", "-"))
    return folders.withColumns({"expected_sn": promised, "n_unique": n}).select(
        "folder",
        "expected_sn",
        "n_csv",
        F.array_join("serials", ", ").alias("device_sns"),
        F.col("n_unique").alias("n_unique_device_sn"),
        (F.col("n_unique") > 1).alias("has_multiple_sns"),
        F.coalesce(
            (F.col("n_unique") == 1)
            & (F.try_element_at("serials", F.lit(1)) != F.col("expected_sn")),
            F.lit(False),
        ).alias("single_sn_mismatch"),
        (F.col("n_unique") == 0).alias("missing_device_sn"),
    )


def file_inventory(paths: DataFrame) -> DataFrame:
    """Distinct (monitor, date) of card files named DATA_<yyyymmdd>@..., logs left out."""
    code = F.regexp_extract("path", FOLDER_ID_PATTERN, 0)
    stamp = F.regexp_extract(file_name("path"), r"^DATA_(\d{8})@", 1)
    return (
        paths.where(~F.col("path").contains("/logs/"))
        .select(
            F.translate(code, "_", "-").alias("monitor"),
            F.try_to_timestamp(stamp, F.lit("yyyyMMdd")).cast("date").alias("date"),
        )
        .where((F.col("monitor") != "") & F.col("date").isNotNull())
        .distinct()
    )
