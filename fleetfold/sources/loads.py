"""Incremental loads of dated files: only new and changed files are read, only their dates rewritten.

A manifest beside the readings names every file already loaded by path, time of change and length. A load
compares it with the files that are there, reads the others, and replaces the dates they touch; a file
that changed first loses its old rows. The manifest is written last, so that a load that broke off is
simply repeated.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetfold.operators.ordering import first_per_key
from fleetfold.session import settle

FILE = ["path", "modified", "length"]


@dataclass(frozen=True)
class Load:
    """What a load did: files read, and the dates that were rewritten or emptied."""

    files: int
    dates: list


def _exists(spark: SparkSession, path: str) -> bool:
    location = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return location.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(location)


def _delete(spark: SparkSession, path: str) -> None:
    location = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    location.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(location, True)


def listed_files(spark: SparkSession, patterns: Sequence[str]) -> DataFrame:
    """(path, modified, length) of the files; their contents are not read."""
    found, of = spark.read.format("binaryFile").load(list(patterns)), F.col("_metadata")
    return found.select(of["file_path"].alias("path"), of["file_modification_time"].alias("modified"), of["file_size"].alias("length"))


def loaded_files(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest: for each path the version that was loaded last."""
    if not _exists(spark, f"{folder}/manifest"):
        return spark.createDataFrame([], "path string, modified timestamp, length bigint, load bigint")
    rows = spark.read.parquet(f"{folder}/manifest")
    return first_per_key(rows, ["path"], [F.desc("load")])


def load_new_files(
    spark: SparkSession,
    patterns: Sequence[str],
    folder: str,
    read: Callable[[list[str]], DataFrame],
    files_per_date: int = 1,
) -> Load:
    """Bring the readings below ``folder`` up to date with the files that match ``patterns``.

    ``read`` turns paths into rows with ``date`` and ``_path``. Rows without a date are kept under a date
    of their own. Files that vanished keep their rows. The paths of one load's new files pass the driver, the
    first load hands the patterns on instead.
    """
    known = loaded_files(spark, folder)
    fresh = settle(listed_files(spark, patterns).join(known.select(*FILE), FILE, "left_anti"))
    n = fresh.count()
    if n == 0:
        return Load(0, [])
    number = (known.agg(F.max("load")).first()[0] or 0) + 1
    first_load = number == 1
    paths = list(patterns) if first_load else [r.path for r in fresh.select("path").collect()]
    rows = settle(read(paths))
    target, spread = f"{folder}/readings", F.pmod(F.xxhash64(*rows.columns), F.lit(files_per_date))
    touched = rows.select("date")
    parts = [rows]
    if not first_load and _exists(spark, target):
        stored = spark.read.parquet(target).select(*rows.columns)
        changed = settle(fresh.join(known.select("path"), "path", "left_semi").select(F.col("path").alias("_path")))
        if not changed.isEmpty():
            touched = touched.union(stored.join(changed, "_path", "left_semi").select("date"))
        touched = settle(touched.distinct())
        same_date = F.col("date").eqNullSafe(F.col("_touched"))
        stays = stored.join(touched.select(F.col("date").alias("_touched")), same_date, "left_semi")
        # settled, because the dates it is read from are about to be replaced
        parts.append(settle(stays.join(fresh.select(F.col("path").alias("_path")), "_path", "left_anti")))
    whole = reduce(DataFrame.unionByName, parts)
    whole.repartition("date", spread).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(target)
    dates = [r.date for r in touched.distinct().orderBy("date").collect()]
    if len(parts) > 1:
        left = {r.date for r in whole.select("date").distinct().collect()}
        for date in dates:
            if date not in left:
                _delete(spark, f"{target}/date={'__HIVE_DEFAULT_PARTITION__' if date is None else date}")
    fresh.withColumn("load", F.lit(number).cast("bigint")).write.mode("append").parquet(f"{folder}/manifest")
    return Load(n, dates)


def loaded_readings(spark: SparkSession, folder: str, keys: Sequence[str] = ()) -> DataFrame:
    """The readings below ``folder``; with ``keys`` one row each, that of the last file by path."""
    rows = spark.read.parquet(f"{folder}/readings")
    return first_per_key(rows, keys, [F.desc("_path")]) if keys else rows
