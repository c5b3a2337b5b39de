"""Incremental loads equal full loads and touch only the dates of new files."""

import datetime as dt
import glob
import os

import pytest
from pyspark.sql import functions as F

from fleetfold.sources import tables
from fleetfold.sources.loads import load_new_files, loaded_files, loaded_readings


def put(folder, name, rows, header="monitor,timestamp_iso,pm25"):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "w") as file:
        file.write("\n".join([header, *rows]) + "\n")


@pytest.fixture
def reader(spark):
    def read(paths):
        raw = tables.read_by_header(spark, paths, ["monitor", "timestamp_iso", "pm25"])
        return raw.select("monitor", "timestamp_iso", F.col("pm25").try_cast("double").alias("pm25"), F.to_date(F.substring("timestamp_iso", 1, 10)).alias("date"), "_path")

    return read


def content(df):
    return sorted(((r.monitor, r.timestamp_iso, r.pm25, r.date) for r in df.drop("_path").collect()), key=str)


def test_late_and_changed_files(spark, reader, tmp_path):
    inbox, folder = str(tmp_path / "in"), str(tmp_path / "out")
    put(inbox, "a.csv", ["m1,2024-01-01 00:01:00,1", "m1,2024-01-02 00:01:00,2"])
    put(inbox, "b.csv", ["5.5,m2,2024-01-03 00:00:00", "6,m2,"], "pm25,monitor,timestamp_iso")
    load = load_new_files(spark, [f"{inbox}/*.csv"], folder, reader)
    assert load.files == 2 and load.dates == [None, dt.date(2024, 1, 1), dt.date(2024, 1, 2), dt.date(2024, 1, 3)]
    assert load_new_files(spark, [f"{inbox}/*.csv"], folder, reader).files == 0
    untouched = {d: os.path.getmtime(d) for d in glob.glob(f"{folder}/readings/date=*/*.parquet")}

    put(inbox, "late.csv", ["m3,2024-01-02 10:00:00,7", "m3,2024-01-09 10:00:00,8"])
    load = load_new_files(spark, [f"{inbox}/*.csv"], folder, reader)
    assert (load.files, load.dates) == (1, [dt.date(2024, 1, 2), dt.date(2024, 1, 9)])
    assert all(os.path.exists(f) == ("date=2024-01-02" not in f) for f in untouched)
    assert content(loaded_readings(spark, folder)) == content(reader([f"{inbox}/*.csv"]))

    # a changed file gives its old rows back: one date shrinks, one is emptied, one is new
    put(inbox, "late.csv", ["m3,2024-01-02 10:00:00,70", "m4,2024-01-05 10:00:00,9"])
    os.utime(f"{inbox}/late.csv", (2_000_000_000, 2_000_000_000))
    load = load_new_files(spark, [f"{inbox}/*.csv"], folder, reader)
    assert load.dates == [dt.date(2024, 1, 2), dt.date(2024, 1, 5), dt.date(2024, 1, 9)]
    assert content(loaded_readings(spark, folder)) == content(reader([f"{inbox}/*.csv"]))
    assert loaded_files(spark, folder).count() == 3


def test_a_load_that_broke_off_is_repeated(spark, reader, tmp_path):
    inbox, folder = str(tmp_path / "in"), str(tmp_path / "out")
    put(inbox, "a.csv", ["m1,2024-01-01 00:01:00,1"])
    load_new_files(spark, [f"{inbox}/*.csv"], folder, reader)
    put(inbox, "b.csv", ["m1,2024-01-01 00:01:00,4", "m2,2024-01-01 00:01:00,5"])

    def broken(paths):
        return reader(paths)

    # the rows are written but the manifest is not, as if the driver had been lost in between
    new = reader([f"{inbox}/*.csv"])
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(f"{folder}/readings")
    assert load_new_files(spark, [f"{inbox}/*.csv"], folder, broken).files == 1
    assert content(loaded_readings(spark, folder)) == content(reader([f"{inbox}/*.csv"]))
    one = loaded_readings(spark, folder, ["monitor", "timestamp_iso"]).collect()
    assert {(r.monitor, r.pm25) for r in one} == {("m1", 4.0), ("m2", 5.0)}


def test_headers_are_joined_by_path(spark, tmp_path):
    for i in range(40):
        names = ["x", "y"] if i % 2 else ["y", "x", "z"]
        put(str(tmp_path / "many"), f"{i}.csv", [",".join(str(i * 10 + "xyz".index(n)) for n in names)], ",".join(names))
    put(str(tmp_path / "many"), "quoted.csv", ['"a,b",', "", "c,d"], "x,y")
    df = tables.read_by_header(spark, [str(tmp_path / "many")], ["x", "y", "absent"])
    assert df.columns == ["x", "y", "absent", "_path"] and df.count() == 42
    plan = df._jdf.queryExecution().toString()
    assert plan.count("many/") < 10 and "0.csv" not in plan
    rows = {(r.x, r.y) for r in df.collect()}
    assert {("a,b", None), ("c", "d")} | {(str(i * 10), str(i * 10 + 1)) for i in range(40)} == rows
