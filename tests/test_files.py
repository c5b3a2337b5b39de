"""Readers and writers on real files."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fleetfold.config import settings_from_yaml
from fleetfold.operators.calibrate import CALIBRATION_SCHEMA
from fleetfold.sources import logs, tables


def write(path, text, binary=False):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text) if binary else path.write_text(text, encoding="utf-8")
    return str(path)


def test_card_files_with_different_columns(spark, tmp_path):
    first = write(
        tmp_path / "a.csv",
        "timestamp_iso,monitor,pm25,pm1\n2024-01-01T00:00:00Z,MOD-1,2.5,NaN\n2024-01-01 00:01:00,MOD-1,x,1\n",
    )
    second = write(tmp_path / "b.csv", "monitor,pm10,timestamp_iso\nMOD-2,7,2024-01-02T00:00:00Z\n")
    df = tables.read_cards(spark, [first, str(tmp_path / "absent.csv"), second])
    rows = {(r.monitor, r.timestamp_iso.minute): r for r in df.collect()}
    assert len(rows) == 3
    assert rows["MOD-1", 0].pm25 == 2.5 and rows["MOD-1", 0].pm1 is None
    assert rows["MOD-1", 1].pm25 is None and rows["MOD-1", 1].pm1 == 1.0
    assert rows["MOD-2", 0].pm10 == 7.0 and rows["MOD-2", 0].source == "sd_card"


def test_no_card_file_gives_the_template(spark, tmp_path):
    df = tables.read_cards(spark, [str(tmp_path / "none.csv")])
    assert df.count() == 0
    assert df.columns == [p.strip().split(" ")[0] for p in tables.CARD_SCHEMA.split(",")]


def test_device_files_take_the_monitor_from_the_name(spark, tmp_path):
    paths = [
        write(tmp_path / f"MOD-PM-0000{i}_x.csv",
              "timestamp_iso,pm1,pm10,pm25\n2024-01-01 00:00:00,1,%d,3\n" % (i * 3000))
        for i in (1, 2)
    ]
    rows = tables.read_device_files(spark, paths, ["pm1", "pm10", "pm25"]).collect()
    assert [(r.monitor, r.pm10) for r in rows] == [("MOD-PM-00001", 3000.0)]


def test_raw_files_skip_the_preamble(spark, tmp_path):
    text = "a\nb\nc\nid,timestamp_iso,x\n1,2024-01-01 05:00:01,9\n2\n3,\xa02024-01-01 05:30:00\n4,bad,1\n"
    write(tmp_path / "raw" / "f.csv", text.encode("utf-8"), binary=True)
    files = logs.read_whole_files(spark, str(tmp_path / "raw"))
    hours = logs.raw_file_hours(files, F.lit("m"), dt.date(2023, 1, 1), dt.date(2025, 1, 1)).collect()
    assert [(r.date_hour.hour, r.observation_count) for r in hours] == [(5, 2)]


def test_inventory_and_audit(spark, tmp_path):
    base = tmp_path / "sd"
    write(base / "MOD_PM_00001" / "DATA_20250317@FW24.csv", 'x\ndeviceSN,"MOD_PM_00001"\n')
    write(base / "MOD_PM_00001" / "DATA_20250318@FW24.csv", "x\nDEVICESN;MOD-PM-00009\n")
    write(base / "MOD_PM_00002" / "DATA_20250317@FW24.csv", "x\n" * 80 + "deviceSN,MOD-PM-00002\n")
    write(base / "MOD_PM_00003" / "DATA_20250317@FW24.csv", "deviceSN,MOD-PM-00004\n")
    write(base / "MOD_PM_00003" / "other.csv", "deviceSN,MOD-PM-00004\n")
    paths = logs.list_files(spark, str(base))
    days = {(r.monitor, r.date.isoformat()) for r in logs.file_inventory(paths).collect()}
    assert days == {
        ("MOD-PM-00001", "2025-03-17"), ("MOD-PM-00001", "2025-03-18"),
        ("MOD-PM-00002", "2025-03-17"), ("MOD-PM-00003", "2025-03-17"),
    }
    files = logs.read_whole_files(spark, [str(p) for p in base.glob("*/*.csv")])
    whole = {r.folder: r for r in logs.audit_folders(files).collect()}
    assert whole["MOD_PM_00002"].device_sns == "MOD-PM-00002"
    audit = {r.folder: r for r in logs.audit_folders(files, header_lines=80).collect()}
    assert audit["MOD_PM_00001"].has_multiple_sns
    assert audit["MOD_PM_00002"].missing_device_sn
    assert audit["MOD_PM_00003"].single_sn_mismatch and audit["MOD_PM_00003"].n_csv == 2


def test_baseline_tables(spark, tmp_path):
    row = ("m", "pm25", 2.0, 1.0, 0.9, 1.0, 5, "fleet_avg", None, dt.datetime(2024, 1, 1),
           dt.datetime(2024, 1, 2), dt.date(2024, 2, 1), "w")
    table = spark.createDataFrame([row], CALIBRATION_SCHEMA)
    tables.write_summary(table, str(tmp_path / "calibration_pm25.csv"), "csv")
    found = tables.read_baseline(spark, str(tmp_path), ["pm25", "pm1"])
    assert [tuple(r) for r in found["pm25"].collect()] == [row]
    assert found["pm1"].count() == 0 and found["pm1"].schema == table.schema


def test_parquet_nan_becomes_null(spark, tmp_path):
    df = spark.createDataFrame([(float("nan"),), (1.0,)], "x double")
    tables.write_summary(df, str(tmp_path / "t"))
    back = tables.read_typed(spark, str(tmp_path / "t"), "x double")
    assert back.where("x IS NULL").count() == 1
    with pytest.raises(ValueError):
        tables.read_typed(spark, str(tmp_path / "t"), "x double", "xlsx")


def test_settings_from_yaml(tmp_path):
    pytest.importorskip("yaml")
    path = write(
        tmp_path / "s.yml",
        'thresholds:\n  min_points: 5\ncolocation_windows:\n  - name: w\n    start: "2024-01-01"\n'
        "    end: 2024-01-05\n    monitors: g\n",
    )
    settings = settings_from_yaml(path)
    assert settings.fit.min_points == 5 and settings.window("w").end == dt.date(2024, 1, 5)


def test_columns_follow_the_header_of_each_file(spark, tmp_path):
    write(tmp_path / "t" / "a b.csv", "intercept,slope,monitor\n5.0,2.0,M1\n")
    write(tmp_path / "t" / "b.csv", "﻿monitor,extra,slope,slope\nM2,x,3.0,9.0\n")
    write(tmp_path / "t" / "c.csv", "monitor,slope,intercept\n")
    df = tables.read_typed(
        spark, str(tmp_path / "t"), "monitor string, slope double, intercept double", "csv"
    )
    assert sorted(tuple(r) for r in df.collect()) == [("M1", 2.0, 5.0), ("M2", 3.0, None)]


def test_device_files_with_swapped_channels(spark, tmp_path):
    paths = [
        write(tmp_path / "MOD-00001_a.csv", "timestamp_iso,pm1,pm25\n2024-01-01 00:00:00,1,25\n"),
        write(tmp_path / "MOD-00002_b.csv", "pm25,timestamp_iso,pm1\n25,2024-01-01 00:00:00,1\n"),
        write(tmp_path / "MOD-00003_c.csv", "timestamp_iso,pm25\n2024-01-01 00:00:00,25\n"),
    ]
    rows = tables.read_device_files(spark, paths, ["pm1", "pm25"], limit_pm10=False).collect()
    assert sorted((r.monitor, r.pm1, r.pm25) for r in rows) == [
        ("MOD-00001", 1.0, 25.0), ("MOD-00002", 1.0, 25.0), ("MOD-00003", None, 25.0)
    ]


def test_many_files_of_one_header_are_one_scan(spark, tmp_path):
    for i in range(40):
        write(tmp_path / "many" / f"{i}.csv", f"monitor,slope\nM{i},{i}\n")
    df = tables.read_typed(spark, str(tmp_path / "many"), "monitor string, slope double", "csv")
    assert df._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert df.count() == 40


def test_lines_of_split_files_are_numbered(spark, tmp_path):
    texts = {f"{n}.log": [f"{n} {i} {'x' * (i % 90)}" for i in range(5000)] for n in "ab"} | {"one.log": ["only"], "none.log": []}
    for name, lines in texts.items():
        write(tmp_path / "logs" / name, "\r\n".join(lines) + ("\n" if lines else ""))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40k")
    try:
        rows = logs.read_lines(spark, str(tmp_path / "logs")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len({r.block for r in rows}) > 3
    for name, lines in texts.items():
        mine = sorted((r.number, r.line) for r in rows if r.path.endswith(f"/{name}"))
        assert mine == [(i + 1, line) for i, line in enumerate(lines)]


def test_pairs_across_blocks(spark, tmp_path):
    text, n = [], 3000
    for i in range(n):
        text += [f" P  {i}"] + ["other"] * (i % 3) + ([f"N_ {i}"] if i % 4 else [])
    write(tmp_path / "logs" / "f.TXT", "\n".join(text))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        pairs = logs.pair_lines(logs.read_lines(spark, str(tmp_path / "logs"))).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    partners = [i for i in range(n) if i % 4]
    assert sorted((r.ordinal, int(r.p_line), int(r.n_line)) for r in pairs) == [(k + 1, k, i) for k, i in enumerate(partners)]
