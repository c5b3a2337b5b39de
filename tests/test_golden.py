"""Hand-computed cases."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetfold.config import RollupRules, settings_from_mapping
from fleetfold.functions import columns as col
from fleetfold.operators import calibrate, impute, merge, rollup, trends
from fleetfold.operators.calibrate import CALIBRATION_SCHEMA
from fleetfold.sources import logs

T = dt.datetime(2024, 1, 1, 10, 0)
DAY = dt.date(2024, 1, 1)


def minute(i):
    return T + dt.timedelta(minutes=i)


@pytest.mark.parametrize("unique", [True, False])
def test_merge_presence_cases(spark, unique):
    cloud = spark.createDataFrame(
        [
            ("a", minute(0), DAY, 10, 1.0, "cloud"),
            ("a", minute(1), DAY, 10, 2.0, "cloud"),
            ("a", minute(3), DAY, 10, None, None),
            ("a", minute(4), DAY, 10, None, None),
        ],
        "monitor string, timestamp timestamp_ntz, date date, hour int, pm25 double, source string",
    )
    card = spark.createDataFrame(
        [("a", minute(0), 9.0), ("a", minute(2), 3.0), ("a", minute(3), 4.0), ("a", minute(4), None)],
        "monitor string, timestamp_iso timestamp_ntz, pm25 double",
    )
    full = {
        r.timestamp.minute: (r.pm25, r.source, r.date, r.hour)
        for r in merge.merge_feeds(cloud, card, "pm25", unique=unique).collect()
    }
    assert full == {
        0: (1.0, "cloud", DAY, 10),
        1: (2.0, "cloud", DAY, 10),
        2: (3.0, "sd_card", None, None),
        3: (4.0, "sd_card", DAY, 10),
        4: (None, None, DAY, 10),
    }
    derived = merge.merge_feeds(cloud, card, "pm25", derive_calendar=True, unique=unique)
    assert derived.where("date IS NULL OR hour IS NULL").count() == 0
    left = merge.merge_feeds(cloud, card, "pm25", "left", "source", unique=unique).collect()
    assert sorted((r.timestamp.minute, r.source) for r in left if r.source) == [
        (0, "cloud"), (1, "cloud"), (3, "sd_card"), (4, "sd_card"),
    ]
    assert len(left) == 4


def test_merge_keeps_all_pairs_of_duplicate_keys(spark):
    cloud = spark.createDataFrame(
        [("a", T, DAY, 10, 1.0), ("a", T, DAY, 10, 2.0)],
        "monitor string, timestamp timestamp_ntz, date date, hour int, pm25 double",
    )
    card = spark.createDataFrame(
        [("a", T, 5.0), ("a", T, 6.0)],
        "monitor string, timestamp_iso timestamp_ntz, pm25 double",
    )
    rows = merge.merge_feeds(cloud, card, "pm25", unique=False).collect()
    assert sorted(r.pm25 for r in rows) == [1.0, 1.0, 2.0, 2.0]


def calibration(spark, rows):
    base = dict(
        pollutant="pm25", intercept=1.0, r2=0.9, rmse=1.0, n_points=10, method="fleet_avg",
        reference_monitor=None, colocation_start=T, colocation_end=T, fitted_on=DAY,
        window_name="w",
    )
    names = [p.strip().split(" ")[0] for p in CALIBRATION_SCHEMA.split(",")]
    return spark.createDataFrame(
        [tuple({**base, **r}[n] for n in names) for r in rows], CALIBRATION_SCHEMA
    )


def test_apply_calibration_guards_and_floor(spark):
    cal = calibration(
        spark,
        [
            dict(monitor="good", slope=2.0),
            dict(monitor="null", slope=None),
            dict(monitor="zero", slope=0.0),
            dict(monitor="nan", slope=float("nan")),
            dict(monitor="inf", slope=float("inf")),
        ],
    )
    readings = spark.createDataFrame(
        [(m, T, DAY, 10, "cloud", v) for m, v in [
            ("good", 21.0), ("good", 2.0), ("good", 0.5), ("good", 1.0), ("null", 7.0), ("zero", 7.0),
            ("nan", 7.0), ("inf", 7.0), ("none", 7.0), ("none", 0.5), ("good", None),
        ]],
        "monitor string, timestamp timestamp_ntz, date date, hour int, source string, pm25 double",
    )
    rows = calibrate.apply_calibration(readings, cal, "pm25").collect()
    got = sorted(str((r.monitor, r.pm25_raw, r.pm25, r.calibrated_pm25)) for r in rows)
    assert got == sorted(
        str(r)
        for r in [
            ("good", 21.0, 10.0, True),
            ("good", 2.0, None, True),  # corrected 0.5 is below the minimum
            ("good", None, None, False),  # raw 0.5 is cut, so the flag is off
            ("good", 1.0, None, True),
            ("good", None, None, False),
            ("null", 7.0, 7.0, False),
            ("zero", 7.0, 7.0, False),
            ("nan", 7.0, 7.0, False),
            ("inf", 7.0, 7.0, False),
            ("none", 7.0, 7.0, False),
            ("none", None, None, False),
        ]
    )


def test_rollup_thresholds(spark):
    def hour(monitor, day, h, n, value=10.0):
        return [(monitor, dt.datetime(2024, 1, day, h, i), value) for i in range(n)]

    rows = hour("a", 1, 0, 44) + hour("a", 1, 1, 45) + hour("a", 1, 2, 60)
    rows += [("a", dt.datetime(2024, 1, 1, 0, 50), None)]
    df = spark.createDataFrame(rows, "monitor string, timestamp timestamp_ntz, pm25 double")
    hours = {r.hour: (r.n_minute_obs, r.mean_pm25) for r in rollup.hourly_means(df, "pm25").collect()}
    assert hours == {0: (44, None), 1: (45, 10.0), 2: (60, 10.0)}

    summary = spark.createDataFrame(
        [("a", DAY, h, 5.0) for h in range(17)] + [("b", DAY, h, float(h)) for h in range(18)],
        "monitor string, date date, hour int, mean_pm25 double",
    )
    days = {r.monitor: (r.n_complete_hours, r.mean_pm25)
            for r in rollup.daily_means(summary, "pm25").collect()}
    assert days == {"a": (17, None), "b": (18, 8.5)}

    fleet = spark.createDataFrame(
        [(f"m{i}", DAY, 0, 2.0) for i in range(9)] + [(f"m{i}", DAY, 1, 4.0) for i in range(10)],
        "monitor string, date date, hour int, mean_pm25 double",
    )
    for table in (
        rollup.fleet_means(fleet, "pm25", ["date", "hour"]),
        rollup.with_fleet_means(fleet, "pm25", ["date", "hour"]),
    ):
        got = {r.hour: (r.n_active, r.fleet_average_pm25) for r in table.collect()}
        assert got == {0: (9, None), 1: (10, 4.0)}


def test_rollup_derives_the_calendar_of_card_only_rows(spark):
    df = spark.createDataFrame(
        [("a", T, None, None, 3.0)],
        "monitor string, timestamp timestamp_ntz, date date, hour int, pm25 double",
    )
    hourly, daily = rollup.summarize(df, "pm25", RollupRules(1, 1, 1))
    assert [(r.date, r.hour, r.mean_pm25) for r in hourly.collect()] == [(DAY, 10, 3.0)]
    assert [(r.date, r.mean_pm25) for r in daily.collect()] == [(DAY, 3.0)]


def test_most_recent_fit(spark):
    newer, older = dt.date(2024, 3, 1), dt.date(2024, 2, 1)
    cal = calibration(
        spark,
        [
            dict(monitor="date", slope=1.0, fitted_on=older),
            dict(monitor="date", slope=2.0, fitted_on=newer, n_points=1),
            dict(monitor="end", slope=1.0, fitted_on=None, colocation_end=dt.datetime(2024, 5, 1)),
            dict(monitor="end", slope=2.0, fitted_on=newer),
            dict(monitor="points", slope=1.0, n_points=5),
            dict(monitor="points", slope=2.0, n_points=6, r2=0.1),
            dict(monitor="r2", slope=1.0, r2=0.8),
            dict(monitor="r2", slope=2.0, r2=0.85),
            dict(monitor="date", slope=9.0, pollutant="pm1", fitted_on=dt.date(2025, 1, 1)),
        ],
    )
    got = {r.monitor: r.slope for r in calibrate.most_recent_fit(cal, "pm25").collect()}
    assert got == {"date": 2.0, "end": 1.0, "points": 2.0, "r2": 2.0}


def test_gas_regression_shapes(spark):
    rows = [("few", T, float(i), float(i)) for i in range(3)]
    rows += [("poor", T, float(i), float((i * 7) % 5)) for i in range(20)]
    rows += [("good", T, float(i), 2.0 * i + 1) for i in range(20)]
    df = spark.createDataFrame(
        rows, "monitor string, timestamp timestamp_ntz, reference_co double, co double"
    )
    got = {r.monitor: (r.slope, r.intercept, r.R2)
           for r in calibrate.gas_regressions(df, ["co"], 10, 0.5).collect()}
    assert got["few"] == (None, None, None)
    assert got["poor"][:2] == (None, None) and got["poor"][2] < 0.5
    assert got["good"] == pytest.approx((2.0, 1.0, 1.0))


def test_optical_log(spark):
    p = "P  24 1 2 3 {minute} 1 100 0 85 40 228 150 7 120 110 5"
    content = "\n".join([
        "junk", "  " + p.format(minute=4), "K 1 2", "N_  12.5  3.5", p.format(minute=5), "N_ 8 2",
        p.format(minute=6),
    ])
    df = spark.createDataFrame([("/x/day.TXT", content)], "path string, content string")
    rows = sorted(logs.optical_readings(df).collect(), key=lambda r: r.ordinal)
    assert [(r.datetime.minute, r.pm10, r.pm25) for r in rows] == [(4, 12.5, 3.5), (5, 8.0, 2.0)]
    # 228 = 0b11100100: low bits 0, 1, 2, 3 of channels 1 to 4
    assert rows[0].datetime == dt.datetime(2024, 1, 2, 3, 4)
    assert rows[0].temp_c == pytest.approx(((110 * 4 + 0) * 10 / 1024 - 2.0) * 20)
    assert rows[0].rh_percent == pytest.approx(((120 * 4 + 1) * 10 / 1024) * 20)
    assert rows[0].pressure_hpa == pytest.approx(((150 * 4 + 3) * 10 / 1024 - 0.275) * 176.21145)


def test_aqi_edges(spark):
    df = spark.createDataFrame(
        [(v,) for v in (8.99, 9.0, 35.4, 55.4, 125.4, 225.4, None)], "x double"
    )
    got = [r[0] for r in df.select(col.aqi_class("x")).collect()]
    assert got == [
        "Good", "Moderate", "Unhealthy for Sensitive Groups", "Unhealthy", "Very Unhealthy",
        "Hazardous", None,
    ]


def test_leave_one_out_cases(spark):
    df = spark.createDataFrame(
        [("a", 1, 1.0), ("b", 1, 2.0), ("c", 1, 6.0), ("d", 1, None), ("a", 2, 1.0), ("b", 2, 5.0)],
        "monitor string, timestamp int, v double",
    )

    def run(mode):
        return {
            (r.monitor, r.timestamp): r.fleet_avg
            for r in impute.leave_one_out(df, "v", mode=mode).collect()
        }

    assert run("compat") == {
        ("a", 1): 4.0, ("b", 1): 3.5, ("c", 1): 1.5, ("d", 1): None, ("a", 2): None, ("b", 2): None,
    }
    assert run("others")[("d", 1)] == 3.0
    filled = {
        r.monitor: (r.x_filled, r.x_data_source)
        for r in impute.fill_gaps(
            impute.leave_one_out(df.where("timestamp = 1"), "v", mode="others"), "v", "fleet_avg", "x"
        ).collect()
    }
    assert filled["d"] == (3.0, "imputed") and filled["a"] == (1.0, "observed")


def test_reference_errors(spark):
    cal = calibration(spark, [dict(monitor="r", slope=0.0)])
    rows = spark.createDataFrame(
        [("r", T, DAY, 1.0)], "monitor string, timestamp timestamp_ntz, date date, pm25 double"
    )
    for monitor in ("r", "unknown"):
        target = rows.withColumn("monitor", F.lit(monitor))
        with pytest.raises(Exception, match="no usable baseline"):
            calibrate.corrected_reference(target, "pm25", monitor, cal).collect()


def test_settings():
    settings = settings_from_mapping(
        {
            "thresholds": {"min_active_monitors": 3, "min_points": 1000, "min_r2": 0.7},
            "colocation_windows": [
                {"name": "w", "start": "2023-08-16", "end": "2023-09-20", "monitors": "g",
                 "reference_monitor": None}
            ],
            "gas_calibration": {
                "reference_monitor": "m", "window_start": "2023-08-16", "window_end": "2023-10-26",
                "gases": ["co"], "thresholds": {"min_points": 500, "min_r2": 0.5},
            },
        }
    )
    assert settings.window("w").start == dt.date(2023, 8, 16)
    assert settings.gas.gases == ("co",)
    with pytest.raises(KeyError):
        settings.window("absent")


def test_significant_digits(spark):
    df = spark.createDataFrame([(123456.0,), (0.0012345,), (0.0,), (-98.76,)], "x double")
    got = [r[0] for r in df.select(col.significant("x")).collect()]
    assert got == pytest.approx([123000.0, 0.00123, 0.0, -98.8])
    assert not any(math.isnan(v) for v in got)
    assert np.isfinite(got).all()


def test_tuning_errors_do_not_depend_on_an_offset(spark):
    rng = random.Random(4)
    rows = [(t, m, rng.gauss(0, 1) + t % 5) for t in range(40) for m in range(2 + t % 6)]
    errors = []
    for offset in (0.0, 1e8):
        df = spark.createDataFrame([(t, m, v + offset) for t, m, v in rows], "timestamp int, monitor int, v double")
        errors.append({r.min_active: (r.rmse, r.mae, r.r2) for r in impute.tune_min_others(df, "v", [1, 2, 4]).collect()})
    assert errors[0].keys() == errors[1].keys() == {1, 2, 4}
    for active in errors[0]:
        assert errors[1][active] == pytest.approx(errors[0][active], rel=1e-5)


def test_extrapolation_is_judged_by_the_training_rows(spark):
    train = spark.createDataFrame([(1.0, 5.0), (3.0, None), (2.0, 9.0)], "a double, b double")
    rows = spark.createDataFrame([(1, 1.0, 9.0), (2, 0.9, 6.0), (3, 3.1, 9.1), (4, 2.0, 4.0)], "key int, a double, b double")
    flagged = trends.flag_extrapolation(rows, trends.training_ranges(train, ["a", "b"]), ["a", "b"])
    found = {r.key: (r.out_a, r.out_b, r.any_extrapolation) for r in flagged.collect()}
    assert found == {1: (False, False, False), 2: (True, False, True), 3: (True, True, True), 4: (False, True, True)}
    share = trends.extrapolation_share(flagged, ["a", "b"]).first()
    assert (share.n, share.pct_any_extrapolation, share.pct_out_a, share.pct_out_b) == (4, 75.0, 50.0, 50.0)
