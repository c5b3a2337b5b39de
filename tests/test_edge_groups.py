"""Null groups, groups of one or two rows, repeated keys, and shuffles of small dimensions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fleetfold.catalog import all_queries
from fleetfold.config import FitRules, Window
from fleetfold.functions.distributions import studentised_range_upper
from fleetfold.operators import calibrate, impute, merge, ordering, spatial, stats

GROUPS = [("a", 1.0, 2.0), ("b", 1.0, 1.0), ("b", 2.0, 2.5), (None, 3.0, 4.0), (None, 5.0, 5.0), (None, 4.0, 4.5)]


@pytest.fixture(scope="module")
def groups(spark):
    return spark.createDataFrame(GROUPS, "monitor string, y double, p double")


def test_error_metrics_of_null_and_single_groups(groups):
    rows = {r.monitor: r for r in stats.error_metrics(groups, "y", "p", ["monitor"]).collect()}
    assert set(rows) == {"a", "b", None}
    assert rows["a"].n == 1 and rows["a"].r2 is None and rows["a"].cvmae == 0.0
    assert rows[None].n == 3 and rows[None].cvmae == pytest.approx((0.5 + 0.5 + 0.0) / 12)


def test_quantiles_ranks_and_splits_keep_the_null_group(groups):
    medians = ordering.exact_quantiles(groups, "y", {"q": 0.5}, ["monitor"])
    attached = ordering.attach(groups, medians, ["monitor"]).select("monitor", "q").distinct()
    assert {(r.monitor, r.q) for r in attached.collect()} == {("a", 1.0), ("b", 1.5), (None, 4.0)}
    ranks = ordering.value_ranks(groups, "y", ["monitor"]).where("monitor is null")
    assert sorted((r.y, r.n_below) for r in ranks.collect()) == [(3.0, 0), (4.0, 1), (5.0, 2)]
    split = ordering.day_block_split(groups.withColumn("date", F.lit(dt.date(2024, 1, 1))), strata=["monitor"])
    assert split.count() == len(GROUPS)


def test_tests_of_degenerate_groups_are_null(spark, groups):
    one_level = groups.withColumn("level", F.lit("x"))
    assert all(r.f is None and r.p_value is None for r in stats.one_way_anova(one_level, "y", "level", ["monitor"]).collect())
    alone = groups.withColumn("level", F.monotonically_increasing_id().cast("string"))
    assert all(r.q is None for r in stats.tukey_pairs(alone, "y", "level", ["monitor"]).collect())
    constant = groups.withColumn("y", F.lit(1.0))
    assert stats.welch_test(constant, "y", F.col("monitor") == "b").first().t is None
    points = spark.createDataFrame([("a", 0.0, 0.0, 1.0), ("b", 1.0, 0.0, 2.0), ("c", 0.0, 1.0, 4.0)], "monitor string, x double, y double, value double")
    assert spatial.moran_test(points, 1).first().p_value is None
    steps = spark.createDataFrame([("a", 1, 2.0), ("b", 1, 2.0), ("c", 1, 2.0)], "monitor string, timestamp int, v double")
    assert [r.r2 for r in impute.tune_min_others(steps, "v", [1, 2]).collect()] == [None, None]


def test_between_squares_keep_digits_of_large_values(spark):
    rows = [(level, 1e9 + offset + d) for level, offset in (("x", 0.0), ("y", 1.0)) for d in (-0.5, 0.5)]
    df = spark.createDataFrame(rows, "level string, v double")
    assert stats.one_way_anova(df, "v", "level").first().ss_between == pytest.approx(1.0, rel=1e-6)


def test_studentised_range_is_continuous_in_its_degrees_of_freedom():
    below, above, far = (studentised_range_upper(3.5, 3, v) for v in (19_999.0, 20_001.0, 1e9))
    assert abs(below - above) < 1e-8 and 0 < below - far < 1e-4


def test_repeated_channel_values_are_an_error(spark):
    two = spark.createDataFrame([("m", 1, 1.0), ("m", 1, 9.0)], "monitor string, timestamp int, p double")
    other = spark.createDataFrame([("m", 1, 2.0)], "monitor string, timestamp int, q double")
    with pytest.raises(Exception, match="several values"):
        merge.combine_channels({"p": two, "q": other}, ["monitor", "timestamp"]).collect()


def test_missing_baseline_fails_without_reference_rows(spark):
    rows = spark.createDataFrame([], "monitor string, timestamp timestamp_ntz, date date, pm25 double")
    window = Window(name="w", start=dt.date(2024, 1, 1), end=dt.date(2024, 1, 2), reference_monitor="r")
    empty = spark.createDataFrame([], calibrate.CALIBRATION_SCHEMA)
    with pytest.raises(ValueError, match="no usable baseline"):
        calibrate.calibrate_on_reference(rows, "pm25", window, FitRules(), empty)


@pytest.mark.parametrize("name", ["j09_coefficient_lookup", "j13_fleet_restriction", "j17_validity_start"])
def test_small_dimensions_do_not_shuffle_the_readings(spark, sample, name):
    matching = [n for n in all_queries() if n.startswith(name[:3])]
    assert matching
    for found in matching:
        plan = all_queries()[found](spark, sample)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan
