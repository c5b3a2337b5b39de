"""Physical plans keep to what a large cluster needs."""

import os
import re

import pytest
from bench import HEADLINE

from fleetfold.catalog import all_queries

QUERIES = all_queries()
EAGER = re.compile(r"^(m0[789]|m1[012348]|m17|m20_f|m26|s1[567]|job_)")
EVERYTHING = os.environ.get("FLEETFOLD_ALL_QUERIES") == "1"
# a colocation without a usable fit fails before there is a plan, so these need the larger sample
LARGER = {"m01_calibrate_fleet", "m02_calibrate_on_reference", "m03_calibrate_windows"}
LARGER_SAMPLE = "/root/testdata/sf0.01"
PLAIN = [n for n in sorted(QUERIES if EVERYTHING else HEADLINE) if not EAGER.match(n)]


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", PLAIN)
def test_no_row_at_a_time_python_and_no_cross_join(spark, sample, name):
    plan = plan_of(QUERIES[name](spark, LARGER_SAMPLE if name in LARGER else sample))
    assert "BatchEvalPython" not in plan
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_rollup_scans_once_and_prunes(spark, sample):
    plan = plan_of(QUERIES["a01_hourly_completeness"](spark, sample))
    assert plan.count("FileScan") == 1
    columns = "event_id:bigint,ts:timestamp_ntz,user_id:bigint,value:double"
    assert f"ReadSchema: struct<{columns}>" in plan
    assert plan.count("Exchange hashpartitioning") == 2


def test_first_rows_are_limited_before_the_exchange(spark, sample):
    plan = plan_of(QUERIES["w04_first_row_per_key"](spark, sample))
    assert plan.count("WindowGroupLimit") == 2


def test_calibration_is_a_broadcast_lookup(spark, sample):
    plan = plan_of(QUERIES["m04_apply_calibration"](spark, sample))
    assert "BroadcastHashJoin [monitor" in plan


def test_date_filter_reaches_the_partitions(spark, sample):
    plan = plan_of(QUERIES["s15_write_and_prune_by_date"](spark, sample))
    assert re.search(r"PartitionFilters: \[.*date", plan)


def test_merge_of_repeated_keys_has_no_outer_join(spark, sample):
    plan = plan_of(QUERIES["j01_merge_full_with_duplicates"](spark, sample))
    assert "FullOuter" not in plan and plan.count("LeftAnti") >= 2


def test_channels_combine_in_one_grouping(spark, sample):
    plan = plan_of(QUERIES["j06_natural_full_join"](spark, sample))
    assert "Join" not in plan
