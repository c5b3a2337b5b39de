"""Queries agree with their SQL; those without one at least run.

By default the headline queries are checked; FLEETFOLD_ALL_QUERIES=1 checks every one (minutes).
"""

import os

import pytest
from bench import HEADLINE
from oracle import compare, connect

from fleetfold.catalog import all_oracles, all_queries

ORACLES = all_oracles()
QUERIES = all_queries()
EVERYTHING = os.environ.get("FLEETFOLD_ALL_QUERIES") == "1"
CHECKED = sorted(ORACLES) if EVERYTHING else sorted(set(HEADLINE) & set(ORACLES))
UNCHECKED = sorted(set(QUERIES) - set(ORACLES))
ROWS_ONLY = UNCHECKED if EVERYTHING else ["m07_elastic_net", "m11_mixture_regression"]
# colocation fits need more hours than the smallest sample has
LARGER = {"m01_calibrate_fleet", "m02_calibrate_on_reference", "m03_calibrate_windows"}
LARGER_SAMPLE = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", CHECKED)
def test_matches_sql(spark, sample, duck, name):
    if name in LARGER:
        sample, duck = LARGER_SAMPLE, connect(LARGER_SAMPLE)
    problems = compare(QUERIES[name](spark, sample), duck, ORACLES[name])
    assert [p for p in problems if p != "no rows"] == []


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_runs(spark, name):
    assert QUERIES[name](spark, LARGER_SAMPLE).limit(1).count() == 1


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
