"""Time the headline queries; prints one JSON line.

Each query is run to completion into Spark's ``noop`` sink, so every row and column is computed.
The time reported is the best of ``BENCH_RUNS`` runs after one warm-up of the session.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from fleetfold.catalog import all_queries  # noqa: E402
from fleetfold.session import build_session  # noqa: E402

HEADLINE = [
    "a01_hourly_completeness",
    "a01_hourly_all_pollutants",
    "a02_daily_of_hourly",
    "a07_least_squares_by_monitor",
    "a14_missing_rate_by_monitor_date",
    "a16_availability_monitor_week",
    "a18_weekly_calendar_by_feed",
    "a19_feed_summary",
    "a20_hour_of_day_completeness",
    "a24_monitor_statistics",
    "a26_quartile_table",
    "a37_error_metrics_by_monitor",
    "a39_monitor_pairs",
    "j01_merge_full_priority",
    "j05_combine_any_source",
    "j06_natural_full_join",
    "j22_nearest_road",
    "j23_road_length_nearby",
    "j24_nearest_neighbours",
    "m01_calibrate_fleet",
    "m03_calibrate_windows",
    "m04_apply_calibration",
    "m05_apply_gas_calibration",
    "m11_mixture_regression_fixed",
    "m16_tune_leave_one_out",
    "m19_fill_gaps",
    "m21_anova_cooking_period",
    "m24_wilcoxon",
    "m25_moran",
    "r06_others_matrix",
    "s10_optical_readings",
    "w06_leave_one_out",
    "w09_row_ids",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = build_session("bench", cpus)
    spark.sparkContext.setLogLevel("ERROR")
    catalog = all_queries()
    spark.read.parquet(f"{sf}/events.parquet").groupBy("event_type").count().collect()
    times = {}
    for name in HEADLINE:
        best = None
        for _ in range(runs):
            start = time.perf_counter()
            catalog[name](spark, sf).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        times[name] = round(best, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
