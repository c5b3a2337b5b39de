"""Identities that hold for any input, and agreement with brute force."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetfold.functions import distributions as dist
from fleetfold.functions.mixture import (
    Mixture,
    conditional_mean,
    conditional_mean_with_gaps,
    responsibilities,
)
from fleetfold.operators import calibrate, impute, merge, models, ordering, spatial, stats, trends


@pytest.fixture(scope="module")
def numbers(spark):
    rng = random.Random(7)
    rows = [(rng.choice("aaaaab"), rng.choice([rng.gauss(0, 1), 0.5, 1e9])) for _ in range(3000)]
    rows += [("c", 4.0), ("d", None)]
    return rows, spark.createDataFrame(rows, "k string, v double").repartition(5)


def test_exact_quantiles(numbers):
    rows, df = numbers
    probs = {"q0": 0.0, "q1": 0.1, "q2": 0.5, "q3": 0.999, "q4": 1.0}
    got = {r.k: r for r in ordering.exact_quantiles(df, "v", probs, ["k"]).collect()}
    assert set(got) == {"a", "b", "c"}
    for key, row in got.items():
        values = [v for k, v in rows if k == key]
        for name, p in probs.items():
            assert row[name] == pytest.approx(np.quantile(values, p), rel=1e-12)
    whole = ordering.exact_quantiles(df, "v", {"m": 0.5}).first()
    assert whole.m == pytest.approx(np.median([v for _, v in rows if v is not None]))


def test_exact_quantiles_of_every_small_and_of_a_large_group(spark):
    rng = random.Random(3)
    groups = {n: [rng.gauss(0, 1) for _ in range(n)] for n in [*range(1, 40), 60_000]}
    rows = [(n, v) for n, values in groups.items() for v in values]
    import pandas as pd

    df = spark.createDataFrame(pd.DataFrame(rows, columns=["k", "v"])).repartition(7)
    probs = {"a": 0.25, "b": 0.5, "c": 0.9}
    for row in ordering.exact_quantiles(df, "v", probs, ["k"]).collect():
        expected = np.quantile(groups[row.k], list(probs.values()))
        assert [row.a, row.b, row.c] == pytest.approx(list(expected), rel=1e-12)


def test_value_ranks(numbers):
    rows, df = numbers
    for r in ordering.value_ranks(df, "v", ["k"]).collect():
        values = [v for k, v in rows if k == r.k]
        assert r.n == values.count(r.v)
        assert r.n_below == sum(v < r.v for v in values)


def test_row_ids_and_splits(spark):
    df = spark.range(5000).withColumn("date", F.expr("date_add(DATE '2024-01-01', int(id % 50))"))
    ids = [r.row_id for r in ordering.row_ids(df, ["id"]).collect()]
    assert sorted(ids) == list(range(1, 5001))
    split = ordering.day_block_split(df, "date")
    sides = split.groupBy("date").agg(F.count_distinct("split_day_block").alias("n"))
    assert sides.where("n <> 1").count() == 0
    assert split.where("split_day_block = 'test'").select("date").distinct().count() == 10
    assert split.count() == 5000


def test_linear_fit_recovers_coefficients_and_inverts(spark):
    df = spark.range(200).select(
        F.lit("m").alias("monitor"), F.col("id").cast("double").alias("x"),
        (F.col("id") * 1.7 - 3).alias("y"),
    )
    fit = calibrate.least_squares(df, "y", "x").first()
    assert (fit.slope, fit.intercept, fit.r2) == pytest.approx((1.7, -3.0, 1.0))
    assert fit.rmse == pytest.approx(0.0, abs=1e-5)
    flat = df.withColumn("x", F.lit(1.0))
    assert calibrate.least_squares(flat, "y", "x").first().slope is None


def test_leave_one_out_sum_identity(spark):
    df = spark.range(60).select(
        F.col("id").alias("monitor"), (F.col("id") % 6).alias("timestamp"),
        (F.col("id") * 1.0).alias("v"),
    )
    rows = impute.leave_one_out(df, "v").collect()
    for r in rows:
        assert r.fleet_avg * (r.n_reporting - 1) + r.v == pytest.approx(
            sum(x.v for x in rows if x.timestamp == r.timestamp)
        )


def test_calendar_is_the_cardinality_product(spark):
    df = spark.createDataFrame([("a",), ("b",), ("a",)], "monitor string")
    start, end = F.lit(dt.date(2024, 1, 1)), F.lit(dt.date(2024, 1, 10))
    assert merge.full_calendar(df, "date", start, end, "1 day").count() == 20


def mixture(k=2):
    rng = np.random.default_rng(3)
    d = 3
    covariances = []
    for _ in range(k):
        a = rng.normal(size=(d, d))
        covariances.append(a @ a.T + np.eye(d))
    weights = rng.random(k)
    return Mixture(
        ("a", "b", "y"), weights / weights.sum(), rng.normal(size=(k, d)), np.array(covariances)
    )


def test_mixture_regression_matches_the_formula(spark):
    mix = mixture()
    points = [(0.1, -0.4), (2.0, 1.0), (-3.0, 0.5)]
    df = spark.createDataFrame(points, "a double, b double")
    got = [r[0] for r in df.select(conditional_mean(mix, "y", ["a", "b"])).collect()]
    for (a, b), value in zip(points, got):
        x = np.array([a, b])
        weights, means = [], []
        for w, m, c in zip(mix.weights, mix.means, mix.covariances):
            s = c[:2, :2]
            delta = x - m[:2]
            weights.append(
                w * math.exp(-0.5 * delta @ np.linalg.solve(s, delta)) / math.sqrt(np.linalg.det(s))
            )
            means.append(m[2] + c[2, :2] @ np.linalg.solve(s, delta))
        assert value == pytest.approx(np.dot(weights, means) / sum(weights))


def test_mixture_shares_sum_to_one_far_from_all_components(spark):
    df = spark.createDataFrame([(500.0, -800.0)], "a double, b double")
    shares = df.select(*responsibilities(mixture(3), ["a", "b"])).first()
    assert sum(shares) == pytest.approx(1.0)


def test_one_component_equals_least_squares(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=400)
    rows = [(float(v), float(2 * v + e)) for v, e in zip(x, rng.normal(size=400))]
    df = spark.createDataFrame(rows, "a double, y double")
    mix = models.fit_mixture(df, ["a", "y"], 1)
    slope, intercept = np.polyfit(x, [r[1] for r in rows], 1)
    got = [r[0] for r in df.limit(5).select(conditional_mean(mix, "y", ["a"])).collect()]
    assert got == pytest.approx([slope * r.a + intercept for r in df.limit(5).collect()])


def test_missing_predictors_are_marginalised(spark):
    mix = mixture()
    df = spark.createDataFrame([(0.3, 1.0), (0.3, None)], "a double, b double")
    full, gap = [
        r[0] for r in df.select(conditional_mean_with_gaps(mix, "y", ["a"], ["b"])).collect()
    ]
    one = df.limit(1)
    assert full == pytest.approx(one.select(conditional_mean(mix, "y", ["a", "b"])).first()[0])
    assert gap == pytest.approx(one.select(conditional_mean(mix, "y", ["a"])).first()[0])


def test_mixture_table_round_trip(spark):
    mix = mixture()
    back = models.mixture_from_table(models.mixture_table(spark, mix))
    assert back.columns == mix.columns
    assert np.allclose(back.covariances, mix.covariances) and np.allclose(back.means, mix.means)


def clustered_points(n=150):
    rng = random.Random(11)
    points = [("p%03d" % i, 5.0, 5.0, rng.random()) for i in range(n // 3)]  # one spot
    points += [("q%03d" % i, rng.gauss(0, 1e-4), rng.gauss(0, 1e-4), rng.random())
               for i in range(n // 3)]
    points += [("r%03d" % i, rng.uniform(-10, 10), rng.uniform(-10, 10), rng.random())
               for i in range(n // 3)]
    return points


@pytest.mark.parametrize("k", [1, 4])
def test_neighbours_match_brute_force(spark, k):
    points = clustered_points()
    df = spark.createDataFrame(points, "monitor string, x double, y double, value double")
    got = {}
    for r in spatial.nearest_neighbours(df, k).collect():
        got.setdefault(r.monitor, {})[r["rank"]] = r.neighbour
    for name, x, y, _ in points:
        others = sorted(
            (math.sqrt((x - a) ** 2 + (y - b) ** 2), m) for m, a, b, _ in points if m != name
        )
        assert [got[name][i + 1] for i in range(k)] == [m for _, m in others[:k]]


def test_few_points(spark):
    df = spark.createDataFrame([("a", 0.0, 0.0), ("b", 1.0, 0.0)], "monitor string, x double, y double")
    rows = spatial.nearest_neighbours(df, 5).collect()
    assert sorted((r.monitor, r.neighbour) for r in rows) == [("a", "b"), ("b", "a")]


def test_moran_is_invariant_to_shift_and_scale(spark):
    df = spark.createDataFrame(
        clustered_points(60), "monitor string, x double, y double, value double"
    )
    first = spatial.moran_test(df, 3).first()
    second = spatial.moran_test(df.withColumn("value", F.col("value") * -3 + 100), 3).first()
    assert first.observed == pytest.approx(second.observed)
    assert first.z_score == pytest.approx(second.z_score)
    assert first.expected == pytest.approx(-1 / 59)


def segments():
    rng = random.Random(5)
    rows = []
    for i in range(120):
        x, y, size = rng.uniform(-10, 10), rng.uniform(-10, 10), rng.choice([0.0, 0.01, 1.0, 15.0])
        rows.append((i, "h%d" % (i % 3), x, y, x + rng.uniform(-size, size), y + rng.uniform(-size, size)))
    return rows


def _distance(px, py, s):
    _, _, x1, y1, x2, y2 = s
    dx, dy = x2 - x1, y2 - y1
    t = 0.0 if dx == dy == 0 else max(0, min(1, ((px - x1) * dx + (py - y1) * dy) / (dx * dx + dy * dy)))
    return math.hypot(px - x1 - t * dx, py - y1 - t * dy)


def test_roads_match_brute_force(spark):
    points = clustered_points(60) + [("far", 400.0, -300.0, 1.0)]
    df = spark.createDataFrame(points, "monitor string, x double, y double, value double")
    rows = segments()
    roads = spark.createDataFrame(
        rows, "road_id int, highway string, x1 double, y1 double, x2 double, y2 double"
    )
    near = {r.monitor: r for r in spatial.nearest_segment(df, roads).collect()}
    length = {r.monitor: r.total_length for r in spatial.road_length_within(df, roads, 1.5).collect()}
    for name, px, py, _ in points:
        assert near[name].distance_to_road == pytest.approx(min(_distance(px, py, s) for s in rows))
        expected = 0.0
        for _, _, x1, y1, x2, y2 in rows:
            steps = np.linspace(0, 1, 20001)[:-1] + 0.5 / 20000
            inside = np.hypot(x1 + steps * (x2 - x1) - px, y1 + steps * (y2 - y1) - py) <= 1.5
            expected += math.hypot(x2 - x1, y2 - y1) * inside.mean()
        assert length[name] == pytest.approx(expected, abs=0.02)


def test_monitor_pairs_match_numpy(spark):
    rng = np.random.default_rng(2)
    data = {m: rng.normal(size=80) for m in "abc"}
    rows = [(m, t, float(v)) for m, series in data.items() for t, v in enumerate(series)
            if (t + ord(m)) % 5]
    df = spark.createDataFrame(rows, "monitor string, t int, v double")
    got = {(r.monitor_x, r.monitor_y): r for r in trends.monitor_pairs(df, "v", ["t"]).collect()}
    known = {(m, t): v for m, t, v in rows}
    for (a, b), r in got.items():
        common = [t for t in range(80) if (a, t) in known and (b, t) in known]
        xs, ys = [known[a, t] for t in common], [known[b, t] for t in common]
        assert r.n == len(common)
        assert r.correlation == pytest.approx(np.corrcoef(xs, ys)[0, 1])
        assert r.slope == pytest.approx(np.polyfit(xs, ys, 1)[0])
    assert len(got) == 9


def test_tail_probabilities_against_published_values():
    assert dist.normal_upper(1.959964) == pytest.approx(0.025, abs=1e-6)
    assert dist.t_two_sided(2.228139, 10) == pytest.approx(0.05, abs=1e-6)
    assert dist.t_two_sided(12.7062, 1) == pytest.approx(0.05, abs=1e-5)
    assert dist.f_upper(4.102821, 2, 10) == pytest.approx(0.05, abs=1e-6)
    assert dist.f_upper(3.087, 2, 100) == pytest.approx(0.05, abs=1e-4)
    assert dist.studentised_range_upper(3.877, 3, 10) == pytest.approx(0.05, abs=2e-4)
    assert dist.studentised_range_upper(3.314, 3, 1e6) == pytest.approx(0.05, abs=2e-4)
    assert dist.studentised_range_quantile(0.95, 4, 20) == pytest.approx(3.958, abs=2e-3)


def test_wilcoxon_and_welch_small_cases(spark):
    pairs = [(1.83, 0.878), (0.50, 0.647), (1.62, 0.598), (2.48, 2.05), (1.68, 1.06), (1.88, 1.29),
             (1.55, 1.06), (3.06, 3.14), (1.30, 1.29)]
    row = stats.wilcoxon_signed_rank(
        spark.createDataFrame(pairs, "a double, b double"), "a", "b"
    ).first()
    assert (row.n, row.v) == (9, 40.0)
    x, y = [1.0, 2.0, 4.0, 7.0], [2.0, 9.0, 11.0, 12.0, 20.0]
    df = spark.createDataFrame(
        [("x", v) for v in x] + [("y", v) for v in y], "g string, v double"
    )
    w = stats.welch_test(df, "v", F.col("g") == "x").first()
    sx, sy = np.var(x, ddof=1) / 4, np.var(y, ddof=1) / 5
    assert w.t == pytest.approx((np.mean(x) - np.mean(y)) / math.sqrt(sx + sy))
    assert 0 < w.p_value < 1


@pytest.mark.parametrize("x0", [0.0, 5.0])
def test_roads_have_few_candidates_wherever_the_data_lies(spark, monkeypatch, x0):
    rng = np.random.default_rng(4)
    points = [(f"m{i}", x0 - 1e-6 - 0.01 * float(a), float(b)) for i, (a, b) in enumerate(rng.random((100, 2)))]
    starts = [(i, x0 + 0.5 * float(a), float(b)) for i, (a, b) in enumerate(rng.random((500, 2)))]
    roads = [(i, a, b, a + 0.001, b + 0.001, "track") for i, a, b in starts]
    pairs, near = [], spatial._near
    monkeypatch.setattr(spatial, "_near", lambda *args: pairs.append(near(*args)) or pairs[-1])
    spatial.nearest_segment(
        spark.createDataFrame(points, "monitor string, x double, y double"),
        spark.createDataFrame(
            roads, "road_id int, x1 double, y1 double, x2 double, y2 double, highway string"
        ),
    )
    assert pairs[0].count() < 40 * len(points)


def test_pair_correlations_survive_large_offsets(spark):
    day = dt.date(2024, 1, 1)
    rows = [
        (m, day, h, 1e9 + s * (h * h % 7) / 1000)
        for h in range(24)
        for m, s in (("a", 1.0), ("b", -2.0))
    ]
    df = spark.createDataFrame(rows, "monitor string, date date, hour int, v double")
    found = {(r.monitor_x, r.monitor_y): r for r in trends.monitor_pairs(df, "v").collect()}
    assert abs(found["a", "b"].correlation + 1) < 1e-6 and abs(found["a", "b"].slope + 2) < 1e-4
