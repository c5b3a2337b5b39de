"""Road searches: how many rows the joins make, and that they are merged."""

import re

import pytest
from pyspark.sql import functions as F

from fleetfold.operators import spatial

POINTS = "monitor string, x double, y double"
ROADS = "road_id int, highway string, x1 double, y1 double, x2 double, y2 double"


@pytest.fixture
def pairs(monkeypatch):
    made, near = [], spatial._near
    monkeypatch.setattr(spatial, "_near", lambda *args: made.append(near(*args)) or made[-1])
    return made


@pytest.fixture
def crowd(spark):
    """30 points on one spot and one apart; 40 equal roads, one shorter, one across."""
    points = [(f"m{i:02d}", 1.0, 1.0) for i in range(30)] + [("apart", 3.0, 1.0)]
    roads = [(i, "track", 0.9, 1.01, 1.1, 1.01) for i in range(40, 0, -1)]
    roads += [(50, "trunk", 1.0, 1.02, 1.03, 1.02), (51, "trunk", 2.9, 0.5, 2.9, 2.5)]
    return spark.createDataFrame(points, POINTS), spark.createDataFrame(roads, ROADS)


def test_nearest_road_of_crowded_places(crowd, pairs):
    points, roads = crowd
    found = {r.monitor: (r.road_id, round(r.distance_to_road, 9)) for r in spatial.nearest_segment(points, roads).collect()}
    assert found.pop("apart") == (51, 0.1)
    assert len(found) == 30 and set(found.values()) == {(1, 0.01)}
    assert pairs[0].count() < 10


def stored(df, path):
    df.coalesce(1).write.parquet(str(path))
    return df.sparkSession.read.schema(df.schema).parquet(str(path))


def test_nearest_road_is_merged_however_small_its_input(crowd, tmp_path):
    # rows exploded from a small file are many; a broadcast takes them all to the driver
    points, roads = stored(crowd[0], tmp_path / "points"), stored(crowd[1], tmp_path / "roads")
    plan = spatial.nearest_segment(points, roads)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"BroadcastHashJoin \[_level#\w+, _cx#\w+, _cy#\w+, _own#\w+\]", plan)
    assert re.search(r"SortMergeJoin \[_level#\w+, _cx#\w+, _cy#\w+, _own#\w+\]", plan)


def test_road_length_at_crowded_places(spark, crowd, pairs):
    points, roads = crowd
    twice = points.union(spark.createDataFrame([("apart", 3.0, 1.0), (None, 1.0, 1.0), ("lost", None, 1.0)], POINTS))
    rows = spatial.road_length_within(twice, roads, 0.5).collect()
    found = {r.monitor: r.total_length for r in rows}
    assert len(rows) == 34
    # 40 copies of 0.2 and one of 0.03; a key that comes twice counts the roads of both its rows
    assert {round(found[f"m{i:02d}"], 9) for i in range(30)} == {8.03}
    assert found["apart"] == pytest.approx(2 * 2 * (0.25 - 0.01) ** 0.5)
    assert found[None] == found["lost"] == 0
    assert pairs[0].count() < 10


def test_one_reach_enters_a_segment_at_one_level(spark, crowd):
    extent = spatial._extent(*crowd, "x", "y")
    shapes = crowd[1].select(*spatial.SEGMENT).distinct()
    entries = spatial._register(shapes, extent, spatial.LEVELS, F.lit(0.05))
    per_shape = entries.groupBy(*spatial.SEGMENT).agg(F.countDistinct("_level").alias("levels"), F.count("*").alias("n"))
    assert [r.levels for r in per_shape.collect()] == [1, 1, 1]
    assert per_shape.where("n > 4").isEmpty()
