"""Neighbours, roads and spatial autocorrelation without all-pairs joins.

Coordinates are planar (projected, or degrees over a small area). All searches use a hierarchy of
square grids, level l having cells of ``size / 2**l``: each point searches at the level where its
surroundings hold just enough candidates, so dense towns and empty country cost the same. Results
are exact; there is no limit on distance or candidates.

The grids start at the smallest coordinates, moved by a share of their size that is no fraction of a
power of two, so that no coordinate is a cell border at every level.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetfold.functions.distributions import normal_upper_pvalue
from fleetfold.operators.ordering import attach, top_per_key
from fleetfold.session import cut_lineage, settle

LEVELS = 20
GRID_SHIFT = 0.3819660113
# what rounding may add to a distance, as a share of the size of the grids; far below any cell
ROUNDING = 1e-9


def _grid(x0: Column, x1: Column, y0: Column, y1: Column, spreads: float) -> Column:
    """Origin of the grids and their size, ``spreads`` times that of the data."""
    size = spreads * F.greatest(x1 - x0, y1 - y0, F.lit(1e-9))
    return F.struct(x0.alias("x"), y0.alias("y"), size.alias("size")).alias("_extent")


def _cell(value: Column | str, level: Column, grid: Column, axis: str) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.floor(((value - grid[axis]) / grid["size"] + GRID_SHIFT) * F.pow(F.lit(2.0), level))


def _level_for(size: Column, grid: Column, levels: int) -> Column:
    """Finest level whose cells are at least ``size`` wide."""
    fitting = F.floor(F.log2(grid["size"] / size))
    bounded = F.least(F.greatest(fitting, F.lit(0)), F.lit(levels - 1))
    return F.when(size <= 0, levels - 1).otherwise(bounded).cast("int")


def _offsets(radius: int) -> Column:
    steps = range(-radius, radius + 1)
    return F.array(
        *[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in steps for j in steps]
    )


def _level_list(levels: int) -> Column:
    return F.array(*[F.lit(level) for level in range(levels)])


def nearest_neighbours(
    points: DataFrame, k: int, key: str = "monitor", x: str = "x", y: str = "y",
    levels: int = LEVELS,
) -> DataFrame:
    """The k nearest other points of every point: (key, neighbour, rank, distance).

    Ties go to the smaller key. Only the k + 1 smallest keys of one location can be neighbours,
    so a pile of points on one spot does not multiply. A location searches the 5 x 5 cells around
    it at the finest level where its own cell holds k + 1 candidates: those lie within one cell
    diagonal, which the block covers.
    """
    spread = points.agg(_grid(F.min(x), F.max(x), F.min(y), F.max(y), 1.0))
    at = [F.col(x).alias("_x"), F.col(y).alias("_y")]
    placed = attach(points.select(F.col(key).alias("_id"), *at), spread, [])
    candidates = top_per_key(placed, ["_x", "_y"], [F.col("_id")], k + 1).drop("_rank")
    extent = F.col("_extent")
    level = F.col("_level")

    def on_grid(df: DataFrame) -> DataFrame:
        return df.select("*", F.explode(_level_list(levels)).alias("_level")).withColumns(
            {"_cx": _cell("_x", level, extent, "x"), "_cy": _cell("_y", level, extent, "y")}
        )

    cell = ["_level", "_cx", "_cy"]
    gridded = on_grid(candidates)
    filled = (
        gridded.groupBy(*cell).agg(F.count(F.lit(1)).alias("_held")).where(F.col("_held") > k)
    )
    locations = candidates.select("_x", "_y", "_extent").distinct()
    own = (
        on_grid(locations)
        .join(filled, cell, "left")
        .groupBy("_x", "_y", "_extent")
        .agg(F.max(F.when(F.col("_held").isNotNull(), level)).alias("_level"))
    )
    # level 0 is as wide as the data, so 3 x 3 of its cells (and the 5 x 5 block) hold every point
    probes = (
        own.withColumn("_level", F.coalesce("_level", F.lit(0)))
        .withColumn("_o", F.explode(_offsets(2)))
        .select(
            "_x",
            "_y",
            "_level",
            (_cell("_x", level, extent, "x") + F.col("_o.i")).alias("_cx"),
            (_cell("_y", level, extent, "y") + F.col("_o.j")).alias("_cy"),
        )
    )
    reachable = gridded.join(probes.select(*cell).distinct(), cell, "left_semi")
    pairs = probes.join(
        reachable.select(
            *cell,
            F.col("_id").alias("_other"),
            F.col("_x").alias("_ox"),
            F.col("_y").alias("_oy"),
        ),
        cell,
    )
    dx, dy = F.col("_x") - F.col("_ox"), F.col("_y") - F.col("_oy")
    near = top_per_key(
        pairs.select("_x", "_y", "_other", F.sqrt(dx * dx + dy * dy).alias("_distance")),
        ["_x", "_y"],
        [F.col("_distance"), F.col("_other")],
        k + 1,
    )
    lists = near.groupBy("_x", "_y").agg(
        F.array_sort(
            F.collect_list(
                F.struct(F.col("_distance").alias("distance"), F.col("_other").alias("neighbour"))
            )
        ).alias("_near")
    )
    others = F.slice(
        F.filter("_near", lambda n: n["neighbour"] != F.col("_id")), 1, k
    )
    return (
        placed.join(lists, ["_x", "_y"])
        .select(F.col("_id").alias(key), F.posexplode(others).alias("_p", "_n"))
        .select(key, "_n.neighbour", (F.col("_p") + 1).alias("rank"), "_n.distance")
    )


def moran_test(
    values: DataFrame, k: int = 5, key: str = "monitor", value: str = "value", x: str = "x",
    y: str = "y",
) -> DataFrame:
    """Moran's I of a value over k-nearest-neighbour weights (rows sum to 1), with its
    expectation and variance under randomisation, z and the one-sided p-value."""
    known = values.where(F.col(value).isNotNull())
    mean = known.agg(F.avg(value).alias("_mean"))
    scored = attach(known.select(key, x, y, value), mean, []).select(
        key, x, y, (F.col(value) - F.col("_mean")).alias("_z")
    )
    # the weights are used four times: find the neighbours once and keep them on shared storage
    edges = cut_lineage(
        nearest_neighbours(scored, k, key, x, y).select(
            key, "neighbour", F.lit(1.0 / k).alias("w")
        )
    )
    z = scored.select(key, "_z")
    lagged = (
        edges.join(z, key)
        .join(z.select(F.col(key).alias("neighbour"), F.col("_z").alias("_zn")), "neighbour")
        .agg(F.sum(F.col("w") * F.col("_z") * F.col("_zn")).alias("cross"), F.sum("w").alias("s0"))
    )
    square = F.col("_z") * F.col("_z")
    moments = scored.agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        F.sum(square).alias("m2"),
        F.sum(square * square).alias("m4"),
    )
    s1 = (
        edges.groupBy(F.least(key, "neighbour"), F.greatest(key, "neighbour"))
        .agg(F.sum("w").alias("_both"))
        .agg(F.sum(F.col("_both") * F.col("_both")).alias("s1"))
    )
    s2 = (
        edges.select(key, "w")
        .union(edges.select("neighbour", "w"))
        .groupBy(key)
        .agg(F.sum("w").alias("_both"))
        .agg(F.sum(F.col("_both") * F.col("_both")).alias("s2"))
    )
    row = attach(attach(attach(moments, lagged, []), s1, []), s2, [])
    n, s0 = F.col("n"), F.col("s0")
    # undefined for equal values and, its variance, for three points or fewer: null, not an error
    kurtosis = F.try_divide(n * F.col("m4"), F.col("m2") * F.col("m2"))
    expected = F.try_divide(F.lit(-1.0), n - 1)
    top = n * ((n * n - 3 * n + 3) * F.col("s1") - n * F.col("s2") + 3 * s0 * s0)
    tail = kurtosis * ((n * n - n) * F.col("s1") - 2 * n * F.col("s2") + 6 * s0 * s0)
    variance = F.try_divide(
        top - tail, (n - 1) * (n - 2) * (n - 3) * s0 * s0
    ) - expected * expected
    table = row.select(
        F.try_divide(F.try_divide(n, s0) * F.col("cross"), F.col("m2")).alias("observed"),
        expected.alias("expected"),
        variance.alias("variance"),
    ).withColumn(
        "z_score",
        F.try_divide(F.col("observed") - F.col("expected"), F.sqrt("variance")),
    )
    return table.withColumn("p_value", normal_upper_pvalue("z_score"))


# --- roads --------------------------------------------------------------------------------------

SEGMENT = ["x1", "y1", "x2", "y2"]


def segment_distance(px: str, py: str) -> Column:
    """Distance of a point from the segment (x1, y1)-(x2, y2) of the same row."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    ax, ay = F.col(px) - F.col("x1"), F.col(py) - F.col("y1")
    length2 = dx * dx + dy * dy
    along = F.when(
        length2 > 0,
        F.least(F.greatest((ax * dx + ay * dy) / length2, F.lit(0.0)), F.lit(1.0)),
    ).otherwise(0.0)
    gx, gy = ax - along * dx, ay - along * dy
    return F.sqrt(gx * gx + gy * gy)


def segment_length_inside(px: str, py: str, radius: Column) -> Column:
    """Length of the part of the segment inside the circle around the point."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    ax, ay = F.col("x1") - F.col(px), F.col("y1") - F.col(py)
    a, b = dx * dx + dy * dy, dx * ax + dy * ay
    discriminant = b * b - a * (ax * ax + ay * ay - radius * radius)
    root = F.sqrt(discriminant)
    enters = F.greatest((-b - root) / a, F.lit(0.0))
    leaves = F.least((-b + root) / a, F.lit(1.0))
    return F.when(
        (a > 0) & (discriminant > 0), F.sqrt(a) * F.greatest(leaves - enters, F.lit(0.0))
    ).otherwise(0.0)


def _extent(points: DataFrame, segments: DataFrame, x: str, y: str) -> DataFrame:
    """Twice the spread of everything: one cell at level 0 is wider than any distance."""
    ends = (
        points.select(F.col(x).alias("x"), F.col(y).alias("y"))
        .union(segments.select("x1", "y1"))
        .union(segments.select("x2", "y2"))
    )
    return ends.agg(_grid(F.min("x"), F.max("x"), F.min("y"), F.max("y"), 2.0))


def _places(points: DataFrame, x: str, y: str) -> DataFrame:
    """The different locations: points that share one share its search."""
    return points.select(F.col(x).alias("_px"), F.col(y).alias("_py")).distinct()


def _register(
    segments: DataFrame, extent: DataFrame, levels: int, reach: Column | None = None
) -> DataFrame:
    """Enter each segment, by bounding box, in the cells of its own level and of all coarser ones.

    Its own level is the finest with cells larger than the segment, so it meets at most four
    cells of a level. ``_own`` rows are looked up from finer levels, the others from their own.
    Where all points have the same ``reach``, one level finds a segment and it is entered there only.
    """
    width = F.greatest(F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1")))
    natural = attach(segments, extent, []).withColumn(
        "_natural", _level_for(width, F.col("_extent"), levels)
    )
    level, size = F.col("_level"), F.col("_extent")

    def entry(at: Column, own: Column) -> Column:
        return F.struct(at.alias("_level"), own.alias("_own"))

    if reach is None:
        coarser = F.transform(F.sequence(F.lit(0), "_natural"), lambda at: entry(at, F.lit(False)))
        entries = F.concat(coarser, F.array(entry(F.col("_natural"), F.lit(True))))
    else:
        finest = _level_for(reach, size, levels)
        entries = F.array(entry(F.least("_natural", finest), F.col("_natural") < finest))

    def cells(a: str, b: str, axis: str) -> Column:
        return F.sequence(
            _cell(F.least(a, b), level, size, axis), _cell(F.greatest(a, b), level, size, axis)
        )

    return (
        natural.select("*", F.inline(entries))
        .withColumns(
            {
                "_minx": _cell(F.least("x1", "x2"), level, size, "x"),
                "_miny": _cell(F.least("y1", "y2"), level, size, "y"),
            }
        )
        .withColumn("_cx", F.explode(cells("x1", "x2", "x")))
        .withColumn("_cy", F.explode(cells("y1", "y2", "y")))
        .drop("_natural", "_extent")
    )


def _probes(places: DataFrame, levels: int) -> DataFrame:
    """The cells, three by three at most, that a place (_px, _py, _reach, _extent) can reach."""
    size, level = F.col("_extent"), F.col("_level")
    span = F.col("_reach") + ROUNDING * size["size"]

    def ends(at: str, axis: str) -> tuple[Column, Column]:
        # beyond the coarsest cells there is nothing, however far the reach
        at, here = F.col(at), _cell(at, level, size, axis)
        low = F.greatest(_cell(at - span, level, size, axis), here - 1)
        return low, F.least(_cell(at + span, level, size, axis), here + 1)

    (left, right), (bottom, top) = ends("_px", "x"), ends("_py", "y")
    return (
        places.withColumn("_finest", _level_for(F.col("_reach"), size, levels))
        .withColumn("_level", F.explode(F.sequence(F.lit(0), "_finest")))
        .withColumns({"_lowx": left, "_lowy": bottom, "_own": level < F.col("_finest")})
        .withColumn("_cx", F.explode(F.sequence("_lowx", right)))
        .withColumn("_cy", F.explode(F.sequence("_lowy", top)))
        .drop("_finest", "_extent")
    )


def _near(probes: DataFrame, registered: DataFrame) -> DataFrame:
    """Pairs of places and segments that may be within reach of each other.

    Every pair comes once: it is reported in the first cell the segment shares with the block.
    Both sides are many times what Spark takes them for, which does not count exploded rows, and
    no executor or driver could hold them: they are merged.
    """
    first = (F.col("_cx") == F.greatest("_minx", "_lowx")) & (
        F.col("_cy") == F.greatest("_miny", "_lowy")
    )
    return probes.join(registered.hint("merge"), ["_level", "_cx", "_cy", "_own"]).where(first)


def nearest_segment(
    points: DataFrame,
    segments: DataFrame,
    keep: Sequence[str] = ("road_id", "highway"),
    key: str = "monitor",
    x: str = "x",
    y: str = "y",
    levels: int = LEVELS,
) -> DataFrame:
    """Nearest road segment of every point, its distance and the attributes ``keep``.

    One representative segment per cell gives each place an upper bound of its distance; the
    exact search then looks only as far as that bound. Of equal segments the one with the smallest
    attributes stands for all.
    """
    extent = _extent(points, segments, x, y)
    shapes = segments.groupBy(*SEGMENT).agg(F.min(F.struct(*keep)).alias("_keep"))
    registered = _register(shapes, extent, levels)
    samples = (
        registered.where(~F.col("_own"))
        .groupBy("_level", "_cx", "_cy")
        .agg(F.min(F.struct(*SEGMENT)).alias("_s"))
        .select("_level", "_cx", "_cy", "_s.*")
    )
    level, size = F.col("_level"), F.col("_extent")
    bounds = (
        attach(_places(points, x, y), extent, [])
        .withColumn("_level", F.explode(_level_list(levels)))
        .withColumns({"_cx": _cell("_px", level, size, "x"), "_cy": _cell("_py", level, size, "y")})
        .join(samples.hint("merge"), ["_level", "_cx", "_cy"], "left")
        .groupBy("_px", "_py", "_extent")
        .agg(F.min(segment_distance("_px", "_py")).alias("_reach"))
        .withColumn("_reach", F.coalesce("_reach", "_extent.size"))
    )
    probes = _probes(settle(bounds), levels)
    # of the coarser entries only those in a cell where some place ends its search are wanted
    ended = settle(probes.where(~F.col("_own")).select("_level", "_cx", "_cy").distinct())
    wanted = registered.where(~F.col("_own")).join(ended, ["_level", "_cx", "_cy"], "left_semi")
    near = _near(probes, registered.where("_own").unionByName(wanted))
    # distances that agree to twelve decimals are ties, decided by the attributes in ``keep``
    found = F.struct(F.round(segment_distance("_px", "_py"), 12).alias("distance"), "_keep")
    by_place = near.groupBy("_px", "_py").agg(F.min(found).alias("_best"))
    best = (
        points.select(key, F.col(x).alias("_px"), F.col(y).alias("_py"))
        .join(by_place, ["_px", "_py"])
        .groupBy(key)
        .agg(F.min("_best").alias("_best"))
        .select(key, F.col("_best.distance").alias("distance_to_road"),
                *[F.col(f"_best._keep.{c}").alias(c) for c in keep])
    )
    return points.join(best, key, "left")


def road_length_within(
    points: DataFrame,
    segments: DataFrame,
    radius: float,
    key: str = "monitor",
    x: str = "x",
    y: str = "y",
    levels: int = LEVELS,
) -> DataFrame:
    """Length of road inside the circle around every point, 0 where there is none.

    Each different place meets each different segment near it once; equal segments are counted.
    """
    extent = _extent(points, segments, x, y)
    reach = F.lit(float(radius))
    shapes = segments.groupBy(*SEGMENT).agg(F.count(F.lit(1)).alias("_copies"))
    registered = _register(shapes, extent, levels, reach)
    places = attach(_places(points, x, y).withColumn("_reach", reach), extent, [])
    inside = segment_length_inside("_px", "_py", F.col("_reach")) * F.col("_copies")
    by_place = (
        _near(_probes(places, levels), registered)
        .groupBy("_px", "_py")
        .agg(F.sum(inside).alias("_length"))
    )
    lengths = (
        points.select(key, F.col(x).alias("_px"), F.col(y).alias("_py"))
        .join(by_place, ["_px", "_py"])
        .groupBy(key)
        .agg(F.sum("_length").alias("total_length"))
    )
    return points.join(lengths, key, "left").withColumn(
        "total_length", F.coalesce("total_length", F.lit(0.0))
    )


def modal_location(
    df: DataFrame, key: str = "monitor", lat: str = "geo_lat", lon: str = "geo_lon"
) -> DataFrame:
    """Most frequent position of every monitor; ties go to the smaller coordinates."""
    counts = df.groupBy(key, lat, lon).agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy(key).agg(
        F.min(F.struct((-F.col("n")).alias("m"), F.col(lat), F.col(lon))).alias("_b")
    )
    return best.select(key, f"_b.{lat}", f"_b.{lon}", (-F.col("_b.m")).alias("n"))
