"""Tables behind the trend, season and wind reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetfold.functions.calendar import in_cook_time, moment
from fleetfold.functions.columns import device_class, outside_range, significant, within
from fleetfold.functions.pairs import PAIR_SCHEMA, SUMS, TILE, pair_sums
from fleetfold.operators.ordering import attach, exact_quantiles, join_on, quantile_table
from fleetfold.operators.reshape import to_long
from fleetfold.session import settle


def monitor_statistics(df: DataFrame, value: str, keys: Sequence[str] = ("monitor",)) -> DataFrame:
    """Mean, exact median and sample deviation per monitor; all null where nothing is known."""
    table = quantile_table(df, value, {"median_value": 0.5}, keys)
    return table.select(*keys, F.col("mean").alias("mean_value"), F.col("sd").alias("sd_value"), "median_value")


def grand_daily_means(daily: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Daily mean over monitors of several measures in long form, plus the mean of each measure
    over all days to three significant digits."""
    by_day = daily.groupBy("date").agg(*[F.avg(c).alias(n) for c, n in columns.items()])
    long = to_long(by_day, ["date"], list(columns.values()), "pollutant", "measurement")
    overall = long.groupBy("pollutant").agg(
        significant(F.avg("measurement"), 3).alias("mean_measurement")
    )
    return long.join(overall, "pollutant", "left")


def quartile_table(df: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """Minimum, quartiles, mean and maximum per group, rounded to two digits."""
    table = quantile_table(df, value, {"q1": 0.25, "median": 0.5, "q3": 0.75}, keys)
    return table.select(*keys, *[F.bround(c, 2).alias(c) for c in ("min", "mean", "max", "q1", "median", "q3")])


def mean_and_spread(df: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean_value"),
        F.stddev_samp(value).alias("sd_value"),
    )


def heat_table(hourly: DataFrame, value: str) -> DataFrame:
    """Mean over monitors for each date and hour, with calendar parts and the logarithm."""
    mean = F.col(value)
    return (
        hourly.groupBy("date", "hour")
        .agg(F.avg(value).alias(value))
        .withColumns(
            {
                "day": F.dayofmonth("date"),
                "month": F.month("date"),
                "year": F.year("date"),
                f"log_{value}": F.when(mean > 0, F.log(mean)),
            }
        )
    )


def daily_mean(
    df: DataFrame, value: str, keys: Sequence[str] = ("monitor",), cook_time: bool = False
) -> DataFrame:
    rows = df.where(in_cook_time("hour")) if cook_time else df
    return rows.groupBy(*keys, "date").agg(F.avg(value).alias(f"mean_{value}"))


def diurnal_profile(
    df: DataFrame, measures: Mapping[str, str], keys: Sequence[str] = ("season",)
) -> DataFrame:
    """Mean of several measures by season and hour of day, one scan for all of them."""
    return df.groupBy(*keys, "hour").agg(*[F.avg(c).alias(n) for c, n in measures.items()])


def daily_measures(base: DataFrame, others: Sequence[DataFrame]) -> DataFrame:
    """Daily tables of further measures joined to the days of the first."""
    out = base
    for other in others:
        out = out.join(other, "date", "left")
    return out


def wind_rose(
    df: DataFrame,
    ws: str = "ws",
    wd: str = "wd",
    angle: int = 18,
    speed_breaks: Sequence[float] = (2.0, 4.0, 6.0),
    keys: Sequence[str] = (),
) -> DataFrame:
    """Share of observations by direction sector and speed class.

    Sectors are centred on multiples of ``angle``; speeds outside (0, 40) and directions outside
    [0, 360] are dropped.
    """
    rows = df.where(within(wd, 0, 360) & within(ws, 0, 40, False, False))
    sectors = 360 // angle
    sector = F.pmod(F.floor((F.col(wd) + angle / 2) / angle), F.lit(sectors)) * angle
    label = F
    lower = 0.0
    for upper in speed_breaks:
        label = label.when(F.col(ws) <= upper, f"{lower:g}-{upper:g}")
        lower = upper
    counts = rows.groupBy(
        *keys, sector.cast("int").alias("sector"), label.otherwise(f">{lower:g}").alias("speed")
    ).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("_total"))
    joined = join_on(counts, totals, keys) if keys else attach(counts, totals, [])
    return joined.select(
        *keys, "sector", "speed", "n", (F.col("n") / F.col("_total")).alias("share")
    )


def overlap_wind_roses(
    device: DataFrame, external: DataFrame, start, end, angle: int = 18
) -> DataFrame:
    """Wind roses of a device and an external station over the same span, station by station."""
    mine = device.where((F.col("date") > F.lit(start)) & (F.col("date") < F.lit(end)))
    theirs = external.where(
        (F.col("DateTime") > moment(start)) & (F.col("DateTime") < moment(end))
    )
    stacked = mine.select(F.col("monitor").alias("station"), "ws", "wd").unionByName(
        theirs.select(
            F.lit("external").alias("station"),
            F.col("WindSpeed_ms").alias("ws"),
            F.col("WindDirection_A").alias("wd"),
        )
    )
    return wind_rose(stacked, angle=angle, keys=["station"])


def training_ranges(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Smallest and largest training value of every predictor: one row."""
    return df.agg(
        *[f(c).alias(f"{c}_{n}") for c in columns for n, f in (("min", F.min), ("max", F.max))]
    )


def flag_extrapolation(df: DataFrame, ranges: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Flags for predictors outside the range of the training data."""
    joined = attach(df, ranges, [])
    flags = {
        f"out_{c}": outside_range(c, F.col(f"{c}_min"), F.col(f"{c}_max")) for c in columns
    }
    flagged = joined.withColumns(flags).drop(*ranges.columns)
    any_flag = F.lit(False)
    for name in flags:
        any_flag = any_flag | F.col(name)
    return flagged.withColumn("any_extrapolation", any_flag)


def extrapolation_share(
    flagged: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()
) -> DataFrame:
    names = ["any_extrapolation", *[f"out_{c}" for c in columns]]
    return flagged.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.bround(F.avg(F.col(n).cast("int")) * 100, 2).alias(f"pct_{n}") for n in names],
    )


def calibration_change(df: DataFrame, raw: str, adjusted: str, delta: str, ratio: str) -> DataFrame:
    """How far calibration moved each monitor; sort by the absolute mean change for a report."""
    means = df.groupBy("monitor").agg(
        F.count(F.lit(1)).alias("n"),
        F.bround(F.avg(raw), 2).alias("mean_raw"),
        F.bround(F.avg(adjusted), 2).alias("mean_adjusted"),
        F.bround(F.avg(delta), 2).alias("mean_delta"),
    )
    medians = exact_quantiles(df, ratio, {"_median": 0.5}, ["monitor"])
    return means.join(medians, "monitor", "left").select(
        *means.columns, F.bround("_median", 2).alias("median_ratio")
    )


def monitor_pairs(
    df: DataFrame, values: str | Sequence[str], time: Sequence[str] = ("date", "hour"), tile: int = TILE
) -> DataFrame:
    """Pearson correlation and slope (y on x) of every ordered pair of monitors, per measure.

    All measures go in one pass. Monitors are numbered and cut into tiles; a reading is sent once per
    tile to the task that holds its time step, which adds up matrix products for blocks of tiles, the upper
    half only, and gives each block once. Pairs are never listed per time step, a step is never
    gathered as one row. Readings are counted from the monitor's smallest, so that sums of squares of
    large values do not cancel. Readings of no monitor and pairs without a common step are left out.
    """
    values = [values] if isinstance(values, str) else list(values)
    known = df.where(F.col("monitor").isNotNull())
    least = [F.min(c).cast("double").alias(f"_least_{i}") for i, c in enumerate(values)]
    numbered = known.groupBy("monitor").agg(*least).withColumn(
        "_number", F.row_number().over(Window.orderBy("monitor")) - 1
    )
    fleet = settle(numbered)
    size = max(1, min(tile, fleet.count()))
    tiles = -(-fleet.count() // size)
    means = known.groupBy(*time, "monitor").agg(*[F.avg(c).alias(f"_v{i}") for i, c in enumerate(values)])
    measures = F.array(
        *[
            F.struct(F.lit(i).alias("measure"), (F.col(f"_v{i}") - F.col(f"_least_{i}")).alias("v"))
            for i in range(len(values))
        ]
    )
    mine = (F.col("_number") / size).cast("int")
    others = F.sequence(F.lit(0), F.lit(tiles - 1))
    blocks = F.transform(others, lambda t: F.struct(F.least(mine, t).alias("tile_x"), F.greatest(mine, t).alias("tile_y")))
    step = F.xxhash64(*time).alias("step")
    dealt = means.join(fleet, "monitor").select(step, F.col("_number").alias("monitor"), measures.alias("m"), F.inline(blocks))
    rows = dealt.select("tile_x", "tile_y", "step", "monitor", F.inline("m")).where("v IS NOT NULL").select(
        "tile_x", "tile_y", "measure", "step", "monitor", "v"
    )
    keys = ["tile_x", "tile_y", "measure", "step"]
    placed = rows.repartition(*keys).sortWithinPartitions(*keys)
    sums = placed.mapInArrow(pair_sums(size), PAIR_SCHEMA).groupBy("measure", "x", "y").agg(
        *[F.sum(c).alias(c) for c in SUMS]
    )
    turned = F.struct("x", "y", "sx", "sy", "sxx", "syy"), F.struct(
        F.col("y").alias("x"), F.col("x").alias("y"), F.col("sy").alias("sx"), F.col("sx").alias("sy"),
        F.col("syy").alias("sxx"), F.col("sxx").alias("syy"),
    )
    both = F.when(F.col("x") == F.col("y"), F.array(turned[0])).otherwise(F.array(*turned))
    ordered = sums.select("measure", "n", "sxy", F.inline(both))
    n = F.col("n")
    sxx = F.col("sxx") - F.col("sx") * F.col("sx") / n
    syy = F.col("syy") - F.col("sy") * F.col("sy") / n
    sxy = F.col("sxy") - F.col("sx") * F.col("sy") / n
    usable = (n > 1) & (sxx > 0) & (syy > 0)
    names = {s: fleet.select(F.col("_number").alias(s), F.col("monitor").alias(f"monitor_{s}")) for s in "xy"}
    labels = F.array(*[F.lit(v) for v in values])
    return ordered.join(names["x"], "x").join(names["y"], "y").select(
        F.get(labels, F.col("measure")).alias("measure"),
        "monitor_x",
        "monitor_y",
        n.cast("bigint").alias("n"),
        F.when(usable, sxy / F.sqrt(sxx * syy)).alias("correlation"),
        F.when((n > 1) & (sxx > 0), sxy / sxx).alias("slope"),
    )


def by_device_class(df: DataFrame) -> DataFrame:
    return df.withColumn("device_class", device_class("monitor"))


def order_labels(label: Column, order: Sequence[str]) -> Column:
    """Position of a label in a given order, for sorting reports."""
    return F.array_position(F.array(*[F.lit(v) for v in order]), label).cast("int")
