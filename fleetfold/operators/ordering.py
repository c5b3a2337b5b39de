"""First rows, ranks, exact quantiles and hash splits that never gather a group in one task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetfold.functions.columns import as_column
from fleetfold.session import settle


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row of each key under an explicit order.

    The rank filter becomes a group limit below the exchange: a map task sends at most one row per
    key, so a key that holds a third of the table costs no more than any other.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n)


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` of which a null matches a null: the keys, then the other columns of each side."""
    keys = list(keys)
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys])
    others = [c for df in (left, right) for c in df.columns if c not in keys]
    return left.join(renamed, same, how).select(*keys, *others)


def attach(df: DataFrame, stats: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Bring one-row-per-key ``stats``, computed from ``df``, back to its rows.

    Without keys ``stats`` is one row and enters as a scalar subquery. With keys it is settled
    first, so that its measured size decides between a broadcast and a shuffled join.
    """
    if keys:
        return join_on(df, settle(stats), keys, how)
    names = stats.columns
    packed = stats.select(F.struct(*names).alias("_s")).scalar()
    return df.withColumn("_s", packed).select(*df.columns, *[F.col(f"_s.{n}") for n in names])


def value_ranks(
    df: DataFrame, value: str, keys: Sequence[str] = (), extra: Sequence[Column] = ()
) -> DataFrame:
    """For each distinct (keys, value): how many rows hold it (``n``) and how many are smaller.

    ``extra`` are further aggregates over the rows of a value, each with a name. Equal values are
    collapsed first; the distinct ones are dealt into ranges of their order, so that even a single
    key spreads over many tasks, and each range starts at the sum of the ranges before it.
    """
    keys = list(keys)
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value)
    distinct = counts.agg(F.count(F.lit(1)).alias("n"), *extra)
    order = [F.col(k) for k in [*keys, value]]
    placed = distinct.repartitionByRange(*order).sortWithinPartitions(*order)
    # the id holds the range above bit 33 and the place within the range below
    ranged = settle(placed.withColumn("_at", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("_range", F.shiftright("_at", 33))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        ranged.groupBy(*keys, "_range")
        .agg(F.sum("n").alias("_size"))
        .withColumn("_start", F.coalesce(F.sum("_size").over(before), F.lit(0)))
        .drop("_size")
    )
    within = Window.partitionBy("_range", *keys).orderBy("_at")
    inside = F.sum("n").over(within.rowsBetween(Window.unboundedPreceding, -1))
    summed = ranged.withColumn("_inside", F.coalesce(inside, F.lit(0)))
    return join_on(summed, settle(starts), [*keys, "_range"]).select(
        *distinct.columns, (F.col("_start") + F.col("_inside")).alias("n_below")
    )


# cells of the first count, per doubling of a value and from the smallest double on; then per cell
CELLS_PER_DOUBLING, CELLS_BEFORE_ONE, CELLS_WITHIN = 16, 20_000, 4096


def _first_cell(value: Column) -> Column:
    """Number of the cell of a value: a sixteenth of a doubling, in the order of the values."""
    size = F.floor(F.log2(F.abs(value)) * CELLS_PER_DOUBLING) + CELLS_BEFORE_ONE
    endless = F.lit(2 * CELLS_BEFORE_ONE).cast("bigint")
    cell = F.when(F.abs(value) == float("inf"), endless).otherwise(size)
    return F.when(value == 0, F.lit(0).cast("bigint")).when(value > 0, cell).otherwise(-cell)


def _ranked_cells(cells: DataFrame, wanted: DataFrame, groups: list[str], keys: list[str]) -> DataFrame:
    """The wanted ranks with the cell each falls into; ``groups`` name what ``cells`` divides."""
    upto = Window.partitionBy(*groups).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    placed = cells.withColumn("_before", F.coalesce(F.sum("_n").over(upto), F.lit(0)) + F.col("_below"))
    # without groups both sides are a few thousand rows at most
    joined = join_on(wanted, placed, groups) if groups else wanted.join(placed, F.col("_rank") < F.col("_before") + F.col("_n"))
    inside = (F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_n"))
    return joined.where(inside).select(*keys, "_rank", "_lo", "_hi", F.col("_before").alias("_below"))


def quantile_table(
    df: DataFrame, value: str, probs: dict[str, float], keys: Sequence[str] = ()
) -> DataFrame:
    """``n``, ``mean``, ``sd``, ``min``, ``max`` and exact interpolated quantiles, one row per key.

    One scan counts the values of each key by cells in their order and gives the moments with it.
    Cells that hold a wanted rank are divided further, each in one more scan, until all values of a
    cell are equal; every division separates the least and the greatest of a cell, and two or three
    are usual. A task sees the cells of a key, never its rows. Null and NaN are left out; a key
    without values has ``n`` 0 and nulls.
    """
    keys = list(keys)
    x = F.col(value).cast("double")
    rows = df.select(*keys, F.when(~F.isnan(x), x).alias("_v"))
    counts = [F.count("_v").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")]
    moments = [F.avg("_v").alias("_mean"), F.var_pop("_v").alias("_var")]
    first = settle(rows.groupBy(*keys, _first_cell(F.col("_v")).alias("_cell")).agg(*counts, *moments))
    whole = first.groupBy(*keys).agg(
        F.sum("_n").alias("n"),
        (F.sum(F.col("_n") * F.col("_mean")) / F.sum(F.when(F.col("_n") > 0, F.col("_n")))).alias("mean"),
        F.min("_lo").alias("min"),
        F.max("_hi").alias("max"),
    )
    whole = settle(whole)
    at = {name: (F.col("n") - 1) * F.lit(float(p)) for name, p in probs.items()}
    ranks = F.explode(F.array_distinct(F.array(*(f(a).cast("bigint") for a in at.values() for f in (F.floor, F.ceil)))))
    wanted = whole.where("n > 0").select(*keys, ranks.alias("_rank"))
    counted = first.where("_n > 0").withColumn("_below", F.lit(0).cast("bigint"))
    found = settle(_ranked_cells(counted, wanted, keys, keys))
    done, live = [], rows.where(F.col("_v").isNotNull())
    while True:
        done.append(found.where("_lo = _hi"))
        open_cells = settle(found.where("_lo < _hi"))
        ranges = open_cells.select(*keys, "_lo", "_hi", "_below").distinct()
        if open_cells.isEmpty():
            break
        where = (F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi"))
        if keys:
            hit = join_on(live, settle(ranges), keys).where(where)
        else:
            # without keys there are at most two open cells per quantile
            known = [F.struct(F.lit(r["_lo"]).alias("_lo"), F.lit(r["_hi"]).alias("_hi"), F.lit(r["_below"]).alias("_below")) for r in ranges.collect()]
            hit = live.select("_v", F.inline(F.array(*known))).where(where)
        share = (F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
        cell = F.floor(share * CELLS_WITHIN).alias("_cell")
        groups = [*keys, "_lo", "_hi", "_below"]
        inner = hit.groupBy(*groups, cell).agg(F.count("_v").alias("_n"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
        renamed = {"_lo": "_from", "_hi": "_to", "_below": "_start"}
        cells = inner.withColumnsRenamed(renamed).withColumnsRenamed({"_least": "_lo", "_most": "_hi"}).withColumn("_below", F.col("_start"))
        found = settle(_ranked_cells(cells, open_cells.withColumnsRenamed(renamed), [*keys, "_from", "_to", "_start"], keys))
    values = reduce(DataFrame.union, done).select(*keys, "_rank", F.col("_lo").alias("_value"))
    by_rank = values.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_value"))).alias("_values"))
    of = lambda rank: F.element_at("_values", rank.cast("bigint"))
    quantiles = [(of(F.floor(a)) + (a - F.floor(a)) * (of(F.ceil(a)) - of(F.floor(a)))).alias(n) for n, a in at.items()]
    apart = F.pow(F.col("_mean") - F.col("mean"), 2)
    spread = attach(first.where("_n > 0"), whole.select(*keys, "mean"), keys, "inner").groupBy(*keys).agg(
        F.sum(F.col("_n") * (F.col("_var") + apart)).alias("_squares")
    )
    sd = F.when(F.col("n") > 1, F.sqrt(F.col("_squares") / (F.col("n") - 1))).alias("sd")
    joined = attach(attach(whole, spread, keys), by_rank, keys)
    return joined.select(*keys, "n", "mean", sd, "min", "max", *quantiles)


def exact_quantiles(
    df: DataFrame, value: str, probs: dict[str, float], keys: Sequence[str] = ()
) -> DataFrame:
    """Exact quantiles with linear interpolation, one named column per probability; see ``quantile_table``."""
    table = quantile_table(df, value, probs, keys)
    return table.where("n > 0").select(*keys, *probs)


def key_digest(*parts: Column | str) -> Column:
    """Hex digest of a key: the same pseudo-random order on every engine and every run."""
    texts = [F.coalesce(as_column(p).cast("string"), F.lit("")) for p in parts]
    return F.md5(F.concat_ws("|", *texts))


def row_ids(df: DataFrame, keys: Sequence[str], name: str = "row_id") -> DataFrame:
    """Number the rows 1..n in the order of the digest of their unique key.

    Digests are uniform, so their first four hex digits cut any table into 65,536 even parts; a
    row number is the offset of the part plus the position inside it.
    """
    tagged = df.withColumn("_digest", key_digest(*keys)).withColumn(
        "_part", F.substring("_digest", 1, 4)
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        tagged.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_size"))
        .withColumn("_offset", F.coalesce(F.sum("_size").over(before), F.lit(0)))
        .select("_part", "_offset")
    )
    position = F.row_number().over(Window.partitionBy("_part").orderBy("_digest", *keys))
    return (
        tagged.withColumn("_position", position)
        .join(offsets, "_part")
        .withColumn(name, F.col("_offset") + F.col("_position"))
        .drop("_digest", "_part", "_position", "_offset")
    )


def random_sample(df: DataFrame, keys: Sequence[str], n: int, seed: str) -> DataFrame:
    """Exactly ``n`` rows (all if fewer), the same ones on every run."""
    return df.orderBy(key_digest(F.lit(seed), *keys), *keys).limit(n)


def day_block_split(
    df: DataFrame,
    day: str = "date",
    strata: Sequence[str] = (),
    test_share: float = 0.2,
    seed: str = "123",
    name: str = "split_day_block",
) -> DataFrame:
    """Send whole days to 'test' or 'train'; ``test_share`` of the days of each stratum is test."""
    strata = list(strata)
    days = df.select(day, *strata).distinct()
    order = Window.partitionBy(*strata).orderBy(key_digest(F.lit(seed), day))
    everything = Window.partitionBy(*strata)
    wanted = F.floor(F.count(F.lit(1)).over(everything) * test_share)
    labelled = days.select(
        day,
        *strata,
        F.when(F.row_number().over(order) <= wanted, "test").otherwise("train").alias(name),
    )
    return join_on(df, settle(labelled), [day, *strata])


def day_fold(day: Column | str, folds: int, seed: str = "123") -> Column:
    """Cross-validation fold of a day; all rows of a day share it."""
    head = F.conv(F.substring(key_digest(F.lit(seed), day), 1, 7), 16, 10).cast("int")
    return F.pmod(head, F.lit(folds)).cast("int")


def rank_by(df: DataFrame, metric: str, name: str, descending: bool = True) -> DataFrame:
    """Order number of each row by a metric; ties share the number of the first of them."""
    signed = df.withColumn("_metric", -F.col(metric) if descending else F.col(metric))
    ranks = value_ranks(signed, "_metric").select(
        "_metric", (F.col("n_below") + 1).alias(name)
    )
    return signed.join(ranks, "_metric", "left").drop("_metric")
