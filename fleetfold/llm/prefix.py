"""Row numbers and running sums over a total order, without a window over a whole group.

Rows are range-partitioned and sorted by the full order, which ends in a unique row name, so a hot
group spreads over many partitions. Each partition sums its own rows; what stands before it is a
running sum over one row per partition.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetfold.llm.common import stored

# monotonically_increasing_id keeps the partition above this bit and the row within it below
PARTITION_SHIFT = 33
PART, AT = "part_of_order", "at_in_order"


def _ordered(df: DataFrame, order: list[Column]) -> DataFrame:
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    kept = stored(placed.withColumn(AT, F.monotonically_increasing_id()))
    return kept.withColumn(PART, F.shiftright(AT, PARTITION_SHIFT))


def row_numbers(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with ``name``: 0, 1, ... in ``order``, which must name every row uniquely."""
    kept = _ordered(df, order)
    before = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    counts = kept.groupBy(PART).agg(F.count("*").alias("rows_of_part"))
    starts = stored(counts.select(PART, F.coalesce(F.sum("rows_of_part").over(before), F.lit(0)).alias("start_of_part")))
    inside = F.col(AT).bitwiseAND(F.lit((1 << PARTITION_SHIFT) - 1))
    return kept.join(starts, PART).withColumn(name, F.col("start_of_part") + inside).drop(PART, AT, "start_of_part")


def running_sums(df: DataFrame, group: list[str], order: list[Column], sums: dict[str, str]) -> DataFrame:
    """``df`` with, per entry ``new: column``, the sum of ``column`` over the earlier rows of the group.

    Nulls are a group of their own. Empty input gives an empty result.
    """
    kept = _ordered(df, [*(F.col(c) for c in group), *order])
    inside = Window.partitionBy(PART, *group).orderBy(AT).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*group).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    totals = kept.groupBy(PART, *group).agg(*(F.sum(c).alias(f"total_{n}") for n, c in sums.items()))
    starts = stored(
        totals.select(
            F.col(PART).alias("start_part"),
            *(F.col(c).alias(f"start_{c}") for c in group),
            *(F.coalesce(F.sum(f"total_{n}").over(earlier), F.lit(0)).alias(f"before_{n}") for n in sums),
        )
    )
    rows = kept.select("*", *(F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"inside_{n}") for n, c in sums.items()))
    same = [F.col(PART) == F.col("start_part"), *(F.col(c).eqNullSafe(F.col(f"start_{c}")) for c in group)]
    joined = rows.join(starts, reduce(lambda a, b: a & b, same))
    return joined.select(*df.columns, *((F.col(f"before_{n}") + F.col(f"inside_{n}")).alias(n) for n in sums))
