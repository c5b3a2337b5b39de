"""Long and wide forms."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def to_long(
    df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str, value: str
) -> DataFrame:
    quoted = [F.col(f"`{c}`") for c in columns]
    return df.unpivot(list(ids), quoted, name, value)


def to_wide(
    df: DataFrame, ids: Sequence[str], name: str, value: str, labels: Sequence, fill=None
) -> DataFrame:
    """One column per label; labels are given, so no extra job looks for them."""
    wide = df.groupBy(*ids).pivot(name, list(labels)).agg(F.max(value))
    return wide if fill is None else wide.fillna(fill, subset=[str(v) for v in labels])


def coefficients_wide(coefs: DataFrame, channels: Sequence[str], channel: str = "gas") -> DataFrame:
    """(monitor, gas, slope, intercept) to one row per monitor with <gas>_slope, <gas>_intercept."""
    return coefs.groupBy("monitor").agg(
        *[
            F.max(F.when(F.col(channel) == c, F.col(p))).alias(f"{c}_{p}")
            for c in channels
            for p in ("slope", "intercept")
        ]
    )


def numeric_columns(df: DataFrame, skip: Sequence[str] = ()) -> list[str]:
    kinds = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    return [
        name
        for name, kind in df.dtypes
        if (kind in kinds or kind.startswith("decimal")) and name not in skip
    ]


def mean_of_numeric(df: DataFrame, keys: Sequence[str], suffix: str = "_mean") -> DataFrame:
    """Mean of every numeric column that is not a key."""
    return df.groupBy(*keys).agg(
        *[F.avg(c).alias(f"{c}{suffix}") for c in numeric_columns(df, keys)]
    )


def indicator_columns(df: DataFrame, column: str, levels: Sequence[str]) -> DataFrame:
    """One 0/1 column per level but the first, aligned to the levels a model was trained on.

    Levels the model does not know get zeros throughout, like the first one.
    """
    return df.withColumns(
        {
            f"{column}_{level}": F.coalesce((F.col(column) == level).cast("int"), F.lit(0))
            for level in levels[1:]
        }
    )


def others_matrix(
    df: DataFrame, monitors: Mapping[str, str], value: str, time: str = "timestamp"
) -> DataFrame:
    """Add one column per monitor with its reading at the same time, the own one blanked.

    ``monitors`` maps a monitor to its column name; the matrix has one row per time step.
    """
    wide = df.groupBy(time).agg(
        *[
            F.max(F.when(F.col("monitor") == m, F.col(value))).alias(name)
            for m, name in monitors.items()
        ]
    )
    joined = df.join(wide, time, "left")
    return joined.withColumns(
        {
            name: F.when(F.col("monitor") != m, F.col(name))
            for m, name in monitors.items()
        }
    )


def select_known(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Project to those of ``names`` the table has, in the given order."""
    return df.select(*[n for n in names if n in df.columns])


def coalesce_known(df: DataFrame, names: Sequence[str], kind: str = "double") -> Column:
    """First non-null of the columns that exist, typed null if none does."""
    known = [F.col(n).cast(kind) for n in names if n in df.columns]
    return F.coalesce(*known) if known else F.lit(None).cast(kind)
