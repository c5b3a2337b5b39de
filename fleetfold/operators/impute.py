"""Gap filling from the rest of the fleet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetfold.operators.merge import full_calendar, on_calendar


def leave_one_out(
    df: DataFrame,
    value: str,
    time: str = "timestamp",
    min_others: int = 2,
    mode: str = "compat",
    name: str = "fleet_avg",
) -> DataFrame:
    """Mean of the other monitors at the same time, and how many report.

    In ``mode="compat"`` a monitor without a value of its own gets none either; in
    ``mode="others"`` it gets the mean of those that report, which is what prediction needs.
    The sums join back instead of using a window, so one crowded time step can be split.
    """
    if mode not in ("compat", "others"):
        raise ValueError(mode)
    sums = df.groupBy(time).agg(
        F.sum(value).alias("_sum"), F.count(value).alias("n_reporting")
    )
    own = F.col(value)
    n = F.col("n_reporting")
    others = F.try_divide(F.col("_sum") - own, n - 1)
    if mode == "others":
        others = F.when(own.isNull(), F.try_divide(F.col("_sum"), n)).otherwise(others)
    return (
        df.join(sums, time, "left")
        .withColumn(name, F.when(n - 1 >= min_others, others))
        .drop("_sum")
    )


def tune_min_others(
    df: DataFrame,
    value: str,
    candidates: Sequence[int] = (1, 2, 3, 5, 10, 20),
    time: str = "timestamp",
) -> DataFrame:
    """Error of the leave-one-out mean for every candidate minimum, in one pass.

    Errors are summed by the number of reporting monitors first (at most fleet-size many rows);
    the candidates then add up those sums.
    """
    scored = leave_one_out(df, value, time, 1).where(F.col("fleet_avg").isNotNull())
    y, miss = F.col(value), F.col("fleet_avg") - F.col(value)
    by_size = scored.groupBy("n_reporting").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(miss * miss).alias("sse"),
        F.sum(F.abs(miss)).alias("sae"),
        F.avg(y).alias("center"),
        F.coalesce(F.regr_syy(y, y), F.lit(0.0)).alias("within"),
    )
    allowed = F.filter(
        F.array(*[F.lit(c) for c in candidates]), lambda c: c <= F.col("n_reporting") - 1
    )
    # squares about the common mean, so that large values do not cancel
    same = Window.partitionBy("min_active")
    weighed = F.sum(F.col("n") * F.col("center")).over(same) / F.sum("n").over(same)
    off = F.col("center") - F.col("mean")
    sums = (
        by_size.withColumn("min_active", F.explode(allowed))
        .withColumn("mean", weighed)
        .withColumn("syy", F.col("within") + F.col("n") * off * off)
        .groupBy("min_active")
        .agg(*[F.sum(c).alias(c) for c in ("n", "sse", "sae", "syy")])
    )
    n = F.col("n")
    return sums.select(
        "min_active",
        F.sqrt(F.col("sse") / n).alias("rmse"),
        (F.col("sae") / n).alias("mae"),
        (
            1 - F.try_divide(F.col("sse"), F.col("syy"))
        ).alias("r2"),
    )


def fill_gaps(df: DataFrame, value: str, predicted: str, name: str = "pm25") -> DataFrame:
    """Observed value first, else the prediction; says for each row which it is."""
    filled = F.coalesce(value, predicted)
    made = F.col(value).isNull() & F.col(predicted).isNotNull()
    return df.withColumns(
        {
            f"{name}_filled": filled,
            f"{name}_was_imputed": made,
            f"{name}_data_source": F.when(made, "imputed")
            .when(F.col(value).isNotNull(), "observed")
            .otherwise("missing"),
        }
    )


def every_step(
    df: DataFrame, time: str = "timestamp", entity: str = "monitor", step: str = "1 hour"
) -> DataFrame:
    """Rows for every monitor at every step of the whole span; new rows are null elsewhere."""
    span = df.agg(F.min(time).alias("a"), F.max(time).alias("b"))
    first, last = span.select("a").scalar(), span.select("b").scalar()
    calendar = full_calendar(df, time, first, last, step, entity)
    return on_calendar(df, calendar, [entity, time], {})
