"""Error metrics and hypothesis tests from grouped sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetfold.functions.distributions import (
    f_pvalue,
    normal_upper_pvalue,
    t_pvalue,
    tukey_critical,
    tukey_pvalue,
)
from fleetfold.operators.ordering import attach, join_on, value_ranks


def error_metrics(
    df: DataFrame, observed: str, predicted: str, keys: Sequence[str] = ()
) -> DataFrame:
    """Agreement of predictions with observations over rows where both are known.

    The bias is computed first (one row per group) because the bias-corrected absolute error
    needs it; everything else is a sum over the rows.
    """
    keys = list(keys)
    rows = df.where(F.col(observed).isNotNull() & F.col(predicted).isNotNull()).select(
        *keys, F.col(observed).alias("_y"), F.col(predicted).alias("_p")
    )
    y, p = F.col("_y"), F.col("_p")
    bias = rows.groupBy(*keys).agg(F.avg(p - y).alias("_bias"))
    miss = p - y
    return (
        attach(rows, bias, keys)
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n"),
            (1 - F.try_divide(F.sum(miss * miss), F.regr_syy(y, p))).alias("r2"),
            F.sqrt(F.avg(miss * miss)).alias("rmse"),
            F.avg(F.abs(miss)).alias("mae"),
            F.avg(miss).alias("bias"),
            F.try_divide(F.sum(F.abs(miss - F.col("_bias"))), F.sum(y)).alias("cvmae"),
            F.try_divide(F.sum(miss), F.sum(y)).alias("mnb"),
            F.try_divide(F.sum(F.abs(miss)), F.sum(y)).alias("nmae"),
            (F.try_divide(F.sqrt(F.avg(miss * miss)), F.avg(y)) * 100).alias("nrmse_pct"),
            F.regr_r2(y, p).alias("pearson_r2"),
            F.regr_slope(y, p).alias("cal_slope"),
            F.regr_intercept(y, p).alias("cal_intercept"),
        )
    )


def bland_altman(df: DataFrame, first: str, second: str, keys: Sequence[str] = ()) -> DataFrame:
    """Mean difference, its deviation and the 95 % limits of agreement."""
    difference = F.col(first) - F.col(second)
    return (
        df.groupBy(*keys)
        .agg(F.avg(difference).alias("mean_diff"), F.stddev_samp(difference).alias("sd_diff"))
        .withColumns(
            {
                "lower": F.col("mean_diff") - 1.96 * F.col("sd_diff"),
                "upper": F.col("mean_diff") + 1.96 * F.col("sd_diff"),
            }
        )
    )


def _level_moments(df: DataFrame, value: str, level: str, keys: Sequence[str]) -> DataFrame:
    return (
        df.where(F.col(value).isNotNull() & F.col(level).isNotNull())
        .groupBy(*keys, level)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(value).alias("mean"),
            F.coalesce(F.var_samp(value), F.lit(0.0)).alias("var"),
        )
    )


def _decomposition(moments: DataFrame, keys: Sequence[str]) -> DataFrame:
    # one row per level: the grand mean is known before squares are added, so nothing cancels
    n, mean = F.col("n"), F.col("mean")
    group = Window.partitionBy(*keys)
    off = mean - F.sum(n * mean).over(group) / F.sum(n).over(group)
    return moments.withColumn("_off", off).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("k"),
        F.sum(n).alias("n_total"),
        F.sum(n * F.col("_off") * F.col("_off")).alias("ss_between"),
        F.sum((n - 1) * F.col("var")).alias("ss_within"),
    )


def one_way_anova(df: DataFrame, value: str, level: str, keys: Sequence[str] = ()) -> DataFrame:
    """F test of equal level means, from one count, mean and variance per level."""
    parts = _decomposition(_level_moments(df, value, level, keys), keys)
    df1, df2 = F.col("k") - 1, F.col("n_total") - F.col("k")
    table = parts.select(
        *keys,
        df1.alias("df_between"),
        df2.alias("df_within"),
        "ss_between",
        "ss_within",
        F.try_divide(
            F.try_divide(F.col("ss_between"), df1), F.try_divide(F.col("ss_within"), df2)
        ).alias("f"),
    )
    return table.withColumn(
        "p_value", f_pvalue("f", F.col("df_between").cast("double"), F.col("df_within").cast("double"))
    )


def tukey_pairs(df: DataFrame, value: str, level: str, keys: Sequence[str] = ()) -> DataFrame:
    """Honest significant differences of all pairs of levels.

    Works on one row of moments per level of the factor; the pairs of levels are the report.
    """
    keys = list(keys)
    moments = _level_moments(df, value, level, keys)
    error = _decomposition(moments, keys).select(
        *keys,
        "k",
        (F.col("n_total") - F.col("k")).alias("df"),
        F.try_divide(F.col("ss_within"), F.col("n_total") - F.col("k")).alias("mse"),
    )
    levels = moments.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(F.col(level).alias("level"), "n", "mean"))).alias("l")
    )
    first = levels.select(*keys, "l", F.posexplode("l").alias("i", "a"))
    pairs = first.select(
        *keys, "a", F.explode(F.slice("l", F.col("i") + 2, F.size("l"))).alias("b")
    )
    joined = join_on(pairs, error, keys) if keys else attach(pairs, error, [])
    difference = F.col("b.mean") - F.col("a.mean")
    scale = F.sqrt(F.col("mse") / 2 * (1 / F.col("a.n") + 1 / F.col("b.n")))
    k = F.col("k").cast("double")
    freedom = F.when(F.col("df") > 0, F.col("df").cast("double"))
    table = joined.select(
        *keys,
        F.col("a.level").alias("level_a"),
        F.col("b.level").alias("level_b"),
        difference.alias("diff"),
        F.try_divide(F.abs(difference), scale).alias("q"),
        scale.alias("_scale"),
        k.alias("_k"),
        freedom.alias("_df"),
    ).withColumn("_margin", F.col("_scale") * tukey_critical("_k", "_df"))
    return table.select(
        *keys,
        "level_a",
        "level_b",
        "diff",
        "q",
        (F.col("diff") - F.col("_margin")).alias("lower"),
        (F.col("diff") + F.col("_margin")).alias("upper"),
        tukey_pvalue("q", "_k", "_df").alias("p_adjusted"),
    )


def welch_test(df: DataFrame, value: str, first: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Two-sample t test with unequal variances: rows where ``first`` holds against the others."""

    def part(condition: Column, name: str) -> list[Column]:
        x = F.when(condition, F.col(value))
        return [
            F.count(x).alias(f"n_{name}"),
            F.avg(x).alias(f"mean_{name}"),
            F.var_samp(x).alias(f"var_{name}"),
        ]

    sums = df.groupBy(*keys).agg(*part(first, "x"), *part(~first, "y"))
    sx = F.try_divide(F.col("var_x"), F.col("n_x"))
    sy = F.try_divide(F.col("var_y"), F.col("n_y"))
    table = sums.select(
        *keys,
        "mean_x",
        "mean_y",
        F.try_divide(F.col("mean_x") - F.col("mean_y"), F.sqrt(sx + sy)).alias("t"),
        F.try_divide(
            (sx + sy) * (sx + sy),
            F.try_divide(sx * sx, F.col("n_x") - 1) + F.try_divide(sy * sy, F.col("n_y") - 1),
        ).alias("df"),
    )
    return table.withColumn("p_value", t_pvalue("t", "df"))


def wilcoxon_signed_rank(df: DataFrame, first: str, second: str) -> DataFrame:
    """Paired signed-rank test: V exactly, the p-value by the normal approximation with ties."""
    differences = df.select((F.col(first) - F.col(second)).alias("_d")).where(
        F.col("_d").isNotNull() & (F.col("_d") != 0)
    )
    sized = differences.withColumn("_size", F.abs("_d"))
    ranks = value_ranks(sized, "_size", extra=[F.count_if(F.col("_d") > 0).alias("_plus")])
    n = F.col("n").cast("double")
    mean_rank = F.col("n_below") + (n + 1) / 2
    sums = ranks.agg(
        F.sum("n").alias("n"),
        F.sum(F.col("_plus") * mean_rank).alias("v"),
        F.sum(n * n * n - n).alias("_ties"),
    )
    total = F.col("n").cast("double")
    centre = F.col("v") - total * (total + 1) / 4
    spread = F.sqrt(total * (total + 1) * (2 * total + 1) / 24 - F.col("_ties") / 48)
    z = F.try_divide(centre - F.signum(centre) * 0.5, spread)
    scored = sums.withColumn("z", z)
    return scored.select(
        "n",
        "v",
        "z",
        F.least(F.lit(1.0), 2 * normal_upper_pvalue(F.abs("z"))).alias("p_value"),
    )
