"""Calibration, models against a reference, imputation and tests."""

from __future__ import annotations

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from fleetfold.catalog import fixtures as fx
from fleetfold.catalog.aggregates import SEASON_SQL, rounded, seasonal
from fleetfold.catalog.joins import (
    GAS_FIT_SQL,
    GAS_MIN_R2,
    MONITOR_COLUMNS,
    RECENT_SQL,
    SPLIT_SQL,
    WIDE_GAS_SQL,
    gas_fits,
)
from fleetfold.catalog.registry import query
from fleetfold.catalog.scalars import COOKING_SQL, CORRECTED_SQL
from fleetfold.catalog.sources import scratch
from fleetfold.config import FitRules, Settings, Window
from fleetfold.functions.mixture import Mixture, conditional_mean, responsibilities
from fleetfold.operators import calibrate, impute, models, reshape, spatial, stats, trends
from fleetfold.operators.ordering import day_block_split
from fleetfold.sources.tables import load_model, save_model

RULES = FitRules(min_active_monitors=3, min_points=300, min_r2=0.08)
FIRST = Window("first", dt.date(2024, 1, 1), dt.date(2024, 1, 20), "original")
SECOND = Window("second", dt.date(2024, 1, 10), dt.date(2024, 1, 30), "new", "MOD-PM-00004")


def fitted_on():
    return F.lit(dt.date(2024, 2, 1))


CAL_COLUMNS = ("slope", "intercept", "r2", "rmse")

FLEET_FIT_SQL = """
    SELECT monitor, 'pm25' AS pollutant, regr_slope(y, x) AS slope,
           regr_intercept(y, x) AS intercept, regr_r2(y, x) AS r2,
           sqrt((regr_syy(y, x) - pow(regr_sxy(y, x), 2) / regr_sxx(y, x)) / count(*)) AS rmse,
           count(*) AS n_points, 'fleet_avg' AS method, NULL::VARCHAR AS reference_monitor,
           TIMESTAMP '2024-01-01' AS colocation_start, TIMESTAMP '2024-01-20' AS colocation_end,
           DATE '2024-02-01' AS fitted_on, 'first' AS window_name
    FROM (SELECT c.monitor, c.pm25 AS y, f.x FROM
            (SELECT * FROM coloc WHERE date BETWEEN DATE '2024-01-01' AND DATE '2024-01-20'
               AND monitor IN (SELECT monitor FROM groups WHERE "group" = 'original')) c
          JOIN (SELECT timestamp, avg(pm25) AS x FROM coloc
                WHERE monitor IN (SELECT monitor FROM groups WHERE "group" = 'original')
                GROUP BY 1 HAVING count(pm25) >= 3) f ON c.timestamp = f.timestamp
          WHERE c.pm25 IS NOT NULL)
    GROUP BY monitor HAVING count(*) >= 300 AND regr_r2(y, x) >= 0.08"""

REFERENCE_FIT_SQL = f"""
    SELECT monitor, 'pm25' AS pollutant, regr_slope(y, x) AS slope,
           regr_intercept(y, x) AS intercept, regr_r2(y, x) AS r2,
           sqrt((regr_syy(y, x) - pow(regr_sxy(y, x), 2) / regr_sxx(y, x)) / count(*)) AS rmse,
           count(*) AS n_points, 'coloc_vs_corrected_ref' AS method,
           'MOD-PM-00004' AS reference_monitor,
           TIMESTAMP '2024-01-10' AS colocation_start, TIMESTAMP '2024-01-30' AS colocation_end,
           DATE '2024-02-01' AS fitted_on, 'second' AS window_name
    FROM (SELECT c.monitor, c.pm25 AS y, (r.pm25 - p.intercept) / p.slope AS x
          FROM coloc c
          JOIN coloc r ON c.timestamp = r.timestamp AND r.monitor = 'MOD-PM-00004'
          JOIN ({FLEET_FIT_SQL}) p ON p.monitor = 'MOD-PM-00004'
          WHERE c.date BETWEEN DATE '2024-01-10' AND DATE '2024-01-30'
            AND c.monitor IN (SELECT monitor FROM groups WHERE "group" = 'new')
            AND c.pm25 IS NOT NULL AND r.pm25 IS NOT NULL)
    GROUP BY monitor HAVING count(*) >= {{n}}"""


def _rounded_cal(sql: str) -> str:
    return f"""SELECT monitor, pollutant, round(slope, 7) AS slope, round(intercept, 7) AS intercept,
        round(r2, 7) AS r2, round(rmse, 7) AS rmse, n_points, method, reference_monitor,
        colocation_start, colocation_end, fitted_on, window_name FROM ({sql})"""


@query("m01_calibrate_fleet", _rounded_cal(FLEET_FIT_SQL))
def m01(spark, sf):
    fits = calibrate.calibrate_on_fleet(
        fx.coloc(spark, sf), "pm25", FIRST, RULES, fx.roster(spark, sf), fitted_on()
    )
    return rounded(fits, *CAL_COLUMNS, digits=7)


@query("m02_calibrate_on_reference", _rounded_cal(REFERENCE_FIT_SQL.format(n=100)))
def m02(spark, sf):
    coloc = fx.coloc(spark, sf)
    baseline = calibrate.calibrate_on_fleet(
        coloc, "pm25", FIRST, RULES, fx.roster(spark, sf), fitted_on()
    )
    fits = calibrate.calibrate_on_reference(
        coloc, "pm25", SECOND, FitRules(3, 100, 0.0), baseline, fx.roster(spark, sf, "new"),
        fitted_on(),
    )
    return rounded(fits, *CAL_COLUMNS, digits=7)


@query(
    "m03_calibrate_windows",
    _rounded_cal(
        f"""SELECT * FROM ({FLEET_FIT_SQL})
            UNION ALL SELECT * FROM ({REFERENCE_FIT_SQL.format(n=300)} AND regr_r2(y, x) >= 0.08)"""
    ),
)
def m03(spark, sf):
    table = calibrate.calibrate_windows(
        {"pm25": fx.coloc(spark, sf)},
        Settings(RULES, (FIRST, SECOND)),
        {g: fx.roster(spark, sf, g) for g in ("original", "new")},
        fitted_on=fitted_on(),
    )
    return rounded(table, *CAL_COLUMNS, digits=7)


@query(
    "m04_apply_calibration",
    f"""WITH {CORRECTED_SQL}
        SELECT monitor, timestamp, date, hour, source, coalesce(usable AND pm25 >= 1, FALSE)
                 AS calibrated_pm25,
               CASE WHEN pm25 >= 1 THEN pm25 END AS pm25_raw,
               CASE WHEN value >= 1 THEN value END AS pm25 FROM corrected""",
)
def m04(spark, sf):
    return calibrate.apply_calibration(fx.merged(spark, sf), fx.cal(spark, sf), "pm25")


@query(
    "m05_apply_gas_calibration",
    f"""WITH w AS (SELECT monitor, {WIDE_GAS_SQL} FROM ({GAS_FIT_SQL.format(r2=GAS_MIN_R2)}) GROUP BY 1)
        SELECT g.monitor, g.timestamp, g.date, g.hour, g.source,
               {", ".join(f"round((g.{c} - {c}_intercept) / {c}_slope, 5) AS {c}" for c in fx.GASES)}
        FROM gas_hours g LEFT JOIN w ON g.monitor = w.monitor""",
)
def m05(spark, sf):
    table = calibrate.apply_gas_calibration(
        fx.gas_hours(spark, sf), gas_fits(spark, sf), fx.GASES
    )
    return rounded(table, *fx.GASES, digits=5)


def dry(df):
    return F.when(F.dayofmonth("date") > 20, 1).otherwise(0)


def model_table(spark, sf):
    """Two overlapping batches of device hours joined to the reference."""
    hours = fx.model_hours(spark, sf)
    devices = hours.drop("ref_pm25", "season_binary")
    day = F.dayofmonth("date")
    reference = hours.groupBy("date", "hour").agg(F.max("ref_pm25").alias("ref_pm25"))
    return models.model_table(
        [devices.where(day <= 18), devices.where(day >= 15)], reference, "ref_pm25",
        season=dry(devices),
    )


MODEL_SQL = f"""
    SELECT monitor, date, hour, mod_pm25, mod_temp, mod_rh, ref_pm25, season_binary,
           sin(2 * pi() * hour / 24) AS sin_hour, cos(2 * pi() * hour / 24) AS cos_hour,
           s.season, s.split_day_block,
           row_number() OVER (ORDER BY md5(monitor || '|' || CAST(date AS VARCHAR) || '|'
             || CAST(hour AS VARCHAR)), monitor, date, hour) AS row_id
    FROM model_hours JOIN ({SPLIT_SQL}) s USING (date)"""


@query(
    "m06_model_table",
    f"""SELECT monitor, date, hour, round(mod_pm25, 9) AS mod_pm25, round(mod_temp, 9) AS mod_temp,
               round(mod_rh, 9) AS mod_rh, round(ref_pm25, 9) AS ref_pm25, season_binary,
               round(sin_hour, 8) + 0.0 AS sin_hour, round(cos_hour, 8) + 0.0 AS cos_hour, season,
               split_day_block, row_id FROM ({MODEL_SQL})""",
)
def m06(spark, sf):
    table = rounded(model_table(spark, sf), "mod_pm25", "mod_temp", "mod_rh", "ref_pm25")
    return table.withColumns(
        {c: F.round(c, 8) + 0.0 for c in ("sin_hour", "cos_hour")}
    )


NUMERIC = ["mod_pm25", "mod_temp", "mod_rh", "sin_hour", "cos_hour"]


def split_parts(spark, sf):
    table = model_table(spark, sf)
    return (
        table.where(F.col("split_day_block") == "train"),
        table.where(F.col("split_day_block") == "test"),
    )


@query("m07_elastic_net")
def m07(spark, sf):
    train, test = split_parts(spark, sf)
    model = models.fit_elastic_net(train, NUMERIC, ["season"], "ref_pm25")
    scored = model.bestModel.transform(test)
    return stats.error_metrics(scored, "ref_pm25", "prediction")


@query("m08_boosted_trees")
def m08(spark, sf):
    train, test = split_parts(spark, sf)
    model = models.fit_boosted_trees(train, NUMERIC, ["season"], "ref_pm25")
    scored = model.bestModel.transform(test)
    return stats.error_metrics(scored, "ref_pm25", "prediction")


@query("m09_predict_side_by_side")
def m09(spark, sf):
    train, test = split_parts(spark, sf)
    linear = models.fit_elastic_net(train, NUMERIC, ["season"], "ref_pm25")
    trees = models.fit_boosted_trees(train, NUMERIC, ["season"], "ref_pm25")
    return models.predict_with(
        test,
        {"pm25_fem_enet": linear.bestModel, "pm25_fem_trees": trees.bestModel},
        NUMERIC,
    )


JOINT = ["mod_pm25", "mod_temp", "mod_rh", "ref_pm25"]
SEASONAL = ["mod_pm25", "mod_temp", "mod_rh", "sin_hour", "cos_hour", "season_binary", "ref_pm25"]


@query("m10_mixture_size_by_bic")
def m10(spark, sf):
    train, _ = split_parts(spark, sf)
    return models.mixture_bic_sweep(train, ["mod_pm25", "mod_rh", "ref_pm25"], range(1, 16))


@query(
    "m10_single_gaussian",
    f"""SELECT CAST(1 AS INTEGER) AS k, round(l, 3) AS log_likelihood, round(5 * ln(n) - 2 * l, 3) AS bic
        FROM (SELECT n, -0.5 * n * (2 + 2 * ln(2 * pi()) + ln(a * b - c * c)) AS l
              FROM (SELECT count(*) AS n, var_pop(mod_pm25) AS a, var_pop(ref_pm25) AS b,
                           covar_pop(mod_pm25, ref_pm25) AS c
                    FROM ({MODEL_SQL}) WHERE split_day_block = 'train'
                      AND mod_pm25 IS NOT NULL AND ref_pm25 IS NOT NULL))""",
)
def m10_single(spark, sf):
    """The sweep at one component, where the likelihood has a closed form."""
    train, _ = split_parts(spark, sf)
    table = models.mixture_bic_sweep(train, ["mod_pm25", "ref_pm25"], [1])
    return rounded(table, "log_likelihood", "bic", digits=3)


@query("m11_mixture_regression")
def m11(spark, sf):
    train, test = split_parts(spark, sf)
    mixture = models.fit_mixture(train, ["mod_pm25", "mod_rh", "ref_pm25"], 5)
    scored = test.withColumn(
        "prediction", conditional_mean(mixture, "ref_pm25", ["mod_pm25", "mod_rh"])
    )
    return stats.error_metrics(scored, "ref_pm25", "prediction")


# Fixed parameters, so that the closed form can be written down in SQL as well.
FIXED = Mixture(
    ("mod_pm25", "ref_pm25"),
    np.array([0.6, 0.4]),
    np.array([[40.0, 45.0], [90.0, 60.0]]),
    np.array([[[400.0, 100.0], [100.0, 90.0]], [[900.0, 150.0], [150.0, 120.0]]]),
)
FIXED_SQL = """
    SELECT *, 1 / (1 + exp(b - a)) AS w1, 1 / (1 + exp(a - b)) AS w2,
           1 / (1 + exp(b - a)) * (45 + 100 / 400.0::DOUBLE * (mod_pm25 - 40))
             + 1 / (1 + exp(a - b)) * (60 + 150 / 900.0::DOUBLE * (mod_pm25 - 90)) AS fem
    FROM (SELECT *, ln(0.6 / 20.0::DOUBLE) - 0.5::DOUBLE * pow((mod_pm25 - 40) / 20, 2) AS a,
                 ln(0.4 / 30.0::DOUBLE) - 0.5::DOUBLE * pow((mod_pm25 - 90) / 30, 2) AS b
          FROM (SELECT monitor, date, hour, ref_pm25,
                       CASE WHEN hour % 5 <> 0 THEN mod_pm25 END AS mod_pm25 FROM model_hours))"""


def fixed_hours(spark, sf):
    return fx.model_hours(spark, sf).withColumn(
        "mod_pm25", F.when(F.col("hour") % 5 != 0, F.col("mod_pm25"))
    )


@query(
    "m11_mixture_regression_fixed",
    f"""SELECT monitor, date, hour, round(w1, 8) AS w1, round(fem, 7) AS fem FROM ({FIXED_SQL})""",
)
def m11_fixed(spark, sf):
    share = responsibilities(FIXED, ["mod_pm25"])[0]
    value = conditional_mean(FIXED, "ref_pm25", ["mod_pm25"])
    rows = fixed_hours(spark, sf)
    return rows.select(
        "monitor", "date", "hour", F.round(share, 8).alias("w1"), F.round(value, 7).alias("fem")
    )


@query("m12_mixture_with_missing_predictors")
def m12(spark, sf):
    train, test = split_parts(spark, sf)
    mixture = models.fit_mixture(train, JOINT, 4)
    gaps = test.withColumns(
        {
            "mod_rh": F.when(F.col("row_id") % 3 != 0, F.col("mod_rh")),
            "mod_temp": F.when(F.col("row_id") % 4 != 0, F.col("mod_temp")),
        }
    )
    scored = models.apply_mixture_with_gaps(
        gaps, mixture, "ref_pm25", ["mod_pm25"], ["mod_temp", "mod_rh"]
    )
    pattern = F.concat_ws(
        "+", F.when(F.col("mod_temp").isNull(), "temp"), F.when(F.col("mod_rh").isNull(), "rh")
    )
    return stats.error_metrics(
        scored.withColumn("missing", pattern), "ref_pm25", "pm25_fem_gmr", ["missing"]
    )


@query("m13_bias_by_component")
def m13(spark, sf):
    train, _ = split_parts(spark, sf)
    mixture = models.fit_mixture(train, JOINT, 4)
    scored = train.withColumn(
        "prediction", conditional_mean(mixture, "ref_pm25", JOINT[:-1])
    )
    return models.component_bias(scored, mixture, "mod_pm25", "ref_pm25", "prediction")


@query(
    "m14_apply_mixture",
    f"""SELECT monitor, date, hour, round(greatest(fem, 0), 7) AS pm25_fem_gmr,
               round(greatest(fem, 0) - mod_pm25, 7) AS delta_gmr,
               round(CASE WHEN mod_pm25 > 0 THEN greatest(fem, 0) / mod_pm25 END, 6) AS ratio_gmr
        FROM (SELECT monitor, date, hour, mod_pm25, fem FROM ({FIXED_SQL}))
        WHERE fem IS NOT NULL OR mod_pm25 IS NULL""".replace(
        "greatest(fem, 0)", "CASE WHEN fem IS NOT NULL THEN greatest(fem, 0) END"
    ),
)
def m14(spark, sf):
    rows = fixed_hours(spark, sf)
    table = models.apply_mixture(rows, FIXED, "ref_pm25", ["mod_pm25"])
    return table.select(
        "monitor", "date", "hour",
        F.round("pm25_fem_gmr", 7).alias("pm25_fem_gmr"),
        F.round("delta_gmr", 7).alias("delta_gmr"),
        F.round("ratio_gmr", 6).alias("ratio_gmr"),
    )


@query("m14_apply_seasonal_mixture")
def m14_seasonal(spark, sf):
    """The whole path: fit on training days, calibrate every hour, keep incomplete rows null."""
    train, _ = split_parts(spark, sf)
    mixture = models.fit_mixture(train, SEASONAL, 4)
    hours = models.with_time_features(fx.model_hours(spark, sf), dry(None))
    gaps = hours.withColumn("mod_rh", F.when(F.col("hour") % 7 != 0, F.col("mod_rh")))
    return models.apply_mixture(gaps, mixture, "ref_pm25", SEASONAL[:-1])


CANDIDATES = (1, 2, 3, 5, 10, 20)


@query(
    "m16_tune_leave_one_out",
    """SELECT CAST(m AS INTEGER) AS min_active, round(sqrt(avg(pow(p - y, 2))), 7) AS rmse,
              round(avg(abs(p - y)), 7) AS mae,
              round(1 - sum(pow(p - y, 2)) / (sum(y * y) - pow(sum(y), 2) / count(*)), 7) AS r2
       FROM (SELECT mean_pm25 AS y, n_reporting AS n,
                    (sum(mean_pm25) OVER (PARTITION BY timestamp) - mean_pm25) / (n_reporting - 1)
                      AS p FROM loo),
            (SELECT unnest([1, 2, 3, 5, 10, 20]) AS m)
       WHERE n - 1 >= m AND y IS NOT NULL GROUP BY m""",
)
def m16(spark, sf):
    table = impute.tune_min_others(
        fx.loo(spark, sf).drop("n_reporting", "fleet_avg"), "mean_pm25", CANDIDATES
    )
    return rounded(table, "rmse", "mae", "r2", digits=7)


FLEET_FEATURES = ["fleet_avg", "hour", "month", "dow", "met_temp", "met_rh"]


def imputation_table(spark, sf):
    weather = fx.readings(spark, sf).groupBy("monitor", "date", "hour").agg(
        F.avg("met_temp").alias("met_temp"), F.avg("met_rh").alias("met_rh")
    )
    return (
        fx.loo(spark, sf, "others")
        .join(weather, ["monitor", "date", "hour"], "left")
        .withColumns({"month": F.month("date"), "dow": F.weekday("date")})
    )


def _fit_imputation(df, numeric, nominal):
    known = day_block_split(df.where(F.col("mean_pm25").isNotNull()), "date", seed="222")
    train = known.where(F.col("split_day_block") == "train")
    return models.fit_boosted_trees(
        train, numeric, nominal, "mean_pm25", models.imputation_grid(), trees=300, folds=3
    )


@query("m17_impute_from_fleet")
def m17(spark, sf):
    df = imputation_table(spark, sf)
    model = _fit_imputation(df, FLEET_FEATURES, ["monitor"])
    scored = models.predict_with(df, {"pred_pm25": model.bestModel}, FLEET_FEATURES)
    filled = impute.fill_gaps(scored, "mean_pm25", "pred_pm25")
    return filled.select(
        "monitor", "timestamp", "mean_pm25", "pred_pm25", "pm25_filled", "pm25_data_source"
    )


@query("m18_impute_from_all_monitors")
def m18(spark, sf):
    columns = list(MONITOR_COLUMNS.values())
    df = reshape.others_matrix(imputation_table(spark, sf), MONITOR_COLUMNS, "mean_pm25")
    numeric = [*columns, "hour", "month", "dow", "met_temp", "met_rh"]
    model = _fit_imputation(df, numeric, [])
    scored = models.predict_with(df, {"pred_pm25": model.bestModel}, numeric)
    return impute.fill_gaps(scored, "mean_pm25", "pred_pm25").select(
        "monitor", "timestamp", "mean_pm25", "pred_pm25", "pm25_filled", "pm25_data_source"
    )


GAPS_SQL = """
    SELECT monitor, timestamp, mean_pm25, CASE WHEN n_reporting > 2 THEN CASE WHEN mean_pm25 IS NULL
             THEN total / n_reporting ELSE (total - mean_pm25) / (n_reporting - 1) END END AS g
    FROM (SELECT *, sum(mean_pm25) OVER (PARTITION BY timestamp) AS total FROM loo)"""


@query(
    "m19_fill_gaps",
    f"""SELECT monitor, timestamp, round(coalesce(mean_pm25, g), 9) AS pm25_filled,
               mean_pm25 IS NULL AND g IS NOT NULL AS pm25_was_imputed,
               CASE WHEN mean_pm25 IS NOT NULL THEN 'observed' WHEN g IS NOT NULL THEN 'imputed'
                    ELSE 'missing' END AS pm25_data_source FROM ({GAPS_SQL})""",
)
def m19(spark, sf):
    filled = impute.fill_gaps(fx.loo(spark, sf, "others"), "mean_pm25", "fleet_avg")
    return filled.select(
        "monitor", "timestamp", F.round("pm25_filled", 9).alias("pm25_filled"),
        "pm25_was_imputed", "pm25_data_source",
    )


@query(
    "m19_fill_full_grid",
    """SELECT m.monitor, g.timestamp, round(coalesce(h.y, f.x), 9) AS pm25_filled,
              CASE WHEN h.y IS NOT NULL THEN 'observed' WHEN f.x IS NOT NULL THEN 'imputed'
                   ELSE 'missing' END AS pm25_data_source
       FROM (SELECT DISTINCT monitor FROM loo) m,
            (SELECT unnest(generate_series(min(timestamp), max(timestamp), INTERVAL 1 HOUR))
               AS timestamp FROM loo) g
       LEFT JOIN (SELECT monitor, timestamp, mean_pm25 AS y FROM loo) h
         ON h.monitor = m.monitor AND h.timestamp = g.timestamp
       LEFT JOIN (SELECT timestamp, avg(mean_pm25) AS x FROM loo GROUP BY 1
                  HAVING count(mean_pm25) > 2) f ON f.timestamp = g.timestamp""",
)
def m19_grid(spark, sf):
    base = fx.loo(spark, sf).select("monitor", "timestamp", "mean_pm25")
    grid = impute.leave_one_out(impute.every_step(base), "mean_pm25", mode="others")
    return impute.fill_gaps(grid, "mean_pm25", "fleet_avg").select(
        "monitor", "timestamp", F.round("pm25_filled", 9).alias("pm25_filled"), "pm25_data_source"
    )


@query(
    "m20_compare_models",
    " UNION ALL ".join(
        f"""SELECT '{label}' AS model, round(sqrt(avg(pow(p - y, 2))), 8) AS rmse,
                   round(avg(abs(p - y)), 8) AS mae,
                   round(1 - sum(pow(p - y, 2)) / regr_syy(y, p), 8) AS r2
            FROM (SELECT ref_pm25 AS y, {expression} AS p FROM model_hours)"""
        for label, expression in (
            ("raw", "mod_pm25"), ("scaled", "mod_pm25 * 0.5 + 25"), ("rh", "mod_rh")
        )
    ),
)
def m20(spark, sf):
    df = fx.model_hours(spark, sf).withColumn("scaled", F.col("mod_pm25") * 0.5 + 25)
    table = models.compare_models(
        df, "ref_pm25", {"raw": "mod_pm25", "scaled": "scaled", "rh": "mod_rh"}
    )
    return rounded(table, "rmse", "mae", "r2", digits=8)


@query("m20_feature_importance")
def m20_importance(spark, sf):
    train, _ = split_parts(spark, sf)
    model = models.fit_boosted_trees(train, NUMERIC, ["season"], "ref_pm25").bestModel
    return models.top_importances(spark, model, 20, "season")


ANOVA_SQL = """
    SELECT {key} count(*) - 1 AS df_between, CAST(sum(n) AS BIGINT) - count(*) AS df_within,
           round(sum(n * m * m) - pow(sum(n * m), 2) / sum(n), 5) AS ss_between,
           round(sum((n - 1) * v), 4) AS ss_within,
           round(((sum(n * m * m) - pow(sum(n * m), 2) / sum(n)) / (count(*) - 1))
             / (sum((n - 1) * v) / (sum(n) - count(*))), 6) AS f
    FROM (SELECT {key} {level} AS level, count(*) AS n, avg(mean_pm25) AS m,
                 var_samp(mean_pm25) AS v
          FROM (SELECT *, {season} AS season FROM hourly) WHERE mean_pm25 IS NOT NULL GROUP BY ALL)
    {group}"""


@query(
    "m21_anova_cooking_period",
    ANOVA_SQL.format(key="", level=COOKING_SQL, season=SEASON_SQL, group=""),
)
def m21(spark, sf):
    return _anova(stats.one_way_anova(seasonal(spark, sf), "mean_pm25", "cooking_period"))


@query(
    "m21_anova_by_season",
    ANOVA_SQL.format(
        key="season,", level=COOKING_SQL, season=SEASON_SQL, group="GROUP BY season"
    ),
)
def m21_season(spark, sf):
    return _anova(
        stats.one_way_anova(seasonal(spark, sf), "mean_pm25", "cooking_period", ["season"])
    )


def _anova(table):
    """Columns both engines can compute; the p-value is tested against published values."""
    return rounded(rounded(table.drop("p_value"), "ss_between", digits=5), "ss_within", digits=4) \
        .withColumn("f", F.round("f", 6))


@query("m21_anova_p_values")
def m21_p(spark, sf):
    return stats.one_way_anova(seasonal(spark, sf), "mean_pm25", "cooking_period", ["season"])


@query(
    "m22_tukey_pairs",
    f"""WITH g AS (SELECT {COOKING_SQL} AS level, count(*) AS n, avg(mean_pm25) AS m,
                          var_samp(mean_pm25) AS v
                   FROM hourly WHERE mean_pm25 IS NOT NULL GROUP BY 1),
             e AS (SELECT sum((n - 1) * v) / (sum(n) - count(*)) AS mse FROM g)
        SELECT a.level AS level_a, b.level AS level_b, round(b.m - a.m, 8) AS diff,
               round(abs(b.m - a.m) / sqrt(mse / 2 * (1.0::DOUBLE / a.n + 1.0::DOUBLE / b.n)), 8) AS q
        FROM g a JOIN g b ON a.level < b.level, e""",
)
def m22(spark, sf):
    table = stats.tukey_pairs(seasonal(spark, sf), "mean_pm25", "cooking_period")
    return rounded(
        table.select("level_a", "level_b", "diff", "q"), "diff", "q", digits=8
    )


@query("m22_tukey_adjusted_p")
def m22_p(spark, sf):
    return stats.tukey_pairs(seasonal(spark, sf), "mean_pm25", "cooking_period")


WELCH_SQL = """
    SELECT mx AS mean_x, my AS mean_y, (mx - my) / sqrt(vx / nx + vy / ny) AS t,
           pow(vx / nx + vy / ny, 2) / (pow(vx / nx, 2) / (nx - 1) + pow(vy / ny, 2) / (ny - 1)) AS df
    FROM (SELECT avg(v) FILTER (pm) AS mx, avg(v) FILTER (NOT pm) AS my,
                 var_samp(v) FILTER (pm) AS vx, var_samp(v) FILTER (NOT pm) AS vy,
                 count(v) FILTER (pm) AS nx, count(v) FILTER (NOT pm) AS ny
          FROM (SELECT contains(monitor, 'MOD-PM') AS pm, date, hour, avg(mean_pm25) AS v
                FROM hourly GROUP BY 1, 2, 3))"""


def welch(spark, sf):
    hours = (
        trends.by_device_class(fx.hourly(spark, sf))
        .groupBy("device_class", "date", "hour")
        .agg(F.avg("mean_pm25").alias("value"))
    )
    return stats.welch_test(hours, "value", F.col("device_class") == "MOD-PM")


@query(
    "m23_welch_test",
    f"""SELECT round(mean_x, 8) AS mean_x, round(mean_y, 8) AS mean_y, round(t, 8) AS t,
               round(df, 6) AS df FROM ({WELCH_SQL})""",
)
def m23(spark, sf):
    table = rounded(welch(spark, sf).drop("p_value"), "mean_x", "mean_y", "t", digits=8)
    return table.withColumn("df", F.round("df", 6))


@query("m23_welch_p_value")
def m23_p(spark, sf):
    return welch(spark, sf)


@query(
    "m24_wilcoxon",
    """SELECT CAST(count(*) AS BIGINT) AS n, sum(CASE WHEN d > 0 THEN r END) AS v FROM (
         SELECT d, (min(k) OVER (PARTITION BY abs(d)) + max(k) OVER (PARTITION BY abs(d)))
                / 2.0::DOUBLE AS r
         FROM (SELECT d, row_number() OVER (ORDER BY abs(d)) AS k
               FROM (SELECT round(met_rh, 1) - round(pm25, 1) AS d FROM readings
                     WHERE pm25 IS NOT NULL) WHERE d <> 0))""",
)
def m24(spark, sf):
    return wilcoxon(spark, sf).select("n", "v")


def wilcoxon(spark, sf):
    df = fx.readings(spark, sf).select(
        F.round("met_rh", 1).alias("a"), F.round("pm25", 1).alias("b")
    )
    return stats.wilcoxon_signed_rank(df, "a", "b")


@query("m24_wilcoxon_p_value")
def m24_p(spark, sf):
    return wilcoxon(spark, sf)


MORAN_SQL = """
    WITH p AS (SELECT *, value - avg(value) OVER () AS z FROM sites WHERE value IS NOT NULL),
    e AS (SELECT i, j, 0.2::DOUBLE AS w FROM (
            SELECT a.monitor AS i, b.monitor AS j, row_number() OVER (PARTITION BY a.monitor
                     ORDER BY sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), b.monitor) AS r
            FROM p a JOIN p b ON a.monitor <> b.monitor) WHERE r <= 5),
    c AS (SELECT sum(w * a.z * b.z) AS cross_sum, sum(w) AS s0
          FROM e JOIN p a ON e.i = a.monitor JOIN p b ON e.j = b.monitor),
    m AS (SELECT count(*)::DOUBLE AS n, sum(z * z) AS m2, sum(pow(z, 4)) AS m4 FROM p),
    s1 AS (SELECT sum(pow(w, 2)) AS s1 FROM (SELECT sum(w) AS w FROM e
           GROUP BY least(i, j), greatest(i, j))),
    s2 AS (SELECT sum(pow(w, 2)) AS s2 FROM (SELECT k, sum(w) AS w FROM (
             SELECT i AS k, w FROM e UNION ALL SELECT j, w FROM e) GROUP BY k)),
    t AS (SELECT n / s0 * cross_sum / m2 AS observed, -1 / (n - 1) AS expected,
                 (n * ((n * n - 3 * n + 3) * s1 - n * s2 + 3 * s0 * s0)
                  - n * m4 / (m2 * m2) * ((n * n - n) * s1 - 2 * n * s2 + 6 * s0 * s0))
                 / ((n - 1) * (n - 2) * (n - 3) * s0 * s0) - 1 / pow(n - 1, 2) AS variance
          FROM c, m, s1, s2)
    SELECT round(observed, 9) AS observed, round(expected, 9) AS expected,
           round(variance, 9) AS variance, round((observed - expected) / sqrt(variance), 8) AS z_score
    FROM t"""


@query("m25_moran", MORAN_SQL)
def m25(spark, sf):
    table = spatial.moran_test(fx.sites(spark, sf), 5).drop("p_value")
    return rounded(table, "observed", "expected", "variance").withColumn(
        "z_score", F.round("z_score", 8)
    )


@query("m25_moran_p_value")
def m25_p(spark, sf):
    return spatial.moran_test(fx.sites(spark, sf), 5)


@query("m26_log_linear_fit")
def m26(spark, sf):
    near = spatial.nearest_segment(fx.sites(spark, sf), fx.roads(spark, sf))
    return models.log_linear_fit(
        near.withColumn("value", F.col("value") + 2000),
        "value",
        {
            "distance": F.col("distance_to_road"),
            "main_road": (F.col("highway") != "track").cast("int"),
        },
    )


@query(
    "m27_reference_against_fleet",
    f"""SELECT count(*) AS n_points, round(regr_slope(y, x), 8) AS slope,
               round(regr_intercept(y, x), 8) AS intercept, round(regr_r2(y, x), 8) AS r2,
               round(sqrt((regr_syy(y, x) - pow(regr_sxy(y, x), 2) / regr_sxx(y, x)) / count(*)), 8)
                 AS rmse
        FROM (SELECT (c.pm25 - p.intercept) / p.slope AS y, f.x FROM coloc c
              JOIN ({RECENT_SQL}) p ON c.monitor = p.monitor AND p.monitor = 'MOD-00000'
              JOIN (SELECT timestamp, avg(pm25) AS x FROM coloc GROUP BY 1 HAVING count(pm25) >= 3) f
                ON c.timestamp = f.timestamp) WHERE y IS NOT NULL""",
)
def m27(spark, sf):
    df = fx.coloc(spark, sf)
    reference = calibrate.corrected_reference(df, "pm25", fx.REFERENCE, fx.cal(spark, sf))
    pairs = reference.join(calibrate.fleet_average(df, "pm25", 3), "timestamp")
    fit = calibrate.least_squares(pairs, "ref_corr", "fleet_avg", ())
    return rounded(fit, "slope", "intercept", "r2", "rmse", digits=8)


@query("s16_model_round_trip")
def s16(spark, sf):
    train, test = split_parts(spark, sf)
    fitted = models.fit_elastic_net(train, NUMERIC, ["season"], "ref_pm25")
    path = scratch(spark, "model")
    save_model(fitted.bestModel, path)
    scored = load_model(path).transform(test)
    return scored.select("monitor", "date", "hour", "ref_pm25", "prediction")


LEVELS = sorted(MONITOR_COLUMNS)[:-1]


@query(
    "r07_one_hot",
    f"""SELECT event_id, monitor, {", ".join(
        f"CAST(monitor = '{m}' AS INTEGER) AS \"monitor_{m}\"" for m in LEVELS[1:])}
        FROM readings""",
)
def r07(spark, sf):
    """Indicators of the levels known to a model; the last monitor plays the unknown one."""
    df = fx.readings(spark, sf).select("event_id", "monitor")
    return reshape.indicator_columns(df, "monitor", LEVELS)
