"""Models against a reference instrument and for gap filling."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import (
    Imputer,
    OneHotEncoder,
    StandardScaler,
    StringIndexer,
    VarianceThresholdSelector,
    VectorAssembler,
)
from pyspark.ml.regression import LinearRegression
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetfold.functions.calendar import dry_season_flag, hour_angle
from fleetfold.functions.columns import clamp_at_zero, guarded_ratio
from fleetfold.functions.distributions import t_two_sided
from fleetfold.functions.mixture import (
    Mixture,
    conditional_mean,
    conditional_mean_with_gaps,
    hard_label,
    responsibilities,
)
from fleetfold.operators.boosted import BoostedModel, TunedTrees, tune_boosted_trees
from fleetfold.operators.merge import combine_channels, stack_batches, valid_since
from fleetfold.operators.mixtures import ROUNDS, fit_mixtures
from fleetfold.operators.ordering import day_block_split, day_fold, row_ids
from fleetfold.operators.stats import error_metrics
from fleetfold.session import cut_lineage, settle

HOUR_KEYS = ["monitor", "date", "hour"]
SIMPLE_PREDICTORS = ("mod_pm25", "mod_temp", "mod_rh")
SEASONAL_PREDICTORS = (*SIMPLE_PREDICTORS, "sin_hour", "cos_hour", "season_binary")


# --- tables -------------------------------------------------------------------------------------


def with_time_features(df: DataFrame, season: Column | None = None) -> DataFrame:
    """Hour on the circle and the dry-season flag."""
    sine, cosine = hour_angle("hour")
    flag = dry_season_flag(F.month("date")) if season is None else season
    return df.withColumns({"sin_hour": sine, "cos_hour": cosine, "season_binary": flag})


def model_table(
    batches: Sequence[DataFrame],
    reference: DataFrame,
    target: str,
    starts: DataFrame | None = None,
    season: Column | None = None,
    test_share: float = 0.2,
) -> DataFrame:
    """Device hours joined to reference hours, with features, split by whole days and numbered.

    Overlapping batches keep the first row of an hour, rows of one batch being ordered by their
    readings; ``starts`` gives the first valid day of single monitors; ``target`` is the column of
    the reference to learn.
    """
    readings = [F.col(c) for c in batches[0].columns if c not in HOUR_KEYS]
    devices = stack_batches(batches, HOUR_KEYS, readings)
    if starts is not None:
        devices = valid_since(devices, starts)
    joined = devices.join(
        reference.select("date", "hour", target).where(F.col(target).isNotNull()),
        ["date", "hour"],
    )
    features = with_time_features(joined, season)
    labelled = features.withColumn(
        "season", F.when(F.col("season_binary") == 1, "dry").otherwise("wet")
    )
    split = day_block_split(labelled, "date", ["season"], test_share)
    return row_ids(split, HOUR_KEYS)


def hours_to_calibrate(channels: Mapping[str, DataFrame]) -> DataFrame:
    """All device hours with any channel; each table is deduplicated and its nulls dropped."""
    cleaned = {
        name: df.select(*HOUR_KEYS, name).where(F.col(name).isNotNull()).distinct()
        for name, df in channels.items()
    }
    return combine_channels(cleaned, HOUR_KEYS)


# --- regressions --------------------------------------------------------------------------------


def encoded(nominal: Sequence[str], keep_unknown: bool = True) -> tuple[list, list[str]]:
    """Index and one-hot stages; the last level is dropped, unseen levels become all zeros."""
    if not nominal:
        return [], []
    indexed = [f"{c}_index" for c in nominal]
    vectors = [f"{c}_vector" for c in nominal]
    handle = "keep" if keep_unknown else "error"
    return [
        StringIndexer(inputCols=list(nominal), outputCols=indexed, handleInvalid=handle),
        OneHotEncoder(inputCols=indexed, outputCols=vectors, dropLast=True, handleInvalid=handle),
    ], vectors


def elastic_net_pipeline(
    numeric: Sequence[str], nominal: Sequence[str], target: str
) -> tuple[Pipeline, LinearRegression]:
    """Encode, impute medians, standardise, drop constant columns, fit."""
    filled = [f"{c}_filled" for c in numeric]
    encode, vectors = encoded(nominal)
    regression = LinearRegression(
        featuresCol="features", labelCol=target, predictionCol="prediction", maxIter=100,
        standardization=False,
    )
    stages = [
        *encode,
        Imputer(strategy="median", inputCols=list(numeric), outputCols=filled),
        VectorAssembler(inputCols=[*filled, *vectors], outputCol="raw_features"),
        StandardScaler(
            inputCol="raw_features", outputCol="scaled_features", withMean=True, withStd=True
        ),
        VarianceThresholdSelector(
            featuresCol="scaled_features", outputCol="features", varianceThreshold=0.0
        ),
        regression,
    ]
    return Pipeline(stages=stages), regression


def penalty_grid(levels: int = 6) -> list[tuple[float, float]]:
    """Penalty 1e-4 .. 1 (log spaced) by mixture 0 .. 1."""
    return [
        (float(penalty), float(mixture))
        for penalty in np.logspace(-4, 0, levels)
        for mixture in np.linspace(0.0, 1.0, levels)
    ]


def _cross_validate(
    train: DataFrame, pipeline: Pipeline, maps: list[dict], target: str, day: str, folds: int,
    parallelism: int,
) -> CrossValidatorModel:
    folded = cut_lineage(train.withColumn("_fold", day_fold(day, folds)))
    validator = CrossValidator(
        estimator=pipeline,
        estimatorParamMaps=maps,
        evaluator=RegressionEvaluator(labelCol=target, metricName="rmse"),
        numFolds=folds,
        foldCol="_fold",
        parallelism=parallelism,
    )
    return validator.fit(folded)


def fit_elastic_net(
    train: DataFrame,
    numeric: Sequence[str],
    nominal: Sequence[str],
    target: str,
    grid: Sequence[tuple[float, float]] | None = None,
    folds: int = 5,
    day: str = "date",
    parallelism: int = 4,
) -> CrossValidatorModel:
    """Elastic net tuned over (penalty, mixture) with folds of whole days."""
    pipeline, regression = elastic_net_pipeline(numeric, nominal, target)
    maps = [
        {regression.regParam: penalty, regression.elasticNetParam: mixture}
        for penalty, mixture in (grid or penalty_grid())
    ]
    return _cross_validate(train, pipeline, maps, target, day, folds, parallelism)


def space_filling_grid(n: int, seed: int = 123) -> list[dict[str, float]]:
    """Latin hypercube over depth, step, minimum gain, row share and column share."""
    rng = np.random.default_rng(seed)
    cells = np.column_stack([rng.permutation(n) for _ in range(5)])
    unit = (cells + 0.5) / n
    return [
        {
            "maxDepth": int(2 + round(6 * u[0])),
            "stepSize": float(10 ** (-2.5 + 2.0 * u[1])),
            "minInfoGain": float(10 ** (-8 + 7 * u[2])),
            "subsamplingRate": float(0.5 + 0.5 * u[3]),
            "featureSubsetStrategy": float(0.4 + 0.6 * u[4]),
        }
        for u in unit
    ]


def fit_boosted_trees(
    train: DataFrame,
    numeric: Sequence[str],
    nominal: Sequence[str],
    target: str,
    grid: Sequence[Mapping[str, object]] | None = None,
    trees: int = 1000,
    folds: int = 5,
    day: str = "date",
) -> TunedTrees:
    """Boosted trees tuned with folds of whole days; missing predictors go to the better side of a split."""
    return tune_boosted_trees(
        train, numeric, nominal, target, grid or space_filling_grid(25), trees, folds, day
    )


def imputation_grid(n: int = 8, seed: int = 123) -> list[dict[str, object]]:
    """Random draws (without repeats) from the search space of the gap-filling models."""
    space = [
        {
            "maxDepth": depth,
            "stepSize": step,
            "subsamplingRate": rows,
            "featureSubsetStrategy": columns,
            "minInstancesPerNode": leaf,
        }
        for depth in (3, 5, 7)
        for step in (0.03, 0.1)
        for rows in (0.8, 1.0)
        for columns in (0.8, 1.0)
        for leaf in (1, 5)
    ]
    picks = np.random.default_rng(seed).choice(len(space), size=min(n, len(space)), replace=False)
    return [space[i] for i in picks]


def predict_with(
    df: DataFrame, models: Mapping[str, PipelineModel | BoostedModel], numeric: Sequence[str]
) -> DataFrame:
    """Predictions of several models side by side, clamped at zero."""
    out = df.withColumns({c: F.col(c).cast("double") for c in numeric})
    for name, model in models.items():
        scored = model.transform(out)
        out = scored.select(*out.columns, clamp_at_zero("prediction").alias(name))
    return out


def top_importances(
    spark: SparkSession, model: BoostedModel, n: int = 20, without: str | None = None
) -> DataFrame:
    """Largest feature importances with their names; unused features are left out."""
    rows = [(name, share) for name, share in model.importances().items() if share > 0]
    table = spark.createDataFrame(rows, "feature string, importance double")
    kept = table if without is None else table.where(~F.col("feature").startswith(without))
    return kept.orderBy(F.desc("importance"), "feature").limit(n)


def compare_models(
    df: DataFrame, observed: str, predictions: Mapping[str, str], keys: Sequence[str] = ()
) -> DataFrame:
    """Error metrics of several prediction columns, one row per model, in one grouped pass."""
    stacked = df.select(
        *keys,
        F.col(observed).alias("_observed"),
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(label).alias("model"), F.col(c).alias("_predicted"))
                    for label, c in predictions.items()
                ]
            )
        ).alias("_m"),
    ).select(*keys, "_observed", "_m.*")
    metrics = error_metrics(stacked, "_observed", "_predicted", [*keys, "model"])
    return metrics.select(*keys, "model", "rmse", "mae", "r2")


def independent_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """The columns that are no constant and no linear function of the ones before them.

    Found on the covariances, which one pass over the rows gives.
    """
    names = list(columns)
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1)]
    row = df.agg(
        *[F.avg(c) for c in names], *[F.covar_pop(names[i], names[j]) for i, j in pairs]
    ).first()
    if row[0] is None:
        return []
    means, covariance = np.array(row[: len(names)]), np.zeros((len(names), len(names)))
    for (i, j), value in zip(pairs, row[len(names) :]):
        covariance[i, j] = covariance[j, i] = value
    spread = np.sqrt(np.diag(covariance))
    kept: list[int] = []
    for i in range(len(names)):
        if not spread[i] > 1e-7 * abs(means[i]):
            continue
        correlation = covariance[np.ix_([*kept, i], [*kept, i])] / np.outer(
            spread[[*kept, i]], spread[[*kept, i]]
        )
        cross = correlation[:-1, -1]
        explained = cross @ np.linalg.solve(correlation[:-1, :-1], cross)
        if 1 - explained > 1e-12:
            kept.append(i)
    return [names[i] for i in kept]


def log_linear_fit(df: DataFrame, target: str, predictors: Mapping[str, Column]) -> DataFrame:
    """log(target) on the given columns by least squares, with standard errors and p-values.

    Predictors that are constant or depend on the ones before them have no coefficient of their
    own: they are left out of the fit and their row is null, as in R's ``lm``. Errors and p-values
    are null where no rows are left to estimate them from or the target does not vary.
    """
    # the rows are read three times: find them once
    ready = settle(
        df.where(F.col(target) > 0).select(
            F.log(target).alias("_y"), *[c.cast("double").alias(n) for n, c in predictors.items()]
        ).dropna()
    )
    names = independent_columns(ready, list(predictors))
    n, mean, sd = ready.agg(F.count("_y"), F.avg("_y"), F.stddev_samp("_y")).first()
    found: dict[str, tuple] = {}
    r2 = None
    if names:
        assembled = VectorAssembler(inputCols=names, outputCol="features").transform(ready)
        fit = LinearRegression(
            featuresCol="features", labelCol="_y", solver="normal", standardization=False
        ).fit(assembled)
        terms, estimates = [*names, "(intercept)"], [*map(float, fit.coefficients), float(fit.intercept)]
        if n > len(terms) and sd > 0:
            summary = fit.summary
            errors = zip(summary.coefficientStandardErrors, summary.tValues, summary.pValues)
            found = {term: (e, *rest) for term, e, rest in zip(terms, estimates, errors)}
        else:
            found = {term: (e, None, None, None) for term, e in zip(terms, estimates)}
        r2 = float(fit.summary.r2) if sd > 0 else None
    elif n > 1 and sd > 0:
        error = sd / math.sqrt(n)
        found, r2 = {"(intercept)": (mean, error, mean / error, t_two_sided(mean / error, n - 1))}, 0.0
    elif n:
        found = {"(intercept)": (mean, None, None, None)}
    rows = [
        (term, *found.get(term, (None, None, None, None)), r2) for term in [*predictors, "(intercept)"]
    ]
    return df.sparkSession.createDataFrame(
        rows,
        "term string, estimate double, std_error double, t double, p_value double, r2 double",
    )


# --- Gaussian mixture regression ----------------------------------------------------------------


def fit_mixture(
    df: DataFrame, columns: Sequence[str], k: int, seed: int = 11, max_iter: int = ROUNDS
) -> Mixture:
    """Mixture over the joint vector of predictors and target."""
    return fit_mixtures(df, columns, [k], seed=seed, max_rounds=max_iter)[k].mixture


def mixture_bic_sweep(
    df: DataFrame, columns: Sequence[str], sizes: Sequence[int], seed: int = 2, max_iter: int = ROUNDS
) -> DataFrame:
    """Bayesian information criterion of mixtures of several sizes, all fitted in the same rounds."""
    fits = fit_mixtures(df, columns, sizes, seed=seed, max_rounds=max_iter)
    rows = [(k, fits[k].log_likelihood, fits[k].bic) for k in sizes]
    return df.sparkSession.createDataFrame(rows, "k int, log_likelihood double, bic double")


def mixture_table(spark: SparkSession, mixture: Mixture) -> DataFrame:
    return spark.createDataFrame(
        mixture.rows(),
        "component int, weight double, mean array<double>, covariance array<double>",
    ).withColumn("columns", F.array(*[F.lit(c) for c in mixture.columns]))


def mixture_from_table(df: DataFrame) -> Mixture:
    rows = df.collect()
    return Mixture.from_rows(
        rows[0]["columns"],
        [(r["component"], r["weight"], r["mean"], r["covariance"]) for r in rows],
    )


def apply_mixture(
    df: DataFrame,
    mixture: Mixture,
    target: str,
    names: Sequence[str],
    raw: str = "mod_pm25",
    label: str = "pm25_fem_gmr",
) -> DataFrame:
    """Calibrated value, its change and ratio; rows without all predictors stay null."""
    predicted = clamp_at_zero(conditional_mean(mixture, target, names))
    return df.withColumn(label, predicted).withColumns(
        {
            "delta_gmr": F.col(label) - F.col(raw),
            "ratio_gmr": guarded_ratio(label, raw),
        }
    )


def apply_mixture_with_gaps(
    df: DataFrame,
    mixture: Mixture,
    target: str,
    required: Sequence[str],
    optional: Sequence[str],
    label: str = "pm25_fem_gmr",
) -> DataFrame:
    return df.withColumn(label, conditional_mean_with_gaps(mixture, target, required, optional))


def component_bias(
    df: DataFrame, mixture: Mixture, raw: str, target: str, predicted: str | None = None
) -> DataFrame:
    """Rows, certainty and bias by most likely component of the joint mixture."""
    names = list(mixture.columns)
    shares = responsibilities(mixture, names)
    certainty = F.greatest(*shares) if len(shares) > 1 else shares[0]
    measures = [F.avg(F.col(raw) - F.col(target)).alias("mean_raw_bias")]
    if predicted is not None:
        measures.append(F.avg(F.col(predicted) - F.col(target)).alias("mean_model_bias"))
    return (
        df.dropna(subset=names)
        .withColumns({"component": hard_label(mixture, names), "_certainty": certainty})
        .groupBy("component")
        .agg(F.count(F.lit(1)).alias("n"), F.avg("_certainty").alias("mean_certainty"), *measures)
    )
