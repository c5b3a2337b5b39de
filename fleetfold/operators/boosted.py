"""Boosted regression trees tuned over a whole grid, all candidates and folds at once.

Rows are binned once and dealt by a digest into blocks of bounded size. Every (candidate, fold, block)
is one group that a task grows on its own, so the tuning is one shuffle of narrow rows and as many
tasks as there are groups; no row is left out and none waits for another round. Errors are summed over
the blocks. The model is the mean of the blocks' models; data within one block gives the usual single one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetfold.functions.boosting import Trees, bin_columns, boost, chunks
from fleetfold.operators.ordering import day_fold
from fleetfold.session import settle

# rows of a group; bins of a number, the one of missing values besides; levels of a text
BLOCK_ROWS, BINS, MOST_LEVELS = 1 << 17, 64, 255
ROWS_AT_ONCE = 8192
PATIENCE = 50  # trees without a lower held-out error after which a fold ends


@dataclass(frozen=True)
class Binning:
    """Where numbers are cut and which texts have a feature of their own."""

    numeric: tuple[str, ...]
    edges: tuple[np.ndarray, ...]
    nominal: tuple[str, ...]
    levels: tuple[tuple[str, ...], ...]

    @property
    def features(self) -> list[str]:
        return [*self.numeric, *(f"{c}_{v}" for c, known in zip(self.nominal, self.levels) for v in known)]


def find_binning(df: DataFrame, numeric: Sequence[str], nominal: Sequence[str], bins: int = BINS) -> Binning:
    """Edges at quantiles of each number, all in one aggregation; every value is an edge if there are few.

    NaN counts as missing. A text with more than 255 levels is an error.
    """
    shares = F.array(*(F.lit(i / bins) for i in range(1, bins)))
    number = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in numeric}
    sampled = [F.percentile_approx(x, shares, 10_000).alias(f"q{i}") for i, x in enumerate(number.values())]
    several = [F.approx_count_distinct(x, 0.02).alias(f"n{i}") for i, x in enumerate(number.values())]
    row = df.agg(F.count(F.lit(1)).alias("n"), *sampled, *several).first()
    edges = []
    for i, x in enumerate(number.values()):
        cuts = row[f"q{i}"] or []
        if row[f"n{i}"] <= bins * 0.9:
            found = df.where(x.isNotNull()).select(x.alias("v")).distinct().orderBy("v").limit(bins + 1).collect()
            cuts = [r.v for r in found][:-1] if len(found) <= bins else cuts
        edges.append(np.unique(np.array(cuts, dtype=np.float64)))
    levels = []
    for c in nominal:
        found = df.where(F.col(c).isNotNull()).select(F.col(c).cast("string").alias("v")).distinct().orderBy("v").limit(MOST_LEVELS + 1).collect()
        if len(found) > MOST_LEVELS:
            raise ValueError(f"column {c} has more than {MOST_LEVELS} levels")
        levels.append(tuple(r.v for r in found))
    return Binning(tuple(numeric), tuple(edges), tuple(nominal), tuple(levels))


def _bins_of(batch: pa.RecordBatch, binning: Binning) -> np.ndarray:
    named = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
    numbers = [named[f"__n{i}"].to_numpy(zero_copy_only=False).astype(np.float64) for i in range(len(binning.numeric))]
    texts = [named[f"__t{i}"].to_pylist() for i in range(len(binning.nominal))]
    return bin_columns(numbers, list(binning.edges), texts, [list(k) for k in binning.levels])


def _inputs(binning: Binning) -> list:
    numbers = [F.col(c).cast("double").alias(f"__n{i}") for i, c in enumerate(binning.numeric)]
    return numbers + [F.col(c).cast("string").alias(f"__t{i}") for i, c in enumerate(binning.nominal)]


def binned_rows(df: DataFrame, binning: Binning, target: str, fold) -> DataFrame:
    """(y, fold, bins): one byte per feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r.tobytes() for r in _bins_of(batch, binning)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.binary())], ["y", "fold", "bins"])

    picked = df.select(F.col(target).cast("double").alias("y"), fold.cast("int").alias("fold"), *_inputs(binning))
    return picked.mapInArrow(run, "y double, fold int, bins binary")


@dataclass(frozen=True)
class BoostedModel:
    """The mean of the models of all blocks. Its size is trees x nodes per block of ``BLOCK_ROWS`` rows."""

    binning: Binning
    blocks: tuple[Trees, ...]
    point: Mapping[str, float]

    def transform(self, df: DataFrame, prediction: str = "prediction") -> DataFrame:
        """``df`` with ``prediction``; unknown levels and missing values are allowed."""
        names, binning = df.columns, self.binning
        shared = df.sparkSession.sparkContext.broadcast(self.blocks)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for some in chunks(batch.num_rows, ROWS_AT_ONCE):
                    rows = batch.slice(some.start, some.stop - some.start)
                    bins = _bins_of(rows, binning)
                    mean = sum(block.predict(bins) for block in shared.value) / max(1, len(shared.value))
                    yield pa.RecordBatch.from_arrays([*rows.columns[: len(names)], pa.array(np.broadcast_to(mean, len(bins)))], [*names, prediction])

        fields = [*df.schema.fields, T.StructField(prediction, T.DoubleType())]
        return df.select("*", *_inputs(binning)).mapInArrow(run, T.StructType(fields))

    def importances(self) -> dict[str, float]:
        """Share of each feature in the squared error that all splits took away."""
        total = np.zeros(len(self.binning.features))
        for block in self.blocks:
            inner = block.feature >= 0
            total += np.bincount(block.feature[inner], block.gain[inner], len(total))
        return dict(zip(self.binning.features, (total / max(total.sum(), 1e-300)).tolist()))


@dataclass(frozen=True)
class TunedTrees:
    bestModel: BoostedModel
    errors: list[float]  # mean over the folds of the held-out root mean squared error, per candidate
    candidates: list[Mapping[str, float]]


def _bins_matrix(bins: pd.Series, features: int) -> np.ndarray:
    return np.frombuffer(b"".join(bins), dtype=np.uint8).reshape(-1, features)


def _dealt(rows: DataFrame, blocks: int) -> DataFrame:
    """Rows with the block they belong to: a digest of the row, so reruns agree."""
    return rows.withColumn("block", F.pmod(F.xxhash64("y", "fold", "bins"), F.lit(blocks)).cast("int"))


def _held_out_errors(
    dealt: DataFrame, grid: Sequence[Mapping[str, float]], folds: int, trees: int, seed: int, features: int, groups: int, patience: int | None
) -> list[tuple[float, int]]:
    """Per candidate: mean over the folds of the held-out error, and the trees that gave it."""
    points = [dict(p) for p in grid]

    def fit(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        candidate, fold, block = (int(k) for k in key)
        group = group.sort_values(["y", "bins"], kind="stable")
        held_out = group["held_out"].to_numpy()
        y = group["y"].to_numpy()
        model, prediction = boost(_bins_matrix(group["bins"], features), y, ~held_out, points[candidate], trees, seed + block, patience)
        error, n = float(np.square(prediction - y)[held_out].sum()), int(held_out.sum())
        return pd.DataFrame({"candidate": [candidate], "fold_out": [fold], "n": [n], "sse": [error], "grown": [n * len(model.feature)]})

    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("candidate"), F.lit(k).alias("fold_out")) for c in range(len(points)) for k in range(folds))))
    spread = dealt.select("block", "y", "bins", "fold", pairs.alias("p")).select("block", "y", "bins", "p.*", (F.col("fold") == F.col("p.fold_out")).alias("held_out"))
    keys = ["candidate", "fold_out", "block"]
    # more partitions than groups, so that a group rarely shares its task with another one
    parts = spread.repartition(4 * groups, *keys).groupBy(*keys).applyInPandas(fit, "candidate int, fold_out int, n bigint, sse double, grown bigint")
    by_fold = parts.groupBy("candidate", "fold_out").agg(*(F.sum(c).alias(c) for c in ("n", "sse", "grown"))).where("n > 0")
    rmse, grown = F.avg(F.sqrt(F.col("sse") / F.col("n"))).alias("rmse"), (F.sum("grown") / F.sum("n")).alias("grown")
    found = {r.candidate: (r.rmse, max(1, round(r.grown))) for r in by_fold.groupBy("candidate").agg(rmse, grown).collect()}
    return [found.get(c, (math.nan, trees)) for c in range(len(points))]


def _fit_blocks(dealt: DataFrame, point: Mapping[str, float], trees: int, seed: int, features: int, blocks: int) -> tuple[Trees, ...]:
    kinds = {"feature": np.int16, "threshold": np.uint8, "missing_left": np.bool_, "value": np.float64, "gain": np.float64}

    def fit(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["y", "bins"], kind="stable")
        bins = _bins_matrix(group["bins"], features)
        model, _ = boost(bins, group["y"].to_numpy(), np.ones(len(group), dtype=bool), point, trees, seed + int(key[0]))
        columns = {name: [getattr(model, name).astype(kind).tobytes()] for name, kind in kinds.items()}
        return pd.DataFrame({"block": [int(key[0])], "base": [model.base], "nodes": [model.feature.shape[1]]} | columns)

    schema = "block int, base double, nodes int, " + ", ".join(f"{name} binary" for name in kinds)
    rows = dealt.select("block", "y", "bins").repartition(4 * blocks, "block").groupBy("block").applyInPandas(fit, schema).collect()
    return tuple(
        Trees(r.base, *(np.frombuffer(r[name], dtype=kind).reshape(-1, r.nodes) for name, kind in kinds.items())) for r in sorted(rows, key=lambda r: r.block)
    )


def tune_boosted_trees(
    train: DataFrame,
    numeric: Sequence[str],
    nominal: Sequence[str],
    target: str,
    grid: Sequence[Mapping[str, float]],
    trees: int,
    folds: int,
    day: str = "date",
    seed: int = 123,
    block_rows: int = BLOCK_ROWS,
    patience: int | None = PATIENCE,
) -> TunedTrees:
    """The candidate with the least held-out error over folds of whole days, fitted on all rows.

    ``trees`` is the most of each candidate: a fold ends once ``patience`` trees have not lowered its held-out
    error, and the final fit has as many trees as the folds needed on average (None: always ``trees``).
    Rows without a target are left out; no row at all is an error. Rows of a null day train in every fold.
    Of equal errors the first candidate wins. A single candidate is fitted without folds.
    """
    known = train.where(F.col(target).isNotNull() & ~F.isnan(F.col(target).cast("double")))
    binning = find_binning(known, numeric, nominal)
    rows = settle(binned_rows(known, binning, target, day_fold(day, folds)))
    n = rows.count()
    if n == 0:
        raise ValueError(f"no row with a value in {target}")
    blocks = -(-n // block_rows)
    dealt, features = _dealt(rows, blocks), len(binning.features)
    found = [(math.nan, trees)]
    if len(grid) > 1:
        found = _held_out_errors(dealt, grid, folds, trees, seed, features, len(grid) * folds * blocks, patience)
    best = min(range(len(grid)), key=lambda c: (math.isnan(found[c][0]), found[c][0], c))
    kept = trees if patience is None else found[best][1]
    model = BoostedModel(binning, _fit_blocks(dealt, grid[best], kept, seed, features, blocks), grid[best])
    return TunedTrees(model, [error for error, _ in found], list(grid))
