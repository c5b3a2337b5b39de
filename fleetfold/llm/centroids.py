"""Centroid clustering of integer vectors with a progressive Walsh-Hadamard search.

The transform keeps squared distances up to the factor of the vector length, and in the order of the
number of sign changes its first coefficients tell the coarse shape. Differences of coefficients are
summed coarse to fine; the sum so far is a lower bound, so a centroid whose sum is strictly above the
finished sum of another one is out. Those left over are summed to the end. All numbers are integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetfold.llm.common import stored

SIZE, CLUSTERS, ROUNDS, SCALE = 64, 16, 3, 64
LEVELS = (4, 16, 64)  # coefficients summed after each step
ROWS_AT_ONCE = 4096
# components within this bound keep 64 squared differences of the transform below 2^63
LARGEST = 1 << 24


def transform(vectors: np.ndarray) -> np.ndarray:
    """Exact Walsh-Hadamard transform of the rows, coefficients by their number of sign changes."""
    n = vectors.shape[1]
    out, half = vectors.astype(np.int64), 1
    while half < n:
        pairs = out.reshape(len(out), -1, 2, half)
        out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(out), n)
        half *= 2
    bits = n.bit_length() - 1
    gray = [k ^ (k >> 1) for k in range(n)]
    return out[:, [int(f"{g:0{bits}b}"[::-1], 2) for g in gray]]


def nearest(vectors: np.ndarray, centroids: np.ndarray, levels=LEVELS) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, squared distance) of each vector; of equal distances the smaller number."""
    moved, aims = transform(vectors), transform(centroids)
    n, size = moved.shape
    row, aim = (x.ravel() for x in np.divmod(np.arange(n * len(aims)), len(aims)))
    total, first = np.zeros(len(row), dtype=np.int64), 0
    for level in levels:
        total += np.square(moved[row, first:level] - aims[aim, first:level]).sum(axis=1)
        first = level
        if level < size:
            # the least sum so far is finished; what is already strictly above the finished sum is out
            order = np.lexsort((aim, total, row))
            best = order[np.unique(row[order], return_index=True)[1]]
            finished = total[best] + np.square(moved[row[best], first:] - aims[aim[best], first:]).sum(axis=1)
            left = total <= finished[row]
            row, aim, total = row[left], aim[left], total[left]
    order = np.lexsort((aim, total, row))
    best = order[np.unique(row[order], return_index=True)[1]]
    return aim[best], total[best] // size


def integer_vectors(vectors: DataFrame, vector: str = "embedding", size: int = SIZE, scale: int = SCALE, name: str = "components") -> DataFrame:
    """Rows of ``vectors`` with ``size`` finite components, and ``name``, the integers floor(scale * component)."""
    x = F.col(f"`{vector}`").cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    kept = vectors.where((F.size(x) == size) & finite)
    exact = F.forall(x, lambda v: F.abs(v * scale) <= LARGEST - 1)
    whole = F.transform(x, lambda v: F.floor(v * scale).cast("long"))
    return kept.withColumn(name, F.when(exact, whole).otherwise(F.raise_error(F.lit("a component is beyond the range of exact sums"))))


def _matrix(lists: pa.ListArray, size: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _sums(chosen: DataFrame, centroids: np.ndarray) -> list:
    """(cluster, component, sum, count): every task adds up its own vectors first."""
    k, size = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, size), dtype=np.int64), np.zeros(k, dtype=np.int64)
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS_AT_ONCE):
                some = _matrix(batch.column(0).slice(first, ROWS_AT_ONCE), size)
                to = nearest(some, centroids)[0]
                np.add.at(sums, to, some)
                counts += np.bincount(to, minlength=k)
        cluster, component = np.divmod(np.arange(k * size), size)
        columns = cluster, component, sums.ravel(), np.repeat(counts, size)
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["cluster", "component", "sum", "n"])

    parts = chosen.select("components").mapInArrow(run, "cluster bigint, component bigint, sum bigint, n bigint")
    # exact at any number of rows; the result has clusters x size rows
    return parts.groupBy("cluster", "component").agg(F.sum(F.col("sum").cast("decimal(38,0)")).alias("sum"), F.sum("n").alias("n")).collect()


def _assigned(chosen: DataFrame, centroids: np.ndarray) -> DataFrame:
    size = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS_AT_ONCE):
                rows = batch.slice(first, ROWS_AT_ONCE)
                cluster, distance = nearest(_matrix(rows.column(rows.num_columns - 1), size), centroids)
                added = [pa.array(cluster.astype(np.int32)), pa.array(distance)]
                yield pa.RecordBatch.from_arrays([*rows.columns, *added], [*rows.schema.names, "cluster", "distance"])

    fields = [*chosen.schema.fields, T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())]
    return chosen.mapInArrow(run, T.StructType(fields))


def start_order(key: Column) -> list[Column]:
    """Order from which the first centroids are taken: a digest of the key, then the components."""
    return [F.sha2(F.concat(F.lit("1:"), key.cast("string")), 256).asc_nulls_last(), F.col("components")]


def walsh_clusters(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", size: int = SIZE, clusters: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE
) -> tuple[DataFrame, DataFrame]:
    """(members, centroids) after ``rounds`` rounds of assigning and averaging and a last assignment.

    ``members``: ``key``, components, cluster and squared distance of every vector kept; vectors that are null,
    of another length, or hold a null or non-finite component are left out. ``centroids``: cluster, centroid,
    n, inertia and the inertia of all, also of empty clusters. Repeated rows are vectors of their own, null keys start no cluster
    while others are left, fewer vectors than ``clusters`` start fewer. Empty input gives two empty tables.
    Other columns are not looked at. No vector is shuffled; a round sends clusters x size sums per task.
    """
    if size & (size - 1):
        raise ValueError("the transform needs a power of two")
    chosen = stored(integer_vectors(vectors, vector, size, scale).select(F.col(f"`{key}`").alias("key"), "components"))
    starts = chosen.orderBy(*start_order(F.col("key"))).limit(clusters).select("components").collect()
    spark = vectors.sparkSession
    shapes = "cluster int, centroid array<bigint>, n bigint, inertia decimal(38,0), total decimal(38,0)"
    if not starts:
        none = chosen.select(F.col("key").alias(key), "components", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
        return none, spark.createDataFrame([], shapes)
    centroids = np.array([r.components for r in starts], dtype=np.int64)
    for _ in range(rounds):
        for r in _sums(chosen, centroids):
            if r.n:
                centroids[r.cluster, r.component] = int(r.sum) // r.n
    members = stored(_assigned(chosen, centroids).withColumnRenamed("key", key))
    found = {r.cluster: r for r in members.groupBy("cluster").agg(F.count("*").alias("n"), F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia")).collect()}
    total = sum(r.inertia for r in found.values())
    rows = [(i, c.tolist(), found[i].n if i in found else 0, found[i].inertia if i in found else Decimal(0), total) for i, c in enumerate(centroids)]
    return members, spark.createDataFrame(rows, shapes)
