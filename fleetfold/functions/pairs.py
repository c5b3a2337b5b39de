"""Sums over pairs of monitors, taken inside tasks on Arrow batches."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

# executors get these functions by value and need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

TILE = 512  # monitors of one side of a block of pairs
CELLS_AT_ONCE = 4_000_000
KEYS = ("tile_x", "tile_y", "measure")
SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")
PAIR_SCHEMA = "measure int, x int, y int, " + ", ".join(f"{s} double" for s in SUMS)


def _steps(rows: dict[str, np.ndarray], tile: int, size: int, first: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
    """(steps, monitors) of readings of one tile, zeros where there is none, and where there is one."""
    values, here = np.zeros((stop - first, size)), np.zeros((stop - first, size))
    mine = (rows["at"] >= first) & (rows["at"] < stop) & (rows["monitor"] // size == tile)
    at, column = rows["at"][mine] - first, rows["monitor"][mine] % size
    values[at, column], here[at, column] = rows["v"][mine], 1.0
    return values, here


def _add(total: np.ndarray, rows: dict[str, np.ndarray], tiles: tuple[int, int], size: int) -> None:
    """Add the sums of whole time steps to (6, size, size)."""
    step = rows["step"]
    rows = rows | {"at": np.cumsum(np.r_[False, step[1:] != step[:-1]])}
    steps, chunk = int(rows["at"][-1]) + 1, max(1, CELLS_AT_ONCE // size)
    for first in range(0, steps, chunk):
        stop = min(steps, first + chunk)
        x, in_x = _steps(rows, tiles[0], size, first, stop)
        y, in_y = (x, in_x) if tiles[0] == tiles[1] else _steps(rows, tiles[1], size, first, stop)
        for k, (a, b) in enumerate(((in_x, in_y), (x, in_y), (in_x, y), (x * x, in_y), (in_x, y * y), (x, y))):
            total[k] += a.T @ b


def _given(total: np.ndarray, key: tuple[int, int, int], size: int) -> pa.RecordBatch:
    """The pairs of a block that share a time step; of pairs of one tile the upper half."""
    common = total[0] > 0
    at_x, at_y = np.nonzero(np.triu(common) if key[0] == key[1] else common)
    names = [np.full(len(at_x), key[2]), key[0] * size + at_x, key[1] * size + at_y]
    columns = [pa.array(c.astype(np.int32)) for c in names] + [pa.array(t[at_x, at_y]) for t in total]
    return pa.RecordBatch.from_arrays(columns, ["measure", "x", "y", *SUMS])


def pair_sums(size: int):
    """Task function: sums of every pair of monitors over their common steps, given once per block of pairs.

    Rows (tile_x, tile_y, measure, step, monitor, v) come sorted by block and step, and a step lies in one
    task. Memory is six numbers per pair of a block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] | None = None
        key, total = None, None
        for batch in _with_end(batches):
            if batch is not None:
                rows = {n: batch.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(batch.schema.names)}
                rows = rows if held is None else {n: np.concatenate([held[n], c]) for n, c in rows.items()}
            else:
                rows = held
            if rows is None or not len(rows["step"]):
                held = rows
                continue
            change = np.zeros(len(rows["step"]), dtype=bool)
            for name in KEYS:
                change[1:] |= rows[name][1:] != rows[name][:-1]
            new_step = change.copy()
            new_step[1:] |= rows["step"][1:] != rows["step"][:-1]
            # the last step may go on in the next batch
            cut = len(change) if batch is None else int(np.flatnonzero(np.r_[True, new_step[1:]])[-1])
            held = {n: c[cut:] for n, c in rows.items()}
            bounds = [0, *np.flatnonzero(change[:cut]).tolist(), cut]
            for first, stop in zip(bounds, bounds[1:]):
                if first == stop:
                    continue
                some = {n: c[first:stop] for n, c in rows.items()}
                now = tuple(int(some[n][0]) for n in KEYS)
                if now != key:
                    if key is not None:
                        yield _given(total, key, size)
                    key, total = now, np.zeros((len(SUMS), size, size))
                _add(total, some, now[:2], size)
        if key is not None:
            yield _given(total, key, size)

    return run


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None
