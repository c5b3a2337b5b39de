"""Growing and evaluating boosted regression trees on one block of binned rows, inside tasks.

A row holds one bin per feature: 0 for a missing value, then 1, 2, ... in the order of the values.
A tree is a heap of nodes; a node sends bins up to its threshold to the left and missing values to the
side that gains more.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
from pyspark import cloudpickle

# executors get these functions by value and need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

LEAF = -1


@dataclass
class Trees:
    """Heaps of the trees of one block: arrays of (trees, nodes)."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    missing_left: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    def predict(self, bins: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(bins), self.base), np.arange(len(bins))
        for feature, threshold, missing_left, value in zip(self.feature, self.threshold, self.missing_left, self.value):
            node = np.zeros(len(bins), dtype=np.int64)
            while True:
                f = feature[node]
                inner = f != LEAF
                if not inner.any():
                    break
                bin_of = bins[rows, np.maximum(f, 0)]
                right = np.where(bin_of == 0, ~missing_left[node], bin_of > threshold[node])
                node = np.where(inner, 2 * node + 1 + right, node)
            total += value[node]
        return total


def histograms(flat: np.ndarray, slot: np.ndarray, residual: np.ndarray, slots: int, features: int, bins: int):
    """Sums of residuals and counts by (slot, feature, bin)."""
    width = features * bins
    keys = (flat + (slot * width)[:, None]).ravel()
    sums = np.bincount(keys, np.repeat(residual, features), slots * width)
    counts = np.bincount(keys, minlength=slots * width)
    return sums.reshape(slots, features, bins), counts.reshape(slots, features, bins)


def best_splits(sums: np.ndarray, counts: np.ndarray, least_rows: int):
    """Per slot: gain in squared error, feature, threshold bin and side of missing values.

    Cuts behind bins without rows are the same as earlier cuts and not looked at.
    """
    slots, _, bins = sums.shape
    total, n = sums[:, 0].sum(axis=1), counts[:, 0].sum(axis=1)
    at = np.flatnonzero(counts)
    slot, feature = at // (sums.shape[1] * bins), at // bins
    first = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
    left, left_n = np.cumsum(sums, axis=2).ravel()[at], np.cumsum(counts, axis=2).ravel()[at]
    sides = [(left, left_n, True)]
    if counts[:, :, 0].any():
        sides.append((left - sums[:, :, 0].ravel()[feature], left_n - counts[:, :, 0].ravel()[feature], False))
    best = None
    for side, side_n, missing_left in sides:
        other_n = n[slot] - side_n
        gain = side * side / np.maximum(side_n, 1) + (total[slot] - side) ** 2 / np.maximum(other_n, 1)
        gain[(side_n < least_rows) | (other_n < least_rows)] = -np.inf
        most = np.maximum.reduceat(gain, first)
        where = np.flatnonzero(gain == most[slot])
        pick = where[np.unique(slot[where], return_index=True)[1]]
        now = [most - total * total / n, feature[pick] % sums.shape[1], at[pick] % bins, np.full(slots, missing_left)]
        best = now if best is None else [np.where(now[0] > best[0], a, b) for a, b in zip(now, best)]
    return best


def grow_tree(flat: np.ndarray, bins: np.ndarray, residual: np.ndarray, sample: np.ndarray, columns: np.ndarray, depth: int, least_gain: float, least_rows: int, width: int):
    """One tree on the rows of ``sample``; returns its heap and the node that every row ends in.

    ``flat``: bins shifted so that every feature has ``width`` keys of its own.
    """
    nodes = (2 << depth) - 1
    feature, threshold = np.full(nodes, LEAF, dtype=np.int16), np.zeros(nodes, dtype=np.uint8)
    missing_left, gains = np.zeros(nodes, dtype=bool), np.zeros(nodes)
    node, open_nodes = np.zeros(len(bins), dtype=np.int64), np.zeros(1, dtype=np.int64)
    chosen, keys, y = sample, flat[sample][:, columns], residual[sample]
    keys = keys + (np.arange(len(columns)) - columns) * width
    for _ in range(depth):
        counted = np.bincount(node[chosen], minlength=nodes)
        open_nodes = open_nodes[counted[open_nodes] >= max(2 * least_rows, 2)]
        if not len(open_nodes):
            break
        slot_of = np.full(nodes, -1, dtype=np.int64)
        slot_of[open_nodes] = np.arange(len(open_nodes))
        slot = slot_of[node[chosen]]
        if (slot < 0).any():
            live = slot >= 0
            chosen, keys, y, slot = chosen[live], keys[live], y[live], slot[live]
        sums, counts = histograms(keys, slot, y, len(open_nodes), len(columns), width)
        gain, at, cut, left = best_splits(sums, counts, least_rows)
        n = counts[:, 0].sum(axis=1)
        split = (gain > 1e-12) & (gain >= least_gain * n)
        if not split.any():
            break
        parents = open_nodes[split]
        feature[parents], threshold[parents] = columns[at[split].astype(np.int64)], cut[split]
        missing_left[parents], gains[parents] = left[split], gain[split]
        f = feature[node]
        moving = np.flatnonzero(f >= 0)
        # rows in nodes of earlier levels have moved on, so all that stand in an inner node move now
        here = node[moving]
        bin_of = bins[moving, f[moving]]
        right = np.where(bin_of == 0, ~missing_left[here], bin_of > threshold[here])
        node[moving] = 2 * here + 1 + right
        open_nodes = np.concatenate([2 * parents + 1, 2 * parents + 2])
    value = np.bincount(node[sample], residual[sample], nodes) / np.maximum(np.bincount(node[sample], minlength=nodes), 1)
    return feature, threshold, missing_left, value, gains, node


def boost(
    bins: np.ndarray, target: np.ndarray, training: np.ndarray, point: Mapping[str, float], trees: int, seed: int, patience: int | None = None
) -> tuple[Trees, np.ndarray]:
    """Boosted trees for squared error on the ``training`` rows, and the prediction of every row.

    With ``patience`` growing ends when that many trees in a row have not lowered the error of the other
    rows, and the trees after the least error are dropped.

    ``point``: maxDepth, stepSize, and as far as given minInfoGain (variance per row), subsamplingRate,
    featureSubsetStrategy (share of the features of each tree), minInstancesPerNode.
    """
    rng = np.random.default_rng(seed)
    rows, features = np.flatnonzero(training), bins.shape[1]
    width = int(bins.max(initial=0)) + 1
    flat = bins.astype(np.int64) + np.arange(features) * width
    base = float(target[rows].mean()) if len(rows) else 0.0
    prediction = np.full(len(bins), base)
    depth, step = int(point["maxDepth"]), float(point["stepSize"])
    share, columns_share = float(point.get("subsamplingRate", 1.0)), float(point.get("featureSubsetStrategy", 1.0))
    picked_columns = max(1, round(columns_share * features))
    heaps, held_out = [], np.flatnonzero(~training)
    watched = patience is not None and len(held_out) > 0
    least, best, kept = np.square(target - prediction)[held_out].sum(), prediction.copy(), 0
    for _ in range(trees if len(rows) else 0):
        sample = rows if share >= 1 else rng.choice(rows, max(1, round(share * len(rows))), replace=False, shuffle=False)
        columns = np.sort(rng.choice(features, picked_columns, replace=False))
        residual = target - prediction
        *heap, node = grow_tree(flat, bins, residual, sample, columns, depth, float(point.get("minInfoGain", 0.0)), int(point.get("minInstancesPerNode", 1)), width)
        heap[3] = heap[3] * step
        prediction += heap[3][node]
        heaps.append(heap)
        if watched:
            error = np.square(target - prediction)[held_out].sum()
            if error < least:
                least, best, kept = error, prediction.copy(), len(heaps)
            elif len(heaps) - kept >= patience:
                break
    if watched:
        heaps, prediction = heaps[:kept], best
    none = np.zeros((0, 1))
    stacked = [np.stack(x) for x in zip(*heaps)] if heaps else [none.astype(np.int16), none.astype(np.uint8), none.astype(bool), none, none]
    return Trees(base, *stacked), prediction


def bin_columns(columns: list[np.ndarray], edges: list[np.ndarray], nominal: list[list], levels: list[list[str]]) -> np.ndarray:
    """(rows, features) of bins: numbers by their edges, one feature of two bins per level of a text."""
    out = []
    for values, cuts in zip(columns, edges):
        missing = np.isnan(values)
        out.append(np.where(missing, 0, 1 + np.searchsorted(cuts, np.where(missing, 0.0, values), side="left")))
    for values, known in zip(nominal, levels):
        texts = np.array(["" if v is None else f"={v}" for v in values], dtype=object)
        out += [np.where(texts == f"={level}", 2, 1) for level in known]
    return np.stack(out, axis=1).astype(np.uint8)


def chunks(n: int, size: int) -> Iterator[slice]:
    for first in range(0, n, size):
        yield slice(first, min(n, first + size))
