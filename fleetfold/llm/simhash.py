"""SimHash near-duplicates through Gray-ordered hierarchical indexes.

Two fingerprints that differ in at most 4 of 64 bits agree in 2 of 6 blocks. So for each of the 15
pairs of blocks the bits are reordered with these blocks first and the fingerprints sorted by the Gray
rank of the result: what shares the leading blocks is one node of the index and stands together.
Within a node, runs of neighbours in Gray order share masked bit patterns, which form the upper levels;
a pair of runs is dropped as soon as the differences of its shared bits exceed the limit.
Nodes that grow large are cut into runs in Gray order, pruned pair by pair on their shared bits
before any fingerprint moves. A task returns links to the first member of each group it finds, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetfold.llm.common import distinct_rows, row_keys, stored
from fleetfold.llm.components import components
from fleetfold.llm.prefix import row_numbers

SHINGLE, SEED, DIFFERENCES = 4, 42, 4
BLOCKS = (11, 11, 11, 11, 10, 10)
RUN, NODE_LIMIT, FANOUT = 1024, 2048, 16
PAIR_CHUNK = 4096


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of the word shingles; zero without words."""
    words = text.lower().split()
    if not words:
        return 0
    plain = b" ".join(words)
    if len(words) <= shingle:
        digests = [xxhash.xxh64_intdigest(plain, SEED)]
    else:
        ends = list(accumulate(len(w) + 1 for w in words))
        digests = [xxhash.xxh64_intdigest(plain[a : b - 1], SEED) for a, b in zip([0, *ends], ends[shingle - 1 :])]
    bits = np.unpackbits(np.array(digests, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    majority = 2 * bits.sum(axis=0, dtype=np.int64) > len(digests)
    return int(np.packbits(majority, bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` columns and ``fp``, the fingerprint as a signed long; a null text counts as empty."""
    narrow = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).cast("binary").alias("fp_text"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t.as_py()) for t in batch.column(len(keep))], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(prints)], [*keep, "fp"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in narrow.schema[: len(keep)])
    return narrow.mapInArrow(task, f"{schema}, fp bigint")


def gray_rank(bits: np.ndarray) -> np.ndarray:
    """Position of each word in the Gray code sequence: every bit becomes the parity of those above it."""
    rank = bits.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def block_orders(blocks=BLOCKS, leading: int = 2) -> list[tuple[int, list[int]]]:
    """(leading bits, blocks in their new order) for every choice of leading blocks."""
    every = range(len(blocks))
    return [(sum(blocks[i] for i in first), [*first, *(i for i in every if i not in first)]) for first in combinations(every, leading)]


def reordered(prints: np.ndarray, order: list[int], blocks=BLOCKS) -> np.ndarray:
    starts = [64 - end for end in accumulate(blocks)]
    result = np.zeros_like(prints)
    for i in order:
        result = (result << np.uint64(blocks[i])) | ((prints >> np.uint64(starts[i])) & np.uint64((1 << blocks[i]) - 1))
    return result


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each fingerprint in the node of every order, with its Gray rank there."""
    for batch in batches:
        prints = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for number, (lead, order) in enumerate(block_orders()):
            rank = gray_rank(reordered(prints, order))
            node = (rank >> np.uint64(64 - lead)).astype(np.int64) + (number << 32)
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(rank.view(np.int64)), batch.column(0)], ["node", "rank", "fp"])


def _merge(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give joined positions the smallest label of their group, in place."""
    while len(a):
        least = np.minimum(labels[a], labels[b])
        np.minimum.at(labels, labels[a], least)
        np.minimum.at(labels, labels[b], least)
        while True:
            root = labels[labels]
            if (root == labels).all():
                break
            labels[:] = root
        open_ = labels[a] != labels[b]
        a, b = a[open_], b[open_]


def _levels(prints: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(pattern, shared mask) per run, from single fingerprints up to one root."""
    low, high = prints, prints
    levels = [(low, np.full_like(low, ~np.uint64(0)))]
    while len(low) > 1:
        cuts = np.arange(0, len(low), FANOUT)
        low, high = np.bitwise_and.reduceat(low, cuts), np.bitwise_or.reduceat(high, cuts)
        levels.append((low, ~(low ^ high)))
    return levels


def _descend(levels: list, level: int, i: np.ndarray, j: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Leaf pairs within the limit below the pairs (i, j), in bounded chunks."""
    pattern, mask = levels[level]
    close = np.bitwise_count((pattern[i] ^ pattern[j]) & mask[i] & mask[j]) <= limit
    i, j = i[close], j[close]
    if level == 0:
        yield i, j
        return
    below = len(levels[level - 1][0])
    step = np.arange(FANOUT)
    for at in range(0, len(i), PAIR_CHUNK):
        left = (i[at : at + PAIR_CHUNK, None, None] * FANOUT + step[None, :, None]) + np.zeros((1, 1, FANOUT), dtype=np.int64)
        right = (j[at : at + PAIR_CHUNK, None, None] * FANOUT + step[None, None, :]) + np.zeros((1, FANOUT, 1), dtype=np.int64)
        left, right = left.ravel(), right.ravel()
        inside = (left < right if level == 1 else left <= right) & (left < below) & (right < below)
        yield from _descend(levels, level - 1, left[inside], right[inside], limit)


def node_links(prints: np.ndarray, limit: int = DIFFERENCES) -> np.ndarray:
    """Label of each fingerprint of one Gray-sorted node: position of the first member of its group."""
    labels = np.arange(len(prints))
    levels = _levels(prints)
    root = np.zeros(1, dtype=np.int64)
    for a, b in _descend(levels, len(levels) - 1, root, root, limit):
        _merge(labels, a, b)
    return labels


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within each node of rows that come sorted by node and Gray rank.

    Small nodes are compared by shifting the whole batch against itself; larger ones one by one.
    """
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def links(node: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        labels = np.arange(len(node))
        starts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        sizes = np.diff(np.r_[starts, len(node)])
        for at, n in zip(starts[sizes > 32], sizes[sizes > 32]):
            labels[at : at + n] = node_links(prints[at : at + n]) + at
        small = np.repeat(sizes <= 32, sizes)
        for shift in range(1, min(33, len(node))):
            same = (node[shift:] == node[:-shift]) & small[shift:]
            if not same.any():
                break
            i = np.flatnonzero(same)
            i = i[np.bitwise_count(prints[i] ^ prints[i + shift]) <= DIFFERENCES]
            _merge(labels, i, i + shift)
        moved = np.flatnonzero(labels != np.arange(len(node)))
        signed = prints.view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(signed[moved]), pa.array(signed[labels[moved]])], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        node = batch.column(0).to_numpy(zero_copy_only=False)
        prints = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
        held.append((node, prints))
        if held[0][0][0] == node[-1]:
            continue
        node, prints = (np.concatenate(x) for x in zip(*held))
        cut = np.searchsorted(node, node[-1])
        held = [(node[cut:], prints[cut:])]
        yield links(node[:cut], prints[:cut])
    if held:
        yield links(*(np.concatenate(x) for x in zip(*held)))


def _links_of(placed: DataFrame) -> DataFrame:
    together = placed.repartition("node").sortWithinPartitions("node", "rank")
    return together.select("node", "fp").mapInArrow(_linked, "a bigint, b bigint")


def _cut_into_runs(rows: DataFrame) -> DataFrame:
    """Rows of large nodes once per surviving pair of runs; ``node`` becomes the pair."""
    numbered = stored(row_numbers(rows, [F.col("node"), F.col("rank")], "place"))
    starts = numbered.groupBy("node").agg(F.min("place").alias("start"))
    in_runs = stored(numbered.join(starts, "node").select("node", "rank", "fp", F.expr(f"(place - start) div {RUN}").alias("run")))
    runs = stored(in_runs.groupBy("node", "run").agg(F.expr("bit_and(fp)").alias("low"), F.expr("bit_or(fp)").alias("high")))
    shared = F.expr("~(low ^ high)")
    left = runs.select("node", F.col("run").alias("run_a"), F.col("low").alias("low_a"), shared.alias("shared_a"))
    right = runs.select("node", F.col("run").alias("run_b"), F.col("low").alias("low_b"), shared.alias("shared_b"))
    close = F.bit_count(F.expr("(low_a ^ low_b) & shared_a & shared_b")) <= DIFFERENCES
    pairs = left.join(right, "node").where((F.col("run_a") <= F.col("run_b")) & close)
    ends = pairs.select("node", "run_a", "run_b", F.explode(F.array_distinct(F.array("run_a", "run_b"))).alias("run"))
    unit = F.xxhash64("node", "run_a", "run_b")
    return in_runs.join(stored(ends), ["node", "run"]).select(unit.alias("node"), "rank", "fp")


def linked_fingerprints(prints: DataFrame) -> DataFrame:
    """(a, b): links that connect exactly the distinct ``fp`` reachable by steps of at most 4 differences."""
    placed = prints.select("fp").mapInArrow(_placed, "node bigint, rank bigint, fp bigint")
    large = stored(placed.groupBy("node").count().where(F.col("count") > NODE_LIMIT).select(F.col("node").alias("large")))
    found = _links_of(placed.join(large, F.col("node") == F.col("large"), "left_anti"))
    if large.head(1):
        found = found.union(_links_of(_cut_into_runs(placed.join(large, F.col("node") == F.col("large"), "left_semi"))))
    return found.distinct()


def component_roots(prints: DataFrame) -> DataFrame:
    """(linked, root) for the fingerprints that have a link; the rest stand alone."""
    return stored(components(linked_fingerprints(prints)).select(F.col("node").alias("linked"), "root"))


def simhash_components(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint in hex, component_id for every document.

    Null and empty texts have fingerprint zero and link like others. Null keys never name a component
    unless all its keys are null. Repeated rows stay. An empty table gives an empty result.
    """
    rows = stored(with_fingerprints(docs))
    prints = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first_doc")))
    roots = component_roots(prints)
    grouped = prints.join(roots, F.col("fp") == F.col("linked"), "left").select("fp", "first_doc", F.coalesce("root", "fp").alias("root"))
    first = grouped.where("fp <> root").union(grouped.join(roots.where("linked = root").select("root"), "root", "left_semi").select(grouped.columns))
    named = stored(first.groupBy("root").agg(F.min("first_doc").alias("component_doc")).withColumnRenamed("root", "named_root"))
    per_print = grouped.join(named, F.col("root") == F.col("named_root"), "left").select(
        F.col("fp").alias("print"), F.coalesce("component_doc", "first_doc").alias("component_id")
    )
    return rows.join(per_print, F.col("fp") == F.col("print")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_per_group(docs: DataFrame) -> DataFrame:
    """``docs`` with the first document of each component: smallest key, nulls last, then a row digest.

    Columns are kept whatever their names and types. Null and empty texts are one group; of repeated rows one
    stays; an empty table gives an empty result.
    """
    keyed = docs.select(*row_keys(docs), F.col("doc_id").alias("row_doc"), F.col("text").alias("row_text"))
    rows = stored(with_fingerprints(keyed, ("row_x1", "row_x2", "row_doc"), "row_text"))
    roots = component_roots(rows.select("fp").distinct())
    grouped = rows.join(roots, F.col("fp") == F.col("linked"), "left").withColumn("root", F.coalesce("root", "fp"))
    first = F.min(F.struct(F.col("row_doc").isNull().alias("unnamed"), "row_doc", "row_x1", "row_x2")).alias("first")
    kept = stored(grouped.groupBy("root").agg(first).select("first.row_x1", "first.row_x2"))
    return distinct_rows(docs).join(kept, ["row_x1", "row_x2"], "left_semi").select("whole_row.*")
