"""Shards of near-equal bytes: minimax contiguous partition of an ordered list of atomic groups.

Documents with equal text form an atomic group. Groups stand in the order of their text digest, and
the smallest shard capacity that lets a greedy pass fit them into the shards is found by binary
search. The greedy pass asks "where is the last group that ends at or before x"; the driver answers
from a bounded list of fences (prefix sums at group ends), which is refined only where a cut may
still fall, one Spark job per refinement, until capacity and cuts are exact.
A group larger than an even share gets a shard of its own; the others share the rest.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetfold.llm.common import stored, stored_rows, text_keys, whole_text
from fleetfold.llm.prefix import row_numbers, running_sums

FENCES = 20_000
ROW_OVERHEAD = 16


def greedy_cuts(fences: list[tuple[int, int]], total: int, shards: int, capacity: int, hopeful: bool) -> list[int]:
    """Ends of the shards of a greedy pass; a list that does not end in ``total`` did not fit.

    ``fences``: (prefix sum, groups ending since the fence before it), ascending. ``hopeful`` assumes
    that unseen groups end wherever it helps, otherwise only fences are used.
    """
    ends, cuts, at = [f for f, _ in fences], [], 0
    for _ in range(shards):
        reach = at + capacity
        i = bisect_right(ends, reach)
        sure = ends[i - 1] if i else 0
        if hopeful and i < len(ends) and fences[i][1] > 1:
            sure = max(sure, min(reach, ends[i] - 1))
        at = max(at, sure)
        cuts.append(at)
        if at >= total:
            break
    return cuts


def _smallest(low: int, high: int, fits) -> int:
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if fits(middle) else (middle + 1, high)
    return low


def minimax_capacity(groups: DataFrame, total: int, largest: int, shards: int, fences: int = FENCES) -> tuple[int, list[int]]:
    """Smallest feasible capacity and the ends of the shards.

    ``groups`` has ``upto``: bytes of all groups up to and with this one, strictly increasing.
    Reads about ``fences`` values per job to the driver, twice as many after a round without progress.
    """
    if total <= 0:
        return 0, []
    even = -(-total // shards)
    low, high = max(largest, even), even + largest
    known: list[tuple[int, int]] = []
    regions = [(0, total)]
    bounds = None
    while True:
        # a round that told nothing had too few fences for the cuts still open
        fences, bounds = (2 * fences if (low, high) == bounds else fences), (low, high)
        known = _refined(groups, known, regions, fences)
        high = _smallest(low, high, lambda c: greedy_cuts(known, total, shards, c, False)[-1] >= total)
        low = _smallest(low, high, lambda c: greedy_cuts(known, total, shards, c, True)[-1] >= total)
        if low >= high:
            return high, greedy_cuts(known, total, shards, high, False)
        regions = _open_regions(known, total, shards, low, high)


def _open_regions(known: list[tuple[int, int]], total: int, shards: int, low: int, high: int) -> list[tuple[int, int]]:
    """Stretches between fences in which a cut may fall for some capacity in [low, high]."""
    ends = [f for f, _ in known]
    first, last = greedy_cuts(known, total, shards, low, False), greedy_cuts(known, total, shards, high, True)
    merged: list[list[int]] = []
    for k in range(max(len(first), len(last))):
        a, b = first[min(k, len(first) - 1)], last[min(k, len(last) - 1)]
        i, j = bisect_right(ends, a), bisect_right(ends, b)
        start, stop = (ends[i - 1] if i else 0), (ends[j] if j < len(ends) else total)
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], stop)
        else:
            merged.append([start, stop])
    return [(a, b) for a, b in merged if b > a]


def _refined(groups: DataFrame, known: list, regions: list[tuple[int, int]], fences: int) -> list[tuple[int, int]]:
    width = sum(b - a for a, b in regions)
    cell: Column = F.lit(None).cast("long")
    first = 0
    for a, b in regions:
        step = max(1, -(-width // fences))
        cell = F.when((F.col("upto") > a) & (F.col("upto") <= b), F.lit(first) + F.expr(f"(upto - {a} - 1) div {step}")).otherwise(cell)
        first += (b - a) // step + 1
    found = (
        groups.select("upto", cell.alias("cell")).where("cell is not null").groupBy("cell").agg(F.max("upto").alias("fence"), F.count("*").alias("ends"))
    )
    fresh = [(r.fence, r.ends) for r in found.collect()]
    outside = [f for f in known if not any(a < f[0] <= b for a, b in regions)]
    return sorted({*fresh, *outside})


def shard_by_bytes(docs: DataFrame, shards: int = 40, text: str = "text", key: str = "doc_id", fences: int = FENCES) -> DataFrame:
    """One row per document: key, size, text_crc32, law, shard, slot, grown_shard.

    Size is UTF-8 bytes plus 16. Equal texts share a shard. Slots count each shard from 0, by text
    digest, key and stored row, so repeated rows get slots of their own. A null text counts as an
    empty one, null keys come first among equal texts, other columns are not looked at; an empty
    table gives an empty result. With fewer groups than shards some shards stay empty.
    """
    body = whole_text(text)
    rows = stored_rows(
        docs.select(
            F.col(key).alias("doc_key"),
            (F.octet_length(body).cast("long") + ROW_OVERHEAD).alias("size"),
            F.crc32(body).alias("text_crc32"),
            *text_keys(body),
        )
    )
    groups = stored(rows.groupBy("k1", "k2").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")))
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    alone, left, free = [], total, shards
    for group in groups.orderBy(F.desc("bytes"), "k1", "k2").limit(shards).collect():
        if free == 1 or group.bytes * free <= left:
            break
        alone.append(group)
        left, free = left - group.bytes, free - 1
    tier: Column = F.lit(0)
    for i, group in enumerate(alone):
        tier = F.when((F.col("k1") == group.k1) & (F.col("k2") == group.k2), i + 1).otherwise(tier)
    shared = groups.where(tier == 0)
    sums = running_sums(shared, [], [F.col("k1"), F.col("k2")], {"bytes_before": "bytes", "rows_before": "rows"})
    placed = stored(
        sums.select((F.col("bytes_before") + F.col("bytes")).alias("upto"), (F.col("rows_before") + F.col("rows")).alias("rows_upto"), "bytes")
    )
    ends = placed.agg(F.max("bytes"), F.max("rows_upto")).first()
    _, cuts = minimax_capacity(placed, left, ends[0] or 0, free, fences)
    at = {r.upto: r.rows_upto for r in placed.where(F.col("upto").isin(cuts)).collect()} if cuts else {}
    shared_rows = ends[1] or 0
    starts = [0, *(at[c] for c in cuts[:-1])]
    starts += [shared_rows] * (free - len(starts))
    place = shared_rows
    for group in alone:
        starts.append(place)
        place += group.rows
    numbered = row_numbers(
        rows.withColumn("tier", tier), [F.col(c) for c in ("tier", "k1", "k2", "doc_key", "row_file", "row_at")], "place"
    )
    shard = sum((F.col("place") >= s).cast("int") for s in starts[1:]) if len(starts) > 1 else F.lit(0)
    return (
        numbered.withColumn("shard", shard.cast("int"))
        .withColumn("slot", F.col("place") - F.element_at(F.array(*(F.lit(s).cast("long") for s in starts)), F.col("shard") + 1))
        .select(
            F.col("doc_key").alias(key),
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            "slot",
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
