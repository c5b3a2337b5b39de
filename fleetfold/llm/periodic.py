"""Detection of periodic runs of words: seed and extend along diagonals.

A run of period q and length of at least max(24, 3 q) agrees with itself at lag q over at least
max(24 - q, 2 q) words. For lags in a band the least of these is the length of the seeds: 16 words for
lags up to 16, then k words for lags above k / 2 and up to k, with k doubled from band to band. Seeds are as
long as the lag at least, so within a run the next place of the same seed is exactly one period on, and it
is enough to pair each place with the next one. A pair is extended along its diagonal in both
directions; a table of the place up to which each lag is covered skips pairs inside a known run.

Seeds of twice the length come from pairs of shorter ones and are sought only where both of these recur
in the same document, so ordinary text is gone after a few words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEAST_LENGTH, LEAST_PERIODS = 24, 3  # fixed by the contract
FIRST_SEED = min(max(LEAST_LENGTH - q, (LEAST_PERIODS - 1) * q) for q in range(1, LEAST_LENGTH))
WORDS_AT_ONCE = 1 << 19
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def _numbered(values: np.ndarray) -> np.ndarray:
    """Equal values get equal small numbers."""
    return np.unique(values, return_inverse=True)[1].astype(np.int64)


def _recurring(at: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places whose code occurs twice or more."""
    twice = np.bincount(code, minlength=1)[code] > 1 if len(code) else np.zeros(0, dtype=bool)
    return at[twice], code[twice]


def _doubled(at: np.ndarray, code: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    """Recurring seeds of twice the length, from the sorted places of the recurring ones of ``half`` words."""
    if not len(at):
        return at, code
    other = np.minimum(np.searchsorted(at, at + half), len(at) - 1)
    both = at[other] == at + half
    joined = code[both] * (int(code.max()) + 1) + code[other[both]]
    return _recurring(at[both], _numbered(joined))


def _stop(words: np.ndarray, i: int, lag: int, step: int, limit: int) -> int:
    """First place from ``i`` on in direction ``step`` where the words at ``lag`` differ, or ``limit``."""
    block = 64
    while i != limit:
        size = min(block, abs(limit - i))
        low = i if step > 0 else i - size + 1
        differ = np.flatnonzero(words[low : low + size] != words[low + lag : low + lag + size])
        if len(differ):
            return low + int(differ[0 if step > 0 else -1])
        i, block = i + step * size, block * 4
    return limit


def runs_of(words: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(document, start, length, period) of all runs; document d holds words ``ends[d] : ends[d + 1]``.

    ``words`` are numbers; equal words of a document have equal numbers.
    """
    owner = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    longest = int(np.diff(ends).max(initial=0))
    place = np.arange(len(words))
    at, code = _recurring(place, _numbered(owner * (int(words.max(initial=0)) + 1) + words))
    found, size = [], 1
    while len(at) and (size <= FIRST_SEED or (size // 2 + 1) * LEAST_PERIODS <= longest):
        if size >= FIRST_SEED:
            order = np.lexsort((at, code))
            here, there = at[order[:-1]], at[order[1:]]
            lag = there - here
            in_band = (lag <= size) & (lag > (0 if size == FIRST_SEED else size // 2))
            pair = (code[order[:-1]] == code[order[1:]]) & in_band
            here, lag = here[pair], lag[pair]
            order = np.argsort(here, kind="stable")
            found += _extended(words, ends, owner, here[order], lag[order])
        at, code = _doubled(at, code, size)
        size *= 2
    return sorted(found, key=lambda run: (run[0], run[1], run[3]))


def _extended(words: np.ndarray, ends: np.ndarray, owner: np.ndarray, here: np.ndarray, lags: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Runs from pairs of equal seeds at ``here`` and ``here + lag``, in the order of places."""
    covered: dict[tuple[int, int], int] = {}
    for i, lag, document in zip(here.tolist(), lags.tolist(), owner[here].tolist()):
        if i < covered.get((document, lag), 0):
            continue
        first, last = int(ends[document]), int(ends[document + 1])
        stop = _stop(words, i, lag, 1, last - lag)
        start = _stop(words, i, lag, -1, first - 1) + 1
        covered[document, lag] = stop
        length = stop + lag - start
        if length >= max(LEAST_LENGTH, LEAST_PERIODS * lag):
            yield document, start - first, length, lag


def _with_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(batch.num_columns - 1)
        ends = lists.offsets.to_numpy().astype(np.int64)
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(ends, ends[first] + WORDS_AT_ONCE, side="right")) - 1)
            yield _batch_with_runs(batch.slice(first, last - first))
            first = last


def _batch_with_runs(batch: pa.RecordBatch) -> pa.RecordBatch:
    lists = batch.column(batch.num_columns - 1)
    ends = np.r_[0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))].astype(np.int64)
    flat = lists.flatten()
    runs = runs_of(flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64), ends)
    dropped = np.zeros(len(flat) + 1, dtype=np.int64)
    for document, start, length, period in runs:
        dropped[ends[document] + start + period] += 1
        dropped[ends[document] + start + length] -= 1
    kept = np.cumsum(dropped)[:-1] == 0
    kept_ends = np.r_[0, np.cumsum(kept)][ends]
    left = pa.LargeListArray.from_arrays(pa.array(kept_ends), flat.filter(pa.array(kept)).cast(pa.large_string()))
    collapsed = pc.binary_join(left, pa.scalar(" ", pa.large_string())).cast(pa.string())
    table = np.array(runs, dtype=np.int64).reshape(-1, 4)
    run_ends = np.searchsorted(table[:, 0], np.arange(batch.num_rows + 1)).astype(np.int32)
    fields = pa.StructArray.from_arrays([pa.array(table[:, c]) for c in (1, 2, 3)], ["start", "length", "period"])
    added = [pa.ListArray.from_arrays(pa.array(run_ends), fields), collapsed]
    return pa.RecordBatch.from_arrays([*batch.columns[:-1], *added], [*batch.schema.names[:-1], "runs", "collapsed"])


def periodic_runs(docs: DataFrame, words: str = "words") -> DataFrame:
    """``docs`` with ``runs`` (start, length, period; by start, then period) and ``collapsed`` in place of ``words``.

    ``words`` names an array of words; a null array counts as empty, a null word as an empty one.
    ``collapsed`` joins by single blanks the words that no run contains behind its first period. Empty texts
    have no runs and collapse to an empty string; repeated rows stay; an empty table gives an empty result;
    other columns pass through, columns named ``runs`` and ``collapsed`` are replaced. Nothing is
    shuffled; a document is searched by one task in time n log n, whatever repeats in it.
    """
    kept = docs.drop("runs", "collapsed", words)
    fields = [*kept.schema.fields, T.StructField("runs", T.DataType.fromDDL(RUNS)), T.StructField("collapsed", T.StringType())]
    whole = F.coalesce(F.transform(F.col(f"`{words}`"), lambda w: F.coalesce(w, F.lit(""))), F.array().cast("array<string>"))
    return docs.select(*(F.col(f"`{c}`") for c in kept.columns), whole.alias("words")).mapInArrow(_with_runs, T.StructType(fields))


def planted_words(key: Column, words: Column) -> Column:
    """Test repetitions: in a tenth of the documents, by a checksum of the key, a stretch of words repeats to the end."""
    h = F.crc32(key.cast("string"))
    g, n = F.floor(h / 10).cast("long"), F.size(words).cast("long")
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8)).cast("long")
    at = lambda i: F.when(i >= a, a + (i - a) % p).otherwise(i).cast("int")
    moved = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(words, at(i)))
    return F.when((h % 10 == 0) & (n > 0), moved).otherwise(words)


def longest_run(runs: Column) -> Column:
    """The run with the greatest exact length / period; of equal ones the first, then that of the smallest period; null if none."""
    none = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")

    def better(best: Column, run: Column) -> Column:
        more = run["length"] * best["period"] > best["length"] * run["period"]
        return F.when(best.isNull() | more, run).otherwise(best)

    return F.aggregate(runs, none, better)
