"""Removal of byte strings that also occur in an earlier document.

Candidates come from minimizers: of every 31 neighbouring 20-byte strings of a text the one with the
least digest is an anchor, so two equal 50-byte strings hold the same anchor at the same place. Anchors
of a single text are dropped after one shuffle. For the others the bytes around them are gathered, and
each task builds the sorted order and the common prefixes of its strings column by column: every round
puts one more symbol in front of all strings, the new order is a stable sort of the old one by that
symbol, and a common prefix is one more than the least of the old prefixes it spans. Strings whose
common prefix reaches 50 are equal there, and the smallest key among them decides.

Building the transform over whole texts would take as many rounds over all data as the longest text has
bytes; over the candidates it takes 80.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetfold.llm.common import stored, text_keys, whole_text

LENGTH, ANCHOR = 50, 20
REACH = LENGTH - ANCHOR  # bytes before an anchor that a string around it can hold
WIDTH = REACH + LENGTH
# groups of equal anchors beyond this many places are compared by digests of their strings
GROUP_LIMIT, COLLECTION = 1 << 16, 1 << 16
ROWS_AT_ONCE, CONTEXTS_AT_ONCE, TEXTS_REMEMBERED = 64, 20_000, 1 << 18
LAST = (1 << 63) - 1
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xFF51AFD7ED558CCD)]


def anchor_digests(text: bytes) -> np.ndarray:
    """Digest of the 20-byte string at every start."""
    one = np.frombuffer(text, dtype=np.uint8).astype(np.uint64)
    two = one[:-1] | (one[1:] << np.uint64(8))
    four = two[:-2] | (two[2:] << np.uint64(16))
    eight = four[:-4] | (four[4:] << np.uint64(32))
    n = len(text) - ANCHOR + 1
    digest = (eight[:n] * MIX[0]) ^ (((eight[8 : 8 + n] ^ MIX[3]) * MIX[1]) >> np.uint64(7)) ^ (eight[8 : 8 + n] * MIX[1]) ^ (four[16 : 16 + n] * MIX[2])
    digest ^= digest >> np.uint64(29)
    digest *= MIX[3]
    return digest ^ (digest >> np.uint64(32))


def _sliding(values: np.ndarray, pick) -> np.ndarray:
    """``pick`` over every run of 31 neighbours."""
    for step in (1, 2, 4, 8):
        values = pick(values[:-step], values[step:])
    return pick(values[:-15], values[15:])


def anchors(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(starts, digests) of the anchors; none in a text shorter than 50 bytes."""
    if len(text) < LENGTH:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    digest = anchor_digests(text)
    least = _sliding(digest, np.minimum)
    pad = np.zeros(REACH, dtype=np.uint64)
    at = np.flatnonzero(_sliding(np.concatenate([pad, least, pad]), np.maximum) == digest)
    return at, digest[at]


def _emit_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct anchors of each text and how often each occurs; the places are found again where they are needed.

    A text that the task has just seen is passed over, so a large group of copies costs one text per task.
    """
    seen: set[int] = set()
    for batch in batches:
        text_ids = batch.column(0).to_numpy(zero_copy_only=False)
        digests, owners, places, size = [], [], [], 0
        for i, text in enumerate(batch.column(1)):
            if int(text_ids[i]) not in seen:
                if len(seen) >= TEXTS_REMEMBERED:
                    seen.clear()
                seen.add(int(text_ids[i]))
                digest, times = np.unique(anchors(text.as_py())[1], return_counts=True)
                digests.append(digest)
                places.append(times.astype(np.int32))
                owners.append(np.full(len(digest), text_ids[i]))
                size += len(digest)
            if digests and (size > 200_000 or i == batch.num_rows - 1):
                columns = np.concatenate(digests).view(np.int64), np.concatenate(owners), np.concatenate(places)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["anchor", "text_id", "places"])
                digests, owners, places, size = [], [], [], 0


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows, sorted by anchor, whose anchor occurs in several texts; ``wide`` marks groups with more places than the limit."""
    held: list[np.ndarray] = []
    wide_anchor, wide = 0, False

    def batch_of(rows: np.ndarray, is_wide) -> pa.RecordBatch:
        flags = np.broadcast_to(is_wide, len(rows))
        return pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1]), pa.array(flags)], ["anchor", "text_id", "wide"])

    def closed(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        cuts = np.flatnonzero(np.r_[True, rows[1:, 0] != rows[:-1, 0]])
        sizes = np.diff(np.r_[cuts, len(rows)])
        several = np.minimum.reduceat(rows[:, 1], cuts) != np.maximum.reduceat(rows[:, 1], cuts)
        chosen = np.repeat(several, sizes)
        yield batch_of(rows[chosen], np.repeat(np.add.reduceat(rows[:, 2], cuts) > GROUP_LIMIT, sizes)[chosen])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1)
        if wide:
            same = rows[:, 0] == wide_anchor
            yield batch_of(rows[same], True)
            rows = rows[~same]
            wide = not len(rows)
            if wide:
                continue
        held.append(rows)
        rows = np.concatenate(held)
        cut = int(np.searchsorted(rows[:, 0], rows[-1, 0]))
        held = [rows[cut:]]
        if cut:
            yield from closed(rows[:cut])
        if rows[cut:, 2].sum() > GROUP_LIMIT and (rows[cut:, 1] != rows[cut, 1]).any():
            yield batch_of(rows[cut:], True)
            wide_anchor, wide, held = rows[-1, 0], True, []
    if held:
        yield from closed(np.concatenate(held))


CONTEXT = "anchor bigint, text_id bigint, rank bigint, at int, size int, around binary, wide boolean"


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The 80 bytes around each repeated anchor, zeros beyond the text, and the size of the text."""
    names = [f.split()[0] for f in CONTEXT.split(", ")]
    window = np.arange(WIDTH)

    def batch_of(parts: list[tuple]) -> pa.RecordBatch:
        anchor, text_id, rank, at, size, around, wide = (np.concatenate(x) for x in zip(*parts))
        offsets = np.arange(len(at) + 1, dtype=np.int32) * WIDTH
        strings = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(around))])
        small = (pa.array(x.astype(np.int32)) for x in (at, size))
        return pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(text_id), pa.array(rank), *small, strings, pa.array(wide)], names)

    for batch in batches:
        ids, ranks = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("text_id", "rank"))
        texts, lists = (batch.column(batch.schema.get_field_index(c)) for c in ("text", "places"))
        parts, held = [], 0
        for i in range(batch.num_rows):
            known, known_wide = (lists[i].values.field(c).to_numpy(zero_copy_only=False) for c in ("anchor", "wide"))
            body = texts[i].as_py()
            at, digest = anchors(body)
            digest = digest.view(np.int64)
            repeated = np.isin(digest, known)
            at, digest = at[repeated], digest[repeated]
            wide = np.isin(digest, known[known_wide])
            padded = np.frombuffer(bytes(REACH) + body + bytes(LENGTH), dtype=np.uint8)
            for first in range(0, len(at), CONTEXTS_AT_ONCE):
                some = slice(first, first + CONTEXTS_AT_ONCE)
                n = len(at[some])
                parts.append((digest[some], np.full(n, ids[i]), np.full(n, ranks[i]), at[some], np.full(n, len(body)), padded[at[some][:, None] + window], wide[some]))
                held += n
                if held >= CONTEXTS_AT_ONCE:
                    yield batch_of(parts)
                    parts, held = [], 0
        if parts:
            yield batch_of(parts)


def column_wise(strings: np.ndarray, ranks: np.ndarray, valid: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For each string and each offset: does an equal ``length``-byte string of a smaller rank start there?

    ``strings``: (n, width) symbols; ``valid``: (n, offsets) tells which strings lie within their text.
    """
    n, width = strings.shape
    order, common = np.arange(n), np.zeros(n, dtype=np.int64)
    earlier = np.zeros(valid.shape, dtype=bool)
    for column in range(width - 1, -1, -1):
        symbols = strings[order, column]
        places = np.argsort(symbols, kind="stable")
        sorted_symbols = symbols[places]
        fresh = np.zeros(n, dtype=np.int64)
        cuts = np.flatnonzero(np.r_[True, sorted_symbols[1:] != sorted_symbols[:-1]])
        spans = np.r_[common, 0]
        for a, b in zip(cuts, np.r_[cuts[1:], n]):
            if b - a > 1:
                at = places[a:b]
                fresh[a + 1 : b] = np.minimum.reduceat(spans[: at[-1] + 2], at + 1)[:-1] + 1
        order, common = order[places], np.minimum(fresh, length)
        if column < valid.shape[1]:
            starts = np.flatnonzero(np.r_[True, common[1:] < length])
            rank = np.where(valid[order, column], ranks[order], LAST)
            least = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.r_[starts, n]))
            earlier[order, column] = valid[order, column] & (least < rank)
    return earlier


def _valid(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which of the 31 strings around an anchor at ``at`` lie within a text of ``size`` bytes."""
    start = at[:, None] - REACH + np.arange(REACH + 1)[None, :]
    return (start >= 0) & (start + LENGTH <= size[:, None])


def _spans(text_ids: np.ndarray, at: np.ndarray, hit: np.ndarray) -> pa.RecordBatch:
    """Byte ranges of runs of hits."""
    padded = np.pad(hit.astype(np.int8), ((0, 0), (1, 1)))
    step = np.diff(padded, axis=1)
    row, first = np.nonzero(step == 1)
    _, stop = np.nonzero(step == -1)
    start = at[row] - REACH + first
    return pa.RecordBatch.from_arrays([pa.array(text_ids[row]), pa.array(start.astype(np.int64)), pa.array((at[row] - REACH + stop - 1 + LENGTH).astype(np.int64))], ["text_id", "start", "stop"])


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy().astype(np.int64)


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of one collection after the other; contexts come sorted by anchor, groups stay whole."""

    def of(table: pa.Table) -> pa.RecordBatch:
        strings = np.frombuffer(b"".join(table.column("around").to_pylist()), dtype=np.uint8).reshape(-1, WIDTH)
        hit = column_wise(strings, _numbers(table, "rank"), _valid(_numbers(table, "at"), _numbers(table, "size")))
        return _spans(_numbers(table, "text_id"), _numbers(table, "at"), hit)

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= COLLECTION:
            table = pa.Table.from_batches(held)
            anchor = _numbers(table, "anchor")
            cut = int(np.searchsorted(anchor, anchor[-1]))
            if cut:
                yield of(table.slice(0, cut))
            held = table.slice(cut).combine_chunks().to_batches()
    if sum(b.num_rows for b in held):
        yield of(pa.Table.from_batches(held))


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows as dicts, few at a time."""
    for first in range(0, batch.num_rows, ROWS_AT_ONCE):
        yield from batch.slice(first, ROWS_AT_ONCE).to_pylist()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every string around an anchor of a wide group, by a 128-bit digest.

    Rows come in the order of their places, so a string that several anchors reach is given once.
    """
    text_id, done = None, -1
    for batch in batches:
        out: list[list] = [[], [], [], []]
        for row in _rows(batch):
            if row["text_id"] != text_id:
                text_id, done = row["text_id"], -1
            first = max(0, REACH - row["at"], done + 1 - row["at"] + REACH)
            last = min(REACH, row["size"] - LENGTH - row["at"] + REACH)
            done = max(done, row["at"] - REACH + last)
            for offset in range(first, last + 1):
                string = row["around"][offset : offset + LENGTH]
                for column, value in zip(out, (hashlib.md5(string).digest(), row["text_id"], row["rank"], row["at"] - REACH + offset)):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), *(pa.array(c, pa.int64()) for c in out[1:])], ["digest", "text_id", "rank", "start"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of each text."""
    names = ["cut_k1", "cut_k2", "removed", "spans", "kept"]
    for batch in batches:
        out: list[list] = [[] for _ in names]
        for row in _rows(batch):
            text, at, removed, spans, kept = row["text"], 0, 0, 0, hashlib.sha256()
            stop = -1
            for span in sorted((s["start"], s["stop"]) for s in row["spans"]):
                spans += span[0] > stop
                kept.update(text[at : max(at, span[0])])
                removed += max(0, span[1] - max(at, span[0]))
                at, stop = max(at, span[1]), max(stop, span[1])
            kept.update(text[at:])
            for column, value in zip(out, (row["k1"], row["k2"], removed, spans, kept.hexdigest())):
                column.append(value)
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:4]), pa.array(out[4], pa.string())], names)


def shared_anchors(texts: DataFrame) -> DataFrame:
    """(place_id, places, has_wide): for each text (text_id, text) with anchors of several texts, which those are."""
    places = texts.mapInArrow(_emit_anchors, "anchor bigint, text_id bigint, places int")
    together = places.repartition("anchor").sortWithinPartitions("anchor")
    shared = together.mapInArrow(_repeated, "anchor bigint, text_id bigint, wide boolean")
    listed = F.collect_set(F.struct("anchor", "wide")).alias("places")
    return stored(shared.groupBy(F.col("text_id").alias("place_id")).agg(listed, F.max("wide").alias("has_wide")))


def repeated_spans(suspects: DataFrame) -> DataFrame:
    """(text_id, start, stop) for distinct ``suspects`` (text_id, rank, text, places, has_wide).

    The spans cover exactly the bytes of 50-byte strings that start in a text of smaller rank, in overlapping pieces.
    """
    seen = suspects.select("text_id", "rank", "text", "places", "has_wide")
    narrow = seen.mapInArrow(_contexts, CONTEXT).where(~F.col("wide")).drop("wide").repartition("anchor").sortWithinPartitions("anchor")
    spans = narrow.mapInArrow(_compared, "text_id bigint, start bigint, stop bigint")
    # only texts with an anchor of a wide group are read again
    around = seen.where("has_wide").mapInArrow(_contexts, CONTEXT)
    strings = around.where("wide").mapInArrow(_digests, "digest binary, text_id bigint, rank bigint, start bigint")
    least = strings.groupBy(F.col("digest").alias("same")).agg(F.min("rank").alias("least"), F.max("rank").alias("most")).where("least < most")
    wide = strings.join(least, F.col("digest") == F.col("same")).where("rank > least").select("text_id", "start", (F.col("start") + LENGTH).alias("stop"))
    return spans.union(wide)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every document.

    A null text counts as empty, an empty table gives an empty result, other columns are not looked at. Null
    keys come after all others and are not smaller than each other; equal keys are not smaller either. Equal
    texts, told apart by two digests, are settled first: copies of a text of at least 50 bytes under a smaller
    key lose everything, and one of each text is searched under the smallest key. Texts are shuffled
    once, with copies meeting before; those with an anchor of another text are stored and numbered.
    """
    body = whole_text()
    keys = text_keys(body)
    rank = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))
    rows = stored(docs.select("doc_id", rank.alias("rank"), *keys, F.octet_length(body).cast("long").alias("n_bytes"), F.sha2(body, 256).alias("sha")))
    first = stored(rows.groupBy(F.col("k1").alias("first_k1"), F.col("k2").alias("first_k2")).agg(F.min("rank").alias("first_rank")))
    ranked = rows.join(first, (F.col("k1") == F.col("first_k1")) & (F.col("k2") == F.col("first_k2")))
    texts = docs.where(F.octet_length(body) >= LENGTH).select(*keys, body.cast("binary").alias("text"))
    # one digest is enough to name a text where candidates are sought: two texts of one digest share their lists
    listed = shared_anchors(texts.select(F.col("k1").alias("text_id"), "text"))
    wanted = listed.join(first, F.col("place_id") == F.col("first_k1")).select(
        F.col("first_k1").alias("k1"), F.col("first_k2").alias("k2"), F.col("first_rank").alias("rank"), "places", "has_wide"
    )
    one_each = texts.groupBy("k1", "k2").agg(F.first("text").alias("text"))
    suspects = stored(one_each.join(wanted, ["k1", "k2"]).withColumn("text_id", F.monotonically_increasing_id()))
    spans = repeated_spans(suspects)
    per_text = stored(spans.groupBy(F.col("text_id").alias("span_id")).agg(F.collect_set(F.struct("start", "stop")).alias("spans")))
    cut = suspects.select("text_id", "k1", "k2", "text").join(per_text, F.col("text_id") == F.col("span_id")).select("k1", "k2", "text", "spans")
    left = stored(cut.mapInArrow(_cut, "cut_k1 bigint, cut_k2 bigint, removed bigint, spans bigint, kept string"))
    joined = ranked.join(left, (F.col("k1") == F.col("cut_k1")) & (F.col("k2") == F.col("cut_k2")), "left")
    copy = (F.col("rank") > F.col("first_rank")) & (F.col("n_bytes") >= LENGTH)
    zero = F.lit(0).cast("long")
    return joined.select(
        "doc_id",
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("removed", zero)).alias("n_removed"),
        F.when(copy, F.lit(1).cast("long")).otherwise(F.coalesce("spans", zero)).alias("n_spans"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
    )
