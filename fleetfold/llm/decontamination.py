"""Benchmark decontamination with spaced seeds.

A seed is a mask over consecutive words that ignores some positions, so a hit survives substituted
words. Digests of all masked windows of the documents are joined with those of the benchmark; each hit
names an item and a shift between item and document. Around a hit the words are then compared at that
shift: an overlap counts if some run of ``window`` item words agrees in at least ``similarity`` of them.
Whichever words are substituted within that tolerance, one masked window of the run is free of them.
Items of fewer than ``least_words`` words are found where all their words follow each other unchanged.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetfold.llm.common import alnum_words, stored, text_keys, whole_text

# fixed values: word positions that a seed looks at; together complete for runs of 8 to 13 words
SEEDS = ((0, 1, 3, 5, 6), (0, 2, 3, 4, 7), (0, 1, 4, 5, 7))
WINDOW = 13
SIMILARITY = 0.8
LEAST_WORDS = 8


def _codes(words: Column) -> Column:
    """A digest per word, so that a word is read once and not once per window."""
    return F.transform(words, lambda w: F.xxhash64(w))


def _digest(number: int, codes: Column, at: Column, seed) -> Column:
    return F.xxhash64(F.lit(number), *(F.get(codes, at + s) for s in seed))


def _seeded(codes: Column, seeds) -> Column:
    """(digest, position) of every masked window of every seed."""

    def of(number: int, seed) -> Column:
        last = F.size(codes) - 1 - max(seed)
        window = lambda i: F.struct(_digest(number, codes, i, seed).alias("digest"), i.alias("at"))
        windows = F.transform(F.sequence(F.lit(0), last), window)
        return F.when(last >= 0, windows).otherwise(F.array().cast("array<struct<digest:bigint,at:int>>"))

    return F.concat(*(of(n, s) for n, s in enumerate(seeds)))


def _possible(codes: Column, seeds, bitmap: Column) -> Column:
    """(digest, position) of the masked windows that may be of the benchmark.

    ``codes`` holds null for words that the benchmark has not; a window stops at the first of them and
    gets no digest, which is the case for nearly all.
    """

    def of(number: int, seed) -> Column:
        last = F.size(codes) - 1 - max(seed)

        def window(i: Column) -> Column:
            known = reduce(lambda a, b: a & b, (F.get(codes, i + s).isNotNull() for s in seed))
            return F.when(known, _digest(number, codes, i, seed))

        digests = F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), window)).otherwise(F.array().cast("array<bigint>"))
        hit = lambda d, i: F.when(d.isNotNull() & _maybe_known(bitmap, d), F.struct(d.alias("digest"), i.alias("at")))
        return F.array_compact(F.transform(digests, hit))

    return F.concat(*(of(n, s) for n, s in enumerate(seeds)))


def _whole(size: int) -> tuple[int, ...]:
    """The seed that looks at every one of ``size`` words."""
    return tuple(range(size))


def benchmark_items(benchmark: DataFrame, item: str = "item_id", text: str = "text", least_item_words: int = 1) -> DataFrame:
    """Distinct items with at least ``least_item_words`` words, and one at any rate."""
    words = alnum_words(whole_text(text))
    items = benchmark.select(F.col(item).alias("item_id"), F.xxhash64(F.col(item), F.col(text)).alias("item"), words.alias("item_words"))
    return items.where(F.size("item_words") >= max(1, least_item_words)).dropDuplicates(["item"])


def _bitmap(known: DataFrame) -> Column:
    """Bits of the column ``digest``, as one constant array of longs.

    Its size follows the benchmark, never the documents, and stops at 2 MB; a fuller bitmap lets more
    words and windows through to the join, it never loses one.
    """
    words = 1 << min(18, max(6, (4 * max(1, known.count()) - 1).bit_length()))
    slot, bit = F.col("digest").bitwiseAND(F.lit(words - 1)), F.expr("cast(shiftrightunsigned(digest, 32) & 63 as int)")
    # two's complement: bit 63 is the sign
    rows = known.select(slot.alias("slot"), bit.alias("bit")).distinct().groupBy("slot").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits")).collect()
    bits = [0] * words
    for row in rows:
        bits[row.slot] = row.bits
    return F.from_json(F.lit(json.dumps(bits)), "array<bigint>")


def _maybe_known(bitmap: Column, digest: Column) -> Column:
    slot = digest.bitwiseAND(F.size(bitmap).cast("long") - 1).cast("int")
    bit = F.shiftrightunsigned(digest, 32).bitwiseAND(F.lit(63)).cast("int")
    return F.get(bitmap, slot).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), bit)) != 0


def _agreeing(words: Column, item_words: Column, shift: Column) -> Column:
    """1 per item word that stands at its place in the document, else 0."""
    return F.transform(item_words, lambda w, i: F.coalesce(F.get(words, shift + i) == w, F.lit(False)).cast("int"))


def _candidates(docs: DataFrame, text: str, items: DataFrame, seeds, least_words: int) -> DataFrame:
    """(k1, k2, item, shift): where a masked window of a text is that of an item. Narrow rows only."""
    size, code = F.size("item_words"), _codes(F.col("item_words"))
    # lengths of short items that the benchmark has: their windows are looked up only if there are any
    short = sorted(r.size for r in items.where(size < least_words).select(size.alias("size")).distinct().collect())
    whole = [_whole(n) for n in short]
    coded = items.select("item", size.alias("size"), code.alias("codes"))
    long_known = coded.where(F.col("size") >= least_words).select("item", F.inline(_seeded(F.col("codes"), seeds)))
    parts = [long_known] + [coded.where(F.col("size") == n).select("item", F.inline(_seeded(F.col("codes"), [w]))) for n, w in zip(short, whole)]
    known = stored(reduce(DataFrame.union, parts).withColumnRenamed("at", "item_at"))
    windows, vocabulary = _bitmap(known), _bitmap(coded.select(F.explode("codes").alias("digest")).distinct())
    split = docs.select(F.xxhash64(whole_text(text)).alias("k1"), F.xxhash64(F.lit("second"), whole_text(text)).alias("k2"), alnum_words(whole_text(text)).alias("words"))
    codes = F.transform(_codes(F.col("words")), lambda c: F.when(_maybe_known(vocabulary, c), c))
    possible = F.concat(_possible(F.col("codes"), seeds, windows), *(_possible(F.col("codes"), [w], windows) for w in whole))
    seen = split.select("k1", "k2", codes.alias("codes")).select("k1", "k2", F.inline(possible))
    return seen.join(known, "digest").select("k1", "k2", "item", (F.col("at") - F.col("item_at")).alias("shift")).distinct()


def overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    keep: list[Column],
    text: str = "text",
    seeds=SEEDS,
    window: int = WINDOW,
    similarity: float = SIMILARITY,
    least_words: int = LEAST_WORDS,
    least_item_words: int = 1,
) -> DataFrame:
    """``keep`` columns, item_id, shift, words and agreeing words, a row per overlap of a document.

    Two scans, no shuffle of texts while hits are few. The first leaves out within the row all windows that
    cannot be of the benchmark and joins the others, as narrow rows, with the digests of the benchmark; the
    second brings the hits back to their texts, compares the words around them once per item and shift,
    and splits no other text. Null and empty texts, an empty benchmark and an empty table give no rows;
    items shorter than ``window`` are compared whole, those below ``least_words`` without tolerance, those
    below ``least_item_words`` not at all (with 1, an item of one word is found in every text that holds
    it); repeated rows and null keys give rows of their own; other columns are not looked at.
    """
    items = stored(benchmark_items(benchmark, least_item_words=least_item_words))
    found = stored(_candidates(docs, text, items, seeds, least_words).withColumnsRenamed({"k1": "hit_k1", "k2": "hit_k2"}))
    first, second = text_keys(whole_text(text))
    named = docs.select(*keep, whole_text(text).alias("whole_text"), first.alias("text_k1"), second.alias("text_k2"))
    names = named.columns[:-3]
    # texts with a hit are split before their hits join, so that each is split once
    keys = stored(found.select("hit_k1", "hit_k2").distinct())
    same = (F.col("text_k1") == F.col("hit_k1")) & (F.col("text_k2") == F.col("hit_k2"))
    matched = named.join(keys, same).select(*names, "hit_k1", "hit_k2", alnum_words(F.col("whole_text")).alias("words"))
    shifted = matched.join(found, ["hit_k1", "hit_k2"]).join(items, "item")
    agree = shifted.select(*names, "item_id", "shift", _agreeing(F.col("words"), F.col("item_words"), F.col("shift")).alias("agree"))
    n = F.least(F.size("agree"), F.lit(window))
    runs = F.transform(
        F.sequence(F.lit(0), F.size("agree") - n), lambda s: F.aggregate(F.slice("agree", s + 1, n), F.lit(0), lambda a, x: a + x)
    )
    scored = agree.select(*names, "item_id", "shift", n.alias("words"), F.array_max(runs).alias("agreeing"))
    least = F.when(F.col("words") < least_words, F.col("words")).otherwise(F.ceil(F.col("words") * F.lit(similarity) - F.lit(1e-9)))
    return scored.where(F.col("agreeing") >= least).distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, first_word, words, agreeing: the best overlap of each document with each item."""
    found = overlaps(docs, benchmark, [F.col("doc_id")])
    best = F.max(F.struct("agreeing", (-F.col("shift")).alias("back"), "words"))
    per_item = found.groupBy("doc_id", "item_id").agg(best.alias("best"))
    return per_item.select(
        "doc_id", "item_id", F.greatest(-F.col("best.back"), F.lit(0)).alias("first_word"), "best.words", "best.agreeing"
    )


def without_benchmark(docs: DataFrame, benchmark: DataFrame, least_item_words: int = 1) -> DataFrame:
    """``docs`` without the documents that overlap a benchmark item; equal texts share the verdict.

    All columns are kept whatever their names and types. Items below ``least_item_words`` words are ignored.
    """
    first, second = text_keys(whole_text())
    found = overlaps(docs, benchmark, [first, second], least_item_words=least_item_words).select("k1", "k2")
    flagged = stored(found.distinct())
    # the columns travel in one struct, so that none of them clashes with the keys
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), first, second)
    return packed.join(flagged, ["k1", "k2"], "left_anti").select("row.*")
