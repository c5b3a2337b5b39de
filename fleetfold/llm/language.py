"""Language identification with a bit-sliced Bloom filter of character n-grams.

Every slot of the filter holds one bit per language, so a few probes return all languages that have an
n-gram at once. A language's n-grams are those that occur in enough of its training texts. For a text
the hits of each language are counted and corrected for the false positives that the filling of its
slice predicts; the language with the largest corrected share decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetfold.llm.common import held_out, stored

SIZES = (3, 4)
SLOT_BITS, PROBES = 20, 3
SAMPLE_PER_LANGUAGE = 3000
LEAST_SHARE, LEAST_TEXTS = 0.01, 2
CHUNK_CHARACTERS = 1 << 19
UNKNOWN = "und"
# odd constants that spread the code points of an n-gram, and one per probe
SPREAD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)
PROBE_SPREAD = np.array([0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x2545F4914F6CDD1D], dtype=np.uint64)


@cache
def _letters() -> np.ndarray:
    """Code point -> its lower-case letter, or a space for whatever is no letter."""
    table = np.full(0x110000, 32, dtype=np.uint32)
    for c in range(0x110000):
        letter = chr(c)
        if letter.isalpha():
            low = letter.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Digests of all n-grams of letters and single spaces, and the text that each belongs to."""
    gap = "   "
    codes = np.frombuffer((gap + gap.join(texts) + gap).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    letters = _letters()[codes].astype(np.uint64)
    lengths = np.array([len(t) + len(gap) for t in texts])
    # a text owns the two blanks before it and all but the last two after it
    owner = np.repeat(np.arange(len(texts)), lengths)
    owner = np.r_[0, owner, [len(texts) - 1] * 2]
    blank = letters == 32
    double = np.r_[blank[:-1] & blank[1:], True]
    digests, owners = [], []
    for size in SIZES:
        n = len(letters) - size + 1
        bad = np.zeros(n, dtype=bool)
        digest = np.full(n, size, dtype=np.uint64)
        for i in range(size):
            digest += letters[i : i + n] * SPREAD[i]
            digest ^= digest >> np.uint64(29)
            if i < size - 1:
                bad |= double[i : i + n]
        good = np.flatnonzero(~bad)
        digests.append(digest[good])
        owners.append(owner[good])
    return np.concatenate(digests), np.concatenate(owners)


def slots(digests: np.ndarray) -> list[np.ndarray]:
    return [((digests * spread) >> np.uint64(64 - SLOT_BITS)).astype(np.int64) for spread in PROBE_SPREAD[:PROBES]]


def _chunks(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    first, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= CHUNK_CHARACTERS:
            yield first, texts[first : i + 1]
            first, size = i + 1, 0
    if first < len(texts):
        yield first, texts[first:]


def _once_per_text(digests: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((digests, owners))
    digests, owners = digests[order], owners[order]
    again = (digests[1:] == digests[:-1]) & (owners[1:] == owners[:-1])
    kept = np.r_[True, ~again][: len(digests)]
    return digests[kept], owners[kept]


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, texts): in how many texts of the chunk each n-gram occurs."""
    for batch in batches:
        texts, langs = batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist(), dtype=object)
        for first, chunk in _chunks(texts):
            digests, owners = _once_per_text(*grams(chunk))
            for lang in set(langs[first : first + len(chunk)]):
                mine = langs[first : first + len(chunk)] == lang
                gram, n = np.unique(digests[mine[owners]], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(gram), pa.string()), pa.array(gram.view(np.int64)), pa.array(n.astype(np.int64))],
                    ["lang", "gram", "texts"],
                )


class Filters:
    """The languages, most frequent first, and the slots: one 64-bit word of bits per 64 languages."""

    def __init__(self, languages: list[str], table: np.ndarray):
        self.languages, self.table = languages, table
        bits = [(table[i // 64] >> np.uint64(i % 64)) & np.uint64(1) for i in range(len(languages))]
        self.false_positive = np.array([float(b.mean()) ** PROBES for b in bits])

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language and its share of the evidence, per text."""
        digests, owners = grams(texts)
        counts = np.zeros((len(self.languages), len(texts)))
        total = np.maximum(np.bincount(owners, minlength=len(texts)), 1)
        where = slots(digests)
        for word in range(len(self.table)):
            masks = self.table[word][where[0]]
            for at in where[1:]:
                masks &= self.table[word][at]
            for i in range(64 * word, min(64 * word + 64, len(self.languages))):
                hit = (masks >> np.uint64(i % 64)) & np.uint64(1)
                counts[i] = np.bincount(owners, weights=hit, minlength=len(texts))
        false = self.false_positive[:, None]
        share = np.maximum((counts / total - false) / np.maximum(1 - false, 1e-9), 0)
        best = share.argmax(axis=0)
        mass = share.sum(axis=0)
        top = share[best, np.arange(len(texts))]
        return best, np.where(mass > 0, top / np.where(mass > 0, mass, 1), 1 / len(self.languages))


def fit_filters(docs: DataFrame, sample_per_language: int = SAMPLE_PER_LANGUAGE) -> Filters | None:
    """Filters from about ``sample_per_language`` training texts of each language; None without any."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("doc_id", 4, 2)).select("doc_id", "text", "lang")
    counts = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return None
    languages = sorted(counts, key=lambda name: (-counts[name], name))
    share = F.lit(0)
    for name, n in counts.items():
        share = F.when(F.col("lang") == name, int(min(1.0, sample_per_language / n) * (1 << 20))).otherwise(share)
    chosen = known.where(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 20)) < share)
    sample = stored(chosen.select("text", "lang"))
    sizes = {r.lang: r["count"] for r in sample.groupBy("lang").count().collect()}
    gram_counts = sample.mapInArrow(_gram_counts, "lang string, gram bigint, texts bigint").groupBy("lang", "gram").agg(F.sum("texts").alias("texts"))
    number, least = F.lit(0), F.lit(float(LEAST_TEXTS))
    for i, name in enumerate(languages):
        number = F.when(F.col("lang") == name, i).otherwise(number)
        texts = sizes.get(name, 1)
        least = F.when(F.col("lang") == name, float(max(min(LEAST_TEXTS, texts), LEAST_SHARE * texts))).otherwise(least)

    def to_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in slots(batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at)], ["number", "slot"])

    kept = gram_counts.where(F.col("texts") >= least).select(number.alias("number"), "gram")
    filled = kept.mapInArrow(to_slots, "number int, slot bigint").groupBy((F.expr("number div 64")).alias("word"), "slot")
    rows = filled.agg(F.expr("bit_or(shiftleft(1L, number % 64))").alias("bits")).toArrow()
    table = np.zeros(((len(languages) + 63) // 64, 1 << SLOT_BITS), dtype=np.uint64)
    columns = [rows.column(c).to_numpy() for c in ("word", "slot", "bits")]
    table[columns[0].astype(np.int64), columns[1].astype(np.int64)] = columns[2].astype(np.int64).view(np.uint64)
    return Filters(languages, table)


def predict_languages(docs: DataFrame, filters: Filters | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document.

    ``und`` with score 0 for a null text, one without a letter, or when nothing could be learned.
    Repeated rows and null keys are rows like others.
    """
    has_letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = docs.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), F.when(has_letter, F.col("text")).alias("text"))
    if filters is None:
        return rows.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array(shared.value.languages, dtype=object)
        for batch in batches:
            texts = batch.column(2).to_pylist()
            known = [i for i, t in enumerate(texts) if t is not None]
            lang, score = np.full(len(texts), UNKNOWN, dtype=object), np.zeros(len(texts))
            for first, chunk in _chunks([texts[i] for i in known]):
                at = known[first : first + len(chunk)]
                best, share = shared.value.scores(chunk)
                lang[at], score[at] = names[best], share
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(list(lang), pa.string()), pa.array(score)],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(task, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
