"""Quality rules with host verdicts.

Each document is measured in one pass. Failures of each rule are counted by host (the ``source``
column) and the rates are shrunk towards the corpus by a beta prior fitted to the hosts. The rate moves
the limit of the rule: the odds that a document is junk are those of its host times a power of how
near it comes to the limit, so at a host with worse odds than the corpus less is tolerated, by as much as
makes up for the host. A document is rejected if it fails a base rule or any other rule, whatever its
host, if it is beyond the limit of its host, and if most of what its host holds fails: hosts add
verdicts, they never excuse a document, so no rows added to the table can let a failed one through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetfold.llm.common import blank_words, stored, whole_text

SYMBOLS = r"[#*$%&|<>]"
LEAST_WORDS, MOST_REPEATED_PERCENT = 50, 50
# a host is barred by a rule if its shrunken failure rate is above this: most of what it holds fails
BARRED_RATE = 0.5
# the power: how fast the odds rise with a measure; and the share of a limit that every host tolerates
STEEPNESS, LEAST_LIMIT = 4.0, 0.5


def _windows(words: Column) -> Column:
    """64-bit digests of the 3-word windows, in order."""
    last = F.size(words) - 3
    return F.when(
        last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    ).otherwise(F.array().cast("array<bigint>"))


def _by_digest(windows: Column) -> Column:
    """(digest, start) of all windows in the order of the digests if any occurs twice, else none."""
    marked = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), marked)


def _twins(marked: Column) -> Column:
    """Starts, ascending, of the windows whose neighbour in digest order has the same digest."""
    twin = F.filter(marked, lambda m, j: (F.get(marked, j - 1)["h"] == m["h"]) | (F.get(marked, j + 1)["h"] == m["h"]))
    return F.sort_array(F.transform(twin, lambda m: m["i"]))


def _covered(starts: Column) -> Column:
    """Words in windows that start at ``starts``: each adds what the one before it does not cover."""
    step = lambda acc, at: F.struct(
        (acc["n"] + F.least(F.lit(3), at - acc["at"])).cast("long").alias("n"), at.alias("at")
    )
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("at"))
    return F.coalesce(F.aggregate(starts, none, step, lambda acc: acc["n"]), F.lit(0).cast("long"))


def measured(docs: DataFrame, text: str = "text", source: str = "source", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, the host, the counts of the contract and one failure flag per rule.

    A null text has no words. Works row by row, so repeated rows and null keys are rows like others.
    """
    spread = docs.select(*(F.col(c) for c in keep), F.col(source).cast("string").alias("host"), whole_text(text).alias("body"))
    split = spread.select(
        "*",
        blank_words(F.col("body")).alias("words"),
        F.filter(F.split("body", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    # one select per array: what a lambda looks up must be a finished column, or it is built anew per element
    windows = split.select("*", _windows(F.col("words")).alias("windows"))
    sorted_windows = windows.select("*", _by_digest(F.col("windows")).alias("marked"))
    repeated = sorted_windows.select("*", _twins(F.col("marked")).alias("twins"))
    counted = repeated.select(
        *keep,
        "host",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("body", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _covered(F.col("twins")).alias("n_repeat_words"),
    )
    return counted.select(
        "*",
        ((F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))).alias("base_failed"),
        *(rule.alias(f"fails_{name}") for name, rule in _rules().items()),
    )


def _rules(limit=lambda name: F.lit(1)) -> dict[str, Column]:
    """Rules that also count against the host; ``limit`` scales what they tolerate, 1 is the rule itself.

    Products of counts instead of ratios, so that the rule itself is exact.
    """
    symbols, lines, length = (limit(r) for r in ("symbols", "lines", "length"))
    n, chars = F.col("n_words"), F.col("word_chars")
    return {
        "symbols": 10 * F.col("n_symbols") > n * symbols,
        "lines": 10 * F.col("n_dup_lines") > 3 * F.col("n_lines") * lines,
        "length": (chars * length < 2 * n) | (chars > 14 * n * length),
    }


def host_limit(rate: Column, mean: float) -> Column:
    """Share of a rule's limit that a host with this failure rate may reach; never above 1."""
    if mean <= 0 or mean >= 1:
        return F.lit(1.0)
    odds = F.greatest(rate, F.lit(1e-12)) / F.greatest(1 - rate, F.lit(1e-12))
    moved = F.pow(F.lit(mean / (1 - mean)) / odds, F.lit(1 / STEEPNESS))
    return F.least(F.lit(1.0), F.greatest(F.lit(LEAST_LIMIT), moved))


def host_verdicts(rows: DataFrame, barred_rate: float = BARRED_RATE) -> DataFrame:
    """host, documents, and per rule the shrunken failure rate, the limit it leads to and whether it bars the host.

    The prior is fitted by moments: a beta distribution with the mean of the corpus whose variance is the spread
    of the hosts' rates beyond what chance alone gives; without such a spread every host gets the rate
    of the corpus. A null source is a host of its own; an empty table has no hosts.
    """
    names = list(_rules())
    hosts = stored(rows.groupBy("host").agg(F.count("*").alias("n"), *(F.count_if(f"fails_{r}").alias(r) for r in names)))
    totals = hosts.agg(
        F.sum("n").alias("n"), F.count("*").alias("hosts"),
        *(F.sum(r).alias(r) for r in names), *(F.sum(F.col(r) * F.col(r) / F.col("n")).alias(f"{r}_square") for r in names),
    ).first()
    verdicts = [F.col("host").alias("verdict_host"), F.col("n").alias("host_documents")]
    for r in names:
        n = totals.n or 1
        mean = (totals[r] or 0) / n
        spread = max(0.0, (totals[f"{r}_square"] or 0.0) / n - mean * mean)
        chance = mean * (1 - mean) * totals.hosts / n
        between = spread - chance
        if between > 0:
            strength = max(0.0, mean * (1 - mean) - between) / between
            rate = (F.col(r) + F.lit(mean * strength)) / (F.col("n") + F.lit(strength))
        else:
            rate = F.lit(mean)
        verdicts += [rate.alias(f"rate_{r}"), host_limit(rate, mean).alias(f"limit_{r}"), (rate > barred_rate).alias(f"barred_{r}")]
    return stored(hosts.select(*verdicts))


def judged(rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """``rows`` of ``measured`` with their host's verdicts and ``kept``."""
    # a sum over both sides of the join: no part of it moves below the join, where it would be computed twice
    failures = F.col("base_failed").cast("int")
    for r, beyond in _rules(lambda name: F.col(f"limit_{name}")).items():
        failures = failures + (F.col(f"fails_{r}") | beyond | F.col(f"barred_{r}")).cast("int")
    return rows.join(verdicts, F.col("host").eqNullSafe(F.col("verdict_host"))).withColumn("kept", failures == 0)


def quality_by_host(docs: DataFrame, barred_rate: float = BARRED_RATE) -> DataFrame:
    """doc_id, counts, base_failed, kept for every document, repeated rows and null keys included.

    Null and empty texts fail the base rules; an empty table gives an empty result; other columns are not looked at.
    """
    rows = stored(measured(docs))
    return judged(rows, host_verdicts(rows, barred_rate))


def passing(docs: DataFrame, barred_rate: float = BARRED_RATE) -> DataFrame:
    """The documents that are kept, with their own columns whatever their names; texts are measured twice instead of stored."""
    wrapped = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole_row"), "text", "source")
    verdicts = host_verdicts(measured(docs, keep=()), barred_rate)
    return judged(measured(wrapped, keep=("whole_row",)), verdicts).where("kept").select("whole_row.*")
