"""Mix of sources to target weights, cut at the exact word budget of each source.

Documents get hash-random keys; within each source they are range-sorted by the key, running sums of
their sizes are distributed, and each source is cut where its budget ends, after as many whole epochs
as the budget holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetfold.llm.common import blank_words, distinct_rows, row_keys, stored, stored_rows, whole_text
from fleetfold.llm.prefix import row_numbers, running_sums

# fixed values: weights of the sources in their order, share of all words, most epochs of a source
WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST_EPOCHS = 2


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS) -> DataFrame:
    """source, source_size, target: budgets by weight; what exceeds ``most`` epochs goes to the others.

    Handing the excess on by weight until none is above its limit ends at one price per unit of
    weight, which rises from round to round; each round is one aggregation over the sources.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = [F.col("source").isNull(), F.col("source")]
    ranked = row_numbers(sources, order, "rank")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights)).cast("int") + 1)
    priced = stored(ranked.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * float(most)).alias("limit")))
    total = priced.agg(F.sum("source_size")).first()[0] or 0
    budget, price, full = share * total, 0.0, -1
    while True:
        above = F.col("limit") < F.col("weight") * F.lit(price)
        sums = priced.agg(
            F.count_if(above).alias("full"),
            F.coalesce(F.sum(F.when(above, F.col("limit"))), F.lit(0.0)).alias("held"),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0)).alias("weight"),
        ).first()
        if sums.full == full or sums.weight == 0:
            break
        full, price = sums.full, max(price, (budget - sums.held) / sums.weight)
    return stored(priced.select("source", "source_size", F.least("limit", F.col("weight") * F.lit(price)).alias("target")))


def mix_words(docs: DataFrame, seed: int = 0, text: str = "text", source: str = "source", key: str = "doc_id", keep: tuple = ()) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, and the columns of ``keep``.

    ``taken`` sums to the whole part of each source's target; the document at the cut is taken in
    part. Null texts count no words, a null source is a source, null and repeated keys are ordered by
    their stored row. An empty table gives an empty result. The same ``seed`` gives the same mix.
    """
    random_key = F.xxhash64(F.lit(seed), F.col(key), F.col(text))
    sized = stored_rows(
        docs.select(
            F.col(key).alias("doc_id"),
            F.col(source).cast("string").alias("source"),
            F.size(blank_words(whole_text(text))).cast("long").alias("size"),
            random_key.alias("random_key"),
            *keep,
        )
    )
    targets = source_targets(sized)
    order = [F.col(c) for c in ("random_key", "doc_id", "row_file", "row_at")]
    summed = running_sums(sized, ["source"], order, {"words_before": "size"})
    quota = targets.select(
        F.col("source").alias("target_source"),
        "source_size",
        "target",
        F.expr("cast(case when source_size > 0 then floor(target) div source_size else 0 end as bigint)").alias("epochs"),
    ).withColumn("part", F.floor("target") - F.col("epochs") * F.col("source_size"))
    left = F.col("part") - F.col("words_before")
    part = F.greatest(F.lit(0).cast("long"), F.least(left, F.col("size")))
    return summed.join(quota, F.col("source").eqNullSafe(F.col("target_source"))).select(
        "doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).alias("taken"), *keep
    )


def mixed(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The documents of the mix, repeated as often as taken; the one at a cut is in if half of it is taken.

    Documents without words take no part. Columns are kept whatever their names and types; repeated rows are
    taken as often as all of them together; an empty table gives an empty result.
    """
    keyed = docs.select(*row_keys(docs), "doc_id", "source", "text")
    taken = mix_words(keyed, seed, keep=("row_x1", "row_x2")).where("taken > 0")
    times = F.floor(F.col("taken") / F.col("size") + 0.5).cast("int")
    copies = stored(taken.groupBy("row_x1", "row_x2").agg(F.sum(times).alias("copies")).where("copies > 0"))
    repeated = distinct_rows(docs).join(copies, ["row_x1", "row_x2"])
    return repeated.select("whole_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("whole_row.*")
