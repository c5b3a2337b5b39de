"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetfold.llm.common import stored


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("least"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    least = down.groupBy("a").agg(F.min("b").alias("least"))
    joined = down.join(least, "a")
    ends = joined.select(F.explode(F.array("a", "b")).alias("a"), F.col("least").alias("b"))
    return ends.where("a > b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b), the root being the smallest node of its component.

    Each round replaces links by links to smaller nodes and is stored; it ends when nothing changes,
    after about log of the longest chain rounds. Self links are ignored.
    """
    now = stored(links.where("a <> b").select("a", "b"))
    seen = None
    while True:
        digest = F.xxhash64("a", "b")
        mark = tuple(now.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))"), F.sum(digest % 1000003)).first())
        if mark == seen or mark[0] == 0:
            break
        seen, now = mark, stored(_small_star(_large_star(now)))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
