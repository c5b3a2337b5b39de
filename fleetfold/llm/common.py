"""Column helpers and stored intermediate tables shared by the text operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetfold.session import shared_folder

# fixed values: the separators of the contracts, as Java patterns
BLANKS = r"[\x20\x09-\x0D]+"
NOT_ALNUM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# the only characters beyond ASCII whose lower case holds an ASCII letter
KELVIN_SIGN, DOTTED_I = "K", "İ"


def whole_text(column: str = "text") -> Column:
    """The text, an empty one for null."""
    return F.coalesce(F.col(column), F.lit(""))


def blank_words(text: Column) -> Column:
    """Maximal runs of characters other than ASCII blanks."""
    return F.array_remove(F.split(text, BLANKS), "")


def lowered(text: Column) -> Column:
    """Lower case of A-Z; letters beyond ASCII may change too, but never into an ASCII letter."""
    shielded = F.replace(F.replace(text, F.lit(KELVIN_SIGN), F.lit("ķ")), F.lit(DOTTED_I), F.lit("î"))
    return F.lower(shielded)


def alnum_words(text: Column) -> Column:
    """Maximal runs of digits, lower-cased letters and characters beyond ASCII."""
    return F.array_remove(F.split(lowered(text), NOT_ALNUM), "")


def text_keys(text: Column) -> list[Column]:
    """Two independent 64-bit digests that stand for the text in joins and groupings."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("second"), text).alias("k2")]


@contextmanager
def _shuffle_files_removed(spark: SparkSession) -> Iterator[None]:
    """Queries run in this block remove their shuffle files when they end, instead of when the driver collects garbage."""
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "true")
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def stored(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage and gives the planner the true size.

    The written table replaces the shuffles that led to it, so their files are removed at once.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}"
    with _shuffle_files_removed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_rows(df: DataFrame) -> DataFrame:
    """``stored`` plus ``row_file`` and ``row_at``, which name each stored row for good."""
    kept = stored(df)
    return kept.select("*", F.col("_metadata.file_name").alias("row_file"), F.col("_metadata.row_index").alias("row_at"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _hashable(name: str, kind: str) -> Column:
    """The column in a form that has a digest: maps by their sorted entries, deeper ones by their text."""
    column = F.col(f"`{name}`")
    if "map<" not in kind:
        return column
    if kind.startswith("map<") and kind.count("map<") == 1:
        return F.array_sort(F.map_entries(column))
    return F.to_json(F.struct(column))


def row_keys(df: DataFrame) -> list[Column]:
    """Two independent 64-bit digests of a whole row, nulls told apart; equal rows share them."""
    columns = [_hashable(*c) for c in df.dtypes]
    nulls = F.concat(*(F.when(c.isNull(), "0").otherwise("1") for c in columns))
    return [F.xxhash64(nulls, *columns).alias("row_x1"), F.xxhash64(F.lit("second"), nulls, *columns).alias("row_x2")]


def distinct_rows(df: DataFrame) -> DataFrame:
    """(whole_row, row_x1, row_x2): one of each set of equal rows; equal rows meet before the shuffle.

    The columns of ``df`` are packed into one struct, so that no name of theirs clashes with others.
    """
    packed = F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("whole_row")
    return df.select(packed, *row_keys(df)).dropDuplicates(["row_x1", "row_x2"])


def held_out(key: str, parts: int, part: int) -> Column:
    """True where the checksum of the key's text falls on ``part``; a null key is never held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % parts == part, F.lit(False))


def bounded_sample(df: DataFrame, key: str, bound: int) -> DataFrame:
    """About ``bound`` rows at most, chosen by a digest of ``key``; all rows if there are fewer."""
    share = min(1.0, bound / max(1, df.count()))
    return df.where(F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(1 << 20)) < int(share * (1 << 20)))


def training_labels(labels: DataFrame, label: str, bound: int) -> DataFrame:
    """(label_doc, label): one row per labelled document outside the held-out part, a bounded sample."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out("doc_id", 5, 0))
    one_each = known.groupBy(F.col("doc_id").alias("label_doc")).agg(F.max(label).alias("label"))
    return stored(bounded_sample(one_each, "label_doc", bound))
