"""Putting feeds, channels and dimensions together."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetfold.functions.columns import null_if_all_null
from fleetfold.operators.ordering import first_per_key
from fleetfold.session import settle

KEY = ["monitor", "timestamp"]


def merge_feeds(
    cloud: DataFrame,
    card: DataFrame,
    value: str,
    how: str = "full",
    label: str = "winner",
    derive_calendar: bool = False,
    unique: bool = True,
) -> DataFrame:
    """Merge the cloud feed with memory-card readings, the cloud value first.

    ``cloud`` has monitor, timestamp, date, hour, ``value`` and perhaps source; ``card`` has
    monitor, timestamp_iso, ``value`` and perhaps source.

    ``how="full"`` keeps card-only rows (their date and hour stay null unless
    ``derive_calendar``), ``how="left"`` drops them. ``label="winner"`` names the feed the value
    came from, ``label="source"`` coalesces the two source columns.

    ``unique`` states that both feeds hold a key once (as after ``first_per_key``); one join then
    does. Otherwise the merge is assembled from an inner and two anti joins, all of which AQE can
    split when one key is hot, unlike an outer join.
    """
    if how not in ("full", "left"):
        raise ValueError(how)
    source = "source" if "source" in cloud.columns else F.lit(None).cast("string")
    card_source = "source" if "source" in card.columns else F.lit("sd_card")
    left = cloud.select(
        *KEY, "date", "hour", F.col(value).alias("_cloud"), _named(source, "_cloud_source")
    )
    right = card.select(
        "monitor",
        F.col("timestamp_iso").alias("timestamp"),
        F.col(value).alias("_card"),
        _named(card_source, "_card_source"),
    )
    if unique:
        joined = left.join(right, KEY, how)
    else:
        parts = [
            left.join(right, KEY, "inner"),
            left.join(right.select(*KEY).distinct(), KEY, "left_anti"),
        ]
        if how == "full":
            parts.append(right.join(left.select(*KEY).distinct(), KEY, "left_anti"))
        joined = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    if label == "winner":
        named = F.when(F.col("_cloud").isNotNull(), "cloud").when(
            F.col("_card").isNotNull(), F.lit("sd_card")
        )
    else:
        named = F.coalesce("_cloud_source", "_card_source")
    if derive_calendar:
        day, hour = F.to_date("timestamp"), F.hour("timestamp")
    else:
        day, hour = F.col("date"), F.col("hour")
    return joined.select(
        *KEY,
        day.alias("date"),
        hour.alias("hour"),
        F.coalesce("_cloud", "_card").alias(value),
        named.alias("source"),
    )


def _named(column: Column | str, name: str) -> Column:
    return (F.col(column) if isinstance(column, str) else column).alias(name)


def combine_channels(
    channels: Mapping[str, DataFrame],
    keys: Sequence[str],
    extra: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Full outer join of one-channel tables on ``keys``, written as one union and one grouping.

    Each table holds a key once, so the outer-join chain of n tables equals a conditional maximum
    per channel: one shuffle with map-side combine instead of n - 1 joins. A second value of a
    channel under one key is an error, never mixed. Grouping matches null keys with each other, as
    the natural join does.
    """
    keys = list(keys)
    names = list(channels)
    stacked = reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True), list(channels.values())
    )

    def only(name: str) -> Column:
        repeated = F.raise_error(F.lit(f"channel {name} has several values under one key"))
        return F.when(F.count(name) > 1, repeated).otherwise(F.max(name)).alias(name)

    return stacked.groupBy(*keys).agg(
        *[only(n) for n in names],
        *[c.alias(n) for n, c in (extra or {}).items()],
    )


def combine_with_any_source(channels: Mapping[str, DataFrame]) -> DataFrame:
    """Channels side by side per (monitor, timestamp); the source is that of the first channel
    that knows one."""
    tagged = {
        name: df.select(*KEY, name, F.col("source").alias(f"_source_{name}"))
        for name, df in channels.items()
    }
    sources = {f"_source_{n}": F.max(f"_source_{n}") for n in channels}
    wide = combine_channels(tagged, KEY, sources)
    return wide.select(
        *KEY, *channels, F.coalesce(*[f"_source_{n}" for n in channels]).alias("source_any")
    )


def combine_naturally(channels: Mapping[str, DataFrame]) -> DataFrame:
    """Natural full join including date, hour and source: rows split where the sources differ."""
    keys = ["monitor", "timestamp", "date", "hour", "source"]
    wide = combine_channels({n: df.select(*keys, n) for n, df in channels.items()}, keys)
    names = list(channels)
    return wide.select(
        *keys[:-1], *names, null_if_all_null("source", names).alias("source")
    )


def left_join_summaries(
    base: DataFrame, others: Sequence[DataFrame], keys: Sequence[str]
) -> DataFrame:
    """Add the columns of further summaries to ``base``; all joins share one partitioning."""
    return reduce(lambda a, b: a.join(b, list(keys), "left"), others, base)


def restrict_to(df: DataFrame, roster: DataFrame, key: str = "monitor") -> DataFrame:
    """Rows of the roster's keys; the roster is settled, so that few keys never shuffle the rows."""
    return df.join(settle(roster.select(key).distinct()), key, "left_semi")


def new_monitors(df: DataFrame, roster: DataFrame, start, end) -> DataFrame:
    """Monitors that report in the window but are not on the roster."""
    seen = df.where(F.col("date").between(F.lit(start), F.lit(end))).select("monitor").distinct()
    return seen.join(roster.select("monitor").distinct(), "monitor", "left_anti")


def with_missing_monitors(inventory: DataFrame, roster: DataFrame) -> DataFrame:
    """Add a row with null in every other column for roster monitors without any entry."""
    absent = roster.select("monitor").distinct().join(
        inventory.select("monitor").distinct(), "monitor", "left_anti"
    )
    return inventory.unionByName(absent, allowMissingColumns=True)


def valid_since(df: DataFrame, starts: DataFrame, start: str = "start_date") -> DataFrame:
    """Drop rows from before the start of a monitor; monitors without a start keep all rows."""
    joined = df.join(settle(starts.select("monitor", start)), "monitor", "left")
    return joined.where((F.col("date") >= F.col(start)) | F.col(start).isNull()).drop(start)


def fill_from_same_site(sites: DataFrame, replacements: DataFrame) -> DataFrame:
    """Take missing position and population from the site a monitor replaced.

    ``replacements`` maps description to base_description; the provenance of a position that was
    filled this way becomes 'matched_to_same_site'.
    """
    facts = ["households", "population", "geo_lat", "geo_lon"]
    lookup = first_per_key(sites, ["description"], [F.col("monitor")]).select(
        F.col("description").alias("base_description"),
        *[F.col(c).alias(f"_ref_{c}") for c in facts],
    )
    based = sites.join(replacements, "description", "left").withColumn(
        "base_description", F.coalesce("base_description", "description")
    )
    filled = based.join(lookup, "base_description", "left")
    placed = F.coalesce("geo_lat", "_ref_geo_lat").isNotNull() & F.coalesce(
        "geo_lon", "_ref_geo_lon"
    ).isNotNull()
    moved = F.col("coord_source").isNull() & placed & (
        F.col("description") != F.col("base_description")
    )
    return filled.select(
        *[
            F.coalesce(c, f"_ref_{c}").alias(c)
            if c in facts
            else F.when(moved, "matched_to_same_site").otherwise(F.col(c)).alias(c)
            if c == "coord_source"
            else F.col(c)
            for c in sites.columns
        ]
    )


def override_positions(
    sites: DataFrame, fixes: Mapping[str, tuple[float, float, str]]
) -> DataFrame:
    """Hand-entered positions for single monitors, used only where nothing is known."""
    lat, lon, origin = F, F, F
    for monitor, (fixed_lat, fixed_lon, label) in fixes.items():
        mine = F.col("monitor") == monitor
        lat = lat.when(mine & F.col("geo_lat").isNull(), fixed_lat)
        lon = lon.when(mine & F.col("geo_lon").isNull(), fixed_lon)
        origin = origin.when(mine & F.col("coord_source").isNull(), label)
    return sites.withColumns(
        {
            "geo_lat": lat.otherwise(F.col("geo_lat")),
            "geo_lon": lon.otherwise(F.col("geo_lon")),
            "coord_source": origin.otherwise(F.col("coord_source")),
        }
    )


def stack_batches(
    batches: Sequence[DataFrame], keys: Sequence[str], tie_break: Sequence[Column] = ()
) -> DataFrame:
    """Overlapping batches on top of each other; the earliest batch wins a key."""
    tagged = [b.withColumn("_batch", F.lit(i)) for i, b in enumerate(batches)]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    return first_per_key(stacked, keys, [F.col("_batch"), *tie_break]).drop("_batch")


def full_calendar(
    df: DataFrame, time: str, start: Column, end: Column, step: str, *entity: str
) -> DataFrame:
    """Every monitor (or other entity) at every step between two moments.

    No cross join: each entity explodes the calendar for itself.
    """
    names = entity or ("monitor",)
    steps = F.explode(F.sequence(start, end, F.expr(f"interval {step}")))
    return df.select(*names).distinct().select(*names, steps.alias(time))


def own_calendar(df: DataFrame, time: str, step: str, entity: str = "monitor") -> DataFrame:
    """Every monitor at every step between its own first and last entry."""
    spans = df.groupBy(entity).agg(F.min(time).alias("_first"), F.max(time).alias("_last"))
    steps = F.explode(F.sequence("_first", "_last", F.expr(f"interval {step}")))
    return spans.select(entity, steps.alias(time))


def on_calendar(
    df: DataFrame, calendar: DataFrame, keys: Sequence[str], fill: Mapping[str, object]
) -> DataFrame:
    """Left join to the calendar, with a fill value for what is missing."""
    joined = calendar.join(df, list(keys), "left")
    return joined.fillna(dict(fill)) if fill else joined
