"""Scalar cleaning, labelling and correction columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Device ids carry their class, the analyser class has gas channels, the PM class not.
PM_DEVICE = "MOD-PM"
GAS_DEVICE_PATTERN = "^MOD-[^P]"
PLAIN_DEVICE_PATTERN = r"^MOD-\d+$"
DEVICE_ID_PATTERN = r"MOD(?:-PM)?-\d+"
FOLDER_ID_PATTERN = r"MOD(?:_PM)?_\d{4,5}"

# Upper bounds (exclusive) of the air quality classes for PM2.5.
AQI_CLASSES = (
    (9.0, "Good"),
    (35.4, "Moderate"),
    (55.4, "Unhealthy for Sensitive Groups"),
    (125.4, "Unhealthy"),
    (225.4, "Very Unhealthy"),
)
AQI_LAST = "Hazardous"


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def nan_to_null(value: Column | str) -> Column:
    value = as_column(value)
    return F.when(~F.isnan(value), value)


def within(
    value: Column | str,
    low: float | None = None,
    high: float | None = None,
    include_low: bool = True,
    include_high: bool = True,
) -> Column:
    """Plausibility test; null readings fail it, as in a filter."""
    value = as_column(value)
    test = F.lit(True)
    if low is not None:
        test = test & ((value >= low) if include_low else (value > low))
    if high is not None:
        test = test & ((value <= high) if include_high else (value < high))
    return test


def is_gas_device(monitor: Column | str) -> Column:
    return as_column(monitor).rlike(GAS_DEVICE_PATTERN)


def device_class(monitor: Column | str) -> Column:
    return F.when(as_column(monitor).contains(PM_DEVICE), PM_DEVICE).otherwise("MOD")


def canonical_monitor(monitor: Column | str) -> Column:
    """Trim, upper case, typographic dashes and underscores to '-', no blanks inside."""
    cleaned = F.upper(F.trim(as_column(monitor)))
    cleaned = F.translate(cleaned, "‐‑‒–—―_", "-------")
    return F.regexp_replace(cleaned, r"\s+", "")


def monitor_from_path(path: Column | str) -> Column:
    """Device id in a file name, null where there is none."""
    name = F.element_at(F.split(as_column(path), "/"), -1)
    found = F.regexp_extract(name, DEVICE_ID_PATTERN, 0)
    return F.when(found != "", found)


def inverse_linear(value: Column | str, slope: Column | str, intercept: Column | str) -> Column:
    """(value - intercept) / slope with no guard: a missing or zero coefficient gives null."""
    slope = as_column(slope)
    return F.when(slope != 0, (as_column(value) - as_column(intercept)) / slope)


def usable_slope(slope: Column | str) -> Column:
    """Not null, not NaN, finite and not zero."""
    slope = as_column(slope)
    finite = (~F.isnan(slope)) & (F.abs(slope) < F.lit(float("inf")))
    return F.coalesce(finite & (slope != 0), F.lit(False))


def null_below(value: Column | str, minimum: float) -> Column:
    value = as_column(value)
    return F.when(value >= minimum, value)


def clamp_at_zero(value: Column | str) -> Column:
    value = as_column(value)
    return F.when(value.isNotNull(), F.greatest(value, F.lit(0.0)))


def guarded_ratio(numerator: Column | str, denominator: Column | str) -> Column:
    denominator = as_column(denominator)
    return F.when(denominator > 0, as_column(numerator) / denominator)


def null_if_all_null(label: Column | str, channels: Sequence[str]) -> Column:
    """Keep ``label`` only where at least one channel has a value."""
    return F.when(F.coalesce(*channels).isNotNull(), as_column(label))


def aqi_class(value: Column | str) -> Column:
    """Left-closed classes: exactly 9 is already 'Moderate'."""
    value = as_column(value)
    label = F
    for bound, name in AQI_CLASSES:
        label = label.when(value < bound, name)
    return label.when(value.isNotNull(), AQI_LAST)


def significant(value: Column | str, digits: int = 3) -> Column:
    """Round half to even at ``digits`` significant digits."""
    value = as_column(value)
    scale = F.pow(F.lit(10.0), F.lit(digits - 1) - F.floor(F.log10(F.abs(value))))
    return F.when(value == 0, value).otherwise(F.bround(value * scale) / scale)


def repair_position(
    lat: Column | str,
    lon: Column | str,
    lon_fixes: Mapping[float, float],
    digits: int = 4,
) -> tuple[Column, Column]:
    """Replace known wrong longitudes, then round away the jitter of the receiver."""
    lon = as_column(lon)
    fixed = F
    for wrong, right in lon_fixes.items():
        fixed = fixed.when(lon == wrong, right)
    fixed = fixed.otherwise(lon) if lon_fixes else lon
    return F.bround(as_column(lat), digits), F.bround(fixed, digits)


def in_box(lat: Column | str, lon: Column | str, box: tuple[float, float, float, float]) -> Column:
    south, north, west, east = box
    return as_column(lat).between(south, north) & as_column(lon).between(west, east)


def clean_place(name: Column | str, spelling: Mapping[str, str]) -> Column:
    """Drop a bracketed suffix, title-case, then apply the given spellings."""
    cleaned = F.initcap(F.regexp_replace(as_column(name), r" \(.*$", ""))
    if not spelling:
        return cleaned
    fixed = F
    for wrong, right in spelling.items():
        fixed = fixed.when(cleaned == wrong, right)
    return fixed.otherwise(cleaned)


def road_group(highway: Column | str) -> Column:
    """Fixed grouping of road classes used by the regressions."""
    highway = as_column(highway)
    return (
        F.when(highway.isin("secondary", "trunk", "tertiary"), "City Connection")
        .when(highway == "residential", "Residential")
        .otherwise("Other")
    )


def outside_range(value: Column | str, low: Column, high: Column) -> Column:
    value = as_column(value)
    return value.isNotNull() & ((value < low) | (value > high))


def adc_value(low_bits: Column | str, high_bits: Column | str, channel: int) -> Column:
    """10-bit reading of ``channel`` (1..4): eight high bits plus two bits packed in ``low_bits``."""
    low = F.shiftright(as_column(low_bits), 2 * (channel - 1)).bitwiseAND(F.lit(3))
    return as_column(high_bits) * 4 + low


def adc_volts(adc: Column | str) -> Column:
    return as_column(adc) * 10 / 1024
