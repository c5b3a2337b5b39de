"""Run settings of the pipelines, kept on the driver."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from dataclasses import dataclass, field


@dataclass(frozen=True)
class RollupRules:
    """How complete an hour, a day and the fleet must be before a mean is reported."""

    min_minutes_per_hour: int = 45
    min_hours_per_day: int = 18
    min_active_monitors: int = 10


@dataclass(frozen=True)
class FitRules:
    """Which colocation regressions are good enough to be used."""

    min_active_monitors: int = 3
    min_points: int = 1000
    min_r2: float = 0.7


@dataclass(frozen=True)
class Window:
    """A colocation period; ``group`` names the fleet group that took part."""

    name: str
    start: dt.date
    end: dt.date
    group: str | None = None
    reference_monitor: str | None = None


@dataclass(frozen=True)
class GasRules:
    reference_monitor: str
    start: dt.date
    end: dt.date
    gases: tuple[str, ...] = ("co", "no", "no2", "o3")
    min_points: int = 500
    min_r2: float = 0.5


@dataclass(frozen=True)
class Settings:
    fit: FitRules = field(default_factory=FitRules)
    windows: tuple[Window, ...] = ()
    gas: GasRules | None = None

    def window(self, name: str) -> Window:
        hits = [w for w in self.windows if w.name == name]
        if len(hits) != 1:
            raise KeyError(f"window {name!r} occurs {len(hits)} times in the settings")
        return hits[0]


def _day(value) -> dt.date:
    return value if isinstance(value, dt.date) else dt.date.fromisoformat(str(value))


def settings_from_mapping(raw: Mapping) -> Settings:
    """Build settings from the nested mapping a YAML file loads to."""
    gas = raw.get("gas_calibration")
    return Settings(
        fit=FitRules(**raw.get("thresholds", {})),
        windows=tuple(
            Window(
                name=w["name"],
                start=_day(w["start"]),
                end=_day(w["end"]),
                group=w.get("monitors"),
                reference_monitor=w.get("reference_monitor"),
            )
            for w in raw.get("colocation_windows", ())
        ),
        gas=None
        if gas is None
        else GasRules(
            reference_monitor=gas["reference_monitor"],
            start=_day(gas["window_start"]),
            end=_day(gas["window_end"]),
            gases=tuple(gas.get("gases", GasRules.gases)),
            **gas.get("thresholds", {}),
        ),
    )


def settings_from_yaml(path: str) -> Settings:
    import yaml

    with open(path, encoding="utf-8") as handle:
        return settings_from_mapping(yaml.safe_load(handle))
