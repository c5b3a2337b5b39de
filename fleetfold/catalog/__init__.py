"""Named queries over the sample tables, each with an equivalent SQL text where there is one."""

from __future__ import annotations


def _load() -> None:
    """Import the modules that register queries."""
    from fleetfold.catalog import aggregates, jobs, joins, modelling, scalars, sources  # noqa: F401


def all_queries() -> dict:
    from fleetfold.catalog.registry import QUERIES

    _load()
    return dict(sorted(QUERIES.items()))


def all_oracles() -> dict[str, str]:
    from fleetfold.catalog.registry import ORACLES

    _load()
    return dict(sorted(ORACLES.items()))
