"""All queries of the engine and their DuckDB counterparts."""

from __future__ import annotations

import importlib

from .base import ORACLES, QUERIES

_MODULES = ("scans", "filters", "joins", "aggregates", "windows", "ranking", "scalars", "vectors", "sequences", "diagnostics", "services")


def _load() -> None:
    for name in _MODULES:
        importlib.import_module(f"{__package__}.{name}")


def queries() -> dict:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLES)
