"""All queries of the library over the driver's tables, with their DuckDB twins."""

from __future__ import annotations

from archivolt.plans import aggregates, arrivals, classes, increments, joins, resolution, scalars

_MODULES = (aggregates, joins, scalars, classes, resolution, increments, arrivals)

QUERIES: dict = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLES: dict[str, str] = {name: text for m in _MODULES for name, text in m.ORACLES.items() if text}
