"""All queries over the driver's tables, by name, with their DuckDB twins."""

from __future__ import annotations

from . import detection, graphs, profiling, scoring, store, streams, tokenisation
from .common import Query

MODULES = [detection, tokenisation, profiling, graphs, scoring, store, streams]


def queries() -> dict[str, Query]:
    return {name: query for module in MODULES for name, query in module.registry.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.registry.oracles.items()}
