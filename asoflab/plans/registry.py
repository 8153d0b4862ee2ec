"""Named queries and the SQL that states the same result.

Modules of asoflab.plans call ``query(name, sql)`` as a decorator at import;
``queries()`` and ``oracle_sql()`` import them all.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_MODULES = ("features", "joins", "market", "research", "texts", "more", "rest", "deeper", "trading", "studies", "linking", "replays", "correlations", "callable", "scans", "statements", "decisions", "slices")
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(function: Query) -> Query:
        if name in _queries:
            raise ValueError(f"query {name} is registered twice")
        _queries[name] = function
        if sql:
            _sql[name] = sql
        return function

    return keep


def _load() -> None:
    for name in _MODULES:
        importlib.import_module(f"asoflab.plans.{name}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_sql)
