"""The opN_* queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Modules that register queries; each has QUERIES and may have ORACLE_SQL.
MODULES = tuple(f"op{n}" for n in range(1, 14))


def _modules():
    return [importlib.import_module(f"loomgraph.llm.q_{name}") for name in MODULES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in _modules() for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for m in _modules() for k, sql in getattr(m, "ORACLE_SQL", {}).items()}
