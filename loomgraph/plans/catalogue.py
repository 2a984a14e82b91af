"""All registered queries of the library with their DuckDB equivalents."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Modules of loomgraph.plans with QUERIES and ORACLE_SQL.
MODULES: tuple[str, ...] = ("q_graph", "q_temporal", "q_quality", "q_context", "q_exchange", "q_decisions", "q_text", "q_more", "q_mentions", "q_links", "q_clusters", "q_hierarchy", "q_chunks", "q_monitor", "q_hybrid")


def _modules():
    return [importlib.import_module(f"loomgraph.plans.{name}") for name in MODULES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in _modules() for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for m in _modules() for k, sql in m.ORACLE_SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resolved entities: duplicate names of one brand found, grouped and merged."""
    return queries()["merged_entities"](spark, sf_dir)
