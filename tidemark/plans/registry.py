"""All registered queries and their SQL oracles, gathered from the query modules."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

FLAGSHIP = "w01_as_of_pick"

#: Modules of this package that hold QUERIES (name -> function) and ORACLE (name -> SQL).
MODULES = ("q_temporal", "q_tree", "q_dedupe", "q_sync", "q_catalog", "q_functions", "q_changes", "q_sources")


def _modules():
    return [importlib.import_module(f"tidemark.plans.{name}") for name in MODULES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for module in _modules():
        found |= module.QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for module in _modules():
        found |= module.ORACLE
    return found
