"""Every query of the library by name, and its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lamella.plans import construction, decisions, extensions, lifecycle, operations, retrieval, textual, versioned, workflow

MODULES = (retrieval, lifecycle, operations, workflow, textual, construction, extensions, versioned, decisions)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.oracle_sql().items()}
