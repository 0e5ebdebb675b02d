"""Queries of the engine and, by the same names, their SQL for an independent check."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL that must give the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


for _topic in ("duplicates", "names", "pieces", "integrity", "likeness", "events"):
    importlib.import_module(f"tidemill.plans.{_topic}")
