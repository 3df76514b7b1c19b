"""All registered queries of the engine, and the SQL that states the same result."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with its SQL where there is any."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


for _name in ("analytics", "process", "profile", "records", "text", "vectors", "decisions", "splits", "composites", "sources", "artefacts", "estimators", "streams", "selection", "trained", "protocols", "workflow", "evidence"):
    importlib.import_module(f"halyard.plans.{_name}")
