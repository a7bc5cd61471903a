"""Registered queries over the driver tables, each with its SQL counterpart where one exists."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
MODULES = ("sites", "contacts", "companies", "results", "pages", "people", "leads", "metrics", "streams", "surface")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with the DuckDB SQL that must give the same rows."""
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn
    return register


def load() -> None:
    for m in MODULES:
        importlib.import_module(f"leadloom.plans.{m}")
