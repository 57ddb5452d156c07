"""Query registry: one entry per operator, with its SQL counterpart where SQL can say it."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from regionloom.catalog.views import Tables, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

MODULES = ["aggregates", "sets", "joins", "transforms", "link_joins", "states", "motifs", "ordering", "statistics",
           "reporter", "scans"]


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name`` with the SQL that gives the same rows."""
    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"{name} registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn
    return wrap


def load() -> None:
    for module in MODULES:
        importlib.import_module(f"regionloom.catalog.{module}")
