"""Every query of the package by name, with its DuckDB twin where SQL can express it."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from codeloom.plans import registry

PLANS = ("store", "search", "metrics", "imports", "events", "signals", "review", "chunking", "recovery", "tree", "tools")


def _load() -> None:
    for name in PLANS:
        importlib.import_module(f"codeloom.plans.{name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(registry.SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents to line windows to terms to BM25 for a benchmark passage, with relative scores and ranks."""
    return queries()["i3_bm25_search"](spark, sf_dir)
