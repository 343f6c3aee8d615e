"""Every registered query of the library and its SQL twin."""

from __future__ import annotations

import importlib
from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}
FLAGSHIP = "slice_orf_gff3"
MODULES = ("sequence_queries", "interval_queries", "gene_queries", "track_queries", "metric_queries", "source_queries", "quality_queries", "store_queries")


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a function of (spark, sf_dir) under `name`, with the DuckDB text for the same rows."""

    def add(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def load() -> None:
    for module in MODULES:
        importlib.import_module(f"strandloom.plans.{module}")
