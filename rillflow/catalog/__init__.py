"""Registered queries: every operator over the provided tables, with the same result in ANSI SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
MODULES = ("flagship", "writing", "running", "asking", "normalising", "polling", "checking", "flowing")


def catalog() -> dict[str, tuple[Query, str | None]]:
    """Query function and SQL (None where SQL cannot say it) by name."""
    out: dict[str, tuple[Query, str | None]] = {}
    for name in MODULES:
        module = importlib.import_module(f"rillflow.catalog.{name}")
        for key, entry in module.QUERIES.items():
            if key in out:
                raise ValueError(f"query registered twice: {key}")
            out[key] = entry
    return out
