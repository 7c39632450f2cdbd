"""Adapters by source type. An adapter maps payloads to ``(signals, problems)``."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.sources import feeds, issues, jsonfeed, listings, stories
from rillflow.sources.common import problem

Adapter = Callable[[DataFrame], tuple[DataFrame, DataFrame]]


class Registry:
    """Named functions; names are case-insensitive, unique and not blank."""

    def __init__(self, label: str) -> None:
        self._label = label
        self._known: dict[str, Callable] = {}

    def register(self, name: str, fn: Callable) -> None:
        key = name.strip().lower()
        if not key:
            raise ValueError(f"{self._label} type must not be empty")
        if key in self._known:
            raise ValueError(f"{self._label} type already registered: {key}")
        self._known[key] = fn

    def get(self, name: str) -> Callable:
        key = name.strip().lower()
        if key not in self._known:
            known = ", ".join(self.types) or "none"
            raise ValueError(f"unknown {self._label} type {name!r}; registered: {known}")
        return self._known[key]

    @property
    def types(self) -> tuple[str, ...]:
        return tuple(sorted(self._known))


def default_sources() -> Registry:
    registry = Registry("source")
    registry.register("rss", feeds.normalize)
    registry.register("jsonfeed", jsonfeed.normalize)
    registry.register("hackernews", stories.normalize)
    registry.register("github", issues.normalize)
    registry.register("reddit", listings.normalize)
    return registry


def present_types(payloads: DataFrame, registry: Registry) -> list[str]:
    """Registered types that occur in a batch; at most as many rows as there are adapters."""
    kind = F.lower(F.trim("source_type"))
    rows = payloads.select(kind.alias("t")).filter(F.col("t").isin(*registry.types)).distinct()
    return sorted(r["t"] for r in rows.collect())


def normalize_payloads(
    payloads: DataFrame, registry: Registry, types: Sequence[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Run each registered adapter on its own payload rows and stack the results.

    The type filter reaches the scan, so an adapter reads its own rows only. ``types`` narrows the
    plan to the types known to occur. Rows of an unknown type become errors.
    """
    kind = F.lower(F.trim("source_type"))
    used = [t for t in registry.types if types is None or t in types] or list(registry.types)[:1]
    outputs = [registry.get(t)(payloads.filter(kind == t)) for t in used]
    known = F.coalesce(kind.isin(*registry.types), F.lit(False))
    unknown = problem(
        payloads.filter(~known), "error",
        F.concat(F.lit("unknown source type "), F.coalesce(kind, F.lit("null"))),
    )
    signals = reduce(DataFrame.unionByName, [s for s, _ in outputs])
    problems = reduce(DataFrame.unionByName, [p for _, p in outputs], unknown)
    return signals, problems
