"""Collects the registered queries and their SQL from the catalog modules."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
MODULES = ("text", "labels", "dedupe", "sources", "provenance", "splits", "stats", "features", "scoring",
           "thresholds", "fitting", "streams", "metadata")


class Catalog:
    """A family of queries; ``add`` takes the query and, where there is one, its SQL."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def register(query: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"query {name} registered twice")
            self.queries[name] = query
            if sql is not None:
                self.oracles[name] = sql
            return query
        return register


def _families() -> list[Catalog]:
    return [import_module(f"tagloom.catalog.{m}").CATALOG for m in MODULES]


def queries() -> dict[str, Query]:
    return {name: q for family in _families() for name, q in family.queries.items()}


def oracles() -> dict[str, str]:
    return {name: q for family in _families() for name, q in family.oracles.items()}
