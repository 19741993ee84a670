"""Queries by name: each is a function of a session and a folder of tables; most have SQL that gives the same rows."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}
_MODULES: tuple[str, ...] = ("retrieval", "memory", "energy", "gis", "timeline", "streams", "checks", "loading", "stores")


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a function under a name, with the SQL that its rows are held against."""

    def put(f: Query) -> Query:
        if name in _QUERIES and _QUERIES[name].__qualname__ != f.__qualname__:
            raise ValueError(f"two queries named {name}")
        _QUERIES[name] = f
        if oracle:
            _ORACLES[name] = oracle
        return f

    return put


def _load() -> None:
    for module in _MODULES:
        importlib.import_module(f"quern.plans.{module}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracles() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
