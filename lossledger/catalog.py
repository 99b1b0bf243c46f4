"""Registry of named queries: key -> (Spark builder, DuckDB oracle SQL or None).

A Spark builder takes a Context and returns a lazy DataFrame; the oracle
SQL runs in DuckDB over the same parquet tables. Keys without SQL are
checked against brute-force expectations in tests instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from lossledger.plans import reports as R

Builder = Callable[..., DataFrame]

_REGISTRY: dict[str, Builder] = {}
_ORACLE: dict[str, str] = {}


def register(key: str, builder: Builder, sql: str | None = None) -> None:
    _REGISTRY[key] = builder
    if sql is not None:
        _ORACLE[key] = sql


def _load() -> None:
    if _REGISTRY:
        return
    from lossledger.oracle.reports import REPORTS
    for key in REPORTS:
        register(key, getattr(R, key), REPORTS[key])
    from lossledger import catalog_more  # noqa: F401  (registers the remaining operators)


def builders() -> dict[str, Builder]:
    _load()
    return dict(_REGISTRY)


def oracle() -> dict[str, str]:
    _load()
    return dict(_ORACLE)
