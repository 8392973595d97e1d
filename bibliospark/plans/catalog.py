"""Registry of named queries: a Spark builder plus, where SQL can express it,
the DuckDB oracle statement that must return the same rows.

Every builder takes ``(spark, base_dir)`` and reads the landed tables under
``base_dir`` in full; nothing is sampled or capped except where a limit is the
feature itself (the top-10 reports, the top-k retrieval).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFn] = {}
_ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        _QUERIES[name] = fn
        if sql is not None:
            _ORACLES[name] = sql
        return fn
    return deco


def _load_all() -> None:
    # importing the modules registers their queries
    from . import q_reports, q_retrieval, q_messages, q_etl, q_layout  # noqa: F401


def queries() -> dict[str, QueryFn]:
    _load_all()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load_all()
    return dict(_ORACLES)
