"""All queries of the library over the test tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register a ``(spark, sf_dir) -> DataFrame`` function, with its DuckDB SQL if there is one."""

    def keep(f: Callable) -> Callable:
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return _SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["flagship_label_imbalance"](spark, sf_dir)


def _load() -> None:
    """Modules register their queries when they are imported."""
    from msgloom.plans import augment_queries, eval_queries, io_queries, quality_queries, text_queries, traffic_queries  # noqa: F401

