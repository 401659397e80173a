"""Every query of the engine by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Mark a (spark, sf_dir) function as a query, with its SQL where SQL can say it."""

    def put(f: Callable[[SparkSession, str], DataFrame]):
        if name in _QUERIES:
            raise ValueError(f"{name} is registered twice")
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return put


def _load() -> None:
    from .queries import contents, evaluation, graphs, ingest, ranking, reports, texts  # noqa: F401


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine top-k of each hundredth vector."""
    return queries()["cosine_topk"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
