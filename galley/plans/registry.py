"""Queries by name: an operator bound to the views, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .views import Views, with_views

QUERIES: dict[str, Callable[[Views], DataFrame]] = {}
SQL: dict[str, str] = {}


def bind(name: str, run: Callable[[Views], DataFrame], sql: str | None = None, views: bool = True) -> None:
    """views: whether the SQL names views that are still to be put before it."""
    if name in QUERIES:
        raise ValueError(f"{name} is bound twice")
    QUERIES[name] = run
    if sql:
        SQL[name] = with_views(sql) if views else sql


def _query(run: Callable[[Views], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: run(Views(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _query(run) for name, run in QUERIES.items()}
