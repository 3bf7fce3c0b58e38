"""All queries of the library with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import config, decisions, flows, gauges, scalars, views

_ALL = (views.QUERIES, decisions.QUERIES, flows.QUERIES, config.QUERIES, gauges.QUERIES, scalars.QUERIES)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for group in _ALL for name, (f, _) in group.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for group in _ALL for name, (_, sql) in group.items() if sql}
