"""How queries are registered, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from ..sources.task_log import LOG_SQL, dim_sql


def registry(queries: dict) -> Callable:
    """The decorator that puts queries into `queries`: the SQL twin follows the log and the named policy tables."""

    def query(sql: str | None = None, *dims: str):
        def add(f):
            head = ", ".join([LOG_SQL, *([dim_sql(*dims)] if dims else [])])
            queries[f.__name__] = (f, f"WITH {head}{sql}" if sql and sql.startswith(",") else f"WITH {head} {sql}" if sql else None)
            return f

        return add

    return query
