"""The hook for user code: a task handler applied to messages batch by batch."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class HandlerError(Exception):
    """Raised by a handler to say how its task failed."""

    def __init__(self, failure_class: str, message: str = ""):
        super().__init__(message)
        self.failure_class = failure_class


def apply_handlers(messages: DataFrame, handlers: dict[str, Callable[[str, bytes], None]]) -> DataFrame:
    """Runs the handler of each message's name (id, name, payload) and returns id, ok, failure_class, error. Names without a handler succeed."""

    @F.pandas_udf("ok boolean, failure_class string, error string")
    def handle(name: pd.Series, task: pd.Series, payload: pd.Series) -> pd.DataFrame:
        out = []
        for n, t, p in zip(name, task, payload, strict=True):
            try:
                handlers.get(n, lambda *_: None)(t, p)
                out.append((True, "", ""))
            except HandlerError as e:
                out.append((False, e.failure_class, str(e)))
            except TimeoutError as e:
                out.append((False, "timeout", str(e)))
            except Exception as e:  # any other failure of user code is worth a retry
                out.append((False, "transient_retryable", str(e)))
        return pd.DataFrame(out, columns=["ok", "failure_class", "error"])

    return messages.select("id", handle("name", "id", "payload").alias("r")).select("id", "r.*")
