"""Histories replayed in order, key by key, in one pass over sorted rows: linear in the rows, and no history is held in memory."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame


def replay(rows: DataFrame, key: str, order: list[str], begin: Callable[[], dict], step: Callable[[dict, dict], tuple], schema: str, names: list[str]) -> DataFrame:
    """For each row, in `order` within its key, what step(state, row) returns; `begin` makes the state of a key. Each key's rows pass one task."""

    def run(batches):
        at, state = None, {}
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if at is None or row[key] != at[0]:
                    at, state = (row[key],), begin()
                out.append((row[key], *step(state, row)))
            columns = zip(*out, strict=True) if out else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)
