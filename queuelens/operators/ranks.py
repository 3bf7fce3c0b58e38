"""Positions and last values within a long key, in buckets: no key's rows meet in one task, only its bucket totals do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def positions(rows: DataFrame, keys: list[str], bucket: Column, order: list, name: str = "position") -> DataFrame:
    """Rows with their position (from 1) in `order` within their keys. The bucket must not fall as the order rises; a bucket is ranked by itself
    and starts after what the earlier buckets of its key hold."""
    at = rows.withColumn("__bucket", bucket)
    held = at.groupBy(*keys, "__bucket").agg(F.count("*").alias("__held"))
    before = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("__held").over(before), F.lit(0).cast("long")).alias("__start")
    starts = held.select(*[F.col(k).alias(f"__of_{k}") for k in keys], F.col("__bucket").alias("__of_bucket"), start)
    same = F.col("__bucket") == F.col("__of_bucket")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__of_{k}"))
    joined = at.join(starts, same).drop("__of_bucket", *[f"__of_{k}" for k in keys])
    rank = F.row_number().over(Window.partitionBy(*keys, "__bucket").orderBy(*order))
    return joined.withColumn(name, (F.col("__start") + rank).cast("long")).drop("__bucket", "__start")


def last_before(events: DataFrame, marks: DataFrame, key: str, time: str, value: str, width: int) -> DataFrame:
    """Events with `value` of the last mark (key, time, value) of their key at or before their time, null before the first: an as-of join.

    Events and marks are put together in buckets of `width` and carried forward there; what a bucket starts with is the last mark of the
    buckets before it, of which there is one row each.
    """
    bucket = F.floor(F.col(time) / width).alias("__bucket")
    mine = events.select("*", bucket, F.lit(1).alias("__kind"), F.lit(None).cast("long").alias("__value"))
    theirs = marks.select(key, time, bucket, F.lit(0).alias("__kind"), F.col(value).cast("long").alias("__value"))
    carried = Window.partitionBy(key).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = mine.select(key, "__bucket").distinct().withColumn("__last", F.lit(None).cast("long")).unionByName(theirs.groupBy(key, "__bucket").agg(F.max_by("__value", time).alias("__last")))
    begins = buckets.groupBy(key, "__bucket").agg(F.max("__last").alias("__last")).withColumn("__begin", F.last("__last", True).over(carried)).drop("__last")
    inside = Window.partitionBy(key, "__bucket").orderBy(time, "__kind").rowsBetween(Window.unboundedPreceding, 0)
    both = mine.unionByName(theirs, allowMissingColumns=True).withColumn("__seen", F.last("__value", True).over(inside)).filter("__kind = 1")
    return both.join(begins, [key, "__bucket"], "left").withColumn(value, F.coalesce("__seen", "__begin")).select(*events.columns, value)
