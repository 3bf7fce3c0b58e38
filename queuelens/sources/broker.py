"""A broker over tables: messages, leases and what became of deliveries are Parquet folders that are only appended to.

Each call appends one part and returns what it appended; what is ready, leased or expired is a join of the three at the time of the call.
Calls of one folder come from one driver, one after the other, as Spark has no transactions; readers may be many. `now` is given in
microseconds, so that a history can be replayed.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import exprs
from ..operators.ranks import positions

MESSAGE = "seq long, id string, name string, queue string, fairness_key string, payload binary, headers map<string,string>, attempt int, max_attempts int, eta_us long, dedup_key string, created_us long"
LEASE = "delivery_id string, seq long, consumer string, at_us long, ends_us long, delivery_count long"
DONE = "delivery_id string, seq long, outcome string, at_us long"
RECEIPT_US = 7 * 86_400_000_000


class TableBroker:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        for name, schema in (("messages", MESSAGE), ("leases", LEASE), ("done", DONE)):
            spark.createDataFrame([], schema).write.mode("append").parquet(f"{self.path}/{name}")

    def _table(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def _append(self, name: str, rows: DataFrame, schema: str) -> DataFrame:
        """Rows of one call, written once and read back, so that what is returned is what was written."""
        part = f"{self.path}/parts/{name}-{uuid.uuid4().hex}"
        rows.write.parquet(part)
        rows = self.spark.read.schema(schema).parquet(part)
        rows.write.mode("append").parquet(f"{self.path}/{name}")
        return rows

    def messages(self) -> DataFrame:
        return self._table("messages", MESSAGE)

    def leases(self) -> DataFrame:
        """The last lease of every message that is not finalised."""
        every = self._table("leases", LEASE)
        last = every.groupBy("seq").agg(F.max_by(F.struct("delivery_id", "consumer", "at_us", "ends_us", "delivery_count"), F.struct("at_us", "ends_us")).alias("x")).select("seq", "x.*")
        return last.join(self._table("done", DONE).select("seq"), "seq", "left_anti")

    def publish(self, messages: DataFrame, now: int) -> DataFrame:
        """Appends messages (id, name, queue, fairness_key, payload, headers, attempt, max_attempts, eta_us, dedup_key, created_us) in order of
        created_us and id, with their defaults. One whose key was published within a receipt's life, or is given twice, is left out; a
        missing id is an error."""
        if not messages.filter("id is null or id = ''").isEmpty():
            raise ValueError("a message needs an id")
        at = messages.withColumns({
            "queue": F.coalesce(F.nullif("queue", F.lit("")), F.lit("default")), "fairness_key": F.trim(F.coalesce("fairness_key", F.lit(""))),
            "created_us": F.coalesce("created_us", F.lit(now)), "dedup_key": F.coalesce("dedup_key", F.lit("")),
        })
        known = self.messages().filter(F.col("dedup_key") != "").filter(F.col("created_us") > now - RECEIPT_US).select("dedup_key").distinct()
        fresh = at.join(known, "dedup_key", "left_anti")
        twice = F.row_number().over(Window.partitionBy(F.when(F.col("dedup_key") == "", F.col("id")).otherwise(F.col("dedup_key")), F.col("dedup_key") == "").orderBy("created_us", "id"))
        fresh = fresh.withColumn("n", twice).filter("n = 1 or dedup_key = ''")
        before = self.messages().agg(F.max("seq")).first()[0] or 0
        placed = positions(fresh.withColumn("of", F.lit(0)), ["of"], F.floor(F.col("created_us") / 1_000_000), ["created_us", "id"], "place")
        columns = [c.split()[0] for c in MESSAGE.split(", ")]
        return self._append("messages", placed.withColumn("seq", F.lit(before) + F.col("place")).select(*columns), MESSAGE)

    def reserve(self, queue: str, consumer: str, ttl_us: int, now: int, n: int = 1) -> DataFrame:
        """Leases of at most n messages: expired ones first, then due ones that were never leased, first in first out."""
        mine = self.messages().filter(F.col("queue") == queue)
        over = self.leases().filter(F.col("ends_us") <= now).join(mine.select("seq"), "seq").select("seq", (F.col("delivery_count") + 1).alias("delivery_count"), F.lit(0).alias("turn"))
        new = mine.filter(F.col("eta_us").isNull() | (F.col("eta_us") <= now)).join(self._table("leases", LEASE).select("seq"), "seq", "left_anti")
        new = new.select("seq", F.greatest(F.coalesce("attempt", F.lit(0)) + 1, F.lit(1)).cast("long").alias("delivery_count"), F.lit(1).alias("turn"))
        taken = over.unionByName(new).orderBy("turn", "seq").limit(n)
        lease = taken.select(F.concat(F.lit("d-"), F.col("seq").cast("string"), F.lit("-"), F.col("delivery_count").cast("string")).alias("delivery_id"), "seq", F.lit(consumer).alias("consumer"), F.lit(now).alias("at_us"), F.lit(now + ttl_us).alias("ends_us"), "delivery_count")
        return self._append("leases", lease, LEASE)

    def check(self, claims: DataFrame, now: int) -> DataFrame:
        """Claims (delivery_id, caller) with their lease and verdict: unknown, stale, expired or ok."""
        at = claims.join(self.leases(), "delivery_id", "left")
        verdict = F.when(F.col("consumer").isNull(), "unknown").when(F.col("consumer") != F.col("caller"), "stale").when(F.col("ends_us") <= now, "expired").otherwise("ok")
        return at.withColumn("verdict", verdict)

    def _finish(self, valid: DataFrame, outcome: str, now: int) -> DataFrame:
        return self._append("done", valid.select("delivery_id", "seq", F.lit(outcome).alias("outcome"), F.lit(now).alias("at_us")).distinct(), DONE)

    def ack(self, claims: DataFrame, now: int) -> DataFrame:
        return self._finish(self.check(claims, now).filter("verdict = 'ok'"), "acked", now)

    def nack(self, claims: DataFrame, now: int, requeue: bool = True) -> DataFrame:
        """Finalises valid claims; with requeue their messages are published again, without ETA, under the key requeue:<delivery>."""
        valid = self._finish(self.check(claims, now).filter("verdict = 'ok'"), "nacked", now)
        if requeue:
            again = valid.join(self.messages().drop("dedup_key"), "seq").withColumns({"eta_us": F.lit(None).cast("long"), "dedup_key": F.concat(F.lit("requeue:"), "delivery_id"), "created_us": F.lit(now)})
            self.publish(again, now)
        return valid

    def extend(self, claims: DataFrame, ttl_us: int, now: int) -> DataFrame:
        """Valid claims get a lease from now on; the delivery is not counted again."""
        valid = self.check(claims, now).filter("verdict = 'ok'")
        return self._append("leases", valid.select("delivery_id", "seq", "consumer", F.lit(now).alias("at_us"), F.lit(now + ttl_us).alias("ends_us"), "delivery_count"), LEASE)

    def dead_letter(self, claims: DataFrame, failure_class: str, error: str, now: int) -> DataFrame:
        """Finalises valid claims; their messages go into the envelope of a dead letter on the queue dlq.<queue>."""
        valid = self._finish(self.check(claims, now).filter("verdict = 'ok'"), "dead_lettered", now)
        at = valid.join(self.messages(), "seq")
        original = F.struct("id", "name", "queue", "fairness_key", "payload", "headers", "attempt", "max_attempts", "created_us")
        envelope = F.struct(original.alias("original_task"), F.lit(failure_class).alias("failure_class"), F.lit(error).alias("last_error"), "delivery_id")
        trace = exprs.trace_id(F.col("headers")["trace_id"], F.col("headers")["traceparent"])
        headers = F.create_map(F.lit("dead_letter_failure_class"), F.lit(failure_class), F.lit("dead_letter_last_error"), F.lit(error), F.lit("dead_letter_trace_id"), trace)
        self.publish(at.select(
            F.concat(F.lit("dlq:"), "delivery_id").alias("id"), F.lit("dead_letter").alias("name"), F.concat(F.lit("dlq."), "queue").alias("queue"), F.lit("").alias("fairness_key"), F.to_json(envelope).cast("binary").alias("payload"), F.map_filter(headers, lambda k, v: v != "").alias("headers"),
            F.lit(0).alias("attempt"), F.lit(0).alias("max_attempts"), F.lit(None).cast("long").alias("eta_us"), F.concat(F.lit("dead_letter:"), "delivery_id").alias("dedup_key"), F.lit(now).alias("created_us"),
        ), now)
        return valid

    def dead_letters(self, queue: str, limit: int = 50) -> DataFrame:
        """Oldest dead letters of a queue, opened."""
        original = "original_task struct<id:string,name:string,queue:string,fairness_key:string,payload:binary,headers:map<string,string>,attempt:int,max_attempts:int,created_us:bigint>, failure_class string, last_error string, delivery_id string"
        rows = self.messages().filter(F.col("queue") == f"dlq.{queue}").join(self._table("done", DONE).select("seq"), "seq", "left_anti").orderBy("seq").limit(limit)
        return rows.withColumn("envelope", F.from_json(F.col("payload").cast("string"), original))

    def replay(self, queue: str, now: int, limit: int = 50) -> DataFrame:
        """Publishes the original messages of the oldest dead letters again and takes those off their queue."""
        picked = self.dead_letters(queue, limit)
        taken = self._append("done", picked.select(F.col("id").alias("delivery_id"), "seq", F.lit("replayed").alias("outcome"), F.lit(now).alias("at_us")), DONE)
        at = self.messages().join(taken.select("seq"), "seq", "left_semi").withColumn("e", F.from_json(F.col("payload").cast("string"), "original_task struct<id:string,name:string,queue:string,fairness_key:string,payload:binary,headers:map<string,string>,attempt:int,max_attempts:int,created_us:bigint>"))
        marks = F.create_map(F.lit("dead_letter_replayed_from"), F.col("entry"), F.lit("dead_letter_replayed_at"), exprs.rfc3339(F.lit(now)))
        at = at.select(F.col("id").alias("entry"), "e.original_task.*")
        self.publish(at.withColumns({"headers": exprs.overwritten(F.col("headers"), marks), "eta_us": F.lit(None).cast("long"), "dedup_key": F.lit("")}), now)
        return taken

    def discard(self, queue: str, now: int, limit: int = 50) -> DataFrame:
        """Takes the oldest dead letters off their queue for good; the returned rows are the audit."""
        picked = self.dead_letters(queue, limit)
        return self._append("done", picked.select(F.col("id").alias("delivery_id"), "seq", F.lit("discarded").alias("outcome"), F.lit(now).alias("at_us")), DONE)


def write_lines(rows: DataFrame, path: str, column: str = "value") -> None:
    """Appends the texts of a column to a folder of line files."""
    rows.select(F.col(column).cast("string").alias("value")).write.mode("append").text(path)
