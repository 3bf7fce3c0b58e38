"""Continuous versions of the stateful operators.

Dedup and windows use built-in streaming operators with a watermark; leases, delayed releases, task states, workers, leadership and
idempotency keep keyed state with event-time timers (RocksDB state store), and no state outlives its timer. The batch operators give
the same results over a finished log.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: State of a key that nothing happened to is dropped after so long.
DAY_MS = 86_400_000


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def read_log(spark: SparkSession, path: str, schema, files_per_batch: int = 8) -> DataFrame:
    """A stream over a folder of Parquet log files; timestamps without zone become UTC timestamps so that they can be watermarked."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    zoneless = [f.name for f in rows.schema.fields if f.dataType.typeName() == "timestamp_ntz"]
    return rows.withColumns({c: F.col(c).cast("timestamp") for c in zoneless})


def dedup(stream: DataFrame, time: str = "ts", key: str = "dedup_key", life: str = "7 days") -> DataFrame:
    """First publish of each key within a receipt's life of event time."""
    return stream.withWatermark(time, life).dropDuplicatesWithinWatermark([key])


def control_windows(stream: DataFrame, period: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Executions, failures and latency of each pool in tumbling windows; late rows within the watermark are counted, later ones dropped."""
    at = stream.withWatermark("ts", late).groupBy("pool", F.window("ts", period).alias("w"))
    out = at.agg(F.count("*").alias("executions"), F.count_if("failed").alias("failures"), F.sum("latency_ns").alias("latency_sum_ns"))
    return out.select("pool", F.col("w.start").alias("window_start"), "executions", "failures", "latency_sum_ns")


class Keyed(StatefulProcessor):
    """One value of state for each key, and at most one timer: `step` and `expire` take the state (a tuple or None) and return the next state,
    the time it ends in milliseconds, and the rows to give out. A state of None is removed."""

    state: str
    names: tuple[str, ...] = ()
    order: tuple[str, ...] = ("ms", "seq")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", self.state)

    def step(self, key: str, held: tuple | None, row: Row) -> tuple[tuple | None, int | None, list[tuple]]:
        raise NotImplementedError

    def expire(self, key: str, held: tuple, now: int) -> tuple[tuple | None, int | None, list[tuple]]:
        return None, None, []

    def _named(self, values: tuple) -> Row:
        return Row(**dict(zip(self.names, values, strict=True)))

    def _keep(self, held: tuple | None, ends: int | None, watermark: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if held is None:
            self.held.clear()
            return
        self.held.update(held)
        if ends is not None:
            self.handle.registerTimer(max(ends, watermark + 1))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterable[Row]:  # noqa: N802, N803
        held, ends = (tuple(self.held.get()) if self.held.exists() else None), None
        for row in sorted(rows, key=lambda r: tuple(r[c] for c in self.order)):
            held, ends, out = self.step(key[0], held, row)
            yield from map(self._named, out)
        self._keep(held, ends, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterable[Row]:  # noqa: N802, N803
        if self.held.exists():
            held, ends, out = self.expire(key[0], tuple(self.held.get()), expiredTimerInfo.getExpiryTimeInMs())
            yield from map(self._named, out)
            self._keep(held, ends, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def _keyed(stream: DataFrame, key: str, processor: Keyed, schema: str, late: str) -> DataFrame:
    processor.names = tuple(c.split()[0] for c in schema.split(", "))
    at = stream.withWatermark("ts", late).withColumn("ms", F.unix_millis("ts"))
    return at.groupBy(key).transformWithState(processor, schema, "Append", "EventTime")


class Leases(Keyed):
    """reserve opens a lease, extend renews it, ack or nack ends it; no heartbeat for a ttl means expired."""

    state = "owner string, beats long, ends long"

    def step(self, key, held, row):
        out, ms = [], row.ms
        if held and ms >= held[2]:
            out.append((key, held[0], "expired", held[1], held[2]))
            held = None
        if row.action == "reserve" and held is None:
            held = (row.consumer, 0, ms + row.ttl_ms)
        elif held is None:
            out.append((key, row.consumer, "unknown", 0, ms))
        elif row.consumer != held[0]:
            out.append((key, row.consumer, "stale", held[1], ms))
        elif row.action == "extend":
            held = (held[0], held[1] + 1, ms + row.ttl_ms)
        elif row.action in ("ack", "nack"):
            out.append((key, held[0], row.action + "ed", held[1], ms))
            held = None
        return held, held and held[2], out

    def expire(self, key, held, now):
        return None, None, [(key, held[0], "expired", held[1], held[2])]


def lease_lifecycle(stream: DataFrame, late: str = "1 minute") -> DataFrame:
    """Outcomes of leases from events (delivery_id, seq, ts, action, consumer, ttl_ms)."""
    return _keyed(stream, "delivery_id", Leases(), "delivery_id string, owner string, outcome string, heartbeats long, at_ms long", late)


class Releases(Keyed):
    state = "queue string, eta long"
    order = ("ms",)

    def step(self, key, held, row):
        eta = row.eta_ms
        if eta <= row.ms:
            return None, None, [(key, row.queue, eta, row.ms - eta)]
        return (row.queue, eta), eta, []

    def expire(self, key, held, now):
        return None, None, [(key, held[0], held[1], max(0, now - held[1]))]


def delayed_release(stream: DataFrame, late: str = "1 minute") -> DataFrame:
    """Releases each delayed task (task_id, queue, ts, eta) when event time passes its ETA; an ETA already past goes at once."""
    return _keyed(stream.withColumn("eta_ms", F.unix_millis("eta")), "task_id", Releases(), "task_id string, queue string, scheduled_for_ms long, release_lag_ms long", late)


TERMINAL = frozenset(("succeeded", "retry_scheduled", "dead_lettered"))
EDGES = frozenset((("queued", "leased"), ("leased", "running"), ("running", "succeeded"), ("running", "retry_scheduled"), ("running", "dead_lettered"), ("retry_scheduled", "queued")))


class Tasks(Keyed):
    state = "at string, last long"

    def step(self, key, held, row):
        ok = held is None or row.ms - held[1] >= DAY_MS or (held[0], row.state) in EDGES
        return (row.state if ok else held[0], row.ms), row.ms + DAY_MS, [(key, row.seq, row.state, ok, row.state in TERMINAL)]


def task_states(stream: DataFrame, late: str = "1 minute") -> DataFrame:
    """Checks each state change (task_id, seq, ts, state) against the allowed moves; a wrong one leaves the state as it was. A task that
    nothing happened to for a day is forgotten."""
    return _keyed(stream, "task_id", Tasks(), "task_id string, seq long, state string, valid boolean, terminal boolean", late)


class Workers(Keyed):
    """accepting, then draining with a deadline, then stopped: drained if the work ended in time, else forced, which abandons what is left."""

    state = "at string, work long, deadline long"

    def step(self, key, held, row):
        at, work, deadline = held or ("accepting", 0, 0)
        if at == "stopped" and row.action != "start":
            return held, row.ms + DAY_MS, []
        out = []
        if at == "draining" and deadline and row.ms >= deadline:
            return ("stopped", 0, 0), row.ms + DAY_MS, [(key, "stopped", "forced_timeout", work, deadline)]
        if row.action == "start":
            at, work, deadline = "accepting", 0, 0
            out.append((key, at, "", 0, row.ms))
        elif row.action == "take" and at == "accepting":
            work += 1
        elif row.action == "finish":
            work = max(0, work - 1)
        elif row.action == "drain" and at == "accepting":
            at, deadline = "draining", row.ms + row.timeout_ms if row.timeout_ms else 0
            out.append((key, at, "", 0, row.ms))
        if at == "draining" and work == 0:
            return ("stopped", 0, 0), row.ms + DAY_MS, [*out, (key, "stopped", "drained", 0, row.ms)]
        return (at, work, deadline), deadline or row.ms + DAY_MS, out

    def expire(self, key, held, now):
        if held[0] != "draining" or not held[2]:
            return None, None, []
        return ("stopped", 0, 0), now + DAY_MS, [(key, "stopped", "forced_timeout", held[1], held[2])]


def worker_lifecycle(stream: DataFrame, late: str = "1 minute") -> DataFrame:
    """State changes of workers from events (worker_id, seq, ts, action start, take, finish or drain, timeout_ms): state, outcome, abandoned."""
    return _keyed(stream, "worker_id", Workers(), "worker_id string, state string, outcome string, abandoned long, at_ms long", late)


class Leaders(Keyed):
    """One owner at a time; each term has an epoch above all before it; a lock that is not renewed in time is lost. Epochs are kept after the lock
    ran out, so they never repeat."""

    state = "owner string, epoch long, ends long"

    def step(self, key, held, row):
        owner, epoch, ends = held or (None, 0, 0)
        live = owner is not None and row.ms < ends
        if row.action in ("acquire", "renew") and live and owner == row.owner:
            return (owner, epoch, row.ms + row.ttl_ms), row.ms + row.ttl_ms, [(key, owner, epoch, "renewed", row.ms)]
        if row.action == "acquire" and not live:
            lost = [(key, owner, epoch, "lost", ends)] if owner is not None else []
            return (row.owner, epoch + 1, row.ms + row.ttl_ms), row.ms + row.ttl_ms, [*lost, (key, row.owner, epoch + 1, "acquired", row.ms)]
        if row.action == "release" and live and owner == row.owner:
            return (None, epoch, 0), None, [(key, owner, epoch, "released", row.ms)]
        return (owner, epoch, ends), ends if owner is not None else None, [(key, row.owner, epoch, "refused", row.ms)]

    def expire(self, key, held, now):
        return (None, held[1], 0), None, [(key, held[0], held[1], "lost", held[2])] if held[0] is not None else []


def leadership(stream: DataFrame, late: str = "1 second") -> DataFrame:
    """Terms of locks from events (lock, seq, ts, owner, action acquire, renew or release, ttl_ms)."""
    return _keyed(stream, "lock", Leaders(), "lock string, owner string, epoch long, outcome string, at_ms long", late)


class Idempotency(Keyed):
    """begin holds a key, complete keeps it for good (a day after the last event), fail frees it."""

    state = "done boolean, last long"

    def step(self, key, held, row):
        if held is not None and row.ms - held[1] >= DAY_MS:
            held = None
        done, ends = held is not None and held[0], row.ms + DAY_MS
        if row.action == "begin":
            return (done, row.ms), ends, [(key, row.seq, held is None)]
        if row.action == "complete" and held is not None:
            return (True, row.ms), ends, []
        return (held if done else None), ends, []


def idempotency(stream: DataFrame, late: str = "1 minute") -> DataFrame:
    """Which begins (key, seq, ts, action begin, complete or fail) may go on: those whose key is neither held nor done."""
    return _keyed(stream, "key", Idempotency(), "key string, seq long, begun boolean", late)


def scheduler_ticks(stream: DataFrame, tick, checkpoint: str) -> None:
    """One tick for each micro-batch: tick(batch, number) runs the control plane's operators on what arrived; the checkpoint makes each batch
    one tick, also after a restart."""
    stream.writeStream.foreachBatch(tick).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Processes what is there in micro-batches and stops; results are appended as Parquet, exactly once by the checkpoint."""
    stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()
