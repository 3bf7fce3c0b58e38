"""Delivery semantics: queue reads, leases, validation, outcomes, dead letters, retries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs
from ..sources.task_log import AS_OF_US
from .ranks import positions


def next_ready(log: DataFrame, n: int = 1) -> DataFrame:
    """The next n never-delivered entries of each queue, first in first out."""
    order = Window.partitionBy("queue").orderBy("seq")
    return log.filter("placement = 'ready'").withColumn("position", F.row_number().over(order).cast("long")).filter(F.col("position") <= n).select("queue", "position", "task_id", "fairness_key")


def due(log: DataFrame, limit: int = 100) -> DataFrame:
    """The delayed entries due now, in ETA order, at most `limit`, stamped for release."""
    rows = log.filter("placement = 'delayed'").filter(F.floor(F.col("eta_us") / 1000) <= AS_OF_US // 1000)
    rows = rows.orderBy(F.floor(F.col("eta_us") / 1000), "task_id").limit(limit)
    return rows.select("task_id", "queue", F.col("eta_us").alias("scheduled_for_us"), F.lit(AS_OF_US).alias("released_at_us"), F.floor((F.lit(AS_OF_US) - F.col("eta_us")) / 1000).alias("release_lag_ms"))


def lease_state(idle_us: Column, ttl_us: Column, owner: Column, caller: Column) -> Column:
    """Precedence: not pending is unknown, another owner is stale, an idle lease is expired even for its owner."""
    return F.when(owner.isNull(), "unknown").when(owner != caller, "stale").when(idle_us >= ttl_us, "expired").otherwise("ok")


def validate(claims: DataFrame, leases: DataFrame) -> DataFrame:
    """Claims (delivery_id, caller) against the live leases."""
    at = claims.join(leases.select("delivery_id", "consumer", "created_us", "ttl_ns"), "delivery_id", "left")
    verdict = lease_state(F.lit(AS_OF_US) - F.col("created_us"), F.floor(F.col("ttl_ns") / 1000), F.col("consumer"), F.col("caller"))
    return at.select(*claims.columns, verdict.alias("verdict"))


def deliveries(log: DataFrame, pool_ttl_ns: int) -> DataFrame:
    """Leased attempts of pending work: count, first enqueue, lease end."""
    ttl = F.when(F.col("ttl_ns") > 0, F.col("ttl_ns")).otherwise(F.lit(pool_ttl_ns))
    rows = log.filter("placement = 'pending'")
    return rows.select("task_id", "delivery_id", F.greatest(F.col("attempt") + 1, F.lit(1)).cast("long").alias("delivery_count"), "created_us", (F.col("created_us") + F.floor(ttl / 1000)).alias("lease_expires_us"), F.col("consumer").alias("lease_owner"), F.lit("leased").alias("state"))


def reclaimable(log: DataFrame) -> DataFrame:
    """The first expired lease of each queue and key: what the next reader takes over before it reads anything new."""
    expired = log.filter("placement = 'pending'").filter(F.lit(AS_OF_US) - F.col("created_us") >= F.floor(F.col("ttl_ns") / 1000))
    first = expired.groupBy("queue", "fairness_key").agg(F.min_by(F.struct("delivery_id", "attempt"), "seq").alias("x"), F.count("*").alias("n_expired"))
    return first.select("queue", "fairness_key", "x.delivery_id", (F.col("x.attempt") + 2).cast("long").alias("delivery_count"), "n_expired")


def violations(history: DataFrame, transitions: DataFrame) -> DataFrame:
    """Steps (task_id, step, state) whose move from the state before is not allowed."""
    order = Window.partitionBy("task_id").orderBy("step")
    moves = history.withColumn("from_state", F.lag("state").over(order)).filter("from_state is not null").withColumnRenamed("state", "to_state")
    return moves.join(transitions, ["from_state", "to_state"], "left_anti").select("task_id", "step", "from_state", "to_state")


def classify(typed: Column, deadline: Column, lease: Column) -> Column:
    """A typed class wins, then a passed deadline, then a lost lease; anything else is worth a retry."""
    return F.when(F.coalesce(typed, F.lit("")) != "", typed).when(deadline, "timeout").when(lease.isin("expired", "stale"), "lease_lost").otherwise("transient_retryable")


def outcome(failure_class: Column, may_retry: Column) -> Column:
    return F.when(failure_class.isin("transient_retryable", "timeout"), F.when(may_retry, "retry").otherwise("dead_letter")).when(failure_class.isin("permanent", "lease_lost", "decode_or_validation"), "dead_letter").otherwise("ack")


def failures(log: DataFrame, classes: DataFrame, policies: DataFrame) -> DataFrame:
    """What becomes of every failed task: class, retry or dead letter, and the retry's time."""
    at = log.filter("failed").join(classes, "failure_code", "left").join(policies, "queue", "left")
    count = (F.col("attempt") + 1).cast("long")
    may = exprs.should_retry(count, F.col("max_deliveries"), (F.lit(AS_OF_US) - F.col("created_us")) * 1000, F.col("max_age_ns"))
    delay = exprs.jittered(exprs.backoff(F.col("initial_ns"), F.col("multiplier"), F.col("max_ns"), count), F.col("max_ns"), F.col("jitter"), F.col("task_id"), count)
    at = at.withColumns({"delivery_count": count, "outcome": outcome(F.col("failure_class"), may), "delay_ns": delay})
    retry = F.col("outcome") == "retry"
    return at.select("task_id", "queue", "failure_class", "delivery_count", "outcome", F.when(retry, F.col("delay_ns")).alias("delay_ns"), F.when(retry, F.lit(AS_OF_US) + F.floor(F.col("delay_ns") / 1000)).alias("retry_at_us"))


def retry_messages(failed: DataFrame, log: DataFrame) -> DataFrame:
    """The message of every retry: one attempt more, its ETA, and the five headers that tell of the failure."""
    retries = failed.filter("outcome = 'retry'").join(log.select("task_id", "attempt", "created_us"), "task_id")
    return retries.select(
        "task_id", (F.col("attempt") + 1).cast("int").alias("attempt"), F.col("retry_at_us").alias("eta_us"), exprs.rfc3339(F.col("retry_at_us")).alias("retry_scheduled_at"), exprs.format_duration(F.col("delay_ns")).alias("retry_delay"),
        F.col("failure_class").alias("retry_failure_class"), F.col("delivery_count").cast("string").alias("retry_delivery_count"), exprs.rfc3339(F.col("created_us")).alias("retry_first_enqueued_at"),
    )


def is_due(eta_us: Column) -> Column:
    return eta_us.isNull() | (eta_us <= AS_OF_US)


def deferral_headers(headers: Column, source: str, reason: Column, until_us: Column) -> Column:
    """A message's headers with the five of a deferral; what it had under these names goes."""
    new = F.create_map(F.lit("admission_decision"), F.lit("deferred"), F.lit("admission_reason"), reason, F.lit("admission_source"), F.lit(source), F.lit("admission_deferred_until"), exprs.rfc3339(until_us), F.lit("admission_evaluated_at"), exprs.rfc3339(F.lit(AS_OF_US)))
    return exprs.overwritten(headers, new)


def overloaded(failed: DataFrame, status: DataFrame) -> DataFrame:
    """A retry that admission rejects is dead-lettered as overloaded."""
    at = failed.join(status.select("queue", "decision"), "queue", "left")
    lost = (F.col("outcome") == "retry") & (F.col("decision") == "rejected")
    return at.select("task_id", "queue", F.when(lost, "overloaded").otherwise(F.col("failure_class")).alias("failure_class"), F.when(lost, "dead_letter").otherwise(F.col("outcome")).alias("outcome"))


def envelopes(log: DataFrame, classes: DataFrame) -> DataFrame:
    """Dead letters with the task they hold: id, queue and dedup key derive from the delivery."""
    rows = log.filter("placement = 'dead'").join(classes, "failure_code", "left")
    original = F.struct(F.col("task_id").alias("id"), F.col("task_name").alias("name"), "queue", "fairness_key", "attempt", "created_us")
    return rows.select(
        F.concat(F.lit("dlq:"), "delivery_id").alias("entry_id"), F.concat(F.lit("dlq."), "queue").alias("dlq_queue"), F.concat(F.lit("dead_letter:"), "delivery_id").alias("dedup_key"),
        original.alias("original_task"), "failure_class", "delivery_id", F.col("consumer").alias("worker_identity"), "seq", "created_us",
    )


def dead_letter_messages(dead: DataFrame) -> DataFrame:
    """The message published for each dead task (headers, error, failure_class, failed_us): what it is called, its headers, and the envelope's
    fields. Admission does not apply to dead letters."""
    headers = F.col("headers")
    trace = F.nullif(exprs.trace_id(headers["trace_id"], headers["traceparent"]), F.lit(""))
    return dead.select(
        F.concat(F.lit("dlq:"), "delivery_id").alias("id"), F.lit("dead_letter").alias("name"), F.concat(F.lit("dlq."), exprs.or_default(F.col("queue"), "default")).alias("queue"), F.concat(F.lit("dead_letter:"), "delivery_id").alias("dedup_key"),
        F.col("failure_class").alias("dead_letter_failure_class"), F.col("error").alias("dead_letter_last_error"), trace.alias("dead_letter_trace_id"), F.lit("accepted").alias("decision"),
        F.col("created_us").alias("first_enqueued_us"), F.col("failed_us").alias("last_failure_us"), F.greatest(F.col("attempt") + 1, F.lit(1)).cast("long").alias("delivery_count"), F.col("consumer").alias("worker_identity"),
        F.col("queue").alias("original_queue"), F.col("task_name").alias("original_task_name"),
    )


def list_dead(dead: DataFrame, limit: int = 50) -> DataFrame:
    """Oldest entries of every dead-letter queue, at most `limit` of each."""
    order = Window.partitionBy("dlq_queue").orderBy("seq")
    return dead.withColumn("position", F.row_number().over(order).cast("long")).filter(F.col("position") <= limit)


def replay(dead: DataFrame, limit: int = 50) -> DataFrame:
    """Messages that go back to their queue: ETA cleared, origin noted, no dedup key."""
    picked = list_dead(dead, limit)
    return picked.select(F.col("original_task.id").alias("task_id"), F.col("original_task.queue").alias("queue"), F.col("original_task.attempt").alias("attempt"), F.col("entry_id").alias("replayed_from"), F.lit(AS_OF_US).alias("replayed_at_us"))


def remaining(dead: DataFrame, taken: DataFrame) -> DataFrame:
    """Entries that a replay or discard leaves."""
    return dead.join(taken.select("entry_id"), "entry_id", "left_anti")


def audit(taken: DataFrame, action: str, description: str) -> DataFrame:
    return taken.select(F.lit(action).alias("action"), F.col("dlq_queue").alias("queue"), "entry_id", F.col("original_task.id").alias("task_id"), F.lit(AS_OF_US).alias("occurred_us"), F.lit(description).alias("description"))


RETRY_HEADERS = {"max_deliveries": "int", "initial_backoff": "duration", "max_backoff": "duration", "multiplier": "double", "jitter": "double", "max_task_age": "duration"}


def retry_overlay(messages: DataFrame) -> DataFrame:
    """A queue's retry policy under what a message asks for: its number of attempts, then six headers; out of bounds values become the
    defaults. Blank headers say nothing; one that does not parse is an error. Messages: task_id, headers, max_attempts and the
    policy (base_attempts, base_deliveries, base_initial_ns, base_max_ns, base_multiplier, base_jitter, base_age_ns)."""
    read, bad = {}, F.lit(False)
    for name, kind in RETRY_HEADERS.items():
        text = F.nullif(F.element_at("headers", name), F.lit(""))
        read[name] = exprs.parse_duration(text) if kind == "duration" else F.when(F.regexp_like(text, F.lit(r"^[+-]?[0-9]+$" if kind == "int" else r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")), text.try_cast(kind))
        bad = bad | (text.isNotNull() & read[name].isNull())
    base_deliveries = F.when((F.col("base_deliveries") <= 0) & (F.col("base_attempts") > 0), F.col("base_attempts")).otherwise(F.col("base_deliveries"))
    base_attempts = F.when((F.col("base_attempts") <= 0) & (F.col("base_deliveries") > 0), F.col("base_deliveries")).otherwise(F.col("base_attempts"))
    asked = F.when(F.col("max_attempts") > 0, F.col("max_attempts"))
    attempts = F.coalesce(asked, base_attempts)
    deliveries = F.coalesce(read["max_deliveries"], asked, base_deliveries)
    initial, most = F.coalesce(read["initial_backoff"], F.col("base_initial_ns")), F.coalesce(read["max_backoff"], F.col("base_max_ns"))
    at = messages.select(
        "task_id", F.when((attempts > 0) & (deliveries <= 0), attempts).otherwise(deliveries).cast("long").alias("max_deliveries"),
        F.when(initial <= 0, 1_000_000_000).otherwise(initial).cast("long").alias("initial_ns"), F.when(most <= 0, 30_000_000_000).otherwise(most).cast("long").alias("max_ns"),
        F.greatest(F.coalesce(read["multiplier"], F.col("base_multiplier")), F.lit(1.0)).alias("multiplier"), F.greatest(F.coalesce(read["jitter"], F.col("base_jitter")), F.lit(0.0)).alias("jitter"),
        F.coalesce(read["max_task_age"], F.col("base_age_ns")).cast("long").alias("max_age_ns"), bad.alias("error"),
    )
    return at.select("task_id", "error", *[F.when(~F.col("error"), F.col(c)).alias(c) for c in ("max_deliveries", "initial_ns", "max_ns", "multiplier", "jitter", "max_age_ns")])


def validate_payloads(messages: DataFrame) -> DataFrame:
    """Payloads (JSON texts) of the three kinds of work: one that does not decode or lacks its field fails, for external work with a typed
    error of class decode_or_validation, for the others with an error that is worth a retry. Media work has three steps if none are
    given; a mail without a key of its own goes by its task's id."""
    kind = F.col("kind")
    p = F.from_json("payload", "asset_id string, steps long, recipient string, resource_id string, broken string", {"columnNameOfCorruptRecord": "broken"})
    at = messages.withColumn("p", p)
    needed = F.when(kind == "media", F.col("p.asset_id")).when(kind == "email", F.col("p.recipient")).otherwise(F.col("p.resource_id"))
    decoded = F.col("p.broken").isNull()
    bad = ~decoded | (F.coalesce(needed, F.lit("")) == "")
    steps = F.when((kind == "media") & decoded, F.when(F.coalesce("p.steps", F.lit(0)) > 0, F.col("p.steps")).otherwise(3))
    key = F.when((kind == "email") & decoded, F.coalesce(F.nullif("idempotency_key", F.lit("")), F.col("id")))
    return at.withColumn("failure_class", F.when(bad & (kind == "external"), "decode_or_validation").when(bad, "transient_retryable").otherwise("")).withColumn("steps", steps.cast("long")).withColumn("idempotency_key", key)


def with_receipts(publishes: DataFrame, ttl_us: int) -> DataFrame:
    """Publishes (seq, created_us, dedup_key, accepts and any other columns) flagged as duplicates: a receipt lives for ttl from a publish that
    was let in, so a rejected one leaves none and a duplicate renews none. Publishes without a key are never duplicates. Rows are
    shuffled once, by key, with all their columns; each key's are folded in order, and receipts are a ttl apart, so few."""
    free = publishes.filter("dedup_key = ''").withColumn("deduplicated", F.lit(False))
    others = [c for c in publishes.columns if c not in ("created_us", "seq", "accepts", "dedup_key")]
    item = F.struct("created_us", "seq", "accepts", *others)
    receipt = "array<struct<us:bigint,seq:bigint>>"
    start = F.struct(F.lit(None).cast("long").alias("last"), F.array().cast(receipt).alias("receipts"))

    def step(acc, x):
        fresh = x["accepts"] & F.coalesce(x["created_us"] - acc["last"] >= ttl_us, F.lit(True))
        mine = F.array(F.struct(x["created_us"].alias("us"), x["seq"].alias("seq")))
        return F.when(fresh, F.struct(x["created_us"].alias("last"), F.concat(acc["receipts"], mine).alias("receipts"))).otherwise(acc)

    keyed = publishes.filter("dedup_key <> ''").groupBy("dedup_key").agg(F.array_sort(F.collect_list(item)).alias("all"))
    rows = keyed.withColumn("receipts", F.aggregate("all", start, step, lambda acc: acc["receipts"])).select("dedup_key", "receipts", F.explode("all").alias("x")).select("dedup_key", "receipts", "x.*")
    before = F.filter("receipts", lambda r: (r["us"] < F.col("created_us")) | ((r["us"] == F.col("created_us")) & (r["seq"] < F.col("seq"))))
    last = F.get(before, F.size(before) - 1)["us"]
    flagged = rows.withColumn("deduplicated", F.coalesce(F.col("created_us") - last < ttl_us, F.lit(False)))
    return flagged.select(*publishes.columns, "deduplicated").unionByName(free)


def latest_result(log: DataFrame) -> DataFrame:
    """Last state per task name and consumer: an upsert as a partial max."""
    state = F.when(F.col("failed"), "failed").otherwise("succeeded")
    return log.filter("placement = 'acked'").groupBy("task_name", "consumer").agg(F.max_by(F.struct("task_id", state.alias("state")), "seq").alias("x")).select("task_name", "consumer", "x.task_id", "x.state")


def saved_results(saves: DataFrame) -> DataFrame:
    """The state saved last for each task: an upsert as a partial maximum."""
    return saves.groupBy("task_id").agg(F.max_by("state", "saved").alias("state"), F.max("saved").alias("saved"))


def publish_routes(log: DataFrame, decisions: DataFrame, fair_queues: DataFrame, ttl_us: int) -> DataFrame:
    """Where each publish goes: duplicates are settled before admission, and only what admission lets in leaves a receipt. Decisions: queue,
    fairness_key, decision. Fair queues are those with a fairness policy, whatever the message's key."""
    at = log.join(decisions.select("queue", "fairness_key", "decision", "reason", "defer_until_us"), ["queue", "fairness_key"], "left").join(fair_queues.withColumn("fair", F.lit(True)), "queue", "left")
    at = with_receipts(at.withColumn("accepts", F.coalesce(F.col("decision") != "rejected", F.lit(True))), ttl_us)
    route = (
        F.when(F.col("deduplicated"), "deduplicated").when(F.col("decision").isin("rejected", "deferred"), F.col("decision"))
        .when(F.coalesce(F.col("eta_us") > AS_OF_US, F.lit(False)), "delayed").when(F.coalesce("fair", F.lit(False)), "fair_ready").otherwise("ready")
    )
    return at.withColumn("route", route)


def streams(routed: DataFrame) -> DataFrame:
    """Appended entries in order: a queue's stream, or a stream for each fairness key; position within it."""
    key = F.coalesce(F.nullif(F.trim("fairness_key"), F.lit("")), F.lit(exprs.DEFAULT_KEY))
    at = routed.filter("route in ('ready', 'fair_ready')").withColumn("stream", F.when(F.col("route") == "ready", F.col("queue")).otherwise(F.concat_ws(":", "queue", key)))
    return positions(at, ["stream"], F.floor(F.col("seq") / 1_000_000), ["seq"]).select("stream", "position", "task_id", "queue")


def delayed_entries(routed: DataFrame) -> DataFrame:
    """Entries of the delayed set: an id derived from the publish, the score in milliseconds, and what is scheduled."""
    at = routed.filter("route in ('delayed', 'deferred')").withColumn("eta", F.when(F.col("route") == "deferred", F.col("defer_until_us")).otherwise(F.col("eta_us")))
    return at.select(F.sha2(F.concat_ws(":", "task_id", F.col("seq").cast("string")), 256).alias("entry_id"), F.floor(F.col("eta") / 1000).alias("score_ms"), "task_id", "queue", F.col("eta").alias("scheduled_for_us"))


def receipts(routed: DataFrame, ttl_us: int) -> DataFrame:
    """Live receipts by hashed key: when the last accepted publish's receipt ends."""
    kept = routed.filter("accepts and not deduplicated and dedup_key <> ''").groupBy("dedup_key").agg((F.max("created_us") + ttl_us).alias("expires_us"))
    return kept.filter(F.col("expires_us") > AS_OF_US).select(F.sha2("dedup_key", 256).alias("receipt"), "expires_us")


def fair_registry(routed: DataFrame) -> DataFrame:
    """Keys registered for each fair queue, with what their streams hold; the wake list holds one entry a queue."""
    key = F.coalesce(F.nullif(F.trim("fairness_key"), F.lit("")), F.lit(exprs.DEFAULT_KEY))
    return routed.filter("route = 'fair_ready'").groupBy("queue", key.alias("key")).agg(F.count("*").alias("entries"), F.max("seq").alias("last_seq")).withColumn("wake", F.lit(1).cast("long"))


def acknowledge(claims: DataFrame, leases: DataFrame) -> DataFrame:
    """Claims (delivery_id, caller, pos, their order): `acked` for the live owner, else why not. Of several valid claims on a delivery one finds it, the
    others find it unknown."""
    order = Window.partitionBy("delivery_id").orderBy("pos")
    at = validate(claims, leases)
    first = F.coalesce(F.sum(F.when(F.col("verdict") == "ok", 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) == 0
    return at.select("delivery_id", "caller", "pos", F.when(F.col("verdict") != "ok", F.when(first, F.col("verdict")).otherwise("unknown")).when(first, "acked").otherwise("unknown").alias("result"))


def pending_after(leases: DataFrame, done: DataFrame, results: tuple[str, ...] = ("acked", "nacked", "requeued", "requeue_deferred")) -> DataFrame:
    """Leases that remain: those whose delivery was not finalised."""
    return leases.join(done.filter(F.col("result").isin(*results)).select("delivery_id"), "delivery_id", "left_anti")


def negative_acknowledge(claims: DataFrame, leases: DataFrame, decisions: DataFrame) -> DataFrame:
    """Claims (delivery_id, caller, requeue): a requeue is published as new work under the key requeue:<delivery>, its ETA cleared, so
    admission applies; a rejected one fails before the entry is removed, which stays pending."""
    at = validate(claims, leases).join(leases.select("delivery_id", "task_id", "queue", "fairness_key", "attempt"), "delivery_id", "left")
    at = at.join(decisions.select("queue", "fairness_key", "decision", "reason", "defer_until_us"), ["queue", "fairness_key"], "left")
    decision = F.coalesce("decision", F.lit("accepted"))
    again = F.when(decision == "rejected", "requeue_rejected").when(decision == "deferred", "requeue_deferred").otherwise("requeued")
    result = F.when(F.col("verdict") != "ok", F.col("verdict")).when(~F.col("requeue"), "nacked").otherwise(again)
    published = result.isin("requeued", "requeue_deferred")
    return at.select(
        "delivery_id", "caller", result.alias("result"), F.when(published, F.col("task_id")).alias("task_id"), F.when(published, F.concat(F.lit("requeue:"), "delivery_id")).alias("dedup_key"),
        F.when(published, F.col("attempt")).alias("attempt"), F.when(result == "requeue_deferred", F.col("defer_until_us")).alias("eta_us"), F.when(result.isin("requeue_rejected", "requeue_deferred"), F.col("reason")).alias("reason"),
    )


def extend_leases(claims: DataFrame, leases: DataFrame, pool_ttl_ns: int) -> DataFrame:
    """Valid claims start their lease again, without another delivery being counted; others are failures of their queue."""
    at = validate(claims, leases).join(leases.select("delivery_id", "queue", "ttl_ns", "attempt"), "delivery_id", "left")
    ttl = F.when(F.col("ttl_ns") > 0, F.col("ttl_ns")).otherwise(F.lit(pool_ttl_ns))
    ok = F.col("verdict") == "ok"
    return at.select("delivery_id", "caller", "verdict", F.when(ok, F.lit(AS_OF_US) + F.floor(ttl / 1000)).alias("lease_expires_us"), F.when(ok, F.col("attempt") + 1).cast("long").alias("delivery_count"), (~ok).alias("failed"))


def move_due(log: DataFrame, decisions: DataFrame, fair_queues: DataFrame, fence_epoch: int, current_epoch: int, limit: int = 100) -> DataFrame:
    """One release of due entries: at most `limit` in ETA order, each stamped, its ETA cleared, and admitted anew as due_release, which is
    deferred where new work is rejected. A stale fence moves nothing. Each release that is let in raises its queue's pending work and
    lowers its retry backlog before the next is looked at: the few rows are folded queue by queue."""
    rows = log.filter("placement = 'delayed'").filter(F.floor(F.col("eta_us") / 1000) <= AS_OF_US // 1000).filter(F.lit(fence_epoch == current_epoch))
    rows = rows.orderBy(F.floor(F.col("eta_us") / 1000), "task_id").limit(limit)
    at = rows.join(decisions, ["queue", "fairness_key"], "left")
    item = F.struct(F.floor(F.col("eta_us") / 1000).alias("ms"), "task_id", "fairness_key", "eta_us", "is_retry", "mode", "key_pending", "queue_pending", "oldest_age_us", "retry_signal", "dead_signal", "max_pending_per_key", "max_pending", "max_oldest_age_us", "max_retry_backlog", "max_dead", "defer_us")
    out = "array<struct<task_id:string,eta_us:bigint,decision:string,reason:string,defer_until_us:bigint>>"
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("retries"), F.array().cast("array<string>").alias("keys"), F.array().cast(out).alias("out"))

    def step(acc, x):
        mine = F.size(F.filter(acc["keys"], lambda k: k == x["fairness_key"]))

        def hit(cap, value):
            return F.coalesce((x[cap] > 0) & (value >= x[cap]), F.lit(False))

        reason = (
            F.when(F.coalesce(x["mode"], F.lit("disabled")) == "disabled", "").when(hit("max_pending_per_key", x["key_pending"] + F.when(x["key_pending"].isNotNull() & x["capped"], mine).otherwise(0)), "fairness_key_pending_cap")
            .when(hit("max_pending", x["queue_pending"] + acc["n"]), "queue_pending_cap").when(hit("max_oldest_age_us", x["oldest_age_us"]), "oldest_ready_age")
            .when(hit("max_retry_backlog", x["retry_signal"] - acc["retries"]), "retry_backlog").when(hit("max_dead", x["dead_signal"]), "dead_letter_size").otherwise("")
        )
        free = reason == ""
        row = F.struct(x["task_id"].alias("task_id"), x["eta_us"].alias("eta_us"), F.when(free, "accepted").otherwise("deferred").alias("decision"), reason.alias("reason"), F.when(~free, F.lit(AS_OF_US) + x["defer_us"]).alias("defer_until_us"))
        return F.struct((acc["n"] + free.cast("long")).alias("n"), (acc["retries"] + (free & x["is_retry"]).cast("long")).alias("retries"), F.when(free, F.concat(acc["keys"], F.array(x["fairness_key"]))).otherwise(acc["keys"]).alias("keys"), F.concat(acc["out"], F.array(row)).alias("out"))

    at = at.join(fair_queues.withColumn("capped", F.lit(True)), "queue", "left").withColumn("x", item.withField("capped", F.coalesce("capped", F.lit(False))))
    moved = at.groupBy("queue").agg(F.aggregate(F.array_sort(F.collect_list("x")), start, step, lambda a: a["out"]).alias("out")).select("queue", F.inline("out"))
    fair = moved.join(fair_queues.withColumn("fair", F.lit(True)), "queue", "left")
    route = F.when(F.col("decision") == "deferred", "delayed").when(F.coalesce("fair", F.lit(False)), "fair_ready").otherwise("ready")
    return fair.select(
        "task_id", "queue", exprs.rfc3339(F.col("eta_us")).alias("scheduled_for"), exprs.rfc3339(F.lit(AS_OF_US)).alias("released_at"), F.floor((F.lit(AS_OF_US) - F.col("eta_us")) / 1000).alias("release_lag_ms"),
        "decision", "reason", route.alias("route"), F.col("defer_until_us").alias("eta_us"),
    )
