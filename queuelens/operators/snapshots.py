"""As-of views of queues and tenants: one pass over the log, grouped; policy tables broadcast and zero-filled."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.task_log import AS_OF_US


def age(created: str = "created_us"):
    return F.greatest(F.lit(AS_OF_US) - F.col(created), F.lit(0).cast("long"))


def _n(condition):
    return F.count_if(condition).cast("long")


def queue_counts(log: DataFrame) -> DataFrame:
    """Per queue: depth, reserved, distinct consumers of reserved work, dead letters, delayed and retry backlog."""
    where = F.col("placement")
    return log.groupBy("queue").agg(
        _n(where == "ready").alias("depth"),
        _n(where == "pending").alias("reserved"),
        F.count_distinct(F.when(where == "pending", F.col("consumer"))).alias("consumers"),
        _n(where == "dead").alias("dead"),
        _n(where == "delayed").alias("delayed"),
        _n((where == "delayed") & F.col("is_retry")).alias("retry_backlog"),
    )


def queue_snapshot(log: DataFrame, queues: DataFrame) -> DataFrame:
    """Every configured queue, zero-filled."""
    out = queues.join(queue_counts(log), "queue", "left")
    return out.select("queue", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("depth", "reserved", "consumers", "dead", "delayed", "retry_backlog")])


def key_snapshot(log: DataFrame) -> DataFrame:
    """Per queue and fairness key: ready, reserved, and the age of the first ready entry in stream order."""
    ready = F.col("placement") == "ready"
    return log.groupBy("queue", "fairness_key").agg(
        _n(ready).alias("ready"),
        _n(F.col("placement") == "pending").alias("reserved"),
        F.min_by(F.when(ready, F.col("created_us")), F.when(ready, F.col("seq"))).alias("first_us"),
    ).withColumn("oldest_ready_us", F.when(F.col("first_us").isNull(), F.lit(0).cast("long")).otherwise(age("first_us"))).drop("first_us")


def fair_queue_snapshot(log: DataFrame) -> DataFrame:
    """Per queue over its keys: sums, distinct consumers across keys, and the oldest age of any key."""
    keys = key_snapshot(log).groupBy("queue").agg(F.sum("ready").alias("ready"), F.sum("reserved").alias("reserved"), F.max("oldest_ready_us").alias("oldest_ready_us"))
    consumers = log.filter("placement = 'pending'").groupBy("queue").agg(F.count_distinct("consumer").alias("consumers"))
    return keys.join(consumers, "queue", "left").withColumn("consumers", F.coalesce("consumers", F.lit(0).cast("long")))


def resolve_rules(keys: DataFrame, rules: DataFrame, rule_keys: DataFrame) -> DataFrame:
    """Each key's fairness rule, or the default rule."""
    return keys.join(rule_keys, "fairness_key", "left").withColumn("bucket", F.coalesce("bucket", F.lit("default"))).join(rules, "bucket", "left")


def bucket_snapshot(log: DataFrame, queues: DataFrame, rules: DataFrame, rule_keys: DataFrame) -> DataFrame:
    """Per queue and configured bucket: depth, reserved, oldest age, weight; buckets without work are kept."""
    live = key_snapshot(log).join(rule_keys, "fairness_key", "left").withColumn("bucket", F.coalesce("bucket", F.lit("default")))
    sums = live.groupBy("queue", "bucket").agg(F.sum("ready").alias("depth"), F.sum("reserved").alias("reserved"), F.max("oldest_ready_us").alias("oldest_ready_us"))
    out = queues.crossJoin(rules.select("bucket", "weight")).join(sums, ["queue", "bucket"], "left")  # two constant tables
    return out.select("queue", "bucket", "weight", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("depth", "reserved", "oldest_ready_us")])


def oldest_ready(entries: DataFrame, pending: DataFrame) -> DataFrame:
    """First entry per queue, by stream order, that is not pending: an anti join and one partial minimum."""
    free = entries.join(pending.select("seq"), "seq", "left_anti")
    return free.groupBy("queue").agg(F.min_by(F.struct("task_id", "created_us"), "seq").alias("x")).select("queue", "x.task_id", age("x.created_us").alias("oldest_ready_us"))


def scheduler_lag(log: DataFrame, queues: DataFrame) -> DataFrame:
    """Lateness of each queue's earliest delayed entry (by millisecond, then id), 0 if none is late or there is none."""
    first = log.filter("placement = 'delayed'").groupBy("queue").agg(F.min_by("eta_us", F.struct(F.floor(F.col("eta_us") / 1000), "task_id")).alias("first_us"))
    return queues.join(first, "queue", "left").select("queue", F.greatest(F.lit(AS_OF_US) - F.coalesce("first_us", F.lit(AS_OF_US)), F.lit(0).cast("long")).alias("lag_us"))


def key_counts(log: DataFrame) -> DataFrame:
    """All that admission looks at, by queue and fairness key, in one pass over the log."""
    where = F.col("placement")
    ready = where == "ready"
    return log.groupBy("queue", "fairness_key").agg(
        _n(where.isin("ready", "pending")).alias("own"), _n(where == "dead").alias("dead"), _n((where == "delayed") & F.col("is_retry")).alias("retries"),
        F.min_by(F.when(ready, F.col("created_us")), F.when(ready, F.col("seq"))).alias("first_us"),
    ).withColumn("oldest", F.when(F.col("first_us").isNull(), F.lit(0).cast("long")).otherwise(age("first_us"))).drop("first_us")


def admission_signals(totals: DataFrame, policies: DataFrame, fair_queues: DataFrame, how: str) -> DataFrame:
    """What the policy of each queue looks at, from totals (queue, pending, oldest, retries, dead, own: a key's pending work). A signal whose
    threshold is 0 is off and reads 0; delayed work is not pending; a key's work counts only where its queue has a fairness policy."""
    at = totals.join(policies, "queue", how).join(fair_queues.withColumn("fair", F.lit(True)), "queue", "left")

    def on(condition, value: str):
        return F.when(condition, F.coalesce(value, F.lit(0).cast("long"))).otherwise(F.lit(0).cast("long"))

    return at.withColumns({
        "queue_pending": F.coalesce("pending", F.lit(0).cast("long")), "key_pending": on(F.coalesce("fair", F.lit(False)) & (F.col("max_pending_per_key") > 0), "own"),
        "oldest_age_us": on(F.col("max_oldest_age_us") > 0, "oldest"), "retry_signal": on(F.col("max_retry_backlog") > 0, "retries"), "dead_signal": on(F.col("max_dead") > 0, "dead"),
    })


def admission_reason(key_pending):
    """The first threshold reached; 0 turns one off."""

    def hit(limit: str, value):
        return (F.col(limit) > 0) & (value >= F.col(limit))

    return (
        F.when(hit("max_pending_per_key", key_pending), "fairness_key_pending_cap")
        .when(hit("max_pending", F.col("queue_pending")), "queue_pending_cap")
        .when(hit("max_oldest_age_us", F.col("oldest_age_us")), "oldest_ready_age")
        .when(hit("max_retry_backlog", F.col("retry_signal")), "retry_backlog")
        .when(hit("max_dead", F.col("dead_signal")), "dead_letter_size")
        .otherwise("")
    )


def decide(at: DataFrame, source) -> DataFrame:
    """Decision and state for a publish of the given source: releases are deferred where others are rejected, dead letters pass."""
    reason = F.col("reason")
    free = (reason == "") | (source == "dead_letter") | F.coalesce(F.col("mode") == "disabled", F.lit(True))
    decision = F.when(free, "accepted").when((F.col("mode") == "reject") & (source != "due_release"), "rejected").otherwise("deferred")
    state = F.when(free, "normal").when(F.col("mode") == "reject", "rejecting").otherwise("degraded")
    return at.withColumns({"decision": decision, "state": state}).withColumn("defer_until_us", F.when(F.col("decision") == "deferred", F.lit(AS_OF_US) + F.col("defer_us")))


def key_decisions(log: DataFrame, policies: DataFrame, fair_queues: DataFrame, source: str = "new") -> DataFrame:
    """What a message of each queue and fairness key would meet. A blank key is the default key and counts like any other."""
    queue = Window.partitionBy("queue")
    totals = key_counts(log).select("queue", "fairness_key", "own", F.sum("own").over(queue).alias("pending"), F.max("oldest").over(queue).alias("oldest"), F.sum("retries").over(queue).alias("retries"), F.sum("dead").over(queue).alias("dead"))
    at = admission_signals(totals, policies, fair_queues, "left")
    return decide(at.withColumn("reason", F.coalesce(admission_reason(F.col("key_pending")), F.lit(""))), F.lit(source))


def admission_status(log: DataFrame, policies: DataFrame, fair_queues: DataFrame) -> DataFrame:
    """What a new message without fairness key would meet on each queue with a policy: it counts with the default key, that of messages without
    one."""
    totals = key_counts(log).groupBy("queue").agg(F.sum("own").alias("pending"), F.max("oldest").alias("oldest"), F.sum("retries").alias("retries"), F.sum("dead").alias("dead"), F.max(F.when(F.col("fairness_key") == "", F.col("own"))).alias("own"))
    at = admission_signals(totals, policies, fair_queues, "right")
    at = at.withColumn("reason", admission_reason(F.col("key_pending")))
    return decide(at, F.lit("new")).select("queue", "mode", "queue_pending", "key_pending", "oldest_age_us", "retry_signal", "dead_signal", "reason", "decision", "state", "defer_until_us")


def fairness_tiers(log: DataFrame, rules: DataFrame, rule_keys: DataFrame) -> DataFrame:
    """Tier of every key by its own reserved work, the reason where it is deferred, and whether its tier is served next."""
    keys = key_snapshot(log).withColumnRenamed("reserved", "in_use")
    at = resolve_rules(keys, rules, rule_keys)
    used, soft = F.col("in_use"), F.col("soft_quota")
    hard = (F.col("hard_quota") > 0) & (used >= F.col("hard_quota"))
    tier = F.when(used < F.col("reserved"), "reserved").when(hard, "").when((soft <= 0) | (used < soft), "shared").when(used < soft + F.col("burst"), "borrow").otherwise("")
    at = at.withColumns({"tier": tier, "deferral": F.when(used < F.col("reserved"), "").when(hard, "hard_quota").when(tier == "", "soft_quota").otherwise("")})
    rank = F.when(F.col("ready") == 0, 9).when(F.col("tier") == "reserved", 1).when(F.col("tier") == "shared", 2).when(F.col("tier") == "borrow", 3).otherwise(9)
    best = F.min("tier_rank").over(Window.partitionBy("queue"))
    at = at.withColumn("tier_rank", rank).withColumn("candidate", (F.col("tier_rank") < 9) & (F.col("tier_rank") == best))
    return at.select("queue", "fairness_key", "bucket", "weight", "ready", "in_use", "tier", "deferral", "candidate")


def weighted_picks(tiers: DataFrame, tickets: DataFrame) -> DataFrame:
    """Weighted round-robin in closed form: ticket t takes the candidate whose interval of summed weights holds (t - 1) mod sum."""
    order = Window.partitionBy("queue").orderBy("fairness_key")
    w = F.greatest(F.col("weight"), F.lit(1))
    slots = tiers.filter("candidate").withColumn("hi", F.sum(w).over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("lo", F.col("hi") - w).withColumn("total", F.sum(w).over(Window.partitionBy("queue")))
    at = F.pmod(F.col("ticket") - 1, F.col("total"))
    return slots.join(tickets, (at >= F.col("lo")) & (at < F.col("hi"))).select("queue", "ticket", "fairness_key")


def state_changes(events: DataFrame, at: str) -> DataFrame:
    """Rows whose (state, reason) differs from the row before in their queue."""
    order = Window.partitionBy("queue").orderBy(at)
    changed = ~(F.lag("state").over(order).eqNullSafe(F.col("state")) & F.lag("reason").over(order).eqNullSafe(F.col("reason")))
    return events.withColumn("changed", changed).filter("changed").drop("changed")
