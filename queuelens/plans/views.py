"""Queries that show state: queues, tenants, deliveries, dead letters, metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import delivery, metrics, snapshots
from ..sources.task_log import AS_OF_US, DAY_US, dim, task_log
from .base import registry

QUERIES: dict = {}
query = registry(QUERIES)


KEYS_SQL = f""", keys AS (SELECT queue, fairness_key, count(*) FILTER (placement = 'ready') AS ready, count(*) FILTER (placement = 'pending') AS reserved_now,
  coalesce(greatest({AS_OF_US} - arg_min(created_us, seq) FILTER (placement = 'ready'), 0), 0) AS oldest_ready_us FROM log GROUP BY ALL)"""
COUNTS_SQL = """, snap AS (SELECT q.queue, coalesce(depth, 0) AS depth, coalesce(reserved, 0) AS reserved, coalesce(consumers, 0) AS consumers, coalesce(dead, 0) AS dead, coalesce(delayed, 0) AS delayed, coalesce(retry_backlog, 0) AS retry_backlog
  FROM queues q LEFT JOIN (SELECT queue, count(*) FILTER (placement = 'ready') AS depth, count(*) FILTER (placement = 'pending') AS reserved,
  count(DISTINCT CASE WHEN placement = 'pending' THEN consumer END) AS consumers, count(*) FILTER (placement = 'dead') AS dead,
  count(*) FILTER (placement = 'delayed') AS delayed, count(*) FILTER (placement = 'delayed' AND is_retry) AS retry_backlog FROM log GROUP BY queue) USING (queue))"""
SIG_SQL = COUNTS_SQL + KEYS_SQL + """, sig AS (SELECT p.*, depth + reserved AS queue_pending, fq.queue IS NOT NULL AND max_pending_per_key > 0 AS key_capped,
  CASE WHEN max_oldest_age_us > 0 THEN coalesce(oldest, 0) ELSE 0 END AS oldest_age_us, CASE WHEN max_retry_backlog > 0 THEN retry_backlog ELSE 0 END AS retry_signal,
  CASE WHEN max_dead > 0 THEN dead ELSE 0 END AS dead_signal
  FROM admission_policies p JOIN snap USING (queue) LEFT JOIN (SELECT queue, max(oldest_ready_us) AS oldest FROM keys GROUP BY queue) USING (queue) LEFT JOIN fair_queues fq USING (queue))"""
REASON_SQL = """CASE WHEN max_pending_per_key > 0 AND key_pending >= max_pending_per_key THEN 'fairness_key_pending_cap' WHEN max_pending > 0 AND queue_pending >= max_pending THEN 'queue_pending_cap'
  WHEN max_oldest_age_us > 0 AND oldest_age_us >= max_oldest_age_us THEN 'oldest_ready_age' WHEN max_retry_backlog > 0 AND retry_signal >= max_retry_backlog THEN 'retry_backlog' WHEN max_dead > 0 AND dead_signal >= max_dead THEN 'dead_letter_size' ELSE '' END"""


def decision_sql(source: str = "new") -> str:
    """decision, state and defer_until_us of rows with reason and mode."""
    free = "(reason = '' OR mode = 'disabled')" if source != "dead_letter" else "true"
    reject = "mode = 'reject'" if source != "due_release" else "false"
    return f"""CASE WHEN {free} THEN 'accepted' WHEN {reject} THEN 'rejected' ELSE 'deferred' END AS decision, CASE WHEN {free} THEN 'normal' WHEN mode = 'reject' THEN 'rejecting' ELSE 'degraded' END AS state,
  CASE WHEN {free} OR {reject} THEN NULL ELSE {AS_OF_US} + defer_us END AS defer_until_us"""


STATUS_SQL = SIG_SQL + f""", why0 AS (SELECT sig.*, CASE WHEN key_capped THEN coalesce((SELECT ready + reserved_now FROM keys k WHERE k.queue = sig.queue AND k.fairness_key = ''), 0) ELSE 0 END AS key_pending FROM sig),
why AS (SELECT *, {REASON_SQL} AS reason FROM why0),
status AS (SELECT queue, mode, queue_pending, key_pending, oldest_age_us, retry_signal, dead_signal, reason, {decision_sql()} FROM why)"""
#: The decision for every queue and fairness key, as {dec_new} and so on by source.
KEY_DECISIONS_SQL = SIG_SQL + f""", kp AS (SELECT k.queue, k.fairness_key, sig.* EXCLUDE (queue), CASE WHEN key_capped THEN ready + reserved_now ELSE 0 END AS key_pending FROM keys k JOIN sig USING (queue)), kr AS (SELECT *, {REASON_SQL} AS reason FROM kp),
dec AS (SELECT *, {decision_sql()} FROM kr)"""
STATUS_DIMS = ("queues", "fair_queues", "admission_policies")


def _status(spark, d):
    return snapshots.admission_status(task_log(spark, d), dim(spark, "admission_policies"), dim(spark, "fair_queues"))


def _decisions(spark, d, source="new"):
    return snapshots.key_decisions(task_log(spark, d), dim(spark, "admission_policies"), dim(spark, "fair_queues"), source)


@query(STATUS_SQL + " SELECT * FROM status", *STATUS_DIMS)
def admission_status(spark, d):
    return _status(spark, d)


@query(SIG_SQL + f""", kp AS (SELECT k.queue, k.fairness_key, sig.* EXCLUDE (queue), CASE WHEN key_capped THEN ready + reserved_now ELSE 0 END AS key_pending FROM keys k JOIN sig USING (queue)), kr AS (SELECT *, {REASON_SQL} AS reason FROM kp)
 SELECT queue, fairness_key, source, key_pending, reason, decision, state, defer_until_us FROM (SELECT 'new' AS source, *, {decision_sql()} FROM kr UNION ALL SELECT 'due_release', *, {decision_sql("due_release")} FROM kr UNION ALL SELECT 'dead_letter', *, {decision_sql("dead_letter")} FROM kr)""", *STATUS_DIMS)
def admission_decisions(spark, d):
    at = _decisions(spark, d)
    every = [snapshots.decide(at, F.lit(source)).withColumn("source", F.lit(source)) for source in ("new", "due_release", "dead_letter")]
    out = every[0].unionByName(every[1]).unionByName(every[2])
    return out.select("queue", "fairness_key", "source", "key_pending", "reason", "decision", "state", "defer_until_us")


@query(COUNTS_SQL + " SELECT * FROM snap", "queues")
def queue_snapshot(spark, d):
    return snapshots.queue_snapshot(task_log(spark, d), dim(spark, "queues"))


@query(KEYS_SQL + " SELECT queue, fairness_key, ready, reserved_now AS reserved, oldest_ready_us FROM keys")
def fairness_key_snapshot(spark, d):
    return snapshots.key_snapshot(task_log(spark, d))


@query(KEYS_SQL + """ SELECT queue, CAST(sum(ready) AS BIGINT) AS ready, CAST(sum(reserved_now) AS BIGINT) AS reserved, max(oldest_ready_us) AS oldest_ready_us,
 (SELECT count(DISTINCT consumer) FROM log l WHERE l.queue = keys.queue AND placement = 'pending') AS consumers FROM keys GROUP BY queue""")
def fair_queue_snapshot(spark, d):
    return snapshots.fair_queue_snapshot(task_log(spark, d))


@query(KEYS_SQL + """ SELECT q.queue, r.bucket, r.weight, CAST(coalesce(sum(ready), 0) AS BIGINT) AS depth, CAST(coalesce(sum(reserved_now), 0) AS BIGINT) AS reserved, coalesce(max(oldest_ready_us), 0) AS oldest_ready_us
 FROM queues q CROSS JOIN fairness_rules r LEFT JOIN (SELECT keys.*, coalesce(bucket, 'default') AS b FROM keys LEFT JOIN fairness_rule_keys USING (fairness_key)) k ON k.queue = q.queue AND k.b = r.bucket GROUP BY ALL""", "queues", "fairness_rules", "fairness_rule_keys")
def fairness_bucket_snapshot(spark, d):
    return snapshots.bucket_snapshot(task_log(spark, d), dim(spark, "queues"), dim(spark, "fairness_rules"), dim(spark, "fairness_rule_keys"))


TIERS_SQL = KEYS_SQL + """, r AS (SELECT keys.*, f.* FROM keys LEFT JOIN fairness_rule_keys k USING (fairness_key) LEFT JOIN fairness_rules f ON f.bucket = coalesce(k.bucket, 'default')),
t AS (SELECT *, CASE WHEN reserved_now < reserved THEN 'reserved' WHEN hard_quota > 0 AND reserved_now >= hard_quota THEN '' WHEN soft_quota <= 0 OR reserved_now < soft_quota THEN 'shared' WHEN reserved_now < soft_quota + burst THEN 'borrow' ELSE '' END AS tier,
 CASE WHEN reserved_now < reserved THEN '' WHEN hard_quota > 0 AND reserved_now >= hard_quota THEN 'hard_quota' WHEN soft_quota <= 0 OR reserved_now < soft_quota + burst THEN '' ELSE 'soft_quota' END AS deferral FROM r),
u AS (SELECT *, CASE WHEN ready = 0 OR tier = '' THEN 9 WHEN tier = 'reserved' THEN 1 WHEN tier = 'shared' THEN 2 ELSE 3 END AS tr FROM t),
tiers AS (SELECT queue, fairness_key, bucket, weight, ready, reserved_now AS in_use, tier, deferral, tr < 9 AND tr = min(tr) OVER (PARTITION BY queue) AS candidate FROM u)"""


def _tiers(spark, d):
    return snapshots.fairness_tiers(task_log(spark, d), dim(spark, "fairness_rules"), dim(spark, "fairness_rule_keys"))


@query(TIERS_SQL + " SELECT * FROM tiers", "fairness_rules", "fairness_rule_keys")
def fairness_tiers(spark, d):
    return _tiers(spark, d)


@query(TIERS_SQL + """, s AS (SELECT *, sum(greatest(weight, 1)) OVER (PARTITION BY queue ORDER BY fairness_key) AS hi, sum(greatest(weight, 1)) OVER (PARTITION BY queue) AS total FROM tiers WHERE candidate)
 SELECT queue, CAST(ticket AS BIGINT) AS ticket, fairness_key FROM s, range(1, 41) t(ticket) WHERE (ticket - 1) % total >= hi - greatest(weight, 1) AND (ticket - 1) % total < hi""", "fairness_rules", "fairness_rule_keys")
def weighted_round_robin(spark, d):
    return snapshots.weighted_picks(_tiers(spark, d), F.broadcast(spark.range(1, 41).withColumnRenamed("id", "ticket")))


@query(f""", free AS (SELECT * FROM log WHERE placement IN ('ready', 'pending') AND seq NOT IN (SELECT seq FROM log WHERE placement = 'pending'))
 SELECT queue, arg_min(task_id, seq) AS task_id, greatest({AS_OF_US} - arg_min(created_us, seq), 0) AS oldest_ready_us FROM free GROUP BY queue""")
def oldest_ready(spark, d):
    log = task_log(spark, d)
    return snapshots.oldest_ready(log.filter("placement in ('ready', 'pending')"), log.filter("placement = 'pending'"))


@query(f"""SELECT q.queue, greatest({AS_OF_US} - coalesce(first_us, {AS_OF_US}), 0) AS lag_us FROM queues q LEFT JOIN
 (SELECT queue, first(eta_us ORDER BY eta_us // 1000, task_id) AS first_us FROM log WHERE placement = 'delayed' GROUP BY queue) USING (queue)""", "queues")
def scheduler_lag(spark, d):
    return snapshots.scheduler_lag(task_log(spark, d), dim(spark, "queues"))


@query(f""", b AS (SELECT queue, CASE WHEN depth > lag(depth, 1, 0) OVER w THEN 'rejecting' ELSE 'normal' END AS state, day AS on_day FROM (SELECT queue, created_us // {DAY_US} AS day, count(*) AS depth FROM log GROUP BY ALL) WINDOW w AS (PARTITION BY queue ORDER BY day)),
 c AS (SELECT *, lag(state) OVER (PARTITION BY queue ORDER BY on_day) AS before FROM b) SELECT queue, on_day, state, '' AS reason FROM c WHERE before IS DISTINCT FROM state""")
def admission_state_changes(spark, d):
    from pyspark.sql import Window

    days = task_log(spark, d).groupBy("queue", F.floor(F.col("created_us") / DAY_US).alias("on_day")).agg(F.count("*").alias("depth"))
    more = F.col("depth") > F.coalesce(F.lag("depth").over(Window.partitionBy("queue").orderBy("on_day")), F.lit(0))
    return snapshots.state_changes(days.select("queue", "on_day", F.when(more, "rejecting").otherwise("normal").alias("state"), F.lit("").alias("reason")), "on_day")


@query("SELECT queue, position, task_id, fairness_key FROM (SELECT *, row_number() OVER (PARTITION BY queue ORDER BY seq) AS position FROM log WHERE placement = 'ready') WHERE position <= 64")
def group_read(spark, d):
    return delivery.next_ready(task_log(spark, d), 64)


@query(f"""SELECT task_id, queue, eta_us AS scheduled_for_us, {AS_OF_US} AS released_at_us, ({AS_OF_US} - eta_us) // 1000 AS release_lag_ms FROM log
 WHERE placement = 'delayed' AND eta_us // 1000 <= {AS_OF_US // 1000} ORDER BY eta_us // 1000, task_id LIMIT 100""")
def due_release(spark, d):
    return delivery.due(task_log(spark, d))


CLAIMS = "placement IN ('pending', 'acked') AND seq % 3 < 2"


@query(f""", c AS (SELECT delivery_id, concat('w-', CAST((seq + CASE WHEN seq % 5 = 0 THEN 1 ELSE 0 END) % 7 AS STRING)) AS caller FROM log WHERE {CLAIMS})
 SELECT c.delivery_id, caller, CASE WHEN l.consumer IS NULL THEN 'unknown' WHEN l.consumer <> caller THEN 'stale' WHEN {AS_OF_US} - l.created_us >= l.ttl_ns // 1000 THEN 'expired' ELSE 'ok' END AS verdict
 FROM c LEFT JOIN (SELECT * FROM log WHERE placement = 'pending') l USING (delivery_id)""")
def delivery_validation(spark, d):
    log = task_log(spark, d)
    claims = log.filter(CLAIMS).select("delivery_id", F.concat(F.lit("w-"), ((F.col("seq") + F.when(F.col("seq") % 5 == 0, 1).otherwise(0)) % 7).cast("string")).alias("caller"))
    return delivery.validate(claims, log.filter("placement = 'pending'"))


@query("""SELECT task_id, delivery_id, CAST(greatest(attempt + 1, 1) AS BIGINT) AS delivery_count, created_us, created_us + CASE WHEN ttl_ns > 0 THEN ttl_ns ELSE 30000000000 END // 1000 AS lease_expires_us,
 consumer AS lease_owner, 'leased' AS state FROM log WHERE placement = 'pending'""")
def leased_deliveries(spark, d):
    return delivery.deliveries(task_log(spark, d), 30_000_000_000)


@query(f"""SELECT queue, fairness_key, arg_min(delivery_id, seq) AS delivery_id, CAST(arg_min(attempt, seq) + 2 AS BIGINT) AS delivery_count, count(*) AS n_expired FROM log
 WHERE placement = 'pending' AND {AS_OF_US} - created_us >= ttl_ns // 1000 GROUP BY queue, fairness_key""")
def reclaim_expired(spark, d):
    return delivery.reclaimable(task_log(spark, d))


DEAD_SQL = """, dead AS (SELECT concat('dlq:', delivery_id) AS entry_id, concat('dlq.', queue) AS dlq_queue, concat('dead_letter:', delivery_id) AS dedup_key, task_id, task_name, queue, attempt, failure_class,
 delivery_id, consumer AS worker_identity, seq, row_number() OVER (PARTITION BY queue ORDER BY seq) AS position FROM log LEFT JOIN failure_classes USING (failure_code) WHERE placement = 'dead')"""


def _dead(spark, d):
    return delivery.envelopes(task_log(spark, d), dim(spark, "failure_classes"))


@query(DEAD_SQL + " SELECT entry_id, dlq_queue, dedup_key, task_id, task_name, failure_class, delivery_id, worker_identity FROM dead", "failure_classes")
def dead_letter_envelopes(spark, d):
    return _dead(spark, d).select("entry_id", "dlq_queue", "dedup_key", F.col("original_task.id").alias("task_id"), F.col("original_task.name").alias("task_name"), "failure_class", "delivery_id", "worker_identity")


@query(DEAD_SQL + " SELECT dlq_queue, position, entry_id, failure_class FROM dead WHERE position <= 50", "failure_classes")
def dead_letter_list(spark, d):
    return delivery.list_dead(_dead(spark, d)).select("dlq_queue", "position", "entry_id", "failure_class")


@query(DEAD_SQL + " SELECT entry_id, dlq_queue, task_id FROM dead WHERE entry_id = 'dlq:d-9'", "failure_classes")
def dead_letter_load(spark, d):
    return _dead(spark, d).filter("delivery_id = 'd-9'").select("entry_id", "dlq_queue", F.col("original_task.id").alias("task_id"))


@query(DEAD_SQL + f" SELECT task_id, queue, attempt, entry_id AS replayed_from, {AS_OF_US} AS replayed_at_us FROM dead WHERE position <= 25", "failure_classes")
def dead_letter_replay(spark, d):
    return delivery.replay(_dead(spark, d), 25)


@query(DEAD_SQL + " SELECT dlq_queue, count(*) AS n, min(seq) AS first_seq FROM dead WHERE position > 25 GROUP BY dlq_queue", "failure_classes")
def dead_letters_left(spark, d):
    dead = _dead(spark, d)
    return delivery.remaining(dead, delivery.list_dead(dead, 25)).groupBy("dlq_queue").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))


@query(DEAD_SQL + f" SELECT 'discard' AS action, dlq_queue AS queue, entry_id, task_id, {AS_OF_US} AS occurred_us, 'permanent' AS description FROM dead WHERE failure_class = 'permanent'", "failure_classes")
def dead_letter_discard_audit(spark, d):
    return delivery.audit(_dead(spark, d).filter("failure_class = 'permanent'"), "discard", "permanent")


@query("SELECT task_name, consumer, arg_max(task_id, seq) AS task_id, arg_max(CASE WHEN failed THEN 'failed' ELSE 'succeeded' END, seq) AS state FROM log WHERE placement = 'acked' GROUP BY task_name, consumer")
def latest_results(spark, d):
    return delivery.latest_result(task_log(spark, d))


@query(""", g AS (SELECT queue, task_name, CASE WHEN failed THEN 'failed' ELSE 'succeeded' END AS status, latency_ns FROM log WHERE placement IN ('acked', 'dead')),
 b AS (SELECT * FROM (VALUES """ + ", ".join(f"('{b:g}', {b})" for b in metrics.BUCKETS) + """, ('+Inf', 1e18)) v(le, bound))
 SELECT queue, task_name, status, count(*) AS n, CAST(sum(latency_ns) AS BIGINT) AS sum_ns, le, count(*) FILTER (latency_ns <= bound * 1e9) AS cumulative FROM g, b GROUP BY queue, task_name, status, le""")
def latency_histogram(spark, d):
    return metrics.latency_histogram(task_log(spark, d))


@query(""", g AS (SELECT queue, (seq % 40) * 1000000 + CASE WHEN seq % 17 = 0 THEN 900000000 ELSE 0 END AS waited_ns FROM log WHERE placement IN ('acked', 'pending', 'dead')), b AS (SELECT * FROM (VALUES """ + ", ".join(f"('{b:g}', {b})" for b in metrics.BUCKETS) + """, ('+Inf', 1e18)) v(le, bound))
 SELECT queue, count(*) AS n, CAST(sum(waited_ns) AS BIGINT) AS sum_ns, le, count(*) FILTER (waited_ns <= bound * 1e9) AS cumulative FROM g, b GROUP BY queue, le""")
def reserve_latency_histogram(spark, d):
    waited = (F.col("seq") % 40) * 1_000_000 + F.when(F.col("seq") % 17 == 0, 900_000_000).otherwise(0)
    return metrics.histogram(task_log(spark, d).filter("placement in ('acked', 'pending', 'dead')").withColumn("waited_ns", waited), ["queue"], "waited_ns")


@query("SELECT queue, task_name, count(*) FILTER (placement = 'pending') AS active FROM log GROUP BY ALL")
def active_tasks(spark, d):
    return metrics.active_tasks(task_log(spark, d))


@query(STATUS_SQL + " SELECT queue, s AS state_label, CAST(s = state AS BIGINT) AS value FROM status, (VALUES ('normal'), ('degraded'), ('rejecting')) v(s)", *STATUS_DIMS)
def admission_state_gauges(spark, d):
    return metrics.one_hot(_status(spark, d))


@query(""", k AS (SELECT queue AS key FROM log WHERE failed UNION ALL SELECT concat(queue, ':', CAST(failure_code AS STRING)) FROM log WHERE failed) SELECT key, count(*) AS value FROM k GROUP BY key""")
def safety_counters(spark, d):
    return metrics.safety(task_log(spark, d))
