"""Queries over what changes a queue: acknowledgements, requeues, lease extensions, releases, retries, dead letters, results."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs
from ..operators import control, delivery
from ..sources.task_log import AS_OF_US, dim, task_log
from . import decisions, views
from .base import registry
from .decisions import FAIL_SQL, SYNC_PARTS

QUERIES: dict = {}
query = registry(QUERIES)

#: Who claims what: most owners, some strangers, some twice, and deliveries that are no longer pending.
CLAIMS_SQL = """, cl AS (SELECT delivery_id, concat('w-', CAST((seq + CASE WHEN seq % 5 = 0 THEN 1 ELSE 0 END) % 7 AS VARCHAR)) AS caller, seq * 2 AS pos, seq % 4 < 2 AS requeue FROM log WHERE placement IN ('pending', 'acked') AND seq % 3 < 2),
 claims AS (SELECT * FROM cl UNION ALL SELECT delivery_id, caller, pos + 1, requeue FROM cl WHERE pos % 3 = 0),
 pend AS (SELECT * FROM log WHERE placement = 'pending')"""
VERDICT_SQL = f"""CASE WHEN l.consumer IS NULL THEN 'unknown' WHEN l.consumer <> caller THEN 'stale' WHEN {AS_OF_US} - l.created_us >= l.ttl_ns // 1000 THEN 'expired' ELSE 'ok' END"""


def _claims(log, twice=True):
    s = F.col("seq")
    one = log.filter("placement in ('pending', 'acked') and seq % 3 < 2").select("delivery_id", F.concat(F.lit("w-"), ((s + F.when(s % 5 == 0, 1).otherwise(0)) % 7).cast("string")).alias("caller"), (s * 2).alias("pos"), (s % 4 < 2).alias("requeue"))
    return one.unionByName(one.filter("pos % 3 = 0").withColumn("pos", F.col("pos") + 1)) if twice else one


ACK_SQL = CLAIMS_SQL + f""", v AS (SELECT c.*, {VERDICT_SQL} AS verdict FROM claims c LEFT JOIN pend l USING (delivery_id)),
 acks AS (SELECT delivery_id, caller, pos, CASE WHEN count(*) FILTER (verdict = 'ok') OVER (PARTITION BY delivery_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 0 THEN 'unknown' WHEN verdict = 'ok' THEN 'acked' ELSE verdict END AS result FROM v)"""


@query(ACK_SQL + " SELECT * FROM acks")
def ack(spark, d):
    log = task_log(spark, d)
    return delivery.acknowledge(_claims(log), log.filter("placement = 'pending'"))


@query(ACK_SQL + " SELECT delivery_id, task_id, queue FROM pend WHERE delivery_id NOT IN (SELECT delivery_id FROM acks WHERE result = 'acked')")
def pending_after_ack(spark, d):
    pending = task_log(spark, d).filter("placement = 'pending'")
    return delivery.pending_after(pending, delivery.acknowledge(_claims(task_log(spark, d)), pending)).select("delivery_id", "task_id", "queue")


NACK_SQL = views.KEY_DECISIONS_SQL + CLAIMS_SQL + f""", v AS (SELECT c.*, {VERDICT_SQL} AS verdict, l.task_id, l.attempt, l.queue, decision, reason, defer_until_us FROM cl c LEFT JOIN pend l USING (delivery_id) LEFT JOIN dec USING (queue, fairness_key)),
 n AS (SELECT *, CASE WHEN verdict <> 'ok' THEN verdict WHEN NOT requeue THEN 'nacked' WHEN decision = 'rejected' THEN 'requeue_rejected' WHEN decision = 'deferred' THEN 'requeue_deferred' ELSE 'requeued' END AS result FROM v),
 nacks AS (SELECT delivery_id, caller, result, CASE WHEN result IN ('requeued', 'requeue_deferred') THEN task_id END AS task_id, CASE WHEN result IN ('requeued', 'requeue_deferred') THEN concat('requeue:', delivery_id) END AS dedup_key,
  CASE WHEN result IN ('requeued', 'requeue_deferred') THEN attempt END AS attempt, CASE WHEN result = 'requeue_deferred' THEN defer_until_us END AS eta_us, CASE WHEN result IN ('requeue_rejected', 'requeue_deferred') THEN reason END AS reason FROM n)"""


def _nacks(spark, d):
    log = task_log(spark, d)
    return delivery.negative_acknowledge(_claims(log, False), log.filter("placement = 'pending'"), views._decisions(spark, d))


@query(NACK_SQL + " SELECT * FROM nacks", *views.STATUS_DIMS)
def nack(spark, d):
    return _nacks(spark, d)


@query(NACK_SQL + " SELECT delivery_id, task_id, queue FROM pend WHERE delivery_id NOT IN (SELECT delivery_id FROM nacks WHERE result IN ('nacked', 'requeued', 'requeue_deferred'))", *views.STATUS_DIMS)
def pending_after_nack(spark, d):
    return delivery.pending_after(task_log(spark, d).filter("placement = 'pending'"), _nacks(spark, d)).select("delivery_id", "task_id", "queue")


EXTEND_SQL = CLAIMS_SQL + f""", e AS (SELECT delivery_id, caller, {VERDICT_SQL} AS verdict, l.queue, l.attempt, l.ttl_ns FROM cl LEFT JOIN pend l USING (delivery_id))"""


@query(EXTEND_SQL + f" SELECT delivery_id, caller, verdict, CASE WHEN verdict = 'ok' THEN {AS_OF_US} + ttl_ns // 1000 END AS lease_expires_us, CAST(CASE WHEN verdict = 'ok' THEN attempt + 1 END AS BIGINT) AS delivery_count, verdict <> 'ok' AS failed FROM e")
def extend_lease(spark, d):
    log = task_log(spark, d)
    return delivery.extend_leases(_claims(log, False), log.filter("placement = 'pending'"), 30_000_000_000)


def rfc3339_sql(us: str) -> str:
    """The same text as exprs.rfc3339 for microseconds."""
    return f"""concat(strftime(make_timestamp(CAST({us} AS BIGINT)), '%Y-%m-%dT%H:%M:%S'), CASE WHEN ({us}) % 1000000 = 0 THEN '' ELSE rtrim(concat('.', lpad(CAST(({us}) % 1000000 AS VARCHAR), 6, '0')), '0') END, 'Z')"""


MOVE_SQL = views.SIG_SQL + f""", kp AS (SELECT k.queue, k.fairness_key, CASE WHEN key_capped THEN ready + reserved_now ELSE 0 END AS key_pending FROM keys k JOIN sig USING (queue)),
 due AS (SELECT * FROM log WHERE placement = 'delayed' AND eta_us // 1000 <= {AS_OF_US // 1000} ORDER BY eta_us // 1000, task_id LIMIT 100),
 q AS MATERIALIZED (SELECT due.task_id, due.queue, due.fairness_key, eta_us, is_retry, sig.* EXCLUDE (queue), key_pending AS kpend, row_number() OVER (PARTITION BY due.queue ORDER BY eta_us // 1000, task_id) AS n FROM due JOIN sig USING (queue) JOIN kp USING (queue, fairness_key)),
 moved AS (SELECT * FROM (WITH RECURSIVE s AS (SELECT queue, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS acc, CAST(0 AS BIGINT) AS retries, CAST([] AS VARCHAR[]) AS held, CAST(NULL AS VARCHAR) AS task_id, CAST(NULL AS BIGINT) AS eta_us, '' AS reason, CAST(0 AS BIGINT) AS defer_us FROM (SELECT DISTINCT queue FROM q)
  UNION ALL SELECT queue, n, acc + CASE WHEN why = '' THEN 1 ELSE 0 END, retries + CASE WHEN why = '' AND is_retry THEN 1 ELSE 0 END, CASE WHEN why = '' THEN list_append(held, fairness_key) ELSE held END, task_id, eta_us, why, defer_us FROM (
   SELECT q.*, s.acc, s.retries, s.held, CASE WHEN q.mode = 'disabled' THEN '' WHEN q.key_capped AND q.kpend + len(list_filter(s.held, lambda z: z = q.fairness_key)) >= q.max_pending_per_key THEN 'fairness_key_pending_cap'
    WHEN q.max_pending > 0 AND q.queue_pending + s.acc >= q.max_pending THEN 'queue_pending_cap' WHEN q.max_oldest_age_us > 0 AND q.oldest_age_us >= q.max_oldest_age_us THEN 'oldest_ready_age'
    WHEN q.max_retry_backlog > 0 AND q.retry_signal - s.retries >= q.max_retry_backlog THEN 'retry_backlog' WHEN q.max_dead > 0 AND q.dead_signal >= q.max_dead THEN 'dead_letter_size' ELSE '' END AS why FROM s JOIN q ON q.queue = s.queue AND q.n = s.n + 1)) SELECT * FROM s) WHERE n > 0)"""


@query(MOVE_SQL + f""" SELECT task_id, moved.queue, {rfc3339_sql('eta_us')} AS scheduled_for, {rfc3339_sql(str(AS_OF_US))} AS released_at, ({AS_OF_US} - eta_us) // 1000 AS release_lag_ms, CASE WHEN reason = '' THEN 'accepted' ELSE 'deferred' END AS decision, reason,
 CASE WHEN reason <> '' THEN 'delayed' WHEN fq.queue IS NOT NULL THEN 'fair_ready' ELSE 'ready' END AS route, CASE WHEN reason <> '' THEN {AS_OF_US} + defer_us END AS eta_us FROM moved LEFT JOIN fair_queues fq ON fq.queue = moved.queue""", *views.STATUS_DIMS)
def move_due(spark, d):
    return delivery.move_due(task_log(spark, d), views._decisions(spark, d, "due_release"), dim(spark, "fair_queues"), 7, 7)


@query(MOVE_SQL + SYNC_PARTS + """ SELECT 'move_due:accepted' AS operation, count(*) AS rows, 'leader' AS role FROM moved WHERE reason = '' HAVING count(*) > 0 UNION ALL SELECT 'move_due:deferred', count(*), 'leader' FROM moved WHERE reason <> '' HAVING count(*) > 0
 UNION ALL SELECT concat('sync_due:', action), count(*), 'leader' FROM sync GROUP BY action""", *views.STATUS_DIMS)
def scheduler_tick(spark, d):
    """One tick of the leader; the tests have the standby and the stale one."""
    return control.tick(move_due(spark, d), decisions.schedule_sync(spark, d), True, True, 7, 7)


@query(f"SELECT seq, {rfc3339_sql('created_us')} AS text, created_us AS us, created_us - 7200000000 AS us_of_offset FROM log")
def rfc3339_texts(spark, d):
    text = exprs.rfc3339(F.col("created_us"))
    return task_log(spark, d).select("seq", text.alias("text"), exprs.parse_rfc3339(F.regexp_replace(text, "Z$", "000Z")).alias("us"), exprs.parse_rfc3339(F.regexp_replace(text, "Z$", "+02:00")).alias("us_of_offset")).withColumn("us", F.when(F.col("text").contains("."), F.col("us")).otherwise(exprs.parse_rfc3339(F.col("text"))))


def duration_sql(ns: str) -> str:
    """The text of a duration from 0 to under a minute, in nanoseconds."""
    def cut(whole: str, rest: str, digits: int) -> str:
        return f"rtrim(rtrim(concat(CAST({whole} AS VARCHAR), '.', lpad(CAST({rest} AS VARCHAR), {digits}, '0')), '0'), '.')"

    return f"""CASE WHEN {ns} = 0 THEN '0s' WHEN {ns} < 1000000000 THEN concat({cut(f'{ns} // 1000000', f'{ns} % 1000000', 6)}, 'ms') ELSE concat({cut(f'{ns} // 1000000000', f'{ns} % 1000000000', 9)}, 's') END"""


@query(FAIL_SQL + f""" SELECT f.task_id, CAST(log.attempt + 1 AS INT) AS attempt, f.retry_at_us AS eta_us, {rfc3339_sql('f.retry_at_us')} AS retry_scheduled_at, {duration_sql('f.delay_ns')} AS retry_delay, f.failure_class AS retry_failure_class,
 CAST(f.delivery_count AS VARCHAR) AS retry_delivery_count, {rfc3339_sql('log.created_us')} AS retry_first_enqueued_at FROM failures f JOIN log USING (task_id) WHERE outcome = 'retry'""", "failure_classes", "retry_policies")
def retry_messages(spark, d):
    log = task_log(spark, d)
    return delivery.retry_messages(delivery.failures(log, dim(spark, "failure_classes"), dim(spark, "retry_policies")), log)


TRACE_SQL = "CASE WHEN seq % 3 = 0 THEN concat('t', CAST(seq AS VARCHAR)) WHEN seq % 3 = 1 THEN concat('p', CAST(seq AS VARCHAR)) ELSE '' END"


def _headers():
    s = F.col("seq").cast("string")
    headers = F.create_map(F.lit("trace_id"), F.when(F.col("seq") % 3 == 0, F.concat(F.lit(" t"), s)), F.lit("traceparent"), F.when(F.col("seq") % 3 == 1, F.concat(F.lit("00-p"), s, F.lit("-aa-01"))))
    return F.map_filter(headers, lambda k, v: v.isNotNull())


@query(f"""SELECT concat('dlq:', delivery_id) AS id, 'dead_letter' AS name, concat('dlq.', queue) AS queue, concat('dead_letter:', delivery_id) AS dedup_key, failure_class AS dead_letter_failure_class, concat('handler failed with code ', CAST(failure_code AS VARCHAR)) AS dead_letter_last_error,
 nullif({TRACE_SQL}, '') AS dead_letter_trace_id, 'accepted' AS decision, created_us AS first_enqueued_us, created_us + latency_ns // 1000 AS last_failure_us, CAST(greatest(attempt + 1, 1) AS BIGINT) AS delivery_count, consumer AS worker_identity, queue AS original_queue, task_name AS original_task_name FROM log LEFT JOIN failure_classes USING (failure_code) WHERE placement = 'dead'""", "failure_classes")
def dead_letter_publish(spark, d):
    rows = task_log(spark, d).filter("placement = 'dead'").join(dim(spark, "failure_classes"), "failure_code", "left").withColumn("headers", _headers())
    rows = rows.withColumn("error", F.concat(F.lit("handler failed with code "), F.col("failure_code").cast("string"))).withColumn("failed_us", F.col("created_us") + F.floor(F.col("latency_ns") / 1000))
    return delivery.dead_letter_messages(rows)


@query(f"""SELECT 'replay' AS action, concat('dlq.', queue) AS queue, concat('dlq:', delivery_id) AS entry_id, task_id, {AS_OF_US} AS occurred_us, 'replayed dead-letter entry' AS description FROM (SELECT *, row_number() OVER (PARTITION BY queue ORDER BY seq) AS position FROM log WHERE placement = 'dead') WHERE position <= 25""")
def dead_letter_replay_audit(spark, d):
    dead = delivery.envelopes(task_log(spark, d), dim(spark, "failure_classes"))
    return delivery.audit(delivery.list_dead(dead, 25), "replay", "replayed dead-letter entry")


@query("""SELECT task_id, arg_max(state, pos) AS state, max(pos) AS saved FROM (SELECT concat('job-', CAST(seq % 400 AS VARCHAR)) AS task_id, CASE WHEN failed THEN 'failed' ELSE 'succeeded' END AS state, seq AS pos FROM log WHERE placement = 'acked') GROUP BY task_id""")
def task_results(spark, d):
    state = F.when(F.col("failed"), "failed").otherwise("succeeded")
    saves = task_log(spark, d).filter("placement = 'acked'").select(F.concat(F.lit("job-"), (F.col("seq") % 400).cast("string")).alias("task_id"), state.alias("state"), F.col("seq").alias("saved"))
    return delivery.saved_results(saves)


@query("""SELECT seq, CASE WHEN seq % 3 = 0 THEN 'default' ELSE concat(' q', CAST(seq % 3 AS VARCHAR)) END AS queue, CASE WHEN seq % 4 = 0 THEN '' ELSE concat('k', CAST(seq % 4 AS VARCHAR)) END AS fairness_key, CASE WHEN seq % 5 < 2 THEN TIMESTAMP '2024-01-31 00:00:00' ELSE ts END AS created_at, seq % 7 = 0 AS bad FROM (SELECT event_id AS seq, ts FROM events)""")
def normalised_messages(spark, d):
    from ..sources.task_log import normalise, parse_messages

    s = F.col("seq")
    message = F.struct(
        F.when(s % 7 != 0, s.cast("string")).alias("id"), F.when(s % 3 == 0, "").otherwise(F.concat(F.lit(" q"), (s % 3).cast("string"))).alias("queue"), F.when(s % 4 == 0, " ").otherwise(F.concat(F.lit(" k"), (s % 4).cast("string"), F.lit(" "))).alias("fairness_key"),
        F.when(s % 5 == 0, "0001-01-01T00:00:00Z").when(s % 5 != 1, exprs.rfc3339(F.col("created_us"))).alias("created_at"), s.alias("unknown_field"),
    )
    rows = task_log(spark, d).select("seq", F.to_json(message).alias("value"))
    parsed = rows.select("seq", F.from_json("value", "id string").getField("id").isNull().alias("bad"), "value")
    return parsed.join(normalise(parse_messages(rows, keep="seq"), "2024-01-31 00:00:00").select("seq", "queue", "fairness_key", "created_at"), "seq").select("seq", "queue", "fairness_key", "created_at", "bad")


@query(f"SELECT seq, coalesce(eta_us <= {AS_OF_US}, true) AS is_due FROM log")
def due_predicate(spark, d):
    return task_log(spark, d).select("seq", delivery.is_due(F.col("eta_us")).alias("is_due"))


@query("""SELECT seq, CASE WHEN seq % 5 = 0 THEN 'permanent' WHEN seq % 4 = 0 THEN 'timeout' WHEN seq % 3 = 0 THEN 'lease_lost' ELSE 'transient_retryable' END AS failure_class FROM log""")
def failure_classification(spark, d):
    s = F.col("seq")
    lease = F.when(s % 3 == 0, F.when(s % 2 == 0, "expired").otherwise("stale")).otherwise("ok")
    return task_log(spark, d).select("seq", delivery.classify(F.when(s % 5 == 0, "permanent").otherwise(""), s % 4 == 0, lease).alias("failure_class"))


@query(views.KEY_DECISIONS_SQL + f""" SELECT seq, 'deferred' AS admission_decision, reason AS admission_reason, 'new' AS admission_source, {rfc3339_sql('defer_until_us')} AS admission_deferred_until, {rfc3339_sql(str(AS_OF_US))} AS admission_evaluated_at, defer_until_us AS eta_us, CAST(6 AS INT) AS n_headers
 FROM log JOIN dec USING (queue, fairness_key) WHERE decision = 'deferred'""", *views.STATUS_DIMS)
def deferral_headers(spark, d):
    at = task_log(spark, d).join(views._decisions(spark, d), ["queue", "fairness_key"]).filter("decision = 'deferred'")
    before = F.create_map(F.lit("admission_reason"), F.lit("old"), F.lit("other"), F.lit("x"))
    out = at.withColumn("headers", delivery.deferral_headers(before, "new", F.col("reason"), F.col("defer_until_us")))
    names = ("admission_decision", "admission_reason", "admission_source", "admission_deferred_until", "admission_evaluated_at")
    return out.select("seq", *[F.element_at("headers", n).alias(n) for n in names], F.col("defer_until_us").alias("eta_us"), F.size("headers").alias("n_headers"))
