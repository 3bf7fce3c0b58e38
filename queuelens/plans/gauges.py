"""Every registered metric family over the log and the snapshots, one row for each set of labels; and what is served from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs
from ..operators import control, metrics, snapshots
from ..sources.task_log import AS_OF_US, dim, task_log
from . import decisions, flows, views
from .base import registry

QUERIES: dict = {}
query = registry(QUERIES)

OVER = f"{AS_OF_US} - created_us >= ttl_ns // 1000"
RETRY = "placement = 'delayed' AND is_retry"
#: Families counted from the log: condition, labels, what is added. Both engines read the expressions.
LOG_FAMILIES = {
    "tasks_published_total": ("route NOT IN ('rejected', 'deduplicated')", ("queue",), "1"),
    "tasks_reserved_total": ("placement IN ('acked', 'pending', 'dead')", ("queue",), "1"),
    "tasks_reclaimed_total": ("placement = 'pending' AND expired", ("queue",), "1"),
    "tasks_completed_total": ("placement = 'acked' AND NOT failed", ("queue",), "1"),
    "tasks_failed_total": ("placement IN ('acked', 'dead') AND failed", ("queue",), "1"),
    "tasks_retried_total": (RETRY, ("queue",), "1"),
    "task_retry_schedules_total": (RETRY, ("queue", "task_name", "failure_class AS result_class"), "1"),
    "tasks_dead_lettered_total": ("placement = 'dead'", ("queue",), "1"),
    "task_dead_letter_results_total": ("placement = 'dead'", ("queue", "task_name", "failure_class AS result_class"), "1"),
    "task_execution_duration_seconds_count": ("placement IN ('acked', 'dead')", ("queue", "task_name", "CASE WHEN failed THEN 'failed' ELSE 'succeeded' END AS status"), "1"),
    "task_execution_duration_seconds_sum_ms": ("placement IN ('acked', 'dead')", ("queue", "task_name", "CASE WHEN failed THEN 'failed' ELSE 'succeeded' END AS status"), "latency_ns / 1000000"),
    "broker_reserve_latency_seconds_count": ("placement IN ('acked', 'pending', 'dead')", ("queue",), "1"),
    "broker_reserve_latency_seconds_sum_ms": ("placement IN ('acked', 'pending', 'dead')", ("queue",), "seq % 40"),
    "worker_active_tasks": ("placement = 'pending'", ("queue", "task_name"), "1"),
    "fairness_reservations_total": ("placement IN ('acked', 'pending', 'dead') AND fair", ("queue", "bucket AS fairness_bucket"), "1"),
    "admission_decisions_total": ("NOT deduplicated", ("queue", "'new' AS source", "decision", "reason"), "1"),
}
WORKER_FAMILIES = {
    "worker_shutdown_outcomes_total": ("state = 'stopped'", ("pool", "queue", "CASE WHEN forced THEN 'forced_timeout' ELSE 'drained' END AS outcome"), "1"),
    "worker_abandoned_deliveries_total": ("state = 'stopped' AND forced", ("pool", "queue", "'shutdown_timeout' AS reason"), "pending + running"),
    "worker_drain_lease_losses_total": ("state = 'draining'", ("pool", "queue"), "running % 2"),
}


def families_sql(defined: dict, rows: str) -> str:
    def one(family, condition, labels, added):
        parts = [x.rsplit(" AS ", 1) if " AS " in x else (x, x) for x in labels]
        said = ", ',', ".join(f"concat('{n}=', CASE WHEN trim(coalesce(CAST({e} AS VARCHAR), '')) = '' THEN '{exprs.METRIC_DEFAULTS.get(n, 'unknown')}' ELSE trim(CAST({e} AS VARCHAR)) END)" for e, n in parts)
        return f"SELECT '{family}' AS family, concat({said}) AS labels, CAST(sum({added}) AS DOUBLE) AS value FROM {rows} WHERE {condition} GROUP BY ALL"

    return " UNION ALL ".join(one(f, *x) for f, x in defined.items())


ROWS_SQL = decisions.ROUTES_SQL + f""", rows AS (SELECT routed.*, {OVER} AS expired, failure_class, coalesce(fk.bucket, 'default') AS bucket FROM routed LEFT JOIN failure_classes USING (failure_code) LEFT JOIN fairness_rule_keys fk USING (fairness_key))"""


def _rows(spark, d):
    at = decisions._routed(spark, d).withColumn("expired", F.lit(AS_OF_US) - F.col("created_us") >= F.floor(F.col("ttl_ns") / 1000)).withColumn("fair", F.coalesce("fair", F.lit(False)))
    return at.join(dim(spark, "failure_classes"), "failure_code", "left").join(dim(spark, "fairness_rule_keys"), "fairness_key", "left").withColumn("bucket", F.coalesce("bucket", F.lit("default")))


LOG_DIMS = (*views.STATUS_DIMS, "failure_classes", "fairness_rule_keys")


@query(ROWS_SQL + " " + families_sql(LOG_FAMILIES, "rows"), *LOG_DIMS)
def task_counters(spark, d):
    return metrics.families(_rows(spark, d), LOG_FAMILIES)


@query(decisions.WORKERS_SQL + " " + families_sql(WORKER_FAMILIES, "workers"))
def worker_counters(spark, d):
    return metrics.families(decisions._workers(spark, d), WORKER_FAMILIES)


QUOTA = {"fairness_quota_deferrals_total": ("deferral <> ''", ("queue", "bucket AS fairness_bucket", "deferral AS reason"), "1")}


@query(views.TIERS_SQL + " " + families_sql(QUOTA, "tiers"), "fairness_rules", "fairness_rule_keys")
def fairness_counters(spark, d):
    return metrics.families(views._tiers(spark, d), QUOTA)


ADJUSTED = {"worker_concurrency_adjustments_total": ("action <> ''", ("concat('pool-', pool) AS pool", "reason", "action"), "1")}
EFFECTIVE = {"worker_effective_concurrency": ("last", ("concat('pool-', pool) AS pool", "pool AS queue"), "concurrency")}


@query(decisions.ADAPTIVE_SQL + ", a AS (SELECT *, c AS concurrency, n = max(n) OVER (PARTITION BY pool) AS last FROM ctl) " + families_sql(ADJUSTED | EFFECTIVE, "a"))
def concurrency_metrics(spark, d):
    at = decisions._adaptive(spark, d)
    last = at.groupBy("pool").agg(F.max("window_us").alias("of"))
    return metrics.families(at.join(last, "pool").withColumn("last", F.col("window_us") == F.col("of")), ADJUSTED | EFFECTIVE)


BLOCKED = {"dependency_budget_blocked_total": ("NOT acquired", ("budget",), "1")}
RENEWALS = {"dependency_budget_lease_renew_failures_total": ("NOT ok AND seq % 4 = 1", ("budget",), "1")}


@query(decisions.LEASES_SQL + " " + families_sql(RENEWALS, "leases"), "task_budgets", "tight")
def budget_renew_failures(spark, d):
    return metrics.families(decisions._lease_history(spark, d), RENEWALS)


@query(decisions.ACQUIRE_SQL + " " + families_sql(BLOCKED, "acquires"), "task_budgets", "budgets")
def budget_blocked(spark, d):
    return metrics.families(decisions.budget_acquire(spark, d), BLOCKED)


EXTENDS = {"lease_extension_failures_total": ("failed AND queue IS NOT NULL", ("queue",), "1")}


@query(flows.EXTEND_SQL + ", x AS (SELECT *, verdict <> 'ok' AS failed FROM e) " + families_sql(EXTENDS, "x"))
def lease_extension_failures(spark, d):
    log = task_log(spark, d)
    claims = flows._claims(log, False)
    out = flows.delivery.extend_leases(claims, log.filter("placement = 'pending'"), 30_000_000_000)
    return metrics.families(out.join(log.filter("placement = 'pending'").select("delivery_id", "queue"), "delivery_id", "left"), EXTENDS)


STALE = {"scheduler_stale_write_rejections_total": ("stale", ("CASE WHEN seq % 3 = 0 THEN 'move_due' WHEN seq % 3 = 1 THEN 'sync_due' ELSE '' END AS operation",), "1"),
         "scheduler_control_plane_failures_total": ("NOT stale AND seq % 50 = 0", ("CASE WHEN seq % 3 = 0 THEN 'move_due' WHEN seq % 3 = 1 THEN 'sync_due' ELSE '' END AS operation", "'store_error' AS reason"), "1")}


@query(decisions.FENCED_SQL + " " + families_sql(STALE, "fenced"))
def scheduler_counters(spark, d):
    return metrics.families(decisions.fenced_writes(spark, d), STALE)


def _scrape(spark, d):
    """All gauges of a scrape, from the snapshots."""
    log, queues, rules, keys = task_log(spark, d), dim(spark, "queues"), dim(spark, "fairness_rules"), dim(spark, "fairness_rule_keys")
    snap, buckets = snapshots.queue_snapshot(log, queues), snapshots.bucket_snapshot(log, queues, rules, keys)
    status, budgets = views._status(spark, d), decisions.budget_usage(spark, d)
    live = metrics.worker_snapshots(decisions._workers(spark, d), 7_200_000_000)
    shown = [
        metrics.families(snap, {f"queue_{c}": ("true", ("queue",), c) for c in ("depth", "reserved", "consumers")} | {"dead_letter_queue_size": ("true", ("queue",), "dead")}),
        metrics.families(buckets, {f"fairness_{n}": ("true", ("queue", "bucket AS fairness_bucket"), c) for n, c in (("queue_depth", "depth"), ("queue_reserved", "reserved"), ("oldest_ready_us", "oldest_ready_us"), ("rule_weight", "weight"))}),
        metrics.gauge(snapshots.scheduler_lag(log, queues), "scheduler_queue_lag_us", ("queue",), "lag_us"),
        metrics.gauge(metrics.one_hot(status), "admission_state", ("queue", "state_label AS state"), "value"),
        metrics.families(status.withColumn("oldest_ready_age", F.col("oldest_age_us")), {f"admission_signal_{c}": ("true", ("queue",), c) for c in ("queue_pending", "key_pending", "oldest_age_us", "retry_signal", "dead_signal")}),
        metrics.families(budgets, {"dependency_budget_capacity": ("true", ("budget",), "capacity"), "dependency_budget_in_use": ("true", ("budget",), "in_use")}),
        metrics.gauge(metrics.one_hot(live, ("accepting", "draining", "stopped"), ("pool", "queue", "worker_id")), "worker_lifecycle_state", ("pool", "queue", "worker_id", "state_label AS state"), "value"),
        metrics.families(control.observe_leader(decisions._locks(spark, d)).filter("present").groupBy("owner").agg(F.max("epoch").alias("epoch"), F.max("ttl_ms").alias("ttl_ms")), {"scheduler_leader": ("true", ("owner",), "1"), "scheduler_leadership_epoch": ("true", ("owner",), "epoch"), "scheduler_leadership_ttl_ms": ("true", ("owner",), "ttl_ms")}),
    ]
    out = shown[0]
    for more in shown[1:]:
        out = out.unionByName(more)
    return out


SCRAPE_SQL = views.STATUS_SQL + decisions.WORKERS_SQL + decisions.LOCKS_SQL + f""", bk AS (SELECT q.queue, r.bucket, r.weight, CAST(coalesce(sum(ready), 0) AS BIGINT) AS depth, CAST(coalesce(sum(reserved_now), 0) AS BIGINT) AS reserved, coalesce(max(oldest_ready_us), 0) AS oldest_ready_us FROM queues q CROSS JOIN fairness_rules r
  LEFT JOIN (SELECT keys.*, coalesce(bucket, 'default') AS b FROM keys LEFT JOIN fairness_rule_keys USING (fairness_key)) k ON k.queue = q.queue AND k.b = r.bucket GROUP BY ALL),
 lag AS (SELECT q.queue, greatest({AS_OF_US} - coalesce(first_us, {AS_OF_US}), 0) AS lag_us FROM queues q LEFT JOIN (SELECT queue, first(eta_us ORDER BY eta_us // 1000, task_id) AS first_us FROM log WHERE placement = 'delayed' GROUP BY queue) USING (queue)),
 use AS (SELECT b.budget, capacity, CAST(coalesce(sum(tokens), 0) AS BIGINT) AS in_use FROM budgets b LEFT JOIN (SELECT budget, tokens FROM log JOIN task_budgets USING (task_name) WHERE placement = 'pending' AND created_us + ttl_ns // 1000 > {AS_OF_US}) USING (budget) GROUP BY ALL),
 hot AS (SELECT queue, s AS state_label, CAST(s = state AS BIGINT) AS value FROM status, (VALUES ('normal'), ('degraded'), ('rejecting')) v(s)), live AS (SELECT * FROM {decisions.LIVE_SQL}),
 hotw AS (SELECT pool, queue, worker_id, s AS state_label, CAST(s = state AS BIGINT) AS value FROM live, (VALUES ('accepting'), ('draining'), ('stopped')) v(s)), lead AS (SELECT owner, max(epoch) AS epoch, max(ttl_ms) AS ttl_ms FROM observed WHERE present GROUP BY owner)
 """ + " UNION ALL ".join((
    families_sql({f"queue_{c}": ("true", ("queue",), c) for c in ("depth", "reserved", "consumers")} | {"dead_letter_queue_size": ("true", ("queue",), "dead")}, "snap"),
    families_sql({f"fairness_{n}": ("true", ("queue", "bucket AS fairness_bucket"), c) for n, c in (("queue_depth", "depth"), ("queue_reserved", "reserved"), ("oldest_ready_us", "oldest_ready_us"), ("rule_weight", "weight"))}, "bk"),
    families_sql({"scheduler_queue_lag_us": ("true", ("queue",), "lag_us")}, "lag"), families_sql({"admission_state": ("true", ("queue", "state_label AS state"), "value")}, "hot"),
    families_sql({f"admission_signal_{c}": ("true", ("queue",), c) for c in ("queue_pending", "key_pending", "oldest_age_us", "retry_signal", "dead_signal")}, "status"),
    families_sql({"dependency_budget_capacity": ("true", ("budget",), "capacity"), "dependency_budget_in_use": ("true", ("budget",), "in_use")}, "use"),
    families_sql({"worker_lifecycle_state": ("true", ("pool", "queue", "worker_id", "state_label AS state"), "value")}, "hotw"),
    families_sql({"scheduler_leader": ("true", ("owner",), "1"), "scheduler_leadership_epoch": ("true", ("owner",), "epoch"), "scheduler_leadership_ttl_ms": ("true", ("owner",), "ttl_ms")}, "lead"),
))


@query(SCRAPE_SQL, *views.STATUS_DIMS, "fairness_rules", "fairness_rule_keys", "budgets", "task_budgets")
def scraped_gauges(spark, d):
    return _scrape(spark, d)


@query(views.COUNTS_SQL + """ SELECT queue, concat('{"depth":', CAST(depth AS VARCHAR), ',"reserved":', CAST(reserved AS VARCHAR), ',"consumers":', CAST(consumers AS VARCHAR), ',"dead":', CAST(dead AS VARCHAR), '}') AS body FROM snap""", "queues")
def admin_queue_json(spark, d):
    """The admin body of each queue."""
    snap = snapshots.queue_snapshot(task_log(spark, d), dim(spark, "queues"))
    return metrics.as_json(snap, ("queue",), ("depth", "reserved", "consumers", "dead"))


@query(views.COUNTS_SQL + """ SELECT concat('queue_depth{queue="', queue, '"} ', CAST(depth AS VARCHAR)) AS line FROM snap""", "queues")
def metrics_exposition(spark, d):
    """Lines of the text format that scrapers read."""
    return metrics.exposition(metrics.gauge(snapshots.queue_snapshot(task_log(spark, d), dim(spark, "queues")), "queue_depth", ("queue",), "depth"))
