"""Queries that decide: admission over time, budgets, slots, retries, schedules, leadership, adaptive concurrency."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs
from ..operators import control, delivery, metrics, snapshots
from ..sources.task_log import AS_OF_US, DAY_US, dim, task_log
from . import views
from .base import registry

QUERIES: dict = {}
query = registry(QUERIES)


@query(""", a AS (SELECT *, row_number() OVER (PARTITION BY queue, fairness_key ORDER BY seq) AS kr FROM log), b AS (SELECT *, sum(CASE WHEN kr <= 200 THEN 1 ELSE 0 END) OVER (PARTITION BY queue ORDER BY seq) AS qr FROM a),
 c AS (SELECT *, CASE WHEN kr <= 200 AND qr <= 1000 THEN 1 ELSE 0 END AS ok FROM b), e AS (SELECT *, sum(ok) OVER (PARTITION BY queue, fairness_key ORDER BY seq) - ok AS key_pending FROM c)
 SELECT seq, queue, fairness_key, CASE WHEN key_pending >= 200 THEN 'fairness_key_pending_cap' WHEN ok = 0 THEN 'queue_pending_cap' ELSE '' END AS reason FROM e""")
def admission_by_caps(spark, d):
    return control.admit_by_caps(task_log(spark, d).select("seq", "queue", "fairness_key"), 1000, 200)


def receipts_sql(publishes: str) -> str:
    """Deduplicated publishes (relation dedup: seq, dup) of a relation with seq, dedup_key, created_us, accepts."""
    dup = f"coalesce(x.created_us - s.last < {7 * DAY_US}, false)"
    return f""", x AS MATERIALIZED (SELECT seq, dedup_key, created_us, accepts, row_number() OVER (PARTITION BY dedup_key ORDER BY created_us, seq) AS n FROM {publishes} WHERE dedup_key <> ''), dedup AS (SELECT seq, false AS dup FROM {publishes} WHERE dedup_key = '' UNION ALL SELECT seq, dup FROM (
 WITH RECURSIVE s AS (SELECT seq, dedup_key, n, CASE WHEN accepts THEN created_us END AS last, false AS dup FROM x WHERE n = 1 UNION ALL SELECT x.seq, x.dedup_key, x.n, CASE WHEN NOT {dup} AND accepts THEN x.created_us ELSE s.last END, {dup}
 FROM s JOIN x ON x.dedup_key = s.dedup_key AND x.n = s.n + 1) SELECT * FROM s))"""


@query(", every AS (SELECT *, true AS accepts FROM log)" + receipts_sql("every") + " SELECT seq, dedup_key, dup AS deduplicated FROM log JOIN dedup USING (seq)")
def publish_dedup_ttl(spark, d):
    return delivery.with_receipts(task_log(spark, d).select("seq", "created_us", "dedup_key", F.lit(True).alias("accepts")), 7 * DAY_US).select("seq", "dedup_key", "deduplicated")


ROUTES_SQL = views.KEY_DECISIONS_SQL + ", pub AS (SELECT log.*, decision, defer_until_us, reason, decision <> 'rejected' AS accepts, fq.queue IS NOT NULL AS fair FROM log JOIN dec USING (queue, fairness_key) LEFT JOIN fair_queues fq ON fq.queue = log.queue)" + receipts_sql("pub") + f""",
 routed AS (SELECT pub.*, dup AS deduplicated, CASE WHEN dup THEN 'deduplicated' WHEN decision IN ('rejected', 'deferred') THEN decision WHEN coalesce(eta_us > {AS_OF_US}, false) THEN 'delayed' WHEN fair THEN 'fair_ready' ELSE 'ready' END AS route FROM pub JOIN dedup USING (seq))"""
DEFAULTED = f"CASE WHEN trim(fairness_key) = '' THEN '{exprs.DEFAULT_KEY}' ELSE trim(fairness_key) END"


def _routed(spark, d):
    return delivery.publish_routes(task_log(spark, d), views._decisions(spark, d), dim(spark, "fair_queues"), 7 * DAY_US)


@query(ROUTES_SQL + " SELECT seq, task_id, dedup_key, deduplicated FROM routed", *views.STATUS_DIMS)
def publish_dedup(spark, d):
    return _routed(spark, d).select("seq", "task_id", "dedup_key", "deduplicated")


@query(ROUTES_SQL + " SELECT seq, queue, fairness_key, route FROM routed", *views.STATUS_DIMS)
def publish_route(spark, d):
    return _routed(spark, d).select("seq", "queue", "fairness_key", "route")


@query(ROUTES_SQL + f", st AS (SELECT *, CASE WHEN route = 'ready' THEN queue ELSE concat(queue, ':', {DEFAULTED}) END AS stream FROM routed WHERE route IN ('ready', 'fair_ready')) SELECT stream, row_number() OVER (PARTITION BY stream ORDER BY seq) AS position, task_id, queue FROM st", *views.STATUS_DIMS)
def ready_append(spark, d):
    return delivery.streams(_routed(spark, d))


@query(ROUTES_SQL + " SELECT sha256(concat(task_id, ':', CAST(seq AS VARCHAR))) AS entry_id, (CASE WHEN route = 'deferred' THEN defer_until_us ELSE eta_us END) // 1000 AS score_ms, task_id, queue, CASE WHEN route = 'deferred' THEN defer_until_us ELSE eta_us END AS scheduled_for_us FROM routed WHERE route IN ('delayed', 'deferred')", *views.STATUS_DIMS)
def delayed_insert(spark, d):
    return delivery.delayed_entries(_routed(spark, d))


@query(ROUTES_SQL + f" SELECT sha256(dedup_key) AS receipt, max(created_us) + {7 * DAY_US} AS expires_us FROM routed WHERE accepts AND NOT deduplicated AND dedup_key <> '' GROUP BY dedup_key HAVING max(created_us) + {7 * DAY_US} > {AS_OF_US}", *views.STATUS_DIMS)
def publish_receipts(spark, d):
    return delivery.receipts(_routed(spark, d), 7 * DAY_US)


@query(ROUTES_SQL + f" SELECT queue, {DEFAULTED} AS key, count(*) AS entries, max(seq) AS last_seq, CAST(1 AS BIGINT) AS wake FROM routed WHERE route = 'fair_ready' GROUP BY ALL", *views.STATUS_DIMS)
def fair_append(spark, d):
    return delivery.fair_registry(_routed(spark, d))


def _requests(spark, d):
    return task_log(spark, d).filter("placement = 'pending'").join(dim(spark, "task_budgets"), "task_name").select("budget", "seq", "tokens", "created_us", "delivery_id", "ttl_ns")


ACQUIRE_SQL = """, q AS MATERIALIZED (SELECT budget, seq, tokens, capacity, row_number() OVER (PARTITION BY budget ORDER BY seq) AS n FROM log LEFT JOIN task_budgets USING (task_name) LEFT JOIN budgets USING (budget) WHERE placement = 'pending'),
 acquires AS (SELECT budget, seq, acquired FROM (WITH RECURSIVE s AS (SELECT budget, seq, n, tokens <= capacity AS acquired, CASE WHEN tokens <= capacity THEN tokens ELSE 0 END AS used FROM q WHERE n = 1 AND budget IS NOT NULL
 UNION ALL SELECT q.budget, q.seq, q.n, used + tokens <= capacity, used + CASE WHEN used + tokens <= capacity THEN tokens ELSE 0 END FROM s JOIN q ON q.budget = s.budget AND q.n = s.n + 1) SELECT * FROM s)
 UNION ALL SELECT budget, seq, true FROM q WHERE budget IS NULL)"""


@query(ACQUIRE_SQL + " SELECT * FROM acquires", "task_budgets", "budgets")
def budget_acquire(spark, d):
    pending = task_log(spark, d).filter("placement = 'pending'").select("seq", "task_name")
    return control.greedy_leases(pending.join(dim(spark, "task_budgets"), "task_name", "left").select("budget", "seq", "tokens"), dim(spark, "budgets"))


LEASES_SQL = f""", rq AS (SELECT budget, capacity, seq, tokens, created_us, concat('lease:', delivery_id) AS lease, least(ttl_ns // 1000, {DAY_US // 4}) AS ttl_us FROM log JOIN task_budgets USING (task_name) JOIN tight USING (budget) WHERE placement = 'pending'),
 ev AS (SELECT budget, capacity, seq * 4 AS seq, created_us AS at_us, 'acquire' AS action, lease, tokens, ttl_us FROM rq UNION ALL SELECT budget, capacity, seq * 4 + 1, created_us + {DAY_US // 8}, 'renew', lease, tokens, ttl_us FROM rq
  UNION ALL SELECT budget, capacity, seq * 4 + 2, created_us + {DAY_US // 6}, 'release', lease, tokens, ttl_us FROM rq WHERE (seq * 4 + 2) % 12 <> 2),
 q AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY budget ORDER BY at_us, seq) AS n FROM ev),
 leases AS (SELECT * FROM (WITH RECURSIVE s AS (SELECT budget, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(lease VARCHAR, tokens BIGINT, ends BIGINT)[]) AS held, CAST(0 AS BIGINT) AS seq, false AS ok, '' AS action FROM (SELECT DISTINCT budget FROM q)
  UNION ALL SELECT budget, n, CASE WHEN action = 'release' THEN list_filter(live, lambda h: h.lease <> lease) WHEN mine THEN list_transform(live, lambda h: CASE WHEN h.lease = lease THEN {{'lease': h.lease, 'tokens': h.tokens, 'ends': ends}} ELSE h END)
    WHEN acquires THEN list_append(live, {{'lease': lease, 'tokens': tokens, 'ends': ends}}) ELSE live END, seq, action = 'release' OR mine OR acquires, action
   FROM (SELECT *, action = 'acquire' AND NOT mine AND coalesce(list_sum(list_transform(live, lambda h: h.tokens)), 0) + tokens <= capacity AS acquires FROM (SELECT *, len(list_filter(live, lambda h: h.lease = lease)) > 0 AS mine
    FROM (SELECT q.*, q.at_us + q.ttl_us AS ends, list_filter(s.held, lambda h: h.ends > q.at_us) AS live FROM s JOIN q ON q.budget = s.budget AND q.n = s.n + 1)))) SELECT * FROM s WHERE n > 0))"""


def _lease_history(spark, d):
    at = _requests(spark, d).withColumn("ttl_us", F.least(F.floor(F.col("ttl_ns") / 1000), F.lit(DAY_US // 4)))
    lease = F.concat_ws(":", F.lit("lease"), "delivery_id")

    def events(action: str, shift: int, step: int):
        return at.select("budget", (F.col("seq") * 4 + step).alias("seq"), (F.col("created_us") + shift).alias("at_us"), F.lit(action).alias("action"), lease.alias("lease"), "tokens", "ttl_us")

    every = events("acquire", 0, 0).unionByName(events("renew", DAY_US // 8, 1)).unionByName(events("release", DAY_US // 6, 2).filter("seq % 12 <> 2"))
    return control.lease_history(every, dim(spark, "tight"))


@query(LEASES_SQL + " SELECT budget, seq, ok, CAST(coalesce(list_sum(list_transform(held, lambda h: h.tokens)), 0) AS BIGINT) AS used FROM leases", "task_budgets", "tight")
def budget_lease_history(spark, d):
    return _lease_history(spark, d)


@query(f"""SELECT b.budget, capacity, CAST(coalesce(sum(tokens), 0) AS BIGINT) AS in_use FROM budgets b LEFT JOIN (SELECT budget, tokens FROM log JOIN task_budgets USING (task_name) WHERE placement = 'pending' AND created_us + ttl_ns // 1000 > {AS_OF_US}) USING (budget) GROUP BY ALL""", "budgets", "task_budgets")
def budget_usage(spark, d):
    leases = _requests(spark, d).select("budget", "tokens", (F.col("created_us") + F.floor(F.col("ttl_ns") / 1000)).alias("ends_us"))
    return control.budget_usage(leases, dim(spark, "budgets"))


@query(""", r AS (SELECT seq, task_name, queue, global_limit, pool_limit, row_number() OVER (PARTITION BY task_name, queue ORDER BY seq) AS p FROM log LEFT JOIN task_limits USING (task_name) WHERE placement = 'pending'),
 g AS (SELECT *, coalesce(p <= pool_limit, true) AS fits, sum(CASE WHEN coalesce(p <= pool_limit, true) THEN 1 ELSE 0 END) OVER (PARTITION BY task_name ORDER BY seq) AS n FROM r)
 SELECT seq, task_name, queue, fits AND coalesce(n <= global_limit, true) AS gets_slot FROM g""", "task_limits")
def task_slots(spark, d):
    return control.task_slots(task_log(spark, d).filter("placement = 'pending'").select("seq", "task_name", "queue"), dim(spark, "task_limits"))


@query(""", r AS (SELECT queue, seq, task_name, budget, tokens, capacity, least(coalesce(global_limit, 12), coalesce(pool_limit, 12)) AS slots, row_number() OVER (PARTITION BY queue, task_name ORDER BY seq) AS mine
  FROM log LEFT JOIN task_limits USING (task_name) LEFT JOIN task_budgets USING (task_name) LEFT JOIN tight USING (budget) WHERE placement = 'ready'),
 q AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY queue ORDER BY seq) AS n FROM r WHERE mine <= least(slots, 12)),
 f AS (SELECT * FROM (WITH RECURSIVE s AS (SELECT queue, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS seq, CAST(0 AS BIGINT) AS running, false AS ok, CAST([] AS VARCHAR[]) AS held FROM (SELECT DISTINCT queue FROM q)
  UNION ALL SELECT q.queue, q.n, q.seq, running + CASE WHEN fits THEN 1 ELSE 0 END, fits, CASE WHEN fits AND budget IS NOT NULL THEN list_concat(held, list_transform(range(tokens), lambda z: budget)) ELSE held END
   FROM (SELECT q.*, s.running, s.held, s.running < 12 AND (q.budget IS NULL OR len(list_filter(s.held, lambda z: z = q.budget)) + q.tokens <= q.capacity) AS fits FROM s JOIN q ON q.queue = s.queue AND q.n = s.n + 1) q) SELECT * FROM s))
 SELECT queue, seq FROM f WHERE ok""", "task_limits", "task_budgets", "tight")
def dispatch_scan(spark, d):
    gates = dim(spark, "task_budgets").join(dim(spark, "tight"), "budget")
    return control.dispatch(task_log(spark, d).filter("placement = 'ready'").select("queue", "seq", "task_name"), 12, dim(spark, "task_limits"), F.broadcast(gates))


FAIL_SQL = f""", f AS (SELECT log.*, failure_class, p.max_deliveries, initial_ns, max_ns, multiplier, jitter, max_age_ns, CAST(attempt + 1 AS BIGINT) AS dc FROM log LEFT JOIN failure_classes USING (failure_code) LEFT JOIN retry_policies p USING (queue) WHERE failed),
 h AS (SELECT *, list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(string_split(concat(task_id, ':', CAST(dc AS VARCHAR)), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, b: (xor(a, b) * 16777619) & 4294967295) AS fnv FROM f),
 e AS (SELECT *, CAST(least(initial_ns * pow(multiplier, greatest(dc, 1) - 1), max_ns) AS BIGINT) AS base FROM h),
 g AS (SELECT *, CASE WHEN jitter > 0 THEN least(CAST(floor(base * greatest(0.0, 1.0 + (2.0 * ((fnv % 10000) / CAST(9999.0 AS DOUBLE)) - 1.0) * jitter)) AS BIGINT), max_ns) ELSE base END AS delay,
  CASE WHEN failure_class IN ('transient_retryable', 'timeout') THEN CASE WHEN max_deliveries > 0 AND dc < max_deliveries AND NOT (max_age_ns > 0 AND ({AS_OF_US} - created_us) * 1000 >= max_age_ns) THEN 'retry' ELSE 'dead_letter' END
  WHEN failure_class IN ('permanent', 'lease_lost', 'decode_or_validation') THEN 'dead_letter' ELSE 'ack' END AS outcome FROM e),
 failures AS (SELECT task_id, queue, failure_class, dc AS delivery_count, outcome, CASE WHEN outcome = 'retry' THEN delay END AS delay_ns, CASE WHEN outcome = 'retry' THEN {AS_OF_US} + delay // 1000 END AS retry_at_us FROM g)"""


def _failures(spark, d):
    return delivery.failures(task_log(spark, d), dim(spark, "failure_classes"), dim(spark, "retry_policies"))


@query(FAIL_SQL + " SELECT * FROM failures", "failure_classes", "retry_policies")
def failure_outcomes(spark, d):
    return _failures(spark, d)


@query(FAIL_SQL + views.STATUS_SQL + """ SELECT task_id, queue, CASE WHEN outcome = 'retry' AND decision = 'rejected' THEN 'overloaded' ELSE failure_class END AS failure_class,
 CASE WHEN outcome = 'retry' AND decision = 'rejected' THEN 'dead_letter' ELSE outcome END AS outcome FROM failures JOIN status USING (queue)""", "failure_classes", "retry_policies", *views.STATUS_DIMS)
def overloaded_retries(spark, d):
    return delivery.overloaded(_failures(spark, d), views._status(spark, d))


HISTORY = "CASE step WHEN 1 THEN 'queued' WHEN 2 THEN CASE WHEN seq % 11 = 0 THEN 'running' ELSE 'leased' END WHEN 3 THEN 'running' ELSE CASE WHEN placement = 'dead' THEN 'dead_lettered' WHEN placement = 'delayed' THEN 'retry_scheduled' WHEN seq % 13 = 0 THEN 'queued' ELSE 'succeeded' END END"


@query(f""", h AS (SELECT task_id, step, {HISTORY} AS state FROM log, (VALUES (1), (2), (3), (4)) v(step)), m AS (SELECT task_id, step, lag(state) OVER (PARTITION BY task_id ORDER BY step) AS from_state, state AS to_state FROM h)
 SELECT * FROM m WHERE from_state IS NOT NULL AND NOT EXISTS (SELECT 1 FROM state_transitions t WHERE t.from_state = m.from_state AND t.to_state = m.to_state)""", "state_transitions")
def transition_violations(spark, d):
    steps = task_log(spark, d).select("*", F.explode(F.array(*map(F.lit, (1, 2, 3, 4)))).alias("step")).select("task_id", "step", F.expr(HISTORY).alias("state"))
    return delivery.violations(steps, dim(spark, "state_transitions"))


SCHEDULES = "SELECT concat('s-', CAST(o_orderkey AS STRING)) AS schedule_id, o_orderkey % 17 <> 0 AS enabled, CAST(1 + o_orderkey % 96 AS BIGINT) * 900000000 AS interval_us, {us}(o_orderdate) + CAST(o_orderkey % 8 AS BIGINT) * 3600000000 AS next_run_us FROM orders"
SCHEDULES_SQL = "schedules AS (" + SCHEDULES.format(us="epoch_us") + ")"


def _schedules(spark, d):
    text = SCHEDULES.format(us="@").replace("@(o_orderdate)", "timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', o_orderdate)").replace("FROM orders", "FROM {orders}")
    return spark.sql(text, orders=spark.read.parquet(f"{d}/orders.parquet"))


@query(f""", {SCHEDULES_SQL} SELECT schedule_id, next_run_us AS nominal_us, next_run_us + (({AS_OF_US} - next_run_us) // interval_us + 1) * interval_us AS next_run_us, ({AS_OF_US} - next_run_us) // interval_us AS missed,
 concat('recurring:', schedule_id, ':', CAST(next_run_us AS VARCHAR)) AS dedup_key FROM schedules WHERE enabled AND next_run_us <= {AS_OF_US}""")
def recurring_due(spark, d):
    return control.recurring(_schedules(spark, d))


@query(f""", {SCHEDULES_SQL} SELECT schedule_id, next_run_us FROM schedules WHERE enabled AND next_run_us // 1000 <= {AS_OF_US // 1000} ORDER BY next_run_us // 1000, schedule_id LIMIT 100""")
def due_schedules(spark, d):
    return control.due_schedules(_schedules(spark, d).filter("enabled"))


#: Persisted states: some missing, some of another definition, some without a next run, some advanced by another scheduler meanwhile.
SYNC_SQL = f""", {SCHEDULES_SQL}, s AS (SELECT *, CAST(substr(schedule_id, 3) AS BIGINT) AS k FROM schedules),
 cf AS (SELECT schedule_id, enabled, interval_us, CAST(k % 7 AS VARCHAR) AS h, CASE WHEN k % 6 = 0 THEN {AS_OF_US} - k * 1000 END AS start_us FROM s WHERE k % 35 <> 0),
 ps AS (SELECT schedule_id, CASE WHEN k % 45 = 0 THEN '99' ELSE CAST(k % 7 AS VARCHAR) END AS had, CASE WHEN k % 55 <> 0 THEN next_run_us END AS next_run_us, CASE WHEN k % 65 = 0 THEN next_run_us + 1 ELSE next_run_us END AS seen_us FROM s WHERE k % 25 <> 0)"""


SYNC_PARTS = SYNC_SQL + f""", j AS (SELECT s.schedule_id, had, ps.next_run_us AS n, seen_us, cf.enabled, cf.interval_us AS iv, cf.schedule_id IS NOT NULL AS known, had IS NULL OR had <> h OR ps.next_run_us IS NULL AS fresh, start_us FROM s LEFT JOIN ps USING (schedule_id) LEFT JOIN cf ON cf.schedule_id = s.schedule_id),
 r AS (SELECT *, CASE WHEN coalesce(fresh, true) THEN coalesce(start_us, {AS_OF_US} + iv) ELSE n END AS run FROM j), sync AS (SELECT *, CASE WHEN NOT known THEN 'remove' WHEN NOT enabled THEN 'unindex' WHEN run > {AS_OF_US} THEN 'wait' WHEN NOT fresh AND seen_us <> n THEN 'lost_race' ELSE 'dispatch' END AS action FROM r)
"""


@query(SYNC_PARTS + f""" SELECT schedule_id, action, CASE WHEN action = 'dispatch' THEN {{nominal}} END AS nominal_at, CASE WHEN action = 'dispatch' THEN run + (({AS_OF_US} - run) // iv + 1) * iv END AS next_run_us, CASE WHEN action = 'dispatch' THEN ({AS_OF_US} - run) // iv END AS missed_runs,
 CASE WHEN action = 'dispatch' THEN concat('recurring:', schedule_id, ':', {{nominal}}) END AS dedup_key FROM sync""".replace("{nominal}", "concat(strftime(make_timestamp(CAST(run AS BIGINT)), '%Y-%m-%dT%H:%M:%S'), CASE WHEN run % 1000000 = 0 THEN '' ELSE rtrim(concat('.', lpad(CAST(run % 1000000 AS VARCHAR), 6, '0')), '0') END, 'Z')"))
def schedule_sync(spark, d):
    s = _schedules(spark, d).withColumn("k", F.substring("schedule_id", 3, 99).cast("long"))
    configured = s.filter("k % 35 <> 0").select("schedule_id", "enabled", "interval_us", (F.col("k") % 7).cast("string").alias("definition_hash"), F.when(F.col("k") % 6 == 0, F.lit(AS_OF_US) - F.col("k") * 1000).alias("start_us"))
    states = s.filter("k % 25 <> 0").select("schedule_id", F.when(F.col("k") % 45 == 0, "99").otherwise((F.col("k") % 7).cast("string")).alias("definition_hash"), F.when(F.col("k") % 55 != 0, F.col("next_run_us")).alias("next_run_us"), F.when(F.col("k") % 65 == 0, F.col("next_run_us") + 1).otherwise(F.col("next_run_us")).alias("seen_us"))
    return control.sync_due(s.select("schedule_id"), states, configured)


@query(f""", {SCHEDULES_SQL}, s AS (SELECT *, CAST(substr(schedule_id, 3) AS BIGINT) AS k FROM schedules), c AS (SELECT schedule_id, enabled, sha256(concat(schedule_id, chr(10), CAST(interval_us AS VARCHAR), chr(10), CAST(k % 7 AS VARCHAR))) AS h FROM s WHERE k % 35 <> 0),
 p AS (SELECT schedule_id, sha256(concat(schedule_id, chr(10), CAST(interval_us AS VARCHAR), chr(10), CAST(CASE WHEN k % 45 = 0 THEN 99 ELSE k % 7 END AS VARCHAR))) AS h, CASE WHEN k % 55 <> 0 THEN next_run_us END AS n FROM s WHERE k % 25 <> 0)
 SELECT coalesce(c.schedule_id, p.schedule_id) AS schedule_id, CASE WHEN c.schedule_id IS NULL THEN 'delete' WHEN p.schedule_id IS NULL THEN 'insert' WHEN c.h <> p.h OR p.n IS NULL THEN 'reset' ELSE 'keep' END AS action, coalesce(c.enabled, false) AS indexed FROM c FULL OUTER JOIN p ON c.schedule_id = p.schedule_id""")
def schedule_reconcile(spark, d):
    s = _schedules(spark, d).withColumn("k", F.substring("schedule_id", 3, 99).cast("long"))

    def digest(last):
        return F.sha2(F.concat_ws("\n", "schedule_id", F.col("interval_us").cast("string"), last.cast("string")), 256)

    c = s.filter("k % 35 <> 0").select("schedule_id", "enabled", digest(F.col("k") % 7).alias("definition_hash"))
    p = s.filter("k % 25 <> 0").select("schedule_id", digest(F.when(F.col("k") % 45 == 0, 99).otherwise(F.col("k") % 7)).alias("definition_hash"), F.when(F.col("k") % 55 != 0, F.col("next_run_us")).alias("next_run_us"))
    return control.reconcile(c, p)


TERMS = "SELECT concat('lock-', CAST(c_nationkey % 3 AS STRING)) AS lock, CAST(c_custkey - CASE WHEN c_custkey % 20 = 0 THEN 60 ELSE 0 END AS BIGINT) AS epoch, concat('owner-', CAST(c_custkey % 4 AS STRING)) AS owner, c_custkey * 1000000 AS acquired_us, c_custkey * 1000000 + 1500000 AS lost_us FROM {customer}"


def _terms(spark, d):
    return spark.sql(TERMS, customer=spark.read.parquet(f"{d}/customer.parquet"))


@query(f""", t AS ({TERMS.format(customer="customer")}) SELECT lock, epoch, owner, coalesce(epoch <= lag(epoch) OVER w, false) AS epoch_not_growing, coalesce(acquired_us < lag(lost_us) OVER w, false) AS overlaps FROM t WINDOW w AS (PARTITION BY lock ORDER BY acquired_us, epoch)""")
def leadership_audit(spark, d):
    return control.leadership_audit(_terms(spark, d))


FENCED_SQL = f""", t AS ({TERMS.format(customer="customer")}), w AS (SELECT seq, concat('lock-', CAST(seq % 3 AS STRING)) AS lock, seq * 137000 AS at_us, CAST(seq * 137 // 1000 AS BIGINT) AS epoch FROM log),
 fenced AS (SELECT seq, w.lock, w.epoch, w.epoch IS DISTINCT FROM t.epoch AS stale FROM w ASOF LEFT JOIN t ON w.lock = t.lock AND w.at_us >= t.acquired_us)"""


@query(FENCED_SQL + " SELECT * FROM fenced")
def fenced_writes(spark, d):
    writes = task_log(spark, d).select("seq", F.concat(F.lit("lock-"), (F.col("seq") % 3).cast("string")).alias("lock"), (F.col("seq") * 137000).alias("at_us"), F.floor(F.col("seq") * 137 / 1000).alias("epoch"))
    return control.fenced_writes(writes, _terms(spark, d))


def windows_sql(period: int) -> str:
    return f"""(SELECT queue, created_us - created_us % {period} AS window_us, count(*) AS executions, count(*) FILTER (failed) AS failures, CAST(sum(latency_ns) AS BIGINT) AS latency_sum_ns,
 count(*) FILTER (placement = 'dead' AND failure_code = 5) AS blocked, sum(latency_ns) / CAST(count(*) AS DOUBLE) AS mean_latency_ns, count(*) FILTER (failed) / CAST(count(*) AS DOUBLE) AS error_rate,
 (SELECT count(*) FROM log b WHERE b.queue = log.queue AND placement IN ('ready', 'pending')) AS backlog FROM log WHERE placement IN ('acked', 'dead') GROUP BY queue, created_us - created_us % {period})"""


@query("SELECT * FROM " + windows_sql(DAY_US))
def control_windows(spark, d):
    return control.control_windows(task_log(spark, d), DAY_US)


#: Least and most concurrency, steps down and up, thresholds of latency, errors and backlog, healthy windows needed, cooldown.
ADAPTIVE = (2, 12, 1, 2, 2_600_000_000, 0.5, 4, 2, DAY_US // 2)
ADAPTIVE_SQL = f""", q AS MATERIALIZED (SELECT *, queue AS pool, row_number() OVER (PARTITION BY queue ORDER BY window_us) AS n FROM {windows_sql(DAY_US // 4)}),
 ctl AS (SELECT * FROM (WITH RECURSIVE s AS (SELECT pool, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS window_us, 2 AS c, 0 AS healthy, CAST(NULL AS BIGINT) AS adj, '' AS action, '' AS reason FROM (SELECT DISTINCT pool FROM q)
  UNION ALL SELECT pool, n, window_us, nc, nh, CASE WHEN nc <> c THEN window_us ELSE adj END, CASE WHEN nc = c THEN '' WHEN why <> '' THEN 'scale_down' ELSE 'scale_up' END, CASE WHEN nc = c THEN '' WHEN why <> '' THEN why ELSE 'healthy_backlog' END
   FROM (SELECT *, CASE WHEN why <> '' THEN greatest(c - 1, 2) WHEN backlog >= 4 AND nh >= 2 AND (adj IS NULL OR window_us - adj >= {DAY_US // 2}) THEN least(c + 2, 12) ELSE c END AS nc
    FROM (SELECT *, CASE WHEN why = '' AND blocked = 0 THEN healthy + 1 ELSE 0 END AS nh FROM (SELECT q.pool, q.n, q.window_us, q.blocked, q.backlog, s.c, s.healthy, s.adj,
     CASE WHEN mean_latency_ns > 2600000000 THEN 'latency' WHEN error_rate > 0.5 THEN 'error_rate' WHEN blocked > 0 AND backlog >= 4 THEN 'budget_exhaustion' ELSE '' END AS why FROM s JOIN q ON q.pool = s.pool AND q.n = s.n + 1)))) SELECT * FROM s WHERE n > 0))"""


def _adaptive(spark, d):
    windows = control.control_windows(task_log(spark, d), DAY_US // 4).withColumnRenamed("queue", "pool")
    return control.adaptive(windows, *ADAPTIVE)


@query(ADAPTIVE_SQL + " SELECT pool, window_us, c AS concurrency, healthy, action, reason FROM ctl")
def adaptive_concurrency(spark, d):
    return _adaptive(spark, d)


#: Reports of each pool: the controller's windows, moved so that the last lie around the present; one pool has stopped reporting.
REPORTS_SQL = ADAPTIVE_SQL + f""", reports AS (SELECT concat('pool-', pool) AS pool, {AS_OF_US} - (max(n) OVER (PARTITION BY pool) - n) * 30000000 - CASE WHEN pool = 'default' THEN 150000000 ELSE 1000000 END AS updated_us, c AS effective, reason FROM ctl)"""


def _reports(spark, d):
    from pyspark.sql import Window

    at = _adaptive(spark, d)
    late = F.row_number().over(Window.partitionBy("pool").orderBy(F.desc("window_us"))) - 1
    return at.select(F.concat(F.lit("pool-"), "pool").alias("pool"), (F.lit(AS_OF_US) - late.cast("long") * 30_000_000 - F.when(F.col("pool") == "default", 150_000_000).otherwise(1_000_000)).alias("updated_us"), F.col("concurrency").alias("effective"), "reason")


STATUS_OF_POOLS_SQL = f"""SELECT p.pool, CAST(coalesce(effective, 0) AS BIGINT) AS effective, coalesce(reason, '') AS reason, effective IS NOT NULL AS present FROM pools p LEFT JOIN (SELECT pool, arg_max(effective, updated_us) AS effective, arg_max(reason, updated_us) AS reason FROM reports GROUP BY pool HAVING max(updated_us) > {AS_OF_US - 120_000_000}) USING (pool)"""


@query(REPORTS_SQL + " " + STATUS_OF_POOLS_SQL, "pools")
def adaptive_status(spark, d):
    return control.adaptive_status(dim(spark, "pools"), _reports(spark, d), 120_000_000)


#: Reports of workers: each says every few seconds how it is; the last ones lie around the present.
WORKERS_SQL = f""", workers AS (SELECT CASE WHEN seq % 97 = 0 THEN ' ' ELSE consumer END AS worker_id, concat('pool-', queue) AS pool, queue, CASE WHEN seq % 5 < 3 THEN 'accepting' WHEN seq % 5 = 3 THEN 'draining' ELSE 'stopped' END AS state,
  {AS_OF_US} - ((seq * 7919) % 86400) * 1000000 AS updated_us, seq % 6 AS pending, seq % 4 AS running, seq % 2 = 0 AS forced, seq FROM log)"""


def _workers(spark, d):
    s = F.col("seq")
    return task_log(spark, d).select(
        F.when(s % 97 == 0, " ").otherwise(F.col("consumer")).alias("worker_id"), F.concat(F.lit("pool-"), "queue").alias("pool"), "queue", F.when(s % 5 < 3, "accepting").when(s % 5 == 3, "draining").otherwise("stopped").alias("state"),
        (F.lit(AS_OF_US) - ((s * 7919) % 86400) * 1_000_000).alias("updated_us"), (s % 6).alias("pending"), (s % 4).alias("running"), (s % 2 == 0).alias("forced"), "seq",
    )


LIVE_SQL = f"""(SELECT queue, pool, worker_id, arg_max(state, (updated_us, seq)) AS state, arg_max(pending, (updated_us, seq)) AS pending, arg_max(running, (updated_us, seq)) AS running FROM workers WHERE trim(worker_id) <> '' GROUP BY queue, pool, worker_id HAVING max(updated_us) > {AS_OF_US - 7_200_000_000})"""


@query(WORKERS_SQL + " SELECT * FROM " + LIVE_SQL)
def worker_lifecycle_snapshot(spark, d):
    return metrics.worker_snapshots(_workers(spark, d), 7_200_000_000)


@query(WORKERS_SQL + f""" SELECT pool, queue, CASE WHEN state <> 'stopped' THEN '' WHEN forced THEN 'forced_timeout' ELSE 'drained' END AS outcome, count(*) AS shutdowns, CAST(sum(CASE WHEN state = 'stopped' AND forced THEN pending + running ELSE 0 END) AS BIGINT) AS abandoned FROM workers WHERE state = 'stopped' GROUP BY ALL""")
def worker_shutdowns(spark, d):
    return metrics.shutdowns(_workers(spark, d))


@query(REPORTS_SQL + WORKERS_SQL + f""", st AS ({STATUS_OF_POOLS_SQL}), lv AS (SELECT pool, CASE WHEN count(*) FILTER (state = 'accepting') > 0 THEN 'accepting' ELSE 'draining' END AS state FROM {LIVE_SQL} GROUP BY pool),
 b AS (SELECT queue, count(*) % 9 AS busy FROM log WHERE placement = 'pending' GROUP BY queue)
 SELECT pools.pool, coalesce(busy, 0) AS busy, CAST(CASE WHEN present THEN effective ELSE concurrency END AS BIGINT) AS effective, coalesce(lv.state, 'accepting') = 'accepting' AND coalesce(busy, 0) < least(prefetch, CASE WHEN present THEN effective ELSE concurrency END) AS can_reserve
 FROM pools LEFT JOIN b USING (queue) LEFT JOIN st ON st.pool = pools.pool LEFT JOIN lv ON lv.pool = pools.pool""", "pools")
def reserve_gate(spark, d):
    busy = task_log(spark, d).filter("placement = 'pending'").groupBy("queue").agg((F.count("*") % 9).alias("busy"))
    effective = control.adaptive_status(dim(spark, "pools"), _reports(spark, d), 120_000_000).filter("present").select("pool", "effective")
    states = metrics.worker_snapshots(_workers(spark, d), 7_200_000_000).groupBy("pool").agg(F.when(F.count_if(F.col("state") == "accepting") > 0, "accepting").otherwise("draining").alias("state"))
    return control.reserve_gate(dim(spark, "pools"), busy, effective, states)


LOCKS = "SELECT concat('lock-', CAST(seq % 12 AS STRING)) AS lock, concat('host|', consumer, '|', CAST(seq AS STRING)) AS token, {as_of} + (seq % 12 - 5) * 1000000 - (900 - seq % 900) * 1000 AS expires_us FROM {log}"


LOCKS_SQL = f""", locks AS ({LOCKS.format(as_of=AS_OF_US, log='log')}), l AS (SELECT lock, arg_max(token, expires_us) AS token, max(expires_us) AS expires_us FROM (SELECT lock, expires_us, max(token) AS token FROM locks GROUP BY lock, expires_us) GROUP BY lock),
 observed AS (SELECT lock, expires_us > {AS_OF_US} AS present, CASE WHEN expires_us > {AS_OF_US} THEN regexp_extract(token, '^(.+)[|]([0-9]+)$', 1) END AS owner, CASE WHEN expires_us > {AS_OF_US} THEN CAST(regexp_extract(token, '^(.+)[|]([0-9]+)$', 2) AS BIGINT) END AS epoch,
 CASE WHEN expires_us > {AS_OF_US} THEN (expires_us - {AS_OF_US}) // 1000 END AS ttl_ms FROM l)"""


def _locks(spark, d):
    return spark.sql(LOCKS.replace("{as_of}", str(AS_OF_US)), log=task_log(spark, d)).groupBy("lock", "expires_us").agg(F.max("token").alias("token"))


@query(LOCKS_SQL + " SELECT * FROM observed")
def leadership_observe(spark, d):
    return control.observe_leader(_locks(spark, d))


@query(views.TIERS_SQL + f""", ex AS (SELECT queue, fairness_key, count(*) AS n FROM log WHERE placement = 'pending' AND {AS_OF_US} - created_us >= ttl_ns // 1000 AND seq % 40 = 7 GROUP BY ALL),
 kk AS (SELECT u.queue, list(u.fairness_key ORDER BY u.fairness_key) AS keys, list(u.ready ORDER BY u.fairness_key) AS ready, list(u.reserved_now ORDER BY u.fairness_key) AS used, list(reserved ORDER BY u.fairness_key) AS res, list(soft_quota ORDER BY u.fairness_key) AS soft,
  list(hard_quota ORDER BY u.fairness_key) AS hard, list(burst ORDER BY u.fairness_key) AS burst, list(greatest(weight, 1) ORDER BY u.fairness_key) AS w, list(coalesce(n, 0) ORDER BY u.fairness_key) AS expired FROM u LEFT JOIN ex USING (queue, fairness_key) GROUP BY u.queue),
 calls AS (SELECT * FROM (WITH RECURSIVE s AS (SELECT queue, CAST(0 AS BIGINT) AS call, ready, used, expired, [CAST(0 AS BIGINT), 0, 0] AS tickets, CAST(0 AS BIGINT) AS pick, 0 AS tier FROM kk
  UNION ALL SELECT queue, call + 1, CASE WHEN t > 0 THEN list_transform(ready, lambda v, i: CASE WHEN i = p THEN v - 1 ELSE v END) ELSE ready END, CASE WHEN t > 0 THEN list_transform(used, lambda v, i: CASE WHEN i = p THEN v + 1 ELSE v END) ELSE used END,
   CASE WHEN t = 0 THEN list_transform(expired, lambda v, i: CASE WHEN i = p THEN v - 1 ELSE v END) ELSE expired END, list_transform(tickets, lambda v, i: CASE WHEN i = t THEN v + 1 ELSE v END), p, t
   FROM (SELECT *, CASE WHEN t = 0 THEN over ELSE cand[list_filter(range(1, len(cand) + 1), lambda j: list_sum(list_transform(cand[1:j], lambda c: w[c])) > tickets[t] % list_sum(list_transform(cand, lambda c: w[c])))[1]] END AS p
    FROM (SELECT *, CASE WHEN over IS NOT NULL THEN 0 ELSE list_min(tiers) END AS t, list_filter(range(1, len(keys) + 1), lambda i: tiers[i] = list_min(tiers)) AS cand
     FROM (SELECT s.*, keys, w, list_filter(range(1, len(keys) + 1), lambda i: s.expired[i] > 0)[1] AS over, list_transform(range(1, len(keys) + 1), lambda i: CASE WHEN s.ready[i] = 0 THEN 9 WHEN s.used[i] < res[i] THEN 1 WHEN hard[i] > 0 AND s.used[i] >= hard[i] THEN 9
       WHEN soft[i] <= 0 OR s.used[i] < soft[i] THEN 2 WHEN s.used[i] < soft[i] + burst[i] THEN 3 ELSE 9 END) AS tiers FROM s JOIN kk USING (queue) WHERE s.call < 60)) WHERE t < 9)) SELECT * FROM s WHERE call > 0))
 SELECT queue, call, keys[pick] AS fairness_key, CASE tier WHEN 0 THEN 'reclaimed' WHEN 1 THEN 'reserved' WHEN 2 THEN 'shared' ELSE 'borrow' END AS kind FROM calls JOIN kk USING (queue)""", "fairness_rules", "fairness_rule_keys")
def fair_reserve(spark, d):
    log = task_log(spark, d)
    keys = snapshots.resolve_rules(snapshots.key_snapshot(log).withColumnRenamed("reserved", "in_use"), dim(spark, "fairness_rules"), dim(spark, "fairness_rule_keys"))
    over = log.filter("placement = 'pending'").filter(F.lit(AS_OF_US) - F.col("created_us") >= F.floor(F.col("ttl_ns") / 1000))
    return control.fair_reserves(keys, over.filter("seq % 40 = 7").groupBy("queue", "fairness_key").agg(F.count("*").alias("n")), 60)


@query("SELECT coalesce(nullif(dedup_key, ''), task_id) AS dedup_key, arg_min(task_id, seq) AS task_id FROM log WHERE placement = 'acked' AND NOT failed GROUP BY coalesce(nullif(dedup_key, ''), task_id)")
def idempotent_first_success(spark, d):
    return control.first_successes(task_log(spark, d))


@query(WORKERS_SQL + """ SELECT queue, CASE WHEN count(*) FILTER (seq % 331 = 0) > 0 THEN 'failed' WHEN count(*) FILTER (forced) > 0 THEN 'forced_timeout' ELSE 'drained' END AS outcome, count(*) AS pools, CAST(sum(CASE WHEN forced THEN pending + running ELSE 0 END) AS BIGINT) AS abandoned FROM workers WHERE state = 'stopped' GROUP BY queue""")
def manager_shutdown(spark, d):
    return control.shutdown(_workers(spark, d).filter("state = 'stopped'").withColumn("failed", F.col("seq") % 331 == 0))
