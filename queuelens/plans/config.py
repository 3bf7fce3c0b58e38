"""Queries over settings: texts made from the customer and nation tables, parsed, defaulted and checked."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import control
from ..sources import settings
from ..sources.task_log import AS_OF_US
from .base import registry
from .flows import rfc3339_sql

QUERIES: dict = {}
query = registry(QUERIES)

# Each section's entries as expressions that both engines read, from a table with an integer k.
K = "(SELECT CAST(c_custkey AS BIGINT) AS k FROM customer)"
ENTRIES = {
    "pools": {"name": "CASE WHEN k % 31 = 0 THEN ' ' ELSE concat(' p', CAST(k % 60 AS STRING)) END", "queue": "CASE WHEN k % 29 = 0 THEN ' ' ELSE concat('q', CAST(k % 90 AS STRING)) END", "concurrency": "CAST(k % 7 AS INT)", "prefetch": "CAST(k % 5 AS INT)", "lease_ttl": "CASE WHEN k % 13 = 0 THEN 'soon' WHEN k % 11 = 0 THEN '0s' ELSE concat(CAST(k AS STRING), 's') END"},
    "task_limits": {"task_name": "CASE WHEN k % 17 = 0 THEN '' ELSE concat('t', CAST(k % 70 AS STRING), ' ') END", "max_concurrency": "CAST(k % 4 AS INT)"},
    "budgets": {"name": "CASE WHEN k % 19 = 0 THEN ' ' ELSE concat('b', CAST(k % 80 AS STRING)) END", "capacity": "CAST(k % 6 AS INT)"},
    "task_budgets": {"task_name": "concat('t', CAST(k % 101 AS STRING))", "budget": "CASE WHEN k % 23 = 0 THEN '' ELSE concat('b', CAST(k % 85 AS STRING)) END", "tokens": "CAST(k % 4 - 1 AS INT)"},
    "schedules": {"id": "CASE WHEN k % 37 = 0 THEN ' ' ELSE concat('s', CAST(k % 110 AS STRING)) END", "interval": "CASE WHEN k % 9 = 0 THEN 'daily' WHEN k % 8 = 0 THEN '-1m' ELSE concat(CAST(k % 50 + 1 AS STRING), 'm') END", "queue": "CASE WHEN k % 3 = 0 THEN '' ELSE 'bulk' END", "fairness_key": "concat(' k', CAST(k % 4 AS STRING))", "task_name": "CASE WHEN k % 41 = 0 THEN ' ' ELSE 'report' END",
                  "payload": "CASE WHEN k % 43 = 0 THEN '' ELSE concat('{\"k\":', CAST(k AS STRING), '}') END", "misfire_policy": "CASE WHEN k % 14 = 0 THEN 'skip' WHEN k % 2 = 0 THEN '' ELSE 'coalesce' END", "start_at": "CASE WHEN k % 15 = 0 THEN 'tomorrow' WHEN k % 3 = 0 THEN concat('2024-02-0', CAST(k % 9 + 1 AS STRING), 'T00:00:00Z') ELSE '' END"},
    "fairness": {"name": "CASE WHEN k % 33 = 0 THEN '' ELSE concat('r', CAST(k % 100 AS STRING)) END", "weight": "CAST(k % 5 - 1 AS INT)", "reserved_concurrency": "CAST(k % 9 AS INT)", "soft_quota": "CAST(k % 12 AS INT)", "hard_quota": "CAST(k % 8 AS INT)", "burst": "CAST(0 AS INT)", "key": "CASE WHEN k % 21 = 0 THEN ' ' ELSE concat('k', CAST(k % 95 AS STRING), ' ') END"},
    "adaptive": {"pool": "concat('p', CAST(k AS STRING))", "concurrency": "CAST(k % 10 AS INT)", "prefetch": "CAST(k % 13 AS INT)", "min_concurrency": "CAST(k % 4 AS INT)", "max_concurrency": "CAST(k % 11 AS INT)", "control_period": "CASE WHEN k % 12 = 0 THEN '' ELSE '30s' END", "cooldown": "CASE WHEN k % 10 = 0 THEN '-5s' ELSE '1m' END", "scale_up_step": "CAST(k % 3 AS INT)", "scale_down_step": "CAST(k % 5 AS INT)",
                 "latency_threshold": "CASE WHEN k % 7 = 0 THEN '0s' ELSE '250ms' END", "error_rate_threshold": "CAST(k % 6 - 1 AS DOUBLE)", "backlog_threshold": "CAST(k % 16 - 1 AS INT)", "healthy_windows_required": "CAST(k % 18 AS INT)"},
}


def entries_sql(section: str) -> str:
    return f", {section} AS (SELECT k, " + ", ".join(f"{e} AS {n}" for n, e in ENTRIES[section].items()) + f" FROM {K})"


def _raw(spark, d, section):
    """The section written as one JSON text and read back from it."""
    rows = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").cast("long").alias("k")).selectExpr("k", *[f"{e} AS {n}" for n, e in ENTRIES[section].items()])
    if section == "fairness":
        rows = rows.withColumn("keys", F.array("key")).drop("key")
    fields = [c for c in rows.columns if c != "k"]
    text = rows.groupBy().agg(F.to_json(F.collect_list(F.struct(*fields))).alias("text"))
    schema = "array<struct<" + ",".join(":".join(f.strip().split(" ")) for f in settings.SECTIONS[section].replace("map<string,string>", "map<string|string>").split(",")).replace("|", ",") + ">>"
    return settings.parsed_rows(text.select(F.from_json("text", schema).alias("x")))


@query(entries_sql("pools") + """ SELECT trim(name) AS name, CASE WHEN trim(queue) = '' THEN 'default' ELSE queue END AS queue, CAST(concurrency AS BIGINT) AS concurrency, CAST(CASE WHEN prefetch = 0 THEN concurrency ELSE prefetch END AS BIGINT) AS prefetch,
 CASE WHEN lease_ttl = 'soon' THEN NULL WHEN lease_ttl = '0s' THEN 0 ELSE k * 1000000000 END AS lease_ns FROM pools""")
def pool_config(spark, d):
    return settings.pools(_raw(spark, d, "pools"))


@query(entries_sql("pools") + """, p AS (SELECT trim(name) AS name, CASE WHEN trim(queue) = '' THEN 'default' ELSE queue END AS queue, concurrency, CASE WHEN prefetch = 0 THEN concurrency ELSE prefetch END AS prefetch, lease_ttl FROM pools)
 SELECT 'pools' AS section, name AS subject, unnest(list_filter([CASE WHEN name = '' THEN 'name is required' END, CASE WHEN concurrency < 1 THEN 'concurrency must be >= 1' END, CASE WHEN prefetch < concurrency THEN 'prefetch must be >= concurrency' END, CASE WHEN lease_ttl = 'soon' THEN 'lease_ttl is no duration' END, CASE WHEN lease_ttl = '0s' THEN 'lease_ttl must be > 0' END], lambda z: z IS NOT NULL)) AS problem FROM p
 UNION ALL SELECT 'pools', name, 'duplicate name' FROM p WHERE name <> '' GROUP BY name HAVING count(*) > 1 UNION ALL SELECT 'pools', queue, 'duplicate queue' FROM p GROUP BY queue HAVING count(*) > 1""")
def pool_integrity(spark, d):
    return settings.pool_problems(_raw(spark, d, "pools"))


@query(entries_sql("task_limits") + entries_sql("budgets") + entries_sql("task_budgets") + """, l AS (SELECT trim(task_name) AS n, max_concurrency AS m FROM task_limits), b AS (SELECT trim(name) AS n, capacity AS c FROM budgets), t AS (SELECT task_name AS n, budget, CASE WHEN tokens = 0 THEN 1 ELSE tokens END AS tokens FROM task_budgets)
 SELECT 'task_limits' AS section, n AS subject, 'task_name is required' AS problem FROM l WHERE n = '' UNION ALL SELECT 'task_limits', n, 'max_concurrency must be >= 1' FROM l WHERE m < 1 UNION ALL SELECT 'task_limits', n, 'duplicate task_name' FROM l WHERE n <> '' GROUP BY n HAVING count(*) > 1
 UNION ALL SELECT 'budgets', n, 'name is required' FROM b WHERE n = '' UNION ALL SELECT 'budgets', n, 'capacity must be >= 1' FROM b WHERE c < 1 UNION ALL SELECT 'budgets', n, 'duplicate budget' FROM b WHERE n <> '' GROUP BY n HAVING count(*) > 1
 UNION ALL SELECT 'task_budgets', n, 'budget is required' FROM t WHERE budget = '' UNION ALL SELECT 'task_budgets', n, 'unknown budget' FROM t WHERE budget <> '' AND budget NOT IN (SELECT n FROM b) UNION ALL SELECT 'task_budgets', n, 'tokens must be >= 1' FROM t WHERE tokens < 1
 UNION ALL SELECT 'task_budgets', n, 'duplicate mapping' FROM t GROUP BY n HAVING count(*) > 1""")
def budget_integrity(spark, d):
    budgets = _raw(spark, d, "budgets")
    return settings.limit_problems(_raw(spark, d, "task_limits")).unionByName(settings.budget_problems(budgets)).unionByName(settings.task_budget_problems(_raw(spark, d, "task_budgets"), budgets))


@query(entries_sql("schedules") + """ SELECT 'schedules' AS section, id AS subject, unnest(list_filter([CASE WHEN trim(id) = '' THEN 'id is required' END, CASE WHEN interval = 'daily' THEN 'interval is no duration' END, CASE WHEN interval = '-1m' THEN 'interval must be > 0' END, CASE WHEN trim(task_name) = '' THEN 'task_name is required' END,
 CASE WHEN payload = '' THEN 'payload is required' END, CASE WHEN misfire_policy = 'skip' THEN 'misfire_policy is not supported' END, CASE WHEN start_at = 'tomorrow' THEN 'start_at is no time' END], lambda z: z IS NOT NULL)) AS problem FROM schedules
 UNION ALL SELECT 'schedules', id, 'duplicate id' FROM schedules GROUP BY id HAVING count(*) > 1""")
def schedule_integrity(spark, d):
    return settings.schedule_problems(_raw(spark, d, "schedules"))


START = "epoch_us(CASE WHEN start_at LIKE '2024%' THEN strptime(start_at, '%Y-%m-%dT%H:%M:%SZ') END)"
SCHEDULE_SQL = entries_sql("schedules") + f""", sc AS (SELECT id AS schedule_id, CASE WHEN interval = 'daily' THEN NULL WHEN interval = '-1m' THEN -60000000000 ELSE (k % 50 + 1) * 60000000000 END AS interval_ns, CASE WHEN queue = '' THEN 'default' ELSE queue END AS queue, trim(fairness_key) AS fairness_key, task_name, payload,
 CASE WHEN misfire_policy = '' THEN 'coalesce' ELSE misfire_policy END AS misfire_policy, {START} AS start_us, CASE WHEN interval = '-1m' THEN '-1m0s' WHEN interval <> 'daily' THEN concat(CAST(k % 50 + 1 AS VARCHAR), 'm0s') END AS said FROM schedules)"""


@query(SCHEDULE_SQL + f""" SELECT schedule_id, interval_ns, queue, true AS enabled, misfire_policy, start_us, CASE WHEN interval_ns IS NOT NULL THEN sha256(concat_ws(chr(10), schedule_id, said, queue, fairness_key, task_name, misfire_policy, CASE WHEN start_us IS NULL THEN '' ELSE {rfc3339_sql('start_us')} END, payload)) END AS definition_hash FROM sc""")
def schedule_config(spark, d):
    out = settings.schedules(_raw(spark, d, "schedules"))
    return out.select("schedule_id", "interval_ns", "queue", "enabled", "misfire_policy", "start_us", F.when(F.col("interval_ns").isNotNull(), F.col("definition_hash")).alias("definition_hash"))


@query(SCHEDULE_SQL + f" SELECT schedule_id, coalesce(start_us, {AS_OF_US} + interval_ns // 1000) AS next_run_us FROM sc WHERE interval_ns > 0")
def schedule_initial(spark, d):
    at = settings.schedules(_raw(spark, d, "schedules")).filter("interval_ns > 0")
    return at.select("schedule_id", control.initial_run(F.col("start_us"), F.floor(F.col("interval_ns") / 1000)).alias("next_run_us"))


@query(entries_sql("fairness") + """ SELECT 'fairness' AS section, trim(name) AS subject, unnest(list_filter([CASE WHEN trim(name) = '' THEN 'name is required' END, CASE WHEN weight < 0 THEN 'values must be >= 0' END, CASE WHEN hard_quota > 0 AND soft_quota > hard_quota THEN 'soft_quota must be <= hard_quota' END,
 CASE WHEN hard_quota > 0 AND reserved_concurrency > hard_quota THEN 'reserved_concurrency must be <= hard_quota' END, CASE WHEN trim(key) = '' THEN 'cannot target the default key' END], lambda z: z IS NOT NULL)) AS problem FROM fairness
 UNION ALL SELECT 'fairness', name, 'duplicate name' FROM fairness WHERE name <> '' GROUP BY name HAVING count(*) > 1 UNION ALL SELECT 'fairness', trim(key), 'duplicate key' FROM fairness WHERE trim(key) <> '' GROUP BY trim(key) HAVING count(*) > 1""")
def fairness_integrity(spark, d):
    return settings.fairness_problems(_raw(spark, d, "fairness"))


@query(entries_sql("adaptive") + """ SELECT 'adaptive' AS section, pool AS subject, unnest(list_filter([CASE WHEN min_concurrency < 1 THEN 'min_concurrency must be >= 1' END, CASE WHEN max_concurrency < min_concurrency THEN 'max_concurrency must be >= min_concurrency' END, CASE WHEN concurrency < min_concurrency OR concurrency > max_concurrency THEN 'concurrency must lie between' END,
 CASE WHEN prefetch < max_concurrency THEN 'prefetch must be >= max_concurrency' END, CASE WHEN control_period = '' THEN 'control_period must be > 0' END, CASE WHEN cooldown = '-5s' THEN 'cooldown must be >= 0' END, CASE WHEN scale_up_step < 1 THEN 'scale_up_step must be >= 1' END, CASE WHEN scale_down_step < 1 THEN 'scale_down_step must be >= 1' END,
 CASE WHEN latency_threshold = '0s' THEN 'latency_threshold must be > 0' END, CASE WHEN error_rate_threshold < 0 THEN 'error_rate_threshold must be >= 0' END, CASE WHEN backlog_threshold < 0 THEN 'backlog_threshold must be >= 0' END, CASE WHEN healthy_windows_required < 1 THEN 'healthy_windows_required must be >= 1' END], lambda z: z IS NOT NULL)) AS problem FROM adaptive""")
def adaptive_integrity(spark, d):
    return settings.adaptive_problems(_raw(spark, d, "adaptive"))
