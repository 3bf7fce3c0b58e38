"""The task log derived from the `events` table, and the policy tables, with their SQL twins.

Policies are small constant tables (a row for each queue, rule, budget or pool); joins with them broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import micros, parse_rfc3339, rfc3339

AS_OF_US = 1_706_659_200_000_000  # 2024-01-31 00:00:00 UTC
DAY_US = 86_400_000_000

FIELDS = {
    "seq": "event_id",
    "task_id": "concat('evt-', CAST(event_id AS STRING))",
    "delivery_id": "concat('d-', CAST(event_id AS STRING))",
    "task_name": "event_type",
    "queue": "CASE WHEN event_type IN ('purchase','signup') THEN 'critical' WHEN event_type = 'error' THEN 'default' ELSE 'bulk' END",
    "fairness_key": "CASE WHEN user_id % 8 = 7 THEN '' ELSE concat('tenant-', CAST(user_id % 8 AS STRING)) END",
    "attempt": "CAST(event_id % 4 AS INT)",
    "created_at": "ts",
    "placement": "CASE WHEN event_id % 10 <= 4 THEN 'acked' WHEN event_id % 10 <= 6 THEN 'ready' WHEN event_id % 10 = 7 THEN 'pending' WHEN event_id % 10 = 8 THEN 'delayed' ELSE 'dead' END",
    "delay_us": "CASE WHEN event_id % 10 = 8 THEN CASE WHEN event_id % 3 = 0 THEN 300000000 ELSE 3600000000 END END",
    "is_retry": "event_id % 20 = 8",
    "consumer": "concat('w-', CAST(event_id % 7 AS STRING))",
    "ttl_ns": "CAST(1 + event_id % 30 AS BIGINT) * 86400000000000",
    "latency_ns": "CAST(round(value * 10) AS BIGINT) * 1000000",
    "failed": "event_type = 'error'",
    "failure_code": "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 6",
    "dedup_key": "CASE WHEN event_id % 9 = 4 THEN '' ELSE concat('k-', CAST(user_id AS STRING), '-', CAST(CAST(floor(value) AS BIGINT) % 16 AS STRING)) END",
}


def task_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each task: where it is at AS_OF_US, and what is known of its attempts. Only the columns used are scanned."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(*[f"{e} AS {n}" for n, e in FIELDS.items()])
    return rows.withColumn("created_us", micros("created_at")).withColumn("eta_us", F.col("created_us") + F.col("delay_us"))


LOG_SQL = "log AS (SELECT *, created_us + delay_us AS eta_us FROM (SELECT epoch_us(ts) AS created_us, " + ", ".join(f"{e} AS {n}" for n, e in FIELDS.items()) + " FROM events))"

# Policy tables: columns with types, then rows.
DIMS: dict[str, tuple[str, list[tuple]]] = {
    "queues": ("queue string", [("bulk",), ("critical",), ("default",)]),
    "fair_queues": ("queue string", [("critical",), ("default",)]),
    "admission_policies": (
        "queue string, mode string, max_pending long, max_pending_per_key long, max_oldest_age_us long, max_retry_backlog long, max_dead long, defer_us long",
        [("critical", "defer", 1000, 0, 0, 200, 0, 5_000_000), ("bulk", "reject", 1500, 0, 15 * DAY_US, 0, 0, 5_000_000), ("default", "reject", 0, 75, 0, 0, 250, 5_000_000)],
    ),
    "fairness_rules": ("bucket string, weight long, reserved long, soft_quota long, hard_quota long, burst long", [("vip", 3, 2, 0, 60, 0), ("burst", 2, 0, 40, 0, 10), ("default", 1, 0, 0, 50, 0)]),
    "fairness_rule_keys": ("fairness_key string, bucket string", [("tenant-0", "vip"), ("tenant-1", "burst"), ("tenant-2", "burst")]),
    "retry_policies": ("queue string, max_deliveries long, initial_ns long, max_ns long, multiplier double, jitter double, max_age_ns long", [("critical", 3, 1_000_000_000, 30_000_000_000, 2.0, 0.2, 0), ("default", 5, 1_000_000_000, 5_000_000_000, 2.0, 0.0, 0), ("bulk", 2, 500_000_000, 10_000_000_000, 3.0, 0.1, 20 * DAY_US * 1000)]),
    "budgets": ("budget string, capacity long", [("downstream", 40), ("mailer", 25), ("unused", 5)]),
    "tight": ("budget string, capacity long", [("downstream", 7), ("mailer", 3)]),
    "task_budgets": ("task_name string, budget string, tokens long", [("purchase", "downstream", 2), ("signup", "mailer", 1), ("error", "downstream", 1)]),
    "task_limits": ("task_name string, global_limit long, pool_limit long", [("purchase", 30, 10), ("click", 50, 20), ("error", 10, 10)]),
    "pools": ("pool string, queue string, concurrency long, prefetch long", [("pool-bulk", "bulk", 8, 8), ("pool-critical", "critical", 4, 6), ("pool-default", "default", 4, 4)]),
    "state_transitions": ("from_state string, to_state string", [("queued", "leased"), ("leased", "running"), ("running", "succeeded"), ("running", "retry_scheduled"), ("running", "dead_lettered"), ("retry_scheduled", "queued")]),
    "failure_classes": ("failure_code int, failure_class string", [(0, "transient_retryable"), (1, "permanent"), (2, "lease_lost"), (3, "timeout"), (4, "decode_or_validation"), (5, "overloaded")]),
}


def dim(spark: SparkSession, name: str) -> DataFrame:
    schema, rows = DIMS[name]
    return F.broadcast(spark.createDataFrame(rows, schema))


def dim_sql(*names: str) -> str:
    """The policy tables as common table expressions."""
    types = {"long": "BIGINT", "int": "INT", "string": "VARCHAR", "double": "DOUBLE"}

    def one(name: str) -> str:
        schema, rows = DIMS[name]
        cols = [c.split() for c in schema.split(", ")]
        values = ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)
        return f"{name} AS (SELECT " + ", ".join(f"CAST(c{k} AS {types[t]}) AS {c}" for k, (c, t) in enumerate(cols)) + f" FROM (VALUES {values}) v(" + ", ".join(f"c{k}" for k in range(len(cols))) + "))"

    return ", ".join(map(one, names))


MESSAGE_SCHEMA = (
    "id string, name string, queue string, fairness_key string, payload binary, headers map<string,string>, attempt int, max_attempts int, "
    "visibility_timeout long, eta string, timeout long, idempotency_key string, created_at string"
)


def parse_messages(lines: DataFrame, column: str = "value", keep: str | None = None) -> DataFrame:
    """Messages from JSON lines: fixed schema, unknown fields ignored; a line that is no message has corrupt true. A column of the
    lines may be kept."""
    parsed = F.from_json(F.col(column), MESSAGE_SCHEMA, {"mode": "PERMISSIVE"})
    kept = [keep] if keep else []
    out = lines.select(*kept, parsed.alias("m"))
    return out.select(*kept, "m.*", (F.col("m").isNull() | F.col("m.id").isNull()).alias("corrupt"))


def normalise(messages: DataFrame, now: str) -> DataFrame:
    """Defaults of a published message: empty queue is `default`, the fairness key is trimmed, a missing or zero creation time is now."""
    created = F.to_timestamp_ntz(F.regexp_replace("created_at", "Z$", ""))
    return messages.withColumns({
        "queue": F.coalesce(F.nullif("queue", F.lit("")), F.lit("default")),
        "fairness_key": F.trim(F.coalesce("fairness_key", F.lit(""))),
        "created_at": F.coalesce(F.nullif(created, F.lit("0001-01-01 00:00:00").cast("timestamp_ntz")), F.lit(now).cast("timestamp_ntz")),
    })


def delayed_entry_json(entry_id: Column, scheduled_for_us: Column, message: Column) -> Column:
    """A delayed entry as JSON; the message's binary payload becomes base64."""
    return F.to_json(F.struct(entry_id.alias("entry_id"), rfc3339(scheduled_for_us).alias("scheduled_for"), message.alias("message")))


def parse_delayed_entry(lines: DataFrame, column: str = "value") -> DataFrame:
    """entry_id, scheduled_for_us and message of delayed entries."""
    at = lines.select(F.from_json(F.col(column), f"entry_id string, scheduled_for string, message struct<{MESSAGE_SCHEMA.replace(' ', ':').replace(',:', ',')}>").alias("e"))
    return at.select("e.entry_id", parse_rfc3339(F.col("e.scheduled_for")).alias("scheduled_for_us"), "e.message")


ENVELOPE_SCHEMA = "original_task struct<id:string,name:string,queue:string,attempt:int>, failure_class string, last_error string, delivery_count long, first_enqueued_at string, last_failure_at string, worker_identity string, delivery_id string, trace_id string"


def dead_letter_json(entry_id: Column, queue: Column, envelope: Column) -> Column:
    """A dead letter as a message: the envelope is JSON in the payload, which is base64 in the message's own JSON."""
    return F.to_json(F.struct(entry_id.alias("id"), F.lit("dead_letter").alias("name"), queue.alias("queue"), F.to_json(envelope).cast("binary").alias("payload")))


def parse_dead_letter(lines: DataFrame, column: str = "value") -> DataFrame:
    """id, queue and envelope of dead letters."""
    at = lines.select(F.from_json(F.col(column), "id string, queue string, payload binary").alias("m"))
    return at.select("m.id", "m.queue", F.from_json(F.col("m.payload").cast("string"), ENVELOPE_SCHEMA).alias("envelope"))


def write_messages(messages: DataFrame, path: str) -> None:
    """Messages as JSON lines."""
    messages.select(F.to_json(F.struct(*messages.columns)).alias("value")).write.text(path)
