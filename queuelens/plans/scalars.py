"""Queries over the scalar functions, on columns of the fixture tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs
from ..operators import delivery
from ..operators.ranks import positions
from ..sources.task_log import task_log
from .base import registry

QUERIES: dict = {}
query = registry(QUERIES)


FNV = "list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(string_split({0}, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, b: (xor(a, b) * 16777619) & 4294967295)"


@query(f"SELECT task_id, {FNV.format('task_id')} AS fnv, sha256(fairness_key) AS key_hash FROM log")
def hashes(spark, d):
    return task_log(spark, d).select("task_id", exprs.fnv1a32(F.col("task_id")).alias("fnv"), F.sha2("fairness_key", 256).alias("key_hash"))


@query("SELECT task_id, CAST(n AS INT) AS n, CAST(least(1000000000 * pow(2.0, n - 1), 30000000000) AS BIGINT) AS delay_ns FROM log, range(1, 8) t(n)")
def backoff_delays(spark, d):
    rows = task_log(spark, d).select("task_id", F.explode(F.sequence(F.lit(1), F.lit(7))).alias("n"))
    return rows.select("task_id", "n", exprs.backoff(F.lit(1_000_000_000), F.lit(2.0), F.lit(30_000_000_000), F.col("n")).alias("delay_ns"))


@query("SELECT seq, CAST(seq % 60 AS BIGINT) * 60000000000 + CAST(seq % 47 AS BIGINT) * 1000000000 + CAST(seq % 4 AS BIGINT) * 500000000 AS ns FROM log")
def duration_parse(spark, d):
    rows = task_log(spark, d)
    text = F.concat((F.col("seq") % 60).cast("string"), F.lit("m"), (F.col("seq") % 47).cast("string"), F.lit("s"), (F.col("seq") % 4 * 500).cast("string"), F.lit("ms"))
    return rows.select("seq", exprs.parse_duration(text).alias("ns"))


@query("SELECT seq, CAST(seq AS BIGINT) * 1234567 AS ns FROM log")
def duration_round_trip(spark, d):
    return task_log(spark, d).select("seq", exprs.parse_duration(exprs.format_duration(F.col("seq") * 1234567)).alias("ns"))


@query("SELECT seq, CASE WHEN seq % 3 = 0 THEN concat('t', CAST(seq AS VARCHAR)) WHEN seq % 3 = 1 THEN CAST(seq AS VARCHAR) ELSE '' END AS trace_id FROM log")
def trace_ids(spark, d):
    s = F.col("seq").cast("string")
    explicit = F.when(F.col("seq") % 3 == 0, F.concat(F.lit(" t"), s, F.lit(" ")))
    parent = F.when(F.col("seq") % 3 == 1, F.concat(F.lit("00-"), s, F.lit("-aa-01")))
    return task_log(spark, d).select("seq", exprs.trace_id(explicit, parent).alias("trace_id"))


@query("SELECT seq, CASE WHEN seq % 4 <> 0 THEN concat('host|', consumer) END AS owner, CASE WHEN seq % 4 <> 0 THEN seq END AS epoch FROM log")
def fence_tokens(spark, d):
    token = F.when(F.col("seq") % 4 == 0, F.concat(F.lit("|"), F.col("seq").cast("string"))).otherwise(F.concat(F.lit("host|"), "consumer", F.lit("|"), F.col("seq").cast("string")))
    return task_log(spark, d).select("seq", exprs.fence_owner(token).alias("owner"), exprs.fence_epoch(token).alias("epoch"))


@query("SELECT concat(CAST(seq % 9 AS VARCHAR), '-', CAST(seq AS VARCHAR)) AS entry_id, concat(CAST(seq % 9 AS VARCHAR), '-', CAST(seq + 1 AS VARCHAR)) AS next_id, row_number() OVER (PARTITION BY queue ORDER BY seq % 9, seq) AS position, queue FROM log")
def stream_order(spark, d):
    rows = task_log(spark, d).select("queue", F.concat_ws("-", (F.col("seq") % 9).cast("string"), F.col("seq").cast("string")).alias("entry_id"))
    order = [exprs.stream_ms(F.col("entry_id")), exprs.stream_seq(F.col("entry_id"))]
    return positions(rows, ["queue"], exprs.stream_ms(F.col("entry_id")), order).select("entry_id", exprs.stream_after(F.col("entry_id")).alias("next_id"), "position", "queue")


#: Pairs of ids, some of them no stream ids.
IDS = "CASE WHEN seq % 7 = 0 THEN concat('x', CAST(seq AS STRING)) WHEN seq % 11 = 0 THEN CAST(seq AS STRING) ELSE concat(CAST(seq % 40 AS STRING), '-', CAST(seq % 13 AS STRING)) END"
OTHERS = "CASE WHEN seq % 5 = 0 THEN '9-x' ELSE concat(CAST(seq % 23 AS STRING), '-', CAST(seq % 17 AS STRING)) END"


@query(f""", p AS (SELECT seq, {IDS} AS a, {OTHERS} AS b FROM log), q AS (SELECT *, regexp_matches(a, '^[0-9]+-[0-9]+$') AS oka, regexp_matches(b, '^[0-9]+-[0-9]+$') AS okb FROM p),
 r AS (SELECT *, CASE WHEN oka THEN CAST(split_part(a, '-', 1) AS BIGINT) * 1000 + CAST(split_part(a, '-', 2) AS BIGINT) END AS na, CASE WHEN okb THEN CAST(split_part(b, '-', 1) AS BIGINT) * 1000 + CAST(split_part(b, '-', 2) AS BIGINT) END AS nb FROM q)
 SELECT seq, CAST(CASE WHEN oka AND okb THEN sign(na - nb) WHEN a < b THEN -1 WHEN a > b THEN 1 ELSE 0 END AS INT) AS compared, CASE WHEN oka THEN concat(split_part(a, '-', 1), '-', CAST(CAST(split_part(a, '-', 2) AS BIGINT) + 1 AS VARCHAR)) ELSE a END AS after FROM r""")
def stream_compare(spark, d):
    at = task_log(spark, d).selectExpr("seq", f"{IDS} AS a", f"{OTHERS} AS b")
    return at.select("seq", exprs.stream_compare(F.col("a"), F.col("b")).alias("compared"), exprs.stream_after(F.col("a")).alias("after"))


@query("SELECT DISTINCT CASE WHEN trim(q) = '' THEN 'default' ELSE trim(q) END AS queue FROM (SELECT CASE WHEN seq % 9 = 0 THEN ' ' ELSE concat(' ', queue, CASE WHEN seq % 2 = 0 THEN ' ' ELSE '' END) END AS q FROM log)")
def queue_list(spark, d):
    s = F.col("seq")
    named = task_log(spark, d).select(F.when(s % 9 == 0, " ").otherwise(F.concat(F.lit(" "), "queue", F.when(s % 2 == 0, " ").otherwise(""))).alias("q"))
    return exprs.distinct_names(named, "q", "default").withColumnRenamed("name", "queue")


#: Each label with the text that stands for a blank one.
LABEL_SQL = ", ".join(f"CASE WHEN seq % {k + 2} = 0 THEN '{d}' ELSE concat('v', CAST(seq % 5 AS VARCHAR)) END AS {n}" for k, (n, d) in enumerate(exprs.LABEL_DEFAULTS.items()))


@query(f"SELECT seq, {LABEL_SQL} FROM log")
def sanitised_labels(spark, d):
    s = F.col("seq")
    raw = {n: F.when(s % (k + 2) == 0, "  ").otherwise(F.concat(F.lit(" v"), (s % 5).cast("string"), F.lit(" "))) for k, n in enumerate(exprs.LABEL_DEFAULTS)}
    return task_log(spark, d).select("seq", *[exprs.label(n, c).alias(n) for n, c in raw.items()])


@query("""SELECT seq, concat(queue, ':', CASE WHEN fairness_key = '' THEN '__default__' ELSE fairness_key END, ':', delivery_id) AS lease_key, concat('stream:', queue, CASE WHEN fairness_key = '' THEN '' ELSE concat(':', fairness_key) END) AS stream_key, concat('group:', queue) AS group_key,
 concat(CASE WHEN seq % 6 = 0 THEN 'worker' ELSE consumer END, ':', CASE WHEN seq % 4 = 0 THEN 'unknown-host' ELSE concat('h', CAST(seq % 4 AS VARCHAR)) END, ':', CAST(seq % 1000 AS VARCHAR)) AS consumer_name FROM log""")
def labels_and_keys(spark, d):
    s = F.col("seq")
    host = F.when(s % 4 == 0, " ").otherwise(F.concat(F.lit("h"), (s % 4).cast("string")))
    return task_log(spark, d).select(
        "seq", exprs.lease_key(F.col("queue"), F.col("fairness_key"), F.col("delivery_id")).alias("lease_key"), exprs.stream_key(F.col("queue"), F.col("fairness_key")).alias("stream_key"), exprs.group_key(F.col("queue")).alias("group_key"),
        exprs.consumer_name(F.when(s % 6 == 0, "").otherwise(F.col("consumer")), host, s % 1000).alias("consumer_name"),
    )


@query("SELECT seq, CAST(2 + CASE WHEN seq % 2 = 0 THEN 0 ELSE 1 END AS INT) AS n_headers, CASE WHEN seq % 2 = 0 THEN 'new' ELSE 'other' END AS a, seq % 2 <> 0 AS has_other FROM log")
def header_maps(spark, d):
    s = F.col("seq")
    before = F.when(s % 2 == 0, F.create_map(F.lit("a"), F.lit("old"), F.lit("b"), F.lit(""))).otherwise(F.create_map(F.lit("other"), F.lit("x"), F.lit("b"), F.lit("")))
    merged = exprs.overwritten(before, F.create_map(F.lit("a"), F.when(s % 2 == 0, "new").otherwise("other")))
    return task_log(spark, d).select("seq", F.size(merged).alias("n_headers"), F.element_at(merged, "a").alias("a"), exprs.has_header(merged, "other").alias("has_other"))


@query("""SELECT task_id, seq % 7 = 0 OR seq % 29 = 0 AS error, CASE WHEN e THEN NULL ELSE CAST(CASE WHEN seq % 8 = 0 THEN 7 WHEN seq % 4 = 0 THEN 9 ELSE 3 END AS BIGINT) END AS max_deliveries,
 CASE WHEN e THEN NULL WHEN seq % 5 = 0 THEN 250000000 ELSE 1000000000 END AS initial_ns, CASE WHEN e THEN NULL WHEN seq % 9 = 0 THEN 5000000000 ELSE 30000000000 END AS max_ns,
 CASE WHEN e THEN NULL WHEN seq % 6 = 0 THEN CAST(1.5 AS DOUBLE) WHEN seq % 6 = 1 THEN CAST(1.0 AS DOUBLE) ELSE CAST(2.0 AS DOUBLE) END AS multiplier, CASE WHEN e THEN NULL WHEN seq % 10 = 0 THEN CAST(0.25 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END AS jitter,
 CASE WHEN e THEN NULL WHEN seq % 12 = 0 THEN 5400000000000 ELSE 0 END AS max_age_ns FROM (SELECT *, seq % 7 = 0 OR seq % 29 = 0 AS e FROM log)""")
def retry_policy_overlay(spark, d):
    s = F.col("seq")
    asked = {
        "max_deliveries": F.when(s % 29 == 0, "many").when(s % 8 == 0, "7"), "initial_backoff": F.when(s % 7 == 0, "soon").when(s % 5 == 0, "250ms").when(s % 3 == 0, "-4s"), "max_backoff": F.when(s % 9 == 0, "5s").when(s % 2 == 0, "0s"),
        "multiplier": F.when(s % 6 == 0, "1.5").when(s % 6 == 1, "0.2").when(s % 6 == 2, ""), "jitter": F.when(s % 10 == 0, "0.25").when(s % 10 == 1, "-1"), "max_task_age": F.when(s % 12 == 0, "1h30m"),
    }
    headers = F.map_filter(F.create_map(*[x for k, v in asked.items() for x in (F.lit(k), v)]), lambda k, v: v.isNotNull())
    base = {"base_attempts": 3, "base_deliveries": 0, "base_initial_ns": 1_000_000_000, "base_max_ns": 30_000_000_000, "base_multiplier": 2.0, "base_jitter": 0.0, "base_age_ns": 0}
    rows = task_log(spark, d).select("task_id", headers.alias("headers"), F.when(s % 4 == 0, 9).otherwise(0).alias("max_attempts"), *[F.lit(v).alias(k) for k, v in base.items()])
    return delivery.retry_overlay(rows)


@query("SELECT seq, CAST(greatest(1, least(seq % 20, 10)) AS BIGINT) AS clamped, CAST(CASE WHEN seq % 10 = 0 THEN 0.0 ELSE round((seq % 7) / CAST(seq % 10 AS DOUBLE), 6) END AS DOUBLE) AS ratio FROM log")
def clamp_and_ratio(spark, d):
    s = F.col("seq")
    return task_log(spark, d).select("seq", exprs.clamp(s % 20, F.lit(1), F.lit(10)).cast("long").alias("clamped"), F.round(exprs.ratio(s % 7, s % 10), 6).alias("ratio"))


#: Which payload each event carries, and what is wrong with it.
@query("""SELECT event_id, kind, CASE WHEN event_id % 13 <> 0 AND k >= 10 THEN '' WHEN kind = 'external' THEN 'decode_or_validation' ELSE 'transient_retryable' END AS failure_class, CASE WHEN kind = 'media' AND event_id % 13 <> 0 THEN CASE WHEN k % 2 = 0 AND k > 0 THEN k ELSE 3 END END AS steps, CASE WHEN kind = 'email' AND event_id % 13 <> 0 THEN CASE WHEN event_id % 4 = 0 THEN concat('m-', CAST(event_id AS VARCHAR)) ELSE concat('evt-', CAST(event_id AS VARCHAR)) END END AS idempotency_key
 FROM (SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k, CASE event_id % 3 WHEN 0 THEN 'media' WHEN 1 THEN 'email' ELSE 'external' END AS kind FROM events)""")
def payload_validation(spark, d):
    i, k = F.col("event_id"), F.col("k")
    rows = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.from_json("props", "k long")["k"].alias("k"), F.when(i % 3 == 0, "media").when(i % 3 == 1, "email").otherwise("external").alias("kind"))
    named = F.when(k >= 10, F.concat(F.lit("a-"), k.cast("string"))).otherwise("")
    field = F.when(F.col("kind") == "media", F.to_json(F.struct(named.alias("asset_id"), F.when(k % 2 == 0, k).otherwise(-1).alias("steps")))).when(F.col("kind") == "email", F.to_json(F.struct(named.alias("recipient")))).otherwise(F.to_json(F.struct(named.alias("resource_id"))))
    messages = rows.select("event_id", "kind", F.concat(F.lit("evt-"), i.cast("string")).alias("id"), F.when(i % 4 == 0, F.concat(F.lit("m-"), i.cast("string"))).otherwise("").alias("idempotency_key"), F.when(i % 13 == 0, "no json {").otherwise(field).alias("payload"))
    return delivery.validate_payloads(messages).select("event_id", "kind", "failure_class", "steps", "idempotency_key")


@query("""SELECT task_id, concat('e-', CAST(seq AS VARCHAR)) AS entry_id, queue, CAST(attempt AS INT) AS attempt, concat('{"k":', CAST(seq % 10 AS VARCHAR), '}') AS payload, created_us + 5000000 AS scheduled_for_us, CASE WHEN seq % 3 = 0 THEN concat('t', CAST(seq AS VARCHAR)) ELSE '' END AS trace_id, created_us AS created_us FROM log""")
def delayed_entry_codec(spark, d):
    """Delayed entries written as JSON, payload in base64, and read back."""
    from ..sources.task_log import delayed_entry_json, parse_delayed_entry

    s = F.col("seq")
    headers = F.when(s % 3 == 0, F.create_map(F.lit("trace_id"), F.concat(F.lit("t"), s.cast("string")))).otherwise(F.create_map().cast("map<string,string>"))
    message = F.struct(F.col("task_id").alias("id"), F.col("task_name").alias("name"), "queue", "fairness_key", F.concat(F.lit('{"k":'), (s % 10).cast("string"), F.lit("}")).cast("binary").alias("payload"), headers.alias("headers"), F.col("attempt").cast("int").alias("attempt"), exprs.rfc3339(F.col("created_us")).alias("created_at"))
    text = task_log(spark, d).select(delayed_entry_json(F.concat(F.lit("e-"), s.cast("string")), F.col("created_us") + 5_000_000, message).alias("value"))
    at = parse_delayed_entry(text)
    return at.select("message.id", "entry_id", "message.queue", "message.attempt", F.col("message.payload").cast("string").alias("payload"), "scheduled_for_us", exprs.trace_id(F.col("message.headers")["trace_id"], F.lit(None).cast("string")).alias("trace_id"), exprs.parse_rfc3339(F.col("message.created_at")).alias("created_us")).withColumnRenamed("id", "task_id")


@query("""SELECT concat('dlq:', delivery_id) AS entry_id, task_id, queue, failure_class, CAST(attempt + 1 AS BIGINT) AS delivery_count, created_us AS first_enqueued_us FROM log LEFT JOIN failure_classes USING (failure_code) WHERE placement = 'dead'""", "failure_classes")
def envelope_codec(spark, d):
    """Dead letters written as a message whose payload is the envelope's JSON in base64, and read back."""
    from ..sources.task_log import dead_letter_json, dim, parse_dead_letter

    dead = task_log(spark, d).filter("placement = 'dead'").join(dim(spark, "failure_classes"), "failure_code", "left")
    envelope = F.struct(
        F.struct(F.col("task_id").alias("id"), F.col("task_name").alias("name"), "queue", F.col("attempt").cast("int").alias("attempt")).alias("original_task"), "failure_class", F.lit("failed").alias("last_error"), (F.col("attempt") + 1).cast("long").alias("delivery_count"),
        exprs.rfc3339(F.col("created_us")).alias("first_enqueued_at"), "delivery_id",
    )
    at = parse_dead_letter(dead.select(dead_letter_json(F.concat(F.lit("dlq:"), "delivery_id"), F.concat(F.lit("dlq."), "queue"), envelope).alias("value")))
    return at.select(F.col("id").alias("entry_id"), F.col("envelope.original_task.id").alias("task_id"), F.col("envelope.original_task.queue").alias("queue"), "envelope.failure_class", "envelope.delivery_count", exprs.parse_rfc3339(F.col("envelope.first_enqueued_at")).alias("first_enqueued_us"))
