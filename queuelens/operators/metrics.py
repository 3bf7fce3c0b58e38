"""Metric families over the log: counters, histograms, gauges. Labels never hold ids of tasks, deliveries or tenants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs
from ..sources.task_log import AS_OF_US

#: Upper bounds of latency buckets in seconds.
BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)


def families(rows: DataFrame, defined: dict[str, tuple[str, tuple[str, ...], str]]) -> DataFrame:
    """Counters in one pass over rows: (family, labels, value). Each family has a condition, its labels (columns or expressions `e AS name`) and
    what it adds up (1 to count). Labels read name=value, in their order."""
    made = []
    for family, (condition, labels, added) in defined.items():
        parts = [x.rsplit(" AS ", 1) if " AS " in x else (x, x) for x in labels]
        said = F.concat_ws(",", *[F.concat(F.lit(f"{name}="), exprs.or_default(F.expr(e).cast("string"), exprs.METRIC_DEFAULTS.get(name, "unknown"))) for e, name in parts]) if parts else F.lit("")
        made.append(F.when(F.expr(condition), F.struct(F.lit(family).alias("family"), said.alias("labels"), F.expr(added).cast("double").alias("added"))))
    at = rows.select(F.explode(F.filter(F.array(*made), lambda x: x.isNotNull())).alias("x"))
    return at.groupBy("x.family", "x.labels").agg(F.sum("x.added").alias("value"))


def gauge(rows: DataFrame, family: str, labels: tuple[str, ...], value: str) -> DataFrame:
    """A row for each row: what a scrape shows of a snapshot."""
    return families(rows, {family: ("true", labels, value)})


def histogram(rows: DataFrame, labels: list, latency_ns: str) -> DataFrame:
    """Cumulative buckets, count and sum by labels; one pass, no row is multiplied."""
    sums = rows.groupBy(*labels).agg(F.count("*").alias("n"), F.sum(latency_ns).alias("sum_ns"), *[F.count_if(F.col(latency_ns) <= int(b * 1e9)).alias(f"b{k}") for k, b in enumerate(BUCKETS)])
    le = F.array(*[F.struct(F.lit(f"{b:g}").alias("le"), F.col(f"b{k}").alias("cumulative")) for k, b in enumerate(BUCKETS)], F.struct(F.lit("+Inf").alias("le"), F.col("n").alias("cumulative")))
    return sums.select(*sums.columns[: len(labels)], "n", "sum_ns", F.inline(le))


def latency_histogram(log: DataFrame) -> DataFrame:
    """Execution times by queue, task name and status."""
    return histogram(log.filter("placement in ('acked', 'dead')"), ["queue", "task_name", F.when(F.col("failed"), "failed").otherwise("succeeded").alias("status")], "latency_ns")


def active_tasks(log: DataFrame) -> DataFrame:
    """Starts less ends."""
    change = F.when(F.col("placement").isin("acked", "dead", "pending"), 1).otherwise(0) - F.when(F.col("placement").isin("acked", "dead"), 1).otherwise(0)
    return log.groupBy("queue", "task_name").agg(F.sum(change).cast("long").alias("active"))


def one_hot(rows: DataFrame, states: tuple[str, ...] = ("normal", "degraded", "rejecting"), names: tuple[str, ...] = ("queue",)) -> DataFrame:
    """A 0/1 gauge for each possible state."""
    every = rows.select(*names, F.explode(F.array(*map(F.lit, states))).alias("gauge"), "state")
    return every.select(*names, F.col("gauge").alias("state_label"), (F.col("gauge") == F.col("state")).cast("long").alias("value"))


def as_json(rows: DataFrame, names: tuple[str, ...], fields: tuple[str, ...]) -> DataFrame:
    """The fields of each row as a JSON body."""
    return rows.select(*names, F.to_json(F.struct(*fields)).alias("body"))


def exposition(shown: DataFrame) -> DataFrame:
    """family{label="value",...} value: the text format of a scrape, from (family, labels, value)."""
    quoted = F.regexp_replace("labels", r"([^=,]+)=([^,]*)", '$1="$2"')
    number = F.when(F.col("value") == F.floor("value"), F.floor("value").cast("string")).otherwise(F.col("value").cast("string"))
    return shown.select(F.concat("family", F.when(F.col("labels") == "", "").otherwise(F.concat(F.lit("{"), quoted, F.lit("}"))), F.lit(" "), number).alias("line"))


def worker_snapshots(reports: DataFrame, life_us: int) -> DataFrame:
    """Last report of every named worker that is younger than its life, sorted by queue, pool and worker."""
    named = reports.filter(F.trim("worker_id") != "").groupBy("queue", "pool", "worker_id")
    last = named.agg(F.max_by(F.struct("state", "pending", "running", "updated_us"), F.struct("updated_us", "seq")).alias("x")).filter(F.col("x.updated_us") > AS_OF_US - life_us)
    return last.select("queue", "pool", "worker_id", "x.state", "x.pending", "x.running").orderBy("queue", "pool", "worker_id")


def shutdowns(reports: DataFrame) -> DataFrame:
    """Workers that stopped: drained, or forced after the timeout, which abandons what they ran and held."""
    outcome = F.when(F.col("forced"), "forced_timeout").otherwise("drained")
    abandoned = F.when(F.col("forced"), F.col("pending") + F.col("running")).otherwise(0)
    return reports.filter("state = 'stopped'").groupBy("pool", "queue", outcome.alias("outcome")).agg(F.count("*").alias("shutdowns"), F.sum(abandoned).cast("long").alias("abandoned"))


def safety(log: DataFrame) -> DataFrame:
    """Failures of control operations by operation and by operation and reason."""
    rows = log.filter("failed").select(F.col("queue").alias("operation"), F.col("failure_code").cast("string").alias("reason"))
    keys = F.array(F.col("operation"), F.concat_ws(":", "operation", "reason"))
    return rows.select(F.explode(keys).alias("key")).groupBy("key").agg(F.count("*").alias("value"))
