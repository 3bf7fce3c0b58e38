"""Settings given as JSON texts: pools, limits, budgets, schedules, fairness rules, parsed into tables, and what is wrong with them.

Parsing applies the defaults; a problem is a row (section, subject, problem), in place of an error at the first. The texts are small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs

#: Fields of each section; durations are texts.
SECTIONS = {
    "pools": "name string, queue string, concurrency int, prefetch int, lease_ttl string",
    "task_limits": "task_name string, max_concurrency int",
    "budgets": "name string, capacity int",
    "task_budgets": "task_name string, budget string, tokens int",
    "schedules": "id string, interval string, queue string, fairness_key string, task_name string, payload string, headers map<string,string>, enabled boolean, misfire_policy string, start_at string",
    "fairness": "name string, keys array<string>, weight int, reserved_concurrency int, soft_quota int, hard_quota int, burst int",
    "adaptive": "pool string, concurrency int, prefetch int, min_concurrency int, max_concurrency int, control_period string, cooldown string, scale_up_step int, scale_down_step int, latency_threshold string, error_rate_threshold double, backlog_threshold int, healthy_windows_required int",
}


def rows(spark: SparkSession, section: str, text: str) -> DataFrame:
    """The entries of a section's JSON array, in order, with their place; unknown fields are ignored, missing ones null."""
    parsed = F.from_json(F.lit(text), f"array<struct<{SECTIONS[section].replace(' ', ':').replace(',:', ',')}>>")
    return parsed_rows(spark.range(1).select(parsed.alias("x")))


def parsed_rows(arrays: DataFrame) -> DataFrame:
    return arrays.select(F.posexplode("x").alias("place", "x")).select("place", "x.*")


def trimmed(name: str) -> Column:
    return F.trim(F.coalesce(F.col(name), F.lit("")))


def pools(raw: DataFrame) -> DataFrame:
    """Worker pools: the queue is `default` if blank, the prefetch is the concurrency if not given."""
    return raw.select(
        trimmed("name").alias("name"), exprs.or_default(F.col("queue"), "default").alias("queue"), F.col("concurrency").cast("long").alias("concurrency"),
        F.when(F.coalesce("prefetch", F.lit(0)) == 0, F.col("concurrency")).otherwise(F.col("prefetch")).cast("long").alias("prefetch"), exprs.parse_duration(F.trim("lease_ttl")).alias("lease_ns"),
    )


def task_budgets(raw: DataFrame) -> DataFrame:
    """Budgets of task names: one token if none are given."""
    return raw.select(trimmed("task_name").alias("task_name"), trimmed("budget").alias("budget"), F.when(F.coalesce("tokens", F.lit(0)) == 0, 1).otherwise(F.col("tokens")).cast("long").alias("tokens"))


def schedules(raw: DataFrame) -> DataFrame:
    """Recurring schedules: enabled and coalescing if nothing else is said; with the hash of their definition."""
    at = raw.select(
        F.col("id").alias("schedule_id"), exprs.parse_duration(F.col("interval")).alias("interval_ns"), exprs.or_default(F.col("queue"), "default").alias("queue"), trimmed("fairness_key").alias("fairness_key"), F.col("task_name"), F.col("payload"),
        F.col("headers"), F.coalesce("enabled", F.lit(True)).alias("enabled"), exprs.or_default(F.col("misfire_policy"), "coalesce").alias("misfire_policy"), exprs.parse_rfc3339(F.col("start_at")).alias("start_us"),
    )
    return at.withColumn("definition_hash", definition_hash())


def definition_hash() -> Column:
    """SHA-256 over the lines of a definition: id, interval, queue, key, task, misfire policy, start, payload, and key=value of the sorted headers."""
    lines = F.array(
        F.col("schedule_id"), exprs.format_duration(F.col("interval_ns")), F.col("queue"), F.col("fairness_key"), F.col("task_name"), F.col("misfire_policy"),
        F.coalesce(exprs.rfc3339(F.col("start_us")), F.lit("")), F.coalesce("payload", F.lit("")),
    )
    headers = F.transform(F.array_sort(F.map_entries(F.coalesce("headers", F.create_map().cast("map<string,string>")))), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.sha2(F.array_join(F.concat(lines, headers), "\n"), 256)


def _problems(raw: DataFrame, section: str, subject: Column, checks: dict[str, Column]) -> DataFrame:
    """A row for each check that an entry fails."""
    failed = F.filter(F.array(*[F.when(c, F.lit(name)) for name, c in checks.items()]), lambda p: p.isNotNull())
    return raw.select(F.lit(section).alias("section"), subject.alias("subject"), F.explode(failed).alias("problem"))


def _twice(raw: DataFrame, section: str, subject: Column, problem: str) -> DataFrame:
    return raw.select(subject.alias("subject")).filter("subject <> ''").groupBy("subject").agg(F.count("*").alias("n")).filter("n > 1").select(F.lit(section).alias("section"), "subject", F.lit(problem).alias("problem"))


def _not(condition: Column) -> Column:
    return ~F.coalesce(condition, F.lit(False))


def pool_problems(raw: DataFrame) -> DataFrame:
    """Of pools: names and queues missing or given twice, concurrency, prefetch and lease out of bounds."""
    at = pools(raw)
    checks = {
        "name is required": F.col("name") == "", "concurrency must be >= 1": _not(F.col("concurrency") >= 1), "prefetch must be >= concurrency": F.col("prefetch") < F.col("concurrency"),
        "lease_ttl is no duration": F.col("lease_ns").isNull(), "lease_ttl must be > 0": F.col("lease_ns") <= 0,
    }
    return _problems(at, "pools", F.col("name"), checks).unionByName(_twice(at, "pools", F.col("name"), "duplicate name")).unionByName(_twice(at, "pools", F.col("queue"), "duplicate queue"))


def limit_problems(raw: DataFrame) -> DataFrame:
    name = trimmed("task_name")
    checks = {"task_name is required": name == "", "max_concurrency must be >= 1": _not(F.col("max_concurrency") >= 1)}
    return _problems(raw, "task_limits", name, checks).unionByName(_twice(raw, "task_limits", name, "duplicate task_name"))


def budget_problems(raw: DataFrame) -> DataFrame:
    name = trimmed("name")
    return _problems(raw, "budgets", name, {"name is required": name == "", "capacity must be >= 1": _not(F.col("capacity") >= 1)}).unionByName(_twice(raw, "budgets", name, "duplicate budget"))


def task_budget_problems(raw: DataFrame, budgets: DataFrame) -> DataFrame:
    at = task_budgets(raw).join(budgets.select(trimmed("name").alias("budget")).distinct().withColumn("known", F.lit(True)), "budget", "left")
    checks = {
        "task_name is required": F.col("task_name") == "", "budget is required": F.col("budget") == "", "unknown budget": (F.col("budget") != "") & F.col("known").isNull(), "tokens must be >= 1": F.col("tokens") < 1,
    }
    return _problems(at, "task_budgets", F.col("task_name"), checks).unionByName(_twice(at, "task_budgets", F.col("task_name"), "duplicate mapping"))


def schedule_problems(raw: DataFrame) -> DataFrame:
    start, every = F.trim(F.coalesce("start_at", F.lit(""))), exprs.parse_duration(F.col("interval"))
    checks = {
        "id is required": trimmed("id") == "", "interval is no duration": every.isNull(), "interval must be > 0": every <= 0, "task_name is required": trimmed("task_name") == "", "payload is required": F.coalesce("payload", F.lit("")) == "",
        "misfire_policy is not supported": exprs.or_default(F.col("misfire_policy"), "coalesce") != "coalesce", "start_at is no time": (start != "") & exprs.parse_rfc3339(start).isNull(),
    }
    return _problems(raw, "schedules", F.coalesce("id", F.lit("")), checks).unionByName(_twice(raw, "schedules", F.coalesce("id", F.lit("")), "duplicate id"))


def fairness_problems(raw: DataFrame) -> DataFrame:
    """Of fairness rules: names missing or twice, negative values, quotas in the wrong order, keys twice or blank (the default rule's)."""
    name, hard = trimmed("name"), F.coalesce("hard_quota", F.lit(0))
    negative = F.lit(False)
    for c in ("weight", "reserved_concurrency", "soft_quota", "hard_quota", "burst"):
        negative = negative | (F.coalesce(F.col(c), F.lit(0)) < 0)
    checks = {
        "name is required": name == "", "values must be >= 0": negative, "soft_quota must be <= hard_quota": (hard > 0) & (F.coalesce("soft_quota", F.lit(0)) > hard), "reserved_concurrency must be <= hard_quota": (hard > 0) & (F.coalesce("reserved_concurrency", F.lit(0)) > hard),
        "cannot target the default key": F.exists(F.coalesce("keys", F.array().cast("array<string>")), lambda k: F.trim(k) == ""),
    }
    keys = raw.select(F.explode("keys").alias("k")).select(F.trim("k").alias("k"))
    return _problems(raw, "fairness", name, checks).unionByName(_twice(raw, "fairness", name, "duplicate name")).unionByName(_twice(keys, "fairness", F.col("k"), "duplicate key"))


def adaptive_problems(raw: DataFrame) -> DataFrame:
    """Of adaptive concurrency: bounds, steps, periods and thresholds."""
    period, rest, latency = (exprs.parse_duration(F.trim(c)) for c in ("control_period", "cooldown", "latency_threshold"))
    least, most, now = F.col("min_concurrency"), F.col("max_concurrency"), F.col("concurrency")
    checks = {
        "min_concurrency must be >= 1": _not(least >= 1), "max_concurrency must be >= min_concurrency": _not(most >= least), "concurrency must lie between": (now < least) | (now > most), "prefetch must be >= max_concurrency": F.col("prefetch") < most,
        "control_period must be > 0": _not(period > 0), "cooldown must be >= 0": _not(rest >= 0), "scale_up_step must be >= 1": _not(F.col("scale_up_step") >= 1), "scale_down_step must be >= 1": _not(F.col("scale_down_step") >= 1),
        "latency_threshold must be > 0": _not(latency > 0), "error_rate_threshold must be >= 0": _not(F.col("error_rate_threshold") >= 0), "backlog_threshold must be >= 0": _not(F.col("backlog_threshold") >= 0), "healthy_windows_required must be >= 1": _not(F.col("healthy_windows_required") >= 1),
    }
    return _problems(raw, "adaptive", F.col("pool"), checks)
