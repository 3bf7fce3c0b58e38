"""Column functions of the task model: durations, hashes, backoff, tokens, labels. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Units of duration texts in nanoseconds.
UNITS = {"ns": 1, "us": 1_000, "µs": 1_000, "ms": 1_000_000, "s": 1_000_000_000, "m": 60_000_000_000, "h": 3_600_000_000_000}
#: The fairness key of messages without one.
DEFAULT_KEY = "__default__"


def micros(column: str) -> Column:
    """Microseconds since the epoch of a timestamp without zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {column})")


def rfc3339(us: Column) -> Column:
    """The UTC text of microseconds since the epoch, trailing zeros of the fraction cut: 2024-01-31T00:00:00.5Z."""
    days, rest = F.floor(us / 86_400_000_000), F.pmod(us, F.lit(86_400_000_000))
    day = F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), days.cast("int")), "yyyy-MM-dd")
    seconds = F.floor(rest / 1_000_000)
    clock = F.format_string("T%02d:%02d:%02d", F.floor(seconds / 3600), F.floor(seconds / 60) % 60, seconds % 60)
    fraction = F.rtrim(F.format_string(".%06d", rest % 1_000_000), F.lit("0"))
    return F.concat(day, clock, F.when(fraction == ".", "").otherwise(fraction), F.lit("Z"))


def parse_rfc3339(text: Column) -> Column:
    """Microseconds since the epoch of a text with its zone (Z or an offset), digits beyond microseconds cut; null where it is none."""
    good = F.regexp_like(text, F.lit(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)$"))
    return F.when(good, F.unix_micros(F.try_to_timestamp(F.regexp_replace(text, r"(\.\d{6})\d+", "$1"))))


def or_default(c: Column, default: str) -> Column:
    """A trimmed text, or the default where it is null or blank."""
    return F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(default))


def parse_duration(c: Column) -> Column:
    """Nanoseconds of texts such as 1m30s, -1.5h or 250ms; null where the text is no duration."""
    body = F.regexp_replace(c, "^[+-]", "")
    numbers = F.regexp_extract_all(body, F.lit(r"([0-9]*\.?[0-9]+|[0-9]+\.)(ns|us|µs|ms|s|m|h)"), F.lit(1))
    units = F.regexp_extract_all(body, F.lit(r"([0-9]*\.?[0-9]+|[0-9]+\.)(ns|us|µs|ms|s|m|h)"), F.lit(2))
    scale = F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv])
    parts = F.zip_with(numbers, units, lambda n, u: F.round(n.cast("decimal(20,9)") * F.element_at(scale, u)).cast("long"))
    total = F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a + x)
    sign = F.when(F.startswith(c, F.lit("-")), -1).otherwise(1)
    good = F.regexp_like(c, F.lit(r"^[+-]?(0|(([0-9]*\.?[0-9]+|[0-9]+\.)(ns|us|µs|ms|s|m|h))+)$"))
    return F.when(good, sign * total)


def format_duration(ns: Column) -> Column:
    """The canonical text of a duration of whole nanoseconds: 1h2m3.5s, 1.5ms, 0s."""
    a = F.abs(ns)

    def plain(value: Column, digits: int) -> Column:
        return F.regexp_replace(F.regexp_replace(value.cast(f"decimal(20,{digits})").cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")

    seconds = plain((a % 60_000_000_000).cast("decimal(20,0)") / F.lit(1_000_000_000).cast("decimal(20,0)"), 9)
    h, m = F.floor(a / 3_600_000_000_000), F.floor(a / 60_000_000_000) % 60
    long_text = F.concat(F.when(h > 0, F.concat(h.cast("string"), F.lit("h"))).otherwise(""), F.when((h > 0) | (m > 0), F.concat(m.cast("string"), F.lit("m"))).otherwise(""), seconds, F.lit("s"))
    text = (
        F.when(a == 0, F.lit("0s"))
        .when(a < 1_000, F.concat(a.cast("string"), F.lit("ns")))
        .when(a < 1_000_000, F.concat(plain(a.cast("decimal(20,0)") / F.lit(1_000).cast("decimal(20,0)"), 3), F.lit("µs")))
        .when(a < 1_000_000_000, F.concat(plain(a.cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(20,0)"), 6), F.lit("ms")))
        .otherwise(long_text)
    )
    return F.concat(F.when(ns < 0, F.lit("-")).otherwise(""), text)


def fnv1a32(text: Column) -> Column:
    """FNV-1a over the UTF-8 bytes of a text, as a number of 32 bits."""
    digits = F.hex(F.encode(text, "UTF-8"))
    at = F.when(F.length(digits) > 0, F.transform(F.sequence(F.lit(0), (F.length(digits) / 2).cast("int") - 1), lambda i: F.conv(F.substring(digits, i * 2 + 1, F.lit(2)), 16, 10).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(at, F.lit(2166136261).cast("long"), lambda h, b: (h.bitwiseXOR(b) * F.lit(16777619)).bitwiseAND(F.lit(4294967295)))


def backoff(initial: Column, multiplier: Column, most: Column, n: Column) -> Column:
    """Delay of the n-th retry in nanoseconds; capped before it becomes an integer."""
    return F.least(initial.cast("double") * F.pow(multiplier, F.greatest(n, F.lit(1)) - 1), most.cast("double")).cast("long")


def jittered(delay: Column, most: Column, jitter: Column, task_id: Column, n: Column) -> Column:
    """A delay spread by a share that depends on the task and the attempt alone."""
    unit = (fnv1a32(F.concat(task_id, F.lit(":"), n.cast("string"))) % 10000) / F.lit(9999.0)
    scale = F.greatest(F.lit(0.0), 1.0 + (2.0 * unit - 1.0) * jitter)
    return F.when(jitter > 0, F.least(F.floor(delay * scale).cast("long"), most)).otherwise(delay)


def should_retry(n: Column, max_deliveries: Column, age_ns: Column, max_age_ns: Column) -> Column:
    return (max_deliveries > 0) & (n < max_deliveries) & ~((max_age_ns > 0) & (age_ns >= max_age_ns))


def trace_id(trace: Column, traceparent: Column) -> Column:
    """The explicit trace id, else the second field of a traceparent, else empty."""
    return F.coalesce(F.nullif(F.trim(trace), F.lit("")), F.when(F.size(F.split(traceparent, "-")) >= 2, F.get(F.split(traceparent, "-"), F.lit(1))), F.lit(""))


def overwritten(headers: Column, new: Column) -> Column:
    """Headers with new ones, which win; null headers are none."""
    kept = F.map_filter(F.coalesce(headers, F.create_map().cast("map<string,string>")), lambda k, v: ~F.map_contains_key(new, k))
    return F.map_concat(kept, new)


def fence_owner(token: Column) -> Column:
    return F.nullif(F.regexp_extract(token, r"^(.+)\|([0-9]+)$", 1), F.lit(""))


def fence_epoch(token: Column) -> Column:
    return F.nullif(F.regexp_extract(token, r"^(.+)\|([0-9]+)$", 2), F.lit("")).cast("long")


#: Labels of metrics, and what stands for a blank one.
LABEL_DEFAULTS = {
    "queue": "default", "task_name": "unknown", "result_class": "unknown", "fairness_bucket": "default", "admission_source": "unknown", "admission_decision": "unknown", "admission_reason": "none", "pool": "default", "budget": "unknown",
    "adaptive_reason": "none", "adaptive_action": "none", "lifecycle_state": "unknown", "shutdown_outcome": "unknown", "abandon_reason": "unknown", "worker_id": "unknown",
}


#: The same by the names that labels have in metrics.
METRIC_DEFAULTS = {"queue": "default", "pool": "default", "bucket": "default", "source": "unknown", "decision": "unknown", "reason": "none", "action": "none", "state": "unknown"}


def label(name: str, c: Column) -> Column:
    return or_default(c, LABEL_DEFAULTS[name])


def distinct_names(rows: DataFrame, column: str, default: str) -> DataFrame:
    """The names of a column, trimmed, blank ones by their default, each once and in order."""
    return rows.select(or_default(F.col(column), default).alias("name")).distinct().orderBy("name")


def lease_key(queue: Column, fairness_key: Column, delivery_id: Column) -> Column:
    return F.concat_ws(":", queue, or_default(fairness_key, DEFAULT_KEY), delivery_id)


def stream_key(queue: Column, fairness_key: Column) -> Column:
    key = F.trim(F.coalesce(fairness_key, F.lit("")))
    return F.concat(F.lit("stream:"), or_default(queue, "default"), F.when(key == "", "").otherwise(F.concat(F.lit(":"), key)))


def group_key(queue: Column) -> Column:
    return F.concat(F.lit("group:"), or_default(queue, "default"))


def consumer_name(base: Column, host: Column, pid: Column) -> Column:
    return F.concat_ws(":", or_default(base, "worker"), or_default(host, "unknown-host"), pid.cast("string"))


def has_header(headers: Column, name: str) -> Column:
    return F.coalesce(F.element_at(headers, name), F.lit("")) != ""


def clamp(c: Column, least: Column, most: Column) -> Column:
    return F.greatest(least, F.least(c, most))


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a, b.cast("double")), F.lit(0.0))


STREAM_ID = r"^([0-9]{1,18})-([0-9]{1,18})$"


def stream_after(entry_id: Column) -> Column:
    """The id that follows; a text that is no stream id stays as it is."""
    return F.when(F.regexp_like(entry_id, F.lit(STREAM_ID)), F.concat(stream_ms(entry_id).cast("string"), F.lit("-"), (stream_seq(entry_id) + 1).cast("string"))).otherwise(entry_id)


def stream_compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1: by milliseconds and sequence, or as texts where one is no stream id."""
    both = F.regexp_like(a, F.lit(STREAM_ID)) & F.regexp_like(b, F.lit(STREAM_ID))
    of = [F.struct(F.when(both, stream_ms(x)).alias("ms"), F.when(both, stream_seq(x)).alias("seq"), F.when(~both, x).alias("text")) for x in (a, b)]
    return F.when(of[0] < of[1], -1).when(of[0] > of[1], 1).otherwise(0)


def stream_ms(entry_id: Column) -> Column:
    return F.split_part(entry_id, F.lit("-"), F.lit(1)).cast("long")


def stream_seq(entry_id: Column) -> Column:
    return F.split_part(entry_id, F.lit("-"), F.lit(2)).cast("long")


def next_run(next_us: Column, every_us: Column, now_us: Column) -> tuple[Column, Column]:
    """The next run after now and the number of runs missed, in closed form."""
    k = F.floor((now_us - next_us) / every_us)
    return F.when(next_us <= now_us, next_us + (k + 1) * every_us).otherwise(next_us), F.when(next_us <= now_us, k).otherwise(F.lit(0).cast("long"))
