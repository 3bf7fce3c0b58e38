"""Known values, and folds against plain replays."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from queuelens.functions import exprs
from queuelens.functions.handlers import HandlerError, apply_handlers
from queuelens.operators import control, delivery, ranks
from queuelens.sources import task_log


def values(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_durations(spark):
    texts = [("1m30s",), ("1.5h",), ("-250ms",), ("10us",), ("0",), ("soon",), ("5",), (None,)]
    assert values(spark, exprs.parse_duration(F.col("t")), texts, "t string") == [90 * 10**9, 5400 * 10**9, -250 * 10**6, 10**4, 0, None, None, None]
    ns = [(0,), (1,), (1500,), (1_500_000,), (90 * 10**9,), (3_723_500_000_000,), (-2 * 10**9,)]
    assert values(spark, exprs.format_duration(F.col("n")), ns, "n long") == ["0s", "1ns", "1.5µs", "1.5ms", "1m30s", "1h2m3.5s", "-2s"]


def test_backoff_caps(spark):
    n = [(k,) for k in range(1, 6)]
    delay = exprs.backoff(F.lit(10**9), F.lit(2.0), F.lit(5 * 10**9), F.col("n"))
    assert values(spark, delay, n, "n int") == [10**9, 2 * 10**9, 4 * 10**9, 5 * 10**9, 5 * 10**9]
    assert values(spark, exprs.backoff(F.lit(10**9), F.lit(10.0), F.lit(7), F.col("n")), [(300,)], "n int") == [7]


def test_fnv(spark):
    def plain(t):
        h = 2166136261
        for b in t.encode():
            h = (h ^ b) * 16777619 & 0xFFFFFFFF
        return h

    texts = ["", "a", "task-1:3", "é€"]
    assert values(spark, exprs.fnv1a32(F.col("t")), [(t,) for t in texts], "t string") == [plain(t) for t in texts]


def test_recurrence_coalesces(spark):
    minute = 60_000_000
    after, missed = exprs.next_run(F.lit(0), F.lit(10 * minute), F.lit(25 * minute))
    row = spark.range(1).select(after.alias("a"), missed.alias("m")).first()
    assert (row.a, row.m) == (30 * minute, 2)


def test_lease_precedence(spark):
    rows = [(None, 0, 5, "a"), ("b", 9, 5, "a"), ("a", 5, 5, "a"), ("a", 4, 5, "a")]
    verdict = delivery.lease_state(F.col("idle"), F.col("ttl"), F.col("owner"), F.col("caller"))
    assert values(spark, verdict, rows, "owner string, idle int, ttl int, caller string") == ["unknown", "stale", "expired", "ok"]


def test_classes_and_outcomes(spark):
    rows = [("permanent", True, "stale"), ("", True, "stale"), (None, False, "expired"), (None, False, "ok")]
    assert values(spark, delivery.classify(F.col("t"), F.col("d"), F.col("l")), rows, "t string, d boolean, l string") == ["permanent", "timeout", "lease_lost", "transient_retryable"]
    rows = [("timeout", True), ("timeout", False), ("lease_lost", True), ("odd", True)]
    assert values(spark, delivery.outcome(F.col("c"), F.col("m")), rows, "c string, m boolean") == ["retry", "dead_letter", "dead_letter", "ack"]


def test_caps_equal_replay(spark):
    """Only accepted work is pending: what is rejected raises neither the queue's nor its key's count."""
    rng = random.Random(5)
    for per_queue, per_key in ((40, 15), (30, 40), (200, 9), (1, 1)):
        rows = [(k, f"q{rng.randrange(3)}", f"k{rng.randrange(4)}") for k in range(300)]
        got = {r.seq: r.reason for r in control.admit_by_caps(spark.createDataFrame(rows, "seq int, queue string, fairness_key string"), per_queue, per_key).collect()}
        whole, keyed, want = defaultdict(int), defaultdict(int), {}
        for k, q, f in rows:
            want[k] = "fairness_key_pending_cap" if keyed[q, f] >= per_key else "queue_pending_cap" if whole[q] >= per_queue else ""
            if not want[k]:
                whole[q] += 1
                keyed[q, f] += 1
        assert got == want


def test_slots_equal_replay(spark):
    """A task without a pool slot gives its global slot back."""
    rng = random.Random(9)
    limits = {"a": (6, 3), "b": (4, 9), "c": (None, 2), "d": (None, None)}
    rows = [(k, rng.choice("abcd"), f"q{rng.randrange(3)}") for k in range(120)]
    df = spark.createDataFrame(rows, "seq long, task_name string, queue string")
    caps = spark.createDataFrame([(n, *v) for n, v in limits.items() if n != "d"], "task_name string, global_limit long, pool_limit long")
    got = {r.seq: r.gets_slot for r in control.task_slots(df, caps).collect()}
    whole, pooled, want = defaultdict(int), defaultdict(int), {}
    for k, n, q in rows:
        most, pool = limits[n]
        want[k] = (most is None or whole[n] < most) and (pool is None or pooled[n, q] < pool)
        if want[k]:
            whole[n] += 1
            pooled[n, q] += 1
    assert got == want


def test_receipts_equal_replay(spark):
    """Gaps on both sides of the receipts' life, publishes that are let in and others that are not, and ties."""
    rng = random.Random(21)
    rows, at = [], 0
    for k in range(400):
        at += rng.choice([0, 1, 5, 10, 20, 30, 99, 100, 101])
        rows.append((k, at, f"k{rng.randrange(4)}", rng.random() < 0.7))
    got = {r.seq: r.deduplicated for r in delivery.with_receipts(spark.createDataFrame(rows, "seq long, created_us long, dedup_key string, accepts boolean"), 100).collect()}
    last, want = {}, {}
    for k, t, key, accepts in rows:
        want[k] = key in last and t - last[key] < 100
        if not want[k] and accepts:
            last[key] = t
    assert got == want and 50 < sum(want.values()) < 350


def test_dispatch_equals_replay(spark):
    """Slots and budgets per queue; an entry that fails one gives back what it took, and the scan goes on."""
    rng = random.Random(13)
    limits, gates = {"a": (5, 2), "b": (3, 9)}, {"a": ("x", 2, 5), "c": ("x", 3, 5), "d": ("y", 1, 2)}
    rows = [(f"q{rng.randrange(2)}", k, rng.choice("abcde")) for k in range(200)]
    out = control.dispatch(spark.createDataFrame(rows, "queue string, seq long, task_name string"), 8, spark.createDataFrame([(n, *v) for n, v in limits.items()], "task_name string, global_limit long, pool_limit long"), spark.createDataFrame([(n, *v) for n, v in gates.items()], "task_name string, budget string, tokens long, capacity long"))
    want, running, slots, used = [], defaultdict(int), defaultdict(int), defaultdict(int)
    for q, k, n in rows:
        budget, tokens, capacity = gates.get(n, (None, 0, 0))
        if running[q] < 8 and slots[q, n] < min(limits.get(n, (99, 99))) and (budget is None or used[q, budget] + tokens <= capacity):
            running[q] += 1
            slots[q, n] += 1
            used[q, budget] += tokens
            want.append((q, k))
    assert sorted(map(tuple, out.collect())) == sorted(want)


def test_mixed_token_leases_equal_replay(spark):
    rng = random.Random(17)
    rows = [(rng.choice(["a", "b", None]), k, rng.choice([1, 2, 3, 5])) for k in range(150)]
    got = {r.seq: r.acquired for r in control.greedy_leases(spark.createDataFrame(rows, "budget string, seq long, tokens long"), spark.createDataFrame([("a", 17), ("b", 4)], "budget string, capacity long")).collect()}
    used, want = defaultdict(int), {}
    for b, k, n in rows:
        want[k] = b is None or used[b] + n <= {"a": 17, "b": 4}[b]
        used[b] += n if want[k] else 0
    assert got == want


def test_fair_reserves(spark):
    """Reclaims come first, keys in order; then tiers, weights and quotas with every reservation counted."""
    keys = [("q", "a", 5, 0, 2, 1, 0, 0, 0), ("q", "b", 5, 0, 1, 0, 0, 3, 0), ("q", "c", 5, 0, 1, 0, 1, 0, 2)]
    df = spark.createDataFrame(keys, "queue string, fairness_key string, ready long, in_use long, weight long, reserved long, soft_quota long, hard_quota long, burst long")
    over = spark.createDataFrame([("q", "b", 2)], "queue string, fairness_key string, n long")
    got = [(r.fairness_key, r.kind) for r in control.fair_reserves(df, over, 14).orderBy("call").collect()]
    assert got == [("b", "reclaimed"), ("b", "reclaimed"), ("a", "reserved"), ("a", "shared"), ("a", "shared"), ("b", "shared"), ("c", "shared"), ("a", "shared"), ("b", "shared"), ("a", "shared"), ("b", "shared"), ("c", "borrow"), ("c", "borrow")]


def test_rfc3339(spark):
    us = [(0,), (-1,), (1_706_659_200_500_000,), (1_706_659_200_000_001,)]
    assert values(spark, exprs.rfc3339(F.col("u")), us, "u long") == ["1970-01-01T00:00:00Z", "1969-12-31T23:59:59.999999Z", "2024-01-31T00:00:00.5Z", "2024-01-31T00:00:00.000001Z"]
    texts = [("2024-01-31T00:00:00.5Z",), ("2024-01-31T02:00:00+02:00",), ("2024-01-31T00:00:00.123456789Z",), ("2024-01-31",), (None,)]
    assert values(spark, exprs.parse_rfc3339(F.col("t")), texts, "t string") == [1_706_659_200_500_000, 1_706_659_200_000_000, 1_706_659_200_123_456, None, None]


def test_budget_history_equals_replay(spark):
    rng = random.Random(7)
    rows = [("b", k, k * 10, rng.choice(["acquire", "acquire", "renew", "release"]), f"l{rng.randrange(6)}", rng.randrange(1, 4), rng.choice([15, 60, 200])) for k in range(200)]
    out = control.lease_history(spark.createDataFrame(rows, "budget string, seq long, at_us long, action string, lease string, tokens long, ttl_us long"), spark.createDataFrame([("b", 7)], "budget string, capacity long"))
    held, want = {}, []
    for _, seq, at, action, lease, tokens, ttl in rows:
        held = {k: v for k, v in held.items() if v[1] > at}
        if action == "release":
            held.pop(lease, None)
            ok = True
        elif lease in held:
            held[lease], ok = (held[lease][0], at + ttl), True
        elif action == "acquire" and sum(v[0] for v in held.values()) + tokens <= 7:
            held[lease], ok = (tokens, at + ttl), True
        else:
            ok = False
        want.append((seq, ok, sum(v[0] for v in held.values())))
    assert sorted((r.seq, r.ok, r.used) for r in out.collect()) == want


def test_adaptive_equals_replay(spark):
    rng = random.Random(3)
    rows = [("p", k * 100, n := rng.randrange(0, 5), rng.randrange(0, n + 1), n * rng.randrange(50, 250), int(rng.random() < 0.1), rng.randrange(0, 4)) for k in range(150)]
    df = spark.createDataFrame(rows, "pool string, window_us long, executions long, failures long, latency_sum_ns long, blocked long, backlog long")
    got = [(r.window_us, r.concurrency, r.healthy, r.action, r.reason) for r in control.adaptive(df, 2, 5, 1, 2, 200, 0.5, 1, 2, 300).orderBy("window_us").collect()]
    c, healthy, at, want = 2, 0, None, []
    for _, w, n, failed, latency, blocked, backlog in rows:
        mean, rate, before, reason, action = (latency / n, failed / n, c, "", "") if n else (0, 0, c, "", "")
        if mean > 200:
            reason, action, c, healthy = "latency", "scale_down", max(2, c - 1), 0
        elif rate > 0.5:
            reason, action, c, healthy = "error_rate", "scale_down", max(2, c - 1), 0
        elif blocked and backlog >= 1:
            reason, action, c, healthy = "budget_exhaustion", "scale_down", max(2, c - 1), 0
        else:
            healthy = healthy + 1 if n and not blocked else 0
            if backlog >= 1 and healthy >= 2 and (at is None or w - at >= 300):
                reason, action, c = "healthy_backlog", "scale_up", min(5, c + 2)
        at = w if c != before else at
        want.append((w, c, healthy, action if c != before else "", reason if c != before else ""))
    assert got == want and {x[4] for x in want} == {"", "latency", "error_rate", "budget_exhaustion", "healthy_backlog"}


def test_messages_round_trip(spark, tmp_path):
    lines = [('{"id":"t1","name":"x","queue":"","fairness_key":" a ","payload":"eyJ9","created_at":"0001-01-01T00:00:00Z","extra":1}',), ("no json",)]
    m = task_log.parse_messages(spark.createDataFrame(lines, "value string"))
    good = task_log.normalise(m.filter("not corrupt"), "2024-01-01 00:00:00").first()
    assert (good.queue, good.fairness_key, good.payload, str(good.created_at)) == ("default", "a", b'{"}', "2024-01-01 00:00:00")
    assert m.filter("corrupt").count() == 1
    task_log.write_messages(m.filter("not corrupt").drop("corrupt"), str(tmp_path / "m"))
    assert task_log.parse_messages(spark.read.text(str(tmp_path / "m"))).first().id == "t1"


def test_handlers(spark):
    def _fail(task, payload):
        raise HandlerError("permanent", "boom")

    rows = spark.createDataFrame([("1", "a", b""), ("2", "b", b"")], "id string, name string, payload binary")
    got = {r.id: (r.ok, r.failure_class, r.error) for r in apply_handlers(rows, {"a": _fail}).collect()}
    assert got == {"1": (False, "permanent", "boom"), "2": (True, "", "")}


def test_ticks(spark):
    """A standby does nothing; a leader whose epoch was passed is refused and steps down."""
    moved = spark.createDataFrame([("accepted",), ("deferred",), ("accepted",)], "decision string")
    synced = spark.createDataFrame([("dispatch",), ("wait",)], "action string")

    def did(*how):
        return sorted((r.operation, r["rows"], r.role) for r in control.tick(moved, synced, *how).collect())

    assert did(True, True, 7, 7) == [("move_due:accepted", 2, "leader"), ("move_due:deferred", 1, "leader"), ("sync_due:dispatch", 1, "leader"), ("sync_due:wait", 1, "leader")]
    assert did(True, False, 7, 7) == did(False, False, 0, 0) == []
    assert did(True, True, 7, 8) == [("demote", 1, "stale")]


def test_ranks(spark):
    """Positions and as-of values in buckets of any width are those of plain loops; keys without marks, ties and early events included."""
    rng = random.Random(31)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(200), k) for k in range(300)]
    df = spark.createDataFrame(rows, "k string, t long, seq long")
    want, count = {}, defaultdict(int)
    for k, t, s in sorted(rows, key=lambda r: r[1:]):
        count[k] += 1
        want[s] = count[k]
    for width in (1, 17, 1000):
        assert {r.seq: r.position for r in ranks.positions(df, ["k"], F.floor(F.col("t") / width), ["t", "seq"]).collect()} == want
    marks = [("a", 10, 1), ("a", 60, 2), ("a", 61, 3), ("c", 5, 9)]
    last = {s: max((m for m in marks if m[0] == k and m[1] <= t), default=(0, 0, None), key=lambda m: m[1])[2] for k, t, s in rows if k}
    events = df.filter("k is not null")
    for width in (1, 7, 1000):
        got = ranks.last_before(events, spark.createDataFrame(marks, "k string, t long, v long"), "k", "t", "v", width).collect()
        assert {r.seq: r.v for r in got} == last and len(got) == len(last)
