"""Allocation and control: caps, budgets, slots, dispatch, adaptive concurrency, recurrence, leadership.

Where a decision changes what the next one sees, a closed form by ranks is used if nothing leaves in between; else the
history of one key is folded in order with a native `aggregate`.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs
from ..functions.exprs import next_run
from ..sources.task_log import AS_OF_US
from .folds import replay
from .ranks import last_before


def _capped(arrivals: DataFrame, outer: list[str], inner: list[str], outer_cap: str, inner_cap: str, most: int) -> DataFrame:
    """Arrivals (seq, caps as columns, null or 0 for none, at most `most`) with the place where the inner and the outer group become full.

    Nothing leaves in between, so accepted are the first outer_cap among those within their inner group's cap. Only the first rows of
    a group decide; the ranks are limited before the shuffle, so no group is gathered in a task.
    """

    def nth(rows: DataFrame, keys: list[str], cap: str, name: str) -> DataFrame:
        first = rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy("seq"))).filter(F.col("__n") <= most)
        full = first.filter((F.col(cap) > 0) & (F.col("__n") == F.col(cap))).select(*[F.col(k).alias(f"__{name}_{k}") for k in keys], F.col("seq").alias(name))
        same = [F.col(k).eqNullSafe(F.col(f"__{name}_{k}")) for k in keys]
        on = same[0]
        for c in same[1:]:
            on = on & c
        return rows.join(full, on, "left").drop(*[f"__{name}_{k}" for k in keys])

    at = nth(arrivals, outer + inner, inner_cap, "inner_full")
    fits = F.col("inner_full").isNull() | (F.col("seq") <= F.col("inner_full"))
    outer_full = nth(at.filter(fits), outer, outer_cap, "outer_full").groupBy(*outer).agg(F.max("outer_full").alias("outer_full"))
    return at.join(outer_full, outer, "left")


def admit_by_caps(arrivals: DataFrame, per_queue: int, per_key: int) -> DataFrame:
    """Arrivals in order under caps of pending work, starting empty. Only accepted work is pending: a key's cap is the reason only if so many
    of the key were accepted, else the queue's."""
    at = _capped(arrivals.withColumns({"__q": F.lit(per_queue), "__k": F.lit(per_key)}), ["queue"], ["fairness_key"], "__q", "__k", max(per_queue, per_key))
    key_full = F.coalesce(F.col("seq") > F.col("inner_full"), F.lit(False)) & F.coalesce(F.col("inner_full") <= F.col("outer_full"), F.lit(True))
    queue_full = F.coalesce(F.col("seq") > F.col("outer_full"), F.lit(False))
    reason = F.when(key_full, "fairness_key_pending_cap").when(queue_full, "queue_pending_cap").otherwise("")
    return at.select("seq", "queue", "fairness_key", reason.alias("reason"))


def greedy_leases(requests: DataFrame, budgets: DataFrame) -> DataFrame:
    """Requests (budget, seq, tokens) of any sizes and no releases, in order: a request gets a lease if its tokens still fit. Without a budget
    nothing gates it. Once fewer tokens are free than the least request asks for, nothing more fits, so only as many
    requests of each size as the capacity holds are folded."""
    at = requests.join(budgets, "budget", "left")
    gated = at.filter("budget is not null").withColumn("mine", F.row_number().over(Window.partitionBy("budget", "tokens").orderBy("seq"))).filter(F.col("mine") * F.col("tokens") <= F.col("capacity"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<bigint>").alias("out"))

    def step(acc, x):
        fits = acc["used"] + x["tokens"] <= x["capacity"]
        return F.when(fits, F.struct((acc["used"] + x["tokens"]).alias("used"), F.concat(acc["out"], F.array(x["seq"])).alias("out"))).otherwise(acc)

    item = F.struct("seq", "tokens", "capacity")
    got = gated.groupBy("budget").agg(F.aggregate(F.array_sort(F.collect_list(item)), start, step, lambda a: a["out"]).alias("out")).select(F.explode("out").alias("seq"), F.lit(True).alias("got"))
    return at.join(got, "seq", "left").select("budget", "seq", (F.col("budget").isNull() | F.coalesce("got", F.lit(False))).alias("acquired"))


def _lease_step(held: dict, x: dict) -> tuple:
    for lease in [k for k, v in held.items() if v[1] <= x["at_us"]]:
        del held[lease]
    used = sum(v[0] for v in held.values())
    ends, mine = x["at_us"] + x["ttl_us"], x["lease"] in held
    ok = True
    if x["action"] == "release":
        held.pop(x["lease"], None)
    elif mine:
        held[x["lease"]] = (held[x["lease"]][0], ends)
    elif x["action"] == "acquire" and used + x["tokens"] <= x["capacity"]:
        held[x["lease"]] = (x["tokens"], ends)
    else:
        ok = False
    return x["seq"], ok, sum(v[0] for v in held.values())


def lease_history(events: DataFrame, budgets: DataFrame) -> DataFrame:
    """Acquire, renew and release events of each budget, replayed: whether each succeeds and the tokens in use after it.

    Leases whose end is reached go first; acquiring a held lease renews it; renewing needs a held one; releasing is idempotent. Events:
    budget, seq, at_us, action, lease, tokens, ttl_us. The state is the live leases, which the capacity bounds.
    """
    return replay(events.join(budgets, "budget"), "budget", ["at_us", "seq"], dict, _lease_step, "budget string, seq long, ok boolean, used long", ["budget", "seq", "ok", "used"])


def budget_usage(leases: DataFrame, budgets: DataFrame) -> DataFrame:
    """Tokens in live leases of every budget."""
    used = leases.filter(F.col("ends_us") > AS_OF_US).groupBy("budget").agg(F.sum("tokens").alias("in_use"))
    return budgets.join(used, "budget", "left").select("budget", "capacity", F.coalesce("in_use", F.lit(0).cast("long")).alias("in_use"))


def task_slots(running: DataFrame, limits: DataFrame) -> DataFrame:
    """Whether each task, in order, finds a global and a pool slot of its name; names without a limit always do. A task that finds no pool
    slot gives its global slot back."""
    most = limits.agg(F.greatest(F.max("global_limit"), F.max("pool_limit"))).first()[0] or 0
    at = _capped(running.join(limits, "task_name", "left"), ["task_name"], ["queue"], "global_limit", "pool_limit", most)
    late = F.coalesce(F.col("seq") > F.col("inner_full"), F.lit(False)) | F.coalesce(F.col("seq") > F.col("outer_full"), F.lit(False))
    return at.select("seq", "task_name", "queue", (~late).alias("gets_slot"))


def dispatch(pending: DataFrame, concurrency: int, limits: DataFrame, gates: DataFrame) -> DataFrame:
    """First-in-first-out dispatch that skips, not blocks: an entry is passed over where its name has no free global or pool slot or its budget
    too few tokens, and what it had taken is given back; the scan stops at the concurrency. Rows: queue, seq, task_name; limits:
    task_name, global_limit, pool_limit; gates: task_name, budget, tokens, capacity. Each queue has a worker with slots and budgets of its own.

    Of each name only as many entries as may ever run are kept, before anything is shuffled; that short list is folded.
    """
    at = pending.join(limits, "task_name", "left").join(gates, "task_name", "left")
    most = F.least(F.lit(concurrency), F.coalesce("global_limit", F.lit(concurrency)), F.coalesce("pool_limit", F.lit(concurrency)))
    at = at.withColumn("most", most).withColumn("mine", F.row_number().over(Window.partitionBy("queue", "task_name").orderBy("seq"))).filter(F.col("mine") <= concurrency).filter(F.col("mine") <= F.col("most"))
    start = F.struct(F.array().cast("array<struct<budget:string,tokens:bigint>>").alias("held"), F.array().cast("array<bigint>").alias("out"))

    def step(acc, x):
        used = F.aggregate(F.filter(acc["held"], lambda v: v["budget"] == x["budget"]), F.lit(0).cast("long"), lambda a, v: a + v["tokens"])
        free = (F.size(acc["out"]) < concurrency) & (x["budget"].isNull() | (used + x["tokens"] <= x["capacity"]))
        mine = F.array(F.struct(x["budget"].alias("budget"), x["tokens"].alias("tokens")))
        return F.when(free, F.struct(F.concat(acc["held"], F.when(x["budget"].isNotNull(), mine).otherwise(F.slice(mine, 1, 0))).alias("held"), F.concat(acc["out"], F.array(x["seq"])).alias("out"))).otherwise(acc)

    item = F.struct("seq", "budget", "tokens", "capacity")
    out = at.groupBy("queue").agg(F.aggregate(F.array_sort(F.collect_list(item)), start, step, lambda a: a["out"]).alias("out"))
    return out.select("queue", F.explode("out").alias("seq"))


def reserve_gate(pools: DataFrame, running: DataFrame, effective: DataFrame, states: DataFrame) -> DataFrame:
    """Whether a pool may reserve more: it accepts work, and running and buffered work is below the smaller of prefetch and the concurrency in
    effect (the configured one where none was set)."""
    at = pools.join(running, "queue", "left").join(effective, "pool", "left").join(states, "pool", "left").withColumn("busy", F.coalesce("busy", F.lit(0).cast("long")))
    now = F.coalesce("effective", "concurrency").cast("long")
    accepts = F.coalesce("state", F.lit("accepting")) == "accepting"
    return at.select("pool", "busy", now.alias("effective"), (accepts & (F.col("busy") < F.least("prefetch", now))).alias("can_reserve"))


def control_windows(log: DataFrame, period_us: int) -> DataFrame:
    """Executions, failures, mean latency, error rate and budget blocks of each queue in tumbling windows, and its backlog: ready and reserved
    work."""
    at = log.filter("placement in ('acked', 'dead')").withColumn("window_us", F.col("created_us") - F.pmod("created_us", F.lit(period_us)))
    counted = at.groupBy("queue", "window_us").agg(
        F.count("*").alias("executions"), F.count_if("failed").alias("failures"), F.sum("latency_ns").alias("latency_sum_ns"),
        F.count_if((F.col("placement") == "dead") & (F.col("failure_code") == 5)).alias("blocked"),
    )
    waiting = log.groupBy("queue").agg(F.count_if(F.col("placement").isin("ready", "pending")).alias("backlog"))
    rates = {"mean_latency_ns": F.try_divide("latency_sum_ns", F.col("executions").cast("double")), "error_rate": F.try_divide("failures", F.col("executions").cast("double"))}
    return counted.withColumns({k: F.coalesce(v, F.lit(0.0)) for k, v in rates.items()}).join(waiting, "queue")


def adaptive(windows: DataFrame, least: int, most: int, down: int, up: int, latency_ns: int, error_rate: float, backlog_least: int, healthy_needed: int, cooldown_us: int) -> DataFrame:
    """The concurrency controller folded over each pool's windows (pool, window_us, executions, failures, latency_sum_ns, blocked, backlog)."""
    init = F.struct(F.lit(least).alias("c"), F.lit(0).alias("healthy"), F.lit(None).cast("long").alias("at"), F.array().cast("array<struct<window_us:bigint,concurrency:int,healthy:int,action:string,reason:string>>").alias("out"))

    def step(a, w):
        n = w["executions"]
        mean = F.when(n > 0, w["latency_sum_ns"] / n).otherwise(0.0)
        rate = F.when(n > 0, w["failures"] / n).otherwise(0.0)
        reason = F.when(mean > latency_ns, "latency").when(rate > error_rate, "error_rate").when((w["blocked"] > 0) & (w["backlog"] >= backlog_least), "budget_exhaustion")
        healthy = F.when(reason.isNull() & (n > 0) & (w["blocked"] == 0), a["healthy"] + 1).otherwise(0)
        rested = a["at"].isNull() | (w["window_us"] - a["at"] >= cooldown_us)
        grow = reason.isNull() & (w["backlog"] >= backlog_least) & (healthy >= healthy_needed) & rested
        c = F.when(reason.isNotNull(), F.greatest(a["c"] - down, F.lit(least))).when(grow, F.least(a["c"] + up, F.lit(most))).otherwise(a["c"])
        changed = c != a["c"]
        action = F.when(~changed, "").when(reason.isNotNull(), "scale_down").otherwise("scale_up")
        row = F.struct(w["window_us"].alias("window_us"), c.alias("concurrency"), healthy.alias("healthy"), action.alias("action"), F.when(changed, F.coalesce(reason, F.lit("healthy_backlog"))).otherwise("").alias("reason"))
        return F.struct(c.alias("c"), healthy.alias("healthy"), F.when(changed, w["window_us"]).otherwise(a["at"]).alias("at"), F.concat(a["out"], F.array(row)).alias("out"))

    item = F.struct("window_us", "executions", "failures", "latency_sum_ns", "blocked", "backlog")
    return windows.groupBy("pool").agg(F.aggregate(F.array_sort(F.collect_list(item)), init, step, lambda a: a["out"]).alias("out")).select("pool", F.inline("out"))


def adaptive_status(pools: DataFrame, reports: DataFrame, life_us: int) -> DataFrame:
    """The last report (pool, updated_us, effective, reason) of every pool that is younger than its life; a pool without one has only its name."""
    last = reports.groupBy("pool").agg(F.max_by(F.struct("updated_us", "effective", "reason"), "updated_us").alias("x")).filter(F.col("x.updated_us") > AS_OF_US - life_us)
    return pools.select("pool").join(last, "pool", "left").select("pool", F.coalesce("x.effective", F.lit(0)).cast("long").alias("effective"), F.coalesce("x.reason", F.lit("")).alias("reason"), F.col("x").isNotNull().alias("present"))


def observe_leader(locks: DataFrame) -> DataFrame:
    """Who holds each lock (lock, token, expires_us) now: owner, epoch and the time it has left; a lock that ran out has no holder."""
    live = F.col("expires_us") > AS_OF_US
    last = locks.groupBy("lock").agg(F.max_by(F.struct("token", "expires_us"), "expires_us").alias("x")).select("lock", "x.*")
    return last.select(
        "lock", live.alias("present"), F.when(live, exprs.fence_owner(F.col("token"))).alias("owner"), F.when(live, exprs.fence_epoch(F.col("token"))).alias("epoch"), F.when(live, F.floor((F.col("expires_us") - AS_OF_US) / 1000)).alias("ttl_ms")
    )


def fair_reserves(keys: DataFrame, expired: DataFrame, calls: int) -> DataFrame:
    """What `calls` reserve calls on each fair queue return, one after the other: first expired leases, keys in order, then the weighted pick of the
    best tier, whose key then has one entry less ready and one more reserved. Keys: queue, fairness_key, ready, in_use and its rule; expired:
    queue, fairness_key, n. A queue's keys are few; entries are counted, not gathered."""
    at = keys.join(expired, ["queue", "fairness_key"], "left").fillna(0, ["n"])

    def run(key, table):
        rows = sorted(table.to_pylist(), key=lambda r: r["fairness_key"].encode())
        out, tickets = [], {}
        for call in range(1, calls + 1):
            over = next((r for r in rows if r["n"] > 0), None)
            if over:
                over["n"] -= 1
                out.append((call, over["fairness_key"], "reclaimed"))
                continue
            tiers: dict[str, list[dict]] = {}
            for r in rows:
                used, soft = r["in_use"], r["soft_quota"]
                if r["ready"] == 0:
                    continue
                if used < r["reserved"]:
                    tiers.setdefault("reserved", []).append(r)
                elif not (r["hard_quota"] > 0 and used >= r["hard_quota"]):
                    if soft <= 0 or used < soft:
                        tiers.setdefault("shared", []).append(r)
                    elif used < soft + r["burst"]:
                        tiers.setdefault("borrow", []).append(r)
            tier = next((t for t in ("reserved", "shared", "borrow") if t in tiers), None)
            if tier is None:
                break
            weights = [max(1, r["weight"]) for r in tiers[tier]]
            place = tickets.get(tier, 0) % sum(weights)
            tickets[tier] = tickets.get(tier, 0) + 1
            for r, w in zip(tiers[tier], weights, strict=True):
                if place < w:
                    break
                place -= w
            r["ready"], r["in_use"] = r["ready"] - 1, r["in_use"] + 1
            out.append((call, r["fairness_key"], tier))
        return pa.table({"queue": pa.array([key[0].as_py()] * len(out), pa.string()), "call": pa.array([o[0] for o in out], pa.int64()), "fairness_key": pa.array([o[1] for o in out], pa.string()), "kind": pa.array([o[2] for o in out], pa.string())})

    return at.groupBy("queue").applyInArrow(run, "queue string, call long, fairness_key string, kind string")


def due_schedules(states: DataFrame, limit: int = 100) -> DataFrame:
    """Ids of indexed schedules due now, earliest first, ties by id."""
    return states.filter(F.col("next_run_us").isNotNull() & (F.floor(F.col("next_run_us") / 1000) <= AS_OF_US // 1000)).orderBy(F.floor(F.col("next_run_us") / 1000), "schedule_id").limit(limit).select("schedule_id", "next_run_us")


def sync_due(due: DataFrame, states: DataFrame, configured: DataFrame) -> DataFrame:
    """What one sync does with each due id: remove one that is not configured, take a disabled one out of the index, begin anew where the
    state is missing or its definition changed, else dispatch the nominal run once, with the runs missed since. A state that another
    scheduler advanced meanwhile (seen_us differs) is dispatched by neither twice: the dedup key names the nominal run."""
    at = due.select("schedule_id").join(states.select("schedule_id", F.col("definition_hash").alias("had"), "next_run_us", "seen_us"), "schedule_id", "left").join(configured.select("schedule_id", "enabled", "definition_hash", "interval_us", "start_us", F.lit(True).alias("known")), "schedule_id", "left")
    fresh = F.col("had").isNull() | (F.col("had") != F.col("definition_hash")) | F.col("next_run_us").isNull()
    begins = initial_run(F.col("start_us"), F.col("interval_us"))
    at = at.withColumn("run_us", F.when(fresh, begins).otherwise(F.col("next_run_us")))
    action = (
        F.when(F.col("known").isNull(), "remove").when(~F.col("enabled"), "unindex").when(F.col("run_us") > AS_OF_US, "wait").when(~fresh & (F.col("seen_us") != F.col("next_run_us")), "lost_race").otherwise("dispatch")
    )
    after, missed = next_run(F.col("run_us"), F.col("interval_us"), F.lit(AS_OF_US))
    at = at.withColumn("action", action)
    sent = F.col("action") == "dispatch"
    return at.select(
        "schedule_id", "action", F.when(sent, exprs.rfc3339(F.col("run_us"))).alias("nominal_at"), F.when(sent, after).alias("next_run_us"), F.when(sent, missed).alias("missed_runs"),
        F.when(sent, F.concat_ws(":", F.lit("recurring"), "schedule_id", exprs.rfc3339(F.col("run_us")))).alias("dedup_key"),
    )


def initial_run(start_us, interval_us):
    """The first run of a schedule: its start, else one interval from now."""
    return F.coalesce(start_us, F.lit(AS_OF_US) + interval_us)


def recurring(states: DataFrame) -> DataFrame:
    """Due schedules with their nominal run, next run and missed runs; a dedup key makes each (schedule, nominal) run once."""
    after, missed = next_run(F.col("next_run_us"), F.col("interval_us"), F.lit(AS_OF_US))
    return states.filter(F.col("enabled") & (F.col("next_run_us") <= AS_OF_US)).select("schedule_id", F.col("next_run_us").alias("nominal_us"), after.alias("next_run_us"), missed.alias("missed"), F.concat_ws(":", F.lit("recurring"), "schedule_id", F.col("next_run_us").cast("string")).alias("dedup_key"))


def reconcile(configured: DataFrame, persisted: DataFrame) -> DataFrame:
    """Merge of configured and persisted schedules: insert, reset where the definition changed, keep, delete."""
    c, p = configured.alias("c"), persisted.alias("p")
    at = c.join(p, F.col("c.schedule_id") == F.col("p.schedule_id"), "full_outer")
    action = F.when(F.col("c.schedule_id").isNull(), "delete").when(F.col("p.schedule_id").isNull(), "insert").when((F.col("c.definition_hash") != F.col("p.definition_hash")) | F.col("p.next_run_us").isNull(), "reset").otherwise("keep")
    return at.select(F.coalesce("c.schedule_id", "p.schedule_id").alias("schedule_id"), action.alias("action"), F.coalesce(F.col("c.enabled"), F.lit(False)).alias("indexed"))


def leadership_audit(terms: DataFrame) -> DataFrame:
    """Terms (epoch, owner, acquired_us, lost_us) that break the rules: an epoch that does not grow, or a term begun before the last ended."""
    order = Window.partitionBy("lock").orderBy("acquired_us", "epoch")
    at = terms.withColumns({"before": F.lag("epoch").over(order), "ended": F.lag("lost_us").over(order)})
    return at.select("lock", "epoch", "owner", F.coalesce(F.col("epoch") <= F.col("before"), F.lit(False)).alias("epoch_not_growing"), F.coalesce(F.col("acquired_us") < F.col("ended"), F.lit(False)).alias("overlaps"))


def fenced_writes(writes: DataFrame, terms: DataFrame, width_us: int = 60_000_000) -> DataFrame:
    """As-of check of control writes (seq, lock, at_us, epoch): the epoch must be that of the term current at the time."""
    marks = terms.select("lock", F.col("acquired_us").alias("at_us"), F.col("epoch").alias("current"))
    at = last_before(writes, marks, "lock", "at_us", "current", width_us)
    return at.select("seq", "lock", "epoch", (~F.col("epoch").eqNullSafe(F.col("current"))).alias("stale"))


def first_successes(log: DataFrame) -> DataFrame:
    """First success of each idempotency key, which is the task's id where none is given; failures free the key."""
    key = F.coalesce(F.nullif("dedup_key", F.lit("")), F.col("task_id"))
    return log.filter("placement = 'acked' and not failed").groupBy(key.alias("dedup_key")).agg(F.min_by("task_id", "seq").alias("task_id"))


def tick(moved: DataFrame, synced: DataFrame, present: bool, mine: bool, epoch: int, seen_epoch: int) -> DataFrame:
    """What one tick of a scheduler did, from what it would do: a standby does nothing; a leader whose epoch was passed meanwhile is refused at its
    first write and steps down; else due entries were moved and due schedules dispatched."""
    role = "leader" if present and mine and epoch == seen_epoch else "stale" if present and mine else "standby"
    did = moved.groupBy("decision").agg(F.count("*").alias("rows")).select(F.concat(F.lit("move_due:"), "decision").alias("operation"), "rows")
    did = did.unionByName(synced.groupBy("action").agg(F.count("*").alias("rows")).select(F.concat(F.lit("sync_due:"), "action").alias("operation"), "rows"))
    if role == "stale":
        did = did.limit(0).unionByName(moved.sparkSession.createDataFrame([("demote", 1)], "operation string, rows long"))
    return did.withColumn("role", F.lit(role)) if role != "standby" else did.limit(0).withColumn("role", F.lit(role))


def shutdown(workers: DataFrame) -> DataFrame:
    """How a group of pools stopped: one fatal error ends all; whatever had to be forced makes the whole forced."""
    fatal, forced = F.count_if(F.col("failed")) > 0, F.count_if(F.col("forced")) > 0
    return workers.groupBy("queue").agg(F.when(fatal, "failed").when(forced, "forced_timeout").otherwise("drained").alias("outcome"), F.count("*").alias("pools"), F.sum(F.when(F.col("forced"), F.col("pending") + F.col("running")).otherwise(0)).cast("long").alias("abandoned"))
