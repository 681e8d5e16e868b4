"""Stateful stream operators and their batch twins.

The stream forms use event time with a watermark; state that a table alone cannot hold goes through
``applyInPandasWithState``, whose state per key is a few numbers or a bounded list and which times out by event time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType
from pyspark.sql.window import Window as W

from ..functions.folds import fold_sorted

WATERMARK = "10 minutes"
#: Seconds for which the first, second, ... miss in a row is believed.
LADDER = (600, 3600, 21600, 86400)


# --- evidence ---------------------------------------------------------------------------------------------------


def evidence_state(ev: DataFrame, now: str) -> DataFrame:
    """Batch twin: the last event of each kind decides. Bad removes alive before it, blocked outdoes hit and miss, a hit outdoes misses before it."""
    at = lambda k: F.max(F.when(F.col("kind") == k, F.col("seen_at")))
    until = lambda k: F.max_by(F.when(F.col("kind") == k, F.unix_micros("seen_at") + F.col("ttl_s") * 1_000_000), F.when(F.col("kind") == k, F.struct("seen_at", "event_id")))
    per = ev.groupBy("scope", "hash").agg(*[x for k in ("alive", "bad", "hit", "miss", "blocked") for x in (at(k).alias(f"{k}_at"), until(k).alias(f"{k}_until"))])
    t = F.unix_micros(F.lit(now).cast("timestamp"))
    live = lambda k: F.coalesce(F.col(f"{k}_until") > t, F.lit(False))
    alive = live("alive") & ~F.coalesce(F.col("bad_at") >= F.col("alive_at"), F.lit(False))
    state = F.when(live("blocked"), "blocked").when(live("hit") & ~F.coalesce(F.col("miss_at") > F.col("hit_at"), F.lit(False)), "hit").when(live("miss"), "miss")
    return per.select("scope", "hash", alive.alias("alive"), live("bad").alias("bad"), state.alias("state"))


def miss_backoff_fold(ev: DataFrame) -> DataFrame:
    """Batch twin: misses in a row per key in order of time; a run that has expired or a hit starts at one. A left fold along one key's sorted events, of which it carries two numbers."""
    ladder = [x * 1_000_000 for x in LADDER]
    rows = ev.where("kind in ('hit', 'miss')").select("hash", F.unix_micros("seen_at").alias("t"), "event_id", "kind")

    def step(a: list, e: tuple) -> list[tuple]:
        n, until = a
        t, _, kind = e
        n = 0 if kind == "hit" else 1 if t is not None and until is not None and t >= until else n + 1
        a[:] = n, 0 if n == 0 else None if t is None else t + ladder[min(n, len(ladder)) - 1]
        return []

    fields = StructType().add("misses", "long").add("until", "long")
    out = fold_sorted(rows, ["hash"], ["t", "event_id", "kind"], lambda: [0, 0], step, lambda a: [tuple(a)], fields)
    return out.select("hash", "misses", F.when(F.col("until") > 0, F.timestamp_micros("until")).alias("until"))


def miss_backoff_stream(ev: DataFrame) -> DataFrame:
    """Stream form of ``miss_backoff_fold``: emits a key's run and expiry whenever it changes."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, until = state.get if state.exists else (0, 0)
        rows = pd.concat(list(batches)).sort_values(["seen_at", "event_id"])
        for t, kind in zip(rows["seen_at"].astype("int64") // (1 if rows["seen_at"].dt.unit == "us" else 1000), rows["kind"]):
            n = 0 if kind == "hit" else 1 if t >= until else n + 1
            until = 0 if n == 0 else t + LADDER[min(n, len(LADDER)) - 1] * 1_000_000
        state.update((int(n), int(until)))
        state.setTimeoutTimestamp(max(int(until) // 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"hash": [key[0]], "misses": [int(n)], "until_us": [int(until)]})

    kept = ev.where("kind in ('hit', 'miss')").withWatermark("seen_at", WATERMARK)
    return kept.groupBy("hash").applyInPandasWithState(run, "hash string, misses long, until_us long", "n long, until long", "update", GroupStateTimeout.EventTimeTimeout)


# --- sources ----------------------------------------------------------------------------------------------------


def source_health(probes: DataFrame, now: str, ttl_s: int, trip: int, cooldown_s: int) -> DataFrame:
    """Batch twin: the last state of each source, its run of failures in a row (a gap over ``ttl_s`` breaks it), and whether the breaker is open."""
    state = F.when(~F.col("ok"), "offline").when(F.col("ms") > F.col("budget_ms"), "degraded").when(F.col("ms") * 2 > F.col("budget_ms"), "slow").otherwise("online")
    w = W.partitionBy("indexer").orderBy("ts", "event_id")
    df = probes.withColumn("state", state)
    gap = F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(w)) > ttl_s * 1_000_000
    df = df.withColumn("brk", (F.col("ok") | F.coalesce(gap, F.lit(True))).cast("int"))
    df = df.withColumn("island", F.sum("brk").over(w.rowsBetween(W.unboundedPreceding, 0)))
    runs = df.groupBy("indexer", "island").agg(F.count_if(~F.col("ok")).alias("fails"), F.max(F.struct("ts", "event_id", "state")).alias("last"))
    final = runs.groupBy("indexer").agg(F.max_by(F.struct("fails", "last"), "island").alias("x"))
    age = F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros("x.last.ts")
    streak = F.when(F.col("x.last.state") == "offline", F.col("x.fails")).otherwise(0).cast("long")
    return final.select("indexer", F.col("x.last.state").alias("state"), streak.alias("streak"), ((streak >= trip) & (age < cooldown_s * 1_000_000)).alias("is_open"))


# --- windows ----------------------------------------------------------------------------------------------------


def islands(events: DataFrame, key: str, seconds: int) -> DataFrame:
    """``key``, ``t``, ``event_id`` and ``island``: events of a key that no gap of ``seconds`` parts share an island.

    Such a gap never lies inside a bin of that width, so the bins' first and last times decide; bins are partial
    sums, few a key, and events meet their own bin only.
    """
    e = events.select(key, F.unix_micros("ts").alias("t"), "event_id").withColumn("bin", F.floor(F.col("t") / (seconds * 1_000_000)).cast("long") if seconds else F.col("t"))
    bins = e.groupBy(key, "bin").agg(F.min("t").alias("low"), F.max("t").alias("high"))
    w = W.partitionBy(key).orderBy("bin")
    apart = F.coalesce(F.col("low") - F.lag("high").over(w) >= seconds * 1_000_000, F.lit(True))
    bins = bins.withColumn("apart", apart.cast("long")).withColumn("island", F.sum("apart").over(w)).select(F.col(key).alias("__key"), F.col("bin").alias("__bin"), "island")
    return e.join(bins, F.col(key).eqNullSafe(F.col("__key")) & F.col("bin").eqNullSafe(F.col("__bin"))).select(key, "island", "t", "event_id")


def dedupe_within_fold(events: DataFrame, key: str, seconds: int) -> DataFrame:
    """Batch twin: the first event of a key and then the first at least ``seconds`` after the last one kept. Islands between long gaps are folded apart; a fold carries one time."""
    gap = seconds * 1_000_000

    def step(a: list, e: tuple) -> list[tuple]:
        if a[0] is None or (e[0] is not None and e[0] - a[0] >= gap):
            a[0] = e[0]
            return [(e[1],)]
        return []

    kind = StructType().add("event_id", events.schema["event_id"].dataType)
    return fold_sorted(islands(events, key, seconds), [key, "island"], ["t", "event_id"], lambda: [None], step, lambda a: [], kind).select(key, "event_id")


def dedupe_within_stream(events: DataFrame, key: str, seconds: int) -> DataFrame:
    """Stream form: state per key lives as long as the watermark says."""
    return events.withWatermark("ts", f"{seconds} seconds").dropDuplicatesWithinWatermark([key])


def offline_alerts(probes: DataFrame, priority: tuple) -> DataFrame:
    """An alert for each failed probe of a source of priority: ``kind`` (one a source), ``ts``, ``event_id``, ``props``."""
    return probes.where(F.col("indexer").isin(*priority) & ~F.col("ok")).select(F.concat(F.lit("offline:"), F.col("indexer").cast("string")).alias("kind"), "ts", "event_id", "props")


def occupancy_alerts(samples: DataFrame, limit: float) -> DataFrame:
    """An alert for each sample of an account's occupancy (``used``) that reaches the limit."""
    return samples.where(F.col("used") >= limit).select(F.lit("occupancy").alias("kind"), "ts", "event_id", "props")


def alert_cooldown(alerts: DataFrame, cooldown_s: int) -> DataFrame:
    """One alert per kind and cooldown, without secrets among its fields."""
    kept = dedupe_within_fold(alerts, "kind", cooldown_s)
    fields = F.map_filter(F.from_json("props", "map<string,string>"), lambda k, _: ~F.lower(k).rlike("key|token|secret|password"))
    return alerts.join(kept.select("kind", "event_id"), ["kind", "event_id"], "left_semi").select("event_id", "kind", F.coalesce(F.to_json(fields), F.lit("{}")).alias("fields"))


def budget_tumbling(events: DataFrame, cap: int) -> DataFrame:
    """Use per clock hour against a cap; the same expression in batch and stream."""
    return events.groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("used")).select(F.col("w.start").alias("hour"), "used", (F.col("used") > cap).alias("is_over"))


def sliding_rate(events: DataFrame) -> DataFrame:
    return events.groupBy("user_id", F.window("ts", "1 hour", "5 minutes").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("started"), "n")


def admission_fold(events: DataFrame, key: str, cap: int, seconds: int) -> DataFrame:
    """Batch twin: an event is admitted if fewer than ``cap`` were admitted in the ``seconds`` before; what was refused does not count. The fold carries the last ``cap`` admissions."""

    def step(last: list, e: tuple) -> list[tuple]:
        t, i = e
        last[:] = [x for x in last if x is not None and t is not None and x > t - seconds * 1_000_000]
        if len(last) >= cap:
            return []
        last.append(t)
        return [(i,)]

    kind = StructType().add("event_id", events.schema["event_id"].dataType)
    rows = events.select(key, F.unix_micros("ts").alias("t"), "event_id")
    return fold_sorted(rows, [key], ["t", "event_id"], list, step, lambda a: [], kind)


def admission_stream(events: DataFrame, key: str, cap: int, seconds: int) -> DataFrame:
    """Stream form of ``admission_fold``: admitted events as they come; state is the last ``cap`` admissions of a key."""

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, out = list(state.get[0]) if state.exists else [], []
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for t, i in zip(rows["ts"].astype("datetime64[us]").astype("int64"), rows["event_id"]):
            last = [x for x in last if x > t - seconds * 1_000_000]
            if len(last) < cap:
                last.append(int(t))
                out.append(int(i))
        state.update((last,))
        state.setTimeoutTimestamp(max((last[-1] if last else 0) // 1000 + seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [k[0]] * len(out), "event_id": pd.Series(out, dtype="int64")})

    kept = events.withWatermark("ts", WATERMARK)
    return kept.groupBy(key).applyInPandasWithState(run, f"{key} long, event_id long", "last array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def idle_sessions(events: DataFrame, gap: str) -> DataFrame:
    """Stretches without any activity of at least ``gap``, from the end of one session to the start of the next."""
    s = events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    s = s.select("user_id", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")
    return s.withColumn("idle_s", (F.unix_timestamp(F.lead("started").over(W.partitionBy("user_id").orderBy("started"))) - F.unix_timestamp("ended")).cast("long"))


def collect_within_budget(arrivals: DataFrame, budget_s: int, grace_s: int, needs_rows: bool = False) -> DataFrame:
    """What of each request's arrivals is used, with ``why`` the collection ended.

    It ends with the last arrival (``done``), one for which ``stops`` holds (``stopped``), or the budget. At the budget it
    goes on if nothing of priority has come, some task of priority (``task_priority``) is still out and, with
    ``needs_rows``, anything has come at all: until the first of priority (``priority``), the last task of priority
    (``priority done``), an end as above, or the end of the grace. Times count from the request's first arrival.

    ``arrivals`` has ``request``, ``arrived_at``, ``priority``, ``task_priority``, ``stops``, ``n`` (rows that came with it).
    """
    w, us = W.partitionBy("request"), F.col("us")
    df = arrivals.withColumn("us", F.unix_micros("arrived_at") - F.unix_micros(F.min("arrived_at").over(w)))
    budget, grace = F.lit(budget_s * 1_000_000), F.lit((budget_s + grace_s) * 1_000_000)
    first = lambda c: F.min(F.when(c, us)).over(w)
    df = df.withColumns({"end": F.max(us).over(w), "halt": first(F.col("stops"))})
    df = df.withColumn("cut", F.least("end", "halt", budget))
    inside = us <= F.col("cut")
    seen, rows = F.max(F.when(inside, F.col("priority"))).over(w), F.sum(F.when(inside, F.col("n"))).over(w)
    last_task = F.max(F.when(F.col("task_priority"), us)).over(w)
    more = (F.col("cut") < F.col("end")) & F.coalesce(F.col("halt") > F.col("cut"), F.lit(True)) & ~F.coalesce(seen, F.lit(False)) & F.coalesce(last_task > F.col("cut"), F.lit(False))
    if needs_rows:
        more = more & (F.coalesce(rows, F.lit(0)) > 0)
    wanted = first(F.col("priority") & (us > F.col("cut")))
    df = df.withColumns({"more": more & F.lit(grace_s > 0), "wanted": wanted, "last_task": last_task})
    until = F.when(F.col("more"), F.least("end", "halt", "wanted", "last_task", grace)).otherwise(F.col("cut"))
    why = F.when(F.col("until") == F.col("halt"), "stopped").when(F.col("until") == F.col("end"), "done").when(F.col("more") & (F.col("until") == F.col("wanted")), "priority").when(F.col("more") & (F.col("until") == F.col("last_task")), "priority done").when(F.col("more"), "grace").otherwise("budget")
    return df.withColumn("until", until).withColumn("why", why).where("us <= until").select(*arrivals.columns, "why")


LATEST = StructType().add("phase", "long").add("revision", "long").add("useful_phase", "long").add("value", "double").add("commits", "long")


def latest_writer_step(a: list, p: int | None, r: int | None, good: bool | None, v: float | None) -> None:
    """One update of ``a`` (phase, revision, phase of the latest useful commit, value, commits): one of the current or a later (phase, revision) commits; one of an older phase does if it is useful and nothing useful of its phase or a later one has been committed."""
    phase, revision, useful, _, commits = a
    newer = p is not None and r is not None and (p > phase or (p == phase and r >= revision))
    rescue = p is not None and p < phase and good is True and useful < p
    if newer or rescue:
        a[:] = max(phase, p), r if newer else revision, max(useful, p) if good is True else useful, v, commits + 1


def latest_writer_fold(updates: DataFrame) -> DataFrame:
    """Batch twin: updates in order of arrival, a left fold along one key's that carries five numbers. Phases and revisions count from 0."""

    def step(a: list, u: tuple) -> list[tuple]:
        latest_writer_step(a, *u[1:])
        return []

    rows = updates.select("key", "seq", "phase", "revision", "useful", F.col("value").cast("double"))
    return fold_sorted(rows, ["key"], ["seq", "phase", "revision", "useful", "value"], lambda: [-1, -1, -1, None, 0], step, lambda a: [tuple(a)], LATEST)


def partial_to_complete(results: DataFrame, short_s: int, full_s: int, order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """The state of every stored result: its growth over earlier ones re-emits it, completeness promotes it, and its time to live follows."""
    w = W.partitionBy("request").orderBy(*order)
    before = F.max("n").over(w.rowsBetween(W.unboundedPreceding, -1))
    grew = F.coalesce(F.col("n") > before, F.lit(True))
    df = results.withColumns({"grew": grew, "ttl_s": F.when(F.col("partial") | F.col("n").isNull(), short_s).otherwise(full_s).cast("long")})
    return df.withColumn("action", F.when(F.col("grew"), "emit").when(~F.col("partial"), "promote").otherwise("keep"))


def staleness(kv: DataFrame, now: str, grace_s: int) -> DataFrame:
    left = F.unix_micros("expires_at") - F.unix_micros(F.lit(now).cast("timestamp"))
    state = F.when(left > 0, "fresh").when((left > -grace_s * 1_000_000) & F.col("complete"), "stale").otherwise("expired")
    return kv.withColumn("state", state)


def recheck_outcome(obs: DataFrame, dead_after: int, stalled_after: int, expire_s: int) -> DataFrame:
    """Per item the first final outcome: ready, dead or stalled after so many sightings of that kind since the last movement, expired by age otherwise.

    Both counters live side by side; only a movement sets them to 0. ``n`` counts all sightings of the item.
    """
    w = W.partitionBy("item").orderBy("ts", "event_id")
    df = obs.withColumn("since", F.count_if(F.col("seen") == "moving").over(w.rowsBetween(W.unboundedPreceding, 0)))
    df = df.withColumn("age", F.unix_micros("ts") - F.unix_micros(F.first("ts").over(w)))
    run = lambda k: F.count_if(F.col("seen") == k).over(W.partitionBy("item", "since").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0))
    df = df.withColumns({"dead": run("dead"), "still": run("still")})
    said = lambda k, n: (F.col("seen") == k) & (F.col(k) >= n)
    out = F.when(F.col("seen") == "ready", "ready").when(said("dead", dead_after), "dead").when(said("still", stalled_after), "stalled").when(F.col("age") >= expire_s * 1_000_000, "expired")
    done = df.withColumn("outcome", out).groupBy("item").agg(F.min_by("outcome", F.when(F.col("outcome").isNotNull(), F.struct("ts", "event_id"))).alias("outcome"), F.count("*").alias("n"))
    return done.select("item", F.coalesce("outcome", F.lit("pending")).alias("outcome"), "n")


def queue_feed(events: DataFrame, index: DataFrame) -> DataFrame:
    """Work items from misses and gaps; the index is a static side of the join. Works on streams and tables."""
    reason = F.when(F.col("event_type") == "error", "gap").when(F.col("event_type") == "view", "next-episode").otherwise("miss")
    return events.select(F.col("user_id").alias("work_id"), "ts", reason.alias("reason")).join(index.select("work_id", F.lit(True).alias("indexed")).distinct(), "work_id", "left").where("indexed is null or reason = 'next-episode'").select("work_id", "ts", "reason")


def coverage_days(events: DataFrame) -> DataFrame:
    """``taken``, ``share`` (of hits among decided events) and ``decided`` per day; works on streams and tables."""
    per = events.groupBy(F.window("ts", "1 day").alias("w")).agg(F.count_if(F.col("event_type") == "view").alias("hits"), F.count_if(F.col("event_type").isin("view", "purchase")).alias("decided"))
    share = F.when(F.col("decided") == 0, 0.0).otherwise(F.col("hits") / F.nullif(F.col("decided"), F.lit(0)))
    return per.select(F.col("w.start").alias("taken"), F.round(share, 6).alias("share"), "decided")


def coverage_over_time(events: DataFrame, lapse_s: int) -> DataFrame:
    """Coverage per day with its gain over the first day of its cohort; a cohort lapses after ``lapse_s`` without a decided event, and the baseline starts anew."""
    return with_baseline(coverage_days(events), lapse_s)


def with_baseline(samples: DataFrame, lapse_s: int) -> DataFrame:
    """``baseline`` (the first share of a cohort), ``gain`` and ``reset`` of samples (``taken``, ``share``, ``decided``). Samples in which nothing was decided are none. The window runs over one row a day."""
    w = W.orderBy("taken")
    gap = F.unix_micros("taken") - F.unix_micros(F.lag("taken").over(w)) > lapse_s * 1_000_000
    known = samples.where("decided > 0").withColumn("reset", F.coalesce(gap, F.lit(True)))
    known = known.withColumn("cohort", F.sum(F.col("reset").cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    known = known.withColumn("baseline", F.first("share").over(W.partitionBy("cohort").orderBy("taken")))
    return known.withColumn("gain", F.round(F.col("share") - F.col("baseline"), 6)).drop("cohort")


def retry_requeue(attempts: DataFrame, tries: int) -> DataFrame:
    """What happens after an attempt: done, front of the queue if only capped, back if it failed, dropped after so many failures."""
    w = W.partitionBy("work").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    fails = F.sum((F.col("result") == "failed").cast("int")).over(w)
    return attempts.withColumn("fails", fails.cast("long")).withColumn("to", F.when(F.col("result") == "ok", "done").when(F.col("result") == "capped", "front").when(F.col("fails") >= tries, "dropped").otherwise("back"))
