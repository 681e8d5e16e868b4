"""Keyed stream processors that see each key's rows in order of event time, whatever order they arrive in.

Rows wait in the state until the watermark has passed them and are then stepped through in order, so a stream gives what
its batch twin gives of the rows up to the watermark. They need the RocksDB state store (``with_state_store``).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_state_store(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return spark


class Ordered(StatefulProcessor):
    """Steps through a key's rows by (time, ``rank`` of the row, id) once the watermark has passed them.

    State of a key: a map of the rows that wait (those of the watermark's delay), and one value that ``step`` replaces.
    ``expires`` names the next moment at which the value changes by itself; ``expired`` then tells it, in its turn between
    the rows. One timer a key stands for the next row or expiry. Rows have ``t`` (microseconds), ``id`` (long) and the
    columns of ``fields``; emitted are ``seq``, which numbers what is told of a key, and the columns of ``result``.
    """

    fields: StructType
    value: StructType
    result: StructType
    fresh: tuple
    keys: list[str]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", StructType().add("t", "long").add("id", "long"), self.fields)
        # what is told, until when, how much of it, and the next timer (milliseconds; 0: none)
        self.kept = handle.getValueState("kept", StructType().add("told", "long").add("seq", "long").add("timer", "long").add("value", self.value))

    def rank(self, row: tuple) -> int:
        """Order of rows of the same time."""
        return 0

    def step(self, value: tuple, t: int, i: int, row: tuple) -> tuple[tuple, list[tuple]]:
        """The value after a row, and what is told of it."""
        raise NotImplementedError

    def expires(self, value: tuple, t: int) -> int | None:
        """The first moment (microseconds) after ``t`` at which the value alone changes what is told of the key."""
        return None

    def expired(self, value: tuple, t: int) -> list[tuple]:
        return []

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        first = None
        for r in rows:
            self.waiting.updateValue((r["t"], r["id"]), tuple(r[f] for f in self.fields.names))
            first = r["t"] if first is None else min(first, r["t"])
        told, seq, timer, value = self._state()
        self._keep(told, seq, timer, value, first)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        ms = expiredTimerInfo.getExpiryTimeInMs()
        told, seq, timer, value = self._state()
        if ms != timer:  # an earlier one took its place
            return
        until = max(ms, timerValues.getCurrentWatermarkInMs()) * 1000
        waiting = [(k[0], self.rank(tuple(v)), k[1], tuple(v)) for k, v in self.waiting.iterator()]
        out: list[tuple] = []
        for t, _, i, row in sorted(r[:3] + (r[3],) for r in waiting if r[0] <= until):
            while (end := self.expires(value, told)) is not None and end < t:
                told, out = end, out + self.expired(value, end)
            value, got = self.step(value, t, i, row)
            told, out = t, out + got
            self.waiting.removeKey((t, i))
        while (end := self.expires(value, told)) is not None and end <= until:
            told, out = end, out + self.expired(value, end)
        left = [r[0] for r in waiting if r[0] > until] + [end for end in (self.expires(value, told),) if end is not None]
        self._keep(told, seq + len(out), 0, value, min(left, default=None))
        for n, r in enumerate(out):
            yield Row(**dict(zip([*self.keys, "seq", *self.result.names], [*key, seq + n, *r])))

    def _state(self) -> tuple[int, int, int, tuple]:
        if not self.kept.exists():
            return -(1 << 62), 0, 0, self.fresh
        told, seq, timer, value = self.kept.get()
        return told, seq, timer, tuple(value)

    def _keep(self, told: int, seq: int, timer: int, value: tuple, t: int | None) -> None:
        """Writes the state, with a timer at the first millisecond not before ``t`` if none is earlier."""
        ms = 0 if t is None else -(-t // 1000)
        if ms and (not timer or ms < timer):
            if timer:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(ms)
            timer = ms
        self.kept.update((told, seq, timer, value))

    def close(self) -> None:
        pass


def ordered(rows: DataFrame, processor: Ordered, keys: list[str], at: str, i: str, delay: str) -> DataFrame:
    """Runs a processor over a stream: ``at`` is the time column, ``i`` a number that is unique within the key. Rows later than ``delay`` are dropped."""
    fields, processor.keys = processor.fields.names, keys
    kept = rows.withWatermark(at, delay).select(*keys, at, F.unix_micros(at).alias("t"), F.col(i).cast("long").alias("id"), *[f for f in fields if f not in keys])
    schema = StructType([rows.schema[k] for k in keys] + StructType().add("seq", "long").fields + processor.result.fields)
    return kept.groupBy(*keys).transformWithState(processor, schema, "Append", "EventTime")


# --- evidence ---------------------------------------------------------------------------------------------------


class Evidence(Ordered):
    """What is known of a hash: alive, bad, and whether it was hit, missed or is blocked, each with its own expiry.

    Bad takes alive away, whatever is left of it; a hit or miss takes the place of the one before; blocked outdoes both
    while it lasts. Of misses in a row, without a hit between and none of them expired before the next, ``misses`` tells
    the number. The value is emitted after each row and whenever something expires.
    """

    fields = StructType().add("kind", "string").add("ttl_s", "long")
    value = StructType().add("alive", "long").add("bad", "long").add("blocked", "long").add("verdict", "string").add("until", "long").add("misses", "long")
    result = StructType().add("at", "long").add("alive", "boolean").add("bad", "boolean").add("state", "string").add("misses", "long")
    fresh = (0, 0, 0, None, 0, 0)

    def rank(self, row: tuple) -> int:
        return {"alive": 0, "bad": 1, "miss": 0, "hit": 1}.get(row[0], 0)

    def step(self, value: tuple, t: int, i: int, row: tuple) -> tuple[tuple, list[tuple]]:
        alive, bad, blocked, verdict, until, misses = value
        kind, end = row[0], t + row[1] * 1_000_000
        if kind == "alive":
            alive = end
        elif kind == "bad":
            alive, bad = 0, end
        elif kind == "blocked":
            blocked = end
        else:
            misses = 0 if kind == "hit" else misses + 1 if verdict == "miss" and until > t else 1
            verdict, until = kind, end
        value = (alive, bad, blocked, verdict, until, misses)
        return value, self.expired(value, t)

    def expires(self, value: tuple, t: int) -> int | None:
        return min((x for x in (*value[:3], value[4]) if x > t), default=None)

    def expired(self, value: tuple, t: int) -> list[tuple]:
        alive, bad, blocked, verdict, until, misses = value
        state = "blocked" if blocked > t else verdict if until > t else None
        return [(t, alive > t, bad > t, state, misses if state == "miss" else 0)]


def evidence_stream(ev: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Stream form of ``evidence_state``: ``scope``, ``hash``, ``at`` (microseconds), ``alive``, ``bad``, ``state`` and ``misses``; a key's last row holds until the next."""
    return ordered(ev, Evidence(), ["scope", "hash"], "seen_at", "event_id", delay)


# --- sources ----------------------------------------------------------------------------------------------------


class Health(Ordered):
    """The last state of a source and its run of failures, which a success or a gap over ``ttl_s`` ends; the breaker is open while the run has ``trip`` failures and the last is younger than ``cooldown_s``."""

    fields = StructType().add("ok", "boolean").add("ms", "double").add("budget_ms", "double")
    value = StructType().add("last", "long").add("streak", "long").add("state", "string")
    result = StructType().add("at", "long").add("state", "string").add("streak", "long").add("is_open", "boolean")
    fresh = (None, 0, None)

    def __init__(self, ttl_s: int, trip: int, cooldown_s: int):
        self.ttl, self.trip, self.cooldown = ttl_s * 1_000_000, trip, cooldown_s * 1_000_000

    def step(self, value: tuple, t: int, i: int, row: tuple) -> tuple[tuple, list[tuple]]:
        last, streak, _ = value
        ok, ms, budget = row
        late = last is None or t - last > self.ttl
        if ok:
            state, streak = "degraded" if ms > budget else "slow" if ms * 2 > budget else "online", 0
        else:
            state, streak = "offline", 1 if late else streak + 1
        value = (t, streak, state)
        return value, self.expired(value, t)

    def expires(self, value: tuple, t: int) -> int | None:
        last, streak, _ = value
        end = None if last is None or streak < self.trip else last + self.cooldown
        return end if end is not None and end > t else None

    def expired(self, value: tuple, t: int) -> list[tuple]:
        last, streak, state = value
        return [(t, state, streak, streak >= self.trip and t - last < self.cooldown)]


def health_stream(probes: DataFrame, ttl_s: int, trip: int, cooldown_s: int, delay: str = "10 minutes") -> DataFrame:
    """Stream form of ``source_health``: a row after each probe, and one when an open breaker closes."""
    typed = probes.withColumns({"ms": F.col("ms").cast("double"), "budget_ms": F.col("budget_ms").cast("double")})
    return ordered(typed, Health(ttl_s, trip, cooldown_s), ["indexer"], "ts", "event_id", delay)


# --- rechecks and retries ---------------------------------------------------------------------------------------


class Recheck(Ordered):
    """Sightings of an item up to its first final outcome: ready, dead or stalled after so many sightings of that kind, expired by age.

    Both counters live side by side; only a movement sets them to 0. After the outcome the item's state tells no more.
    """

    fields = StructType().add("seen", "string")
    value = StructType().add("first", "long").add("dead", "long").add("still", "long").add("outcome", "string")
    result = StructType().add("at", "long").add("outcome", "string")
    fresh = (None, 0, 0, None)

    def __init__(self, dead_after: int, stalled_after: int, expire_s: int):
        self.dead, self.stalled, self.expire = dead_after, stalled_after, expire_s * 1_000_000

    def step(self, value: tuple, t: int, i: int, row: tuple) -> tuple[tuple, list[tuple]]:
        first, dead, still, outcome = value
        if outcome is not None:
            return value, []
        first, seen = t if first is None else first, row[0]
        if seen == "moving":
            dead = still = 0
        dead, still = dead + (seen == "dead"), still + (seen == "still")
        if seen == "ready":
            outcome = "ready"
        elif seen == "dead" and dead >= self.dead:
            outcome = "dead"
        elif seen == "still" and still >= self.stalled:
            outcome = "stalled"
        elif t - first >= self.expire:
            outcome = "expired"
        return (first, dead, still, outcome), [(t, outcome)] if outcome else []


def recheck_stream(obs: DataFrame, dead_after: int, stalled_after: int, expire_s: int, delay: str = "10 minutes") -> DataFrame:
    """Stream form of ``recheck_outcome``: one row an item, at its first final outcome."""
    return ordered(obs, Recheck(dead_after, stalled_after, expire_s), ["item"], "ts", "event_id", delay)


class Retry(Ordered):
    """Attempts of a work: done, front of the queue if only capped, back if it failed, dropped after so many failures."""

    fields = StructType().add("result", "string")
    value = StructType().add("fails", "long")
    result = StructType().add("event_id", "long").add("fails", "long").add("to", "string")
    fresh = (0,)

    def __init__(self, tries: int):
        self.tries = tries

    def step(self, value: tuple, t: int, i: int, row: tuple) -> tuple[tuple, list[tuple]]:
        fails = value[0] + (row[0] == "failed")
        to = "done" if row[0] == "ok" else "front" if row[0] == "capped" else "dropped" if fails >= self.tries else "back"
        return (fails,), [(i, fails, to)]


def retry_stream(attempts: DataFrame, tries: int, delay: str = "10 minutes") -> DataFrame:
    """Stream form of ``retry_requeue``: a row for each attempt."""
    return ordered(attempts, Retry(tries), ["work"], "ts", "event_id", delay)
