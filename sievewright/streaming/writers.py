"""Streams whose result is a table of last writes: each batch is merged with what the table holds of its keys, once however often it is replayed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.folds import fold_sorted
from ..sources.runs import Runs, merged_stream
from .state import LATEST, coverage_days, latest_writer_step, partial_to_complete, with_baseline


def latest_writer_table(spark: SparkSession, path: str) -> Runs:
    """Committed values by ``key``; ``updates`` counts what was seen of a key and orders its writes."""
    return Runs(spark, path, StructType([*StructType().add("key", "long").fields, *LATEST.fields, *StructType().add("updates", "long").fields]), ["key"], ["updates"])


def latest_writes(updates: DataFrame, table: Runs) -> DataFrame:
    """The new state of every key of a batch of updates (``key``, ``seq``, ``phase``, ``revision``, ``useful``, ``value``): the table's state of the key, then the updates in order of arrival."""
    new = updates.select("key", F.lit(1).alias("part"), "seq", "phase", "revision", "useful", F.col("value").cast("double"), F.lit(None).cast("long").alias("useful_phase"), F.lit(None).cast("long").alias("commits"), F.lit(None).cast("long").alias("updates"))
    old = table.read().join(updates.select("key").distinct(), "key", "left_semi")
    old = old.select("key", F.lit(0).alias("part"), F.lit(None).cast("long").alias("seq"), "phase", "revision", F.lit(None).cast("boolean").alias("useful"), "value", "useful_phase", "commits", "updates")

    def step(a: list, u: tuple) -> list[tuple]:
        part, _, phase, revision, useful, value, useful_phase, commits, seen = u
        if part == 0:
            a[:] = [phase, revision, useful_phase, value, commits], seen
        else:
            latest_writer_step(a[0], phase, revision, useful, value)
            a[1] += 1
        return []

    fields = StructType([*LATEST.fields, *StructType().add("updates", "long").fields])
    order = ["part", "seq", "phase", "revision", "useful", "value"]
    return fold_sorted(old.unionByName(new), ["key"], order, lambda: [[-1, -1, -1, None, 0], 0], step, lambda a: [(*a[0], a[1])], fields)


def latest_writer_stream(updates: DataFrame, path: str, checkpoint: str):
    """Stream form of ``latest_writer_fold``, whose table it keeps: late updates of an older phase commit only if they are useful and nothing useful of their phase or a later one has been committed."""
    return merged_stream(updates, latest_writer_table(updates.sparkSession, path), checkpoint, latest_writes)


RESULTS = StructType().add("request", "long").add("ts", "timestamp").add("event_id", "long").add("n", "long").add("partial", "boolean").add("ttl_s", "long").add("emitted", "long").add("promoted", "long").add("seen", "long")


def results_table(spark: SparkSession, path: str) -> Runs:
    """Stored results by ``request``: the most rows so far, whether the collection goes on, the time to live, and how often it was emitted anew, promoted and seen."""
    return Runs(spark, path, RESULTS, ["request"], ["seen"])


def merged_results(results: DataFrame, table: Runs, short_s: int, full_s: int) -> DataFrame:
    """The stored result of every request of a batch (``request``, ``ts``, ``event_id``, ``n``, ``partial``): growth over what is stored emits it anew, completeness without growth promotes it, and its time to live follows."""
    old = table.read().join(results.select("request").distinct(), "request", "left_semi")
    # the stored result stands before the batch, whenever the batch's rows were made
    rows = old.select("request", F.lit(0).alias("part"), "ts", "event_id", "n", "partial").unionByName(results.select("request", F.lit(1).alias("part"), "ts", "event_id", "n", "partial"))
    told = partial_to_complete(rows, short_s, full_s, ["part", "ts", "event_id"]).where("part = 1")
    last = F.max_by(F.struct("ts", "event_id", "partial", "ttl_s"), F.struct("ts", "event_id")).alias("last")
    new = told.groupBy("request").agg(last, F.max("n").alias("most"), F.count_if(F.col("action") == "emit").alias("emits"), F.count_if(F.col("action") == "promote").alias("promotes"), F.count("*").alias("rows"))
    joined = new.join(old.select("request", F.col("n").alias("had"), "emitted", "promoted", "seen"), "request", "left")
    sum_ = lambda a, b: (F.coalesce(F.col(a), F.lit(0)) + F.col(b)).alias(a)
    return joined.select("request", "last.ts", "last.event_id", F.greatest("most", "had").alias("n"), "last.partial", "last.ttl_s", sum_("emitted", "emits"), sum_("promoted", "promotes"), sum_("seen", "rows"))


def results_stream(results: DataFrame, path: str, checkpoint: str, short_s: int, full_s: int):
    """Stream form of ``partial_to_complete``: the table of stored results that its actions leave."""
    return merged_stream(results, results_table(results.sparkSession, path), checkpoint, lambda b, t: merged_results(b, t, short_s, full_s))


def coverage_samples(spark: SparkSession, path: str) -> Runs:
    """Samples of coverage by ``taken``: the share, and the baseline and gain as of then."""
    return Runs(spark, path, StructType().add("taken", "timestamp").add("share", "double").add("decided", "long").add("baseline", "double").add("gain", "double").add("reset", "boolean"), ["taken"], ["decided"])


def coverage_stream(events: DataFrame, path: str, checkpoint: str, lapse_s: int, delay: str):
    """Stream form of ``coverage_over_time``: days that the watermark has closed are appended as samples, with the baseline of their cohort, which the table carries on."""
    def add(days: DataFrame, table: Runs) -> DataFrame:
        held = table.read().select("taken", "share", "decided")
        every = held.unionByName(days.join(held.select("taken"), "taken", "left_anti"))
        fresh = with_baseline(every, lapse_s).join(days.select("taken"), "taken", "left_semi")
        return fresh.select(*table.schema.names)

    days = coverage_days(events.withWatermark("ts", delay))
    return merged_stream(days, coverage_samples(events.sparkSession, path), checkpoint, add)
