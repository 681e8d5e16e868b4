"""Folds and stream forms against plain Python on whole groups."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sievewright.operators import maintenance as M
from sievewright.operators import ranking as R
from sievewright.sources.relations import evidence, listings, read, snapshot
from sievewright.streaming import state as S

DATA = "/root/testdata/sf0.001"


def test_limit_joint(spark):
    ranked = R.rank_candidates(listings(spark, DATA)).cache()
    caps = {"2160p": 3, "1080p": 4, "720p": 0}
    got = {(r.request_id, r.rn) for r in R.limit_joint(ranked, caps, 2).select("request_id", "rn").collect()}
    want, groups = set(), defaultdict(list)
    for r in ranked.select("request_id", "rn", "quality", "indexer").collect():
        groups[r.request_id].append(r)
    for k, rows in groups.items():
        q, s = defaultdict(int), defaultdict(int)
        for r in sorted(rows, key=lambda r: r.rn):
            if q[r.quality] < caps.get(r.quality, 100) and s[r.indexer] < 2:
                q[r.quality] += 1
                s[r.indexer] += 1
                want.add((k, r.rn))
    assert got == want


def test_near_clusters_do_not_chain(spark):
    rows = [(1, 0, "a", 1000, "Ready", True, False), (2, 0, "a", 1004, "Ready", True, False), (3, 0, "a", 1008, "Ready", True, False), (4, 0, "a", 0, "Ready", True, False), (5, 0, "b", 1000, "Ready", True, False)]
    df = spark.createDataFrame(rows, "service_id long, account long, name string, size long, status string, ready boolean, protected boolean").withColumn("uploaded_at", F.timestamp_seconds("service_id"))
    assert [(r.service_id, r.keep_id) for r in M.plan_dedup_near(df).collect()] == [(2, 1)]


def events_of(spark):
    return read(spark, DATA, "events")


def test_miss_backoff_fold(spark):
    ev = evidence(spark, DATA)
    got = {r.hash: r.misses for r in S.miss_backoff_fold(ev).collect()}
    runs = defaultdict(lambda: [0, 0])
    for r in ev.where("kind in ('hit', 'miss')").select("hash", F.unix_micros("seen_at").alias("t"), "event_id", "kind").orderBy("t", "event_id").collect():
        n, until = runs[r.hash]
        n = 0 if r.kind == "hit" else 1 if r.t >= until else n + 1
        runs[r.hash] = [n, r.t + S.LADDER[min(n, 4) - 1] * 1_000_000 if n else 0]
    assert got == {k: v[0] for k, v in runs.items()}


def test_admission_fold(spark):
    got = {(r.user_id, r.event_id) for r in S.admission_fold(events_of(spark), "user_id", 2, 86400).collect()}
    want, last = set(), defaultdict(list)
    for r in events_of(spark).select("user_id", "event_id", F.unix_micros("ts").alias("t")).orderBy("t", "event_id").collect():
        last[r.user_id] = [t for t in last[r.user_id] if t > r.t - 86400 * 1_000_000]
        if len(last[r.user_id]) < 2:
            last[r.user_id].append(r.t)
            want.add((r.user_id, r.event_id))
    assert got == want


def test_dedupe_within_fold(spark):
    got = {(r.user_id, r.event_id) for r in S.dedupe_within_fold(events_of(spark), "user_id", 43200).collect()}
    want, last = set(), {}
    for r in events_of(spark).select("user_id", "event_id", F.unix_micros("ts").alias("t")).orderBy("t", "event_id").collect():
        if r.user_id not in last or r.t - last[r.user_id] >= 43200 * 1_000_000:
            last[r.user_id] = r.t
            want.add((r.user_id, r.event_id))
    assert got == want


def test_latest_writer(spark):
    rows = [("a", 1, 1, 1, False, 1.0), ("a", 2, 0, 9, True, 2.0), ("a", 3, 0, 9, True, 3.0), ("a", 4, 1, 0, True, 4.0), ("a", 5, 2, 0, False, 5.0)]
    df = spark.createDataFrame(rows, "key string, seq long, phase long, revision long, useful boolean, value double")
    r = S.latest_writer_fold(df).first()
    assert (r.phase, r.revision, r.useful_phase, r.value, r.commits) == (2, 0, 0, 5.0, 3)


@pytest.mark.parametrize("form", ["admission", "backoff", "window"])
def test_stream_forms(spark, tmp_path, form):
    """One file a trigger in order of time; the stream's rows are those of the batch twin."""
    src = events_of(spark).orderBy("ts", "event_id")
    n = src.count()
    rows = src.withColumn("ix", F.row_number().over(S.W.orderBy("ts", "event_id")))
    for k in range(3):
        rows.where(f"ix > {k * n // 3} and ix <= {(k + 1) * n // 3}").drop("ix").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).option("maxFilesPerTrigger", 10).parquet(str(tmp_path / "in"))
    if form == "admission":
        out, mode, want = S.admission_stream(stream, "user_id", 2, 86400), "append", S.admission_fold(src, "user_id", 2, 86400)
    elif form == "backoff":
        prep = lambda d: d.select(F.sha1(F.col("user_id").cast("string").cast("binary")).alias("hash"), F.expr("CASE event_type WHEN 'view' THEN 'hit' ELSE 'miss' END").alias("kind"), F.col("ts").alias("seen_at"), "event_id")
        out, mode, want = S.miss_backoff_stream(prep(stream)), "update", S.miss_backoff_fold(prep(src)).select("hash", "misses")
    else:
        out, mode, want = S.budget_tumbling(stream.withWatermark("ts", S.WATERMARK), 15), "complete", S.budget_tumbling(src, 15)
    name = f"t_{form}"
    q = out.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table(name)
    if form == "backoff":
        assert got.select("hash").distinct().count() == want.count()
    else:
        assert got.exceptAll(want.select(got.columns)).isEmpty() and want.select(got.columns).exceptAll(got).isEmpty()


def test_top_k_is_monotone(spark):
    ranked = R.rank_candidates(listings(spark, DATA))
    small, large = (R.limit_reserving(ranked, k, 0).select("lid", "rn") for k in (5, 9))
    assert small.exceptAll(large).isEmpty()


def test_partitioning_does_not_matter(spark):
    df = snapshot(spark, DATA)
    a, b = M.plan_dedup_exact(df.repartition(1)), M.plan_dedup_exact(df.repartition(8))
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_index_record_is_idempotent(spark):
    li = listings(spark, DATA)
    once = M.index_record(li.where("indexer % 2 = 0"), li.where("indexer % 2 = 1"))
    keep = once.withColumns({"multi_work": F.lit(False)})
    again = M.index_record(once, keep)
    assert again.exceptAll(once.select(again.columns)).isEmpty()
