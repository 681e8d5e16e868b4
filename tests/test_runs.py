"""Tables of last writes: one version a reader, bounded runs, replays that change nothing; and the streams that write them."""

import random

import pytest
from pyspark.sql import functions as F

from sievewright.sources import runs
from sievewright.sources import sinks as K
from sievewright.sources.relations import read
from sievewright.streaming import state as S
from sievewright.streaming import writers as Wr

DATA = "/root/testdata/sf0.001"


def batch(spark, rows):
    return spark.createDataFrame([(k, float(v), s, s, s) for k, v, s in rows], "key string, value double, e long, u long, seq long").select("key", "value", F.timestamp_seconds("e").alias("expires_at"), F.timestamp_seconds("u").alias("used_at"), "seq")


def test_runs_are_merged_and_replays_change_nothing(spark, tmp_path):
    rng, want, table = random.Random(2), {}, K.kv_table(spark, str(tmp_path / "t"))
    assert table.read().count() == 0
    for number in range(20):
        rows = [(f"k{rng.randrange(30)}", rng.random(), number * 100 + i) for i in range(15)]
        assert table.merge(batch(spark, rows), number)
        want |= {k: v for k, v, _ in rows}
        before = table.manifest()
        assert not table.merge(batch(spark, [("k1", -1.0, 10**6)]), number) and table.manifest() == before
        assert len(before.runs) <= (table.fan - 1) * 3
    assert {r.key: r.value for r in table.read().collect()} == want
    # what no kept manifest names is gone, so files do not pile up
    folders = list((tmp_path / "t" / "runs").iterdir())
    assert len(folders) <= runs.KEPT * (table.fan - 1) * 3 and len(table.versions()) == runs.KEPT
    files = [f for d in folders for f in d.glob("*.parquet")]
    assert len(files) <= len(folders) * runs.BUCKETS


def test_a_reader_sees_one_version(spark, tmp_path):
    table = K.kv_table(spark, str(tmp_path / "t"))
    table.merge(batch(spark, [("a", 1, 1), ("b", 2, 2)]), 0)
    old = table.read()
    table.merge(batch(spark, [("a", 3, 3)]), 1)
    table.merge(batch(spark, [("c", 4, 4)]), 2)
    assert {r.key: r.value for r in old.collect()} == {"a": 1.0, "b": 2.0}
    assert {r.key: r.value for r in table.read(table.versions()[0]).collect()} == {"a": 1.0, "b": 2.0}
    assert {r.key: r.value for r in table.read().collect()} == {"a": 3.0, "b": 2.0, "c": 4.0}


def test_an_overtaken_writer_fails(spark, tmp_path):
    table = K.kv_table(spark, str(tmp_path / "t"))
    table.merge(batch(spark, [("a", 1, 1)]), 0)
    with pytest.raises(RuntimeError, match="another"):
        table._swap(runs.Manifest(1, 7, []))
    assert table.manifest().batch == 0


def test_an_older_write_that_comes_late_loses(spark, tmp_path):
    table = K.kv_table(spark, str(tmp_path / "t"))
    table.merge(batch(spark, [("a", 1, 50)]), 0)
    table.merge(batch(spark, [("a", 2, 40), ("b", 3, 1)]), 1)
    assert {r.key: r.value for r in table.read().collect()} == {"a": 1.0, "b": 3.0}


def in_files(spark, df, order, path, n=4):
    """Files of a table in order of arrival; returns their names and the schema."""
    rows = sorted(df.collect(), key=order)
    for k in range(n):
        spark.createDataFrame(rows[k * len(rows) // n : (k + 1) * len(rows) // n], df.schema).coalesce(1).write.mode("append").parquet(str(path))
    return df.schema


def streamed(spark, schema, path):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(path))


def replayed(spark, table, rows):
    """A batch that a restart delivers again: the table stays as it is."""
    before = (table.manifest(), sorted(map(str, table.read().collect())))
    assert not table.merge(rows, before[0].batch)
    assert (table.manifest(), sorted(map(str, table.read().collect()))) == before


def test_latest_writer_stream(spark, tmp_path):
    e = read(spark, DATA, "events")
    u = e.select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), (F.floor("value").cast("long") % 3).alias("phase"), (F.col("event_id") % 5).alias("revision"), (F.col("event_type") != "error").alias("useful"), "value")
    schema = in_files(spark, u, lambda r: r.seq, tmp_path / "in")
    q = Wr.latest_writer_stream(streamed(spark, schema, tmp_path / "in"), str(tmp_path / "t"), str(tmp_path / "cp"))
    q.awaitTermination()
    table = Wr.latest_writer_table(spark, str(tmp_path / "t"))
    got, want = table.read().drop("updates"), S.latest_writer_fold(u)
    assert got.exceptAll(want.select(got.columns)).isEmpty() and want.select(got.columns).exceptAll(got).isEmpty() and table.manifest().version == 4
    replayed(spark, table, Wr.latest_writes(u, table))
    # nothing new to read after a restart from the checkpoint
    Wr.latest_writer_stream(streamed(spark, schema, tmp_path / "in"), str(tmp_path / "t"), str(tmp_path / "cp")).awaitTermination()
    assert table.manifest().version == 4


def test_late_phases_rescue_only_without_newer_use(spark, tmp_path):
    table = Wr.latest_writer_table(spark, str(tmp_path / "t"))
    u = lambda *rows: spark.createDataFrame(rows, "key long, seq long, phase long, revision long, useful boolean, value double")
    state = lambda: [(r.phase, r.useful_phase, r.value) for r in table.read().collect()]
    table.merge(Wr.latest_writes(u((1, 1, 0, 1, True, 1.0)), table), 0)
    table.merge(Wr.latest_writes(u((1, 2, 2, 1, False, 2.0)), table), 1)
    assert state() == [(2, 0, 2.0)]  # the new phase came back empty
    table.merge(Wr.latest_writes(u((1, 3, 0, 9, True, 3.0), (1, 4, 1, 1, False, 4.0)), table), 2)
    assert state() == [(2, 0, 2.0)]  # phase 0 has had its useful commit, phase 1 is empty
    table.merge(Wr.latest_writes(u((1, 5, 1, 2, True, 5.0)), table), 3)
    assert state() == [(2, 1, 5.0)]  # a late phase rescues
    table.merge(Wr.latest_writes(u((1, 6, 2, 2, True, 6.0), (1, 7, 1, 3, True, 7.0)), table), 4)
    assert state() == [(2, 2, 6.0)]


def test_results_stream(spark, tmp_path):
    e = read(spark, DATA, "events")
    r = e.select(F.col("user_id").alias("request"), "ts", "event_id", (F.floor("value").cast("long") % 30).alias("n"), (F.col("event_type") == "error").alias("partial"))
    schema = in_files(spark, r, lambda x: (x.ts, x.event_id), tmp_path / "in")
    Wr.results_stream(streamed(spark, schema, tmp_path / "in"), str(tmp_path / "t"), str(tmp_path / "cp"), 60, 3600).awaitTermination()
    table = Wr.results_table(spark, str(tmp_path / "t"))
    told = S.partial_to_complete(r, 60, 3600)
    want = told.groupBy("request").agg(F.max_by("ttl_s", F.struct("ts", "event_id")).alias("ttl_s"), F.max("n").alias("n"), F.count_if(F.col("action") == "emit").alias("emitted"), F.count_if(F.col("action") == "promote").alias("promoted"), F.count("*").alias("seen"))
    got = table.read().select(want.columns)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    replayed(spark, table, Wr.merged_results(r, table, 60, 3600))


def test_coverage_stream(spark, tmp_path):
    """Days that are over become samples once; after two days without a request the baseline is a new one."""
    e = read(spark, DATA, "events").where("day(ts) not in (10, 11, 12)")
    schema = in_files(spark, e, lambda x: (x.ts, x.event_id), tmp_path / "in", 5)
    Wr.coverage_stream(streamed(spark, schema, tmp_path / "in"), str(tmp_path / "t"), str(tmp_path / "cp"), 2 * 86400, "1 hour").awaitTermination()
    got = Wr.coverage_samples(spark, str(tmp_path / "t")).read()
    want = S.coverage_over_time(e, 2 * 86400).select(got.columns)
    last = want.agg(F.max("taken")).first()[0]
    want = want.where(F.col("taken") < F.lit(last))  # the last day is not over
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty() and got.where("reset").count() == 2


def test_queue_feed_stream(spark, tmp_path):
    e, index = read(spark, DATA, "events"), read(spark, DATA, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("work_id"))
    schema = in_files(spark, e, lambda x: x.ts, tmp_path / "in")
    q = S.queue_feed(streamed(spark, schema, tmp_path / "in"), index).writeStream.format("memory").queryName("t_feed").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    got, want = spark.table("t_feed"), S.queue_feed(e, index)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty() and want.count() > 0
