"""Keyed processors on shuffled micro-batches with late rows, across a restart, against their batch twins."""

import random

import pytest
from pyspark.sql import functions as F

from sievewright.sources.relations import evidence, probes, read
from sievewright.streaming import processors as P
from sievewright.streaming import state as S

DATA = "/root/testdata/sf0.001"
DELAY = "3 days"


@pytest.fixture(scope="module")
def late(spark, tmp_path_factory):
    """The events in four files: in order of arrival, which is up to three days after their time."""
    rng, folder = random.Random(1), tmp_path_factory.mktemp("late")
    rows = sorted(read(spark, DATA, "events").collect(), key=lambda r: r.ts.timestamp() + rng.random() * 3 * 86400)
    schema = read(spark, DATA, "events").schema
    for k in range(4):
        part = rows[k * len(rows) // 4 : (k + 1) * len(rows) // 4]
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(folder / f"{k}"))
    return folder, schema


def run(spark, late, tmp_path, make, watermark=True):
    """Streams the first two files, stops, and goes on from the checkpoint with the others; returns what was emitted, and the watermark at the end."""
    folder, schema = late
    source = tmp_path / "in"
    source.mkdir()
    P.with_state_store(spark)
    for ks in ((0, 1), (2, 3)):
        for k in ks:
            for f in (folder / str(k)).glob("*.parquet"):
                (source / f"{k}-{f.name}").write_bytes(f.read_bytes())
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
        q = make(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    mark = [p["eventTime"]["watermark"] for p in q.recentProgress if "watermark" in p["eventTime"]][-1]
    return spark.read.parquet(str(tmp_path / "out")), mark.rstrip("Z").replace("T", " ")


def same(a, b):
    b = b.select(a.columns)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def rows_of(df, make):
    """The relation that a function of relations makes of this stream or table of events."""

    class Reader:
        def parquet(self, _):
            return df

    class Session:
        read = Reader()

    return make(Session(), "")


def test_evidence_stream(spark, late, tmp_path):
    got, mark = run(spark, late, tmp_path, lambda s: P.evidence_stream(rows_of(s, evidence), DELAY))
    last = got.groupBy("scope", "hash").agg(F.max_by(F.struct("alive", "bad", "state"), "seq").alias("x")).select("scope", "hash", "x.*")
    seen = evidence(spark, DATA).where(F.col("seen_at") <= F.lit(mark).cast("timestamp"))
    want = S.evidence_state(seen, mark)
    assert last.count() > 10 and same(last, want)
    # everything that was alive, bad or known has been told to end
    assert got.where("state is null and not alive and not bad").count() > 0 and got.where("misses > 1").count() > 0
    assert got.groupBy("scope", "hash").agg(F.count("*").alias("n"), F.max("seq").alias("m")).where("n <> m + 1").isEmpty()


def test_health_stream(spark, late, tmp_path):
    got, mark = run(spark, late, tmp_path, lambda s: P.health_stream(rows_of(s, probes), 6 * 3600, 1, 86400, DELAY))
    last = got.groupBy("indexer").agg(F.max_by(F.struct("state", "streak", "is_open"), "seq").alias("x")).select("indexer", "x.*")
    seen = probes(spark, DATA).where(F.col("ts") <= F.lit(mark).cast("timestamp"))
    want = S.source_health(seen, mark, 6 * 3600, 1, 86400)
    assert last.count() == want.count() and same(last, want)
    assert got.where("is_open").count() > 0


def sightings(events):
    seen = F.expr("CASE event_type WHEN 'purchase' THEN CASE WHEN value > 90 THEN 'ready' ELSE 'still' END WHEN 'error' THEN 'dead' WHEN 'view' THEN 'still' ELSE 'moving' END")
    return events.select("event_id", "ts", (F.col("user_id") % 40).alias("item"), seen.alias("seen"))


def test_recheck_stream(spark, late, tmp_path):
    got, mark = run(spark, late, tmp_path, lambda s: P.recheck_stream(sightings(s), 2, 3, 5 * 86400, DELAY))
    seen = sightings(read(spark, DATA, "events")).where(F.col("ts") <= F.lit(mark).cast("timestamp"))
    want = S.recheck_outcome(seen, 2, 3, 5 * 86400).where("outcome <> 'pending'").select("item", "outcome")
    assert same(got.select("item", "outcome"), want)
    assert want.select("outcome").distinct().count() >= 3


def test_retry_stream(spark, late, tmp_path):
    attempts = lambda e: e.select("event_id", "ts", F.col("user_id").alias("work"), F.expr("CASE event_type WHEN 'view' THEN 'ok' WHEN 'click' THEN 'capped' ELSE 'failed' END").alias("result"))
    got, mark = run(spark, late, tmp_path, lambda s: P.retry_stream(attempts(s), 3, DELAY))
    want = S.retry_requeue(attempts(read(spark, DATA, "events")).where(F.col("ts") <= F.lit(mark).cast("timestamp")), 3)
    assert same(got.select("work", "event_id", "fails", "to"), want)


def test_processors_on_hand_cases():
    """Bad takes alive away for good; misses count up until one expires or a hit comes; blocked outdoes both while it lasts."""
    p, s = P.Evidence(), 1_000_000
    v = p.fresh
    for t, kind, ttl in ((0, "alive", 100), (10, "bad", 20), (11, "miss", 50), (20, "miss", 50), (71, "miss", 9), (72, "blocked", 5), (73, "hit", 60)):
        v, told = p.step(v, t * s, 0, (kind, ttl))
        if t == 10:
            assert told == [(10 * s, False, True, None, 0)] and p.expires(v, 10 * s) == 30 * s
        if t == 20:
            assert told[0][3:] == ("miss", 2)
        if t == 71:  # the run had expired at 70
            assert told[0][3:] == ("miss", 1)
        if t == 73:
            assert told[0][3:] == ("blocked", 0) and p.expired(v, 77 * s)[0][3:] == ("hit", 0)
    r = P.Recheck(2, 3, 1000)
    v = r.fresh
    for t, seen, want in ((0, "dead", None), (1, "still", None), (2, "moving", None), (3, "dead", None), (4, "still", None), (5, "dead", "dead"), (6, "ready", None)):
        v, told = r.step(v, t * s, 0, (seen,))
        assert [x[1] for x in told] == ([want] if want else [])
