"""Folds hold their state, not their groups."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sievewright.operators import maintenance as M
from sievewright.operators import ranking as R
from sievewright.plans import registry
from sievewright.sources.relations import evidence, listings
from sievewright.streaming import state as S

DATA = "/root/testdata/sf0.001"
FOLDED = ["str2_miss_backoff", "str4_dedupe_within", "str5_alert_cooldown", "str7_sliding_admission", "str11_latest_writer", "win9_limit_joint", "mrg18_promote_lists"]


@pytest.mark.parametrize("name", FOLDED)
def test_no_group_becomes_an_array(spark, name):
    plan = registry.queries()[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "collect_set" not in plan


def test_near_sizes_are_no_array(spark):
    df = spark.createDataFrame([(1, 0, "a", 1000, "Ready", True, False)], "service_id long, account long, name string, size long, status string, ready boolean, protected boolean").withColumn("uploaded_at", F.timestamp_seconds("service_id"))
    assert "collect_set" not in M.plan_dedup_near(df)._jdf.queryExecution().optimizedPlan().toString()


def test_islands_end_at_gaps(spark):
    times = [0, 59, 118, 178, 179, 238, 239, 300, 500, None]
    df = spark.createDataFrame([("a", t, i) for i, t in enumerate(times)] + [(None, 7, 99), (None, 8, 100)], "k string, s long, event_id long").withColumn("ts", F.timestamp_seconds("s"))
    parts = defaultdict(set)
    for r in S.islands(df, "k", 60).collect():
        parts[r.k, r.island].add(r.event_id)
    assert sorted(map(sorted, parts.values())) == [[0, 1, 2], [3, 4, 5, 6], [7], [8], [9], [99, 100]]
    got = {r.event_id for r in S.dedupe_within_fold(df, "k", 60).collect()}
    assert got == {0, 2, 3, 5, 7, 8, 9, 99}


def test_lists_are_promoted_row_by_row(spark):
    hit = {r.hash for r in evidence(spark, DATA).where("kind = 'hit'").collect()}
    want = defaultdict(set)
    for r in listings(spark, DATA).collect():
        want[r.request_id].add(r.hash)
    got = {r.list_id: (r.n, r.n_ready) for r in registry.queries()["mrg18_promote_lists"](spark, DATA).collect()}
    assert got == {k: (len(v), len(v & hit)) for k, v in want.items()}


def test_joint_quota_takes_unknown_quality(spark):
    df = spark.createDataFrame([(1, i, None, 7) for i in range(3)], "request_id long, rn long, quality string, indexer long")
    assert sorted(r.rn for r in R.limit_joint(df, {"1080p": 1}, 2).collect()) == [0, 1]
