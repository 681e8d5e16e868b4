"""When the collection of a request ends, against a plain sweep over its arrivals."""

import random

import pytest

from sievewright.streaming import state as S


def sweep(rows, budget, grace, needs_rows):
    """Rows (t, priority, task_priority, stops, n) in order of time."""
    end, halt = max(r[0] for r in rows), min((r[0] for r in rows if r[3]), default=None)
    cut = min(x for x in (end, halt, budget) if x is not None)
    seen = [r for r in rows if r[0] <= cut]
    tasks = max((r[0] for r in rows if r[2]), default=-1)
    if cut < end and cut != halt and not any(r[1] for r in seen) and tasks > cut and grace and (not needs_rows or sum(r[4] for r in seen)):
        wanted = min((r[0] for r in rows if r[1] and r[0] > cut), default=None)
        cut = min(x for x in (end, halt, wanted, tasks, budget + grace) if x is not None)
    return [i for i, r in enumerate(rows) if r[0] <= cut]


@pytest.mark.parametrize("budget,grace,needs_rows", [(10, 0, False), (10, 8, False), (10, 8, True), (3, 30, False)])
def test_collections_end(spark, budget, grace, needs_rows):
    rng, all_, want = random.Random(budget + grace), [], set()
    for k in range(200):
        times = sorted(rng.sample(range(1, 40), rng.randint(1, 8)))
        rows = [(t - times[0], rng.random() < 0.15, rng.random() < 0.4, rng.random() < 0.05, rng.randint(0, 1)) for t in times]
        all_ += [(k, i, *r) for i, r in enumerate(rows)]
        want |= {(k, i) for i in sweep(rows, budget, grace, needs_rows)}
    df = spark.createDataFrame(all_, "request long, i long, t long, priority boolean, task_priority boolean, stops boolean, n long").selectExpr("*", "timestamp_seconds(t) as arrived_at")
    got = S.collect_within_budget(df, budget, grace, needs_rows).collect()
    assert {(r.request, r.i) for r in got} == want
    assert {r.why for r in got} >= ({"done", "budget", "stopped"} if not grace else {"done", "priority", "priority done", "stopped"})
