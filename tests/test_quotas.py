"""Reserves and guarantees of the final lists against a plain row-by-row reading of the rules."""

import random

import pytest

from sievewright.operators import ranking as R

QUALITIES = ["2160p", "1080p", "720p", "480p", "SD", "unknown"]


def requests(seed, n=25):
    rng = random.Random(seed)
    return {k: [(rn + 1, rng.choice(QUALITIES), rng.random() < 0.35, rng.random() < 0.5, rng.random() < 0.3) for rn in range(rng.randint(0, 40))] for k in range(n)}


def frame(spark, reqs):
    rows = [(k, *r) for k, rs in reqs.items() for r in rs]
    return spark.createDataFrame(rows, "request_id long, rn long, quality string, is_br boolean, dubbed boolean, multi_work boolean").repartition(3)


def plain_pool(rows, caps, target, reserved, per_band, factor, origin_first):
    taken, count, most = [], dict.fromkeys(caps, 0), min(target, target if origin_first else reserved)
    full = lambda q: q in caps and count[q] >= caps[q] * factor

    def take(r):
        taken.append(r)
        if r[1] in count:
            count[r[1]] += 1

    bands = dict.fromkeys(QUALITIES, 0)
    for step in (1, 2):
        for r in rows:
            if len(taken) < most and r[2] and r not in taken and not full(r[1]) and (step == 2 or bands[r[1]] < per_band):
                bands[r[1]] += 1
                take(r)
    more = True
    while more and len(taken) < target:
        more = False
        for q in sorted(caps, key=QUALITIES.index):
            left = [r for r in rows if r[1] == q and r not in taken]
            if left and not full(q) and len(taken) < target:
                take(left[0])
                more = True
    for r in rows:
        if len(taken) < target and r not in taken and r[1] not in caps:
            taken.append(r)
    return {r[0] for r in taken}


@pytest.mark.parametrize("caps,target,reserved,per_band,factor,origin_first", [({"2160p": 2, "1080p": 3}, 12, 0, 0, 1, False), ({"2160p": 2, "1080p": 3, "480p": 1}, 12, 5, 1, 1, False), ({"1080p": 2, "720p": 2}, 10, 4, 2, 2, True), ({"SD": 0, "480p": 1}, 8, 20, 1, 1, False)])
def test_pool_with_reserves(spark, caps, target, reserved, per_band, factor, origin_first):
    reqs = requests(target + reserved)
    got = {}
    for r in R.select_quality_pool(frame(spark, reqs), caps, target, reserved=reserved, per_band=per_band, factor=factor, origin_first=origin_first).collect():
        got.setdefault(r.request_id, set()).add(r.rn)
    assert got == {k: w for k, rs in reqs.items() if (w := plain_pool(rs, caps, target, reserved, per_band, factor, origin_first))}


def plain_guaranteed(rows, most, reserve, per_band, packs):
    own = sorted((r for r in rows if r[2]), key=lambda r: (not r[3], r[0]))
    sure, have = [], {}
    for r in own:
        if have.get(r[1], 0) < per_band and not (packs and r[4]):
            have[r[1]] = have.get(r[1], 0) + 1
            sure.append(r)
    for q in QUALITIES if packs and per_band else []:
        pack = next((r for r in own if r[1] == q and r[4] and r not in sure), None)
        if q not in have and pack:
            sure.append(pack)
    queue = [*sure, *(r for r in own if r not in sure)][: max(reserve, len(sure))]
    chosen = rows[:most]
    for r in queue:
        if r not in chosen:
            other = next((x for x in reversed(chosen) if not x[2]), None)
            if other:
                chosen.remove(other)
            if len(chosen) < most:
                chosen.insert(0, r)
    return {r[0] for r in chosen}


@pytest.mark.parametrize("most,reserve,per_band,packs", [(8, 0, 1, True), (8, 3, 1, True), (10, 6, 2, False), (5, 2, 0, True), (12, 0, 3, True)])
def test_guaranteed_bands(spark, most, reserve, per_band, packs):
    reqs = requests(most * 7 + reserve)
    got = {}
    for r in R.limit_guaranteed(frame(spark, reqs), most, reserve, per_band, packs=packs).collect():
        got.setdefault(r.request_id, set()).add(r.rn)
    assert got == {k: w for k, rs in reqs.items() if (w := plain_guaranteed(rs, most, reserve, per_band, packs))}
