"""Work that does not grow with copies: what many rows share is met, read and cut once, and the results stay whole."""

import random

from pyspark.sql import functions as F

from sievewright.functions import text as T
from sievewright.operators import filters as P
from sievewright.operators import joins as J
from sievewright.operators import ranking as R
from sievewright.plans import registry
from sievewright.sources import sinks as K


def test_searches_that_share_posts(spark):
    rng = random.Random(5)
    words = ["deep", "sky", "blue", "old", "sea"]
    posts = [(rng.randint(0, 2), k, " ".join(rng.sample(words, rng.randint(1, 4))) + rng.choice(["", " 2ª Temporada", " S03 pack"])) for k in range(400)]
    posts += [(1, 1000, None), (1, 1001, "")]
    queries = [" ".join(rng.sample(words, rng.randint(0, 3))) + rng.choice(["", " 2049"]) for _ in range(60)] + ["deep deep sea sky", "old old old", None]
    searches = [(s, s % 3, q, rng.choice([None, 0, 2, 3])) for s, q in enumerate(queries)]
    p = spark.createDataFrame(posts, "grp long, pos long, title string")
    s = spark.createDataFrame(searches, "search long, grp long, query string, season long")
    got = {(r.search, r.pos, r.nth) for r in P.filter_legible_posts(p, s, 7, on="grp").collect()}
    own = p.join(s.select("search", "grp"), "grp").select("search", "pos", "title")
    assert got == {(r.search, r.pos, r.nth) for r in P.filter_legible_posts(own, s.drop("grp"), 7).collect()}
    # against a plain reading of the rule
    want = set()
    for k, grp, query, season in searches:
        if query is None:
            continue
        tokens = query.split()
        tokens = tokens[:-1] if len(tokens) >= 2 and tokens[-1] == "2049" else tokens
        wanted = [w for w in tokens if len(w) > 2] if sum(len(w) > 2 for w in tokens) >= 2 else tokens
        fits = []
        for g, pos, title in posts:
            held = (title or "").lower().split()
            named = 2 if "temporada" in held else 3 if "s03" in held else None
            told = title is not None or not wanted
            if g == grp and told and (not wanted or sum(w in held for w in wanted) / len(wanted) >= 0.6) and (season in (None, 0) or named in (None, season)):
                fits.append(pos)
        want |= {(k, pos, n + 1) for n, pos in enumerate(sorted(fits)[:7])}
    assert got == want


WORKS = "work_id long, names array<string>, year int, is_series boolean, season int, episode int"


def test_works_alike_are_met_once(spark):
    kinds = [(["Deep Sky"], 2001, False, None, None), (["Deep Sky"], None, False, None, None), (["Old Sea", "Mar Velho"], 1999, True, 1, 2), (["Old Sea", "Mar"], 1999, False, None, None), (["Old Sea"], 1999, False, None, None)]
    works = spark.createDataFrame([(i, *kinds[i % 5]) for i in range(100)], WORKS)
    classes, members = J.work_classes(works)
    assert classes.count() == 5 and members.count() == 100
    rows = spark.createDataFrame([(1, "Deep Sky 2001", True, None), (2, "Old Sea S01E02", False, None), (3, "Old Sea", True, None)], "lid long, title string, is_br boolean, magnet string")
    got = {(r.lid, r.work_id) for r in J.match_works(rows, works).collect()}
    named = [{1}, {1}, {2, 3}, {2, 3}, {2, 3}]
    assert got == {(lid, i) for i in range(100) for lid in named[i % 5]}
    items = rows.withColumns({"multi_work": F.lit(False), "rows": F.lit(3)})
    assert {(r.work_id, r.n) for r in J.inventory_counts(items, works).collect()} == {(w, 3 * sum(x == w for _, x in got)) for _, w in got}


TITLES = "lid long, request_id long, title string, is_br boolean, dubbed boolean, multi_work boolean, quality string, seeders long, season long, episode long"


def titled(spark, n):
    kinds = ["Work S01E02", "Work CAMRip", "Work LEGENDADO", "Work FRENCH", "Work 1ª Temporada Completa da Cidade", None]
    rows = [(k, k % 5, kinds[k * 7 % 6], k % 3 == 0 and k % 5 != 4, k % 2 == 0 and k % 5 < 2, k % 4 == 0, ["1080p", "SD", None][k % 3], k % 11, 1, 2) for k in range(n)]
    return spark.createDataFrame(rows, TITLES)


def below_grouping(df, pattern):
    """Whether the plan looks for a pattern in rows before they are grouped by text."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return plan.rindex(pattern) > plan.rindex("Aggregate")


def test_titles_are_read_once(spark):
    df = titled(spark, 60)
    assert not below_grouping(T.read_once(df, {"x": F.col("title").rlike("Cam|Leg")}).where("x"), "Cam|Leg")
    got = T.read_once(df, {"x": F.length("title")}).select("lid", "title", "x").collect()
    assert len(got) == 60 and all(r.x == (r.title and len(r.title)) for r in got)
    for pool in (R.pool_priority_dubbed(df), R.pool_any_dubbed(df), R.pool_top_seeded(df), R.pool_ladder(df, 3)):
        assert not below_grouping(pool, "camrip")
    assert not below_grouping(P.classify(df).where("source = 'CAM'"), "camrip")
    assert not below_grouping(P.episode_is_weak(df, F.col("is_br"), 5), "TRUEFRENCH")


def test_ladder_takes_the_best_pool(spark):
    df = titled(spark, 300)
    pools = [{(r.request_id, r.lid): r.rn for r in p.collect()} for p in (R.pool_priority_dubbed(df), R.pool_any_dubbed(df), R.pool_top_seeded(df))]
    want = set()
    for request in range(5):
        tier = next((i for i, p in enumerate(pools) if any(k[0] == request for k in p)), None)
        if tier is not None:
            want |= {(*k, n, tier + 1, n <= 3) for k, n in pools[tier].items() if k[0] == request}
    got = {(r.request_id, r.lid, r.rn, r.tier, r.immediate) for r in R.pool_ladder(df, 3).collect()}
    assert got == want and len({t for *_, t, _ in got}) > 1


def test_large_partitions_are_several_files(spark, tmp_path):
    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    old = spark.conf.get(name)
    spark.conf.set(name, "2k")
    try:
        K.write_index(spark.range(0, 40000, 1, 4).selectExpr("id", "sha1(string(id)) AS lid", "1 AS shelf"), str(tmp_path / "index"))
    finally:
        spark.conf.set(name, old)
    assert len(list((tmp_path / "index" / "shelf=1").glob("*.parquet"))) > 1
    assert spark.read.parquet(str(tmp_path / "index")).count() == 40000


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_evidence_meets_works_and_not_listings(spark):
    """Hashes are no columns of the rows that are ranked or kept."""
    sf = "/root/testdata/sf0.001"
    for name in ("win1_rank_candidates", "mrg22_invalidate_lists", "flt8_filter_known_cache"):
        assert plan_of(registry.queries()[name](spark, sf)).count("sha1(cast(l_partkey") == 0


def test_few_rows_reach_the_windows_of_a_pool(spark):
    ranked = spark.range(500).selectExpr("id % 2 AS request_id", "id DIV 2 + 1 AS rn", "element_at(array('1080p', 'SD', 'x'), int(id % 3 + 1)) AS quality", "id % 5 = 0 AS is_br")
    df = R.select_quality_pool(ranked, {"SD": 3}, 10, reserved=4, per_band=2)
    assert "WindowGroupLimit" in plan_of(df) and df.count() == 20


def test_links_are_read_once_for_all_scopes(spark):
    plan = plan_of(registry.queries()["src12_post_links"](spark, "/root/testdata/sf0.001"))
    assert plan.count("Window ") == 1 and "segment#" not in plan[: plan.index("Window ")]
