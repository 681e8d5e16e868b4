"""Rules of the reference on hand cases."""

import pytest

from sievewright.operators import aggregates as A
from sievewright.operators import filters as P
from sievewright.operators import maintenance as M
from sievewright.operators import ranking as R

LISTING = "lid long, request_id long, title string, is_br boolean, dubbed boolean, multi_work boolean, quality string, seeders long"


def listing(spark, *rows):
    """Rows of (title, is_br, dubbed, seeders) of one request."""
    return spark.createDataFrame([(k, 1, t, b, d, False, "1080p", n) for k, (t, b, d, n) in enumerate(rows)], LISTING)


@pytest.mark.parametrize(
    "rows,asked,cover",
    [
        ([("Work S01E02 1080p", True, True, 0)], (1, 2), "priority"),
        ([("Work S01E02 1080p", True, False, 0)], (1, 2), "priority"),  # without a tagged one, what does not say it is subtitled
        ([("Work S01E02 1080p LEGENDADO", True, False, 0)], (1, 2), "none"),
        ([("Work S01E02 CAMRip", True, True, 90)], (1, 2), "none"),
        ([("Work S01E02 1080p", False, True, 0)], (1, 2), "dubbed"),
        ([("Work S01E02 1080p", False, False, 30)], (1, 2), "healthy"),
        ([("Work S01E02 1080p FRENCH", False, False, 30)], (1, 2), "none"),
        ([("Work 1 Temporada Completa", True, True, 90)], (1, 2), "none"),  # a pack does not decide
        ([("Work 1 Temporada Completa", True, True, 90)], (None, None), "priority"),
        ([("Work 1 Temporada Completa", True, True, 90), ("Work S01E02", False, False, 0)], (1, 2), "priority"),
    ],
)
def test_pool_coverage(spark, rows, asked, cover):
    from pyspark.sql import functions as F

    df = listing(spark, *rows).withColumns({"ask_season": F.lit(asked[0]).cast("int"), "ask_episode": F.lit(asked[1]).cast("int")})
    assert A.pool_coverage(df, 10).first().cover == cover


def test_pools(spark):
    df = listing(spark, ("a CAMRip", True, True, 9), ("b LEGENDADO", True, False, 9), ("c", True, False, 1), ("d FRENCH", False, False, 99), ("e da casa de ouro", False, False, 6), ("f", False, False, 50))
    assert [r.title for r in R.pool_priority_dubbed(df).collect()] == ["c"]
    assert [r.title[0] for r in R.pool_top_seeded(df).orderBy("rn").collect()] == ["e", "f", "b"]
    assert [r.title[0] for r in R.pool_top_seeded(df, target_first=False).orderBy("rn").collect()] == ["f", "b", "e"]
    both = df.union(listing(spark, ("g DUBLADO", True, True, 2)))
    assert [r.title[0] for r in R.pool_priority_dubbed(both).collect()] == ["g"]


@pytest.mark.parametrize(
    "title,asked,key",
    [
        ("Work S02E05", (1, 1), (2, 5)), ("Work 2 Temporada", (1, 1), (2, None)), ("Work S02E05E06", (1, 1), (2, None)), ("Work S01-S03 1 a 3 temporada", (1, 1), (None, None)),
        ("Work serie completa", (1, 1), (None, None)), ("Work 1080p", (1, 1), (1, 1)), ("Work S02E05", (None, None), (None, None)),
    ],
)
def test_rows_go_where_their_title_says(spark, title, asked, key):
    df = spark.createDataFrame([(title, *asked)], "title string, season long, episode long")
    r = M.routed(df).first()
    assert (r.season, r.episode) == key


def test_eviction_spares_what_is_not_its_own(spark):
    rows = [(1, i, f"h{i}", i, "Ready", True, False) for i in range(20)]
    rows[0] = (1, 0, "h0", None, "Ready", True, False)  # no date
    rows[1] = (1, 1, "h1", 1, "Downloading", True, False)
    rows[2] = (1, 2, "h2", 2, "Ready", None, False)  # not proved foreign
    rows[3] = (1, 3, "h3", 3, "Ready", False, False)
    rows[4] = (1, 4, "h4", 4, "Ready", True, True)  # protected
    df = spark.createDataFrame(rows, "account long, service_id long, hash string, uploaded_at long, status string, foreign boolean, protected boolean")
    pairs = lambda *h: spark.createDataFrame([(1, x) for x in h], "account long, hash string")
    got = lambda cap, floor: sorted(r.service_id for r in M.plan_evict(df, pairs("h5", "x", "y"), pairs("h6"), cap, floor).collect())
    assert got(60, 5) == [7, 8, 9]  # as many as were consulted
    assert got(2, 5) == [7, 8] and got(60, 19) == [7] and got(60, 30) == []


def test_weak_episodes(spark):
    from pyspark.sql import functions as F

    weak = lambda *rows: P.episode_is_weak(listing(spark, *rows), F.col("is_br"), 10).first().weak
    assert weak(("a FRENCH", True, False, 99), ("b", True, False, 3), ("c", False, False, 99)) is True
    assert weak(("a", True, False, 10)) is False and weak(("a", False, False, 1)) is False


@pytest.mark.parametrize(
    "paths,names,year,pack,path,error",
    [
        (["a.txt"], ["Work"], None, False, None, "no video"),
        (["Work sample.mkv"], ["Work"], None, False, None, "no video"),
        (["other.mkv", "extras/Work.mkv"], ["Work"], None, True, "other.mkv", None),  # a lone one is it
        (["bb.mkv", "a.mkv"], ["Work"], None, False, "bb.mkv", None),  # the largest, where nothing speaks of several works
        (["Deep Sea 1999.mkv", "Deep Sky 2003.mkv"], ["Deep Sky"], 2003, False, "Deep Sky 2003.mkv", None),
        (["Deep Sea 1999.mkv", "Deep Sky 2003.mkv"], ["Other"], 2003, False, None, "work not clear"),
        (["Deep Sky 1999.mkv", "Deep Sky 2003.mkv"], ["Deep Sky"], 2003, False, "Deep Sky 2003.mkv", None),
        (["Deep Sky 1999.mkv", "Deep Sky 2003.mkv"], ["Deep Sky"], None, False, None, "work not clear"),
        (["Deep Sky/one.mkv", "Deep Sea/two.mkv"], ["Deep Sky"], None, True, "Deep Sky/one.mkv", None),  # the folder counts where the name says nothing
        (["x Deep.mkv", "y.mkv"], ["Deep Blue Sky", "Deep"], None, True, "x Deep.mkv", None),  # any of the names
    ],
)
def test_the_file_of_a_work(spark, paths, names, year, pack, path, error):
    files = spark.createDataFrame([("h", p, 100 * len(p)) for p in paths], "hash string, path string, size long")
    asked = spark.createDataFrame([("h", names, year, pack)], "hash string, names array<string>, year int, pack boolean")
    r = M.pick_work_file(files, asked).first()
    assert (r.path, r.error) == (path, error)


@pytest.mark.parametrize("query,season,title,ok", [
    ("The Deep Sky 2049", None, "deep sky remastered", True), ("Deep Sky 2049", None, "Deep Sea", False), ("1917", None, "1917 film", True), ("Blade 2049 2017", None, "blade 2049", True), ("ab cd", None, "ab", False), ("", None, "x", True),
    ("Deep Sky", 2, "Deep Sky 2ª Temporada", True), ("Deep Sky", 2, "Deep Sky 3ª Temporada", False), ("Deep Sky", 2, "Deep Sky S03 pack", False), ("Deep Sky", 2, "Deep Sky S03E01", True), ("Deep Sky", 2, "Deep Sky", True), ("Deep Sky", None, "Deep Sky 3ª Temporada", True),
])
def test_legible_posts(spark, query, season, title, ok):
    posts = spark.createDataFrame([(1, 1, title)], "search long, pos long, title string")
    searches = spark.createDataFrame([(1, query, season)], "search long, query string, season long")
    assert P.filter_legible_posts(posts, searches, 5).count() == ok


def test_holds_are_reconciled(spark):
    day, now = 86400, "2024-01-31 00:00:00"
    rows = [(1, 1, 2), (2, 1, None), (3, 30, None), (4, 1, None), (5, 30, None), (6, None, None), (7, 1, None), (8, 1, None)]
    holds = spark.createDataFrame([(i, f"2024-01-{a:02} 00:00:00" if a else None, f"2024-01-{r:02} 00:00:00" if r else None) for i, a, r in rows], "service_id long, a string, r string").selectExpr("service_id", "cast(a as timestamp) accepted_at", "cast(r as timestamp) ready_at")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "service_id long")
    got = {r.service_id: r.fate for r in M.reconcile_holds(holds, ids(1, 2, 3), ids(1, 2, 3, 8), ids(7), now, 10 * day, 5 * day).collect()}
    assert got == {1: "regressed", 2: "expired", 3: "keep", 4: "pruned", 5: "keep", 6: "pruned", 7: "keep", 8: "keep"}


@pytest.mark.parametrize("query,want", [
    ("Rocky V", "Rocky 5"), ("Jornada nas Estrelas II: x 1989", "Jornada nas Estrelas 2: x 1989"), ("V de Vinganca", None), ("A V de Vinganca", None), ("Rocky II Parte IV", None), ("I Am X", None), ("Apollo 13", None), ("Work VIII.", "Work 8."), ("IVory III", "IVory 3"), (None, None),
])
def test_numeral_variants(spark, query, want):
    from pyspark.sql import functions as F

    from sievewright.functions import identity as I

    assert spark.createDataFrame([(query,)], "q string").select(I.numeral_variant(F.col("q")).alias("v")).first().v == want


def test_search_queries(spark):
    from pyspark.sql import functions as F

    from sievewright.functions import identity as I

    rows = [("Work", 1999, 1, 2), ("Work", 1999, None, None), ("Work", None, None, None), (None, 1999, None, None), ("Obra Ação S01E02", None, None, None), ("1999", None, None, None)]
    df = spark.createDataFrame(rows, "name string, year long, season long, episode long")
    got = df.select(I.search_query(F.col("name"), F.col("year"), F.col("season"), F.col("episode")).alias("q")).select("q", I.shape_query(F.col("q"), F.lit(True), F.lit(True)).alias("s")).collect()
    assert [(r.q, r.s) for r in got] == [("Work S01E02", "Work"), ("Work 1999", "Work"), ("Work", "Work"), ("1999", "1999"), ("Obra Ação S01E02", "Obra Acao"), ("1999", "1999")]


def test_links_are_picked_by_identity(spark):
    import hashlib

    from sievewright.sources import readers as S

    name = lambda u: hashlib.sha1(u.encode()).hexdigest()[:10]
    links = spark.createDataFrame([(1, k + 1, f"/{k}") for k in range(3)], "page_id long, nth long, href string")
    ask = lambda *r: S.pick_link(links, spark.createDataFrame([r], "page_id long, id string, nth long, counted long")).first().href
    assert ask(1, name("/2"), 1, 9) == "/2" and ask(1, "gone", 1, 3) == "/0" and ask(1, "gone", 1, 2) is None and ask(1, "gone", 1, None) == "/0" and ask(1, None, 2, 7) == "/1" and ask(1, None, 9, None) is None and ask(2, None, 1, None) is None
