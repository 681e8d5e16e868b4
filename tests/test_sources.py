"""Readers, writers and title expressions on literal cases."""

import json

import pytest
from pyspark.sql import functions as F

from sievewright.functions import text as T
from sievewright.sources import readers as S
from sievewright.sources import sinks as K

HASH = "0123456789abcdef0123456789abcdef01234567"


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("x")).first().x


@pytest.mark.parametrize(
    "title,quality,source,audio",
    [
        ("Work 2024 2160p WEB-DL Dublado", "2160p", "WEB-DL", "Dublado"),
        ("Work 1080p BluRay Dual Audio", "1080p", "BluRay", "Dual"),
        ("Work HDCAM 720p", "720p", "", ""),
        ("Work HD-CAM-RIP LEGENDADO", "SD", "CAM", "Legendado"),
        ("Work [Ukr Dub] 4K", "2160p", "", ""),
        ("Work HDTV Nacional", "unknown", "HDTV", "Nacional"),
    ],
)
def test_titles(spark, title, quality, source, audio):
    assert one(spark, title, T.quality) == quality
    assert one(spark, title, T.source_of) == ("CAM" if "HDCAM" in title else source)
    assert one(spark, title, T.audio_of) == audio


@pytest.mark.parametrize(
    "title,seasons,episodes",
    [
        ("Name S01E04", [1], [4]),
        ("Name S01E01-E03", [1], [1, 2, 3]),
        ("Name 1x04", [1], [4]),
        ("Name 1ª até 3ª Temporada", [1, 2, 3], []),
        ("Name 2ª Temporada (2022) E02", [2], [2]),
        ("Name Season 3", [3], []),
        ("Name Dublado", [], []),
        ("Name T01 E001-E003", [1], [1, 2, 3]),
        ("Name T01 E001 e E003", [1], [1, 3]),
        ("Name T02E05", [2], [5]),
        ("Name 1ª 2ª 3ª e 7ª Temporadas", [1, 2, 3, 7], []),
        ("Name 2 e 7ª Temporada", [7], []),
        ("Name 1 a 5 temporadas", [1, 2, 3, 4, 5], []),
        ("Name Temporada (2011)", [], []),
        ("Name S01 S03 Complete", [1, 3], []),
        ("Name 1ª Temporada Episódio 4", [1], [4]),
        ("Name Episódio II", [], []),
        ("Lilo e Stitch 2", [], []),
    ],
)
def test_season_episode(spark, title, seasons, episodes):
    r = one(spark, title, T.season_episode)
    assert sorted(r.seasons) == seasons and sorted(r.episodes) == episodes


@pytest.mark.parametrize(
    "title,want",
    [
        ("Work LEGENDADA 720P 1080p, 2160p, 720p, HD, WEB-DL", "720p"), ("Work Dual 1080P 1080p, 720p; x264", "1080p"), ("Work, 2160p", "2160p"), ("Work, the 2160p, 4K, One", "2160p"), ("Work 1080p, 2160p, HD, Part", "2160p"),
        ("Work 2160p, HD", "2160p"), ("Work 2160p, HD, 4K", "unknown"), ("Work DVD-Rip", "SD"), ("Work 576p", "SD"), ("Work TS", "SD"), ("Works", "unknown"), ("Work 480p CAM", "480p"), (None, "unknown"),
    ],
)
def test_quality_without_rows_of_tags(spark, title, want):
    assert spark.createDataFrame([(title,)], "t string").select(T.quality(F.col("t")).alias("q")).first().q == want


@pytest.mark.parametrize("title,want", [("A Guerra", True), ("One da Two de", True), ("One de Two", False), ("OPERAÇÃO", True), ("Work www.bludv.tv", True), ("The Night", False), ("Warguerra", False)])
def test_signs_of_the_target_language(spark, title, want):
    assert spark.createDataFrame([(title,)], "t string").select(T.target_signs(F.col("t")).alias("q")).first().q is want


def test_hashes_and_sizes(spark):
    assert one(spark, HASH.upper(), T.info_hash) == HASH
    assert one(spark, f"magnet:?xt=urn:btih:{HASH}&dn=x", T.info_hash) == HASH
    import base64

    assert one(spark, base64.b32encode(bytes.fromhex(HASH)).decode(), T.info_hash) == HASH
    assert one(spark, "no hash", T.info_hash) is None
    assert one(spark, "1,5 GB", T.parse_size) == int(1.5 * 1024**3)
    assert one(spark, "none", T.parse_size) is None


def test_json_readers(spark, tmp_path):
    p = tmp_path / "a.json"
    item = {"Title": "A &amp; B", "InfoHash": HASH, "Seeders": -3, "Size": 5000, "Tracker": "t", "Category": [2040]}
    p.write_text(json.dumps({"Results": [item, item | {"Category": [8000]}]}) + "\n" + json.dumps([item | {"Category": []}]))
    got = S.read_listings_json(spark, str(p)).collect()
    assert [(r.title, r.seeders, r.size, r.hash) for r in got] == [("A & B", 0, 5000, HASH)] * 2
    p = tmp_path / "f.json"
    p.write_text(json.dumps([{"title": "x", "infoHash": HASH, "seeders": 2, "size": 9, "indexer": "i"}]))
    r = S.read_listings_flat(spark, str(p)).first()
    assert (r.hash, r.size, r.seeders) == (HASH, 0, 2)
    p = tmp_path / "s.json"
    p.write_text(json.dumps({"streams": [{"name": "n", "title": "The Work\n👤 12 💾 1.5 GB ⚙️ source", "infoHash": HASH}]}, ensure_ascii=False))
    r = S.read_listings_feed(spark, str(p)).first()
    assert (r.title, r.seeders, r.size, r.indexer) == ("The Work", 12, int(1.5 * 1024**3), "source")


def test_source_catalog(spark, tmp_path):
    p = tmp_path / "c.xml"
    p.write_text('<indexers><indexer id="one"><title>One</title></indexer><indexer><id>two</id><title>Two</title></indexer><indexer id="bad id"><title>x</title></indexer></indexers>')
    got = {r.id: r.label for r in S.read_source_catalog(spark, str(p), ["two", "three", "three"]).collect()}
    assert got == {"one": "One", "two": "Two", "three": "three"}


def test_file_tree(spark):
    tree = json.dumps([{"n": "a", "e": [{"n": "b", "s": 1}, {"n": "c", "e": [{"n": "d", "s": 2}]}]}, {"n": "e", "s": 3}])
    df = spark.createDataFrame([(1, tree)], "id int, tree string")
    assert sorted((r.path, r.size) for r in S.explode_file_tree(df).collect()) == [("a/b", 1), ("a/c/d", 2), ("e", 3)]
    deep = {"n": "f", "s": 7}
    for k in range(40):
        deep = {"n": f"d{k}", "e": [deep]}
    rows = [(1, tree), (2, json.dumps([deep, {"n": "empty", "e": []}])), (3, None), (4, "no json"), (5, "[]")]
    got = {(r.path, r.id): r.size for r in S.explode_file_tree(spark.createDataFrame(rows, "path int, tree string").withColumnRenamed("path", "id").select("id", "tree")).collect()}
    assert got == {("a/b", 1): 1, ("a/c/d", 1): 2, ("e", 1): 3, ("/".join(f"d{k}" for k in reversed(range(40))) + "/f", 2): 7}


def test_links_carry_sections(spark):
    html = '<h2>Dub</h2><a href="/1">x</a><p><a href="/2">y</a></p><h2>Sub</h2><a href="/3">z</a><footer><a href="/4">f</a></footer>'
    df = spark.createDataFrame([(1, "http://h", html)], "page_id long, url string, html string")
    assert [(r.href, r.section) for r in S.posts_to_links(df).orderBy("nth").collect()] == [("/1", "Dub"), ("/2", "Dub"), ("/3", "Sub"), ("/4", None)]


def test_index_overwrites_only_its_partitions(spark, tmp_path):
    path = str(tmp_path / "i")
    K.write_index(spark.createDataFrame([(1, "a"), (2, "b")], "v int, shelf string"), path)
    K.write_index(spark.createDataFrame([(3, "b")], "v int, shelf string"), path)
    assert sorted((r.v, r.shelf) for r in spark.read.parquet(path).collect()) == [(1, "a"), (3, "b")]


def test_kv_stream(spark, tmp_path):
    rows = [("k", 1.0, 1), ("k", 2.0, 2), ("j", 5.0, 1)]
    df = spark.createDataFrame(rows, "key string, value double, seq long").withColumns({"used_at": F.timestamp_seconds("seq"), "expires_at": F.timestamp_seconds(F.col("seq") + 9)})
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    K.write_kv_snapshot(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = K.read_kv_snapshot(spark, str(tmp_path / "out"), df.schema)
    assert {r.key: r.value for r in got.collect()} == {"k": 2.0, "j": 5.0}


def test_empty_tables(spark):
    from sievewright.operators import aggregates, joins, ranking

    e = spark.createDataFrame([], "lid string, title string, is_br boolean, magnet string")
    w = spark.createDataFrame([], "work_id long, names array<string>, year int, is_series boolean, season int, episode int")
    assert joins.match_works(e, w).count() == 0
    li = spark.createDataFrame([], "lid string, request_id long, hash string, quality string, dubbed boolean, lied boolean, multi_work boolean, is_br boolean, seeders long, size long, indexer long")
    assert ranking.limit_joint(ranking.rank_candidates(li), {}, 2).count() == 0
    assert aggregates.dedupe_by_hash(li).count() == 0


def test_classify_by_title_and_file(spark):
    from sievewright.operators import filters

    cases = [
        # title, is_br, origin_only, proven_audio, proven_name -> audio, is_br, dubbed, multi_work
        ("Work 1080p Dual", False, False, None, None, "Dual", False, False, False),
        ("Work 1080p Dual", True, False, None, None, "Dual", True, True, False),
        ("Work 1080p Dual", True, True, None, None, "Dual", True, False, False),
        ("Work Dublado", False, False, "", None, "", True, False, False),
        ("Work LEGENDADO", False, False, "", None, "Legendado", False, False, False),
        ("Work", False, False, "Dublado", "Work.Dublado.mkv", "Dublado", False, True, False),
        ("Work Kannada Dub", False, False, None, None, "", False, False, False),
        ("Todos os filmes 1979-2016", False, False, None, None, "", False, False, True),
        ("Todas as Temporadas", False, False, None, None, "", False, False, False),
        ("Trilogia Work", False, False, None, None, "", False, False, True),
    ]
    df = spark.createDataFrame([c[:5] for c in cases], "title string, is_br boolean, origin_only boolean, proven_audio string, proven_name string").withColumns({"season": F.lit(None).cast("int"), "episode": F.lit(None).cast("int")})
    got = {(r.title, r.is_br, r.audio, r.dubbed, r.multi_work) for r in filters.classify(df).collect()}
    assert got == {(c[0], c[6], c[5], c[7], c[8]) for c in cases}
