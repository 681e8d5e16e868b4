"""Queries over whole tables against plain Python."""

import re
import unicodedata

from pyspark.sql import functions as F

from sievewright.functions import text as T
from sievewright.operators import joins as J
from sievewright.plans import registry
from sievewright.sources.relations import listings, read

DATA = "/root/testdata/sf0.001"


MATCHES = [
    # names, year, season and episode asked for, titles that name the work, titles that do not; BR marks priority origin
    (["Scary Movie"], 2000, None, ["Scary Movie 2000 BluRay", "The Scary Movie 1080p", "Scary Movie (1998 2000)"], ["Scary Movie 2 1080p", "Titanic 2000 Scary Sexy Disaster Movie", "Scary Movie 2013", "Scary Movie III", "BR Outro Scary Movie"]),
    (["Duna Parte Dois", "Dune Part Two"], 2024, None, ["BR Duna Parte 2 2024 Dublado", "Dune Part Two 2160p"], ["BR Duna Parte 3", "Dune Part Two 1984"]),
    (["Game of Thrones"], 2011, (1, 1), ["BR Game of Thrones 1ª até 8ª Temporada", "Game of Thrones S01E01 Winter Is Coming 1080p", "Game of Thrones S01 Complete", "BR Game of Thrones S01E01 Qualquer Nome"], ["BR Game of Thrones A Última Vigília", "Game of Thrones S02E01", "Game of Thrones 2004", "Game of Thrones Conquest Rebellion Special Film 1080p"]),
    (["Rick and Morty", "Rick e Morty"], 2013, (1, 2), ["S01E02 Rick and Morty 1080p", "Rick and Morty 1x02"], ["S01E02 Rick and Morty The Strange Anime Story 1080p", "BR Rick e Morty O Anime Novo"]),
    (["The Walking Dead: Dead City"], 2023, (1, 1), ["The Walking Dead Dead City S01E01", "Dead City"], ["Shaun of the Dead 2004"]),
    (["Demon Slayer Kimetsu no Yaiba"], 2019, (1, 1), ["Demon Slayer Kimetsu no Yaiba S01 03 VOSTFR Trix"], ["Demon Slayer Kimetsu no Yaiba Infinity Castle Movie Theater Cut 2025", "Demon Slayer Kimetsu no Yaiba S02"]),
]
MAGNETS = [("magnet:?xt=urn:btih:aa&dn=O%20Corvo%201994", False), ("magnet:?dn=The+Crow+2024&tr=x", True), ("https://x/o-corvo-1994", True), ("magnet:?dn=1920x1080", True), ("magnet:?dn=O+Corvo+1994+2024", True), (None, True)]


def test_titles_name_their_works(spark):
    works_, rows, want = [], [], set()
    for k, (names, year, asked, good, bad) in enumerate(MATCHES):
        works_.append((k, names, year, asked is not None, *(asked or (None, None))))
        for t in [*good, *bad]:
            rows.append((f"{k}|{t}", t.removeprefix("BR "), t.startswith("BR "), None))
            want |= {(f"{k}|{t}", k)} if t in good else set()
    works_.append((99, ["O Corvo", "The Crow"], 2024, False, None, None))
    for i, (m, good) in enumerate(MAGNETS):
        rows.append((f"m{i}", "O Corvo The Crow Dual", True, m))
        want |= {(f"m{i}", 99)} if good else set()
    df = spark.createDataFrame(rows, "lid string, title string, is_br boolean, magnet string")
    wk = spark.createDataFrame(works_, "work_id long, names array<string>, year int, is_series boolean, season int, episode int")
    got = {(r.lid, r.work_id) for r in J.match_works(df, wk).collect()}
    mine = {(lid, w) for lid, w in got if lid.startswith(("m", f"{w}|"))}
    assert mine == want
    counts = {r.work_id: (r.titles, r.n_listings) for r in J.match_counts(df.union(df), wk).collect()}
    for w in {w for _, w in got}:
        titles = {(t, b, m) for lid, t, b, m in rows if (lid, w) in got}
        assert counts[w] == (len(titles), 2 * sum((t, b, m) in titles for _, t, b, m in rows))


def test_inventory_of_franchises(spark):
    wk = spark.createDataFrame([(1, ["Jornada nas Estrelas II: A Ira"], 1982, False, None, None), (2, ["Distrito 9"], 2009, False, None, None)], "work_id long, names array<string>, year int, is_series boolean, season int, episode int")
    items = [(1, "FILMOGRAFIA COMPLETA JORNADA NAS ESTRELAS STAR TREK PTBR", True), (2, "FILMOGRAFIA JORNADA NAS ESTRELAS", False), (3, "Distrito 9 2009", False), (4, "Colecao Distrito Federal 9", True)]
    df = spark.createDataFrame([(*i, True, None) for i in items], "lid long, title string, multi_work boolean, is_br boolean, magnet string")
    assert sorted(map(tuple, J.match_inventory(df, wk).collect())) == [(1, 1, "root"), (3, 2, "name")]


def test_every_indexed_work_is_looked_up(spark):
    data = "/root/testdata/sf0.01"  # more works than 500
    got = {r.hash for r in registry.queries()["jn3_index_lookup_all"](spark, data).select("hash").distinct().collect()}
    assert got == {r.hash for r in listings(spark, data).select("hash").distinct().collect()}


def brute_norm(text):
    marks = re.sub("[\u0300-\u036f]", "", unicodedata.normalize("NFD", text.lower()))
    return re.sub("[^a-z0-9]+", " ", marks).strip(" ")


def test_norm_of_letters_beyond_latin_1(spark):
    texts = ["Škoda Łódź Őrült Ǆ", "Việt Nam Ệ", "e\u0301te\u0301 A\u030angstro\u0308m", "İstanbul \u212b \u212a", "ß æ ø đ Ж й", "가 ñandú", "x" * 200 + "é"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.norm_title(F.col("t")).alias("n"))
    assert {r.t: r.n for r in df.collect()} == {t: brute_norm(t) for t in texts}


def test_whole_texts_of_all_languages(spark):
    got = {r.doc_id: (r.norm, r.n) for r in registry.queries()["exp1_norm_whole_text"](spark, DATA).collect()}
    want = {r.doc_id: brute_norm(r.text) for r in read(spark, DATA, "documents").collect()}
    assert got == {k: (v, len(v.split())) for k, v in want.items()}
