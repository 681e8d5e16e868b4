"""Posts of listing pages and their links: cards, carried sections, references."""

import random
import re

import pytest
from pyspark.sql import functions as F

from sievewright.functions import text as T
from sievewright.sources import readers as S


def test_cards_tell_title_date_and_poster(spark):
    html = """<div class="post"><div class="title"><a href="/one">Work &#8211; &Aacute;udio</a></div> <img src="//img/x.jpg"> T&iacute;tulo Original: <b></b>
    <p>Título Original: </p> 03/02/2024 <div>x</div></div>
    <div class="post"><div class="title"><a href="two.html">List of works</a></div></div><div class="post"><div><a href="http://h/a/one">x</a></div></div><div class="post"><div><a href="/one">again</a></div></div>"""
    df = spark.createDataFrame([(1, "http://h/a/page.html", html)], "page_id long, url string, html string")
    got = {r.post_url: r for r in S.pages_to_posts(df, "post").collect()}
    assert set(got) == {"http://h/one", "http://h/a/one"}
    r = got["http://h/one"]
    assert (r.title, str(r.posted), r.poster) == ("Work – Áudio", "2024-02-03", "http://img/x.jpg")
    assert got["http://h/a/one"].posted is None and got["http://h/a/one"].poster is None


@pytest.mark.parametrize("url,want", [("http://x/y", "http://x/y"), ("magnet:?x", "magnet:?x"), ("/a", "http://h/a"), ("a", "http://h/p/a"), ("//i/a", "http://i/a"), (None, None)])
def test_addresses(spark, url, want):
    df = spark.createDataFrame([(url, "http://h/p/q.html")], "u string, p string")
    assert df.select(S.resolved(F.col("u"), F.col("p")).alias("r")).first().r == want


EPISODE, PACK = re.compile(S.EPISODE_TEXT), re.compile(S.PACK_TEXT)


def last(pattern, text):
    return next(reversed(list(pattern.finditer(text))), None)


def machine(links, scope, tie):
    """What each link is told, walking a post link by link: (segment, own text) pairs in upper case."""
    audio, episode, out = "", None, []
    named = lambda t: next((k for k, p in S.AUDIO_TEXT.items() if re.search(p, t)), None)
    for segment, own in links:
        audio = named(segment) or audio
        e, p = last(EPISODE, segment), last(PACK, segment)
        told = (int(e[1]) if e and (not p or (tie and e.start() > p.start())) else "none" if p else None) if e or p else None
        own_e, own_p = last(EPISODE, own), last(PACK, own)
        if scope == "anchor-writes" and (own_e or own_p):
            told = int(own_e[1]) if own_e else "none"
        if told is not None:
            episode = None if told == "none" else told
        shown = episode
        if scope == "anchor-local":
            shown = None if own_p else int(own_e[1]) if own_e else episode
        out.append((named(own) or audio, shown))
    return out


@pytest.mark.parametrize("scope", S.SCOPES)
@pytest.mark.parametrize("tie", [True, False])
def test_sections_are_carried(spark, scope, tie):
    rng, posts, want = random.Random(3), [], {}
    above = ["", "", "DUAL ÁUDIO", "LEGENDADO", "EPISÓDIO 05", "EP. 12", "TEMPORADA COMPLETA", "PACK EPISÓDIO 3", "EPISÓDIO 7 PACK", "DUBLADO EPISODIO 9", "1080P 2 GB"]
    own = ["DOWNLOAD", "DOWNLOAD", "EPISÓDIO 21", "PACK", "DUBLADO", "EPISÓDIO 2 PACK"]
    for k in range(60):
        links = [(rng.choice(above), rng.choice(own)) for _ in range(rng.randint(0, 12))]
        posts.append((k, "".join(f'<p>{a.lower()}</p> <a class="x" href="/{i}"><b>{b.lower()}</b></a>' for i, (a, b) in enumerate(links)) + "<p>EPISÓDIO 99</p>"))
        want |= {(k, i + 1): v for i, v in enumerate(machine(links, scope, tie))}
    df = spark.createDataFrame([*posts, (100, None), (101, ""), (102, "no link")], "page_id long, html string").repartition(5)
    got = {(r.page_id, r.nth): (r.audio, r.episode) for r in S.post_links(df, scope, tie).collect()}
    assert got == want


def test_links_tell_quality_source_and_size(spark):
    df = spark.createDataFrame([(1, '<p>1080p BluRay 3 GB ou 1,5 GB</p><a href="/x">Baixar</a> 720p <a href="/y">HDTV 700 MB</a>')], "page_id long, html string")
    assert [(r.href, r.quality, r.source, r["size"]) for r in S.post_links(df, "segment-only").orderBy("nth").collect()] == [("/x", "1080p", "BluRay", "1,5 GB"), ("/y", "720p", "HDTV", "700 MB")]


@pytest.mark.parametrize(
    "raw,want",
    [
        ("A &amp; B", "A & B"), ("II &#8211; Ataque", "II – Ataque"), ("&#x41;&#X1F600;", "A😀"), ("4&ordf; Temporada", "4ª Temporada"), ("Dual &Aacute;udio e &aacute;", "Dual Áudio e á"), ("&AMP;", "&"), ("&unknown; & x;", "&unknown; & x;"),
        ("&amp;#39;", "&#39;"), ("&#38;lt;", "<"), ("&#x110000;&#xD800;", "&#x110000;&#xD800;"), ("plain", "plain"), ("", ""), (None, None), ("&#39;&quot;&#39;", "'\"'"),
    ],
)
def test_references(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "t string").select(T.decode_entities(F.col("t")).alias("t")).first().t == want
