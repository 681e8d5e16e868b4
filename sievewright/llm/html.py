"""Operator 2, main text of web pages: boosted trees over DOM nodes and one consistent choice for the whole tree."""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Trees, fit_trees
from .common import kept_in_worker, ship, sliced, texts_of
from .dom import Page

#: Price of leaving a container undecided, so that its children choose for themselves.
MIXED = -0.5

#: Elements with the attributes that pages give them, by part of a page; fixed values of the training layouts.
PARTS = {
    "main": ["article", "main", "article class='post'", "div class='content'", "div id='main-content'", "div class='post-body'", "div class='entry-content'", "section class='story'", "div class='article-text'", "div class='articleBody'", "div role='main'", "div", "section"],
    "menu": ["nav", "nav class='navbar'", "div class='menu'", "div id='nav'", "ul class='navigation'", "div class='breadcrumbs'", "div class='pagination'", "div class='topnav'", "div role='navigation'"],
    "head": ["header", "div id='header'", "div class='masthead'", "header class='site-header'", "div class='topbar'", "div class='branding'", "div role='banner'"],
    "foot": ["footer", "div id='footer'", "div class='site-footer'", "footer class='footer'", "div class='copyright'", "p class='legal'", "div role='contentinfo'"],
    "side": ["aside", "div class='sidebar'", "aside class='widget'", "div id='sidebar'", "div class='related-posts'", "section class='recommended'", "div class='trending'", "div role='complementary'", "div class='latest-news'"],
    "note": ["div class='cookie-notice'", "div id='cookie-banner'", "div class='alert'", "div class='notice'", "div class='newsletter'", "div class='consent'", "div role='alert'", "section class='paywall'", "div class='popup'", "p class='notice'"],
    "advert": ["div class='ad'", "div class='advertisement'", "aside class='ads'", "section class='sponsored'", "div id='ad-top'", "div class='promo'", "ins class='adsbygoogle'", "div class='ad-container'", "p class='advert'"],
    "form": ["form", "form class='search'", "div class='login-form'", "form id='subscribe'", "div class='contact-form'", "fieldset", "form class='signup'"],
    "comment": ["section id='comments'", "div class='comments'", "ol class='commentlist'", "div id='disqus_thread'", "div class='comment-list'", "section class='responses'", "div class='discussion'", "ul class='replies'", "section class='reader-comments'"],
    "share": ["div class='share'", "ul class='social'", "div class='tags'", "p class='share-buttons'"],
}


def layout(rng: random.Random, long: list[str], short: list[str]) -> str:
    """A page made of the corpus's own texts in a random layout; data-y marks what is article."""

    def words(a: int, b: int) -> str:
        return " ".join(rng.choice(long).split()[: rng.randint(a, b)]).replace("<", "&lt;")

    def element(kind: str, inner: str, y: int = 0) -> str:
        head = rng.choice(PARTS[kind])
        return f"<{head} data-y='{y}'>{inner}</{head.split()[0]}>"

    def links(n: int) -> str:
        item = lambda: f"<a href='/{rng.random()}'>{rng.choice(short).replace('<', '&lt;')}</a>"
        return "<ul>" + "".join(f"<li>{item()}</li>" for _ in range(n)) + "</ul>" if rng.random() < 0.7 else " ".join(item() for _ in range(n))

    def inline(text: str) -> str:
        w = text.split()
        if len(w) > 6 and rng.random() < 0.5:
            i = rng.randrange(len(w) - 3)
            tag = rng.choice(["b", "i", "em", "strong", "a href='/x'", "span", "code"])
            w[i] = f"<{tag}>{w[i]}"
            w[i + 2] += f"</{tag.split()[0]}>"
        return " ".join(w)

    def paragraph() -> str:
        return f"<p>{inline(rng.choice(long).replace('<', '&lt;') if rng.random() < 0.6 else words(1, 40))}</p>"

    def noise(kind: str) -> str:
        if kind in ("menu", "share"):
            return element(kind, links(rng.randint(2, 9)))
        if kind == "head":
            inner = rng.choice([f"<div class='logo'>{rng.choice(short)}</div>", f"<p>{words(1, 8)}</p>", f"<h2>{words(1, 6)}</h2>", f"<h1>{words(1, 6)}</h1>", words(1, 6)])
            return element(kind, inner + (noise("menu") if rng.random() < 0.5 else ""))
        if kind == "comment":
            item = lambda: rng.choice(["<div class='comment'>{}</div>", "<li>{}</li>", "<p>{}</p>", "<article class='comment'>{}</article>", "<div class='comment'><b>" + rng.choice(short) + "</b> {}</div>"]).format(rng.choice([f"<p>{words(3, 60)}</p>", words(3, 60)]))
            return element(kind, (f"<h3>{words(1, 3)}</h3>" if rng.random() < 0.5 else "") + "".join(item() for _ in range(rng.randint(1, 6))) + (noise("form") if rng.random() < 0.4 else ""))
        if kind == "form":
            return element(kind, f"<label>{words(1, 4)}</label><input name='x'>" + (f"<p>{words(2, 25)}</p>" if rng.random() < 0.5 else "") + f"<button>{words(1, 2)}</button>")
        if kind == "side":
            return element(kind, (f"<h3>{words(1, 4)}</h3>" if rng.random() < 0.6 else "") + (links(rng.randint(2, 8)) if rng.random() < 0.5 else "".join(f"<p>{words(4, 50)}</p>" for _ in range(rng.randint(1, 3)))))
        return element(kind, rng.choice([f"<p>{words(2, 50)}</p>", words(2, 50), words(2, 20) + " <a href='/x'>" + rng.choice(short) + "</a>"]))

    blocks = []
    if rng.random() < 0.75:
        blocks.append(f"<h1>{words(2, 12)}</h1>")
    for _ in range(rng.choice([1, 2, 3, 5, 8, 13])):
        kind = rng.random()
        if kind < 0.8:
            blocks.append(paragraph())
        elif kind < 0.86:
            blocks.append(f"<h2>{words(1, 7)}</h2>")
        elif kind < 0.91:
            blocks.append("<ul>" + "".join(f"<li>{inline(words(2, 30))}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
        elif kind < 0.94:
            blocks.append(f"<blockquote>{words(5, 40)}</blockquote>")
        elif kind < 0.97:
            blocks.append("<table>" + "".join(f"<tr><td>{words(1, 5)}</td><td>{words(1, 5)}</td></tr>" for _ in range(3)) + "</table>")
        else:
            blocks.append(f"<div>{words(5, 60)}</div>")
    for _ in range(rng.choice([0, 0, 0, 1, 2])):
        blocks.insert(rng.randint(1, len(blocks)), noise(rng.choice(["advert", "side", "share", "note", "form"])))
    main = element("main", "".join(blocks), 1)
    before = [noise(rng.choice(["menu", "head", "note", "advert", "form"])) for _ in range(rng.randint(0, 4))]
    after = [noise(rng.choice(["side", "comment", "foot", "advert", "share", "form", "note"])) for _ in range(rng.randint(0, 4))]
    if rng.random() < 0.7:
        after.append(noise("foot"))
    inner = "".join(before) + main + "".join(after)
    for _ in range(rng.randint(0, 2)):
        inner = f"<div{rng.choice(['', ' class=wrapper', ' id=page', ' class=container'])}>{inner}</div>"
    return f"<html><body data-y='0'>{inner}</body></html>"


def fit(pages: DataFrame, most_pages: int = 300, layouts: int = 900, seed: int = 7) -> Trees:
    """Trains the trees on pages re-laid from the corpus's own text.

    The texts come from at most ``most_pages`` pages, those with the smallest hash of their html: long runs stand for
    paragraphs, short ones for labels. ``layouts`` pages are made of them; nodes whose text is wholly article or wholly
    not are the examples. The sample is what a classifier may be fitted on; extraction itself reads every page whole.
    """
    hashed = pages.where("length(html) > 0").select("html", F.xxhash64("html").alias("h"))
    least = [r["h"] for r in hashed.select("h").distinct().orderBy("h").limit(most_pages).collect()]
    # only the pages chosen move, each once however often it occurs
    got = hashed.where(F.col("h").isin(least)).groupBy("h").agg(F.first("html").alias("html")).orderBy("h").collect() if least else []
    long, short = [], []
    for r in got:
        page = Page(r["html"])
        for text in page.run_text:
            text = " ".join(text.split())
            if len(text) > 60:
                long.append(text)
            elif text:
                short.append(text)
    long, short = long or ["One two three, four five six. Seven eight nine ten."], short or ["Home"]
    rng = random.Random(seed)
    xs, ys = [], []
    for _ in range(layouts):
        page = Page(layout(rng, long, short), marked=True)
        size, inside = np.zeros(len(page.tag)), np.zeros(len(page.tag))
        for node, text in zip(page.run_node, page.run_text):
            n = len(text.strip())
            size[node] += n
            inside[node] += n * (page.truth[node] or 0)
        for i in range(len(page.tag) - 1, 0, -1):
            size[page.parent[i]] += size[i]
            inside[page.parent[i]] += inside[i]
        share = inside / np.maximum(size, 1)
        # a container that holds next to nothing else is an example too
        pure = (size > 0) & ((share == 0) | (share > 0.9))
        xs.append(page.features()[pure])
        ys.append((share[pure] > 0.9).astype(float))
    return fit_trees(np.concatenate(xs), np.concatenate(ys))


def decode(page: Page, p: np.ndarray) -> np.ndarray:
    """Which nodes' own text is article: the best choice for the whole tree.

    A node is article, boilerplate or undecided. All below boilerplate is boilerplate; below article anything but
    undecided; below an undecided node anything. Text of an undecided node's own counts as a child with its chances.
    """
    n = len(page.tag)
    yes, no = np.log(np.clip(p, 1e-4, 1)), np.log(np.clip(1 - p, 1e-4, 1))
    own = np.zeros(n, bool)
    for node, text in zip(page.run_node, page.run_text):
        own[node] |= not text.isspace()
    full = own.copy()
    for i in range(n - 1, 0, -1):
        full[page.parent[i]] |= full[i]
    best = np.zeros((n, 3))  # article, boilerplate, undecided
    for i in range(n - 1, -1, -1):
        best[i] += (yes[i], no[i], MIXED + (max(yes[i], no[i]) if own[i] else 0)) if full[i] else 0
        if i:
            a, b, m = best[i]
            best[page.parent[i]] += (max(a, b), b, max(a, b, m))
    state, chosen = np.zeros(n, int), np.zeros(n, bool)
    for i in range(n):
        up = state[page.parent[i]] if i else 2
        state[i] = 1 if up == 1 else best[i, :2].argmax() if up == 0 else best[i].argmax()
        chosen[i] = state[i] == 0 or state[i] == 2 and p[i] >= 0.5
    return chosen


def extract(pages: DataFrame, model: Trees, html: str = "html") -> DataFrame:
    """The main text of every page, beside its other columns except the html: ``text`` and ``n_chars`` (its code points).

    Null and empty html, and pages in which nothing looks like an article, give empty text. Truncated and unclosed
    markup is read as far as it goes; very long pages are read whole. Repeated rows get equal results. Empty table: no
    rows. Columns named text or n_chars are replaced. No shuffle; the trees are broadcast, their size is fixed.
    """
    shipped = ship(pages.sparkSession).sparkContext.broadcast(model)
    keep = [f for f in pages.schema.fields if f.name not in (html, "text", "n_chars")]
    names = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_in_worker()
        for whole in batches:
            for b in sliced(whole, "__html"):
                read = [Page(t) for t in texts_of(b, "__html")]
                x = [page.features() for page in read]
                p = np.split(shipped.value.probability(np.concatenate(x)), np.cumsum(list(map(len, x)))[:-1]) if x else []
                texts = [page.text(decode(page, q)) for page, q in zip(read, p)]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], [*names, "text", "n_chars"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), "text string", "n_chars long"])
    return pages.select(*names, F.col(html).alias("__html")).mapInArrow(run, schema)
