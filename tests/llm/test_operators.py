"""The training-data operators against brute force, and on nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import hashlib
import math
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sievewright.llm import bpe, common, dom, graph, html, lines, lm, minhash, mixing, quality, queries, sharding, toxicity, vectors, words

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, row long, size string, crc string, h1 string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")

ODD_TEXTS = [
    (1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "same text here and there now"), (6, "same text here and there now"), (6, "same text here and there now"), (7, "ünï cödé ßtraße \U0001f600 words in a line of text"),
    (8, "long " * 60_000), (None, "row without an id but with words"), (9, "a\nb\na\n\nb b b b b b b b b b b b b b b b b b b b b b b"), (10, "x" * 200_000),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", [None, "b", "a"][k % 3], None if t is None else len(t), k, k, "x", "y", "z") for k, (i, t) in enumerate(ODD_TEXTS)]
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return common.table(spark, DATA, "documents").cache()


# --- 1 ----------------------------------------------------------------------------------------------------------


def hilbert_walk(n, bits, spark):
    side = 1 << bits
    df = spark.range(side**n)
    cols = [((F.col("id") / side**k).cast("long") % side).cast("int").alias(f"c{k}") for k in range(n)]
    df = df.select(*cols)
    return df.select(*[f"c{k}" for k in range(n)], sharding.hilbert_index([F.col(f"c{k}") for k in range(n)], bits).alias("h")).orderBy("h").collect()


@pytest.mark.parametrize("n,bits", [(2, 3), (3, 2)])
def test_hilbert_visits_every_cell_once_in_single_steps(spark, n, bits):
    walk = hilbert_walk(n, bits, spark)
    assert [r.h for r in walk] == list(range(1 << (n * bits)))
    assert all(sum(abs(a[k] - b[k]) for k in range(n)) == 1 for a, b in zip(walk, walk[1:]))


@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_shards_follow_their_law(spark, docs, law):
    r = sharding.shard(docs, 24, law=law).toPandas()
    assert len(r) == docs.count() and r["shard"].between(0, 23).all()
    for _, g in r.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    order = r.sort_values(["shard", "slot"])["hilbert"]
    assert order.is_monotonic_increasing
    counts = r.groupby("shard").size().reindex(range(24), fill_value=0)
    if law == "rows":
        assert counts.max() - counts.min() <= 1
    else:
        sums = r.groupby("shard")["size"].sum()
        assert sums.max() - sums.min() <= 2 * r["size"].max()


def test_shards_prune_on_every_dimension(spark):
    """A file of one shard holds few sources, few languages and a narrow range of sizes, though all names begin alike."""
    rng = np.random.default_rng(16)
    rows = [(i, f"corpus-of-texts-{'abcdefgh'[rng.integers(8)]}", f"language-{'abcd'[rng.integers(4)]}", "x" * int(rng.integers(1, 1000))) for i in range(4000)]
    r = sharding.shard(spark.createDataFrame(rows, "doc_id long, source string, lang string, text string"), 24).toPandas()
    r = r.merge(spark.createDataFrame(rows, "doc_id long, source string, lang string, text string").drop("text").toPandas(), on="doc_id")
    per = r.groupby("shard").agg(s=("source", "nunique"), g=("lang", "nunique"), low=("size", lambda x: x.quantile(0.1)), high=("size", lambda x: x.quantile(0.9)))
    assert per["s"].mean() <= 4.5 and per["g"].mean() <= 3 and (per["high"] - per["low"]).mean() < 600


def test_shard_columns(spark, docs):
    got = {r.doc_id: r for r in queries.op1_hilbert_sharding(spark, DATA).collect()}
    for d in docs.collect():
        raw = d.text.encode()
        assert (got[d.doc_id]["size"], got[d.doc_id].text_crc32) == (len(raw) + 8, zlib.crc32(raw))


def test_shard_odd(odd, none):
    assert sharding.shard(none, 4).count() == 0
    r = sharding.shard(odd, 4).toPandas()
    assert len(r) == len(ODD_TEXTS) and sorted(r.groupby("shard").size()) == [3, 3, 3, 3]
    assert r.loc[r["doc_id"] == 1, "size"].item() == 8


# --- 2 ----------------------------------------------------------------------------------------------------------


def test_pages_give_their_articles(spark):
    import html as H

    pages = common.table(spark, DATA, "pages")
    got = {r.page_id: r for r in queries.op2_html_extraction(spark, DATA).collect()}
    for p in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", p.html, re.S)[1]
        blocks = re.split(r"</?(?:p|h1|br|ul|li)>", re.sub(r"</?b>", "", inner))
        want = " ".join(x for x in (" ".join(H.unescape(b).split()) for b in blocks) if x)
        assert got[p.page_id].text == want and got[p.page_id].n_chars == len(want)


@pytest.mark.parametrize("source", ["<div>" * 100_000 + "</x>" * 100_000, "<ul>" + "<div>" * 100_000 + "<li></li>" * 100_000, "<svg><desc>" + "<div>" * 100_000 + "<p>" * 100_000])
def test_reader_takes_linear_time(source):
    start = time.process_time()
    dom.Page(source)
    assert time.process_time() - start < 20


def test_reader_on_broken_markup():
    p = dom.Page("<div>a<p>b<b>c<p>d &amp; e &am <script>x<p></script><li>f<li>g<!-- x --><td>h <b x='>'>i</b><unclosed")
    assert p.text(np.ones(len(p.tag), bool)) == "a bc d & e &am f g h i"
    assert dom.Page("").text(np.ones(1, bool)) == ""


@pytest.mark.parametrize(
    "source,want",
    [
        ("<p>a<svg width='1'/>b</p><p>c</p>", "ab c"),
        ("<p>a<svg><title/><path d='x'/><text>no</text></svg>b</p>", "ab"),
        ("<p>a<svg><path></p><p>b</p>", "a b"),
        ("<div>a<select><option>no<option>no<p>b</p></div><p>c</p>", "a b c"),
        ("<p>a<select><option>no</select>b", "ab"),
        ("<div>a<object data=x><p>b</p></div><p>c</p>", "a b c"),
        ("<div>a<object data=x><p>no</p></object>b</div>", "ab"),
        ("<ul><li>a<template><li>no</li></template>b</ul>c", "ab c"),
        ("<head><noscript><img></noscript><title>no</title></head><p>a", "a"),
        ("<p>a<object>b<select><option>no</select>c", "abc"),
        ("<p data-y='many'>a</p>", "a"),
    ],
)
def test_reader_keeps_what_follows_dropped_elements(source, want):
    p = dom.Page(source)
    assert p.text(np.ones(len(p.tag), bool)) == want
    assert len(p.features()) == len(p.tag) == len(p.children) and sum(p.children) == len(p.tag) - 1


def test_choice_is_consistent(spark):
    model = html.fit(common.table(spark, DATA, "pages"), layouts=120)
    p = dom.Page("<body><nav><article><p>in a menu</p></article></nav><article><h1>t</h1><p>Some words, more words. And so on, and so on.</p><aside class='related'><p>no</p></aside></article></body>")
    chosen = html.decode(p, model.probability(p.features()))
    for i in range(1, len(p.tag)):
        if p.tag[p.parent[i]] == "nav" and not chosen[p.parent[i]]:
            assert not chosen[i]
    text = p.text(chosen)
    assert "Some words" in text and "menu" not in text


def test_extract_odd(spark):
    model = html.fit(common.table(spark, DATA, "pages"), layouts=40)
    df = spark.createDataFrame([(1, "u", None, "x"), (2, "u", "", "x"), (2, "u", "", "x"), (3, "u", "<p>" * 3000 + "deep", "x")], "page_id long, url string, html string, text string")
    got = html.extract(df, model).collect()
    assert [(r.page_id, r.n_chars == len(r.text)) for r in sorted(got, key=lambda r: r.page_id)] == [(1, True), (2, True), (2, True), (3, True)]
    assert html.extract(df.limit(0), model).count() == 0
    assert html.fit(df.limit(0), layouts=20).feature


# --- 3 ----------------------------------------------------------------------------------------------------------


def brute_segments(scores):
    """All maximal segments by their recursive meaning: the best one, then left and right of it."""
    if not scores:
        return []
    best = (0.0, 0, 0)
    for i in range(len(scores)):
        s = 0.0
        for j in range(i, len(scores)):
            s += scores[j]
            if s > best[0] + 1e-9 or (abs(s - best[0]) <= 1e-9 and s > 0 and best[2] > best[1] and j + 1 - i > best[2] - best[1] and i >= best[1]):
                best = (s, i, j + 1)
    if best[0] <= 0:
        return []
    s, i, j = best
    right = [(a, b + j, c + j) for a, b, c in brute_segments(scores[j:])]
    return brute_segments(scores[:i]) + [best] + right


def test_segments_are_the_maximal_ones():
    rng = np.random.default_rng(1)
    for _ in range(300):
        n = int(rng.integers(1, 25))
        at = sorted(rng.choice(n, int(rng.integers(0, n + 1)), replace=False).tolist())
        gain = [float(x) for x in rng.uniform(-2, 3, len(at))]
        full = [-0.3] * n
        for p, g in zip(at, gain):
            full[p] = g
        got = [(round(s, 6), i, j) for s, i, j in toxicity.segments(at, gain, -0.3)]
        assert got == [(round(s, 6), i, j) for s, i, j in brute_segments(full)]


def test_segments_of_a_million_tokens_take_linear_time():
    """Totals that drift down leave all candidates standing, so that a walk back over them would be quadratic."""
    gain = np.where(np.arange(1_000_000) % 3 < 2, 1.5, -1.0).tolist()
    start = time.process_time()
    got = toxicity.segments(list(range(0, 10_000_000, 10)), gain, -0.3)
    assert len(got) == 666_667 and time.process_time() - start < 20


def test_toxicity_on_the_held_out_fold(spark):
    sf = "/root/testdata/sf0.01"
    r = queries.op3_toxicity(spark, sf).join(common.table(spark, sf, "labels"), "doc_id").where("held_out").toPandas()
    assert ((r["score"] >= 0) & (r["score"] <= 1)).all()
    assert ((r["predicted"] == 1) == (r["score"] >= 0.5)).all()
    assert (r["predicted"] == r["toxic"]).mean() > 0.95


def test_toxicity_odd(spark, odd, none):
    m = toxicity.Model(scores={"bad": 3.0}, lam=1.0, k=0.01, a=1.0, b=-2.0)
    got = toxicity.toxicity(odd, m, keep=("source",)).collect()
    assert len(got) == len(ODD_TEXTS) and all(0 <= r.score <= 1 and r.n_segments == 0 for r in got)
    assert toxicity.toxicity(none, m).count() == 0
    empty = toxicity.fit(spark.createDataFrame([], "text string, toxic int"))
    assert empty.scores == {}
    assert toxicity.fit(spark.createDataFrame([("a b c", 0), (None, 0)], "text string, toxic int")).scores == {}


def test_toxicity_learns_alike_whatever_the_batches(spark):
    """A batch without evidence between batches with evidence has the same types as they."""
    filler = [f"word{chr(97 + i % 20)} and other plain words" for i in range(400)]
    rows = [(f"{t} vile vile vile vile" if i % 100 < 10 else t, int(i % 100 < 10)) for i, t in enumerate(filler)]
    # texts count once, so every one has a word of its own
    rows = [(f"{t} {''.join(chr(97 + int(c)) for c in str(i))}", y) for i, (t, y) in enumerate(rows)]
    labelled = spark.createDataFrame(rows, "text string, toxic int").coalesce(1)
    whole = toxicity.fit(labelled)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "5")
    try:
        small = toxicity.fit(labelled)
        scored = toxicity.toxicity(labelled.withColumn("doc_id", F.monotonically_increasing_id()), small, keep=("toxic",)).collect()
    finally:
        spark.conf.set(name, before)
    assert whole.scores["vile"] > 0 and small == whole
    assert len(scored) == 400 and all(r.predicted == r.toxic for r in scored)


def test_the_curve_of_evidence_does_not_run_away():
    """Clean texts with some evidence each, a few with very much: whole Newton steps overshoot from there."""
    rng = np.random.default_rng(4)
    total = np.r_[rng.exponential(5.4, 880), rng.uniform(100, 600, 10), 4 + rng.exponential(12, 100), rng.uniform(300, 500, 4)]
    x, y = np.c_[total, np.ones(len(total))], np.r_[np.zeros(890), np.ones(104)]
    w = toxicity.logistic_curve(x, y)
    p = 1 / (1 + np.exp(-x @ w))
    assert 0 < w[0] < 1 and -6 < w[1] < 0
    assert np.abs(x.T @ (y - p) - 1e-3 * w).max() < 1e-4  # the slope of the loss is 0 there


# --- 4 ----------------------------------------------------------------------------------------------------------


def test_edit_check(spark):
    rng = np.random.default_rng(2)
    rows = []
    for _ in range(600):
        a = "".join(rng.choice(list("abé"), int(rng.choice([0, 1, 2, 5, 30, 90]))))
        b = list(a)
        for _ in range(int(rng.integers(0, 5))):
            k, i = rng.integers(3), int(rng.integers(len(b) + 1))
            if k == 0:
                b.insert(i, "é")
            elif b and k == 1:
                b.pop(min(i, len(b) - 1))
            elif b:
                b[min(i, len(b) - 1)] = "a"
        rows.append((a, "".join(b)))
    df = spark.createDataFrame(rows, "a string, b string")
    for t in (1, 2, 3):
        assert df.where(lines.within_edits(F.col("a"), F.col("b"), t) != (F.levenshtein("a", "b") <= t)).count() == 0


def test_no_pair_within_the_threshold_is_missed(spark):
    rng = np.random.default_rng(3)
    base = ["".join(rng.choice(list("abcdefgh "), int(n))) for n in rng.integers(10, 60, 100)]
    texts = set(base)
    for b in base:
        for _ in range(3):
            x = list(b)
            for _ in range(int(rng.integers(1, 4))):
                i, k = int(rng.integers(len(x))), int(rng.integers(3))
                x[i : i + (k > 0)] = [] if k == 1 else [str(rng.choice(list("abcdefgh")))] + ([x[i]] if k == 0 else [])
            texts.add("".join(x))
    df = spark.createDataFrame([(2 * i, t) for i, t in enumerate(texts)], "h1 long, line string").withColumn("h2", F.col("h1"))
    got = {(r.a, r.b) for r in lines.line_links(df, lines.STEPS).collect()}
    shorter = F.least(F.length("x.line"), F.length("y.line"))
    most = F.when(shorter >= 30, 2).when(shorter >= 15, 1).otherwise(0)
    both = df.alias("x").crossJoin(df.alias("y")).where("x.h1 < y.h1").where(F.levenshtein("x.line", "y.line") <= most)
    want = {(r[0], r[1]) for r in both.select("x.h1", "y.h1").collect()}
    assert got == want and len(want) > 100


def brute_lines(rows):
    """(id, lines, exact, near, dropped) of every row, rows in the order of their ids and of the table."""
    occ = [(i, k, p, x) for k, (i, t) in enumerate(rows) for p, x in enumerate((t or "").split("\n")) if WORD.search(x)]
    texts = sorted({x for *_, x in occ})
    up = {x: x for x in texts}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, c in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, d in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
        return row[-1]

    for i, a in enumerate(texts):
        for b in texts[:i]:
            n = min(len(a), len(b))
            if n >= 15 and abs(len(a) - len(b)) <= 2 and edits(a, b) <= (2 if n >= 30 else 1):
                up[find(a)] = find(b)
    first, lead = {}, {}
    for o in sorted(occ, key=lambda o: (o[0] is not None, o[0] or 0, o[1], o[2])):
        first.setdefault(o[3], o[:3])
        lead.setdefault(find(o[3]), o[:3])
    out = []
    for k, (i, t) in enumerate(rows):
        mine = [o for o in occ if o[1] == k]
        exact = [o[2] for o in mine if first[o[3]] != o[:3]]
        near = [o[2] for o in mine if first[o[3]] == o[:3] != lead[find(o[3])]]
        out.append((i or 0, len(mine), len(exact), len(near), sorted(exact + near)))
    return sorted(out)


def test_lines_against_brute_force(spark):
    rng = np.random.default_rng(12)
    base = ["".join(rng.choice(list("abcdefg "), int(n))) for n in rng.integers(3, 45, 30)]

    def line():
        x = list(base[rng.integers(len(base))])
        for _ in range(int(rng.choice([0, 0, 1, 2, 3]))):
            x[int(rng.integers(len(x)))] = str(rng.choice(list("abcé")))
        return "".join(x)

    rows = [(i, "\n".join(line() for _ in range(rng.integers(0, 5)))) for i in range(60)]
    rows += [(7000, rows[3][1]), (7000, rows[3][1]), (7001, None), (None, rows[5][1]), (7002, "a\n\na")]
    got = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_lines, r.n_exact, r.n_near, r.dropped) for r in got) == brute_lines(rows)
    assert sum(r.n_near for r in got) > 5


def test_lines_are_kept_once(spark, docs):
    out = {r.doc_id: r.text for r in lines.clean(docs).collect()}
    seen, first = Counter(), {}
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        for line in r.text.split("\n"):
            if WORD.search(line):
                first.setdefault(line, r.doc_id)
    for i, t in out.items():
        for line in t.split("\n"):
            if WORD.search(line):
                seen[line] += 1
                assert first[line] == i
    assert max(seen.values()) == 1
    r = lines.dedup_lines(docs).agg(F.sum("n_lines").alias("n"), F.sum("n_exact").alias("e"), F.sum("n_near").alias("d")).first()
    assert r.n - r.e - r.d == len(seen)


def test_lines_odd(odd, none, spark):
    got = lines.dedup_lines(odd.drop("row")).toPandas()
    assert len(got) == len(ODD_TEXTS)
    assert lines.dedup_lines(none.drop("row")).count() == 0 and lines.clean(none).count() == 0
    out = [r.text for r in lines.clean(odd).where("doc_id = 9").collect()]
    assert out == ["a\nb\n\nb b b b b b b b b b b b b b b b b b b b b b b"]
    assert [r.text for r in lines.clean(odd).where("doc_id = 1").collect()] == [None]
    df = spark.createDataFrame([(1, "the very same line of some thirty letters"), (2, "the very same line of some thirty letterz\nnew")], "doc_id long, text string")
    assert [r.text for r in lines.clean(df).orderBy("doc_id").collect()] == ["the very same line of some thirty letters", "new"]


def test_repeated_rows_lose_their_lines(spark):
    near = "the very same line of some thirty letters"
    rows = [(1, near + "\nalone\nalone"), (1, near + "\nalone\nalone"), (None, "of nobody\n\ntwice"), (None, "of nobody\n\ntwice"), (2, near[:-1] + "z"), (2, near[:-1] + "z"), (2, near[:-1] + "z"), (3, ""), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = lines.dedup_lines(df).collect()
    assert len({r.row for r in got}) == len(rows)
    assert sorted((r.doc_id or 0, r.n_lines, r.n_exact, r.n_near, r.dropped) for r in got) == [
        (0, 2, 0, 0, []), (0, 2, 2, 0, [0, 2]),
        (1, 3, 1, 0, [2]), (1, 3, 3, 0, [0, 1, 2]),
        (2, 1, 0, 1, [0]), (2, 1, 1, 0, [0]), (2, 1, 1, 0, [0]),
        (3, 0, 0, 0, []), (3, 0, 0, 0, []),
    ]
    texts = sorted((r.doc_id or 0, r.text) for r in lines.clean(df).collect())
    assert texts == [(0, ""), (0, "of nobody\n\ntwice"), (1, ""), (1, near + "\nalone"), (2, ""), (2, ""), (2, ""), (3, ""), (3, "")]


# --- 5 ----------------------------------------------------------------------------------------------------------


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in capped)
        open_ = [s for s in names if s not in capped]
        share = {s: left * w[s] / sum(w[o] for o in open_) for s in open_}
        over = {s for s in open_ if share[s] > most * sizes[s]}
        if not over:
            return {s: float(most * sizes[s]) for s in capped} | share
        capped |= over


def misses_little(rows, target):
    """What a source gives lies within half its smallest row that could still be taken or left."""
    free = rows.loc[(rows["size"] > 0) & (rows["copies"] == rows.loc[rows["size"] > 0, "copies"].min()), "size"]
    return abs(target - rows["taken"].sum()) <= free.min() / 2


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_small_rows_close_a_source(spark, seed):
    """A large row that does not fit keeps no smaller one out."""
    rows = [(i, "a", "w " * 1000) for i in range(3)] + [(10 + i, "b", "w") for i in range(600)] + [(1000 + i, "b", "w " * 300) for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    r = mixing.mix(df, weights=(39, 6), seed=seed).toPandas()
    b = r[r["source"] == "b"]
    assert b["target"].iloc[0] == pytest.approx(600) and b["taken"].sum() == 600


def test_closing_sizes(spark):
    """The largest size that fits, as often as it fits and occurs, then the next; at last one more of the smallest left, if nearer."""
    rng = np.random.default_rng(5)
    free = [(f"s{k}", int(n)) for k in range(12) for n in rng.choice([1, 2, 3, 7, 20, 21, 50, 400] if k % 2 else [5, 9, 30, 31, 800], rng.integers(1, 60))]
    gaps = {f"s{k}": float(rng.integers(0, 600)) + 0.25 for k in range(12)}
    got = defaultdict(dict)
    for r in mixing.closing_sizes(spark.createDataFrame(free, "src string, size long"), spark.createDataFrame(list(gaps.items()), "src string, gap double")).collect():
        got[r.src][r["size"]] = r["take"]
    for s, gap in gaps.items():
        left, want = Counter(n for x, n in free if x == s), Counter()
        for n in sorted((n for n in left if n <= gap), reverse=True):
            k = min(int(gap // n), left[n])
            want[n], left[n], gap = want[n] + k, left[n] - k, gap - k * n
        least = min((n for n in left if left[n]), default=None)
        if least and abs(least - gap) < gap:
            want[least] += 1
        assert got[s] == {n: k for n, k in want.items() if k}


def test_targets_and_sample(spark, docs):
    size = {r.doc_id: (r.source, len(WORD.findall(r.text))) for r in docs.collect()}
    sums = defaultdict(int)
    for s, n in size.values():
        sums[s] += n
    want = brute_targets(sums)
    r = mixing.mix(docs).toPandas()
    again = mixing.mix(docs.repartition(7)).toPandas()
    assert dict(zip(r["doc_id"], r["taken"])) == dict(zip(again["doc_id"], again["taken"]))
    assert all(size[i] == (s, n) for i, s, n in zip(r["doc_id"], r["source"], r["size"]))
    assert np.allclose(r["target"], [want[s] for s in r["source"]])
    assert (r["taken"] == r["copies"] * r["size"]).all() and (r["copies"] <= 3).all()
    for s, g in r.groupby("source"):
        whole = math.floor(want[s] / sums[s])
        assert set(g.loc[g["size"] > 0, "copies"]) <= {whole, whole + 1}
        assert misses_little(g, want[s])
    rows = mixing.sample(docs)
    assert rows.columns == docs.columns
    taken = defaultdict(int, zip(r["doc_id"], r["copies"]))
    assert Counter(x.doc_id for x in rows.collect()) == Counter({i: int(c) for i, c in taken.items() if c})


def test_inclusion_falls_with_size(spark):
    """Shares taken of each size class come near the inclusion probabilities, which differ and sum to the words needed."""
    rng = np.random.default_rng(13)
    sizes = np.minimum(rng.lognormal(3, 1.3, 8000), 3000).astype(int) + 1
    rows = [(i, "a" if i % 4 else "b", "w " * int(n)) for i, n in enumerate(sizes)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    r = mixing.mix(df).toPandas()
    assert len(r) == len(rows) and (abs(r.groupby("source")["taken"].sum() - r.groupby("source")["target"].first()) <= 100).all()
    free = df.select(F.col("source").alias("src"), F.size(F.split(F.trim("text"), " ")).cast("long").alias("size")).withColumn("k", mixing.size_class(F.col("size")))
    need = r.groupby("source").agg(t=("target", "first"), s=("source_size", "first"))
    need["whole"] = (need["t"] // need["s"]).astype(int)
    targets = spark.createDataFrame([(s, float(x.t - x.whole * x.s)) for s, x in need.iterrows()], "src string, need double")
    p = {(x.src, x.k): x.p for x in mixing.inclusion(free, targets).collect()}
    r["k"] = [int(n).bit_length() - 1 for n in r["size"]]
    r["extra"] = r["copies"] - [need.loc[s, "whole"] for s in r["source"]]
    for (s, k), g in r.groupby(["source", "k"]):
        q = p[s, k]
        assert abs(g["extra"].sum() - q * len(g)) <= 4.5 * math.sqrt(len(g) * q * (1 - q)) + 3
    some = [q for (s, k), q in sorted(p.items()) if s == "a"]
    assert some == sorted(some, reverse=True) and some[-1] < 0.5 * some[0]
    for s in "ab":
        g = r[r["source"] == s]
        assert sum(p[s, k] * n for k, n in zip(g["k"], g["size"])) == pytest.approx(need.loc[s, "t"] - need.loc[s, "whole"] * need.loc[s, "s"])


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 1, "c": 1}, {"a": 1, "b": 1000, "c": 5, None: 7}, {"x": 10}])
def test_capped_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    assert got == pytest.approx(brute_targets(sizes))


def test_mix_odd(odd, none):
    r = mixing.mix(odd).toPandas()
    assert len(r) == len(ODD_TEXTS) and (r.loc[r["size"] == 0, "taken"] == 0).all()
    assert mixing.mix(none).count() == 0 and mixing.sample(none).count() == 0
    assert mixing.sample(odd).columns == odd.columns


# --- 6 ----------------------------------------------------------------------------------------------------------


def test_bpe_equals_the_library(spark, docs, odd):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.vocabulary_path())
    t.no_truncation()
    t.no_padding()
    rng = np.random.default_rng(4)
    bits = ["a", "th", "'s", "'LL", " ", "\n", "é", "Σ", "İ", "中", "\U0001f600", "é", "1", "23", "!!", "<|endoftext|>", "\x1c", "\x85", "　", "\x00", "ﬁ"]
    extra = ["".join(rng.choice(bits, int(rng.integers(0, 30)))) for _ in range(500)]
    df = docs.select("doc_id", "text").union(spark.createDataFrame([(-1 - i, x) for i, x in enumerate(extra)], "doc_id long, text string")).union(odd.select("doc_id", "text"))
    got = bpe.bpe(df, queries.vocabulary_path(), ("ids", "decoded", "n_tokens", "ids_sha256", "decoded_sha256")).toPandas()
    texts = df.toPandas()
    by = {(i, t): None for i, t in zip(texts["doc_id"].fillna(-10**9), texts["text"])}
    assert len(got) == len(texts) and len(by) <= len(texts)
    want = Counter()
    for x in texts["text"]:
        ids = t.encode(x or "", add_special_tokens=False).ids
        want[(len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest())] += 1
    assert Counter(zip(got["n_tokens"], got["ids_sha256"], got["decoded_sha256"])) == want


def test_pair_check_against_exact_merging():
    v = bpe.load_vocabulary(queries.vocabulary_path())
    rng = np.random.default_rng(5)
    free = np.array([i for t, i in v.open.items() if not t.endswith(v.end)])
    last = np.array([i for t, i in v.open.items() if t.endswith(v.end)])
    a, b = rng.choice(free, 3000), np.r_[rng.choice(free, 1500), rng.choice(last, 1500)]
    ok = v.compatible(a, b)
    for x, y, good in zip(a.tolist(), b.tolist(), ok):
        s, e = v.names[x], v.names[y]
        parts = [v.ids[c] for c in s] + (v.symbols(e, last=False) if not e.endswith(v.end) else v.symbols(e.removesuffix(v.end)))
        assert (v.merged(parts) == [x, y]) == good


def test_caches_are_bounded():
    c = bpe.Coder(bpe.load_vocabulary(queries.vocabulary_path()), most_cached=50)
    a = c.encode_batch(["some words here " * 3, "other words there"])
    for k in range(30):
        c.encode_batch([f"w{k}x w{k}y w{k}z"])
    assert len(c.chunks) <= 60 and c.encode_batch(["some words here " * 3, "other words there"]) == a


def test_long_unbroken_words(spark):
    """Far beyond what quadratic merging would do in the time."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.vocabulary_path())
    t.no_truncation()
    t.no_padding()
    rng = np.random.default_rng(14)
    texts = ["".join(rng.choice(list("etaoinshr"), n)) for n in (70, 3000, 400_000)] + ["ab" * 100_000, "é" * 1000]
    c = bpe.Coder(bpe.load_vocabulary(queries.vocabulary_path()))
    start = time.process_time()
    got = c.encode_batch(texts)
    assert time.process_time() - start < 20
    assert got == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_bpe_empty(none):
    assert bpe.bpe(none, queries.vocabulary_path()).count() == 0


# --- 7 ----------------------------------------------------------------------------------------------------------


def test_samples_estimate_weighted_jaccard():
    p = minhash.Params(bands=400, rows=1)
    s = minhash.Sampler(p, np.where(np.arange(minhash.BUCKETS) % 3 == 0, 0.6, 1.0))
    base = [f"w{i}" for i in range(300)]
    other = base[:240] + [f"v{i}" for i in range(40)] + base[:60]
    a, b = " ".join(base), " ".join(other)
    which, keys, marks = s.bands(*s.weighed(pa.array([a, b])))
    assert which.tolist() == [0, 1]
    assert abs((keys[0] == keys[1]).mean() - s.similarity(a, b)) < 0.08
    assert abs((marks[0] == marks[1]).mean() - s.similarity(a, b)) < 0.08


def test_words_are_hashed_by_their_bytes():
    texts = ["a b  a\tç", None, "", "b", "x" * 5000 + " a", "\x1ca b", "\u3000 a"]
    h, counts = words.word_hashes(pa.array(["lead", *texts, "tail"]).slice(1, len(texts)))
    want = [w for t in texts for w in WORD.findall(t or "")]
    assert counts.tolist() == [len(WORD.findall(t or "")) for t in texts]
    by: dict = defaultdict(set)
    for w, x in zip(want, h.tolist()):
        by[w].add(x)
    assert all(len(x) == 1 for x in by.values()) and len(set().union(*by.values())) == len(by)


def test_frequent_shingles_weigh_less(spark, docs):
    n = docs.count()
    buckets, df, rows = minhash.frequent(docs, 5)
    assert rows == n and len(buckets) and (df > 0.01 * n).all()
    want = Counter()
    for r in docs.collect():
        w = WORD.findall(r.text or "")
        h, _, _ = minhash.shingles(pa.array([r.text]), 5)
        assert len(h) == len({tuple(w[i : i + 5]) for i in range(len(w) - 4)}) or len(w) < 5
        want.update((h % np.uint64(minhash.BUCKETS)).tolist())
    assert dict(zip(buckets.tolist(), df.tolist())) == {b: c for b, c in want.items() if c > 0.01 * n}
    weights = minhash.idf(buckets, df, rows)
    assert weights.min() >= minhash.LEAST and (weights < 1).sum() == len(buckets)


def classes(texts):
    def grams(t):
        w = WORD.findall(t or "")
        return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])

    g = [grams(t) for t in texts]
    up = list(range(len(texts)))

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for i in range(len(g)):
        for j in range(i):
            if texts[i] == texts[j] or (g[i] and g[j] and sum((g[i] & g[j]).values()) >= 0.8 * sum((g[i] | g[j]).values())):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def test_near_duplicates_against_all_pairs(spark, docs):
    rows = docs.orderBy("doc_id").collect()
    want = classes([r.text for r in rows])
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs).collect()}
    assert [got[r.doc_id] for r in rows] == [rows[c].doc_id for c in want]


def test_large_group_of_near_copies(spark):
    rng = np.random.default_rng(6)
    base = [f"word{i}" for i in range(150)]
    rows = [(0, " ".join(base))]
    for i in range(1, 300):
        w = list(base)
        for k in rng.choice(150, 2, replace=False):
            w[k] = f"edit{rng.integers(1000)}"
        rows.append((i, " ".join(w)))
    rows += [(i, " ".join(f"other{x}" for x in rng.integers(0, 10**6, 150))) for i in range(300, 900)]
    r = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    big = r[r["doc_id"] < 300]
    assert big["class_id"].nunique() == 1 and big["kept"].sum() == 1 and (big["n_class"] == 300).all()
    assert r[r["doc_id"] >= 300]["kept"].all()


def test_one_id_on_two_texts(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(80)) for x in "ab")
    rows = [(5, a), (5, b), (9, a + " more"), (10, b + " more"), (5, a), (None, b), (None, "only null ids here")]
    r = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    assert sorted(r["class_id"].fillna(-1)) == [-1, 5, 5, 5, 5, 5, 5] and r["kept"].sum() == 3
    assert sorted(r["n_class"]) == [1, 3, 3, 3, 3, 3, 3]
    out = minhash.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((x.doc_id or 0, x.text) for x in out) == sorted([(5, a), (5, b), (0, "only null ids here")])


def test_small_blocks_find_the_same_links(spark, docs):
    """Chains of edits, so that members of one bucket lie in several classes; blocks far smaller than the buckets."""
    rng, rows = np.random.default_rng(8), []
    for g in range(3):
        base = [f"g{g}w{i}" for i in range(120)]
        for i in range(60):
            w = list(base)
            for k in rng.choice(120, rng.integers(0, 7), replace=False):
                w[k] = f"e{rng.integers(10**6)}"
            rows.append((len(rows), " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = classes([t for _, t in rows])
    for block in (8, 1024):
        p = minhash.Params(block=block)
        got = {r.doc_id: r.class_id for r in minhash.near_duplicates(df, p).collect()}
        # idf moves pairs next to the threshold, so classes are held against pairs far from it: most texts agree
        assert np.mean([got[i] == want[i] for i in range(len(rows))]) > 0.8
    sampler = minhash.Sampler(minhash.Params(), minhash.idf(*minhash.frequent(df, 5)))
    text = pa.array([t for _, t in rows])
    up = list(range(len(rows)))
    for i in range(len(rows)):
        for j in np.flatnonzero(sampler.similarities(pa.array([rows[i][1]] * i), text.slice(0, i)) >= 0.8) if i else []:
            x, y = sorted((up[i], up[j]))
            up = [x if u == y else u for u in up]
    assert [got[i] for i in range(len(rows))] == up


def test_minhash_odd(odd, none):
    r = minhash.near_duplicates(odd).toPandas()
    assert len(r) == len(ODD_TEXTS)
    ids = dict(zip(r["doc_id"].fillna(-1), r["class_id"].fillna(-1)))
    assert ids[5] == ids[6] == 5 and ids[1] == ids[2] == 1 and ids[4] == 4
    assert r["kept"].sum() == r["class_id"].nunique(dropna=False)
    assert minhash.near_duplicates(none).count() == 0


# --- 8 ----------------------------------------------------------------------------------------------------------


def test_vectors_against_all_pairs(spark):
    rng = np.random.default_rng(7)
    centre = rng.standard_normal((40, 32))
    x = np.repeat(centre, 8, 0) + rng.standard_normal((320, 32)) * rng.choice([0.02, 0.15, 0.25], 320)[:, None]
    x = np.r_[x, x[:5], x[:5] * 3, rng.standard_normal((300, 32))].astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1001, [0.0] * 32), (1002, [float("nan")] * 32), (1003, []), (1004, [1.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = vectors.near_vectors(df, block=16).toPandas().set_index("vec_id")
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    link = u @ u.T >= 0.95
    np.fill_diagonal(link, False)
    assert (got.loc[range(len(x)), "n_links"].to_numpy() == link.sum(1)).mean() >= 0.99
    label = np.arange(len(x))
    for _ in range(len(x)):
        new = np.array([min(label[i], label[link[i]].min() if link[i].any() else label[i]) for i in range(len(x))])
        if (new == label).all():
            break
        label = new
    assert (got.loc[range(len(x)), "component_id"].to_numpy() == label).mean() >= 0.99
    assert (got.loc[1000:, "n_links"] == 0).all() and got.loc[1000:, "kept"].all()
    assert vectors.near_vectors(df.limit(0)).count() == 0


def test_one_id_on_two_vectors(spark):
    rng = np.random.default_rng(15)
    a, b = rng.standard_normal((2, 24))
    near = lambda v: (v + rng.standard_normal(24) * 0.01).tolist()
    rows = [(5, a.tolist()), (5, b.tolist()), (9, near(a)), (10, near(b)), (10, a.tolist()), (11, (-a).tolist())]
    got = vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(5, 1, 5), (5, 2, 5), (9, 2, 5), (10, 1, 5), (10, 2, 5), (11, 0, 11)]


def test_plan_reaches_its_recall():
    for n in (10, 10_000, 10_000_000):
        bits, tables = vectors.plan_tables(n, 0.95, 1e-3)
        assert (1 - (1 - math.acos(0.95) / math.pi) ** bits) ** tables <= 1e-3


def test_components(spark):
    rng = np.random.default_rng(8)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (None, 3)]
    up = {}

    def find(a):
        up.setdefault(a, a)
        while up[a] != a:
            a = up[a]
        return a

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in up}


# --- 9 ----------------------------------------------------------------------------------------------------------


def test_lm_base_and_score(spark):
    sf = "/root/testdata/sf0.01"
    d = common.table(spark, sf, "documents").toPandas()
    r = queries.op9_lm_scoring(spark, sf).toPandas().set_index("doc_id")
    words = lambda t: [w.decode() for w in lm.tokens_of(t)] + ["\n"]
    train = {i: zlib.crc32(str(i).encode()) % 10 != 0 for i in d["doc_id"]}
    c = Counter(w for i, t in zip(d["doc_id"], d["text"]) if train[i] for w in words(t))
    n, v = sum(c.values()), len(c)
    for i, t in zip(d["doc_id"], d["text"]):
        w = words(t)
        row = r.loc[i]
        assert (row["n_tokens"], row["n_known"], row["train_tokens"], row["held_out"]) == (len(w), sum(x in c for x in w), n, not train[i])
        assert row["base_score"] == pytest.approx(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), rel=1e-9)
    held = r[r["held_out"]]
    gain = (held["score"].sum() - held["base_score"].sum()) / held["n_tokens"].sum()
    assert 1 - 10**-gain >= 0.15  # perplexity of the held-out texts against the unigram's


def test_lm_does_not_depend_on_partitions(spark):
    df = common.table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    p = lm.Params(group=40_000)
    got = [lm.lm_scores(df.repartition(n), lm.is_training(F.col("doc_id")), p).toPandas().set_index("doc_id")["score"].sort_index() for n in (1, 7, 32)]
    assert np.allclose(got[0], got[1], rtol=1e-4) and np.allclose(got[0], got[2], rtol=1e-4)


def test_probabilities_sum_to_one():
    """Over all known words and one unknown of every ending, behind any two words."""
    words = {b"the": 50, b"of": 20, b"house": 3, b"mouse": 2, b"rat": 1, b"x": 1}
    endings: dict = {}
    for w, c in words.items():
        e = endings.get(w[-2:], (0, 0))
        endings[w[-2:]] = (e[0] + c, e[1] + 1)
    k = lm.Classes(words, endings, 5, len(words) + 1, lm.Params(spread=2))
    assert len(k.word) == 3 and k.of(b"mouse") != k.of(b"rat") and k.of(b"spouse") == k.of(b"mouse") and k.of(b"zzz") == k.other
    assert k.shares().sum() == pytest.approx(1)
    net = lm.Network(lm.Params(dims=6), k.shares())
    rng = np.random.default_rng(9)
    w = rng.integers(0, k.other + 1, 3000)
    net.train(w, *lm.contexts(w, np.array([0, 1500])), rng)
    norm = net.norms()
    for one in (0, 1, k.other):
        for two in (0, 2):
            total = 0.0
            for c in range(k.other + 1):
                p = math.exp(net.log_shares(np.array([c]), np.array([one]), np.array([two]), norm)[0])
                if c < k.first:
                    total += p
                else:
                    inside = [n for x, n in words.items() if k.of(x) == c] + [0]
                    total += sum(p * (n + 0.1) / 10 ** k.inside[c] for n in inside)
            assert total == pytest.approx(1, abs=1e-5)


def test_contexts_stop_at_texts():
    ids = np.array([4, 5, 0, 0, 7, 0])
    one, two = lm.contexts(ids, np.array([0, 3, 4]))
    assert one.tolist() == [0, 4, 5, 0, 0, 7] and two.tolist() == [0, 0, 4, 0, 0, 0]


def test_lm_odd(odd, none):
    r = lm.lm_scores(odd, lm.is_training(F.col("doc_id"))).toPandas()
    assert len(r) == len(ODD_TEXTS) and np.isfinite(r["score"]).all() and np.isfinite(r["base_score"]).all()
    assert (r.loc[r["doc_id"].isin([1, 2]), "n_tokens"] == 1).all()
    assert lm.lm_scores(none, lm.is_training(F.col("doc_id"))).count() == 0
    assert np.isfinite(lm.lm_scores(odd, F.lit(False)).toPandas()["score"]).all()


# --- 10 ---------------------------------------------------------------------------------------------------------


def brute_repetition(t):
    w = WORD.findall(t or "")
    win = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {i + k for i in range(len(w) - 7) if win[tuple(w[i : i + 8])] > 1 for k in range(8)}
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    covers = {}
    for n in quality.LIMITS:
        before, cov = set(), set()
        for i in range(len(w) - n + 1):
            g = tuple(w[i : i + n])
            if g in before:
                cov |= set(range(i, i + n))
            before.add(g)
        covers[n] = sum(len(w[i]) for i in cov) / max(1, sum(map(len, w)))
    return len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), dup, len(hit), covers


def test_repetition_against_brute_force(docs, odd, none):
    for df in (docs, odd.where("doc_id <> 8")):
        texts = df.select("doc_id", "text").collect()
        want = sorted((brute_repetition(r.text)[:5]) for r in texts)
        got = quality.repetition(df).toPandas()
        assert sorted(map(tuple, got[["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]].to_numpy().tolist())) == want
        by = dict(zip(got["doc_id"], got.to_dict("records")))
        for r in texts:
            if r.doc_id is not None and r.doc_id != 6:
                n, _, _, _, rep, covers = brute_repetition(r.text)
                row = by[r.doc_id]
                assert row["base_failed"] == (n < 20 or 100 * rep > 30 * n)
                assert all(row[f"cover_{k}"] == pytest.approx(v) for k, v in covers.items())
                assert not (row["base_failed"] and row["kept"])
    assert quality.repetition(none).count() == 0
    assert quality.repetition(odd).count() == len(ODD_TEXTS)


def test_clean_text_is_kept(spark):
    r = quality.repetition(common.table(spark, "/root/testdata/sf0.01", "documents")).join(common.table(spark, "/root/testdata/sf0.01", "labels"), "doc_id").where("not base_failed and quality = 1").toPandas()
    assert r["kept"].mean() > 0.95
