"""The Merkle manifest, spelling variants and packing against brute force, and on odd tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sievewright.llm import common, merkle, packing, queries, spelling

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, tree string, i long, leaf string, block long"
ODD_TEXTS = [
    (1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "Same TEXT here"), (6, "Same TEXT here"), (6, "Same TEXT here"), (6, "Another text of the same id"),
    (7, "Ünï cödé ßtraße \U0001f600 words"), (8, "Long " * 60_000), (None, "row without an id"), (10, "X" * 200_000),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", [None, "b", "é", "z"][k % 4], None if t is None else len(t), k, "x", k, "y", k) for k, (i, t) in enumerate(ODD_TEXTS)]
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# --- 11 ---------------------------------------------------------------------------------------------------------


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, text):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row.doc_id, row.source, row.lang, row.n_chars, text)))


def climb(nodes):
    """Levels of a tree from its leaves to its root."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][k : k + 16])) for k in range(0, len(levels[-1]), 16)])
    return levels


def plain_manifest(rows, tampered):
    by = defaultdict(list)
    for r in rows:
        by[r.source].append((r.doc_id is not None, r.doc_id or 0, leaf(r, r.text), r))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climb([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in names}
    top = climb([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, (_, _, own, r) in enumerate(sorted(by[s], key=lambda x: x[:3])):
            h = leaf(r, r.text.lower() if r.text and r.text.isascii() else "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text) if r.text else r.text) if tampered(r) else own
            proof, at = "", i
            for levels, start in ((trees[s], i), (top, k)):
                at = start
                for lv in levels[:-1]:
                    low = at // 16 * 16
                    run = lv[low : low + 16]
                    proof += "".join(run[: at - low] + run[at - low + 1 :])
                    h = sha("".join([*run[: at - low], h, *run[at - low + 1 :]]))
                    at //= 16
            out.append((r.doc_id, own, trees[s][-1][0], top[-1][0], sha(proof), h, h == top[-1][0]))
    return sorted(out, key=str)


def manifest_rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


def hit(r):
    return zlib.crc32(str(r.doc_id).encode() if r.doc_id is not None else b"") % 5 == 0


def spoilt(df):
    return merkle.manifest(df, merkle.tampered_rows(F.col("doc_id")), merkle.lowered(F.col("text")))


def test_manifest_by_brute_force(spark):
    docs = common.table(spark, DATA, "documents").collect()
    got = manifest_rows(queries.op11_merkle_manifest(spark, DATA))
    assert got == plain_manifest(docs, hit)
    assert {r[6] for r in got} == {True, False}


def test_manifest_by_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    want = sorted(con.sql(f"SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, verified FROM ({merkle.ORACLE_SQL})").fetchall(), key=str)
    assert manifest_rows(queries.op11_merkle_manifest(spark, DATA)) == want


@pytest.mark.parametrize("sizes", [[1], [2, 1], [16, 17, 1], [4096, 4097, 300], [1] * 40 + [70_000]])
def test_manifest_of_trees_of_all_sizes(spark, sizes):
    """Lone leaves, full runs, last runs of one, trees of one and of many superblocks, more sources than a run holds."""
    rows = [(i, f"s{k:02}" if k else None, "en", i, f"Text {i}") for k, n in enumerate(sizes) for i in range(k, 100_000 * k + n if k == 0 else k + n)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(7)
    assert manifest_rows(spoilt(df)) == plain_manifest(df.collect(), hit)


def test_manifest_odd(odd, none):
    assert spoilt(none).count() == 0
    assert manifest_rows(spoilt(odd)) == plain_manifest(odd.collect(), hit)
    assert {r[6] for r in manifest_rows(merkle.manifest(odd))} == {True}
    assert manifest_rows(merkle.manifest(odd.limit(0).union(odd.where("doc_id = 4"))))[0][4] == sha("")


# --- 12 ---------------------------------------------------------------------------------------------------------


def plain_words(rows, every=97):
    total = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= 5 and n >= 3}


def one_error(w, v):
    """Exactly one inserted, deleted or replaced code point."""
    if len(w) == len(v):
        return sum(a != b for a, b in zip(w, v)) == 1
    a, b = sorted((w, v), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_variants(words):
    gone = defaultdict(set)  # words by what is left of them without one code point, or with it
    for w in words:
        for x in {w, *(w[:k] + w[k + 1 :] for k in range(len(w)))}:
            gone[x].add(w)
    near = {w: {v for x in {w, *(w[:k] + w[k + 1 :] for k in range(len(w)))} for v in gone[x] if v != w and one_error(w, v)} for w in words}
    form = {w: min(vs, key=lambda v: (-words[v], v)) for w, vs in near.items() if vs}
    form = {w: v for w, v in form.items() if words[v] >= 2 * words[w]}
    root = lambda w: root(form[w]) if w in form else w
    return sorted((w, n, len(near[w]), form.get(w), words.get(form.get(w)), root(w)) for w, n in words.items())


def variant_rows(df):
    return sorted(tuple(r) for r in df.select("word", "n", "n_near", "form", "form_n", "root").collect())


def test_variants_by_brute_force(spark):
    docs = common.table(spark, DATA, "documents").select("doc_id", "text").collect()
    want = plain_variants(plain_words(docs))
    assert variant_rows(queries.op12_spelling_variants(spark, DATA)) == want
    assert sum(r[3] is not None for r in want) > 10


@pytest.mark.parametrize("shard,block", [(60_000, 30_000), (300, 40), (50, 3)])
def test_variants_of_dense_words(spark, shard, block):
    """Few letters, so that words have many near ones; halves that many words share are cut into blocks."""
    rng = np.random.default_rng(shard)
    words = {"".join(rng.choice(list("abzÀÿ"), rng.integers(5, 9))) for _ in range(700)} | {"a" * k for k in range(5, 40)}
    words = {w.lower() if w.isascii() else w: int(rng.integers(3, 60)) for w in words}
    df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)
    got = {r.word: (r.n_near, r.best, r.best_n) for r in spelling.near_words(df, shard, block).collect()}
    near = {w: [v for v in words if one_error(w, v)] for w in words}
    assert got == {w: (len(vs), b := min(vs, key=lambda v: (-words[v], v)), words[b]) for w, vs in near.items() if vs}


def test_index_matches_stay_in_step():
    """The interval that follows on the other side is that which a search on that side finds."""
    words = sorted({"abba", "abbab", "babba", "bbaba", "ababa"})
    index = spelling.Index(words)
    text = "".join("#" + w for w in words) * 2
    for s in ("ab", "bba", "a#b", "#ab", "ba#"):
        at = np.array([[0], [0], [index.n]])
        for c in s[1:]:
            at = index.extended(at, np.array([ord(c) - 96 if c != "#" else 0]), left=False)
        at = index.extended(at, np.array([ord(s[0]) - 96 if s[0] != "#" else 0]), left=True)
        want = {i for i in range(index.n) if text[i : i + len(s)] == s}
        assert set(index.order[at[0, 0] : at[0, 0] + at[2, 0]].tolist()) == want


def test_long_texts_are_read_in_windows():
    text = "Über straße " * 1000 + "x" * 5000 + "-ab"
    assert spelling.runs_of(text, 100) == spelling.runs_of(text) == Counter({"Über": 1000, "straße": 1000, "x" * 5000: 1, "ab": 1})


def test_variants_odd(spark, odd, none):
    assert spelling.variants(none).count() == 0
    assert variant_rows(spelling.variants(odd)) == plain_variants(plain_words([(r.doc_id, r.text) for r in odd.collect()]))
    chain = [(k, " ".join([w] * n)) for k, (w, n) in enumerate([("maerchen", 100), ("maerchem", 40), ("maerchxm", 12), ("maerchxmy", 4)])]
    got = variant_rows(spelling.variants(spark.createDataFrame(chain, "doc_id long, text string"), every=10**9))
    assert [(r[0], r[3], r[5]) for r in got] == [("maerchem", "maerchen", "maerchen"), ("maerchen", None, "maerchen"), ("maerchxm", "maerchem", "maerchen"), ("maerchxmy", "maerchxm", "maerchen")]


# --- 13 ---------------------------------------------------------------------------------------------------------


def encoded(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.vocabulary_path())
    t.no_truncation()
    t.no_padding()
    return [e.ids + [0] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def check_pack(rows, docs, capacity):
    """Every document's ids in pieces, every sequence gapless and not over the capacity. Returns how many sequences there are, and how many at least."""
    want = sorted((d, k // capacity, k, len(ids[k : k + capacity]), zlib.crc32(np.array(ids[k : k + capacity], "<u4").tobytes())) for d, ids in docs for k in range(0, len(ids), capacity))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for held in by.values():
        held.sort()
        assert [o for o, _ in held] == np.cumsum([0, *(n for _, n in held)])[:-1].tolist() and sum(n for _, n in held) <= capacity
    return len(by), -(-sum(r.length for r in rows) // capacity)


def test_packing_of_all_documents(spark):
    docs = common.table(spark, DATA, "documents").select("doc_id", "text").collect()
    rows = queries.op13_best_fit_packing(spark, DATA).collect()
    got, least = check_pack(rows, list(zip([d.doc_id for d in docs], encoded([d.text for d in docs]))), 2048)
    assert got <= least * 1.01 + 1
    again = queries.op13_best_fit_packing(spark, DATA).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_packing_odd(spark, odd, none):
    path = queries.vocabulary_path()
    assert packing.pack(none, path).count() == 0
    held = odd.where("doc_id is not null and text is not null and doc_id <> 6").collect()
    rows = packing.pack(odd.where("doc_id is not null and text is not null and doc_id <> 6"), path, 300).collect()
    check_pack(rows, [(r.doc_id, ids) for r, ids in zip(held, encoded([r.text for r in held]))], 300)
    rows = packing.pack(odd, path).collect()
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows) and [r.length for r in rows if r.doc_id == 1] == [1]
    assert sum(r.doc_id == 6 for r in rows) == 3 and any(r.doc_id is None for r in rows)


LENGTHS = {
    "short": lambda rng: rng.geometric(0.01, 60_000),
    "long": lambda rng: rng.integers(600, 2049, 30_000),
    "even": lambda rng: rng.integers(1, 2049, 20_000),
    "few kinds": lambda rng: rng.choice([1024, 2048, 700, 648, 1], 10_000),
    "none": lambda rng: np.zeros(0, int),
    "one": lambda rng: np.array([5]),
}


@pytest.mark.parametrize("kind", LENGTHS)
def test_plans_place_every_length_once(kind):
    lengths = np.clip(LENGTHS[kind](np.random.default_rng(3)), 1, 2048)
    hist = np.bincount(lengths, minlength=2049)
    p = packing.plan(hist, 2048)
    n = np.repeat(np.arange(2049), hist)
    sequence, offset = p.places(n, np.concatenate([np.arange(k) for k in hist]) if len(n) else n)
    order = np.lexsort((offset, sequence))
    n, sequence, offset = n[order], sequence[order], offset[order]
    first = np.r_[True, sequence[1:] != sequence[:-1]][: len(n)]
    assert (offset[first] == 0).all() and (offset[~first] == (offset + n)[:-1][~first[1:]]).all() and (offset + n <= 2048).all()
    assert sorted(set(sequence.tolist())) == list(range(p.sequences))
    # no plan can do with fewer sequences than the tokens fill, nor than there are documents of over half a sequence
    least = max(-(-int(n.sum()) // 2048), int((n > 1024).sum()))
    assert p.sequences <= least * 1.01 + 1
    if kind == "even":  # the larger part is packed by patterns
        assert p.exact > 0.5 * p.sequences


def test_least_squares_are_not_negative():
    rng = np.random.default_rng(4)
    a, b = rng.random((12, 40)), rng.random(12) - 0.2
    x = packing.nnls(a, b)
    slope = a.T @ (b - a @ x)
    assert (x >= 0).all() and slope.max() < 1e-6 and np.abs(slope[x > 0]).max() < 1e-6
