"""Operator 7, near-duplicate texts: improved consistent weighted sampling over TF-IDF shingles, banded and verified."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import kept_in_worker, release, ship, sliced, stash
from .graph import connected_components, lowest
from .quality import rolling
from .words import mixed, word_hashes

#: Buckets of the document frequencies, and into how many rows a task's counts are cut. A bucket holds the shingles of
#: about (shingles a text / BUCKETS) of all texts beside its own, whatever the corpus.
BUCKETS = 1 << 20
CHUNKS = 64
#: Share of all texts above which a shingle counts as frequent, and the weight of one that all texts hold.
COMMON = 0.01
LEAST = 0.75
_DRAWS = 1 << 16


@dataclass(frozen=True)
class Params:
    """``words`` a shingle; ``bands`` of ``rows`` samples each; ``block``: members that one task compares with as many others."""

    words: int = 5
    threshold: float = 0.8
    bands: int = 18
    rows: int = 5
    seed: int = 11
    block: int = 1024

    @property
    def samples(self) -> int:
        return self.bands * self.rows


def shingles(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text, in the order of texts: hash, index of the text, times it occurs. A text of fewer than n words is one shingle."""
    x, counts = word_hashes(column)
    doc = np.repeat(np.arange(len(counts)), counts)
    key = next(rolling(x, [n]))[1] if len(x) >= n else x[:0]
    at = np.flatnonzero(doc[: len(key)] == doc[n - 1 : n - 1 + len(key)])
    h, d = mixed(key[at]), doc[at]
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        start = (np.cumsum(counts) - counts)[short]
        own = np.zeros(len(short), np.uint64)
        for i in range(n - 1):
            own += np.where(counts[short] > i, x[np.minimum(start + i, len(x) - 1)] * np.uint64(2 * i + 3), np.uint64(0))
        h, d = np.r_[h, mixed(own)], np.r_[d, short]
        order = np.argsort(d, kind="stable")
        h, d = h[order], d[order]
    tf = np.ones(len(h), np.int64)
    k = mixed(h + d.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    s = np.sort(k)
    twice = np.unique(s[1:][s[1:] == s[:-1]])
    if len(twice):
        found = np.minimum(np.searchsorted(twice, k), len(twice) - 1)
        hit = np.flatnonzero(twice[found] == k)
        group = found[hit]
        times = np.bincount(group, minlength=len(twice))
        _, first = np.unique(group, return_index=True)
        tf[hit[first]] = times[group[first]]
        keep = np.ones(len(h), bool)
        keep[np.delete(hit, first)] = False
        h, d, tf = h[keep], d[keep], tf[keep]
    return h, d, tf


def frequent(docs: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Buckets of shingles that more than COMMON of all rows hold, the rows of each, and the number of rows.

    Every task counts all its texts into BUCKETS numbers and hands them on in CHUNKS pieces, in the smallest integer
    type that holds them; each piece is summed by one task. Few buckets reach the driver: a row has some hundred
    shingles, so at most some hundred / COMMON buckets can be frequent.
    """
    ship(docs.sparkSession)
    size, rows = BUCKETS // CHUNKS, docs.count()
    kinds = (np.uint8, np.uint16, np.uint32, np.uint64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_in_worker()
        got = np.zeros(BUCKETS, np.uint64)
        for whole in batches:
            for b in sliced(whole, "text"):
                h, _, _ = shingles(b.column("text"), n)
                got += np.bincount((h % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS).astype(np.uint64)
        kind = next(k for k in kinds if got.max() <= np.iinfo(k).max)
        pieces = [x.astype(kind).tobytes() for x in got.reshape(CHUNKS, size)]
        yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array(pieces, pa.binary())], ["chunk", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for chunk, raw in zip(b.column("chunk").to_pylist(), b.column("counts").to_pylist()):
                kind = next(k for k in kinds if len(raw) == size * np.dtype(k).itemsize)
                total.setdefault(chunk, np.zeros(size, np.uint64))[:] += np.frombuffer(raw, kind)
        for chunk, x in total.items():
            at = np.flatnonzero(x > COMMON * rows)
            yield pa.RecordBatch.from_arrays([pa.array(at + chunk * size, pa.int64()), pa.array(x[at].astype(np.int64))], ["bucket", "df"])

    found = docs.select("text").mapInArrow(count, "chunk int, counts binary").repartition("chunk").mapInArrow(add, "bucket long, df long").toPandas()
    return found["bucket"].to_numpy(np.int64), found["df"].to_numpy(np.int64), rows


def idf(buckets: np.ndarray, df: np.ndarray, rows: int) -> np.ndarray:
    """Weight of every bucket: inverse document frequency that saturates.

    1 for shingles in up to COMMON of all texts, then falling with the logarithm to LEAST for one in every text.
    Saturation and floor keep a large group of near copies from lowering the weight of its own text far below that of its edits.
    """
    out = np.ones(BUCKETS, np.float32)
    out[buckets] = np.clip(1 - (1 - LEAST) * np.log(df / (COMMON * max(rows, 1))) / np.log(1 / COMMON), LEAST, 1)
    return out


class Sampler:
    """Consistent weighted samples: for each hash k and shingle the draws r, c ~ Gamma(2, 1) and beta ~ U(0, 1) are fixed by
    the shingle; the sample is the shingle (and level t) with the smallest c / (y e^r), where t = floor(ln w / r + beta) and y = e^(r (t - beta)).
    """

    def __init__(self, p: Params, weights: np.ndarray):
        rng = np.random.default_rng(p.seed)
        self.p, self.weights = p, weights
        self.r, self.beta = rng.gamma(2, 1, _DRAWS), rng.random(_DRAWS)
        self.ln_c = np.log(rng.gamma(2, 1, _DRAWS))
        self.plain = self.ordered(self.ln_c + self.r * self.beta - self.r)
        self.mul = rng.integers(1, 1 << 62, p.samples, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.add = rng.integers(0, 1 << 62, p.samples, dtype=np.uint64)

    @staticmethod
    def ordered(x: np.ndarray) -> np.ndarray:
        """Floats as integers of the same order, in the upper 32 bits."""
        bits = x.astype(np.float32).view(np.uint32)
        return np.where(bits >> np.uint32(31), ~bits, bits | np.uint32(1 << 31)).astype(np.uint64) << np.uint64(32)

    def weighed(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct shingles of each text: hash, index of the text, weight."""
        h, d, tf = shingles(column, self.p.words)
        return h, d, tf * self.weights[(h % np.uint64(BUCKETS)).astype(np.int64)].astype(np.float64)

    def bands(self, h: np.ndarray, d: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Texts that have shingles, the band keys of each, and one byte of every sample."""
        which, starts = np.unique(d, return_index=True)
        out, marks = np.zeros((len(which), self.p.bands), np.uint64), np.zeros((len(which), self.p.samples), np.uint8)
        if not len(which):
            return which, out.view(np.int64), marks
        odd = np.flatnonzero(w != 1)
        ln_w = np.log(w[odd])
        low, s48, s16 = np.uint64(0xFFFFFFFF), np.uint64(48), np.uint64(16)
        for k in range(self.p.samples):
            mix = h * self.mul[k] + self.add[k]
            draw = (mix >> s48).astype(np.int64)
            key = self.plain[draw] | ((mix >> s16) & low)
            if len(odd):
                i = draw[odd]
                t = np.floor(ln_w / self.r[i] + self.beta[i])
                ln_a = self.ln_c[i] - self.r[i] * (t - self.beta[i]) - self.r[i]
                level = mixed(t.astype(np.int64).view(np.uint64)) * (t != 0)
                key[odd] = self.ordered(ln_a) | (((mix[odd] >> s16) ^ level) & low)
            band, low_key = out[:, k // self.p.rows], np.minimum.reduceat(key, starts)
            band[:] = mixed(band * np.uint64(0x9E3779B97F4A7C15) + low_key + np.uint64(k + 1))
            marks[:, k] = low_key & np.uint64(255)
        return which, out.view(np.int64), marks

    def similarities(self, x: pa.Array, y: pa.Array) -> np.ndarray:
        """Weighted Jaccard similarity of the texts of two columns, row by row: summed smaller over summed larger weights; 1 for two texts without words."""
        (h, d, w), (g, e, v) = self.weighed(x), self.weighed(y)
        n = len(x)
        total = np.bincount(d, w, n) + np.bincount(e, v, n)
        k = mixed(np.r_[h, g] + np.r_[d, e].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        both, of = np.r_[w, v], np.r_[d, e]
        order = np.argsort(k)
        same = np.flatnonzero(k[order][1:] == k[order][:-1])
        i, j = order[same], order[same + 1]
        met = np.bincount(of[i], np.minimum(both[i], both[j]), n)
        return np.where(total > 0, met / np.maximum(total - met, 1e-300), 1.0)

    def similarity(self, a: str, b: str) -> float:
        return float(self.similarities(pa.array([a]), pa.array([b]))[0])


def least_equal(size: int, threshold: float) -> int:
    """Samples of ``size`` that a pair at the threshold shares except with a chance of about one in a million: 4.75 standard deviations below the mean."""
    return max(1, int(size * threshold - 4.75 * (size * threshold * (1 - threshold)) ** 0.5))


def near_duplicates(docs: DataFrame, p: Params = Params(), text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The class of near copies of every row.

    Two different texts are linked if they share a band of samples and their weighted Jaccard similarity over shingles
    of ``words`` words is ``threshold`` or more; equal texts are always in one class. Returns the id column,
    ``class_id`` (smallest id of the class), ``n_copies`` (rows with the very same text, this one included), ``n_class``
    (rows of the class) and ``kept`` (true for one row of the class: that of the smallest id, null ids last, the first
    of rows that tie). Texts, not ids, are compared: an id on two texts stands in two classes if they differ. Null text
    is empty text; texts without words are linked only if equal; a text of fewer than ``words`` words is one shingle. A
    class whose ids are all null has a null ``class_id``. Ids are whole numbers, or text that spells them; other text is
    an error. Very long texts are sampled whole. Empty table: no rows. Other columns are not read.

    Every text is reduced to band keys and one byte a sample where it lies. In each bucket all members are first
    compared with one of them, which joins a large group of copies by a star; then members of different classes are
    compared inside tasks that hold a block of the bucket each, by their bytes first and, for those left, by their
    texts. A task returns at most one edge a member and bucket, never its pairs. Members of a bucket's largest class
    are not compared with each other, so its cost is its size times the members outside that class.
    """
    signed, named, temporary = _classes(docs, p, text, id_col)
    out = signed.join(named, "digest").select("id", "class_id", "n_copies", "n_class", (F.col("row") == F.col("first_row")).alias("kept"))
    release(*temporary)
    return out.withColumnRenamed("id", id_col)


def dedup(docs: DataFrame, p: Params = Params(), text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that ``near_duplicates`` keeps, one of every class, with all their columns."""
    signed, named, temporary = _classes(docs, p, text, id_col)
    kept = signed.join(named.select("digest", "first_row"), "digest").where("row = first_row").select(_null_safe(F.col("id")).alias("__id"), F.col("digest").alias("__digest"))
    rows = docs.withColumns({"__id": _null_safe(F.col(id_col)), "__digest": digest_of(F.col(text))}).join(kept, ["__id", "__digest"])
    # of rows that repeat in id and text, any one
    order = W.partitionBy("__id", "__digest").orderBy(F.lit(1))
    release(*temporary)
    return rows.withColumn("__nth", F.row_number().over(order)).where("__nth = 1").select(*docs.columns)


def digest_of(text: Column) -> Column:
    return F.unhex(F.md5(F.encode(F.coalesce(text, F.lit("")), "UTF-8")))


def _null_safe(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("null"))


def _classes(docs: DataFrame, p: Params, text: str, id_col: str) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Rows (row, id, digest), the class of every digest, and tables that nothing reads any more."""
    spark = ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    shipped = spark.sparkContext.broadcast((p, idf(*frequent(rows, p.words))))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_in_worker()
        sampler = Sampler(*shipped.value)
        for whole in batches:
            for b in sliced(whole, "text"):
                which, bands, marks = sampler.bands(*sampler.weighed(b.column("text")))
                at = np.searchsorted(which, np.arange(b.num_rows + 1)).astype(np.int32)
                keys = pa.ListArray.from_arrays(pa.array(at * p.bands), pa.array(bands.ravel()))
                full = [b""] * b.num_rows
                for i, m in zip(which.tolist(), marks):
                    full[i] = m.tobytes()
                yield pa.RecordBatch.from_arrays([b.column("row"), b.column("id"), b.column("digest"), keys, pa.array(full, pa.binary())], ["row", "id", "digest", "bands", "marks"])

    numbered = rows.select(F.monotonically_increasing_id().alias("row"), "id", digest_of(F.col("text")).alias("digest"), "text")
    signed = stash(numbered.mapInArrow(sign, "row long, id long, digest binary, bands array<long>, marks binary"), "signed")
    own = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "row"))
    texts = signed.groupBy("digest").agg(own.alias("own"), F.count("*").alias("n_copies"), F.first("bands").alias("bands"), F.first("marks").alias("marks"))
    texts = stash(texts.withColumn("node", F.monotonically_increasing_id()), "texts")
    members = texts.select("node", F.explode("bands").alias("key"))
    full = members.groupBy("key").agg(F.min("node").alias("leader"), F.count("*").alias("n")).where("n > 1").drop("n")
    members = stash(members.join(full, "key"), "members")
    stars = members.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    signs = texts.select("node", "marks")
    stars = stars.join(signs.select(F.col("node").alias("a"), F.col("marks").alias("m")), "a").join(signs.select(F.col("node").alias("b"), F.col("marks").alias("o")), "b")
    stars = stash(alike(stars, p), "stars")
    moving = members.select("node").distinct().join(texts.select("node", "digest", "own.id"), "node").select("node", "digest", _null_safe(F.col("id")).alias("id"))
    moved = rows.select(_null_safe(F.col("id")).alias("id"), digest_of(F.col("text")).alias("digest"), "text").join(moving, ["id", "digest"])
    moved = stash(moved.groupBy("id", "digest", "node").agg(F.first("text").alias("text")).select("node", "text"), "moved")
    links = stash(verified(stars, moved, shipped), "links")
    groups = connected_components(links)
    more = stash(across(members, groups, texts, moved, shipped), "more")
    if not more.isEmpty():
        groups = connected_components(groups.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))
    classed = texts.select("digest", "own", "n_copies", "node").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    classed = stash(classed.drop("node"), "classed")
    best = classed.groupBy("component").agg(F.min("own").alias("first"), F.sum("n_copies").alias("n_class"))
    named = classed.join(best, "component").select("digest", "n_copies", "n_class", F.col("first.id").alias("class_id"), F.col("first.row").alias("first_row"))
    return signed.select("row", "id", "digest"), named, [texts, members, stars, moved, links, more]


def alike(pairs: DataFrame, p: Params) -> DataFrame:
    """Pairs (a, b) whose samples' bytes (m, o) agree often enough for the threshold."""
    least = least_equal(p.samples, p.threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m, o = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(-1, p.samples) for c in ("m", "o"))
            yield b.select(["a", "b"]).filter(pa.array((m == o).sum(1) >= least))

    return pairs.select("a", "b", "m", "o").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, texts: DataFrame, shipped) -> DataFrame:
    """Pairs (a, b) of nodes whose texts are similar enough. Each text goes to its pairs."""
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("y")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(*shipped.value)
        for whole in batches:
            for b in sliced(whole, "x", 2_000_000):
                good = sampler.similarities(b.column("x"), b.column("y")) >= sampler.p.threshold
                yield b.select(["a", "b"]).filter(pa.array(good))

    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def across(members: DataFrame, groups: DataFrame, texts: DataFrame, moved: DataFrame, shipped) -> DataFrame:
    """Links (a, b) between members of one bucket that are in different classes so far.

    Two passes of the same form: the first keeps members that may be similar to one of another class by the bytes of
    their samples, the second compares the texts of those.
    """
    p = shipped.value[0]
    classed = members.select("key", "node").join(groups.withColumnRenamed("component", "class"), "node", "left").withColumn("class", F.coalesce("class", "node"))
    signs = texts.select("node", "marks", "bands")
    near = dealt(classed, p.block).join(signs, "node")
    near = grouped(near, lambda t: _near(t, p), "key long, node long, class long")
    near = stash(near.distinct(), "near")
    close = dealt(near, max(1, p.block // 4)).join(signs, "node").join(moved, "node")
    held: list[Sampler] = []

    def links(t: pa.Table) -> pa.RecordBatch | None:
        if not held:
            held.append(Sampler(*shipped.value))
        return _links(t, held[0])

    return grouped(close, links, "a long, b long").distinct()


def dealt(classed: DataFrame, block: int) -> DataFrame:
    """Members of buckets of several classes, each once for every pair of blocks in which it meets others.

    Members outside their bucket's largest class fill blocks 0 to outer - 1, the largest class the blocks after that.
    Pairs of blocks (lo, hi) with lo < outer are compared, so the largest class is never compared with itself. A bucket
    of up to two blocks is one block.
    """
    per = classed.groupBy("key", "class").agg(F.count("*").alias("c")).groupBy("key").agg(F.max(F.struct("c", "class")).alias("top"), F.sum("c").alias("n"), F.count("*").alias("classes"))
    small, blocks = F.col("n") <= 2 * block, lambda n: F.ceil(n / block)
    outer, inner = F.when(small, 1).otherwise(blocks(F.col("n") - F.col("top.c"))), F.when(small, 0).otherwise(blocks(F.col("top.c")))
    mixed_up = per.where("classes > 1").select("key", F.col("top.class").alias("top"), outer.alias("outer"), inner.alias("inner"))
    rows = classed.join(mixed_up, "key").withColumn("inside", (F.col("class") == F.col("top")) & (F.col("inner") > 0))
    place = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    rows = rows.withColumn("own", F.when(F.col("inside"), F.col("outer") + place("inner")).otherwise(place("outer")))
    last = F.when(F.col("inside"), F.col("outer")).otherwise(F.col("outer") + F.col("inner")) - 1
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    return rows.select("key", F.least("own", "with").alias("lo"), F.greatest("own", "with").alias("hi"), "own", "node", "class")


def grouped(rows: DataFrame, work, schema: str) -> DataFrame:
    """Applies ``work`` to all rows of each (key, lo, hi), streamed from sorted partitions."""
    group = ["key", "lo", "hi"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.Table] = []

        def parts(t: pa.Table, cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
            for s, e in zip(cuts[:-1], cuts[1:]):
                if e - s > 1 and (out := work(t.slice(s, e - s))) is not None:
                    yield out

        last: tuple | None = None
        for b in batches:
            t = pa.Table.from_batches([b])
            cols = [t.column(c).to_numpy() for c in group]
            change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
            first = tuple(c[0] for c in cols) if len(t) else last
            if rest and first != last:
                whole = pa.concat_tables(rest)
                yield from parts(whole, np.array([0, len(whole)]))
                rest = []
            if len(change):
                whole = pa.concat_tables([*rest, t.slice(0, change[-1])])
                before = len(whole) - int(change[-1])
                yield from parts(whole, np.r_[0, change + before])
                rest = []
            if len(t):
                rest.append(t.slice(change[-1] if len(change) else 0))
                last = tuple(c[-1] for c in cols)
        if rest:
            whole = pa.concat_tables(rest)
            yield from parts(whole, np.array([0, len(whole)]))

    return rows.repartition(*group).sortWithinPartitions(*group).mapInArrow(run, schema)


def _candidates(t: pa.Table, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of two blocks that are of different classes, whose bytes agree often enough, and whose first common band is this bucket's."""
    own, classes = t.column("own").to_numpy(), t.column("class").to_numpy()
    marks = np.frombuffer(b"".join(t.column("marks").to_pylist()), np.uint8).reshape(len(t), p.samples)
    bands = t.column("bands").combine_chunks().flatten().to_numpy().reshape(len(t), p.bands)
    lo, hi, key = (t.column(c)[0].as_py() for c in ("lo", "hi", "key"))
    left, right = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
    least, a, b = least_equal(p.samples, p.threshold), [], []
    for i in left:
        j = right[right > i] if lo == hi else right
        j = j[classes[j] != classes[i]]
        j = j[(marks[j] == marks[i]).sum(1) >= least]
        if len(j):
            j = j[bands[i][(bands[j] == bands[i]).argmax(1)] == key]
            a.append(np.full(len(j), i))
            b.append(j)
    return (np.concatenate(a), np.concatenate(b)) if a else (left[:0], left[:0])


def _near(t: pa.Table, p: Params) -> pa.RecordBatch | None:
    i, j = _candidates(t, p)
    if not len(i):
        return None
    return t.select(["key", "node", "class"]).take(pa.array(np.unique(np.r_[i, j]))).combine_chunks().to_batches()[0]


def _links(t: pa.Table, s: Sampler) -> pa.RecordBatch | None:
    """Compares candidate pairs by their texts: a row at a time against all others at once."""
    i, j = _candidates(t, s.p)
    if not len(i):
        return None
    used, place = np.unique(np.r_[i, j], return_inverse=True)
    i, j = place[: len(i)], place[len(i) :]
    h, d, w = s.weighed(t.column("text").take(pa.array(used)).combine_chunks())
    _, word = np.unique(h, return_inverse=True)
    cut = np.searchsorted(d, np.arange(len(used) + 1))
    total, dense, good = np.bincount(d, w, len(used)), np.zeros(word.max() + 1), np.zeros(len(i), bool)
    edge = np.r_[0, np.flatnonzero(i[1:] != i[:-1]) + 1, len(i)]
    for s0, e0 in zip(edge[:-1], edge[1:]):
        x, ys = i[s0], j[s0:e0]
        mine = slice(cut[x], cut[x + 1])
        dense[word[mine]] = w[mine]
        met = np.bincount(d, np.minimum(w, dense[word]), len(used))[ys]
        dense[word[mine]] = 0
        good[s0:e0] = met >= s.p.threshold * (total[x] + total[ys] - met)
    if not good.any():
        return None
    root = lowest(len(used), i[good], j[good])
    nodes = t.column("node").to_numpy()[used]
    at = np.flatnonzero(root != np.arange(len(used)))
    return pa.RecordBatch.from_arrays([pa.array(nodes[at]), pa.array(nodes[root[at]])], ["a", "b"])
