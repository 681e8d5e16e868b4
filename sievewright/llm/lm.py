"""Operator 9, scoring texts with a log-bilinear model trained by noise-contrastive estimation."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32_of_id, kept_in_worker, ship, sliced, stash

END = 0


@dataclass
class Params:
    """``spread``: the most frequent words that are classes of their own, and the most frequent word endings that are, number
    ``spread`` times the fourth root of the distinct training words each. ``ending``: bytes of an ending. ``dims``: length
    of a vector. ``noise``: noise words a step. ``rounds``: disjoint parts of the training texts, after each of which
    parameters are averaged. ``group``: tokens that one group of texts holds about in a round. ``head``: most words
    whose counts are broadcast.
    """

    spread: int = 40
    ending: int = 2
    dims: int = 24
    noise: int = 24
    batch: int = 2048
    rounds: int = 3
    group: int = 2_000_000
    rate: float = 0.15
    head: int = 200_000
    seed: int = 3


def tokens_of(text: str | None) -> list[bytes]:
    """Words in UTF-8 with A-Z in lower case; bytes split at exactly the blanks of the contract."""
    return (text or "").encode("utf-8").lower().split()


def unigrams(train: DataFrame) -> DataFrame:
    """Count of every word of the training texts (``word`` as UTF-8). Tasks count in parts of bounded size, Spark sums."""
    most = 300_000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], ["word", "c"])
        for whole in batches:
            for b in sliced(whole, "text"):
                for t in b.column("text").to_pylist():
                    counts.update(tokens_of(t))
                if len(counts) > most:
                    yield out()
                    counts.clear()
        yield out()

    return train.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Network:
    """The model's parameters: context vectors with a weight vector per position, target vectors and biases; with each
    parameter the sum of its squared gradients, which Adagrad divides by.
    """

    NAMES = ("r", "q", "c", "b")

    def __init__(self, p: Params, share: np.ndarray):
        rng = np.random.default_rng(p.seed)
        n = len(share)
        self.p, self.share = p, share
        self.r = rng.normal(0, 0.1, (n, p.dims)).astype(np.float32)
        self.q = rng.normal(0, 0.1, (n, p.dims)).astype(np.float32)
        self.c = np.ones((2, p.dims), np.float32)
        self.b = np.log(share).astype(np.float32)
        self.past = {name: np.full(getattr(self, name).shape, 1e-2, np.float32) for name in self.NAMES}

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, x).ravel() for x in self.NAMES] + [self.past[x].ravel() for x in self.NAMES]).astype(np.float64)

    def load(self, x: np.ndarray) -> None:
        at = 0
        for past in (False, True):
            for name in self.NAMES:
                a = getattr(self, name)
                new = x[at : at + a.size].reshape(a.shape).astype(np.float32)
                at += a.size
                if past:
                    self.past[name] = new
                else:
                    setattr(self, name, new)

    def train(self, w: np.ndarray, c1: np.ndarray, c2: np.ndarray, rng: np.random.Generator) -> None:
        """One pass in mini-batches. The noise words of a step are shared by its tokens, so all scores are matrix products; steps by Adagrad."""
        k = self.p.noise
        ln_kp, upto = np.log(k * self.share).astype(np.float32), np.cumsum(self.share)

        def step(name: str, g: np.ndarray, rows: np.ndarray | None = None) -> None:
            a, h = getattr(self, name), self.past[name]
            if rows is not None:
                order = np.argsort(rows, kind="stable")
                rows, at = np.unique(rows[order], return_index=True)
                g = np.add.reduceat(g[order], at)
                h[rows] += g * g
                a[rows] += self.p.rate * g / np.sqrt(h[rows])
            else:
                h += g * g
                a += self.p.rate * g / np.sqrt(h)

        order = rng.permutation(len(w))
        for s in range(0, len(w), self.p.batch):
            at = order[s : s + self.p.batch]
            t, u, v = w[at], c1[at], c2[at]
            z = np.minimum(np.searchsorted(upto, rng.random(k) * upto[-1], side="right"), len(upto) - 1)
            ru, rv = self.r[u], self.r[v]
            x = ru * self.c[0] + rv * self.c[1]
            qt, qz = self.q[t], self.q[z]
            good = 1 / (1 + np.exp((x * qt).sum(1) + self.b[t] - ln_kp[t]))  # 1 - sigma(delta)
            bad = 1 / (1 + np.exp(-(x @ qz.T + self.b[z] - ln_kp[z])))  # sigma(delta of noise)
            gx = good[:, None] * qt - bad @ qz
            n = 1.0 / len(at)
            gq = np.r_[good[:, None] * x, -(bad.T @ x)] * n
            step("c", np.stack([(gx * ru).sum(0), (gx * rv).sum(0)]) * n)
            step("q", gq, np.r_[t, z])
            step("b", np.r_[good, -bad.sum(0)] * n, np.r_[t, z])
            step("r", np.r_[gx * self.c[0], gx * self.c[1]] * n, np.r_[u, v])

    def norms(self) -> np.ndarray:
        """The logarithm of the norm of every pair of context words.

        A score is a sum of two parts, so the norms of all pairs are one matrix product of exponentials.
        """
        one, two = (self.r * self.c[0]) @ self.q.T, (self.r * self.c[1]) @ self.q.T + self.b
        m1, m2 = one.max(1), two.max(1)
        one, two = np.exp(one - m1[:, None]).astype(np.float32), np.exp(two - m2[:, None]).astype(np.float32)
        return (np.log(one @ two.T) + m1[:, None] + m2).astype(np.float32)

    def log_shares(self, w: np.ndarray, c1: np.ndarray, c2: np.ndarray, norm: np.ndarray) -> np.ndarray:
        """Natural logarithm of the probability of every class of ``w`` behind its two context classes, in slices, so that memory stays small."""
        out = np.empty(len(w))
        for at in range(0, len(w), 1 << 16):
            s = slice(at, at + (1 << 16))
            x = self.r[c1[s]] * self.c[0] + self.r[c2[s]] * self.c[1]
            out[s] = np.einsum("ij,ij->i", x, self.q[w[s]]) + self.b[w[s]] - norm[c1[s], c2[s]]
        return out


def contexts(ids: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The class before and the one before that, of texts that begin at ``start``; before a text stands its end sign."""
    one, two = np.r_[END, ids[:-1]][: len(ids)], np.r_[END, END, ids[:-2]][: len(ids)]
    one[start] = two[start] = END
    second = start + 1
    two[second[second < len(ids)]] = END
    return one, two


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Class numbers of several texts behind each other, and where each begins. A text has its end sign at least."""
    size = np.fromiter(map(len, texts), np.int64, len(texts)) // 2
    return np.frombuffer(b"".join(texts), "<u2").astype(np.int64), np.cumsum(size) - size


class Classes:
    """The class of every word: 0 the end, then frequent words, then endings of all other words, then all other endings."""

    def __init__(self, head: dict[bytes, int], endings: dict[bytes, tuple[int, int]], ends: int, distinct: int, p: Params):
        """``head``: counts of frequent words; ``endings``: count and distinct words of every ending over all words; ``ends``: training texts."""
        size = max(1, round(p.spread * max(distinct, 1) ** 0.25))
        top = sorted(head, key=lambda w: (-head[w], w))[:size]
        self.n, self.word = p.ending, {w: i + 1 for i, w in enumerate(top)}
        left = {e: list(c) for e, c in endings.items()}
        for w in top:
            e = left[w[-self.n :]]
            e[0], e[1] = e[0] - head[w], e[1] - 1
        often = sorted((e for e in left if left[e][0] > 0), key=lambda e: (-left[e][0], e))[:size]
        self.first = len(top) + 1
        self.ending = {e: self.first + i for i, e in enumerate(often)}
        self.other = self.first + len(often)
        self.c, self.v = np.zeros(self.other + 1), np.zeros(self.other + 1)
        self.c[0] = ends
        for w, i in self.word.items():
            self.c[i] = head[w]
        for e, (c, v) in left.items():
            i = self.ending.get(e, self.other)
            self.c[i] += c
            self.v[i] += v
        #: Logarithm (base 10) of what a word's smoothed count is divided by in its class; 0 for classes of one word.
        self.inside = np.where(np.arange(self.other + 1) >= self.first, np.log10(self.c + 0.1 * (self.v + 1)), 0.0)

    def of(self, word: bytes) -> int:
        got = self.word.get(word)
        return got if got is not None else self.ending.get(word[-self.n :], self.other)

    def shares(self) -> np.ndarray:
        """Share of every class, smoothed so that none is 0."""
        x = self.c + 0.1 * np.where(np.arange(len(self.c)) >= self.first, self.v + 1, 1)
        return x / x.sum()


def lm_scores(docs: DataFrame, is_training, p: Params = Params(), text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Scores every whole text with a model learnt from the rows for which ``is_training`` (a Column) holds.

    Every text is its words (A-Z in lower case) and one end. Frequent words are classes of their own, all others, known
    or not, belong to the class of their ending; the network gives the probability of a class behind two classes, and a
    word of an ending has its smoothed share of the ending's counts, an unknown word that of count 0. So the
    probabilities of all words and one unknown word an ending sum to 1. Classes grow with the distinct words. Returns
    the id column, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` (unigram, add 0.1) and
    ``score`` (both log10). Null text is empty: one token, the end. Repeated rows each get their score. Very long texts
    are scored whole. Without training rows the model is the smoothed unigram. Empty table: no rows. Other columns are
    not read.

    Counts cover all training texts and never leave the executors but for the ``head`` most frequent words and the sums
    of endings (at most 256 to the power of their bytes); texts become arrays of class numbers, written once. Rare words
    are joined to their counts by a shuffle. Training texts are dealt by a hash of id and text to rounds and groups of
    about ``group`` tokens, and sorted by it; each group is one task that trains from the round's start, and parameters
    are averaged over a round's groups. So the model depends on the rows, not on how files are split or on the tasks.
    """
    spark = ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"), (~is_training).alias("held_out"))
    train = rows.where("not held_out")
    counts = stash(unigrams(train), "counts")
    sums = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    ends = train.count()
    total, distinct = int(sums["n"] or 0) + ends, int(sums["v"]) + (ends > 0)
    step = F.floor(F.log2(F.col("c").cast("double")) * 16)
    sizes = sorted(counts.groupBy(step.alias("s")).count().collect(), key=lambda r: -r["s"])
    held, least = 0, None
    for r in sizes:
        if held + r["count"] > p.head:
            break
        held, least = held + r["count"], r["s"]
    head = {bytes(r["word"]): r["c"] for r in counts.where(step >= least).collect()} if least is not None else {}
    ending = F.expr(f"substring(word, greatest(octet_length(word) - {p.ending}, 0) + 1, {p.ending})")
    endings = {bytes(r["e"]): (r["c"], r["v"]) for r in counts.groupBy(ending.alias("e")).agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()}
    classes = Classes(head, endings, ends, distinct, p)
    net = Network(p, classes.shares())
    code = spark.sparkContext.broadcast((classes, head))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_in_worker()
        classes, head = code.value
        facts = {w: (classes.of(w), math.log10(c + 0.1)) for w, c in head.items()}
        log_end = math.log10(ends + 0.1)
        for whole in batches:
            for b in sliced(whole, "text"):
                out: list[list] = [[] for _ in range(6)]
                for t in b.column("text").to_pylist():
                    words = tokens_of(t)
                    base, mid, n, rare, at = log_end, 0.0, int(ends > 0), [], {}
                    for w, k in Counter(words).items():
                        f = facts.get(w)
                        if f is None:
                            rare.append({"word": w, "k": k})
                            at[w] = classes.of(w)
                        else:
                            at[w] = f[0]
                            base += k * f[1]
                            n += k
                            if f[0] >= classes.first:
                                mid += k * f[1]
                    ids = np.fromiter(map(at.__getitem__, words), "<u2", len(words))
                    for o, x in zip(out, (len(words) + 1, n, base, mid, ids.tobytes() + b"\0\0", rare)):
                        o.append(x)
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.list_(pa.struct([("word", pa.binary()), ("k", pa.int64())]))]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("row", "id", "held_out", "h")), *(pa.array(o, k) for o, k in zip(out, kinds))], names)

    names = ["row", "id", "held_out", "h", "n_tokens", "n_head", "base", "mid", "ids", "rare"]
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"row long, id {kind}, held_out boolean, h long, n_tokens long, n_head long, base double, mid double, ids binary, rare array<struct<word: binary, k: long>>"
    numbered = rows.withColumns({"row": F.monotonically_increasing_id(), "h": F.xxhash64(F.col("id").cast("string"), "text")})
    coded = stash(numbered.select("row", "id", "held_out", "h", "text").mapInArrow(encode, schema), "coded")
    if ends:
        train_rounds(net, coded, total)
    norms = net.norms()
    net.past = {}
    final = spark.sparkContext.broadcast((net, norms, classes.inside))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, norm, inside = final.value
        for whole in batches:
            for b in sliced(whole, "ids", 1_000_000):
                w, start = joined(b.column("ids").to_pylist())
                per = net.log_shares(w, *contexts(w, start), norm) / math.log(10) - inside[w]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(np.add.reduceat(per, start))], [*keep, "lp"])

    keep = ["row", "id", "held_out", "n_tokens", "n_head", "base", "mid"]
    scored = coded.select(*keep, "ids").mapInArrow(score, f"row long, id {kind}, held_out boolean, n_tokens long, n_head long, base double, mid double, lp double")
    rare = coded.select("row", F.explode("rare").alias("r")).select("row", F.col("r.word").alias("word"), F.col("r.k").alias("k"))
    rare = rare.join(counts.where(step < least) if least is not None else counts, "word", "left")
    rare = rare.groupBy("row").agg(F.sum(F.col("k") * F.log10(F.coalesce("c", F.lit(0)) + 0.1)).alias("rare_log"), F.sum(F.when(F.col("c").isNotNull(), F.col("k")).otherwise(0)).alias("rare_known"))
    out = scored.join(rare, "row", "left")
    log_n = math.log10(total + 0.1 * (distinct + 1))
    low = F.coalesce("rare_log", F.lit(0.0))
    return out.select(
        F.col("id").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("n_head") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + low - F.col("n_tokens") * log_n).alias("base_score"),
        (F.col("lp") + F.col("mid") + low).alias("score"),
    )


def train_rounds(net: Network, coded: DataFrame, tokens: int) -> None:
    """Trains the network on the rows that are not held out: ``rounds`` rounds over disjoint texts, each averaged over its groups, weighted by tokens."""
    p, spark = net.p, coded.sparkSession
    groups = max(1, round(tokens / (p.rounds * p.group)))
    dealt = coded.where("not held_out").select("ids", "h", F.pmod("h", F.lit(p.rounds)).alias("round"), F.pmod(F.xxhash64("h"), F.lit(groups)).alias("group"))
    for k in range(p.rounds):
        shipped = spark.sparkContext.broadcast(net.flat())

        def learn(batches: Iterator[pa.RecordBatch], k: int = k) -> Iterator[pa.RecordBatch]:
            mine, seen, last, rng = Network(p, net.share), 0, None, None
            held: list[bytes] = []

            def flush() -> int:
                w, start = joined(held)
                mine.train(w, *contexts(w, start), rng)
                held.clear()
                return len(w)

            def result() -> pa.RecordBatch:
                x = mine.flat()
                at = np.arange(0, len(x), 64)
                parts = [x[i : i + 64] * float(seen) for i in at]
                return pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.full(len(at), seen)), pa.array(parts, pa.list_(pa.float64()))], ["at", "seen", "x"])

            for b in batches:
                for group, ids in zip(b.column("group").to_pylist(), b.column("ids").to_pylist()):
                    if group != last:
                        if last is not None:
                            seen += flush() if held else 0
                            yield result()
                        mine.load(shipped.value)
                        last, seen, size, rng = group, 0, 0, np.random.default_rng([p.seed, k, group])
                    held.append(ids)
                    size += len(ids)
                    if size > 1 << 19:
                        seen += flush()
                        size = 0
            if last is not None:
                seen += flush() if held else 0
                yield result()

        part = dealt.where(F.col("round") == k).repartition(groups, "group").sortWithinPartitions("group", "h")
        got = part.select("group", "ids").mapInArrow(learn, "at long, seen long, x array<double>")
        means = got.select("at", "seen", F.posexplode("x").alias("i", "v")).groupBy((F.col("at") + F.col("i")).alias("at")).agg((F.sum("v") / F.sum("seen")).alias("v"))
        new = means.toPandas()
        if len(new):
            net.load(new.sort_values("at")["v"].to_numpy())
        shipped.unpersist()


def is_training(doc_id) -> object:
    return crc32_of_id(doc_id) % 10 != 0
