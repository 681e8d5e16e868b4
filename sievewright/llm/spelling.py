"""Operator 12, spelling variant grouping: search schemes of one error over bidirectional FM-indexes of a delimited vocabulary."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept_in_worker, release, ship, sliced, stash

#: Least code points and least occurrences of a word, and every how manieth run loses a code point.
LEAST_LENGTH, LEAST_COUNT, DAMAGED = 5, 3, 97
#: Words of a shard's index, about, and of a block of a half that very many words share.
SHARD, BLOCK = 60_000, 30_000
_RUN = re.compile("[a-zÀ-ÿ]+")
_OUTSIDE = re.compile("[^a-zÀ-ÿ]")
_BITS = 7
_CODES = np.zeros(256, np.uint8)
_CODES[ord("a") : ord("z") + 1] = np.arange(1, 27)
_CODES[0xC0:] = np.arange(27, 91)


# --- the vocabulary ---------------------------------------------------------------------------------------------


def runs_of(text: str, window: int = 1_000_000) -> Counter:
    """Runs of letters of a text, A-Z in lower case, with their numbers. Long texts are read window by window, cut where no letter stands."""
    low, out, start = text.encode("utf-8").lower().decode("utf-8"), Counter(), 0
    while start < len(low):
        cut = _OUTSIDE.search(low, start + window) if len(low) - start > window else None
        end = cut.start() if cut else len(low)
        out.update(_RUN.findall(low, start, end))
        start = end
    return out


def spelt(run: str, doc: int, every: int) -> str:
    """The run as its document spells it: one code point is missing where ``every`` divides the CRC-32 of id and run. ``doc``: CRC-32 of the id and a colon."""
    h = zlib.crc32(run.encode("utf-8"), doc)
    return run[: (k := h % len(run))] + run[k + 1 :] if h % every == 0 else run


def vocabulary(docs: DataFrame, text: str = "text", id_col: str = "doc_id", every: int = DAMAGED) -> DataFrame:
    """``word`` and ``n``: words of at least ``LEAST_LENGTH`` code points and ``LEAST_COUNT`` occurrences in all texts. Tasks add up what they read before anything moves."""
    ship(docs.sparkSession)

    def flush(total: dict[str, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_in_worker()
        total: dict[str, int] = {}
        for whole in batches:
            for b in sliced(whole, "text"):
                for doc, value in zip(b.column("id").to_pylist(), b.column("text").to_pylist()):
                    start = zlib.crc32(f"{doc or ''}:".encode())
                    for r, k in runs_of(value or "").items():
                        if len(r) >= LEAST_LENGTH and len(w := spelt(r, start, every)) >= LEAST_LENGTH:
                            total[w] = total.get(w, 0) + k
                if len(total) > 200_000:
                    yield flush(total)
                    total = {}
        yield flush(total)

    found = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text).alias("text")).mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


# --- the index --------------------------------------------------------------------------------------------------


def rotations(codes: np.ndarray) -> np.ndarray:
    """Places of the rotations of a text in their order, by doubling: eight codes at once, then twice as many in each round."""
    n = len(codes)
    key = np.zeros(n, np.int64)
    for k in range(8):
        key = (key << _BITS) | np.roll(codes, -k)
    width = 8
    while True:
        order = np.argsort(key, kind="stable")
        new = np.ones(n, bool)
        new[1:] = key[order[1:]] != key[order[:-1]]
        if new.all() or width >= 2 * n:
            return order
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new) - 1
        key, width = rank * n + np.roll(rank, -width), width * 2


class Ranks:
    """A wavelet matrix over the letters before the rotations of a text: how often each letter stands before a place, and how many smaller ones in a range."""

    def __init__(self, codes: np.ndarray, order: np.ndarray):
        self.levels = []
        at = codes[order - 1].astype(np.uint8)
        counts = np.bincount(codes, minlength=1 << _BITS)
        for bit in range(_BITS - 1, -1, -1):
            one = ((at >> bit) & 1).astype(bool)
            ones = np.zeros(len(at) + 1, np.int32)
            np.cumsum(one, out=ones[1:])
            self.levels.append((bit, ones, len(at) - int(ones[-1])))
            at = np.concatenate([at[~one], at[one]])
        # from a place among the letters sorted by their reversed bits to one among the rotations
        every, base = np.arange(1 << _BITS), np.zeros(1 << _BITS, np.int64)
        for bit, ones, zeros in self.levels:
            base = np.where((every >> bit) & 1, zeros + ones[base], base - ones[base])
        self.shift = np.cumsum(counts) - counts - base

    def step(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ranges of rotations that begin with ``c`` before those of [lo, hi), and how many of these have a smaller letter before them."""
        smaller = np.zeros(len(lo), np.int64)
        for bit, ones, zeros in self.levels:
            up = ((c >> bit) & 1).astype(bool)
            a, b = ones[lo], ones[hi]
            smaller += np.where(up, (hi - lo) - (b - a), 0)
            lo, hi = np.where(up, zeros + a, lo - a), np.where(up, zeros + b, hi - b)
        return lo + self.shift[c], hi + self.shift[c], smaller

    def letters(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``step`` for every letter that occurs before the rotations of each range: number of the range, letter, and what ``step`` gives."""
        of, c, smaller = np.arange(len(lo)), np.zeros(len(lo), np.int64), np.zeros(len(lo), np.int64)
        for _, ones, zeros in self.levels:
            a, b = ones[lo], ones[hi]
            low, high = np.flatnonzero(hi - b > lo - a), np.flatnonzero(b > a)
            left = (hi - lo) - (b - a)
            smaller = np.concatenate([smaller[low], (smaller + left)[high]])
            of, c = np.concatenate([of[low], of[high]]), np.concatenate([c[low] << 1, (c[high] << 1) | 1])
            lo, hi = np.concatenate([(lo - a)[low], (zeros + a)[high]]), np.concatenate([(hi - b)[low], (zeros + b)[high]])
        return of, c, lo + self.shift[c], hi + self.shift[c], smaller


def coded(words: list[str], width: int | None = None, back: bool = False, end: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Codes of words, a row each, filled up with 0, and their lengths; ``back``: from the end, ``end``: with the delimiter (0) counted behind."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    out = np.zeros((len(words), int(sizes.max(initial=0)) + 1), np.int64)
    flat = _CODES[np.frombuffer("".join(words).encode("latin-1"), np.uint8)]
    row = np.repeat(np.arange(len(words)), sizes)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[row, np.repeat(sizes, sizes) - 1 - at if back else at] = flat
    return out, sizes + end


class Index:
    """A bidirectional FM-index over sorted distinct words, a delimiter before each, read as a circle.

    A match is a triple: the first rotation of the text that begins with it, the first rotation of the text read
    backwards that begins with it backwards, and how many there are. Either side of a match can be extended by a letter;
    the interval on the other side follows from how many smaller letters stand there.
    """

    def __init__(self, words: list[str]):
        self.words = words
        text, sizes = coded(words, end=True)
        live = np.arange(text.shape[1])[None] < sizes[:, None]
        codes = np.roll(text[live], 1)  # the delimiter before each word
        self.starts = np.cumsum(sizes) - sizes
        self.order = rotations(codes)
        self.before = Ranks(codes, self.order)
        self.after = Ranks(codes[::-1], rotations(codes[::-1]))
        self.n = len(codes)

    def extended(self, at: np.ndarray, c: np.ndarray, left: bool) -> np.ndarray:
        """Matches (rows: first, first backwards, number) with one letter more on one side; number 0 if none is left."""
        near, far = (0, 1) if left else (1, 0)
        lo, hi, smaller = (self.before if left else self.after).step(c, at[near], at[near] + at[2])
        out = np.empty_like(at)
        out[near], out[far], out[2] = lo, at[far] + smaller, hi - lo
        return out

    def branches(self, at: np.ndarray, left: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All matches with one letter more on one side: number of the match they come from, letter, match."""
        near, far = (0, 1) if left else (1, 0)
        of, c, lo, hi, smaller = (self.before if left else self.after).letters(at[near], at[near] + at[2])
        out = np.empty((3, len(of)), np.int64)
        out[near], out[far], out[2] = lo, at[far][of] + smaller, hi - lo
        return of, c, out

    def search(self, halves: list[str], others: list[str], first: bool) -> tuple[np.ndarray, np.ndarray]:
        """Words that hold one half of a query at its end of the word and differ from the other half by exactly one error.

        ``first``: ``halves`` are beginnings, else endings. The half is matched from the middle of the query out to the
        delimiter; then the search turns and goes across the other half to the other delimiter. Returns the query's
        and the word's number of each find, once.
        """
        exact, n_exact = coded(halves, back=first, end=True)
        rest, n_rest = coded(others, back=not first, end=False)
        q = np.arange(len(halves))
        at = np.zeros((3, len(q)), np.int64)
        at[2] = self.n
        for j in range(exact.shape[1]):
            go = j < n_exact[q]
            if not go.all():  # a query whose half is matched stands still
                at[:, go] = self.extended(at[:, go], exact[q[go], j], left=first)
            else:
                at = self.extended(at, exact[q, j], left=first)
            live = at[2] > 0
            q, at = q[live], at[:, live]
        found, waiting, held = [], [], 0
        for j in range(rest.shape[1] + 1):
            if not len(q):
                break
            here = j < n_rest[q]
            want = np.where(here, rest[q, min(j, rest.shape[1] - 1)], -1)
            of, c, to = self.branches(at, left=not first)
            letter = (c != 0) & (c != want[of])
            # another letter in place of the wanted one; a letter more; the wanted one left out, the last of equal ones
            swap, drop = letter & here[of], here & ~((j + 1 < n_rest[q]) & (rest[q, min(j + 1, rest.shape[1] - 1)] == want))
            for rows, matches, k in ((q[of[swap]], to[:, swap], j + 1), (q[of[letter]], to[:, letter], j), (q[drop], at[:, drop], j + 1)):
                waiting.append((rows, matches, np.full(len(rows), k)))
                held += len(rows)
            if held > 500_000:
                found.append(self.ended(waiting, rest, n_rest, first))
                waiting, held = [], 0
            on = (c == want[of]) & here[of]
            q, at = q[of[on]], to[:, on]
        found.append(self.ended(waiting, rest, n_rest, first))
        pairs = np.unique(np.concatenate(found))
        return pairs // len(self.words), pairs % len(self.words)

    def ended(self, waiting: list, rest: np.ndarray, n_rest: np.ndarray, first: bool) -> np.ndarray:
        """Matches that have had their error go on exactly to the delimiter; query * words + word of those that arrive."""
        if not waiting:
            return np.zeros(0, np.int64)
        q, at, j = (np.concatenate([w[k] for w in waiting], axis=-1) for k in range(3))
        out = []
        while len(q):
            last = j == n_rest[q]
            at = self.extended(at, np.where(last, 0, rest[q, np.minimum(j, rest.shape[1] - 1)]), left=not first)
            live = at[2] > 0
            done = live & last
            word = np.searchsorted(self.starts, self.order[at[0][done]])
            out.append(q[done] * len(self.words) + word)
            live &= ~last
            q, at, j = q[live], at[:, live], j[live] + 1
        return np.concatenate(out) if out else np.zeros(0, np.int64)


# --- shards -----------------------------------------------------------------------------------------------------


def searched(shard: pa.Table, most: int = 20_000) -> pa.Table:
    """What the index of one shard finds for the queries dealt to it: per query ``word``, ``n_near``, ``best_n`` and ``best``."""
    rows = shard.to_pandas()
    known = rows[~rows["query"]].drop_duplicates("word").sort_values("word")
    asked = rows[rows["query"]].sort_values("word", key=lambda s: s.str.len())
    out = []
    if len(known) and len(asked):
        index, n = Index(known["word"].tolist()), known["n"].to_numpy()
        cut = asked["blocks"].max() > 1
        crc = np.fromiter((zlib.crc32(w.encode("utf-8")) for w in index.words), np.int64, len(n)) if cut else None
        for first in (True, False):
            side = asked[asked["side"] == ("p" if first else "s")]
            for k in range(0, len(side), most):
                part = side.iloc[k : k + most]
                words = part["word"].tolist()
                heads, tails = [w[: len(w) // 2] for w in words], [w[len(w) // 2 :] for w in words]
                q, v = index.search(heads if first else tails, tails if first else heads, first)
                good = np.ones(len(q), bool)
                if cut:  # a word stands in one block of a half, though other halves may bring it into this shard too
                    blocks = part["blocks"].to_numpy()[q]
                    good &= crc[v] % blocks == part["block"].to_numpy()[q]
                if not first:  # words that hold the first half too are found by it
                    good &= np.fromiter((not index.words[b].startswith(heads[a]) for a, b in zip(q.tolist(), v.tolist())), bool, len(q))
                q, v = q[good], v[good]
                best = np.lexsort((v, -n[v], q))
                at = np.flatnonzero(np.diff(q[best], prepend=-1))
                top = v[best][at]
                out.append(pa.table({"word": [words[i] for i in q[best][at]], "n_near": np.diff(at, append=len(q)), "best_n": n[top], "best": [index.words[i] for i in top]}, _FOUND))
    return pa.concat_tables(out) if out else _FOUND.empty_table()


_FOUND = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])


def _keys(side: str, cuts: list[Column], least: int) -> Column:
    """Halves of a word by how many code points they hold; cuts below those of the shortest word are left out."""
    word = F.col("word")
    half = lambda k: F.when(k >= least, F.concat(F.lit(side), F.left(word, k) if side == "p" else F.right(word, k)))
    return F.array_distinct(F.array_compact(F.array(*map(half, cuts))))


def dealt(words: DataFrame, shard: int, block: int) -> DataFrame:
    """Words as index entries and as queries, dealt to shards by the half that both share.

    Words that differ by one code point share the first or the second half of either, whose length may be that of a
    word one longer or shorter; so a word is an entry under up to two halves on each side, and a query under its own two.
    A half with more than ``block`` entries is cut into blocks by the entries' CRC-32, and asked in every block.
    """
    n = F.length("word")
    half = lambda x: F.floor(x / 2).cast("int")
    first, second = half(F.lit(LEAST_LENGTH)), half(F.lit(LEAST_LENGTH + 1))
    entries = F.concat(_keys("p", [half(n - 1), half(n), half(n + 1)], first), _keys("s", [half(n), half(n + 1), half(n + 2)], second))
    asked = F.concat(_keys("p", [half(n)], first), _keys("s", [half(n + 1)], second))
    rows = words.select("word", "n", F.explode(entries).alias("key"), F.lit(False).alias("query"))
    hot = rows.groupBy("key").count().where(F.col("count") > block).select("key", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    rows = rows.union(words.select("word", "n", F.explode(asked).alias("key"), F.lit(True)))
    rows = rows.join(hot, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.crc32(F.encode("word", "UTF-8")), "blocks").cast("int")
    rows = rows.withColumn("block", F.explode(F.when(F.col("query"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(own))))
    shards = max(1, -(-4 * words.count() // shard))
    return rows.select("word", "n", "query", F.left("key", F.lit(1)).alias("side"), "block", "blocks", F.pmod(F.xxhash64("key", "block"), F.lit(shards)).alias("shard"))


def near_words(words: DataFrame, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """``word``, ``n_near`` and the near word of largest n (ties: the smallest by code points), ``best`` and ``best_n``, of every word that has a near one."""
    ship(words.sparkSession)
    found = dealt(words, shard, block).groupBy("shard").applyInArrow(lambda t: searched(t), "word string, n_near long, best_n long, best string")
    top = F.min(F.struct((-F.col("best_n")).alias("m"), "best"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), top.alias("top")).select("word", "n_near", F.col("top.best").alias("best"), (-F.col("top.m")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """The last word that each word's forms lead to: ``word`` and ``root``. Forms (word, form) at least double n, so a walk is short; each round doubles what is walked."""
    now = stash(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = stash(now.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        release(now)
        now = after.drop("moved")
        now._stashed = after._stashed
        if after.where("moved").isEmpty():
            return now


def variants(docs: DataFrame, text: str = "text", id_col: str = "doc_id", every: int = DAMAGED, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """Every word of the texts with the form that it is probably a variant of.

    Words are runs of ``[A-Za-z\\u00C0-\\u00FF]``, A-Z in lower case, of at least 5 code points and 3 occurrences; where
    ``every`` divides the CRC-32 of ``<id>:<run>``, the run loses a code point first. Two words are near if they differ by
    exactly one inserted, deleted or replaced code point. A word's form is its near word of largest n (ties: smallest by
    code points), if that is at least twice the word's own; its root is the last word that forms lead to.

    Returns ``word``, ``n``, ``n_near``, ``form``, ``form_n`` and ``root``. Null and empty texts have no words; a null id
    counts as empty text. Very long texts are read window by window. Repeated rows count as often as they stand. Empty
    table: no rows. Other columns are not read.

    Cost: tasks count their own words before the shuffle. The vocabulary is dealt to shards by halves of words; each
    shard is one index of a bounded number of words, so memory does not grow with the vocabulary.
    """
    words = stash(vocabulary(docs, text, id_col, every), "words")
    near = stash(near_words(words, shard, block), "near")
    own = words.join(near, "word", "left").withColumn("good", F.coalesce(F.col("best_n") >= 2 * F.col("n"), F.lit(False)))
    forms = stash(own.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("good"), F.col("best")).alias("form"), F.when(F.col("good"), F.col("best_n")).alias("form_n")), "forms")
    release(words, near)
    return forms.join(roots(forms.where("form is not null")), "word", "left").withColumn("root", F.coalesce("root", "word"))
