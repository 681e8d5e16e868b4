"""Operator 13, best-fit packing: length patterns fitted to the histogram by non-negative least squares, residuals packed by best fit."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .bpe import Coder, load_vocabulary
from .common import kept_in_worker, release, ship, sliced, stash, texts_of

#: Classes of lengths that patterns are fitted by, and documents of a pattern at most.
CLASSES, PARTS = 128, 3
#: Runs without white space whose ids a Python worker keeps at most, some 300 bytes each.
CACHED = 700_000


# --- the plan, from a histogram of at most ``capacity`` lengths -------------------------------------------------


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The x >= 0 that brings a @ x nearest to b, by active sets: as many entries above 0 as b has at most."""
    x, free = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    tired = 1e-10 * max(1.0, float(np.abs(a.T @ b).max(initial=0.0)))
    for _ in range(6 * len(b)):
        slope = a.T @ (b - a @ x)
        slope[free] = -np.inf
        if free.sum() >= len(b) or slope.max(initial=-np.inf) <= tired:
            break
        free[slope.argmax()] = True
        while True:
            s = np.zeros_like(x)
            s[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            low = free & (s <= 0)
            if not low.any():
                break
            x += (x[low] / np.maximum(x[low] - s[low], 1e-300)).min() * (s - x)
            free &= x > 1e-12
            x[~free] = 0.0
        x = s
    return x


def patterns(capacity: int, grain: int, present: np.ndarray, parts: int = PARTS) -> list[tuple[int, ...]]:
    """Classes (numbers from 1, ``grain`` lengths each) of two to ``parts`` documents whose lengths can fill ``capacity`` exactly in more than one way; ``present``: classes that occur."""
    some = np.flatnonzero(present).tolist()
    out = []
    for p in range(2, parts + 1):
        for head in combinations_with_replacement(some, p - 1):
            # the last class lies where sums of lengths reach the capacity: (sum - p) * grain + p <= capacity < sum * grain
            low, high = capacity // grain + 1 - sum(head), (capacity - p) // grain + p - sum(head)
            out += [(*head, k) for k in range(max(low, head[-1]), high + 1) if k < len(present) and present[k]]
    return out


def fitted(hist: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of classes with whole repeat counts, the most repeated first: least squares over the tokens of each class, rounded."""
    grain = -(-capacity // CLASSES)
    cls = -(-np.arange(len(hist)) // grain)
    h = np.bincount(cls[:capacity], hist[:capacity], cls[-1] + 1)
    pool = patterns(capacity, grain, h > 0)
    if not pool:
        return []
    a = np.zeros((len(h), len(pool)))
    for k, p in enumerate(pool):
        np.add.at(a[:, k], list(p), 1)
    weight = np.arange(len(h)) / len(h)
    x = np.rint(nnls(a * weight[:, None], h * weight / h.sum()) * h.sum()).astype(np.int64)
    return sorted(((pool[k], int(x[k])) for k in np.flatnonzero(x)), key=lambda r: (-r[1], r[0]))


def realised(pattern: tuple[int, ...], count: int, left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Lengths of a pattern's classes that fill the capacity exactly, with how often, taken off ``left``; at most ``count`` in all."""
    grain = -(-capacity // CLASSES)
    out = []

    def lengths(c: int) -> list[int]:
        return [n for n in range(min(c * grain, capacity - 1), (c - 1) * grain, -1) if left[n]]

    def go(k: int, chosen: tuple[int, ...]) -> None:
        nonlocal count
        if k < len(pattern) - 1:
            for n in lengths(pattern[k]):
                if count and left[n] > chosen.count(n):
                    go(k + 1, (*chosen, n))
            return
        n = capacity - sum(chosen)
        if not (pattern[k] - 1) * grain < n <= pattern[k] * grain or n >= capacity:
            return
        whole = (*chosen, n)
        times = min(count, *(int(left[m]) // whole.count(m) for m in whole))
        if times > 0:
            for m in whole:
                left[m] -= times
            count -= times
            out.append((whole, times))

    go(0, ())
    return out


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Best-fit decreasing over a histogram: sequences of equal content are one entry, so work grows with the lengths and not with the documents.

    Returns contents ((length, copies), ...) with how many sequences hold them.
    """
    open_: list[list[list]] = [[] for _ in range(capacity + 1)]  # by space left: [content, number]
    for n in np.flatnonzero(left)[::-1].tolist():
        r = int(left[n])
        space = n
        while r:
            while space < capacity and not open_[space]:
                space += 1
            content, number = open_[space].pop() if open_[space] else ((), r)
            k = min(space // n, r)
            used = min(number, r // k)
            if number > used and content:
                open_[space].append([content, number - used])
            open_[space - k * n].append([(*content, (n, k)), used])
            r -= k * used
    return [(content, number) for entries in open_ for content, number in entries]


@dataclass
class Plan:
    """Where the documents of each length go: from ``start`` on in the order of length and rank, ``copies`` to a sequence, the first to ``sequence`` at ``offset``."""

    base: np.ndarray
    start: np.ndarray
    copies: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int
    exact: int

    def places(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self.base[length] + rank
        k = np.searchsorted(self.start, at, "right") - 1
        nth = at - self.start[k]
        return self.sequence[k] + nth // self.copies[k], self.offset[k] + nth % self.copies[k] * length


def plan(hist: np.ndarray, capacity: int) -> Plan:
    """Packs the documents of a histogram (how many of each length, 0 to ``capacity``): full ones alone, fitted patterns as far as lengths fill them exactly, the rest by best fit."""
    left = np.array(hist, np.int64)
    rows = [(((capacity, 1),), int(left[capacity]))] if left[capacity] else []
    left[capacity] = 0
    for pattern, count in fitted(left, capacity):
        rows += [(tuple((n, 1) for n in lengths), times) for lengths, times in realised(pattern, count, left, capacity)]
    exact = sum(times for _, times in rows)
    rows += best_fit(left, capacity)
    base = np.cumsum(hist) - hist
    used, at, sequence = base.copy(), [], 0
    for content, times in rows:
        offset = 0
        for n, copies in content:
            at.append((used[n], copies, sequence, offset))
            used[n] += times * copies
            offset += n * copies
        sequence += times
    table = np.array(sorted(at), np.int64).reshape(-1, 4)
    return Plan(base, *table.T.copy(), sequence, exact)


# --- the documents ----------------------------------------------------------------------------------------------


def pieces(docs: DataFrame, path: str, capacity: int, text: str, id_col: str) -> DataFrame:
    """Every document's ids and a closing 0, cut into pieces of ``capacity``: ``id``, ``piece``, ``start``, ``length``, ``ids_crc32``, and which piece of its length (``nth``) of which task (``part``) it is."""
    shipped = ship(docs.sparkSession).sparkContext.broadcast(load_vocabulary(path))
    key = uuid.uuid4().hex
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["id", "piece", "start", "length", "ids_crc32", "part", "nth"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = kept_in_worker(key, lambda: Coder(shipped.value, most_cached=CACHED))
        part, seen, width = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64), 4 * capacity
        for whole in batches:
            for b in sliced(whole, "text"):
                row, start, size, crc = [], [], [], []
                for i, chunks in enumerate(coder.split_batch(texts_of(b, "text"))):
                    raw = coder.packed(chunks) + b"\0\0\0\0"
                    for k in range(0, len(raw), width):
                        piece = raw[k : k + width]
                        row.append(i)
                        start.append(k // 4)
                        size.append(len(piece) // 4)
                        crc.append(zlib.crc32(piece))
                length = np.array(size, np.int64)
                order = np.argsort(length, kind="stable")
                ranked = length[order]
                nth = np.empty(len(length), np.int64)
                nth[order] = np.arange(len(length)) - np.searchsorted(ranked, ranked) + seen[ranked]
                seen += np.bincount(length, minlength=capacity + 1)
                starts = np.array(start, np.int64)
                columns = [b.column("id").take(pa.array(row, pa.int64())), (starts // capacity).astype(np.int32), starts, length, np.array(crc, np.int64), np.full(len(row), part, np.int32), nth]
                yield pa.RecordBatch.from_arrays([columns[0], *map(pa.array, columns[1:])], names)

    return docs.selectExpr(f"`{id_col}` as id", f"`{text}` as text").mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long, part int, nth long")


def pack(docs: DataFrame, path: str, capacity: int = 2048, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Packs the token ids of every document, each closed by id 0, into sequences of at most ``capacity`` tokens.

    Documents longer than that are cut into full pieces and a last, shorter one; no other is. The histogram of lengths
    (at most ``capacity`` numbers) is fitted by patterns of two or three documents that fill a sequence exactly: least
    squares over classes of lengths give whole repeat counts, which lengths of those classes then realise. What no
    pattern takes is packed by best-fit decreasing, on the histogram too. Pieces of a length are alike to the plan, so
    each takes the place that its rank among them has.

    Returns the id column, ``piece`` (int), ``start``, ``length``, ``ids_crc32`` (of the ids as little-endian unsigned
    32-bit numbers), ``sequence_id`` (long, gapless) and ``offset``. Null and empty texts are one token, the closing
    one. Very long texts are encoded whole. Repeated rows are packed each. Reruns over the same files agree. Empty table:
    no rows. Other columns are not read.

    Cost: one pass over the texts; what is kept of a piece are seven numbers. Ranks are places within a task's output
    and sums of counts per task and length. The plan is made on the driver from the histogram alone and broadcast; its
    size is bounded by ``capacity``, whatever the number of documents.
    """
    rows = stash(pieces(docs, path, capacity, text, id_col), "pieces")
    counts = rows.groupBy("part", "length").agg(F.count("*").alias("k"))
    counts = stash(counts.select("part", "length", "k", (F.sum("k").over(W.partitionBy("length").orderBy("part")) - F.col("k")).alias("before")), "counts")
    hist = np.zeros(capacity + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("k").alias("k")).collect():
        hist[r["length"]] = r["k"]
    shipped = docs.sparkSession.sparkContext.broadcast(plan(hist, capacity))
    kind = docs.schema[id_col].dataType.simpleString()
    out = ["id", "piece", "start", "length", "ids_crc32"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            sequence, offset = shipped.value.places(length, rank)
            yield pa.RecordBatch.from_arrays([*map(b.column, out), pa.array(sequence), pa.array(offset)], [id_col, *out[1:], "sequence_id", "offset"])

    ranked = rows.join(counts.drop("k"), ["part", "length"]).select(*out, (F.col("before") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(place, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
