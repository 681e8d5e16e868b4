"""Operator 10, quality rules by repetition coverage: rolling hashes of several n-gram lengths in numpy."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import WORD, kept_in_worker, ship, sliced, texts_of
from .words import mixed

_WORD = re.compile(WORD)
_SYMBOLS = "#*$%&|<>"
#: Largest share of word characters inside repeated n-grams (second and later occurrences), by n.
LIMITS = {5: 0.20, 6: 0.19, 8: 0.17, 10: 0.15}
LINE_LIMIT = 0.30
WINDOW = 8
_BASE = np.uint64(0x9E3779B97F4A7C15)


def rolling(words: np.ndarray, lengths: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """Polynomial hashes of every window of each length, joined from windows of powers of two."""
    powers, hashes, n = {1: _BASE}, {1: words}, 1
    while 2 * n <= max(lengths):
        h = hashes[n]
        hashes[2 * n] = h[: len(h) - n] * powers[n] + h[n:] if len(h) > n else h[:0]
        powers[2 * n] = np.uint64(int(powers[n]) ** 2 & 0xFFFFFFFFFFFFFFFF)
        n *= 2
    for length in lengths:
        got, at = None, 0
        for part in (1 << k for k in range(length.bit_length() - 1, -1, -1) if length >> k & 1):
            h = hashes[part]
            if got is None:
                got = h
            else:
                h = h[at:]
                m = min(len(got), len(h))
                got = got[:m] * powers[part] + h[:m]
            at += part
        yield length, got


def repeats(key: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of windows found twice or more in one text, and whether each is a second or later occurrence."""
    m = len(key)
    if not m:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    inside = doc[:m] == doc[n - 1 : n - 1 + m]
    at = np.flatnonzero(inside)
    k = mixed(key[at] + doc[at].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    s = np.sort(k)
    twice = np.unique(s[1:][s[1:] == s[:-1]])
    if not len(twice):
        return at[:0], np.zeros(0, bool)
    found = np.searchsorted(twice, k)
    hit = twice[np.minimum(found, len(twice) - 1)] == k
    at, group = at[hit], found[hit]
    order = np.argsort(group, kind="stable")
    later = np.ones(len(at), bool)
    first = np.r_[True, group[order][1:] != group[order][:-1]]
    later[order[first]] = False
    return at, later


def covered(starts: np.ndarray, n: int, total: int) -> np.ndarray:
    edge = np.zeros(total + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + n, -1)
    return np.cumsum(edge[:-1]) > 0


def measure(texts: list[str]) -> dict[str, np.ndarray]:
    """The measures of every text, whole texts each."""
    words, counts, ids = [], [], {}
    for t in texts:
        w = _WORD.findall(t)
        counts.append(len(w))
        words += w
    n_words = np.array(counts, np.int64)
    doc = np.repeat(np.arange(len(texts)), n_words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    x = mixed(np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.uint64, len(words)) + np.uint64(1))
    of = lambda flag, weight=None: np.bincount(doc[flag], None if weight is None else weight[flag], len(texts))
    everywhere = np.ones(len(words), bool)
    out = {"n_words": n_words, "word_chars": of(everywhere, size).astype(np.int64)}
    out["n_symbols"] = np.array([sum(map(t.count, _SYMBOLS)) for t in texts], np.int64)
    share = lambda chars: np.where(out["word_chars"] > 0, chars / np.maximum(out["word_chars"], 1), 0.0)
    for n, key in rolling(x, sorted({*LIMITS, WINDOW})):
        at, later = repeats(key, doc, n)
        if n == WINDOW:
            out["n_repeat_words"] = of(covered(at, n, len(words))).astype(np.int64)
        if n in LIMITS:
            out[f"cover_{n}"] = share(of(covered(at[later], n, len(words)), size))
    lines, chars = [], []
    for t in texts:
        seen, n, c = set(), 0, 0
        for line in t.split("\n"):
            if line in seen:
                n, c = n + 1, c + sum(map(len, _WORD.findall(line)))
            elif _WORD.search(line):
                seen.add(line)
        lines.append(n)
        chars.append(c)
    out["n_dup_lines"], out["cover_lines"] = np.array(lines, np.int64), share(np.array(chars, float))
    out["base_failed"] = (n_words < 20) | (100 * out["n_repeat_words"] > 30 * n_words)
    good = out["cover_lines"] <= LINE_LIMIT
    for n, most in LIMITS.items():
        good &= out[f"cover_{n}"] <= most
    out["kept"] = ~out["base_failed"] & good
    return out


_COLUMNS = [("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"), ("n_repeat_words", "long")]
_COVERS = [*(f"cover_{n}" for n in LIMITS), "cover_lines"]


def repetition(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Repetition measures and a verdict for every row.

    For each n of ``LIMITS`` the share of word characters inside n-grams that occur earlier in the same text, and the
    share inside lines equal to an earlier line; ``kept`` is false if the base rules fail (under 20 words, or over 30 %
    of words in repeated windows of 8) or a share is over its limit. Null or empty text: no words, all measures 0, base
    failed. Very long texts are measured whole. Repeated rows and ties get equal results. Empty table: no rows. Other
    columns are not read. No shuffle: one pass of Arrow batches, cut into slices of a few MB, so memory is bounded by
    the longest text.
    """
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = ", ".join([f"`{id_col}` {kind}", *(f"{c} {k}" for c, k in _COLUMNS), "base_failed boolean", "kept boolean", *(f"{c} double" for c in _COVERS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_in_worker()
        for whole in batches:
            for b in sliced(whole, "text"):
                got = measure(texts_of(b, "text"))
                names = [*(c for c, _ in _COLUMNS), "base_failed", "kept", *_COVERS]
                yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array(got[c]) for c in names)], [id_col, *names])

    return docs.selectExpr(f"`{id_col}` as id", f"`{text}` as text").mapInArrow(run, schema)
