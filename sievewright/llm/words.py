"""Words of many texts at once: places and hashes from the bytes of an Arrow column, in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LETTER = np.random.default_rng(1).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads small numbers over all bits."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> list[np.ndarray]:
    """The powers of the hash's step and of its inverse, at least n of each; kept for the next batch."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_STEP, _BACK)):
            x = np.full(n, base)
            x[0] = 1
            _POWERS[k] = np.multiply.accumulate(x)
    return _POWERS


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the place of each text's first byte, with the end after the last. Null is empty."""
    column = column.fill_null("") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Words of every text in order: a 64-bit hash of each word's bytes, and the number of words of each text.

    A word is a run of bytes other than blank and U+0009 to U+000D inside one text. Its hash is a polynomial over a
    random number per byte, taken as the difference of two running sums, then mixed.
    """
    raw, at = column_bytes(column)
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(at) - 1, np.int64)
    inside = ~_BLANK[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[at] = True
    before = np.r_[False, inside[:-1]]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.r_[inside[1:], False]
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    power, back = _powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_LETTER[raw] * power[: len(raw)], out=total[1:])
    h = mixed((total[end] - total[start]) * back[start] + (end - start).astype(np.uint64))
    return h, np.diff(np.searchsorted(start, at))
