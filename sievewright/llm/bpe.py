"""Operator 6, BPE encoding and decoding: speculate and verify.

Greedy longest match proposes the tokens of a word; a proposal is right if every token encodes to itself and every two
neighbours are compatible, that is, encoding their joined text gives these two again. Compatibility is tested for all
distinct pairs of a batch at once in numpy; words with a pair that fails are merged exactly.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
import unicodedata
from collections.abc import Iterable, Iterator, Sequence
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import kept_in_worker, ship, sliced, texts_of

NEVER = 1 << 40
#: Characters that str.split takes for white space and the split pattern does not.
_OTHER = re.compile(r"[\x1c-\x1f]")
_SPACE = regex.compile(r"\p{White_Space}+")


def byte_letters() -> list[str]:
    """The printable letter of each byte: printable Latin-1 stands for itself, the rest for U+0100 and on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    other = iter(range(256, 512))
    return [chr(b) if b in set(own) else chr(next(other)) for b in range(256)]


class Vocabulary:
    """A BPE vocabulary with merge ranks; read from a tokenizer file on the driver and shipped to the tasks."""

    def __init__(self, spec: dict):
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.ids: dict[str, int] = dict(model["vocab"])
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.names = {i: t for t, i in (*self.ids.items(), *self.special.items())}
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.split_lines = regex.compile(rf"\n|(?:{split})")
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        n = max(self.names) + 1
        self.left, self.right, self.rank = np.full(n, -1), np.full(n, -1), np.full(n, -1)
        for k, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            i, j, whole = self.ids[a], self.ids[b], self.ids[a + b]
            if (i, j) not in self.ranks:
                self.ranks[i, j] = (k, whole)
                if self.rank[whole] < 0:
                    self.left[whole], self.right[whole], self.rank[whole] = i, j, k
        codes = np.array([(a << 32) | b for a, b in self.ranks], np.int64)
        order = np.argsort(codes)
        self.codes, self.code_ranks = codes[order], np.array([r for r, _ in self.ranks.values()], np.int64)[order]
        #: Decimal form of every id; letter of every byte but the line end, which no word holds.
        self.numbers = {i: str(i) for i in self.names}
        self.letters = str.maketrans({chr(b): c for b, c in enumerate(byte_letters()) if b != 10})
        #: Symbol of every letter inside a word and at its end, or -1.
        self.symbol, self.last_symbol = (np.array([self.ids.get(chr(c) + e, -1) for c in range(512)], np.int64) for e in ("", self.end))
        #: Tokens that may be proposed: those that encode to themselves.
        self.open: dict[str, int] = {}
        for t, i in self.ids.items():
            parts = self.symbols(t.removesuffix(self.end) if self.end and t.endswith(self.end) and t != self.end else t, last=bool(self.end) and t.endswith(self.end))
            if parts is not None and self.merged(parts) == [i]:
                self.open[t] = i
        self.whole = np.zeros(len(self.ranks), np.int64)
        for k, (r, i) in enumerate(self.ranks.values()):
            self.whole[k] = i
        self.whole = self.whole[order]
        self.scanner: ahocorasick.Automaton | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"scanner": None}

    def proposals(self, text: str, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Greedy longest match over all words at once, which stand in ``text`` with a line end behind each at ``ends``: tokens, the word of each, and whether the words are covered to their end."""
        if self.scanner is None:
            self.scanner = ahocorasick.Automaton()
            for t, i in self.open.items():
                last = self.end and t.endswith(self.end) and t != self.end
                self.scanner.add_word(t.removesuffix(self.end) + "\n" if last else t, (i << 8) | (len(t) - len(self.end) + 1 if last else len(t)))
            self.scanner.make_automaton()
        got = np.fromiter(chain.from_iterable(self.scanner.iter_long(text)), np.int64).reshape(-1, 2)
        word = np.searchsorted(ends, got[:, 0])
        size = np.bincount(word, got[:, 1] & 255, len(ends)).astype(np.int64)
        return got[:, 1] >> 8, word, size == np.diff(ends, prepend=-1)

    def symbols(self, word: str, last: bool = True) -> list[int] | None:
        """Starting symbols of a word of byte letters; the last carries the word end. None: a symbol is not in the vocabulary."""
        parts = [*word[:-1], word[-1:] + (self.end if last else "")]
        got = [self.ids.get(p) for p in parts]
        return None if None in got else got

    def merged(self, parts: list[int]) -> list[int]:
        """Exact merging: the pair of the lowest rank first, leftmost of equals.

        Pairs wait in a heap and symbols in a linked list, so a word of n symbols takes about n log n steps. An entry of
        the heap whose pair has changed meanwhile is passed over.
        """
        parts, ranks, n = list(parts), self.ranks, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(ranks[p][0], i, p) for i, p in enumerate(zip(parts, parts[1:])) if p in ranks]
        heapq.heapify(heap)
        while heap:
            _, i, (x, y) = heapq.heappop(heap)
            j = after[i]
            if parts[i] != x or j >= n or parts[j] != y:
                continue
            parts[i], parts[j] = ranks[x, y][1], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (p := (parts[i], parts[k])) in ranks:
                    heapq.heappush(heap, (ranks[p][0], i, p))
            if (h := before[i]) >= 0 and (p := (parts[h], parts[i])) in ranks:
                heapq.heappush(heap, (ranks[p][0], h, p))
        return [x for x in parts if x >= 0]

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Place of each pair in the sorted merges, or -1."""
        code = (a << 32) | b
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[at] == code, at, -1)

    def merged_many(self, parts: np.ndarray) -> np.ndarray:
        """Exact merging of many words at once, one merge a word and step. Rows are words, filled up with -1."""
        parts, n = parts.copy(), parts.shape[1]
        if n < 2:
            return parts
        ranks = lambda x, y: np.where((at := self.rank_of(x, y)) >= 0, self.code_ranks[at], NEVER)
        order, cols, live = ranks(parts[:, :-1], parts[:, 1:]), np.arange(n), np.arange(len(parts))
        while True:
            j = order.argmin(1)
            go = order[np.arange(len(order)), j] < NEVER
            if not go.any():
                return parts
            live, order, j = live[go], order[go], j[go]
            p, row = parts[live], np.arange(len(live))
            p[row, j] = self.whole[self.rank_of(p[row, j], p[row, j + 1])]
            p = np.c_[p, np.full(len(p), -1)][row[:, None], cols + (cols > j[:, None])]
            order = np.c_[order, np.full(len(p), NEVER)][row[:, None], cols[:-1] + (cols[:-1] >= j[:, None])]
            k = np.maximum(j - 1, 0)
            order[row, k] = np.where(j > 0, ranks(p[row, k], p[row, k + 1]), order[row, k])
            k = np.minimum(j, n - 2)
            order[row, k] = np.where(j <= n - 2, ranks(p[row, k], p[row, k + 1]), NEVER)
            parts[live] = p

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For pairs of tokens that encode to themselves: whether nothing merges across their border.

        Going back in time along a's right and b's left spine, the border pair that stands at each time merges if its
        rank comes before the merges that use up its two sides; of equal ranks the left one merges first.
        """
        a, b = a.copy(), b.copy()
        until_a, until_b = np.full(len(a), NEVER), np.full(len(a), NEVER)
        good, live = np.ones(len(a), bool), np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            at = self.rank_of(x, y)
            rank = np.where(at >= 0, self.code_ranks[at], NEVER)
            fires = (rank < until_a[live]) & (rank <= until_b[live]) & (rank < NEVER)
            good[live[fires]] = False
            ra, rb = self.rank[x], self.rank[y]
            back_a = ra > rb
            ia, ib = live[back_a], live[~back_a]
            until_a[ia], a[ia] = ra[back_a], self.right[x[back_a]]
            until_b[ib], b[ib] = rb[~back_a], self.left[y[~back_a]]
            live = live[~fires & (np.maximum(ra, rb) >= 0)]
        return good


class Coder:
    """Encodes and decodes with caches of bounded size; one a Python worker.

    Tokens of words, and of chunks (runs without white space), are kept as bytes, 32 bits an id from the lowest on, so a
    text's ids are the joined bytes of its chunks.
    """

    def __init__(self, vocab: Vocabulary, most_cached: int = 300_000):
        self.v, self.most = vocab, most_cached
        self.exact = self.proposed = 0
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str | int, bytes] = {}
        #: Name of every token by its id, and its decimal form.
        self.names = [vocab.names.get(i, "") for i in range(max(vocab.names) + 1)]
        self.numbers = [str(i) for i in range(len(self.names))]
        self.forget()

    def forget(self, but: Iterable[str | int] = ()) -> None:
        """Empties the caches, but for what stands there of the chunks given."""
        held = [c for c in but if c in self.chunks]
        self.chunks = dict(zip(held, map(self.chunks.__getitem__, held)))
        words = [c for c in held if c in self.words]
        self.words = dict(zip(words, map(self.words.__getitem__, words)))
        self.chunks.update({i: struct.pack("<I", i) for i in self.v.special.values()})

    def pieces(self, text: str) -> list[str | int]:
        """Runs without white space of a text after normalising; special tokens stand as their ids. No word of the split pattern spans white space."""
        v, out = self.v, []
        parts = v.split_special.split(text) if v.split_special else [text]
        for k, part in enumerate(parts):
            if k % 2:
                out.append(v.special[part])
            elif part:
                if not part.isascii():
                    part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
                part = part.lower()
                out += part.split() if _OTHER.search(part) is None else filter(None, _SPACE.split(part))
        return out

    def learn(self, words: list[str]) -> None:
        """Puts the tokens of new words into the cache."""
        v = self.v
        text = ("\n".join(words) + "\n").encode("utf-8").decode("latin-1").translate(v.letters)
        letters = np.frombuffer(text.encode("utf-16-le"), np.uint16)
        ends = np.flatnonzero(letters == 10)
        sizes = np.diff(ends, prepend=-1) - 1
        tokens, word, right = v.proposals(text, ends)
        near = np.flatnonzero(word[1:] == word[:-1])
        pairs, of = np.unique((tokens[near] << 32) | tokens[near + 1], return_inverse=True)
        right[word[near[~v.compatible(pairs >> 32, pairs & 0xFFFFFFFF)[of]]]] = False
        self.proposed += len(words)
        self.exact += int((~right).sum())
        good = right[word]
        found = [(word[good], tokens[good])]
        # words that fail start from their letters' symbols, those of about one length side by side
        start = np.where(np.isin(np.arange(len(letters)), ends - 1), v.last_symbol[letters], v.symbol[letters])
        width = np.where(right, 0, -(-sizes // 8))
        for w in np.unique(width[width > 0]).tolist():
            which = np.flatnonzero(width == w)
            if w > 8:
                done = [v.merged([t for t in start[ends[i] - sizes[i] : ends[i]].tolist() if t >= 0]) for i in which.tolist()]
                found.append((np.repeat(which, list(map(len, done))), np.fromiter(chain.from_iterable(done), np.int64)))
                continue
            at = np.arange(8 * w)
            table = np.where(at < sizes[which, None], start[np.minimum((ends - sizes)[which, None] + at, len(start) - 1)], -1)
            if (table < 0)[at < sizes[which, None]].any():  # letters without a symbol go, what stands behind them moves up
                table = np.take_along_axis(table, np.argsort(table < 0, axis=1, kind="stable"), 1)
            merged = v.merged_many(table)
            row, _ = np.nonzero(merged >= 0)
            found.append((which[row], merged[merged >= 0]))
        word, tokens = (np.concatenate([f[k] for f in found]) for k in (0, 1))
        order = np.argsort(word, kind="stable")
        cut = np.searchsorted(word[order], np.arange(len(words) + 1))
        raw, cut = tokens[order].astype("<u4").tobytes(), (4 * cut).tolist()
        self.words.update(zip(words, [raw[i:j] for i, j in zip(cut, cut[1:])]))

    def split_batch(self, texts: list[str]) -> list[list[str | int]]:
        """The chunks of every text, all of them known afterwards."""
        pieces = [self.pieces(t) for t in texts]
        seen = set().union(*pieces)
        if len(self.chunks) + len(seen) > self.most:
            self.forget(but=seen)
        new = list(seen.difference(self.chunks))
        if new:
            # one search over all new chunks; a line end closes each
            parts = self.v.split_lines.findall("\n".join(new) + "\n")
            words = list(set(parts).difference(self.words, "\n"))
            if words:
                self.learn(words)
            known, ids, at = {}, b"", iter(new)
            for part in parts:
                if part == "\n":
                    known[next(at)] = ids
                    ids = b""
                else:
                    ids = ids + self.words[part] if ids else self.words[part]
            self.chunks.update(known)
        return pieces

    def packed(self, pieces: list[str | int]) -> bytes:
        """The ids of a text's chunks, 32 bits each."""
        return b"".join(map(self.chunks.__getitem__, pieces))

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        return [np.frombuffer(self.packed(p), "<u4").tolist() for p in self.split_batch(texts)]

    def decode(self, ids: Sequence[int]) -> str:
        """The file names no decoder: tokens joined by one blank."""
        return " ".join(map(self.names.__getitem__, ids))

    def decimal(self, ids: Sequence[int]) -> str:
        return " ".join(map(self.numbers.__getitem__, ids))


def load_vocabulary(path: str) -> Vocabulary:
    with open(path, encoding="utf-8") as f:
        return Vocabulary(json.load(f))


def bpe(docs: DataFrame, path: str, outputs: tuple[str, ...] = ("ids", "decoded"), text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Encodes every whole text with the vocabulary in ``path`` and decodes the ids again.

    Returns the id column and those of ``outputs``: ``ids`` (array of int), ``decoded`` (the text of the decoded ids),
    ``n_tokens`` (long), ``ids_sha256`` and ``decoded_sha256`` (digests of the decimal ids joined by one blank and of
    the decoded text). The strings of special tokens in a text become those tokens. Null and empty text: no tokens.
    Very long texts are encoded whole. Repeated rows get equal results. Empty table: no rows. Other columns are not
    read. The vocabulary is read on the driver and broadcast (its size is that of the file, a few MB); one pass of
    Arrow batches without a shuffle; a task's caches of words and chunks are emptied at a fixed size.
    """
    kinds = {"ids": "array<int>", "decoded": "string", "n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}
    arrow = {"ids": pa.list_(pa.int32()), "decoded": pa.string(), "n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
    shipped = ship(docs.sparkSession).sparkContext.broadcast(load_vocabulary(path))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_in_worker()
        # a task's caches go with it, so that an idle worker holds none while the next stage runs
        coder = Coder(shipped.value)
        sha = lambda s: hashlib.sha256(s.encode("utf-8")).hexdigest()
        for whole in batches:
            for b in sliced(whole, "text"):
                made: dict[str, list] = {c: [] for c in outputs}
                for pieces in coder.split_batch(texts_of(b, "text")):
                    raw = coder.packed(pieces)
                    ids = np.frombuffer(raw, "<u4").tolist()
                    text = {"ids": lambda: ids, "n_tokens": lambda: len(ids), "decoded": lambda: coder.decode(ids), "ids_sha256": lambda: sha(coder.decimal(ids)), "decoded_sha256": lambda: sha(coder.decode(ids))}
                    for c, values in made.items():
                        values.append(text[c]())
                yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array(made[c], arrow[c]) for c in outputs)], [id_col, *outputs])

    return docs.selectExpr(f"`{id_col}` as id", f"`{text}` as text").mapInArrow(run, ", ".join([f"`{id_col}` {kind}", *(f"{c} {kinds[c]}" for c in outputs)]))
