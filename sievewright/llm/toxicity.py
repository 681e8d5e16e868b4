"""Operator 3, toxicity by maximum-scoring segments of token log-odds."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32_of_id, kept_in_worker, release, ship, sliced, stash, texts_of

TOKEN = r"[^\W\d_]+"
_TOKEN = re.compile(TOKEN)
#: Labelled rows that a model is fitted on at most, about.
MOST_ROWS = 500_000
#: Lengths of word beginnings that are tokens of their own.
STEMS = (4, 5, 6, 7, 8)


@dataclass
class Model:
    """Token scores and the calibration of segment scores.

    ``lam`` and ``k``: parameters of the extreme-value law of the best segment of a clean text; ``a`` and ``b``: the
    logistic curve from the evidence of a text to the probability of label 1.
    """

    scores: dict[str, float] = field(default_factory=dict)
    other: float = -0.05
    lam: float = 1.0
    k: float = 1.0
    a: float = 1.0
    b: float = -4.0


def segments(at: list[int], gain: list[float], other: float) -> list[tuple[float, int, int]]:
    """All maximal scoring segments in linear time (score, first token, end).

    ``at`` and ``gain``: places and scores of the tokens that score above 0 or otherwise than ``other``, which every
    token between them scores. The scan keeps disjoint candidates with the running totals before and after each;
    a new candidate joins those whose total before is lower, as long as that raises the score. Each candidate holds a
    link to the nearest earlier one with a lower total before it, so that no candidate is passed over twice.
    """
    out: list[tuple[float, float, int, int, int]] = []  # total before, total after, first, end, link
    total, last = 0.0, 0
    for p, g in zip(at, gain):
        before = total + other * (p - last)
        after = before + g
        total, last = after, p + 1
        if g <= 0:
            continue
        lo, first, j = before, p, len(out) - 1
        while j >= 0 and out[j][0] >= lo:
            j = out[j][4]
        while j >= 0 and out[j][1] < after:
            lo, _, first, _, link = out[j]
            del out[j:]
            j = link
        out.append((lo, after, first, p + 1, j))
    return [(hi - lo, first, end) for lo, hi, first, end, _ in out]


def scan(texts: list[str], m: Model, cutoff: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[tuple[float, int, int]]]]:
    """Per text: tokens, the best segment's score, the summed evidence above ``cutoff``, and the segments above it."""
    n, best, total, found = [], [], [], []
    memo: dict[str, float | None] = {}
    for t in texts:
        tokens = _TOKEN.findall(t.lower())
        for w in set(tokens).difference(memo):
            memo[w] = score_of(w, m.scores)
        got = [(i, s) for i, s in enumerate(map(memo.__getitem__, tokens)) if s is not None]
        runs = segments([i for i, _ in got], [s for _, s in got], m.other) if got else []
        high = [r for r in runs if evidence(r[0], len(tokens), m) > cutoff]
        n.append(len(tokens))
        best.append(max((r[0] for r in runs), default=0.0))
        total.append(sum(evidence(r[0], len(tokens), m) for r in high))
        found.append(high)
    # types are told, not guessed: the batches of a task must agree, and the sum of no evidence is the integer 0
    return np.array(n, np.int64), np.array(best, np.float64), np.array(total, np.float64), found


def evidence(score: float, n: int, m: Model) -> float:
    """Minus the natural logarithm of the number of segments so good that a clean text of n tokens has by chance."""
    return m.lam * score - math.log(max(m.k * max(n, 1), 1e-9))


def fit_tokens(labelled: DataFrame, prior: float = 0.25, least: int = 5) -> tuple[dict[str, float], float]:
    """Log-odds of tokens in toxic against other texts under a Dirichlet prior in the shape of both together.

    A token of ``c1`` of ``n1`` toxic and ``c0`` of ``n0`` other tokens gets the difference of its log odds with
    ``prior`` times its own count in both added to each count. It is kept if it lies further from 0, in standard
    deviations, than the largest of so many chance values would: ``sqrt(2 ln(number of tokens tested))``. Texts count
    each of their tokens once, equal texts count once. Beside whole words, word beginnings of ``STEMS`` letters are
    tokens (written with a trailing ``*``), so inflected forms share evidence. Returns the scores and that of all other
    words: the log-odds of the mass that scored whole words leave, at most -0.01, so that a passage ends where nothing
    speaks for it. Their number is bounded by that of the labelled rows.
    """
    distinct = labelled.groupBy(F.xxhash64("text").alias("h")).agg(F.max("toxic").alias("toxic"), F.first("text").alias("text"))
    pairs = distinct.select("toxic", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}]+)"), F.lit(1)))).alias("token"))
    words = pairs.groupBy("token").agg(F.sum("toxic").cast("long").alias("c1"), F.sum(1 - F.col("toxic")).cast("long").alias("c0"))
    forms = F.array(F.col("token"), *[F.when(F.length("token") > n, F.concat(F.substring("token", 1, n), F.lit("*"))) for n in STEMS])
    counts = words.select(F.explode(F.array_compact(forms)).alias("token"), "c1", "c0").groupBy("token").agg(F.sum("c1").alias("c1"), F.sum("c0").alias("c0"))
    counts = counts.where(F.col("c1") + F.col("c0") >= least)
    counts = stash(counts, "tokens")
    whole = counts.where("token not like '%*'").agg(F.sum("c1").alias("n1"), F.sum("c0").alias("n0")).first()
    n1, n0 = float(whole["n1"] or 0), float(whole["n0"] or 0)
    if not n1 or not n0:
        return {}, -0.01
    at_least = math.sqrt(2 * math.log(max(counts.count(), 2)))
    share = (F.col("c1") + F.col("c0")) * prior
    odds = lambda c, total: F.log((F.col(c) + share) / (F.lit(total + prior * (n1 + n0)) - F.col(c) - share))
    # the prior is the same in both classes, so equal shares give 0 once its size per class is taken off
    level = math.log((n0 + prior * (n1 + n0)) / (n1 + prior * (n1 + n0)))
    delta = odds("c1", n1) - odds("c0", n0)
    mid = F.log(F.lit(n1 / (n1 + n0)) + prior) - F.log(F.lit(n0 / (n1 + n0)) + prior) + level
    scored = counts.select("token", "c1", "c0", (delta - mid).alias("s"), ((delta - mid) / F.sqrt(1 / (F.col("c1") + share) + 1 / (F.col("c0") + share))).alias("z"))
    kept = scored.where(F.abs("z") >= at_least).orderBy("token").collect()
    words = [r for r in kept if not r["token"].endswith("*")]
    left1, left0 = n1 - sum(r["c1"] for r in words), n0 - sum(r["c0"] for r in words)
    other = math.log(max(left1, 1) / n1) - math.log(max(left0, 1) / n0)
    release(counts)
    return {r["token"]: r["s"] for r in kept}, min(other, -0.01)


def score_of(word: str, scores: dict[str, float]) -> float | None:
    """The score of a word, or else of its longest known beginning."""
    got = scores.get(word)
    if got is None:
        for n in STEMS[::-1]:
            if len(word) > n and (got := scores.get(word[:n] + "*")) is not None:
                return got
    return got


def logistic_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Coefficients of the logistic curve from ``x`` to label ``y``, by Newton steps on the penalised likelihood.

    A whole step may overshoot when few texts hold far more evidence than the rest, and from there the steps run away; so
    a step is halved until the loss, which is convex, falls.
    """
    w = np.array([0.5, -3.0])
    loss = lambda w: np.logaddexp(0, x @ w).sum() - y @ (x @ w) + ridge / 2 * (w @ w)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        down = x.T @ (y - p) - ridge * w
        step, now = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(2), down), loss(w)
        while np.abs(step).max() >= 1e-8 and loss(w + step) > now - 1e-4 * (down @ step):
            step = step / 2
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(labelled: DataFrame) -> Model:
    """Learns a model from rows with ``text`` and ``toxic`` (0 or 1), their number bounded by ``training_rows``.

    Token scores come from all rows. The calibration is fitted on the driver from three numbers a text: lambda and
    K of the extreme-value law by moments of the clean texts' best scores and lengths, then, by Newton steps, the
    logistic curve of the summed evidence that ``toxicity`` scores by. Without both labels nothing scores above 0.5.
    """
    labelled = labelled.select(F.coalesce("text", F.lit("")).alias("text"), F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1)")
    ship(labelled.sparkSession)
    labelled = stash(labelled, "labelled")
    scores, other = fit_tokens(labelled)
    m = Model(scores=scores, other=other)
    if not m.scores:
        return m

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_in_worker()
        for whole in batches:
            for b in sliced(whole, "text"):
                n, best, total, _ = scan(texts_of(b, "text"), m, 0.0)
                yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array(n), pa.array(best), pa.array(total)], ["toxic", "n", "best", "total"])

    measured = lambda: labelled.select("text", "toxic").mapInArrow(measure, "toxic int, n long, best double, total double").toPandas()
    got = measured()
    y, n, best = got["toxic"].to_numpy(), np.maximum(got["n"].to_numpy(), 1), got["best"].to_numpy()
    clean = best[y == 0]
    fits = (y == 0) & (best > 0) & (best <= np.quantile(clean, 0.995))
    spread = best[fits]
    m.lam = float(1.0 / max(spread.mean(), 1e-3)) if fits.any() else 1.0
    m.k = float(max(fits.sum(), 1) / max(n[y == 0].sum(), 1))
    got = measured()  # again, now that the law tells which segments count
    y, x = got["toxic"].to_numpy(), np.c_[got["total"].to_numpy(), np.ones(len(got))]
    w = logistic_curve(x, y)
    m.a, m.b = max(float(w[0]), 1e-3), float(w[1])
    return m


def toxicity(docs: DataFrame, model: Model, text: str = "text", id_col: str = "doc_id", spans: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """Scores every whole text.

    Returns the id column, the columns of ``keep``, ``score`` (0 to 1), ``predicted`` (1 from 0.5 on), ``n_segments`` and, with ``spans``,
    ``segments`` (array of score, first token and end of every significant passage). Null or empty text: no segment, the
    score of a text without evidence. Very long texts are scanned whole in linear time. Repeated rows get equal results.
    Empty table: no rows. Other columns are not read. One pass of Arrow batches, no shuffle; the model is broadcast, its
    size bounded by the number of tokens it may hold.
    """
    shipped = ship(docs.sparkSession).sparkContext.broadcast(model)
    through = {f.name: f.dataType.simpleString() for f in docs.schema.fields if f.name == id_col or f.name in keep}
    read = text if text in through else "__text"  # a kept text goes to Python once
    item = pa.struct([("score", pa.float64()), ("first", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_in_worker()
        m = shipped.value
        for whole in batches:
            for b in sliced(whole, read):
                _, _, total, found = scan(texts_of(b, read), m, 0.0)
                score = 1 / (1 + np.exp(-np.clip(m.a * total + m.b, -30, 30)))
                out = [*(b.column(c) for c in through), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array([len(f) for f in found], pa.int32())]
                if spans:
                    out.append(pa.array([[{"score": s, "first": i, "end": j} for s, i, j in f] for f in found], pa.list_(item)))
                yield pa.RecordBatch.from_arrays(out, [*through, "score", "predicted", "n_segments", *["segments"] * spans])

    schema = "".join(f"`{c}` {k}, " for c, k in through.items()) + "score double, predicted int, n_segments int" + ", segments array<struct<score: double, first: long, end: long>>" * spans
    return docs.select(*through, *[F.col(text).alias(read)] * (read not in through)).mapInArrow(run, schema)


def training_rows(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> DataFrame:
    """Labelled texts whose id is not held out, of at most about ``most_rows`` labelled ids, chosen by a hash of the id.

    The ids and labels taken are few by that bound, so they are sent to all tasks and no text is shuffled.
    """
    known = labels.where("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(crc32_of_id(F.col("doc_id")) % 5 != 0)
    known = stash(known, "labels")
    n = known.count()
    if n > most_rows:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(most_rows / n * (1 << 30)))
    return docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("text", "toxic")
