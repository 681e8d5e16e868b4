"""Operator 8, near-duplicate embeddings: random-hyperplane sign hashing in several tables, exact cosine, components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, stash
from .graph import connected_components, lowest


def plan_tables(n: int, threshold: float, miss: float) -> tuple[int, int]:
    """Bits a key and number of tables for n vectors: buckets of some 16 strangers, and a pair at the threshold missed by all tables with probability ``miss``."""
    bits = min(60, max(6, round(math.log2(max(n, 1) / 16)) if n > 16 else 6))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(miss) / math.log(1 - same)))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one in double precision; scaled first, so that neither large nor small numbers overflow."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def linked(ids: np.ndarray, times: np.ndarray, x: np.ndarray, keys: np.ndarray, block: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links inside one bucket (or between two blocks of it): ids that have any, how many rows they link to, and the smallest id they reach here.

    A pair counts only in the first table that holds both in one bucket; ``keys`` are those of the tables before. Products are taken for slices of rows, so
    memory is bounded by the block.
    """
    two = block.min() != block.max()
    left = np.flatnonzero(block == block.min())
    right = np.flatnonzero(block == block.max())
    count = np.zeros(len(ids), np.int64)
    a, b = [], []
    for s in range(0, len(left), 512):
        i, j = np.nonzero(x[left[s : s + 512]] @ x[right].T >= threshold)
        i, j = left[s : s + 512][i], right[j]
        if not two:
            i, j = i[i < j], j[i < j]
        a.append(i)
        b.append(j)
    i, j = np.concatenate(a), np.concatenate(b)
    if not len(i):
        return ids[:0], count[:0], ids[:0]
    fresh = np.ones(len(i), bool)
    for s in range(0, len(i), 1 << 16):
        e = slice(s, s + (1 << 16))
        fresh[e] = ~(keys[i[e]] == keys[j[e]]).any(axis=1)
    np.add.at(count, i[fresh], times[j[fresh]])
    np.add.at(count, j[fresh], times[i[fresh]])
    order = np.argsort(ids, kind="stable")
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.arange(len(ids))
    label = lowest(len(ids), rank[i], rank[j])[rank]
    at = np.unique(np.r_[i, j])
    return ids[at], count[at], ids[order[label[at]]]


def near_vectors(df: DataFrame, threshold: float = 0.95, miss: float = 2e-4, block: int = 1024, seed: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Links and component of every vector.

    Vectors of one dimension whose cosine in double precision is ``threshold`` or more are linked if a hash table holds
    them in one bucket; every candidate is checked exactly. Returns the id column, ``n_links`` (other rows linked
    directly), ``component_id`` (smallest id reachable, itself included) and ``kept`` (it is its own component's id).
    Null, zero and empty vectors and those with null or non-finite components link with nothing. Equal vectors are
    linked with each other and compared with the rest once. An id on two different vectors is two vectors: each row is
    linked by its own. Rows with a null id are kept and link with nothing. Ids are whole numbers, or text that spells
    them; other text is an error. Empty table: no rows. Other columns are not read.

    The number of bits grows with the number of vectors and the tables with it, so buckets keep their size. A bucket of
    more than ``block`` vectors is dealt into blocks and its pairs of blocks over tasks. A task returns a count and one
    edge a vector, never its pairs.
    """
    spark = ship(df.sparkSession)
    wide = dict(df.dtypes)[vec_col] != "array<float>"
    base = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>" if wide else "array<float>").alias("v"))
    fine = F.coalesce(
        (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0) & F.col("id").isNotNull(), F.lit(False)
    )
    base = base.withColumn("fine", fine)
    good = base.where("fine").withColumn("h", F.xxhash64("v"))
    texts = stash(good.groupBy("h", "v").agg(F.min("id").alias("first"), F.count("*").alias("times")).withColumn("rep", F.monotonically_increasing_id()), "vectors")
    n = texts.count()
    bits, tables = plan_tables(n, threshold, miss)
    kind = np.float64 if wide else np.float32

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for b in batches:
            vs = [np.array(v, kind) for v in b.column("v").to_pylist()]
            for v in vs:
                if len(v) not in planes:
                    planes[len(v)] = np.random.default_rng([seed, len(v)]).standard_normal((len(v), bits * tables))
            dims = np.array([len(v) for v in vs])
            keys, packed = np.zeros((len(vs), tables), np.int64), np.zeros((len(vs), -(-bits * tables // 8)), np.uint8)
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                signs = (unit(np.stack([vs[i] for i in at])) @ planes[d] > 0).reshape(len(at), tables, bits)
                keys[at] = (signs.astype(np.int64) << np.arange(bits)).sum(axis=2) * 100_003 + d
                packed[at] = np.packbits(signs.reshape(len(at), -1), axis=1)
            out = [b.column("rep"), b.column("times"), pa.array([v.tobytes() for v in vs], pa.binary()), pa.array(list(keys), pa.list_(pa.int64())), pa.array([p.tobytes() for p in packed], pa.binary())]
            yield pa.RecordBatch.from_arrays(out, ["rep", "times", "v", "keys", "signs"])

    signed = stash(texts.select("rep", "times", "v").mapInArrow(sign, "rep long, times long, v binary, keys array<long>, signs binary"), "signs")
    spots = signed.select("rep", F.posexplode("keys").alias("t", "key"))
    counts = stash(spots.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / block).cast("int")), "buckets")
    rows = signed.select("rep", "times", "v", "signs", F.posexplode("keys").alias("t", "key")).join(counts.select("t", "key", "blocks"), ["t", "key"])
    rows = rows.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks").cast("long")).cast("int"))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("t", "key", F.least("own", "with").alias("lo"), F.greatest("own", "with").alias("hi"), "own", "rep", "times", "v", "signs")
    group = ["t", "key", "lo", "hi"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def work(t: pa.Table) -> Iterator[pa.RecordBatch]:
            cols = [t.column(c).to_numpy() for c in group]
            edge = np.r_[0, 1 + np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)), len(t)]
            ids, times, own = (t.column(c).to_numpy() for c in ("rep", "times", "own"))
            raw, signs = t.column("v").to_pylist(), t.column("signs").to_pylist()
            found = []
            for s, e in zip(edge[:-1], edge[1:]):
                blocks = own[s:e]
                if e - s < 2 or (cols[2][s] != cols[3][s] and blocks.min() == blocks.max()):
                    continue
                x = unit(np.frombuffer(b"".join(raw[s:e]), kind).reshape(e - s, -1))
                earlier = np.unpackbits(np.frombuffer(b"".join(signs[s:e]), np.uint8).reshape(e - s, -1), axis=1)[:, : int(cols[0][s]) * bits].reshape(e - s, -1, bits)
                keys = (earlier.astype(np.int64) << np.arange(bits)).sum(axis=2)
                found.append(linked(ids[s:e], times[s:e], x, keys, blocks, threshold))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[k] for f in found])) for k in range(3)], ["rep", "links", "low"])

        for b in batches:
            now = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
            # the last group may go on in the next batch
            cols = [now.column(c).to_numpy() for c in group]
            change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0))
            cut = int(change[-1]) + 1 if len(change) else 0
            if cut:
                yield from work(now.slice(0, cut).combine_chunks())
            rest = now.slice(cut)
        if rest is not None and len(rest):
            yield from work(rest.combine_chunks())

    found = rows.repartition(*group).sortWithinPartitions(*group).mapInArrow(compare, "rep long, links long, low long")
    found = stash(found, "links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    groups = connected_components(found.select(F.col("rep").alias("a"), F.col("low").alias("b")))
    named = texts.select("h", F.col("v").alias("rv"), "rep", "first", "times").join(links, "rep", "left").join(groups.withColumnRenamed("node", "rep"), "rep", "left")
    named = stash(named.withColumn("component", F.coalesce("component", "rep")), "named")
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    named = named.join(least, "component").select("h", "rv", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"), "component_id")
    mine = good.join(named, (good.h == named.h) & (good.v == named.rv)).select("id", "n_links", "component_id")
    lone = base.where("not fine").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = mine.union(lone)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
