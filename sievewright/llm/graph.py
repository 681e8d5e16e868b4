"""Connected components as DataFrame jobs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, stash


def lowest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest node that each of n nodes reaches over the links (i, j), by repeated minima and pointer jumps."""
    label = np.arange(n)
    while True:
        low = label.copy()
        np.minimum.at(low, i, label[j])
        np.minimum.at(low, j, label[i])
        low = low[low]
        if (low == label).all():
            return label
        label = low


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Smallest reachable node of every node that has an edge: alternating large-star and small-star rounds.

    ``edges`` has ``a`` and ``b``, both long; nulls and loops are ignored, repeats do no harm. Returns ``node`` and
    ``component``. No edges: an empty table. Each round is two aggregations and two joins on the edges, which shrink to
    one star per component; a round's edges are written to the shared folder, so a lost executor costs one round.
    """
    now = stash(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v and a is not null and b is not null").distinct(), "edges"
    )
    for _ in range(most_rounds):
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        after = stash(
            small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", "m")).where("u <> v").distinct(), "edges"
        )
        same = now.count() == after.count() and now.exceptAll(after).isEmpty()
        release(now)
        now = after
        if same:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
