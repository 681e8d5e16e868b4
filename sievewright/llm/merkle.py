"""Operator 11, Merkle dataset manifest: leaves and the outer nodes they need meet by superblock, where reduction, proofs and folding end together."""

from __future__ import annotations

import hashlib
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import crc32_of_id, release, ship, stash

#: Children of a node, and levels of a tree that are settled inside a superblock.
FAN, DEPTH = 16, 3
SUPERBLOCK = FAN**DEPTH
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_DIGITS = 64


def coded(value: Column) -> Column:
    """A field of a leaf: its UTF-8 byte count, a colon and the value; ``-`` for null."""
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_of(*values: Column) -> Column:
    return F.sha2(F.concat(*map(coded, values)), 256)


def tree_of(source: Column) -> Column:
    """The name of a source's tree; null is a source of its own, and its name sorts first."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def numbered(df: DataFrame, group: str, *order: str) -> DataFrame:
    """Adds ``i``, the gapless place from 0 of each row of a group in the given order, and ``n``, the group's rows.

    Rows are dealt by ranges of group and order, so a group spreads over as many tasks as its size asks for; a row's
    place is its place in the task's part of the group and the rows of the group in the tasks before.
    """
    spread = df.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    at = F.monotonically_increasing_id()
    rows = stash(spread.withColumn("at", at).withColumn("part", F.shiftright("at", 33)), "places")
    parts = rows.groupBy(group, "part").agg(F.min("at").alias("low"), F.count("*").alias("k"))
    parts = parts.withColumn("base", F.sum("k").over(W.partitionBy(group).orderBy("part")) - F.col("k"))
    parts = parts.withColumn("n", F.sum("k").over(W.partitionBy(group))).drop("k")
    out = stash(rows.join(parts, [group, "part"]).withColumn("i", F.col("base") + F.col("at") - F.col("low")).drop("at", "part", "low", "base"), "numbered")
    release(rows)
    return out


def parent(digests: Column) -> Column:
    return F.sha2(F.array_join(digests, ""), 256)


def superblock_tops(leaves: DataFrame) -> DataFrame:
    """The node that stands for each superblock of ``leaves`` (tree, i, n, leaf): three levels up, or the subroot of a tree that fits in one. Returns ``tree``, ``i``, ``m`` (superblocks of the tree) and ``h``."""
    block = F.floor(F.col("i") / SUPERBLOCK)
    got = leaves.groupBy("tree", block.alias("i")).agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("i", "leaf"))).alias("run"))
    whole = F.col("n") > SUPERBLOCK

    def up(nodes: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / FAN).cast("int")), lambda k: parent(F.slice(nodes, k * FAN + 1, F.lit(FAN))))
        return F.when(whole | (F.size(nodes) > 1), runs).otherwise(nodes)

    top = got.withColumn("nodes", F.transform("run", lambda r: r["leaf"])).drop("run")
    for _ in range(DEPTH):
        top = top.withColumn("nodes", up(F.col("nodes")))
    return top.select("tree", "i", F.ceil(F.col("n") / SUPERBLOCK).alias("m"), F.get("nodes", F.lit(0)).alias("h"))


def reduced(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Levels of a forest from ``nodes`` (tree, i, m, h) to its roots.

    Returns the roots (tree, h) and, from the lowest level on, the runs that became a node: ``tree``, ``i`` (the new
    node's place), ``run`` (the digests of its children; one and no hashing where the tree had one node left). A level
    has a sixteenth of the rows of that below; levels are as many as the largest tree needs.
    """
    levels: list[DataFrame] = []
    most = nodes.agg(F.max("m")).first()[0] or 1
    while most > 1:
        runs = nodes.groupBy("tree", F.floor(F.col("i") / FAN).alias("i")).agg(F.max("m").alias("m"), F.sort_array(F.collect_list(F.struct("i", "h"))).alias("run"))
        runs = runs.withColumn("run", F.transform("run", lambda r: r["h"]))
        levels.append(stash(runs.select("tree", "i", "m", "run", F.when(F.col("m") > 1, parent(F.col("run"))).otherwise(F.get("run", F.lit(0))).alias("h")), "level"))
        nodes = levels[-1].select("tree", "i", F.ceil(F.col("m") / FAN).alias("m"), "h")
        most = -(-most // FAN)
    return nodes.select("tree", "h"), levels


_PATH = "array<struct<pos: int, run: array<string>>>"


def paths(tops: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """From what each root's path is (``tree``, ``path`` and more) to the path of every node of the lowest level: ``tree``, ``i``, ``path`` and the rest of ``tops``.

    A path lists, from the node up, the run that the node stands in and its place there.
    """
    at = tops.withColumn("i", F.lit(0).cast("long"))
    more = [c for c in at.columns if c not in ("tree", "i", "path")]
    for level in reversed(levels):
        down = at.join(level.select("tree", "i", "m", "run"), ["tree", "i"]).select("tree", "i", "m", "run", "path", *more, F.posexplode("run").alias("pos", "h"))
        step = F.array(F.struct("pos", "run")).cast(_PATH)
        at = down.select("tree", (F.col("i") * FAN + F.col("pos")).alias("i"), F.when(F.col("m") > 1, F.concat(step, "path")).otherwise(F.col("path")).alias("path"), *more)
    return at


def sha(text: str) -> str:
    return hashlib.sha256(text.encode("ascii")).hexdigest()


def finish(leaves: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
    """Proofs and folded roots of a superblock's leaves (i, id, n, leaf, tampered) from the one row of ``outer`` (path, subroot, root) that leads from its top node to the root."""
    leaves = leaves.sort_values("i")
    path, subroot, root = outer["path"].iloc[0], outer["subroot"].iloc[0], outer["root"].iloc[0]
    levels, n = [leaves["leaf"].tolist()], int(leaves["n"].iloc[0])
    while len(levels) <= DEPTH and (n > SUPERBLOCK or len(levels[-1]) > 1):
        below = levels[-1]
        levels.append([sha("".join(below[k : k + FAN])) for k in range(0, len(below), FAN)])
    # what stands above the superblock's top node: a run, cut where the node on the way stands
    above = [(run[: (k := int(step["pos"]))], run[k + 1 :]) for step in path for run in (list(step["run"]),)]
    outside = [("".join(a), "".join(b)) for a, b in above]
    runs = [["".join(lv[k : k + FAN]) for k in range(0, len(lv), FAN)] for lv in levels[:-1]]
    beside = [""] * len(levels[-1])
    tail = "".join(a + b for a, b in outside)
    siblings = [tail for _ in beside]
    for lv in range(len(levels) - 2, -1, -1):
        siblings = [(r := runs[lv][k // FAN])[: (c := k % FAN * _DIGITS)] + r[c + _DIGITS :] + siblings[k // FAN] for k in range(len(levels[lv]))]
    folded = []
    for k, (leaf, other) in enumerate(zip(levels[0], leaves["tampered"])):
        h = leaf if other is None or other != other else other
        for lv in range(len(levels) - 1):
            r, c = runs[lv][k // FAN], k % FAN * _DIGITS
            h, k = sha(r[:c] + h + r[c + _DIGITS :]), k // FAN
        for a, b in outside:
            h = sha(a + h + b)
        folded.append(h)
    return pd.DataFrame(
        {"id": leaves["id"].to_numpy(), "leaf": levels[0], "subroot": subroot, "root": root, "proof_sha256": [sha(s) for s in siblings], "folded_root": folded, "verified": [f == root for f in folded]}
    )


def manifest(docs: DataFrame, tampered: Column | None = None, tampered_text: Column | None = None, id_col: str = "doc_id") -> DataFrame:
    """The Merkle manifest of a table, one row a document, with its proof's digest and the root that folding gives.

    A leaf is the SHA-256 of doc_id, source, lang, n_chars and text, each ``-`` if null, else byte count, colon, value.
    In each source leaves ascend by id; runs of 16 become their digest, the last run with fewer, until one node is left,
    the subroot. Subroots by source (null first, bytewise) go the same way to the root. Where ``tampered`` holds, the
    leaf that is folded is that of ``tampered_text`` with all other fields kept; proofs hold the untampered siblings.

    Returns the id column, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root`` and ``verified``. Null
    ids come first in their source; equal ids stand by leaf, so repeated rows are leaves of their own. Null and empty
    texts differ (``-`` and ``0:``). Very long texts are hashed in the JVM and leave it as digests. Empty table: no rows.
    One row: its leaf is subroot and root, its proof the digest of nothing. Other columns are not read.

    Cost: the text is read once and only ids, sources and digests move, by ranges for their places and by superblocks
    of 4096 leaves for the rest; a hot source is many of both. The superblocks' top nodes are settled in one
    aggregation, the levels above them have a 4096th of the rows and shrink by 16. Each superblock then meets the runs
    on its way to the root (at most 16 digests a level) in one cogrouped task that reduces, proves and folds.
    """
    spark = docs.sparkSession
    fields = {c: F.col(id_col if c == "doc_id" else c) for c in FIELDS}
    other = F.lit(None).cast("string")
    if tampered is not None:
        other = F.when(tampered, leaf_of(*(fields | {"text": tampered_text}).values()))
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), tree_of(fields["source"]).alias("tree"), leaf_of(*fields.values()).alias("leaf"), other.alias("tampered"))
    # the row's own number keeps equal rows apart, so that ranges may cut between them
    rows = stash(rows.withColumn("row", F.monotonically_increasing_id()), "leaves")
    leaves = numbered(rows, "tree", "id", "leaf", "row").drop("row")
    release(rows)
    tops = stash(superblock_tops(leaves), "tops")
    subroots, levels = reduced(tops)
    sources = numbered(subroots.withColumn("all", F.lit(0)), "all", "tree").select(F.lit("").alias("tree"), "i", F.col("n").alias("m"), "h", F.col("tree").alias("of"))
    roots, upper = reduced(sources.drop("of"))
    start = roots.select("tree", F.col("h").alias("root"), F.array().cast(_PATH).alias("path"))
    tree_paths = paths(start, upper).drop("tree").join(sources.select("i", F.col("of").alias("tree"), F.col("h").alias("subroot")), "i").drop("i")
    outer = paths(tree_paths, levels).withColumnRenamed("i", "block")
    ship(spark)
    schema = f"id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    blocks = leaves.withColumn("block", F.floor(F.col("i") / SUPERBLOCK)).groupBy("tree", "block")
    return blocks.cogroup(outer.groupBy("tree", "block")).applyInPandas(lambda a, b: finish(a, b), schema).withColumnRenamed("id", id_col)


def lowered(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, _UPPER, _LOWER)


def tampered_rows(doc_id: Column, every: int = 5) -> Column:
    return crc32_of_id(doc_id) % every == 0


#: The same manifest in SQL: trees by recursion over levels, proofs and folds by joins with the runs of each level.
ORACLE_SQL = """
WITH RECURSIVE docs AS (
  SELECT doc_id, source, lang, n_chars, text, s, xor(list_reduce(range(0, 8 * length(s)), lambda crc, i: 
           xor(xor(crc, CASE WHEN i % 8 = 0 THEN ascii(s[i // 8 + 1]) ELSE 0 END) >> 1, CASE WHEN xor(crc, CASE WHEN i % 8 = 0 THEN ascii(s[i // 8 + 1]) ELSE 0 END) & 1 = 1 THEN 3988292384 ELSE 0 END), 4294967295), 4294967295) AS crc
  FROM (SELECT *, CAST(doc_id AS VARCHAR) AS s FROM documents)),
coded AS (SELECT doc_id, source, crc,
    concat(coalesce(strlen(s) || ':' || s, '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || CAST(n_chars AS VARCHAR), '-')) AS head,
    text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM docs),
hashed AS (SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN crc % 5 = 0 THEN sha256(head || coalesce(strlen(low) || ':' || low, '-')) END AS other FROM coded),
leaves AS (SELECT *, coalesce('s' || source, 'n') AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM hashed),
nodes AS (
  SELECT tree, 0 AS lvl, i, leaf AS h, n AS m FROM leaves
  UNION ALL
  SELECT tree, lvl + 1, i // 16, sha256(string_agg(h, '' ORDER BY i)), (any_value(m) + 15) // 16 FROM nodes WHERE m > 1 GROUP BY tree, lvl, i // 16),
subroots AS (SELECT tree, h, lvl AS height, row_number() OVER (ORDER BY tree) - 1 AS r, count(*) OVER () AS m FROM nodes WHERE m = 1),
above AS (
  SELECT 0 AS lvl, r AS i, h, m FROM subroots
  UNION ALL
  SELECT lvl + 1, i // 16, sha256(string_agg(h, '' ORDER BY i)), (any_value(m) + 15) // 16 FROM above WHERE m > 1 GROUP BY lvl, i // 16),
runs AS (
  SELECT tree, lvl, i // 16 AS k, string_agg(h, '' ORDER BY i) AS run FROM nodes WHERE m > 1 GROUP BY ALL
  UNION ALL
  SELECT '' AS tree, lvl, i // 16 AS k, string_agg(h, '' ORDER BY i) AS run FROM above WHERE m > 1 GROUP BY ALL),
walk AS (
  SELECT row_number() OVER () AS id, doc_id, l.tree, l.tree AS own, height, r, 0 AS lvl, i, leaf, coalesce(other, leaf) AS fold, '' AS proof FROM leaves l JOIN subroots s ON l.tree = s.tree
  UNION ALL
  SELECT id, doc_id, CASE WHEN ended THEN '' ELSE w.tree END, own, height, r, CASE WHEN ended THEN 0 ELSE w.lvl + 1 END, CASE WHEN ended THEN r ELSE i // 16 END, leaf,
         CASE WHEN ended THEN fold ELSE sha256(substr(run, 1, CAST(64 * (i % 16) AS BIGINT)) || fold || substr(run, CAST(64 * (i % 16) + 65 AS BIGINT))) END,
         CASE WHEN ended THEN proof ELSE proof || substr(run, 1, CAST(64 * (i % 16) AS BIGINT)) || substr(run, CAST(64 * (i % 16) + 65 AS BIGINT)) END
  FROM (SELECT *, tree <> '' AND lvl = height AS ended FROM walk) w LEFT JOIN runs ON w.tree = runs.tree AND w.lvl = runs.lvl AND i // 16 = k WHERE ended OR run IS NOT NULL)
SELECT doc_id, leaf, s.h AS subroot, root.h AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = root.h AS verified
FROM walk w JOIN subroots s ON w.own = s.tree, (SELECT max_by(h, lvl) AS h, max(lvl) AS top FROM above) root WHERE w.tree = '' AND w.lvl = root.top"""
