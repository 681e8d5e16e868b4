"""Operator 5, mixing sources to target weights by Pareto order sampling. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import WORD, release, stash

#: Cells of the sampling order for each unit of the logarithm of a rank, so that a hot source is many tasks' work.
CELLS = 256


def source_targets(sized: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """Words that each source should give: shares of all words by weight, stopped at ``most`` times the source's words.

    Sources sort by code point, null last, and weigh ``weights``, repeating. Water filling in closed form: in the order
    of cap per weight a source is capped while its cap lies below its share of what the sources before leave over.
    ``sized`` has ``source`` and ``size``. Returns ``source``, ``weight``, ``source_size`` and ``target`` (double).
    The windows run over one row a source.
    """
    per = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    turn = F.pmod(F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights)))
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (turn + 1).cast("int")).cast("long"))
    per = per.withColumn("cap", F.col("source_size") * most)
    order = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    every = W.partitionBy()
    before = order.rowsBetween(W.unboundedPreceding, -1)
    per = per.withColumn("left", F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    per = per.withColumn("open", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    per = per.withColumn("level", F.col("left").cast("double") / F.col("open"))
    per = per.withColumn("capped", F.col("cap") <= F.col("level") * F.col("weight"))
    # the first open source has the largest "open" of those not capped
    per = per.withColumn("final", F.max(F.when(~F.col("capped"), F.struct(F.col("open").alias("o"), F.col("level").alias("l")))).over(every)["l"])
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("final") * F.col("weight"))
    return per.select("source", "weight", "source_size", target.alias("target"))


def uniform(seed: int, *cols: Column) -> Column:
    """A number of (0, 1) from the MD5 of the values: the same on every run and in every engine."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("")) for c in cols]))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("long").cast("double") + 0.5) / float(1 << 48)


def size_class(size: Column) -> Column:
    """Number of binary digits of a size, less one."""
    return F.length(F.bin(size)) - 1


def inclusion(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Inclusion probability ``p`` of the rows of each source and size class in the sample beyond certain copies.

    Within a source p falls with the square root of the class's size, ``p = min(1, c / sqrt(2 ** k))``, and c is such that
    the expected words are those needed: classes from the smallest on are certain while their p would reach 1. ``sized``
    has ``src``, ``k`` and ``size``, ``targets`` ``src`` and ``need``. A source has at most 64 classes, so the windows are
    small. Returns ``src``, ``k``, ``p`` and ``left``, the need less the certain classes' words.
    """
    per = sized.groupBy("src", "k").agg(F.sum("size").alias("w")).join(targets.where("need > 0").select("src", "need"), "src")
    damped = 1 / F.sqrt(F.pow(F.lit(2.0), F.col("k")))
    up = W.partitionBy("src").orderBy("k")
    per = per.withColumn("damped", damped).withColumn("before", F.sum("w").over(up) - F.col("w"))
    per = per.withColumn("tail", F.sum(F.col("w") * F.col("damped")).over(W.partitionBy("src").orderBy(F.col("k").desc())))
    per = per.withColumn("c", (F.col("need") - F.col("before")) / F.col("tail"))
    open_ = F.min(F.when(F.col("c") * F.col("damped") < 1, F.struct("k", "c", (F.col("need") - F.col("before")).alias("left")))).over(W.partitionBy("src"))
    per = per.withColumn("open", open_)
    p = F.when(F.col("open").isNull() | (F.col("k") < F.col("open.k")), 1.0).otherwise(F.col("open.c") * F.col("damped"))
    return per.select("src", "k", p.alias("p"), F.coalesce("open.left", F.lit(0.0)).alias("left"))


def closing_sizes(free: DataFrame, gaps: DataFrame) -> DataFrame:
    """How many rows of which size close each source's ``gap``: the largest that fits, as often as it fits and occurs, then the next; at last one more of the smallest size that is left, if that brings the source nearer.

    ``free`` has ``src`` and ``size``, one row a document; ``gaps`` has ``src`` and ``gap``. Returns ``src``, ``size``, ``take``.
    A source's fold goes over its distinct sizes up to the gap, which is less than one row's size; its result has few entries, since a size taken as often as it fits leaves less than itself.
    """
    sizes = free.groupBy("src", "size").agg(F.count("*").alias("n")).join(gaps.where("gap > 0"), "src")
    fits = F.col("size") <= F.col("gap")
    per = sizes.groupBy("src").agg(
        F.max("gap").alias("gap"), F.min(F.when(~fits, F.col("size"))).alias("over"), F.sort_array(F.collect_list(F.when(fits, F.struct("size", "n"))), asc=False).alias("sizes")
    )
    takes = "array<struct<size: long, take: long>>"
    start = F.struct(F.col("gap").alias("gap"), F.array().cast(takes).alias("takes"))

    def step(s, x):
        take = F.least(F.floor(s["gap"] / x["size"]), x["n"])
        taken = F.concat(s["takes"], F.array(F.struct(x["size"].alias("size"), take.alias("take"))))
        return F.when(take > 0, F.struct((s["gap"] - take * x["size"]).alias("gap"), taken.alias("takes"))).otherwise(s)

    per = per.withColumn("end", F.aggregate("sizes", start, step))
    used = lambda x: F.coalesce(F.get(F.filter(F.col("end.takes"), lambda t: t["size"] == x["size"]), F.lit(0))["take"], F.lit(0))
    least = F.least(F.array_min(F.transform(F.filter("sizes", lambda x: x["n"] > used(x)), lambda x: x["size"])), F.col("over"))
    nearer = F.abs(least - F.col("end.gap")) < F.col("end.gap")
    last = F.when(nearer, F.array(F.struct(least.alias("size"), F.lit(1).cast("long").alias("take")))).otherwise(F.array().cast(takes))
    return per.select("src", F.inline(F.concat("end.takes", last))).groupBy("src", "size").agg(F.sum("take").alias("take"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: int = 17, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """How often each row enters a mix whose sources give their targets' words.

    A row is wanted ``r = target / source words`` times: ``floor(r)`` copies are certain, and the words that are then
    still needed come from a Pareto order sample. In it a row's inclusion probability p falls with the square root of
    its size (by classes of powers of two) and sums, over the rows' words, to the need; small rows whose p would pass 1
    are certain. A row's rank is the odds of a random number over the odds of its p. The sample has a fixed size in
    words: rows enter in rank order while they fit below the need. What is then still open, less than one row, is closed
    by free rows: the largest size that fits, as often as it fits, then the next, the first rows by rank of each; at last
    one more of the smallest free size, if that brings the source nearer to its target. So a source misses its target
    by at most half its smallest free row, as a rule by nothing.

    Returns the id column, ``source``, ``size``, ``source_size``, ``target``, ``copies`` (int) and ``taken`` (long,
    ``copies * size``). Null text: size 0, taken 0 words. Null source: a source of its own, last. Rows with equal ids
    share a random number; ties in rank go by id and text hash. Repeated rows are separate rows of the sample. Empty
    table: no rows. Extra columns are not read. No row is taken more than ``most`` times.

    Cost: the text is read once; sizes (a few numbers a row) are written to the shared folder. The sample is a sum per
    source and cell of the rank order and a window inside cells.
    """
    rows, targets, picked, _ = _sampled(docs, weights, most, seed, id_col, text)
    nth = rows.withColumn("nth", F.row_number().over(W.partitionBy("src", "id", "crc").orderBy("size")))
    out = nth.join(picked, [nth.src == picked.psrc, nth.id.eqNullSafe(picked.pid), nth.crc == picked.pcrc], "left").join(targets, "src")
    copies = (F.col("whole") + F.when(F.col("nth") <= F.coalesce("extra", F.lit(0)), 1).otherwise(0)).cast("int")
    return out.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


def _named(value: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), value.cast("string")), F.lit("n"))


def _crc(text: Column) -> Column:
    return F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8"))


def _sampled(docs: DataFrame, weights: tuple[int, ...], most: int, seed: int, id_col: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Sized rows (id, source, src, size, crc); per src the source's target and certain copies; how many rows equal in id, source and text hash are picked besides."""
    body = F.coalesce(F.col(text), F.lit(""))
    sized = docs.select(F.col(id_col).alias("id"), F.col("source").cast("string").alias("source"), F.regexp_count(body, F.lit(WORD)).cast("long").alias("size"), _crc(F.col(text)).alias("crc"))
    rows = stash(sized.withColumns({"src": _named(F.col("source")), "k": size_class(F.col("size")), "u": uniform(seed, F.col("id"))}), "mix")
    targets = source_targets(rows, weights, most).select(_named(F.col("source")).alias("src"), "source_size", "target")
    targets = targets.withColumn("whole", F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most))).otherwise(0).cast("long"))
    targets = stash(targets.withColumn("need", F.col("target") - F.col("whole") * F.col("source_size")), "mix")
    free = rows.where("size > 0").select("id", "src", "size", "crc", "k", "u")
    free = free.join(inclusion(free, targets), ["src", "k"])
    certain = free.where("p >= 1").select("id", "src", "crc")
    # odds of the random number over the odds of inclusion
    ranked = free.where("p < 1").withColumn("rank", F.col("u") / (1 - F.col("u")) * ((1 - F.col("p")) / F.col("p")))
    ranked = ranked.withColumn("cell", F.floor(F.log("rank") * CELLS))
    cells = ranked.groupBy("src", "cell").agg(F.sum("size").alias("w"))
    cells = cells.withColumn("base", F.sum("w").over(W.partitionBy("src").orderBy("cell")) - F.col("w")).drop("w")
    inside = F.sum("size").over(W.partitionBy("src", "cell").orderBy("rank", "id", "crc").rowsBetween(W.unboundedPreceding, 0))
    ranked = ranked.withColumn("inside", inside).join(cells, ["src", "cell"]).withColumn("fits", F.col("base") + F.col("inside") <= F.col("left"))
    ranked = stash(ranked.select("id", "src", "crc", "size", "rank", "cell", "left", "fits"), "mix")
    gaps = ranked.groupBy("src").agg((F.max("left") - F.sum(F.when(F.col("fits"), F.col("size")).otherwise(0))).alias("gap"))
    free = ranked.where("not fits")
    wanted = closing_sizes(free, gaps)
    # the first rows by rank of each size that closes: whole cells first, so that no size is one task's work
    cells = free.join(wanted, ["src", "size"]).groupBy("src", "size", "cell").agg(F.count("*").alias("n"), F.max("take").alias("take"))
    cells = cells.withColumn("left", F.col("take") - (F.sum("n").over(W.partitionBy("src", "size").orderBy("cell")) - F.col("n"))).where("left > 0").select("src", "size", "cell", "left")
    near = free.drop("left").join(cells, ["src", "size", "cell"])
    closing = near.withColumn("nth", F.row_number().over(W.partitionBy("src", "size", "cell").orderBy("rank", "id", "crc"))).where("nth <= left").select("id", "src", "crc")
    picked = certain.union(ranked.where("fits").select("id", "src", "crc")).union(closing)
    picked = stash(picked.groupBy(F.col("id").alias("pid"), F.col("src").alias("psrc"), F.col("crc").alias("pcrc")).agg(F.count("*").alias("extra")), "mix")
    release(ranked)
    return rows.select("id", "source", "src", "size", "crc"), targets, picked, rows


def sample(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: int = 17, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The mixed table itself: every row of ``docs`` as often as ``mix`` takes it, with all its columns. Texts are shuffled once."""
    _, targets, picked, rows = _sampled(docs, weights, most, seed, id_col, text)
    whole = targets.select(F.col("src").alias("__src"), F.col("whole").alias("__whole"))
    extra = picked.select(_named(F.col("pid")).alias("__id"), F.col("psrc").alias("__src"), F.col("pcrc").alias("__crc"), F.col("extra").alias("__extra"))
    keys = ["__id", "__src", "__crc"]
    keyed = docs.withColumns({"__id": _named(F.col(id_col)), "__src": _named(F.col("source")), "__crc": _crc(F.col(text))})
    # rows of sources without certain copies that are not picked go before their texts move, as far as the join can do so
    out = keyed.join(whole, "__src").join(extra, keys, "left").where("__whole > 0 or __extra is not null")
    out = out.withColumn("__nth", F.row_number().over(W.partitionBy(*keys).orderBy(F.lit(1))))
    copies = F.col("__whole") + F.when(F.col("__nth") <= F.coalesce("__extra", F.lit(0)), 1).otherwise(0)
    release(rows)
    return out.withColumn("__copies", copies.cast("int")).where("__copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*docs.columns)


#: The same law in SQL; rows are told apart by their number, which decides only between rows of equal ids.
ORACLE_SQL = """
WITH RECURSIVE docs AS (
  SELECT doc_id AS id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         row_number() OVER () AS rid FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source),
w AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1] AS weight, 3 * source_size AS cap FROM per),
l AS (SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0) AS lft, sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS opn FROM w
  WINDOW o AS (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT *, CAST(lft AS DOUBLE) / opn AS level, cap <= CAST(lft AS DOUBLE) / opn * weight AS capped FROM l),
t AS (SELECT source, source_size, CASE WHEN capped THEN CAST(cap AS DOUBLE) ELSE (max_by(level, opn) FILTER (NOT capped) OVER ()) * weight END AS target FROM v),
s AS (SELECT source, source_size, target, CASE WHEN source_size > 0 THEN CAST(least(floor(target / source_size), 3) AS BIGINT) ELSE 0 END AS whole FROM t),
n AS (SELECT *, coalesce(source, chr(1)) AS src, target - whole * source_size AS need FROM s),
u AS (SELECT id, coalesce(source, chr(1)) AS src, size, rid, length(bin(size)) - 1 AS k,
         (CAST('0x' || substr(md5('17|' || coalesce(CAST(id AS VARCHAR), '')), 1, 12) AS BIGINT) + 0.5) / 281474976710656.0 AS u FROM docs WHERE size > 0),
k AS (SELECT u.src, k, sum(size) AS w, any_value(need) AS need, 1 / sqrt(pow(2.0, k)) AS damped FROM u JOIN n ON u.src = n.src WHERE need > 0 GROUP BY u.src, k),
c AS (SELECT *, need - (sum(w) OVER (PARTITION BY src ORDER BY k) - w) AS lft,
         (need - (sum(w) OVER (PARTITION BY src ORDER BY k) - w)) / (sum(w * damped) OVER (PARTITION BY src ORDER BY k DESC)) AS c FROM k),
o AS (SELECT *, min(CASE WHEN c * damped < 1 THEN k END) OVER (PARTITION BY src) AS k0 FROM c),
p AS (SELECT src, k, CASE WHEN k0 IS NULL OR k < k0 THEN 1.0 ELSE (max(CASE WHEN k = k0 THEN c END) OVER (PARTITION BY src)) * damped END AS p,
         coalesce(max(CASE WHEN k = k0 THEN lft END) OVER (PARTITION BY src), 0.0) AS lft FROM o),
f AS (SELECT u.*, p, lft, u / (1 - u) * ((1 - p) / p) AS rank FROM u JOIN p ON u.src = p.src AND u.k = p.k),
r AS (SELECT *, sum(size) OVER (PARTITION BY src ORDER BY rank, id, rid ROWS UNBOUNDED PRECEDING) <= lft AS fits FROM f WHERE p < 1),
g AS (SELECT src, max(lft) - sum(CASE WHEN fits THEN size ELSE 0 END) AS gap FROM r GROUP BY src),
z AS (SELECT r.src, size, count(*) AS n, any_value(gap) AS gap FROM r JOIN g ON r.src = g.src WHERE NOT fits AND gap > 0 GROUP BY r.src, size),
d AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY size DESC) AS nth FROM z WHERE size <= gap),
w2 AS (
  SELECT src, CAST(0 AS BIGINT) AS nth, CAST(0 AS BIGINT) AS size, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS take, CAST(any_value(gap) AS DOUBLE) AS gap FROM z GROUP BY src
  UNION ALL
  SELECT w2.src, d.nth, d.size, d.n, CAST(least(floor(w2.gap / d.size), d.n) AS BIGINT), w2.gap - least(floor(w2.gap / d.size), d.n) * d.size FROM w2 JOIN d ON d.src = w2.src AND d.nth = w2.nth + 1),
y AS (SELECT src, max_by(gap, nth) AS gap FROM w2 GROUP BY src),
v2 AS (SELECT z.src, min(z.size) AS size, any_value(y.gap) AS gap FROM z JOIN y ON z.src = y.src LEFT JOIN w2 ON w2.src = z.src AND w2.size = z.size WHERE z.n > coalesce(w2.take, 0) GROUP BY z.src),
q AS (SELECT src, size, sum(take) AS take FROM (SELECT src, size, take FROM w2 WHERE take > 0 UNION ALL SELECT src, size, 1 FROM v2 WHERE abs(size - gap) < gap) GROUP BY src, size),
e AS (SELECT rid, row_number() OVER (PARTITION BY r.src, r.size ORDER BY rank, id, rid) <= take AS taken FROM r JOIN q ON r.src = q.src AND r.size = q.size WHERE NOT fits),
x AS (SELECT rid FROM f WHERE p >= 1 UNION ALL SELECT rid FROM r WHERE fits UNION ALL SELECT rid FROM e WHERE taken)
SELECT d.id AS doc_id, d.size, n.source_size, n.target, CAST((whole + CASE WHEN d.rid IN (SELECT rid FROM x) THEN 1 ELSE 0 END) * d.size AS BIGINT) AS taken,
       CAST(whole + CASE WHEN d.rid IN (SELECT rid FROM x) THEN 1 ELSE 0 END AS INTEGER) AS copies
FROM docs d JOIN n ON coalesce(d.source, chr(1)) = n.src"""
