"""Operator 1, sharding by Hilbert order. DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import release, stash

#: Rows of one curve cell are dealt over so many sub-cells, so that no hot cell is one task's work.
SALTS = 64


def _entry(w: int) -> int:
    low = 0 if w == 0 else 2 * ((w - 1) // 2)
    return low ^ (low >> 1)


def _turn(w: int, dims: int) -> int:
    n = 0 if w == 0 else (w - 1 if w % 2 == 0 else w)
    ones = 0
    while n & 1:
        ones, n = ones + 1, n >> 1
    return ones % dims


def hilbert_index(coords: list[Column], bits: int) -> Column:
    """Position on the Hilbert curve of a point of ``2**bits`` cells a side (Hamilton's state form), as one fold over the bit planes.

    The state is the entry corner and the direction of the current sub-cube; the tables of both are made from their
    rule, ``2**len(coords)`` entries each.
    """
    n = len(coords)
    full = (1 << n) - 1
    entries = F.array(*[F.lit(_entry(w)) for w in range(1 << n)])
    turns = F.array(*[F.lit(_turn(w, n)) for w in range(1 << n)])

    def rotl(x: Column, k: Column) -> Column:
        return (F.call_function("shiftleft", x, k).bitwiseOR(F.call_function("shiftright", x, F.lit(n) - k))).bitwiseAND(F.lit(full))

    def rotr(x: Column, k: Column) -> Column:
        return rotl(x, (F.lit(n) - k) % F.lit(n))

    def step(state: Column, word: Column) -> Column:
        turned = rotr(word.bitwiseXOR(state["e"]), (state["d"] + 1) % F.lit(n))
        gray = reduce(lambda a, k: a.bitwiseXOR(F.shiftright(turned, k)), range(1, n), turned)
        out = F.transform(
            F.array(gray),
            lambda w: F.struct(
                state["e"].bitwiseXOR(rotl(F.get(entries, w), (state["d"] + 1) % F.lit(n))).alias("e"),
                ((state["d"] + F.get(turns, w) + 1) % F.lit(n)).alias("d"),
                (state["h"] * F.lit(1 << n) + w).cast("long").alias("h"),
            ),
        )
        return F.get(out, F.lit(0))

    words = F.transform(
        F.sequence(F.lit(bits - 1), F.lit(0)),
        lambda i: reduce(lambda a, b: a + b, [F.call_function("shiftright", c.cast("int"), i).bitwiseAND(F.lit(1)) * F.lit(1 << k) for k, c in enumerate(coords)]).cast("int"),
    )
    start = F.struct(F.lit(0).alias("e"), F.lit(0).alias("d"), F.lit(0).cast("long").alias("h"))
    return F.aggregate(words, start, step, lambda s: s["h"])


def cells_of(rows: DataFrame, col: str, cells: int, total: int) -> DataFrame:
    """Cell of every distinct value of a column: the share of rows that come before it, in ``cells`` steps."""
    k = col.removeprefix("q")
    counts = rows.groupBy(col).agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.orderBy(F.col(col).asc_nulls_first())) - F.col("n")
    return counts.select(F.col(col).alias(f"v{k}"), F.least(F.floor(before * cells / max(total, 1)), F.lit(cells - 1)).cast("int").alias(f"cell{k}"))


def shard(
    docs: DataFrame, shards: int = 24, dims: tuple[str, ...] = ("source", "lang"), text: str = "text", id_col: str = "doc_id", bits: int = 5, law: str = "rows"
) -> DataFrame:
    """Deals every row to a shard: rows in Hilbert order of (dims, text size), cut into equal runs.

    Each dimension is quantised at its own quantiles into ``2**bits`` cells: its distinct values are ranked (strings by
    code point, the text by its size, null first) and a value's cell is that of the rows before it. ``law`` is ``rows``
    (counts of shards differ by one at most) or ``bytes`` (a shard takes the rows whose first byte falls into its equal
    part of all bytes). Returns the id column, ``size`` (UTF-8 bytes of the text plus 8), ``text_crc32``, ``law``,
    ``shard``, ``slot`` (position in the shard, from 0) and ``hilbert``. Null text is empty. Ties (equal rows of one
    cell): by text hash and id. Empty table: no rows. Extra columns are not read.

    Cost: texts are read once, for rows of a few numbers that are written to the shared folder; ranks are a window over
    the distinct values of a dimension; then one pass counts cells (``2**(bits * dimensions) * SALTS`` at most, whatever
    the input) and one ranks rows inside cells; cumulated counts of cells are windows over at most
    ``2**(bits * dimensions / 2)`` groups and within those, so no task sees all rows.
    """
    if law not in ("rows", "bytes"):
        raise ValueError(f"law is rows or bytes, not {law}")
    body = F.coalesce(F.col(text), F.lit(""))
    sized = docs.select(
        F.col(id_col).alias("id"), (F.octet_length(body).cast("long") + 8).alias("size"), F.crc32(F.encode(body, "UTF-8")).alias("crc"), *[F.col(c).alias(f"q{k}") for k, c in enumerate(dims)]
    )
    rows = stash(sized.withColumn(f"q{len(dims)}", F.col("size")), "sized")
    n, cells = len(dims) + 1, 1 << bits
    sums = rows.agg(F.count("*").alias("rows"), F.sum("size").alias("bytes")).first()
    total = sums[law] or 1
    spot = rows
    for k in range(n):
        spot = spot.join(cells_of(rows, f"q{k}", cells, sums["rows"]), F.col(f"q{k}").eqNullSafe(F.col(f"v{k}"))).drop(f"v{k}")
    spot = spot.select("id", "size", "crc", hilbert_index([F.col(f"cell{k}") for k in range(n)], bits).alias("hilbert"), F.pmod(F.xxhash64("crc", "id"), F.lit(SALTS)).cast("int").alias("salt"))
    spot = stash(spot, "spots")
    release(rows)
    weight = F.lit(1).cast("long") if law == "rows" else F.col("size")
    half = 1 << (bits * n // 2)
    counted = spot.groupBy("hilbert", "salt").agg(F.sum(weight).alias("w")).withColumn("top", F.floor(F.col("hilbert") / half))
    tops = counted.groupBy("top").agg(F.sum("w").alias("tw")).withColumn("before", F.sum("tw").over(W.orderBy("top")) - F.col("tw")).drop("tw")
    inner = F.sum("w").over(W.partitionBy("top").orderBy("hilbert", "salt")) - F.col("w")
    cells_at = counted.withColumn("inner", inner).join(F.broadcast(tops), "top").select("hilbert", "salt", (F.col("before") + F.col("inner")).alias("offset"))
    order = W.partitionBy("hilbert", "salt").orderBy("crc", "id")
    own = F.sum(weight).over(order.rowsBetween(W.unboundedPreceding, 0)) - weight
    placed = spot.withColumn("own", own).join(cells_at, ["hilbert", "salt"]).withColumn("rank", F.col("offset") + F.col("own"))
    out = placed.withColumn("shard", F.expr(f"cast((rank * {shards}L) div {total}L as int)"))
    if law == "rows":
        slot = F.col("rank") - F.expr(f"(shard * {total}L + {shards - 1}L) div {shards}L")
    else:
        slot = None
    out = out.select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit(law).alias("law"), "shard", *([slot.cast("long").alias("slot")] if slot is not None else []), "hilbert", "rank"
    )
    if law == "rows":
        return out.drop("rank")
    return _slots_by_bytes(out, id_col)


def _slots_by_bytes(out: DataFrame, id_col: str) -> DataFrame:
    """Gapless positions inside shards of unequal counts: counts of 64 byte runs a shard first, then ranks inside a run."""
    runs = out.withColumn("run", F.pmod(F.floor(F.col("rank") / F.lit(1 << 20)), F.lit(1 << 30)))
    counts = runs.groupBy("shard", "run").agg(F.count("*").alias("c"))
    counts = counts.withColumn("base", F.sum("c").over(W.partitionBy("shard").orderBy("run")) - F.col("c")).drop("c")
    slot = F.row_number().over(W.partitionBy("shard", "run").orderBy("rank", id_col)) - 1
    return runs.withColumn("in_run", slot).join(counts, ["shard", "run"]).withColumn("slot", (F.col("base") + F.col("in_run")).cast("long")).drop("run", "base", "in_run", "rank")
