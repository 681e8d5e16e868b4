"""Operator 4, line dedup by a segment-partition edit join. DataFrame functions only.

If two lines differ by at most t edits and one is cut into t + 1 segments, one segment stands unchanged in the other,
near its own place. Segments are indexed by (line length, segment number, text); every line probes the lengths from its
own down to t less, at the few places where a segment can stand. Candidates are verified with a bit-parallel automaton
that follows a band of 2 t + 1 diagonals.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import release, stash
from .graph import connected_components

#: Letters counted to tell lines apart.
COUNTED = "abcdefghijklmnopqrstuvwxyz"
Steps = tuple[tuple[int, int], ...]
#: Least length of a line in code points, and the edits allowed from there on.
STEPS: Steps = ((30, 2), (15, 1))
#: Letters after which a pair is given up if no state is left.
LOOK = 20


def within_edits(a: Column, b: Column, t: int) -> Column:
    """Whether two strings are within t edits: insertion, deletion or replacement of a code point.

    What both begin and end with is cut off first, by halving steps. The rest runs through t + 1 states of 2 t + 1
    bits: bit k of state d says that some prefix pair on diagonal k - t is within d edits.
    """
    full = (1 << (2 * t + 1)) - 1
    steps = F.array(*[F.lit(1 << k) for k in range(21, -1, -1)])

    def let(value: Column, then) -> Column:
        """Names a value, so that it is worked out once: what a lambda mentions is worked out at every step."""
        return F.get(F.transform(F.array(value), then), F.lit(0))

    def common(x: Column, y: Column) -> Column:
        grow = lambda n, s, most: F.when((n + s <= most) & (F.substring(x, n + 1, s) == F.substring(y, n + 1, s)), n + s).otherwise(n)
        return let(F.least(F.length(x), F.length(y)), lambda most: F.aggregate(steps, F.lit(0), lambda n, s: grow(n, s, most)))

    def banded(x: Column, y: Column) -> Column:
        def masks(u: Column, v: Column) -> Column:
            padded = F.concat(F.array_repeat(F.lit(""), t), F.split(u, ""), F.array_repeat(F.lit(""), t))
            bits = lambda p, c, j: reduce(lambda m, n: m + n, [F.when(F.get(p, j + k) == c, F.lit(1 << k)).otherwise(F.lit(0)) for k in range(2 * t + 1)])
            return let(padded, lambda p: F.transform(F.split(v, ""), lambda c, j: bits(p, c, j)))

        def step(s: Column, e: Column) -> Column:
            now: list[Column] = []
            for d in range(t + 1):
                r = s[f"r{d}"].bitwiseAND(e)
                if d:
                    old = s[f"r{d - 1}"]
                    r = r.bitwiseOR(old).bitwiseOR(F.shiftright(old, 1)).bitwiseOR(F.shiftleft(now[-1], 1))
                now.append(r.bitwiseAND(F.lit(full)))
            return F.struct(*[n.alias(f"r{d}") for d, n in enumerate(now)])

        start = F.struct(*[F.lit(((1 << (d + 1)) - 1) << t & full).alias(f"r{d}") for d in range(t + 1)])
        last = F.length(x) - F.length(y) + t
        hit = lambda s: F.call_function("shiftright", s[f"r{t}"], last).bitwiseAND(F.lit(1)) == 1
        return F.when(F.length(y) == 0, F.length(x) <= t).when(F.length(x) == 0, F.length(y) <= t).when(
            # the last letters differ too, so one edit lies behind these first ones
            (F.length(y) > 2 * LOOK) & F.aggregate(masks(F.substring(x, 1, LOOK + t), F.substring(y, 1, LOOK)), start, step, lambda s: s[f"r{max(t - 1, 0)}"] == 0), False
        ).otherwise(F.aggregate(masks(x, y), start, step, hit))

    def cut(x: Column, y: Column, then) -> Column:
        """Goes on with what is left of two strings behind their common beginning."""
        pair = lambda u, v: F.struct(u.alias("x"), v.alias("y"))
        rest = lambda p: let(common(p["x"], p["y"]), lambda n: let(pair(F.substr(p["x"], n + 1), F.substr(p["y"], n + 1)), then))
        return let(pair(x, y), rest)

    near = F.abs(F.length(a) - F.length(b)) <= t
    body = cut(a, b, lambda p: cut(F.reverse(p["x"]), F.reverse(p["y"]), lambda q: banded(q["x"], q["y"])))
    return F.coalesce(near & body, F.lit(False))


def steps_of(steps: Steps) -> list[tuple[int, int, int | None]]:
    """(edits, least length, length that a step stays under) of each step."""
    down = sorted(steps, reverse=True)
    return [(t, least, down[k - 1][0] if k else None) for k, (least, t) in enumerate(down) if t > 0]


def places(steps: Steps) -> list[tuple[int, int, int, int, int, int]]:
    """Where a line is looked up: edits, the partner's least length and the length it stays under, how much shorter it is, segment, shift.

    A partner of ``delta`` less code points is cut into t + 1 segments. Segment i (from 0) starts in the longer line
    within min(i, t - i) of its own place on the left or, counted from the end, on the right; both bounds together leave
    about (t * t - delta * delta) / 2 + t + 1 places a length. Places of delta and shift 0 are a line's own segments,
    under which it is indexed too.
    """
    out = []
    for t, least, below in steps_of(steps):
        for delta in range(t + 1):
            for i in range(t + 1):
                low, high = max(-i, delta - (t - i)), min(i, delta + (t - i))
                out += [(t, least, below or 1 << 30, delta, i, k) for k in range(low, high + 1)]
    return out


def keys(lines: DataFrame, steps: Steps) -> DataFrame:
    """``key`` and ``code`` of every place of every line: its h1, whose lowest bit is 0, plus 1 if the place is one of its own segments.

    The last segments of a line take what does not divide evenly.
    """
    names = ["t", "least", "below", "delta", "i", "shift"]
    table = F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(names, place)]) for place in places(steps)])
    at = lambda c: F.col(f"place.{c}")
    rows = lines.withColumn("n", F.length("line")).select("h1", "line", "n", F.explode(table).alias("place"))
    rows = rows.withColumn("other", F.col("n") - at("delta")).where((F.col("other") >= at("least")) & (F.col("other") < at("below")))
    base, extra = F.expr("other div (place.t + 1)").cast("int"), F.col("other") % (at("t") + 1)
    rows = rows.withColumns({
        "size": base + F.when(at("t") + 1 - at("i") <= extra, 1).otherwise(0),
        "start": base * at("i") + F.greatest(F.lit(0), at("i") - at("t") - 1 + extra) + at("shift"),
    }).where("start >= 0 and start + size <= n")
    own = F.when((at("delta") == 0) & (at("shift") == 0), 1).otherwise(0)
    return rows.select(F.xxhash64("other", "place.i", F.expr("substring(line, start + 1, size)")).alias("key"), (F.col("h1") + own).alias("code"))


def lines_of(docs: DataFrame, text: str, *keep: str) -> DataFrame:
    """Every line that has a word, with its place ``pos``."""
    lines = docs.select(*keep, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)).alias("pos", "line"))
    return lines.where(F.col("line").rlike(r"[^\x20\x09-\x0D]"))


def hashes() -> list[Column]:
    """Two independent hashes of a line as it stands; the lowest bit of the first is 0."""
    return [F.shiftleft(F.xxhash64("line"), 1).alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2")]


def letter_counts(line: Column) -> Column:
    """How often each of the counted letters occurs, modulo 128, nine letters to a number that is not negative."""
    count = lambda c: (F.length(line) - F.length(F.replace(line, F.lit(c), F.lit("")))).cast("long").bitwiseAND(F.lit(127).cast("long"))
    pack = lambda letters: reduce(lambda a, c: F.shiftleft(a, 7).bitwiseOR(count(c)), letters[1:], count(letters[0]))
    return F.array(*[pack(COUNTED[i : i + 9]) for i in range(0, len(COUNTED), 9)])


def counts_apart(a: Column, b: Column) -> Column:
    """Least sum of differences of the counts; an edit changes two counts by one at most."""
    part = lambda x, i: F.shiftright(F.get(x, F.lit(i // 9)), 7 * (i % 9)).bitwiseAND(F.lit(127).cast("long"))
    apart = lambda i: F.abs(part(a, i) - part(b, i))
    places = [9 * (i // 9) + k for i in range(0, len(COUNTED), 9) for k in range(min(9, len(COUNTED) - i))]
    return reduce(lambda u, v: u + v, [F.least(apart(i), 128 - apart(i)) for i in places])


def line_links(lines: DataFrame, steps: Steps) -> DataFrame:
    """Links between different lines: ``a``, ``a2``, ``b``, ``b2``, the hashes of both. ``lines`` has h1, h2 and line, each line once.

    The keys of all lines are shuffled once. Keys under which only one line stands go there and then. Of the lines left,
    few, the letters are counted; their own segments are joined with all places, and pairs whose letter counts are too
    far apart never leave that join. Lines left are joined back by merging at any size, so nothing that grows is broadcast.
    """
    parts = steps_of(steps)
    most = max((t for t, _, _ in parts), default=0)
    code = F.col("code")
    line, own = code.bitwiseAND(F.lit(-2).cast("long")), code.bitwiseAND(F.lit(1).cast("long"))
    keyed = keys(lines, steps).repartition("key")
    live = keyed.groupBy("key").agg(F.min(line).alias("low"), F.max(line).alias("high"), F.max(own).alias("own"))
    live = live.where("low < high and own = 1").select("key").hint("shuffle_hash")
    keyed = stash(keyed.join(live, "key").select("key", line.alias("h1"), (own == 1).alias("own")), "keys")
    texts = stash(lines.join(keyed.select("h1").distinct().hint("merge"), "h1", "left_semi").withColumn("counts", letter_counts(F.col("line"))), "candidate-lines")
    counted = stash(keyed.join(texts.select("h1", "counts"), "h1"), "counted")
    one = counted.where("own").select("key", F.col("h1").alias("a"), "counts")
    two = counted.select("key", F.col("h1").alias("b"), F.col("counts").alias("others"), F.col("own").alias("both"))
    # two own segments meet twice, the pair is taken once
    met = one.join(two, "key").where((F.col("a") != F.col("b")) & (~F.col("both") | (F.col("a") < F.col("b"))) & (counts_apart(F.col("counts"), F.col("others")) <= 2 * most))
    pairs = stash(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "candidates")
    side = lambda h, h2, line: texts.select(F.col("h1").alias(h), F.col("h2").alias(h2), F.col("line").alias(line))
    met = pairs.join(side("a", "a2", "x"), "a").join(side("b", "b2", "y"), "b")
    shorter = F.least(F.length("x"), F.length("y"))
    near = reduce(lambda e, s: e.when(shorter >= s[1], within_edits(F.col("x"), F.col("y"), s[0])), parts, F.when(F.lit(False), F.lit(False)))
    links = stash(met.where(F.coalesce(near, F.lit(False))).select("a", "a2", "b", "b2").distinct(), "links")
    release(keyed, texts, counted, pairs)
    return links


def dedup_lines(docs: DataFrame, steps: Steps = STEPS, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Marks the lines of every row that repeat an earlier line of the table, exactly or within few edits.

    Lines are what ``\\n`` separates; lines without a word are no lines here and always stay. Two lines are linked if
    they are equal, or differ by no more edits than ``steps`` allow to the shorter of them ((30, 2), (15, 1): two edits
    from 30 code points on, one from 15, shorter lines must be equal). Linked lines, however indirectly, form a class,
    and only the first of a class (smallest id, then place) stays. Returns the id column, ``row`` (a hash of id and
    text, of later copies also of their number), ``n_lines``, ``n_exact`` and ``n_near`` (lines dropped because an equal
    or only a similar one comes first), and ``dropped`` (places of dropped lines, from 0). Null and empty text: no
    lines. Very long lines take part whole. Rows with null ids come first. Repeated rows: later ones lose all their
    lines. Empty table: no rows. Extra columns are not read.
    """
    docs = docs.select(F.col(id_col), F.col(text).alias("__text"), row_hash(id_col, text).alias("row"))
    per = row_marks(docs, steps, "__text", id_col)
    none = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    out = docs.select(F.col(id_col), "row", nth_of("row").alias("nth")).join(per, "row", "left")
    later = F.col("nth") > 1
    return out.select(
        id_col,
        F.when(later, F.xxhash64("row", "nth")).otherwise(F.col("row")).alias("row"),
        none(F.size("places")).alias("n_lines"),
        none(F.when(later, F.size("places")).otherwise(F.col("n_exact"))).alias("n_exact"),
        none(F.when(~later, F.col("n_near"))).alias("n_near"),
        F.coalesce(F.when(later, F.col("places")).otherwise(F.col("dropped")), F.array().cast("array<int>")).alias("dropped"),
    )


def row_hash(id_col: str, text: str) -> Column:
    return F.xxhash64(F.col(id_col), F.coalesce(F.col(text), F.lit("")))


def nth_of(row: str) -> Column:
    """Number of a row among those of its hash; such rows are alike, so any order will do."""
    return F.row_number().over(W.partitionBy(row).orderBy(F.lit(1)))


def row_marks(docs: DataFrame, steps: Steps, text: str, id_col: str) -> DataFrame:
    """What ``dedup_lines`` says of the first of the rows of each hash ``row``: ``places`` of its lines, ``dropped`` ones, ``n_exact``, ``n_near`` and the number of ``copies``. Rows without lines are left out.

    Texts are split twice: into narrow occurrences of hashes, and into distinct lines long enough for edits; both are
    written once. Only lines that repeat or have a link are joined back to their occurrences.
    """
    occ = stash(lines_of(docs, text, "row", F.col(id_col).alias("id")).select("row", "id", "pos", *hashes()), "occurrences")
    shortest = min((least for _, least, _ in steps_of(steps)), default=1 << 30)
    long = lines_of(docs, text).select("line").where(F.length("line") >= shortest).distinct()
    distinct = stash(long.select(*hashes(), "line"), "lines")
    links = line_links(distinct, steps)
    of = links.select(F.col("a").alias("h1"), F.col("a2").alias("h2")).union(links.select("b", "b2")).distinct()
    classes = of.join(connected_components(links.select("a", "b")).withColumnRenamed("node", "h1"), "h1")
    first = occ.groupBy("h1", "h2").agg(F.min(F.struct("id", "row", "pos")).alias("own"), F.count("*").alias("n"))
    first = first.join(classes, ["h1", "h2"], "left").where("n > 1 or component is not null")
    first = stash(first.select("h1", "h2", "own", "component"), "first")
    lead = first.where("component is not null").groupBy("component").agg(F.min("own").alias("lead"))
    first = first.join(lead, "component", "left").select("h1", "h2", "own", F.coalesce("lead", "own").alias("lead"))
    here = occ.join(first, ["h1", "h2"])
    place = F.struct("id", "row", "pos")
    here = here.withColumn("why", F.when(place.eqNullSafe(F.col("lead")), 0).when(place.eqNullSafe(F.col("own")), 2).otherwise(1)).where("why > 0")
    # copies of a row share its places: sets and the quotient count each place once
    gone = here.groupBy("row").agg(F.sum((F.col("why") == 1).cast("long")).alias("n_exact"), F.sum((F.col("why") == 2).cast("long")).alias("n_near"), F.array_sort(F.collect_set("pos")).alias("dropped"))
    per = occ.groupBy("row").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("pos")).alias("places")).withColumn("copies", (F.col("n") / F.size("places")).cast("long"))
    one = lambda c: F.coalesce((F.col(c) / F.col("copies")).cast("long"), F.lit(0).cast("long")).alias(c)
    out = per.join(gone, "row", "left").select("row", "places", "copies", one("n_exact"), one("n_near"), F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"))
    release(distinct, links)
    return out


def clean(docs: DataFrame, steps: Steps = STEPS, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows with their repeated lines taken out; all other columns as they are. Rows that repeat wholly keep their first one's lines only.

    Repeated rows (same id and text) are told apart by their number among themselves.
    """
    narrow = docs.select(F.col(id_col), F.col(text).alias("__text"), row_hash(id_col, text).alias("row"))
    marked = row_marks(narrow, steps, "__text", id_col).where("size(dropped) > 0 or copies > 1")
    marked = marked.select(F.col("row").alias("__row"), F.struct("dropped", "places").alias("__marks"))
    out = docs.withColumn("__row", row_hash(id_col, text)).withColumn("__nth", nth_of("__row")).join(marked, "__row", "left")
    out = out.withColumn("__dropped", F.when(F.col("__nth") > 1, F.col("__marks.places")).otherwise(F.col("__marks.dropped")))
    lines = F.split(F.col(text), "\n", -1)
    kept = F.array_join(F.filter(lines, lambda _, i: ~F.array_contains("__dropped", i)), "\n")
    return out.withColumn(text, F.when(F.col("__dropped").isNull(), F.col(text)).otherwise(kept)).select(*docs.columns)
