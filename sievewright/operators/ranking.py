"""Windows, quotas and top-k over candidate listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window as W

from ..functions import text as T
from ..functions.folds import fold_sorted

# Places of the qualities in the display order and among the quotas' bands, and weights in the pools.
ORDER = {"2160p": 5, "1080p": 4, "720p": 3, "unknown": 2, "480p": 1, "SD": 0}
BANDS = {"2160p": 6, "1080p": 5, "720p": 4, "480p": 3, "SD": 2, "unknown": 1}
WEIGHT = {"1080p": 6, "720p": 5, "2160p": 4, "unknown": 3, "480p": 2, "SD": 1}


def placed(c: Column, places: dict[str, int]) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in places.items() for x in kv]), c), F.lit(0)).cast("long")


def rank_by(df: DataFrame, key: str, *order: Column, name: str = "rn") -> DataFrame:
    return df.withColumn(name, F.row_number().over(W.partitionBy(key).orderBy(*order)).cast("long"))


def down(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).desc()


def preference(source: Column, preferred: tuple) -> Column:
    """Place of a source in a list of preferred ones, from 1; those not listed come behind, all alike."""
    if not preferred:
        return F.lit(1)
    return F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(x) for x in preferred]), source), F.lit(0)), F.lit(len(preferred) + 1))


def candidate_order(dubbed_first: bool = True, preferred: tuple = (), exact: Column | None = None, instant: Column | None = None) -> list[Column]:
    """The order of the result list: exact episode, quality, dubbed, preferred source, instant play, not lied, seeders, arrival. What is not given does not count."""
    first = [exact.desc()] if exact is not None else []
    q = placed(F.col("quality"), ORDER)
    middle = [down("dubbed")] if dubbed_first else []
    middle += [preference(F.col("indexer"), preferred)] if preferred else []
    middle += [instant.desc()] if instant is not None else []
    return [*first, q.desc(), *middle, F.col("lied").asc(), down("seeders"), F.col("lid").asc()]


def rank_candidates(df: DataFrame, key: str = "request_id", dubbed_first: bool = True, preferred: tuple = (), exact: Column | None = None, instant: Column | None = None) -> DataFrame:
    """Numbers the candidates of each request in the order of the result list. ``exact`` (the title names the episode asked for) and ``instant`` (the hash is known to play at once) are conditions on the rows."""
    return rank_by(df, key, *candidate_order(dubbed_first, preferred, exact, instant))


def cinema(title: Column) -> Column:
    return T.source_of(title) == "CAM"


def _read_titles(df: DataFrame) -> DataFrame:
    """The rows with what the pools ask of a title."""
    t = F.col("title")
    return T.read_once(df, {"__cam": cinema(t), "__subtitled": T.audio_of(t) == "Legendado", "__alien": T.foreign_audio(t), "__target": T.looks_target(t) | T.target_signs(t)})


def _first_step(df: DataFrame, key: str, step: Column, *order: Column) -> DataFrame:
    """The rows of the lowest ``step`` that a key has, numbered in order; rows without a step go. That step stands first in the order, so no key is held whole."""
    w = W.partitionBy(key).orderBy("__step", *order)
    some = df.withColumn("__step", step).where(F.col("__step").isNotNull())
    some = some.withColumns({"rn": F.row_number().over(w).cast("long"), "__best": F.first("__step").over(w.rowsBetween(W.unboundedPreceding, 0))})
    return some.where(F.col("__step") == F.col("__best")).drop("__best")


def _told(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("__")])


def _own_step() -> Column:
    """Rows of priority origin: 1 if tagged as dubbed, 2 if they do not say they are subtitled."""
    mine = F.col("is_br") & ~F.col("__cam")
    return F.when(mine & F.col("dubbed"), 1).when(mine & ~F.col("__subtitled"), 2)


def pool_priority_dubbed(df: DataFrame, key: str = "request_id") -> DataFrame:
    """Priority-origin rows that are no recordings from a cinema: the tagged dubbed ones if the request has any, else all that do not say they are subtitled."""
    mine = _read_titles(df.where("is_br"))
    return _told(_first_step(mine, key, _own_step(), down("multi_work"), placed(F.col("quality"), WEIGHT).desc(), down("seeders"), F.col("lid")))


def pool_any_dubbed(df: DataFrame, key: str = "request_id") -> DataFrame:
    safe = _read_titles(df.where("dubbed")).where(~F.col("__cam"))
    return _told(rank_by(safe, key, down("multi_work"), placed(F.col("quality"), WEIGHT).desc(), down("seeders"), F.col("lid")))


def pool_top_seeded(df: DataFrame, floor: int = 5, key: str = "request_id", target_first: bool = True) -> DataFrame:
    """Rows with enough seeders that neither come from a cinema nor name a foreign language; packs first, then, if asked for, titles with a sign of the target language."""
    safe = _read_titles(df.where(F.col("seeders") >= floor)).where(~F.col("__cam") & ~F.col("__alien"))
    sign = [down("__target")] if target_first else []
    return _told(rank_by(safe, key, down("multi_work"), *sign, down("seeders"), placed(F.col("quality"), WEIGHT).desc(), F.col("lid")))


def pick_from_pool(pool: DataFrame, cached: DataFrame, k: int, key: str = "request_id") -> DataFrame:
    """First occurrence of each hash that is not cached, the first k a request. ``pool`` has ``rn``; ``cached`` has ``hash``."""
    first = pool.withColumn("seen", F.row_number().over(W.partitionBy(key, "hash").orderBy("rn"))).where("seen = 1").drop("seen")
    left = first.join(cached.select("hash").distinct(), "hash", "left_anti")
    return rank_by(left, key, F.col("rn"), name="pick").where(F.col("pick") <= k)


def pool_ladder(df: DataFrame, k: int, floor: int = 5, key: str = "request_id") -> DataFrame:
    """The best of the three pools that has rows, per request; the first k rows are immediate, the rest queued.

    A row counts in the best pool that may hold it: where a better one has rows, only those are asked for.
    """
    rows = _read_titles(df)
    step = F.coalesce(_own_step(), F.when(F.col("dubbed") & ~F.col("__cam"), 3), F.when((F.col("seeders") >= floor) & ~F.col("__cam") & ~F.col("__alien"), 4))
    seeded, weight = F.col("__step") == 4, placed(F.col("quality"), WEIGHT).desc()
    best = _first_step(rows, key, step, down("multi_work"), F.when(seeded, F.col("__target")).desc(), F.when(seeded, F.col("seeders")).desc(), weight, down("seeders"), F.col("lid"))
    tier = F.when(F.col("__step") <= 2, 1).otherwise(F.col("__step") - 1).cast("long")
    return _told(best.withColumns({"tier": tier, "immediate": F.col("rn") <= k}))


def limit_by_quality(ranked: DataFrame, limits: dict[str, int], key: str = "request_id") -> DataFrame:
    """At most ``limits[q]`` rows of each quality: no entry or 100 and more is unlimited, 0 is none."""
    most = F.element_at(F.create_map(*[F.lit(x) for kv in limits.items() for x in kv]), F.col("quality"))
    nth = F.row_number().over(W.partitionBy(key, "quality").orderBy("rn"))
    return ranked.withColumns({"most": most, "nth": nth}).where("most is null or most >= 100 or nth <= most").drop("most", "nth")


def limit_by_source(ranked: DataFrame, cap: int, overrides: dict[int, int], exempt: Column, key: str = "request_id") -> DataFrame:
    """At most ``cap`` rows of each source, 0 for no limit; exempt rows pass but count."""
    most = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in overrides.items() for x in kv]), F.col("indexer").cast("int")), F.lit(cap)) if overrides else F.lit(cap)
    nth = F.row_number().over(W.partitionBy(key, "indexer").orderBy("rn"))
    return ranked.withColumns({"most": most, "nth": nth}).where(F.col("indexer").isNull() | (F.col("most") == 0) | (F.col("nth") <= F.col("most")) | exempt).drop("most", "nth")


def limit_joint(ranked: DataFrame, quality_limits: dict[str, int], source_cap: int, key: str = "request_id") -> DataFrame:
    """Both quotas in one pass over each request's order: a row that one refuses does not use up the other.

    A left fold along one request's rows in order; what is carried is one count per quality and source.
    Returns the kept rows.
    """

    def step(a: list, r: tuple) -> list[tuple]:
        (q, s), (rn, quality, indexer) = a, r
        most = quality_limits.get(quality, 100)
        if (most < 100 and q.get(quality, 0) >= most) or (source_cap and s.get(indexer, 0) >= source_cap):
            return []
        q[quality], s[indexer] = q.get(quality, 0) + 1, s.get(indexer, 0) + 1
        return [(rn,)]

    kind = StructType().add("rn", ranked.schema["rn"].dataType)
    kept = fold_sorted(ranked.select(key, "rn", "quality", "indexer"), [key], ["rn"], lambda: [{}, {}], step, lambda a: [], kind)
    return ranked.join(kept, [key, "rn"])


def select_quality_pool(ranked: DataFrame, caps: dict[str, int], target: int, key: str = "request_id", reserved: int = 0, per_band: int = 0, factor: int = 1, origin_first: bool = False) -> DataFrame:
    """The rows of each request that go on, ``target`` at most, with ``turn``, the order in which they were taken.

    Rows of priority origin come first: up to ``per_band`` of each quality, then any, until ``reserved`` (with
    ``origin_first``: ``target``) are taken and as far as the quality's cap (times ``factor``) lets them. Then a round
    robin over the capped qualities takes one row of each in turn up to its cap, and rows of uncapped qualities fill up.
    Each of the four steps has its limits per quality and one on all, so each is a rank within the quality and one
    within the request, behind the rows of the steps before.

    In each step the rows of a quality and origin are taken in their order, so none behind the first ``target`` of them,
    or as many as the largest cap, goes on or changes a rank that counts: these are cut before the other windows.
    """
    most = max([target, *[n * factor for n in caps.values()]])
    ranked = ranked.withColumn("__at", F.row_number().over(W.partitionBy(key, "quality", "is_br").orderBy("rn"))).where(F.col("__at") <= most).drop("__at")
    cap = F.element_at(F.create_map(*[F.lit(x) for q, n in caps.items() for x in (q, n * factor)]), F.col("quality"))
    df = ranked.withColumn("cap", cap)
    every, band = W.partitionBy(key), W.partitionBy(key, "quality")
    so_far = lambda w: w.orderBy("rn").rowsBetween(W.unboundedPreceding, 0)
    number = lambda c, w: F.sum(c.cast("int")).over(w)
    least = F.lit(min(target, target if origin_first else reserved))
    open_ = F.col("is_br")
    df = df.withColumn("ok", open_ & (number(open_, so_far(band)) <= F.least(F.lit(per_band), F.coalesce("cap", F.lit(per_band)))))
    df = df.withColumn("one", F.col("ok") & (number(F.col("ok"), so_far(every)) <= least))
    open_ = F.col("is_br") & ~F.col("one")
    df = df.withColumn("ok", open_ & (F.col("cap").isNull() | (number(F.col("one"), band) + number(open_, so_far(band)) <= F.col("cap"))))
    df = df.withColumn("two", F.col("ok") & (number(F.col("one"), every) + number(F.col("ok"), so_far(every)) <= least))
    taken = F.col("one") | F.col("two")
    nth = number(~taken, so_far(band))
    df = df.withColumn("step", F.when(F.col("one"), 1).when(F.col("two"), 2).when(F.col("cap").isNotNull() & (number(taken, band) + nth <= F.col("cap")), 3).when(F.col("cap").isNull(), 4)).withColumn("nth", nth).where("step is not null")
    robin = F.col("step") == 3
    turn = F.row_number().over(every.orderBy("step", F.when(robin, F.col("nth")), F.when(robin, placed(F.col("quality"), BANDS)).desc(), "rn"))
    return df.withColumn("turn", turn.cast("long")).where(F.col("turn") <= target).drop("cap", "ok", "one", "two", "step", "nth")


def limit_guaranteed(ranked: DataFrame, most: int, reserve: int, per_band: int, key: str = "request_id", packs: bool = True) -> DataFrame:
    """The first ``most`` rows of each request, into which rows of priority origin are swapped for the last others.

    Guaranteed are up to ``per_band`` such rows of each quality, dubbed ones first, that are no packs; then, for each
    quality that has none, best quality first, its first pack (``packs``: the request asks for a season). They come
    first among the ``reserve`` rows (or as many as are guaranteed) that may enter; rows that stand beyond the cut do so
    in that order, while there are others before it.
    """
    every, band = W.partitionBy(key), W.partitionBy(key, "quality")
    pack = F.col("multi_work") if packs else F.lit(False)
    df = ranked.withColumns({"place": placed(F.col("quality"), BANDS), "inside": F.col("rn") <= most, "own": F.col("is_br") & ~pack, "fill": F.col("is_br") & pack})
    own = F.row_number().over(W.partitionBy(key, "quality", "own").orderBy(F.col("dubbed").desc(), "rn"))
    df = df.withColumn("sure", F.col("own") & (own <= per_band))
    bare = F.max(F.col("sure").cast("int")).over(band) == 0
    first = F.row_number().over(W.partitionBy(key, "quality", "fill").orderBy(F.col("dubbed").desc(), "rn")) == 1
    df = df.withColumn("cover", F.col("fill") & bare & first & (per_band > 0))
    # own rows that are guaranteed, then packs by quality, then the other rows of priority origin
    group = F.when(F.col("sure"), 1).when(F.col("cover"), 2).when(F.col("is_br"), 3).otherwise(4)
    order = [group, F.when(F.col("cover"), -F.col("place")), F.col("dubbed").desc(), F.col("rn")]
    df = df.withColumn("queue", F.row_number().over(every.orderBy(*order)))
    may = F.greatest(F.lit(reserve), F.sum((F.col("sure") | F.col("cover")).cast("int")).over(every))
    df = df.withColumn("waits", F.col("is_br") & ~F.col("inside") & (F.col("queue") <= may)).withColumn("other", ~F.col("is_br") & F.col("inside"))
    df = df.withColumn("swaps", F.least(F.sum(F.col("waits").cast("int")).over(every), F.sum(F.col("other").cast("int")).over(every)))
    enters = F.col("waits") & (F.row_number().over(W.partitionBy(key, "waits").orderBy("queue")) <= F.col("swaps"))
    leaves = F.col("other") & (F.row_number().over(W.partitionBy(key, "other").orderBy(F.col("rn").desc())) <= F.col("swaps"))
    kept = df.withColumns({"enters": enters, "leaves": leaves}).where("enters or (inside and not leaves)")
    return kept.drop("place", "inside", "own", "fill", "sure", "cover", "queue", "waits", "other", "swaps", "enters", "leaves")


def limit_reserving(ranked: DataFrame, most: int, reserve: int, key: str = "request_id") -> DataFrame:
    """The first ``most`` rows of each request, of which at least ``reserve`` are dubbed priority-origin rows if there are so many:
    those beyond the cut replace the last other rows before it.
    """
    w = W.partitionBy(key)
    own = (F.col("is_br") & F.col("dubbed")).cast("int")
    df = ranked.withColumn("own", own).withColumn("inside", (F.col("rn") <= most).cast("int"))
    df = df.withColumn("have", F.sum(F.col("own") * F.col("inside")).over(w))
    df = df.withColumn("out_nth", F.row_number().over(W.partitionBy(key, "own", "inside").orderBy("rn")))
    df = df.withColumn("back_nth", F.row_number().over(W.partitionBy(key, "own", "inside").orderBy(F.col("rn").desc())))
    spare = F.sum(F.col("own") * (1 - F.col("inside"))).over(w)
    others = F.sum((1 - F.col("own")) * F.col("inside")).over(w)
    df = df.withColumn("swap", F.greatest(F.lit(0), F.least(F.lit(reserve) - F.col("have"), spare, others)))
    enter = (F.col("own") == 1) & (F.col("inside") == 0) & (F.col("out_nth") <= F.col("swap"))
    leave = (F.col("own") == 0) & (F.col("inside") == 1) & (F.col("back_nth") <= F.col("swap"))
    kept = df.where(((F.col("inside") == 1) & ~leave) | enter)
    return kept.drop("own", "inside", "have", "out_nth", "back_nth", "swap")


def first_within(df: DataFrame, key: list[str], order: list[Column], most: int, name: str = "rn") -> DataFrame:
    """The first ``most`` rows of each key."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*key).orderBy(*order)).cast("long")).where(F.col(name) <= most)
