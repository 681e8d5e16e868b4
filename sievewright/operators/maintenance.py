"""Merges, slowly changing tables and plans over index, catalogue and account snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window as W

from ..functions.folds import fold_sorted
from ..functions.text import let, season_episode, tokens
from ..streaming.state import dedupe_within_fold


def routed(rows: DataFrame) -> DataFrame:
    """Rows found for a request under the key that their title declares: its only episode, its only season where it declares none or several episodes, the whole work for a complete series or several seasons. A title that declares nothing stays with the request, and so do all rows of a request for a whole work (``season`` null)."""
    parsed = F.when(F.col("season").isNotNull(), season_episode(F.col("title")))
    df = rows.withColumn("declared", parsed)
    seasons, episodes = F.col("declared.seasons"), F.col("declared.episodes")
    stays = F.col("declared").isNull() | (~F.col("declared.complete") & (F.size(seasons) == 0))
    whole = F.col("declared.complete") | (F.size(seasons) > 1)
    one = F.when(F.size(episodes) == 1, F.get(episodes, F.lit(0)).cast("long"))
    to = F.when(stays, F.struct("season", "episode")).when(whole, F.struct(F.lit(None).cast("long").alias("season"), F.lit(None).cast("long").alias("episode"))).otherwise(F.struct(F.get(seasons, F.lit(0)).cast("long").alias("season"), one.alias("episode")))
    return df.withColumn("to", to).withColumns({"season": F.col("to.season"), "episode": F.col("to.episode")}).drop("to", "declared")


def index_record(old: DataFrame, new: DataFrame, most: int = 60) -> DataFrame:
    """Merges a batch into the index: rows go to the key their title declares (season and episode may be null), newest wins per hash, flags are united, the newest ``most`` stay per key."""
    keys = ["work_id", "season", "episode"]
    kept = [*keys, "hash", "lid", "title", "seeders", "seen_at", "is_br", "dubbed", "lied"]
    both = old.select(*kept).unionByName(routed(new.select(*kept)))
    order = F.struct("seen_at", "lid")
    one = both.groupBy(*keys, "hash").agg(
        *[F.max_by(c, order).alias(c) for c in ("lid", "title", "seeders")], F.max("seen_at").alias("seen_at"), *[F.bool_or(c).alias(c) for c in ("is_br", "dubbed", "lied")]
    )
    return one.withColumn("rn", F.row_number().over(W.partitionBy(*keys).orderBy(F.col("seen_at").desc(), "hash"))).where(F.col("rn") <= most).drop("rn")


def mark(index: DataFrame, flagged: DataFrame, column: str) -> DataFrame:
    """Sets a sticky flag on rows whose hash is flagged."""
    f = flagged.select("hash").distinct().withColumn("__f", F.lit(True))
    return index.join(f, "hash", "left").withColumn(column, F.col(column) | F.coalesce("__f", F.lit(False))).drop("__f")


def snapshot_works(index: DataFrame) -> DataFrame:
    """All keys of a work in one list, newest per hash."""
    order = F.struct("seen_at", "lid")
    return index.groupBy("work_id", "hash").agg(F.max_by("lid", order).alias("lid"), F.max("seen_at").alias("seen_at"))


def catalog_scan(catalog: DataFrame, snap: DataFrame, now: str) -> DataFrame:
    """One full outer join of catalogue and account: new rows enter, seen rows are updated, missing ones get a tombstone.

    First sight and audits never go back; the time of a verdict moves only when the verdict does; rows that come back
    lose their tombstone.
    """
    t = F.lit(now).cast("timestamp")
    c, s = catalog.alias("c"), snap.alias("s")
    j = c.join(s, F.col("c.service_id") == F.col("s.service_id"), "full_outer")
    seen = F.col("s.service_id").isNotNull()
    known = F.col("c.service_id").isNotNull()
    changed = ~F.col("c.cached").eqNullSafe(F.col("s.cached"))
    return j.select(
        F.coalesce("c.service_id", "s.service_id").alias("service_id"),
        F.coalesce("s.account", "c.account").alias("account"),
        F.coalesce("s.status", "c.status").alias("status"),
        F.when(seen, F.col("s.cached")).otherwise(F.col("c.cached")).alias("cached"),
        F.when(~seen, F.col("c.cached_at")).when(~known | changed, t).otherwise(F.col("c.cached_at")).alias("cached_at"),
        F.coalesce(F.least("c.first_seen", "s.uploaded_at"), "s.uploaded_at", "c.first_seen").alias("first_seen"),
        F.when(seen, t).otherwise(F.col("c.last_seen")).alias("last_seen"),
        F.when(~seen, F.coalesce("c.deleted_at", t)).alias("deleted_at"),
    )


def plan_dedup_exact(df: DataFrame) -> DataFrame:
    """Rows of a hash that are to go: all but the best by protection, readiness and age, unless protected or active."""
    w = W.partitionBy("account", "hash").orderBy(F.col("protected").desc(), F.col("ready").desc(), "uploaded_at", "service_id")
    ranked = df.withColumns({"rn": F.row_number().over(w), "keep_id": F.first("service_id").over(w)})
    return ranked.where("rn > 1 and not protected and status <> 'Downloading'").select("account", "hash", "service_id", "keep_id")


def plan_dedup_near(df: DataFrame, share: float = 0.005) -> DataFrame:
    """Rows of one name whose sizes lie within ``share`` of the smallest of their cluster, best kept.

    Clusters do not chain: sorted sizes are folded left, a size beyond the limit of the current base opens a new one.
    The fold runs over the distinct sizes of one name in an account.
    """
    key = ["account", "name"]
    sizes = df.where("size > 0").select(*key, F.col("size").cast("long")).distinct()

    def step(a: list, r: tuple) -> list[tuple]:
        if a[0] is None or not r[0] <= a[0] * (1 + share):
            a[0] = r[0]
        return [(r[0], a[0])]

    bases = fold_sorted(sizes, key, ["size"], lambda: [None], step, lambda a: [], StructType().add("size", "long").add("base", "long"))
    w = W.partitionBy(*key, "base").orderBy(F.col("protected").desc(), F.col("ready").desc(), "uploaded_at", "service_id")
    ranked = df.join(bases, [*key, "size"]).withColumns({"rn": F.row_number().over(w), "keep_id": F.first("service_id").over(w)})
    return ranked.where("rn > 1 and not protected and status <> 'Downloading'").select(*key, "service_id", "keep_id", "base")


def flatten_kills(plans: list[tuple[str, DataFrame]], rows: DataFrame, most: int) -> DataFrame:
    """One row per id with the last plan's reason, the first ``most`` ids; ``survives`` says that a row of the same hash stays under an id that is not among them. ``rows`` is the catalogue."""
    every = None
    for k, (reason, p) in enumerate(plans):
        p = p.select("service_id", "hash", F.lit(reason).alias("reason"), F.lit(k).alias("k"))
        every = p if every is None else every.unionByName(p)
    kills = every.groupBy("service_id", "hash").agg(F.max_by("reason", "k").alias("reason")).orderBy("service_id").limit(most)
    stays = rows.select("service_id", "hash").join(kills.select("service_id"), "service_id", "left_anti").select("hash").distinct().withColumn("survives", F.lit(True))
    return kills.join(stays, "hash", "left").select("service_id", "hash", "reason", F.coalesce("survives", F.lit(False)).alias("survives"))


def plan_foreign_cleanup(df: DataFrame, most: int, before: str) -> DataFrame:
    """Condemned rows in order of age with the reason that spares them; the first ``most`` eligible rows of an account are chosen and nothing after the cut is counted."""
    spared = F.when(F.col("known"), "known").when(F.col("protected"), "protected").when(F.col("status") == "Downloading", "active").when(F.col("uploaded_at") > F.lit(before).cast("timestamp"), "young").when(F.col("bucket") != "none", "not condemned")
    order = W.partitionBy("account").orderBy("uploaded_at", "service_id")
    ranked = df.withColumn("spared", spared).withColumn("eligible", F.sum(F.col("spared").isNull().cast("long")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    inside = (F.col("eligible") < most) | (F.col("spared").isNull() & (F.col("eligible") == most)) if most else F.lit(True)
    return ranked.where(inside).select("account", "service_id", F.coalesce("spared", F.lit("chosen")).alias("verdict"))


def plan_manual(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Ordered distinct ids with what happens to each: missing, active or chosen."""
    asked = ids.groupBy("service_id").agg(F.min("pos").alias("pos"))
    j = asked.join(df.select("service_id", "status"), "service_id", "left")
    return j.select("pos", "service_id", F.when(F.col("status").isNull(), "missing").when(F.col("status") == "Downloading", "active").otherwise("chosen").alias("verdict"))


def oldest(df: DataFrame, most: int, key: str = "account") -> DataFrame:
    return df.withColumn("rn", F.row_number().over(W.partitionBy(key).orderBy("uploaded_at", "service_id")).cast("long")).where(F.col("rn") <= most)


def plan_evict(df: DataFrame, consulted: DataFrame, preexisting: DataFrame, cap: int, floor: int) -> DataFrame:
    """Per account as many of its oldest rows as searches have put there: the least of the hashes consulted, ``cap``, and the occupancy above ``floor``.

    Only rows proved foreign go (``foreign`` is true; null is unknown and stays), and none that was consulted, was there
    before us, is protected, still loads, or has no date. ``consulted`` and ``preexisting`` have ``account`` and ``hash``.
    """
    asked = consulted.select("account", "hash").distinct()
    rows = df.groupBy("account").agg(F.count("*").alias("occupancy")).join(asked.groupBy("account").agg(F.count("*").alias("asked")), "account")
    target = rows.select("account", F.greatest(F.lit(0), F.least(F.col("asked"), F.lit(cap), F.col("occupancy") - floor)).alias("target"))
    ok = df.where("foreign and not protected and status <> 'Downloading' and uploaded_at is not null and hash is not null and service_id is not null")
    ok = ok.join(asked.unionByName(preexisting.select("account", "hash")).distinct(), ["account", "hash"], "left_anti")
    ranked = ok.withColumn("rn", F.row_number().over(W.partitionBy("account").orderBy("uploaded_at", "service_id")).cast("long"))
    return ranked.join(target, "account").where("rn <= target").select("account", "service_id", "rn")


def pick_file(files: DataFrame) -> DataFrame:
    """One file of each hash: no samples, the asked episode by name before path, extras last, the largest; an error kind where there is none or a tie of works."""
    name, path = F.lower("name"), F.lower("path")
    junk = name.rlike(r"(^|[^a-z])(sample|trailer|rarbg)([^a-z]|$)")
    code = F.format_string("s%02de%02d", F.col("season"), F.col("episode"))
    tier = F.when(F.contains(name, code), 0).when(F.contains(path, code), 1).otherwise(2)
    extra = path.rlike(r"(^|/)(extras?|bonus|featurettes?)/").cast("int")
    ok = files.withColumns({"junk": junk, "tier": tier, "extra": extra})
    w = W.partitionBy("hash").orderBy("junk", "tier", "extra", F.col("size").desc(), "path")
    per = ok.withColumns({"rn": F.row_number().over(w), "n_named": F.count(F.when((F.col("tier") == 0) & ~F.col("junk"), 1)).over(W.partitionBy("hash"))}).where("rn = 1")
    return per.select("hash", F.when(~F.col("junk"), F.col("path")).alias("path"), F.when(F.col("junk"), "no video").when((F.col("tier") == 2) & (F.col("n_named") == 0), "episode not named").alias("error"))


# What tells a video, a sample and an extra by its path; the least share of a work's name that a file must bear.
VIDEO, SAMPLE = r"(?i)\.(mkv|mp4|avi|mov|m4v|ts|webm)$", "(?i)(^|[^a-z])sample([^a-z]|$)"
EXTRA = (
    "(?i)(^|[^a-z])(extras?|b[oô]nus|bonus|featurettes?|interviews?|entrevistas?|behind[ ._-]?the[ ._-]?scenes|trailers?|deleted[ ._-]?scenes?|cenas[ ._-]?deletadas|bloopers?|gags?|making[ ._-]?of)([^a-z]|$)"
)
WORK_COVERAGE = 0.7
_FILE_YEAR = "(?:^|[^0-9])((?:19|20)[0-9]{2})(?:$|[^0-9])"


def work_coverage(path: Column, name: Column) -> Column:
    """The share of a name's tokens (of more than two letters, if there are any) that the file's own name holds, or, if that holds none, its whole path."""
    long = lambda t: F.filter(t, lambda x: F.length(x) > 2)
    base = F.element_at(F.split(path, r"[/\\\\]"), -1)
    held = lambda wanted, c: F.size(F.filter(wanted, lambda x: F.array_contains(tokens(c), x)))

    def share(wanted: Column) -> Column:
        return let(held(wanted, base), lambda n: F.when(n > 0, n).otherwise(held(wanted, path)) / F.nullif(F.size(wanted), F.lit(0)))

    return F.coalesce(let(tokens(name), lambda t: let(long(t), lambda x: share(F.when(F.size(x) > 0, x).otherwise(t)))), F.lit(0.0))


def pick_work_file(files: DataFrame, asked: DataFrame) -> DataFrame:
    """The file of each hash that is the work asked for, or why there is none.

    ``files`` has ``hash``, ``path``, ``size``; ``asked`` has, per hash, ``names``, ``year`` (may be null) and ``pack`` (the
    title says it holds several works). Videos that are no samples count, extras only if there is nothing else. A lone
    one is it. Where neither the title nor two years among the files' names speak of several works, the largest is.
    Otherwise it is the only file that bears enough of a name; of several the only one, or the largest, that bears the
    year; else which one is meant is not clear. Returns ``hash``, ``path`` and ``error`` (``no video``, ``work not clear``).
    """
    path = F.col("path")
    base = F.element_at(F.split(path, r"[/\\\\]"), -1)
    ok = path.rlike(VIDEO) & ~path.rlike(SAMPLE)
    df = files.select("hash", "path", "size").join(asked, "hash").withColumns({"ok": ok, "main": ok & ~path.rlike(EXTRA)})
    df = df.withColumn("pool", F.col("ok") & (F.col("main") | (F.max(F.col("main").cast("int")).over(W.partitionBy("hash")) == 0)))
    cover = F.array_max(F.transform("names", lambda n: work_coverage(path, n)))
    df = df.withColumns({"bears": F.col("pool") & (F.coalesce(cover, F.lit(0.0)) >= WORK_COVERAGE), "told": F.nullif(F.regexp_extract(base, _FILE_YEAR, 1), F.lit(""))})
    df = df.withColumn("dated", F.col("bears") & F.coalesce(base.rlike(r"(?<!\d)(?:19|20)\d{2}(?!\d)") & F.array_contains(F.regexp_extract_all(base, F.lit(r"(?<![0-9])([0-9]{4})(?![0-9])"), F.lit(1)), F.col("year").cast("string")), F.lit(False)))
    largest = lambda c: F.min_by("path", F.when(F.col(c), F.struct((-F.col("size")).alias("s"), "path")))
    per = df.groupBy("hash").agg(
        F.first("pack").alias("pack"), F.count_if("pool").alias("n"), F.count_distinct(F.when(F.col("main"), F.col("told"))).alias("years"), F.count_if("main").alias("mains"),
        F.count_if("bears").alias("bearing"), F.count_if("dated").alias("dating"), largest("pool").alias("any"), largest("bears").alias("one"), largest("dated").alias("right"),
    )
    several = F.col("pack") | ((F.col("mains") > 1) & (F.col("years") >= 2))
    picked = F.when((F.col("n") == 1) | ~several, F.col("any")).when(F.col("bearing") == 1, F.col("one")).when(F.col("dating") > 0, F.col("right"))
    return per.select("hash", picked.alias("path"), F.when(F.col("n") == 0, "no video").when(picked.isNull(), "work not clear").alias("error"))


def protect_merge(holds: DataFrame, seen: DataFrame, now: str, ttl_s: int) -> DataFrame:
    """Holds with first acceptance kept, readiness set once, and expiry renewed once half the time is gone."""
    t = F.lit(now).cast("timestamp")
    j = holds.alias("h").join(seen.alias("s"), "service_id", "full_outer")
    left = F.col("h.expires_at").cast("double") - t.cast("double")
    renew = F.timestamp_seconds(F.lit(ttl_s) + t.cast("double"))
    return j.select("service_id", F.coalesce("h.accepted_at", t).alias("accepted_at"), F.coalesce("h.ready_at", F.when(F.col("s.ready"), t)).alias("ready_at"), F.when(F.col("s.ready").isNotNull() & (left.isNull() | (left < ttl_s / 2)), renew).otherwise(F.col("h.expires_at")).alias("expires_at"))


def reconcile_holds(holds: DataFrame, unready: DataFrame, present: DataFrame, volatile: DataFrame, now: str, ttl_s: int, grace_s: int) -> DataFrame:
    """What becomes of each durable hold: ``regressed`` (it was ready and was seen not to be), ``expired`` (seen not ready, and accepted for longer than ``ttl_s``), ``pruned`` (no longer there, not held by a download in flight, and older than ``grace_s`` or without a date), else ``keep``.

    ``holds`` has ``service_id``, ``accepted_at``, ``ready_at``; the others ``service_id``. The first reason that fits is told.
    """
    t = F.lit(now).cast("timestamp").cast("double")
    flag = lambda df, name: df.select("service_id").distinct().withColumn(name, F.lit(True))
    j = holds.select("service_id", "accepted_at", "ready_at")
    for df, name in ((unready, "unready"), (present, "present"), (volatile, "volatile")):
        j = j.join(flag(df, name), "service_id", "left")
    age, yes = t - F.col("accepted_at").cast("double"), lambda c: F.coalesce(F.col(c), F.lit(False))
    gone = ~yes("present") & ~yes("volatile") & F.coalesce(age > grace_s, F.lit(True))
    fate = F.when(yes("unready") & F.col("ready_at").isNotNull(), "regressed").when(yes("unready") & F.coalesce(age >= ttl_s, F.lit(True)), "expired").when(gone, "pruned").otherwise("keep")
    return j.select("service_id", fate.alias("fate"))


def invalidate_lists(lists: DataFrame, items: DataFrame, packs: DataFrame, wrong: DataFrame, key: list[str], on: str = "hash") -> DataFrame:
    """Stored lists that stay, each once: those of a season whose pack has become ready go (``packs``: ``work_id``, ``season``), and those that hold a row proved wrong (``wrong``: ``on``; ``items``: the lists' ``key`` and ``on``).

    Lists and their wrong items are gathered by key in one step.
    """
    spoilt = items.join(wrong.select(on).distinct(), on, "left_semi").select(*key, F.lit(False).alias("listed"))
    told = lists.select(*key, F.lit(True).alias("listed")).unionByName(spoilt).groupBy(*key).agg(F.bool_and("listed").alias("listed"))
    return told.where("listed").drop("listed").join(packs.select("work_id", "season").distinct(), ["work_id", "season"], "left_anti")


def promote_lists(items: DataFrame, ready: DataFrame) -> DataFrame:
    """Relabels the elements of stored lists whose hash is ready. Lists are rows, one an element, with all their columns; none is put together in one row."""
    return items.join(ready.select("hash").distinct().withColumn("ready", F.lit(True)), "hash", "left").withColumn("ready", F.coalesce("ready", F.lit(False)))


def next_episode_requests(results: DataFrame, known: DataFrame, hours: int = 12) -> DataFrame:
    """Requests for the episode after each one that had results, once per ``hours`` and episode, without those that are known or in flight.

    ``results`` has ``work_id``, ``season``, ``episode``, ``ts``, ``event_id``; ``known`` has the first three.
    """
    key = ["work_id", "season", "episode"]
    asked = results.withColumn("episode", F.col("episode") + 1).select(*key, "ts", "event_id").join(known.select(*key).distinct(), key, "left_anti")
    asked = asked.withColumn("of", F.concat_ws("|", *key))
    kept = dedupe_within_fold(asked, "of", hours * 3600).select("of", "event_id")
    return asked.join(kept, ["of", "event_id"], "left_semi").drop("of").distinct()
