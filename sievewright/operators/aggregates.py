"""Aggregations over listings, evidence, accounts and metrics. Each is one hash aggregation with partial sums, unless it says otherwise."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as T
from .ranking import preference


def dedupe_by_hash(df: DataFrame, preferred: tuple = ()) -> DataFrame:
    """One row per hash: the winner by seeders, dubbed, preferred source and arrival; quality and size come from the best row that knows them; flags are united."""
    order = F.struct(-F.col("seeders"), (~F.col("dubbed")).cast("int"), preference(F.col("indexer"), preferred), F.col("lid"))
    return df.groupBy("hash").agg(
        F.min_by("lid", order).alias("lid"),
        F.max("seeders").alias("seeders"),
        F.coalesce(F.min_by(F.when(F.col("quality") != "unknown", F.col("quality")), F.when(F.col("quality") != "unknown", order)), F.lit("unknown")).alias("quality"),
        F.coalesce(F.min_by("size", F.when(F.col("size") > 0, order)), F.lit(0)).alias("size"),
        F.bool_or("multi_work").alias("multi_work"),
        F.bool_or("lied").alias("lied"),
        F.count("*").alias("n"),
    )


def catalog_report(df: DataFrame) -> DataFrame:
    """Counts and bytes over all, by bucket and by cached state (true, false, unknown), in one pass of grouping sets."""
    return df.groupingSets([[], [F.col("bucket")], [F.col("cached")]], F.col("bucket"), F.col("cached")).agg(
        F.when(F.grouping("bucket") == 0, "bucket").when(F.grouping("cached") == 0, "cached").otherwise("all").alias("level"),
        F.count("*").alias("n"),
        F.sum("size").alias("bytes"),
        F.count_if("ready").alias("ready"),
        F.count_if("known").alias("known"),
    )


def evidence_status(df: DataFrame, now: str) -> DataFrame:
    """Live evidence and its mean time left, by scope and kind with subtotals."""
    left = F.col("ttl_s") - (F.lit(now).cast("timestamp").cast("double") - F.col("seen_at").cast("double"))
    live = df.withColumn("left_s", left).where("left_s > 0")
    return live.rollup("scope", "kind").agg(F.count("*").alias("live"), F.ceil(F.avg("left_s")).alias("mean_left"))


def coverage_sample(cohort: DataFrame, index: DataFrame) -> DataFrame:
    """Per kind and in all: works with a hit, with misses only, and unknown. ``found`` is true, false or null; unknown never counts as a miss."""
    per = index.groupBy("work").agg(F.bool_or(F.coalesce("found", F.lit(False))).alias("hit"), F.bool_and(~F.coalesce("found", F.lit(True))).alias("miss"))
    state = F.when(F.col("hit"), "hit").when(F.col("miss"), "miss").otherwise("unknown")
    works = cohort.join(per, "work", "left").withColumn("state", state)
    decided = F.count_if(F.col("state") != "unknown")
    return works.rollup("kind").agg(
        F.count("*").alias("works"), F.count_if(F.col("state") == "hit").alias("hits"), F.count_if(F.col("state") == "miss").alias("misses"), F.count_if(F.col("state") == "unknown").alias("unknown"),
        F.round(F.when(decided == 0, F.lit(0.0)).otherwise(F.count_if(F.col("state") == "hit") / F.nullif(decided, F.lit(0))), 6).alias("hit_ratio"),
    )


def account_occupancy(df: DataFrame, full: int, busy: int) -> DataFrame:
    active = F.count_if(F.col("status") == "Downloading")
    return df.groupBy("account").agg(
        F.count("*").alias("total"), F.count_if("ready").alias("ready"), active.alias("active"), F.count_if(F.col("status") == "Error").alias("error"), F.min("uploaded_at").alias("oldest"), (F.count("*") >= full).alias("is_full"), (active >= busy).alias("is_busy")
    )


def timer_stats(df: DataFrame, last: int) -> DataFrame:
    """Count, mean and maximum over all samples of a timer; percentiles by lower index over the last ``last``, which is all that is collected."""
    life = df.groupBy("name").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("top"))
    recent = df.withColumn("rn", F.row_number().over(W.partitionBy("name").orderBy(F.col("at").desc()))).where(F.col("rn") <= last)
    kept = recent.groupBy("name").agg(F.array_sort(F.collect_list("value")).alias("v"))
    at = lambda f: F.round(F.element_at("v", F.least(F.size("v"), F.floor(F.lit(f) * F.size("v")).cast("int") + 1)), 3)
    return life.join(kept.select("name", at(0.5).alias("p50"), at(0.95).alias("p95")), "name")


def pool_coverage(df: DataFrame, floor: int, key: str = "request_id") -> DataFrame:
    """What the best pool of a request holds: dubbed rows of priority origin (or, without any, such that do not say they are subtitled), any dubbed row, a healthy swarm without a foreign mark.

    Recordings from a cinema count for nothing. A request for an episode (``ask_season``, ``ask_episode``; null: for a
    whole work) is covered only if some title names the episode; a pack of its season does not decide.
    """
    title, parsed = F.col("title"), F.col("parsed")
    df = df.withColumn("parsed", F.when(F.col("ask_episode").isNotNull(), T.season_episode(title)))
    names = F.array_contains(parsed["episodes"], F.col("ask_episode").cast("int")) & ((F.size(parsed["seasons"]) == 0) | F.array_contains(parsed["seasons"], F.col("ask_season").cast("int")))
    shown = T.source_of(title) != "CAM"
    own = F.bool_or(F.col("is_br") & shown & (F.col("dubbed") | (T.audio_of(title) != "Legendado")))
    healthy = F.bool_or(shown & (F.col("seeders") >= floor) & ~T.foreign_audio(title))
    best = F.when(own, "priority").when(F.bool_or(F.col("dubbed") & shown), "dubbed").when(healthy, "healthy").otherwise("none")
    per = df.groupBy(key).agg(best.alias("best"), F.bool_or(F.coalesce(names, F.lit(False))).alias("names_episode"), F.max("ask_episode").isNotNull().alias("asks"))
    return per.select(key, F.when(F.col("asks") & ~F.col("names_episode"), "none").otherwise(F.col("best")).alias("cover"), "names_episode")


def file_evidence(files: DataFrame) -> DataFrame:
    """Per hash: the first audio that a file names, the quality of the largest file, and whether any is a scene release; only if something is known."""
    named = F.col("audio") != ""
    per = files.groupBy("hash").agg(
        F.min_by("audio", F.when(named, F.struct("pos", "tie", "audio"))).alias("audio"), F.max_by("quality", F.struct("size", "tie", "quality")).alias("quality"), F.bool_or("scene").alias("scene")
    )
    return per.where("audio is not null or quality <> '' or scene")


def batch_completeness(df: DataFrame) -> DataFrame:
    """Results of the batches that came back, whether all did, and the error if all failed alike."""
    failed = F.count_if("failed")
    return df.groupBy("request").agg(
        F.count("*").alias("batches"), failed.alias("failed"), (failed == 0).alias("is_complete"), F.when((failed == F.count("*")) & (F.min("error") == F.max("error")), F.min("error")).alias("error_class"), F.count_distinct(F.when(~F.col("failed"), F.col("result"))).alias("n_results")
    )


def delivery_funnel(events: DataFrame) -> DataFrame:
    """Found, cached, hidden and visible rows of each pass of a request; late is what a pass shows beyond the most shown before."""
    is_ = lambda *k: F.count_if(F.col("event_type").isin(*k))
    per = events.groupBy(F.col("user_id").alias("request"), F.date_trunc("day", "ts").alias("pass")).agg(F.count("*").alias("found"), F.count_if(F.col("event_type") != "error").alias("cached"), is_("signup").alias("hidden"), is_("view", "click").alias("visible"))
    before = F.max("visible").over(W.partitionBy("request").orderBy("pass").rowsBetween(W.unboundedPreceding, -1))
    return per.withColumn("late", F.greatest(F.lit(0), F.col("visible") - F.coalesce(before, F.lit(0))).cast("long"))


def stage_envelopes(events: DataFrame) -> DataFrame:
    """Milliseconds from the first start to the last end of a group, cut at the window's end, summed over invocations."""
    day = F.date_trunc("day", "ts")
    ms = F.floor(F.col("value") * 1000).cast("long")
    start = F.unix_millis("ts")
    end = F.least(start + ms, F.unix_millis(day) + 20 * 3600 * 1000)
    per = events.groupBy(F.col("user_id").alias("request"), (F.col("event_type") == "purchase").alias("priority"), day.alias("invocation")).agg((F.max(end) - F.min(start)).alias("ms"))
    return per.groupBy("request", "priority").agg(F.sum(F.greatest("ms", F.lit(0))).cast("long").alias("ms"))


def explain_empty(rows: DataFrame, ev: DataFrame) -> DataFrame:
    """Why a request shows nothing."""
    state = ev.groupBy("hash").agg(F.bool_or(F.col("kind") == "bad").alias("bad"), F.bool_or(F.col("kind") == "hit").alias("hit"))
    r = rows.join(state, "hash", "left").groupBy("request_id").agg(
        F.count("*").alias("n"), F.count_if("lied").alias("downloading"), F.count_if(F.coalesce("bad", F.lit(False))).alias("bad"), F.count_if(F.coalesce("hit", F.lit(False))).alias("hits"), F.bool_or("is_series").alias("series")
    )
    c = F.col
    why = F.when(c("hits") > 0, "shown").when(c("downloading") > 60, "downloading").when(c("bad") == c("n"), "all bad").when((c("hits") == 0) & (c("bad") > 0), "outside cache").when(c("series"), "searching").otherwise("none")
    return r.select("request_id", why.alias("reason"))


def foreign_verdict(parts: DataFrame) -> DataFrame:
    """Per hash whether its name and its files prove it foreign: any sign of the target language absolves it, only a mark of a foreign one condemns it, else it is unknown.

    ``parts`` has ``hash``, ``text`` (a name or the path of a file; may be null) and, where they are known besides, ``sign`` and ``proof``.
    """
    text = F.coalesce("text", F.lit(""))
    given = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in parts.columns else F.lit(False)
    sign, proof = given("sign") | T.looks_target(text) | T.target_signs(text), given("proof") | T.foreign_audio(text)
    per = parts.groupBy("hash").agg(F.bool_or(sign).alias("sign"), F.bool_or(proof).alias("proof"))
    return per.select("hash", F.when(F.col("sign"), "absolved").when(F.col("proof"), "foreign").otherwise("unknown").alias("verdict"))
