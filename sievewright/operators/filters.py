"""Row-wise filters and projections; all push down or fuse into the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import identity as I
from ..functions import text as T


def normalize_listings(df: DataFrame, least: int = 1024) -> DataFrame:
    """Entities decoded once, hash in canonical form, negative seeders and impossible sizes 0."""
    size = F.when((F.col("size") > least) & (F.col("size") < 500 * 1024**3), F.col("size")).otherwise(0).cast("long")
    return df.withColumns({"title": T.decode_entities(F.col("title")), "hash": T.info_hash(F.col("hash")), "seeders": F.greatest("seeders", F.lit(0)), "size": size})


def classify(df: DataFrame) -> DataFrame:
    """Quality, source, edition, audio, origin, dubbing, collection and episode fit of every listing.

    ``df`` has ``title``, ``season``, ``episode`` and, where they are known, ``is_br`` and ``origin_only`` (of priority
    origin, by its source or by nothing but its source), ``proven_quality``, ``proven_audio``, ``proven_name`` (what the
    file itself shows) and ``lied``. What a file shows outweighs its title; an empty proof of audio takes back what the
    title claims, but for subtitles. Rows of priority origin are dubbed if their audio says so, unless only their source
    speaks for the origin; others only by an explicit mark.
    """
    given = lambda c, kind: F.col(c) if c in df.columns else F.lit(None).cast(kind)
    t, proof, c = F.col("title"), given("proven_audio", "string"), lambda n: F.col(f"__{n}")
    told = T.distinct_texts(df).withColumns({"__up": T.shouted(t), "__words": T.padded(t), "__parsed": T.season_episode(t)})
    # each step names what the next ones look at, so that every pattern runs once a title
    told = told.withColumns({"__sub": T._has(c("up"), T.SUBTITLE_WORDS), "__signs": T.signs_in(t, c("up"), c("words"))})
    told = told.withColumn("__explicit", T.explicit_in(c("up"), c("sub")))
    told = told.withColumn("__said", T.audio_in(c("up"), c("sub"), c("explicit")))
    told = told.withColumn("__target", T.target_in(c("said"), c("explicit"), c("signs")))
    facts = {
        "quality": T.quality(t), "source": T.named_by(c("words"), T.SOURCES), "edition": T.named_by(c("words"), T.EDITIONS), "bucket": T.bucket_in(c("target"), c("said"), c("signs")), "foreign": ~c("explicit") & T._has(c("up"), T.FOREIGN_WORDS),
        "multi_work": I.is_multi_work(F.filter(F.split(c("words"), " "), lambda w: w != "")), "parsed": c("parsed"), "explicit": c("explicit"), "said": c("said"), "target": c("target"),
    }
    out = T.joined_facts(df, told, {f"__{n}": f for n, f in facts.items()})
    out = out.withColumn("__audio", F.when(proof.isNull(), c("said")).when(proof != "", proof).when(c("said") == "Legendado", c("said")).otherwise(""))
    out = out.withColumn("__origin", F.coalesce(given("is_br", "boolean"), F.lit(False)) | c("target"))
    proven = F.when(F.col("proven_name").isNotNull(), T.explicit_target_audio(F.col("proven_name"))).otherwise(c("explicit")) if "proven_name" in df.columns else c("explicit")
    dubbed = F.when(c("origin") & ~F.coalesce(given("origin_only", "boolean"), F.lit(False)), c("audio").isin("Dublado", "Dual", "Nacional")).otherwise(proven)
    out = out.withColumns({
        "quality": F.coalesce(given("proven_quality", "string"), c("quality")), **{n: c(n) for n in ("source", "edition", "audio", "bucket", "foreign", "multi_work")}, "is_br": c("origin"), "dubbed": dubbed, "lied": F.coalesce(given("lied", "boolean"), F.lit(False)),
        "fits": T.fits_episode(c("parsed"), F.col("season"), F.col("episode")), "pack": F.coalesce(T.is_pack(c("parsed"), F.col("season")), F.lit(False)),
    })
    return out.drop(*[n for n in out.columns if n.startswith("__")])


def filter_quality(df: DataFrame, allow: list[str], unknown_limit: int) -> DataFrame:
    """Qualities of a list (4k and uhd mean 2160p); priority-origin rows of unknown quality pass unless their limit is 0."""
    wanted = ["2160p" if a.lower() in ("4k", "uhd") else a for a in allow]
    ok = F.col("quality").isin(*wanted)
    return df.where(ok | (F.col("is_br") & (F.col("quality") == "unknown"))) if unknown_limit else df.where(ok)


def any_term(df: DataFrame, terms: list[str]) -> DataFrame:
    """Rows whose title contains any of the terms, whatever the case; no terms pass all."""
    if not terms:
        return df
    ok = F.lit(False)
    for t in terms:
        ok = ok | F.contains(F.upper("title"), F.lit(t.upper()))
    return df.where(ok)


def filter_candidates(df: DataFrame, seeders: int, most: int, cam: bool = False) -> DataFrame:
    """Rows with enough seeders that are not filmed in a cinema (unless ``cam``) and not too large; an unknown size (0) passes."""
    ok = (F.col("seeders") >= seeders) & ((F.col("size") == 0) | (F.col("size") <= most))
    return df.where(ok if cam else ok & (T.source_of(F.col("title")) != "CAM"))


def filter_category(df: DataFrame, bucket: int) -> DataFrame:
    """Any category in [bucket, bucket + 1000); rows without categories pass."""
    return df.where((F.size("categories") == 0) | F.exists("categories", lambda c: (c >= bucket) & (c < bucket + 1000)))


def clamp_params(df: DataFrame, ints: dict[str, tuple[int, int]], bools: list[str], lists: list[str]) -> DataFrame:
    """Typed options from texts: numbers clamped, four spellings of yes, lists cut at comma or plus; unknown columns stay as they are."""
    out = {c: F.greatest(F.lit(lo), F.least(F.lit(hi), F.col(c).try_cast("long"))).cast("long") for c, (lo, hi) in ints.items()}
    out |= {c: F.coalesce(F.lower(c).isin("1", "true", "yes", "on"), F.lit(False)) for c in bools}
    out |= {c: F.split(c, "[,+]") for c in lists}
    return df.withColumns(out)


def drop_account_items(df: DataFrame, from_account: Column, per_file: bool) -> DataFrame:
    """Rows of an account never enter an index; rows that hold several works only where single files can be chosen (``per_file``)."""
    kept = df.where(~F.coalesce(from_account, F.lit(False)))
    return kept if per_file else kept.where(~F.col("multi_work"))


def episode_is_weak(df: DataFrame, relevant: Column, floor: int, key: str = "request_id") -> DataFrame:
    """Per request the relevant rows, the healthy ones of them (enough seeders, and no mark of a foreign language in the title), and ``weak``: there are relevant rows and none is healthy."""
    rows = T.read_once(df, {"__alien": T.foreign_audio(F.col("title"))})
    good = relevant & (F.col("seeders") >= floor) & ~F.col("__alien")
    per = rows.groupBy(key).agg(F.count_if(relevant).alias("n"), F.count_if(good).alias("n_healthy"))
    return per.withColumn("weak", (F.col("n") > 0) & (F.col("n_healthy") == 0))


#: Least share of a search's words that a post must bear.
LEGIBLE = 0.6


def search_words(query: Column) -> Column:
    """The words of a search that count: without one year at its end, those of more than two letters if there are two such."""
    all_ = T.let(T.tokens(query), lambda t: F.when((F.size(t) >= 2) & F.element_at(t, -1).rlike("^[0-9]{4}$"), F.slice(t, F.lit(1), F.size(t) - 1)).otherwise(t))
    return T.let(all_, lambda t: T.let(F.filter(t, lambda w: F.length(w) > 2), lambda long: F.when(F.size(long) >= 2, long).otherwise(t)))


def filter_legible_posts(posts: DataFrame, searches: DataFrame, most: int, on: str = "search") -> DataFrame:
    """The posts of each search that may be meant: they bear enough of its words and name no other season; the first ``most``.

    ``posts`` has ``on``, ``pos`` and ``title``; ``searches`` has ``search``, ``on``, ``query`` and ``season`` (null: none
    asked for); searches of one value of ``on`` share its posts. The season is told before the cut, so that other seasons'
    posts take no place. A search without words passes all.

    A search takes all posts of one title or none, so of these only the first ``most`` can be among its own. Titles meet
    the distinct lists of words at one of so many of them that none is missed, and equal searches are cut once.
    """
    asked = searches.select(*dict.fromkeys([on, "search"]), F.array_sort(search_words(F.col("query"))).alias("wanted"), F.col("season").alias("asked"))
    first = posts.withColumn("nth", F.row_number().over(W.partitionBy(on, "title").orderBy("pos"))).where(F.col("nth") <= most).drop("nth")
    season = lambda k: F.nullif(F.regexp_extract("title", r"(?i)(?:\bS(\d{1,2})\b|(\d{1,2})\s*[ªº]\s*Temporada)", k), F.lit(""))
    titles = posts.select(on, "title").distinct().select(on, "title", T.tokens(F.col("title")).alias("tt"), F.coalesce(season(1), season(2)).cast("long").alias("named"))
    lists = asked.select(on, "wanted").distinct()
    # who holds a share of n words holds one of the first n - least + 1
    least = F.ceil(F.size("wanted") * F.lit(LEGIBLE) - 1e-9)
    probes = lists.where(F.size("wanted") > 0).select(on, "wanted", F.explode(F.array_distinct(F.slice("wanted", F.lit(1), (F.size("wanted") - least + 1).cast("int")))).alias("word"))
    held = F.size(F.filter("wanted", lambda w: F.array_contains("tt", w)))
    near = titles.withColumn("word", F.explode(F.array_distinct("tt"))).join(probes, [on, "word"]).where(held / F.size("wanted") >= LEGIBLE)
    met = near.select(on, "title", "named", "wanted").distinct().unionByName(titles.join(lists.where(F.size("wanted") == 0), on).select(on, "title", "named", "wanted"))
    kinds = asked.select(on, "wanted", "asked").distinct()
    fits = met.join(kinds, [on, "wanted"]).where(F.coalesce((F.col("asked") <= 0) | (F.col("named") == F.col("asked")), F.lit(True))).select(F.col(on).alias("__on"), F.col("title").alias("__title"), "wanted", "asked")
    found = first.join(fits, (F.col(on) == F.col("__on")) & F.col("title").eqNullSafe(F.col("__title"))).drop("__on", "__title")
    cut = found.withColumn("nth", F.row_number().over(W.partitionBy(on, "wanted", "asked").orderBy("pos")).cast("long")).where(F.col("nth") <= most)
    own = asked.select(F.col(on).alias("__on"), F.col("search").alias("__search"), F.col("wanted").alias("__wanted"), F.col("asked").alias("__asked"))
    kept = cut.join(own, (F.col(on) == F.col("__on")) & (F.col("wanted") == F.col("__wanted")) & F.col("asked").eqNullSafe(F.col("__asked")))
    return kept.select(F.col("__search").alias("search"), *[c for c in posts.columns if c not in (on, "search")], "nth")
