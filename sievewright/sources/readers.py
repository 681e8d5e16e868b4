"""Readers: every external form becomes a relation with fixed columns. Schemas are given, never inferred."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as T
from ..functions.identity import link_identity
from ..functions.text import decode_entities, quality, source_of, strip_tags

_ITEM = "struct<Title:string,Guid:string,InfoHash:string,MagnetUri:string,Seeders:bigint,Size:bigint,Tracker:string,Category:array<bigint>>"


def read_listings_json(spark: SparkSession, path: str, bucket: int = 2000) -> DataFrame:
    return parse_listings_json(spark.read.text(path), bucket)


def parse_listings_json(lines: DataFrame, bucket: int = 2000) -> DataFrame:
    """Aggregator JSON, ``{"Results": [...]}`` or a bare array a line: listings with decoded titles and the wanted categories."""
    raw = lines.select(F.trim("value").alias("v")).where("v <> ''")
    items = F.when(F.col("v").startswith("["), F.from_json("v", f"array<{_ITEM}>")).otherwise(F.from_json("v", f"struct<Results:array<{_ITEM}>>")["Results"])
    df = raw.select(F.inline(items))
    cats = F.coalesce("Category", F.array().cast("array<bigint>"))
    df = df.where((F.size(cats) == 0) | F.exists(cats, lambda c: (c >= bucket) & (c < bucket + 1000)))
    return df.select(T.info_hash(F.coalesce("InfoHash", "MagnetUri")).alias("hash"), T.decode_entities(F.col("Title")).alias("title"), F.greatest(F.coalesce("Seeders", F.lit(0)), F.lit(0)).alias("seeders"), T.known_size(F.coalesce("Size", F.lit(0))).alias("size"), F.col("Tracker").alias("indexer"))


def read_listings_flat(spark: SparkSession, path: str) -> DataFrame:
    """Flat JSON of the second aggregator, an array or an object a line."""
    return flat_listings(spark.read.schema(FLAT).json(path))


#: Columns of the second aggregator.
FLAT = "title string, infoHash string, magnetUrl string, guid string, seeders bigint, size bigint, indexer string"


def flat_listings(df: DataFrame) -> DataFrame:
    return df.select(T.info_hash(F.coalesce("infoHash", "magnetUrl", "guid")).alias("hash"), F.col("title"), F.coalesce("seeders", F.lit(0)).alias("seeders"), T.known_size(F.coalesce("size", F.lit(0))).alias("size"), "indexer")


def read_listings_feed(spark: SparkSession, path: str) -> DataFrame:
    return feed_listings(spark.read.schema("streams array<struct<name:string,title:string,infoHash:string>>").json(path).select(F.inline("streams")))


def feed_listings(df: DataFrame) -> DataFrame:
    """A feed whose numbers hide in a display line: the line with a size is taken apart, the others are the title."""
    lines = F.split("title", "\n")
    facts = F.concat_ws(" ", F.filter(lines, lambda x: x.rlike(r"💾|👤|⚙")))
    return df.select(
        T.info_hash(F.col("infoHash")).alias("hash"), F.concat_ws(" ", F.filter(lines, lambda x: ~x.rlike(r"💾|👤|⚙"))).alias("title"), F.coalesce(F.regexp_extract(facts, r"👤\s*(\d+)", 1).try_cast("long"), F.lit(0)).alias("seeders"),
        F.coalesce(T.parse_size(F.regexp_extract(facts, r"💾\s*([\d.,]+\s*[KMGT]?B)", 1)), F.lit(0)).alias("size"), F.trim(F.regexp_extract(facts, r"⚙️?\s*(.+)$", 1)).alias("indexer"),
    )


def read_source_catalog(spark: SparkSession, path: str, configured: list[str]) -> DataFrame:
    return source_catalog(spark.read.format("xml").option("rowTag", "indexer").schema(REGISTRY).load(path), configured)


#: Columns of the source registry; ``_id`` is the attribute.
REGISTRY = "_id string, id string, title string, language string"


def source_catalog(df: DataFrame, configured: list[str]) -> DataFrame:
    """Source registry (id as attribute or child); ids with odd characters go; configured ids missing there follow in order."""
    spark = df.sparkSession
    good = df.select(F.trim(F.coalesce("_id", "id")).alias("id"), F.col("title").alias("label"), "language").where(F.col("id").rlike("^[A-Za-z0-9_-]+$")).withColumn("place", F.lit(0))
    extra = spark.createDataFrame([(c, i + 1) for i, c in enumerate(configured)], "id string, place int").select("id", F.col("id").alias("label"), F.lit(None).cast("string").alias("language"), "place")
    both = good.unionByName(extra)
    return both.withColumn("rn", F.row_number().over(W.partitionBy("id").orderBy("place"))).where("rn = 1").drop("rn")


def read_account_snapshot(raw: DataFrame) -> DataFrame:
    """Rows of an account: those without id or hash go, hashes in lower case, seconds become times, ready by flag or status."""
    return raw.where("id is not null and hash is not null and hash <> ''").select(
        F.col("id").alias("service_id"), F.lower("hash").alias("hash"), F.coalesce("filename", F.lit("")).alias("filename"), F.coalesce("size", F.lit(0)).alias("size"), "status", (F.coalesce("ready", F.lit(False)) | (F.lower("status") == "ready")).alias("ready"), F.timestamp_seconds("upload_date").alias("uploaded_at")
    )


def ready_inventory(snapshot: DataFrame) -> DataFrame:
    return snapshot.where("ready and filename <> '' and lower(filename) <> hash")


#: Levels that a file tree may have before the job ends with an error rather than run on for ever.
MOST_LEVELS = 1000


def explode_file_tree(df: DataFrame, column: str = "tree") -> DataFrame:
    """Nested ``{"n": name, "s": size, "e": [children]}`` as flat files with their path, at any depth.

    A recursive query opens one level of all trees in each step, so there are as many steps as the deepest tree has
    levels. A node with an ``e`` is a folder, if an empty one; null and malformed trees have no files.
    """
    spark, keep = df.sparkSession, [c for c in df.columns if c != column]
    names = {c: f"k{i}" for i, c in enumerate(keep)}
    keys = "".join(f"{n}, " for n in names.values())
    top = df.select(*[F.col(c).alias(n) for c, n in names.items()], F.explode(F.from_json(F.col(column), "array<string>")).alias("raw"))
    spark.conf.set("spark.sql.cteRecursionLevelLimit", MOST_LEVELS)
    spark.conf.set("spark.sql.cteRecursionRowLimit", -1)
    node = "from_json({}, 'struct<n:string,s:bigint,e:array<string>>')"
    found = spark.sql(
        f"""WITH RECURSIVE tree AS (
  SELECT {keys}x.n AS path, x.s AS size, x.e AS inside FROM (SELECT {keys}{node.format('raw')} AS x FROM {{top}})
  UNION ALL
  SELECT {keys}CASE WHEN path = '' THEN x.n ELSE concat_ws('/', path, x.n) END, x.s, x.e FROM (SELECT {keys}path, {node.format('child')} AS x FROM (SELECT {keys}path, explode(inside) AS child FROM tree)))
SELECT {keys}path, size FROM tree WHERE inside IS NULL AND path IS NOT NULL""",
        top=top,
    )
    return found.withColumnsRenamed({n: c for c, n in names.items()})


def read_popular(df: DataFrame, today: str, votes: int, most: int) -> DataFrame:
    """The most voted released works per type; first occurrence of an id, types mapped, ids checked."""
    kind = F.expr("CASE type WHEN 'movie' THEN 'movie' WHEN 'tvMovie' THEN 'movie' WHEN 'tvSeries' THEN 'series' WHEN 'tvMiniSeries' THEN 'series' END")
    ok = df.where(F.col("id").rlike("^tt[0-9]+$")).withColumn("kind", kind).where(f"kind is not null and votes >= {votes}")
    day = F.lit(today).cast("date")
    ok = ok.where(F.when(F.col("released").isNotNull(), F.col("released") <= day).otherwise(F.col("start_year") <= F.year(day)))
    one = ok.groupBy("id", "kind").agg(F.max("votes").alias("votes"))
    return one.withColumn("place", F.row_number().over(W.partitionBy("kind").orderBy(F.col("votes").desc(), "id")).cast("long")).where(F.col("place") <= most)


def resolve_names(works: DataFrame, meta: DataFrame, titles: DataFrame) -> DataFrame:
    """Name by preference of its sources, else the id; all known names once."""
    j = works.join(meta, "work_id", "left").join(titles, "work_id", "left")
    return j.select("work_id", F.coalesce("meta_name", "original", "localised", F.col("work_id").cast("string")).alias("name"), F.coalesce("meta_year", "title_year").alias("year"), F.array_compact(F.array("meta_name", "original", "localised")).alias("names"))


def work_id(c: Column) -> Column:
    """``tt:season:episode`` as its parts; missing or odd parts are null."""
    part = lambda i: F.try_element_at(F.split(c, ":"), F.lit(i))
    return F.struct(part(1).alias("work"), part(2).try_cast("long").alias("season"), part(3).try_cast("long").alias("episode"))


#: Layouts of listing pages: how a card, its link, its title and what else it tells look; an empty pattern: the layout does not tell it. Fixed values of the site profiles.
PROFILES = {
    "post": {"card": r'(?s)<div class="post">.*?</div>\s*</div>', "link": r'href="([^"]+)"', "title": r"<a [^>]*>([^<]+)</a>", "original": r"(?i)t[ií]tulo original:?\s*(?:</[a-z]+>)?\s*([^<]+)", "date": r"(\d{2}/\d{2}/\d{4})", "poster": r'<img[^>]+src="([^"]+)"'},
    "article": {"card": r"(?s)<article.*?</article>", "link": r'href="([^"]+)"', "title": r"<h[12][^>]*>(?:<a [^>]*>)?([^<]+)</", "original": "", "date": r"datetime=\"(\d{4}-\d{2}-\d{2})", "poster": r'<img[^>]+src="([^"]+)"'},
    "list": {"card": r"(?s)<li>.*?</li>", "link": r'href="([^"]+)"', "title": r"<a [^>]*>([^<]*)</a>", "original": "", "date": "", "poster": ""},
    "heading": {"card": r"(?s)<h2[^>]*>.*?</h2>", "link": r'href="([^"]+)"', "title": r"<a [^>]*>([^<]+)</a>", "original": "", "date": "", "poster": ""},
    "card": {"card": r'(?s)<a class="sa-card[^>]*>.*?</a>', "link": r'href="([^"]+)"', "title": r">([^<]+)<", "original": "", "date": "", "poster": r'<img[^>]+src="([^"]+)"'},
}


def resolved(url: Column, page: Column) -> Column:
    """An address as it stands on a page: absolute, from the host's root, or beside the page."""
    host = F.regexp_extract(page, r"^(https?://[^/]+)", 1)
    beside = F.regexp_replace(page, r"(?<=[^/:])/[^/]*$", "")
    return F.when(url.isNull() | url.rlike("^[a-z]+:"), url).when(url.startswith("//"), F.concat(F.regexp_extract(page, "^([a-z]+:)", 1), url)).when(url.startswith("/"), F.concat(host, url)).otherwise(F.concat_ws("/", beside, url))


def pages_to_posts(pages: DataFrame, profile: str) -> DataFrame:
    """Cards of listing pages in order, the first of each link; posts that are only lists go.

    Returns ``page_id``, ``pos``, ``post_url`` (resolved), ``title``, and, where the layout tells them, ``original`` (the
    work's own title), ``posted`` (date) and ``poster`` (resolved), else null. References in texts are decoded.
    """
    p = PROFILES[profile]
    cards = pages.select("page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit(p["card"]), F.lit(0))).alias("pos", "card"))
    told = lambda what: F.nullif(F.trim(F.regexp_extract("card", p[what], 1)), F.lit("")) if p[what] else F.lit(None).cast("string")
    date = told("date")
    posted = F.coalesce(F.try_to_timestamp(date, F.lit("dd/MM/yyyy")), F.try_to_timestamp(date, F.lit("yyyy-MM-dd"))).cast("date")
    posts = cards.select("page_id", "pos", resolved(told("link"), F.col("url")).alias("post_url"), F.coalesce(decode_entities(told("title")), F.lit("")).alias("title"), decode_entities(told("original")).alias("original"), posted.alias("posted"), resolved(told("poster"), F.col("url")).alias("poster"))
    posts = posts.where("post_url is not null").where(~F.lower("title").rlike("^(list|lista|liste) (of|de|des|der) "))
    return posts.withColumn("rn", F.row_number().over(W.partitionBy("page_id", "post_url").orderBy("pos"))).where("rn = 1").drop("rn")


#: How far what a link's own text says of the episode reaches: to the link alone, to all links behind it, or not at all.
SCOPES = ("anchor-local", "anchor-writes", "segment-only")
# What posts write above their links, in upper case.
EPISODE_TEXT, PACK_TEXT = r"(?:EPIS[ÓO]DIO|\bEP\.?) *0*([0-9]{1,3})", "TEMPORADA COMPLETA|PACK|COMPLETO"
AUDIO_TEXT = {"Dual": "DUAL [ÁA]UDIO|DUAL", "Dublado": "DUBLAD[OA]", "Legendado": "LEGENDAD[OA]", "Nacional": "NACIONAL"}
_ANCHOR = r'(?s)<a [^>]*?href="[^"]*"[^>]*>.*?</a>'
_RESET = -1


def post_links(posts: DataFrame, scope: str, tie_break: bool = True, audio: str = "") -> DataFrame:
    """Links of posts with what the sections above them say: audio and episode are carried from link to link.

    The text between two links is the segment of the second. An audio that a segment names holds from there on, one that
    a link's text names for the link alone; ``audio`` holds at first. An episode that a segment names holds until a mark
    of a pack takes it away; where both stand in one segment the later decides (``tie_break``), else the pack does. The
    link's own text reaches as far as ``scope`` says. Quality, source and size (the last) come from segment and link.

    ``posts`` has ``page_id`` and ``html``. Returns ``page_id``, ``nth``, ``href``, ``audio``, ``episode``, ``quality``,
    ``source`` and ``size``. The carried states are windows over a post's links: a reset is a value of its own.
    """
    return scoped_links(posts, (scope,), tie_break, audio).drop("scope")


def scoped_links(posts: DataFrame, scopes: tuple[str, ...] = SCOPES, tie_break: bool = True, audio: str = "") -> DataFrame:
    """``post_links`` in several scopes, told by ``scope``. Every text is read once for all of them, before its links come together, so that no text is moved."""
    if set(scopes) - set(SCOPES):
        raise ValueError(f"scope must be one of {SCOPES}")
    anchors, between = F.regexp_extract_all("html", F.lit(_ANCHOR), F.lit(0)), F.split("html", _ANCHOR)
    rows = posts.select("page_id", F.posexplode(F.arrays_zip(anchors.alias("link"), F.slice(between, F.lit(1), F.size(anchors)).alias("text"))).alias("pos", "x"))
    rows = rows.select("page_id", "pos", F.col("x.link").alias("link"), F.upper(strip_tags(F.col("x.text"))).alias("segment"), F.upper(strip_tags(F.col("x.link"))).alias("own"))

    def last_at(c: Column, pattern: str) -> Column:
        """Where the last match of a pattern begins; null without one."""
        return F.when(c.rlike(pattern), F.length(F.regexp_extract(c, f"(?s)^(.*)(?:{pattern})", 1)))

    def last_episode(c: Column) -> Column:
        return F.when(c.rlike(EPISODE_TEXT), F.regexp_extract(c, f"(?s)^.*{EPISODE_TEXT}", 1).try_cast("int"))

    def signal(c: Column, tie: bool) -> Column:
        """The episode that a text names last, a reset if a pack stands behind it (or, without ``tie``, anywhere), else null."""
        wins = (last_at(c, EPISODE_TEXT) > last_at(c, PACK_TEXT)) if tie else F.lit(False)
        return F.when(c.rlike(PACK_TEXT) & ~F.coalesce(wins, F.lit(False)), F.lit(_RESET)).otherwise(last_episode(c))

    named = lambda c: reduce(lambda a, kv: a.when(c.rlike(kv[1]), kv[0]), AUDIO_TEXT.items(), F.when(F.lit(False), ""))
    segment, own, context = F.col("segment"), F.col("own"), F.concat_ws(" ", "segment", "own")
    size = F.element_at(F.concat(F.array(F.lit("")), F.regexp_extract_all(context, F.lit("([0-9.,]+ *[TGMK]B)\\b"), F.lit(1))), -1)
    read = rows.select(
        "page_id", "pos", F.regexp_extract("link", r'href="([^"]*)"', 1).alias("href"), signal(segment, tie_break).alias("told"), last_episode(own).alias("own_episode"), F.when(own.rlike(PACK_TEXT), F.lit(_RESET)).alias("own_pack"),
        named(segment).alias("heard"), named(own).alias("own_heard"), quality(context).alias("quality"), source_of(context).alias("source"), F.nullif(size, F.lit("")).alias("size"),
    )
    w = W.partitionBy("page_id").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    carried = lambda c: F.nullif(F.last(c, ignorenulls=True).over(w), F.lit(_RESET))
    held = read.withColumns({"state": carried(F.col("told")), "written": carried(F.coalesce("own_episode", "own_pack", "told")), "audio": F.coalesce("own_heard", F.last("heard", ignorenulls=True).over(w), F.lit(audio))})
    states = {"anchor-local": F.when(F.col("own_pack").isNull(), F.coalesce("own_episode", "state")), "anchor-writes": F.col("written"), "segment-only": F.col("state")}
    each = held.withColumn("x", F.explode(F.array(*[F.struct(F.lit(s).alias("scope"), states[s].cast("long").alias("episode")) for s in scopes])))
    return each.select("page_id", (F.col("pos") + 1).cast("long").alias("nth"), "href", "audio", "x.episode", "quality", "source", "size", "x.scope")


def posts_to_links(pages: DataFrame) -> DataFrame:
    """Links in page order with the section they stand in: the last heading before a link is its section, a new list or paragraph keeps it, the footer resets it."""
    parts = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r"(?s)<h[1-6][^>]*>[^<]*|<a href=\"[^\"]*\"[^>]*>[^<]*|<footer"), F.lit(0))).alias("pos", "part"))
    head = F.when(F.col("part").rlike("^<h[1-6]"), F.trim(F.regexp_extract("part", r"<h[1-6][^>]*>([^<]*)", 1))).when(F.col("part").startswith("<footer"), F.lit("\u0000"))
    w = W.partitionBy("page_id").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    held = parts.withColumn("section", F.nullif(F.last(head, ignorenulls=True).over(w), F.lit("\u0000")))
    links = held.where(F.col("part").startswith("<a "))
    return links.select("page_id", F.row_number().over(W.partitionBy("page_id").orderBy("pos")).cast("long").alias("nth"), F.regexp_extract("part", r'href="([^"]*)"', 1).alias("href"), F.regexp_extract("part", r">([^<]*)$", 1).alias("label"), "section")


def pick_link(links: DataFrame, asked: DataFrame) -> DataFrame:
    """The link of a post that is asked for: that of the given identity, or else that at the given place, if the post still has as many links as were counted.

    ``links`` has ``page_id``, ``nth`` (from 1) and ``href``; ``asked`` has ``page_id``, ``id`` (ten hex digits; may be
    null), ``nth`` and ``counted`` (may be null). Returns ``page_id`` and ``href``, null where the post has changed.
    """
    own = links.select("page_id", F.col("nth").alias("at"), "href", link_identity(F.col("href")).alias("own"))
    j = asked.join(own, "page_id", "left")
    per = j.groupBy("page_id", "id", "nth", "counted").agg(F.min_by("href", F.when(F.col("own") == F.col("id"), F.col("at"))).alias("same"), F.min_by("href", F.when(F.col("at") == F.col("nth"), F.col("at"))).alias("placed"), F.count("at").alias("n"))
    changed = F.col("id").isNotNull() & F.col("counted").isNotNull() & (F.col("counted") != F.col("n"))
    return per.select("page_id", F.coalesce("same", F.when(~changed, F.col("placed"))).alias("href"))


def season_cards(pages: DataFrame, season: int | None) -> DataFrame:
    """Links that may lead to a season: those whose address names another one go, unnumbered ones stay."""
    links = posts_to_links(pages).withColumn("season", F.regexp_extract("href", r"(?:temporada|season)-?(\d{1,2})", 1).try_cast("long"))
    return links if season is None else links.where(F.col("season").isNull() | (F.col("season") == season))


#: What each account service calls its states; the first rule that fits decides.
STATUS_RULES = [("alpha", "^ready$|^downloaded$", "ready"), ("alpha", "^downloading$|^queued", "downloading"), ("alpha", "error|dead", "dead"), ("beta", "cached|completed|finished", "ready"), ("beta", "download|stalled|meta", "downloading"), ("beta", "error|failed|expired", "dead")]


def normalize_status(df: DataFrame, service: str) -> DataFrame:
    """A service's own states as ready, downloading, dead or unknown, and whether the row is stalled."""
    s = F.lower("status")
    rules = [r for r in STATUS_RULES if r[0] == service]
    state = reduce(lambda a, r: a.when(s.rlike(r[1]), r[2]), rules[1:], F.when(s.rlike(rules[0][1]), rules[0][2])).otherwise("unknown")
    return df.withColumns({"state": state, "stalled": s.rlike("stalled")})
