"""Queries of the sources and sinks (SRC, SNK) over the given tables, and of single expressions (EXP)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import identity as I
from ..functions import text as T
from ..functions.text import decode_entities
from ..sources import readers as S
from ..sources import sinks as K
from ..sources.relations import LISTINGS, NOW, SNAPSHOT, listings, read, snapshot, with_cte
from .registry import query


_KNOWN = "CASE WHEN size > 1024 AND size < 536870912000 THEN size ELSE 0 END"


@query(with_cte(LISTINGS) + f"SELECT hash, title || ' & co' AS title, seeders, {_KNOWN} AS size, CAST(indexer AS VARCHAR) AS indexer FROM listings WHERE NOT multi_work")
def src1_read_listings_json(spark, sf):
    """Listings written as aggregator JSON and read again."""
    cats = F.when(F.col("multi_work"), F.array(F.lit(8000))).otherwise(F.array(F.col("season") * 10 + 2000))
    item = F.struct(F.concat("title", F.lit(" &amp; co")).alias("Title"), F.upper("hash").alias("InfoHash"), F.col("seeders").alias("Seeders"), F.col("size").alias("Size"), F.col("indexer").cast("string").alias("Tracker"), cats.alias("Category"))
    return S.parse_listings_json(listings(spark, sf).select(F.to_json(F.struct(F.array(item).alias("Results"))).alias("value")))


@query(with_cte(LISTINGS) + f"SELECT hash, title, seeders, {_KNOWN} AS size, CAST(indexer AS VARCHAR) AS indexer FROM listings")
def src2_read_listings_flat(spark, sf):
    li = listings(spark, sf)
    row = F.struct("title", F.concat(F.lit("magnet:?xt=urn:btih:"), F.upper("hash"), F.lit("&dn=x")).alias("magnetUrl"), "seeders", "size", F.col("indexer").cast("string").alias("indexer"))
    return S.flat_listings(li.select(F.from_json(F.to_json(row), S.FLAT).alias("x")).select("x.*"))


@query(with_cte(LISTINGS) + "SELECT hash, title, seeders, CAST(round((season + 0.5) * 1073741824.0) AS BIGINT) AS size, 'src' || indexer AS indexer FROM listings")
def src3_read_listings_feed(spark, sf):
    shown = F.concat("title", F.lit("\n👤 "), F.col("seeders").cast("string"), F.lit(" 💾 "), F.col("season").cast("string"), F.lit(".5 GB ⚙️ src"), F.col("indexer").cast("string"))
    return S.feed_listings(listings(spark, sf).select(shown.alias("title"), F.col("hash").alias("infoHash")))


@query("SELECT id, label, CAST(language AS VARCHAR) AS language, place FROM (SELECT 's' || s_suppkey AS id, s_name AS label, 'xx' AS language, 0 AS place FROM supplier WHERE s_suppkey % 10 <> 0 UNION ALL SELECT 'extra', 'extra', NULL, 2)")
def src4_read_source_catalog(spark, sf):
    """Suppliers written as XML rows and read again; ids with a blank go, configured ones follow."""
    s = read(spark, sf, "supplier")
    sid = F.concat(F.lit("s"), F.when(F.col("s_suppkey") % 10 == 0, F.lit(" ")).otherwise(""), F.col("s_suppkey").cast("string"))
    xml = F.concat(F.lit('<indexer id="'), sid, F.lit('"><title>'), "s_name", F.lit("</title><language>xx</language></indexer>"))
    return S.source_catalog(s.select(F.from_xml(xml, S.REGISTRY).alias("x")).select("x.*"), ["s1", "extra", "extra"])


@query(with_cte(LISTINGS) + "SELECT work_id % 8 AS shelf, count(*) AS n, CAST(sum(seeders) AS BIGINT) AS seeders FROM listings GROUP BY 1")
def snk1_write_index(spark, sf):
    """The index written by shelf in two steps, of which the second overwrites the shelves that it holds, and read again."""
    li = listings(spark, sf).select("lid", "seeders", (F.col("work_id") % 8).alias("shelf"))
    path = K.scratch(spark, "index")
    K.write_index(li.where("shelf < 6 and seeders < 30"), path)
    K.write_index(li.where("shelf < 6"), path)
    K.write_index(li.where("shelf >= 6"), path)
    return spark.read.schema("lid string, seeders long, shelf long").parquet(path).groupBy("shelf").agg(F.count("*").alias("n"), F.sum("seeders").alias("seeders"))


def _raw_account(spark, sf):
    o = read(spark, sf, "orders")
    return o.select(F.when(F.col("o_orderkey") % 17 != 0, F.col("o_orderkey")).alias("id"), F.when(F.col("o_orderkey") % 19 != 0, F.upper(F.sha1(F.col("o_custkey").cast("string").cast("binary")))).alias("hash"), F.when(F.col("o_orderkey") % 23 == 0, F.sha1(F.col("o_custkey").cast("string").cast("binary"))).otherwise(F.col("o_orderpriority")).alias("filename"), F.floor("o_totalprice").cast("long").alias("size"), F.expr("CASE o_orderstatus WHEN 'F' THEN 'Ready' WHEN 'O' THEN 'Downloading' ELSE 'Error' END").alias("status"), (F.col("o_orderkey") % 29 == 0).alias("ready"), F.unix_timestamp("o_orderdate").alias("upload_date"))


_RAW = """acc AS (SELECT o_orderkey AS service_id, sha1(CAST(o_custkey AS VARCHAR)) AS hash, CASE WHEN o_orderkey % 23 = 0 THEN sha1(CAST(o_custkey AS VARCHAR)) ELSE o_orderpriority END AS filename, CAST(floor(o_totalprice) AS BIGINT) AS size,
  CASE o_orderstatus WHEN 'F' THEN 'Ready' WHEN 'O' THEN 'Downloading' ELSE 'Error' END AS status, o_orderkey % 29 = 0 OR o_orderstatus = 'F' AS ready, o_orderdate AS uploaded_at FROM orders WHERE o_orderkey % 17 <> 0 AND o_orderkey % 19 <> 0)"""


@query(with_cte(_RAW) + "SELECT * FROM acc")
def src5_read_account_snapshot(spark, sf):
    return S.read_account_snapshot(_raw_account(spark, sf))


@query(with_cte(_RAW) + "SELECT service_id, filename FROM acc WHERE ready AND filename <> '' AND filename <> hash")
def src6_ready_inventory(spark, sf):
    return S.ready_inventory(S.read_account_snapshot(_raw_account(spark, sf))).select("service_id", "filename")


@query("SELECT l_orderkey AS id, count(*) AS files, CAST(sum(floor(l_extendedprice)) AS BIGINT) AS bytes FROM lineitem GROUP BY 1")
def src7_explode_file_tree(spark, sf):
    """Trees built from the lines of each order: files under a folder a supplier."""
    li = read(spark, sf, "lineitem")
    leaf = F.to_json(F.struct(F.concat(F.lit("f"), F.col("l_linenumber").cast("string")).alias("n"), F.floor("l_extendedprice").cast("long").alias("s")))
    per = li.groupBy("l_orderkey", "l_suppkey").agg(F.concat_ws(",", F.sort_array(F.collect_list(leaf))).alias("leaves"))
    folders = per.groupBy("l_orderkey").agg(F.concat_ws(",", F.sort_array(F.collect_list(F.concat(F.lit('{"n":"d'), F.col("l_suppkey").cast("string"), F.lit('","e":['), "leaves", F.lit("]}"))))).alias("x"))
    trees = folders.select(F.col("l_orderkey").alias("id"), F.concat(F.lit("["), "x", F.lit("]")).alias("tree"))
    return S.explode_file_tree(trees).groupBy("id").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


@query(
    """WITH p AS (SELECT 'tt' || p_partkey AS id, CASE p_size % 5 WHEN 0 THEN 'movie' WHEN 1 THEN 'tvMovie' WHEN 2 THEN 'tvSeries' WHEN 3 THEN 'tvMiniSeries' ELSE 'short' END AS type, CAST(floor(p_retailprice) AS BIGINT) AS votes, 1980 + p_size AS start_year FROM part),
k AS (SELECT id, CASE WHEN type IN ('movie', 'tvMovie') THEN 'movie' WHEN type IN ('tvSeries', 'tvMiniSeries') THEN 'series' END AS kind, votes FROM p WHERE votes >= 10 AND start_year <= 2024)
SELECT id, kind, votes, place FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY votes DESC, id) AS place FROM k WHERE kind IS NOT NULL) WHERE place <= 100"""
)
def src8_read_popular_feed(spark, sf):
    p = read(spark, sf, "part")
    df = p.select(F.concat(F.lit("tt"), F.col("p_partkey").cast("string")).alias("id"), F.expr("CASE p_size % 5 WHEN 0 THEN 'movie' WHEN 1 THEN 'tvMovie' WHEN 2 THEN 'tvSeries' WHEN 3 THEN 'tvMiniSeries' ELSE 'short' END").alias("type"), F.floor("p_retailprice").cast("long").alias("votes"), F.lit(None).cast("date").alias("released"), (F.col("p_size") + 1980).alias("start_year"))
    return S.read_popular(df, "2024-06-01", 10, 100)


@query(
    """WITH m AS (SELECT p_partkey AS work_id, p_name AS meta_name, 1980 + p_size AS meta_year FROM part WHERE p_partkey % 3 <> 0), t AS (SELECT p_partkey AS work_id, p_type AS original, CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS localised, 1981 + p_size AS title_year FROM part WHERE p_partkey % 5 <> 0)
SELECT p_partkey AS work_id, coalesce(meta_name, original, localised, CAST(p_partkey AS VARCHAR)) AS name, CAST(coalesce(meta_year, title_year) AS INTEGER) AS year, [x for x in [meta_name, original, localised] if x IS NOT NULL] AS names FROM part LEFT JOIN m ON p_partkey = m.work_id LEFT JOIN t ON p_partkey = t.work_id"""
)
def src9_resolve_work_names(spark, sf):
    p = read(spark, sf, "part").withColumnRenamed("p_partkey", "work_id")
    meta = p.where("work_id % 3 <> 0").select("work_id", F.col("p_name").alias("meta_name"), (F.col("p_size") + 1980).alias("meta_year"))
    titles = p.where("work_id % 5 <> 0").select("work_id", F.col("p_type").alias("original"), F.expr("CASE WHEN work_id % 2 = 0 THEN p_brand END").alias("localised"), (F.col("p_size") + 1981).alias("title_year"))
    return S.resolve_names(p.select("work_id"), meta, titles)


@query(
    """WITH i AS (SELECT p_partkey AS id, 'tt' || p_partkey || CASE p_size % 3 WHEN 0 THEN '' WHEN 1 THEN ':' || p_size ELSE ':' || p_size || ':' || (p_size + 1) END AS s FROM part)
SELECT id, split_part(s, ':', 1) AS work, TRY_CAST(nullif(split_part(s, ':', 2), '') AS BIGINT) AS season, TRY_CAST(nullif(split_part(s, ':', 3), '') AS BIGINT) AS episode FROM i"""
)
def src10_work_id(spark, sf):
    s = F.expr("concat('tt', p_partkey, CASE p_size % 3 WHEN 0 THEN '' WHEN 1 THEN concat(':', p_size) ELSE concat(':', p_size, ':', p_size + 1) END)")
    return read(spark, sf, "part").select(F.col("p_partkey").alias("id"), S.work_id(s).alias("w")).select("id", "w.*")


_CARDS = """c AS (SELECT page_id, i, regexp_extract(url, '^(https?://[^/]+)', 1) AS host, x[i] AS card FROM (SELECT page_id, url, regexp_extract_all(html, '(?s)<li>.*?</li>') AS x FROM pages), generate_series(1, len(x)) g(i)),
p AS (SELECT page_id, i, host, regexp_extract(card, 'href="([^"]+)"', 1) AS href, trim(regexp_extract(card, '<a [^>]*>([^<]*)</a>', 1)) AS title FROM c)"""


_POSTS = f"""WITH {_CARDS}, u AS (SELECT page_id, i, CASE WHEN starts_with(href, '/') THEN host || href ELSE href END AS post_url, title FROM p WHERE href <> '')
SELECT page_id, CAST(min(i) - 1 AS INTEGER) AS pos, post_url, arg_min(title, i) AS title FROM u WHERE NOT regexp_matches(lower(title), '^(list|lista|liste) (of|de|des|der) ') GROUP BY page_id, post_url"""


@query(f"SELECT page_id, count(*) AS n_cards FROM ({_POSTS}) GROUP BY page_id")
def src11_pages_to_posts(spark, sf):
    return S.pages_to_posts(read(spark, sf, "pages"), "list").groupBy("page_id").agg(F.count("*").alias("n_cards"))


@query(_POSTS)
def src11_posts(spark, sf):
    """The layout of lists tells neither original title nor date nor poster."""
    return S.pages_to_posts(read(spark, sf, "pages"), "list").select("page_id", "pos", "post_url", "title")


_OFFERS = """WITH r AS (SELECT l_partkey AS work, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_shipdate, l_extendedprice) AS nth, CAST(l_quantity AS BIGINT) AS n, l_suppkey AS s FROM lineitem),"""


def _posts(spark, sf):
    """A post for each work: its listings are links, and what stands above them goes by source and amount."""
    order = F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate", "l_extendedprice")
    n = F.col("l_quantity").cast("long").cast("string")
    above = F.expr("""CASE l_suppkey % 8 WHEN 0 THEN '<h2>Dual &Aacute;udio</h2>' WHEN 1 THEN concat('<h3>Epis\u00f3dio 0', cast(l_quantity as bigint), '</h3>') WHEN 2 THEN '<h3>Temporada Completa</h3>' WHEN 3 THEN '<h2>LEGENDADO</h2>'
      WHEN 4 THEN concat('<p>Temporada completa, epis\u00f3dio ', cast(l_quantity as bigint), '</p>') WHEN 5 THEN concat('<p>Epis\u00f3dio ', cast(l_quantity as bigint), ' <b>Temporada completa</b></p>') ELSE '<br>' END""")
    text = F.expr("CASE cast(l_quantity as bigint) % 5 WHEN 0 THEN concat('Epis\u00f3dio ', cast(l_quantity as bigint) + 100) WHEN 1 THEN 'Temporada completa' WHEN 2 THEN 'Dublado 720p' ELSE '1080p WEB-DL 1.5 GB' END")
    part = F.concat(above, F.lit('<a class="b" href="/'), n, F.lit('">'), text, F.lit("</a>"))
    per = read(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("page_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct(order.alias("o"), part.alias("p")))), lambda x: x["p"]).alias("parts"))
    return per.select("page_id", F.array_join("parts", "\n").alias("html"))


def _carried(scope: str) -> str:
    """Links of the posts in SQL: what each says (e), what its section says (t, -1: none from here on), and what is carried."""
    own = "CASE WHEN e > 0 THEN e WHEN e = -1 THEN -1 ELSE t END" if scope == "anchor-writes" else "t"
    state = "nullif(last_value(x IGNORE NULLS) OVER w, -1)"
    last = f"CASE WHEN e IS DISTINCT FROM -1 THEN coalesce(e, {state}) END" if scope == "anchor-local" else state
    return f"""SELECT '{scope}' AS scope, work AS page_id, nth, '/' || n AS href, CAST({last} AS BIGINT) AS episode, CASE WHEN n % 5 = 2 THEN 'Dublado' ELSE coalesce(last_value(a IGNORE NULLS) OVER w, '') END AS audio,
  CASE WHEN n % 5 = 2 THEN '720p' WHEN n % 5 > 2 THEN '1080p' ELSE 'unknown' END AS quality, CASE WHEN n % 5 > 2 THEN 'WEB-DL' ELSE '' END AS source, CASE WHEN n % 5 > 2 THEN '1.5 GB' END AS size
  FROM (SELECT *, {own} AS x FROM m) WINDOW w AS (PARTITION BY work ORDER BY nth ROWS UNBOUNDED PRECEDING)"""


@query(
    _OFFERS
    + """ m AS (SELECT work, nth, n, CASE s % 8 WHEN 1 THEN n WHEN 2 THEN -1 WHEN 4 THEN n WHEN 5 THEN -1 END AS t, CASE n % 5 WHEN 0 THEN n + 100 WHEN 1 THEN -1 END AS e, CASE s % 8 WHEN 0 THEN 'Dual' WHEN 3 THEN 'Legendado' END AS a FROM r)
"""
    + " UNION ALL ".join(map(_carried, S.SCOPES))
)
def src12_post_links(spark, sf):
    """The links of all posts in each of the three scopes."""
    posts = _posts(spark, sf).withColumn("html", decode_entities(F.col("html")))
    return S.scoped_links(posts)


@query(
    """WITH l AS (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS h FROM pages)
SELECT page_id, CAST(i AS BIGINT) AS nth, h[i] AS href FROM l, generate_series(1, len(h)) g(i)"""
)
def src12_posts_to_links(spark, sf):
    return S.posts_to_links(read(spark, sf, "pages")).select("page_id", "nth", "href")


@query(
    """WITH l AS (SELECT page_id, regexp_extract_all(html, '(?s)<h[1-6][^>]*>[^<]*|<a href="[^"]*"[^>]*>[^<]*|<footer') AS x FROM pages), p AS (SELECT page_id, i, x[i] AS part FROM l, generate_series(1, len(x)) g(i)),
h AS (SELECT *, nullif(last_value(CASE WHEN regexp_matches(part, '^<h[1-6]') THEN trim(regexp_extract(part, '<h[1-6][^>]*>([^<]*)', 1)) WHEN starts_with(part, '<footer') THEN '|' END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY i ROWS UNBOUNDED PRECEDING), '|') AS section FROM p)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) AS nth, regexp_extract(part, 'href="([^"]*)"', 1) AS href, regexp_extract(part, '>([^<]*)$', 1) AS label, section FROM h WHERE starts_with(part, '<a ')"""
)
def src12_links_with_section(spark, sf):
    return S.posts_to_links(read(spark, sf, "pages"))


@query("SELECT page_id, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS href FROM pages) WHERE NOT regexp_matches(href, '(temporada|season)-?[0-9]') OR regexp_matches(href, '(temporada|season)-?2([^0-9]|$)') GROUP BY page_id")
def src13_season_cards(spark, sf):
    return S.season_cards(read(spark, sf, "pages"), 2).groupBy("page_id").agg(F.count("*").alias("n"))


@query(with_cte(SNAPSHOT) + "SELECT state, stalled, count(*) AS n FROM (SELECT CASE WHEN lower(status) IN ('ready', 'downloaded') THEN 'ready' WHEN lower(status) = 'downloading' THEN 'downloading' WHEN lower(status) LIKE '%error%' THEN 'dead' ELSE 'unknown' END AS state, lower(status) LIKE '%stalled%' AS stalled FROM snapshot) GROUP BY ALL")
def src14_normalize_account_status(spark, sf):
    return S.normalize_status(snapshot(spark, sf), "alpha").groupBy("state", "stalled").agg(F.count("*").alias("n"))


@query(
    """SELECT event_type || ':' || CAST(user_id AS VARCHAR) AS key, arg_max(value, (ts, event_id)) AS value, arg_max(ts + INTERVAL 1 HOUR, (ts, event_id)) AS expires_at FROM events GROUP BY 1"""
)
def snk2_kv_snapshot(spark, sf):
    e = read(spark, sf, "events").select(F.concat_ws(":", "event_type", F.col("user_id").cast("string")).alias("key"), "value", (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("expires_at"), F.col("ts").alias("used_at"), F.col("event_id").alias("seq"))
    # three batches of writes, as a stream would bring them
    table = K.kv_table(spark, K.scratch(spark, "kv"), e.schema)
    for number in range(3):
        table.merge(e.where(F.pmod("seq", F.lit(3)) == number), number)
    return table.read().select("key", "value", "expires_at")


@query("SELECT p_partkey AS link_id, p_name || ' [' || CASE WHEN p_size > 25 THEN '1080p WEB-DL' ELSE 'WEB-DL' END || CASE WHEN p_partkey % 2 = 0 THEN ' Dual' ELSE '' END || ']' AS title, CAST(floor(p_retailprice) AS BIGINT) AS size, CAST(1 AS BIGINT) AS seeders FROM part")
def snk3_links_to_feed(spark, sf):
    p = read(spark, sf, "part")
    links = p.select(F.col("p_partkey").alias("link_id"), F.col("p_name").alias("title"), F.when(F.col("p_size") > 25, "1080p").otherwise("").alias("quality"), F.lit("WEB-DL").alias("source"), F.when(F.col("p_partkey") % 2 == 0, "Dual").otherwise("").alias("audio"), F.lit("").alias("size_text"), F.floor("p_retailprice").cast("long").alias("size"))
    return K.links_to_feed(links)


@query(
    f"""WITH kv AS (SELECT event_type AS namespace, event_type || ':v' || (user_id % 3) || ':' || user_id AS key, max(ts + to_days(CAST(user_id % 20 AS INTEGER))) AS expires_at FROM events GROUP BY 1, 2),
l AS (SELECT * FROM kv WHERE expires_at + INTERVAL 6 HOUR > TIMESTAMP '{NOW}' AND (namespace <> 'view' OR starts_with(key, 'view:v1:'))),
q AS (SELECT *, row_number() OVER (PARTITION BY namespace ORDER BY expires_at DESC, key) AS rn FROM l)
SELECT namespace, key, expires_at FROM q WHERE rn <= CASE namespace WHEN 'click' THEN 40 WHEN 'error' THEN 20 ELSE 300 END ORDER BY expires_at DESC, key LIMIT 300"""
)
def snk4_load_with_quota(spark, sf):
    e = read(spark, sf, "events")
    expires = F.timestamp_micros(F.unix_micros("ts") + (F.col("user_id") % 20) * 86_400_000_000)
    kv = e.groupBy(F.col("event_type").alias("namespace"), F.concat(F.col("event_type"), F.lit(":v"), (F.col("user_id") % 3).cast("string"), F.lit(":"), F.col("user_id").cast("string")).alias("key")).agg(F.max(expires).alias("expires_at"))
    return K.load_with_quota(kv, NOW, 6 * 3600, {"view": "v1"}, {"click": 40, "error": 20}, 300)


@query("SELECT doc_id, trim(regexp_replace(lower(left(text, 80)), '[^a-z0-9]+', ' ', 'g')) AS norm, CAST(len(string_split(trim(regexp_replace(lower(left(text, 80)), '[^a-z0-9]+', ' ', 'g')), ' ')) AS BIGINT) AS n FROM documents WHERE lang = 'en' AND regexp_matches(left(text, 80), '^[ -~\\n]*$')")
def exp1_norm_title(spark, sf):
    """Normalised headings (the first 80 letters) of plain English documents."""
    head = F.substring("text", 1, 80)
    d = read(spark, sf, "documents").where("lang = 'en'").where(head.rlike(r"^[ -~\n]*$"))
    norm = T.norm_title(head)
    return d.select("doc_id", norm.alias("norm"), F.size(F.split(norm, " ")).cast("long").alias("n"))


@query("SELECT doc_id, norm, CAST(len(list_filter(string_split(norm, ' '), lambda t: t <> '')) AS BIGINT) AS n FROM (SELECT doc_id, trim(regexp_replace(strip_accents(lower(text)), '[^a-z0-9]+', ' ', 'g')) AS norm FROM documents)")
def exp1_norm_whole_text(spark, sf):
    """Whole texts of all documents, normalised."""
    norm = T.norm_title(F.col("text"))
    return read(spark, sf, "documents").select("doc_id", norm.alias("norm"), F.size(F.filter(F.split(norm, " "), lambda t: t != "")).cast("long").alias("n"))


@query("SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN CAST(round(p_size * 1073741824.0) AS BIGINT) ELSE CAST(round(p_size * 1.5 * 1048576.0) AS BIGINT) END AS bytes FROM part")
def exp16_parse_size(spark, sf):
    s = F.expr("CASE WHEN p_size % 2 = 0 THEN concat(p_size, ' GB') ELSE concat(replace(cast(p_size * 1.5 as string), '.', ','), ' MB') END")
    return read(spark, sf, "part").select(F.col("p_partkey").alias("id"), T.parse_size(s).alias("bytes"))


@query(
    """SELECT n_regionkey AS grp, coalesce(list(s_suppkey ORDER BY s_suppkey) FILTER (s_suppkey % 4 <> 0), []) AS grouped, coalesce(list(s_suppkey ORDER BY s_suppkey) FILTER (s_suppkey % 4 = 0), []) AS isolated FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1"""
)
def exp15_query_plan(spark, sf):
    """Sources searched together and those searched alone, per group; a group is one region's suppliers."""
    s = read(spark, sf, "supplier").join(read(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    alone = F.col("s_suppkey") % 4 == 0
    return s.groupBy(F.col("n_regionkey").alias("grp")).agg(F.sort_array(F.collect_list(F.when(~alone, F.col("s_suppkey")))).alias("grouped"), F.sort_array(F.collect_list(F.when(alone, F.col("s_suppkey")))).alias("isolated"))


_ROMANS = [*I.ROMAN, "", "V of"]


@query(
    f"""WITH q AS (SELECT p_partkey AS work_id, p_size, concat_ws(' ', CASE WHEN p_size % 10 = 9 THEN 'The' ELSE p_name END, nullif([{', '.join(f"'{r}'" for r in _ROMANS)}][p_size % 10 + 1], '')) AS name, 1980 + p_size AS year, p_partkey % 2 = 0 AS serial FROM part),
s AS (SELECT work_id, p_size, name || CASE WHEN serial THEN printf(' S%02dE%02d', p_size % 5 + 1, p_size % 10 + 1) ELSE ' ' || year END AS query, serial FROM q)
SELECT work_id, query, CASE WHEN p_size % 10 < 8 THEN regexp_replace(query, ' (VIII|VII|IV|III|IX|VI|II|V) ', ' ' || (p_size % 10 + 2) || ' ') END AS variant,
  trim(CASE WHEN p_size % 3 = 0 AND serial THEN regexp_replace(query, ' S[0-9]+E[0-9]+', '') WHEN p_size % 2 = 0 AND NOT serial THEN regexp_replace(query, ' [0-9]{{4}}$', '') ELSE query END) AS shaped FROM s"""
)
def exp14_search_queries(spark, sf):
    """What sources are asked for each work, whose names bear numerals of sequels by their size."""
    p = read(spark, sf, "part")
    end = F.nullif(F.element_at(F.array(*map(F.lit, _ROMANS)), (F.col("p_size") % 10 + 1).cast("int")), F.lit(""))
    name = F.concat_ws(" ", F.when(F.col("p_size") % 10 == 9, "The").otherwise(F.col("p_name")), end)
    serial = F.col("p_partkey") % 2 == 0
    query_ = I.search_query(name, F.col("p_size") + 1980, F.when(serial, F.col("p_size") % 5 + 1), F.when(serial, F.col("p_size") % 10 + 1))
    rows = p.select(F.col("p_partkey").alias("work_id"), query_.alias("query"), "p_size")
    return rows.select("work_id", "query", I.numeral_variant(F.col("query")).alias("variant"), I.shape_query(F.col("query"), F.col("p_size") % 3 == 0, F.col("p_size") % 2 == 0).alias("shaped"))


@query("SELECT namespace, count(*) AS n FROM (SELECT CASE WHEN user_id % 4 = 0 THEN '__default' ELSE event_type END AS namespace FROM events) GROUP BY namespace")
def exp22_namespaces(spark, sf):
    """Keys of events; those of a fourth of the users stand in no namespace."""
    key = F.when(F.col("user_id") % 4 == 0, F.col("user_id").cast("string")).otherwise(F.concat_ws(":", "event_type", F.lit("v1"), F.col("user_id").cast("string")))
    return read(spark, sf, "events").groupBy(I.namespace_of(key).alias("namespace")).agg(F.count("*").alias("n"))


@query(
    """WITH l AS (SELECT page_id, h, len(h) AS n FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS h FROM pages)),
a AS (SELECT *, CASE page_id % 4 WHEN 0 THEN substr(sha1(h[3]), 1, 10) WHEN 1 THEN 'gone' WHEN 2 THEN 'gone' END AS id, CASE page_id % 4 WHEN 1 THEN n WHEN 2 THEN n + 1 END AS counted FROM l)
SELECT page_id, coalesce(list_filter(h, lambda x: substr(sha1(x), 1, 10) = id)[1], CASE WHEN NOT coalesce(id IS NOT NULL AND counted <> n, false) THEN h[2] END) AS href FROM a"""
)
def exp23_pick_links(spark, sf):
    """The third link by its identity, a lost one by its place while the count is right, and the second by its place alone."""
    links = S.posts_to_links(read(spark, sf, "pages"))
    per = links.groupBy("page_id").agg(F.count("*").alias("n"), F.min_by("href", F.when(F.col("nth") == 3, F.col("nth"))).alias("third"))
    turn = F.col("page_id") % 4
    asked = per.select("page_id", F.when(turn == 0, I.link_identity(F.col("third"))).when(turn.isin(1, 2), "gone").alias("id"), F.lit(2).cast("long").alias("nth"), F.when(turn == 1, F.col("n")).when(turn == 2, F.col("n") + 1).alias("counted"))
    return S.pick_link(links, asked)
