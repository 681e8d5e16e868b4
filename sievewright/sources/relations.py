"""The engine's relations as projections of the given tables, each with the same projection in SQL.

Numbers that say "now" are parameters: ``NOW`` is a fixed point after the last event.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = "2024-01-31 00:00:00"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; times without a zone are times of the session's zone."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumns({c: F.col(c).cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"})


def whole(c: Column | str) -> Column:
    return F.floor(c).cast("long")


QUALITY = {"LARGE": "2160p", "MEDIUM": "1080p", "STANDARD": "720p", "SMALL": "480p", "ECONOMY": "SD"}


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D1 and D2: one row per published listing, with its classification."""
    li, part = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "part")
    quality = F.lit("unknown")
    for word, q in QUALITY.items():
        quality = F.when(F.col("p_type").startswith(word), q).otherwise(quality)
    lid = F.concat_ws("|", *[c.cast("string") for c in (F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"), whole("l_quantity"), whole(F.col("l_extendedprice") * 100))], "l_returnflag", "l_linestatus", F.date_format("l_shipdate", "yyyyMMdd"))
    return li.join(part, li.l_partkey == part.p_partkey).select(
        lid.alias("lid"),
        (F.col("l_orderkey") % 97).alias("request_id"),
        F.sha1(F.col("l_partkey").cast("string").cast("binary")).alias("hash"),
        F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("title"),
        whole("l_quantity").alias("seeders"),
        whole(F.col("l_extendedprice") * 1000).alias("size"),
        F.col("l_suppkey").alias("indexer"),
        (F.col("l_returnflag") == "R").alias("is_br"),
        (F.col("l_linestatus") == "O").alias("dubbed"),
        quality.alias("quality"),
        F.col("l_shipdate").alias("seen_at"),
        (F.col("l_linenumber") % 7 == 0).alias("lied"),
        (F.col("l_linenumber") % 5 == 0).alias("multi_work"),
        F.col("l_partkey").alias("work_id"),
        (F.col("p_size") % 5 + 1).cast("long").alias("season"),
        (F.col("p_size") % 10 + 1).cast("long").alias("episode"),
        (F.col("p_partkey") % 2 == 0).alias("is_series"),
        F.col("p_name").alias("name"),
    )


LISTINGS = """listings AS (SELECT concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(floor(l_quantity) AS BIGINT), CAST(floor(l_extendedprice * 100) AS BIGINT), l_returnflag, l_linestatus, strftime(l_shipdate, '%Y%m%d')) AS lid,
  l_orderkey % 97 AS request_id, sha1(CAST(l_partkey AS VARCHAR)) AS hash, concat_ws(' ', p_name, p_type, p_brand) AS title,
  CAST(floor(l_quantity) AS BIGINT) AS seeders, CAST(floor(l_extendedprice * 1000) AS BIGINT) AS size, l_suppkey AS indexer,
  l_returnflag = 'R' AS is_br, l_linestatus = 'O' AS dubbed,
  CASE WHEN p_type LIKE 'LARGE%' THEN '2160p' WHEN p_type LIKE 'MEDIUM%' THEN '1080p' WHEN p_type LIKE 'STANDARD%' THEN '720p' WHEN p_type LIKE 'SMALL%' THEN '480p' WHEN p_type LIKE 'ECONOMY%' THEN 'SD' ELSE 'unknown' END AS quality,
  l_shipdate AS seen_at, l_linenumber % 7 = 0 AS lied, l_linenumber % 5 = 0 AS multi_work, l_partkey AS work_id,
  CAST(p_size % 5 + 1 AS BIGINT) AS season, CAST(p_size % 10 + 1 AS BIGINT) AS episode, p_partkey % 2 = 0 AS is_series, p_name AS name
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


#: What titles of these sources end in, by the source's number modulo 8, and what they say.
_MARKS = {0: "CAMRip", 1: "LEGENDADO", 2: "FRENCH", 3: "DUBLADO", 4: "da Cidade de Ouro"}


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings whose titles declare what they hold: season and episode, a season's pack or (a fifth of the sources) nothing, and marks of recording, audio and language."""
    code = F.when(F.col("indexer") % 5 == 0, "").when(F.col("multi_work"), F.concat(F.col("season").cast("string"), F.lit("ª Temporada Completa"))).otherwise(F.format_string("S%02dE%02d", "season", "episode"))
    mark = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in _MARKS.items() for x in kv]), (F.col("indexer") % 8).cast("int")), F.lit(""))
    return listings(spark, sf_dir).withColumn("title", F.concat_ws(" ", "name", code, mark))


MARKED = """marked AS (SELECT * REPLACE (concat_ws(' ', name, CASE WHEN indexer % 5 = 0 THEN '' WHEN multi_work THEN season || 'ª Temporada Completa' ELSE printf('S%02dE%02d', season, episode) END,
  CASE indexer % 8 WHEN 0 THEN 'CAMRip' WHEN 1 THEN 'LEGENDADO' WHEN 2 THEN 'FRENCH' WHEN 3 THEN 'DUBLADO' WHEN 4 THEN 'da Cidade de Ouro' ELSE '' END) AS title),
  indexer % 8 = 0 AS cam, indexer % 8 = 1 AS sub, indexer % 8 = 2 AS alien, (indexer % 8 IN (3, 4) OR (indexer % 5 <> 0 AND multi_work)) AS sign, indexer % 5 <> 0 AND NOT multi_work AS coded, indexer % 5 <> 0 AND multi_work AS packed FROM listings)"""


def works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D3."""
    return read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("work_id"), F.col("p_name").alias("name"), F.concat_ws(" ", "p_name", "p_brand").alias("alias"), (F.lit(1980) + F.col("p_size")).cast("long").alias("year"),
        (F.col("p_partkey") % 2 == 0).alias("is_series"), (F.col("p_size") % 5 + 1).cast("long").alias("season"), (F.col("p_size") % 10 + 1).cast("long").alias("episode"), F.col("p_type").alias("kind"),
    )


def work_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hash that all listings of a work bear. What is known of hashes meets the works first, and so far fewer rows than the listings, which lie by work already."""
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("work_id"), F.sha1(F.col("p_partkey").cast("string").cast("binary")).alias("hash")).distinct()


WORKS = """works AS (SELECT p_partkey AS work_id, p_name AS name, concat_ws(' ', p_name, p_brand) AS alias, CAST(1980 + p_size AS BIGINT) AS year, p_partkey % 2 = 0 AS is_series,
  CAST(p_size % 5 + 1 AS BIGINT) AS season, CAST(p_size % 10 + 1 AS BIGINT) AS episode, p_type AS kind FROM part)"""


def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D5 and D6: rows of accounts; also the catalogue with derived flags."""
    o = read(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("service_id"),
        (F.col("o_custkey") % 10).alias("account"),
        F.sha1(F.col("o_custkey").cast("string").cast("binary")).alias("hash"),
        F.col("o_orderpriority").alias("filename"),
        whole("o_totalprice").alias("size"),
        F.expr("CASE o_orderstatus WHEN 'F' THEN 'Ready' WHEN 'O' THEN 'Downloading' ELSE 'Error' END").alias("status"),
        (F.col("o_orderstatus") == "F").alias("ready"),
        F.col("o_orderdate").alias("uploaded_at"),
        F.expr("CASE o_orderkey % 4 WHEN 0 THEN 'dub' WHEN 1 THEN 'dual' WHEN 2 THEN 'pt' ELSE 'none' END").alias("bucket"),
        F.expr("CASE o_orderkey % 3 WHEN 0 THEN true WHEN 1 THEN false END").alias("cached"),
        (F.col("o_orderkey") % 11 == 0).alias("protected"),
        (F.col("o_orderkey") % 13 == 0).alias("known"),
    )


SNAPSHOT = """snapshot AS (SELECT o_orderkey AS service_id, o_custkey % 10 AS account, sha1(CAST(o_custkey AS VARCHAR)) AS hash, o_orderpriority AS filename, CAST(floor(o_totalprice) AS BIGINT) AS size,
  CASE o_orderstatus WHEN 'F' THEN 'Ready' WHEN 'O' THEN 'Downloading' ELSE 'Error' END AS status, o_orderstatus = 'F' AS ready, o_orderdate AS uploaded_at,
  CASE o_orderkey % 4 WHEN 0 THEN 'dub' WHEN 1 THEN 'dual' WHEN 2 THEN 'pt' ELSE 'none' END AS bucket, CASE o_orderkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS cached,
  o_orderkey % 11 = 0 AS protected, o_orderkey % 13 = 0 AS known FROM orders)"""


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D7: evidence events with their time to live. The hash is that of a listing, so evidence meets listings."""
    return read(spark, sf_dir, "events").select(
        F.col("event_id"),
        (F.col("user_id") % 3).alias("scope"),
        F.sha1(F.col("user_id").cast("string").cast("binary")).alias("hash"),
        F.expr("CASE event_type WHEN 'click' THEN 'alive' WHEN 'error' THEN 'bad' WHEN 'view' THEN 'hit' WHEN 'signup' THEN 'blocked' ELSE 'miss' END").alias("kind"),
        F.col("ts").alias("seen_at"),
        (F.lit(3600) * (1 + whole("value") % 7)).cast("long").alias("ttl_s"),
        F.col("user_id"),
        F.col("event_type"),
        F.col("value"),
    )


EVIDENCE = """evidence AS (SELECT event_id, user_id % 3 AS scope, sha1(CAST(user_id AS VARCHAR)) AS hash,
  CASE event_type WHEN 'click' THEN 'alive' WHEN 'error' THEN 'bad' WHEN 'view' THEN 'hit' WHEN 'signup' THEN 'blocked' ELSE 'miss' END AS kind,
  ts AS seen_at, CAST(3600 * (1 + CAST(floor(value) AS BIGINT) % 7) AS BIGINT) AS ttl_s, user_id, event_type, value FROM events)"""


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D9."""
    return read(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 20).alias("indexer"), (F.col("event_type") != "error").alias("ok"), whole("value").alias("ms"), "ts", F.lit(250).cast("long").alias("budget_ms"))


PROBES = "probes AS (SELECT event_id, user_id % 20 AS indexer, event_type <> 'error' AS ok, CAST(floor(value) AS BIGINT) AS ms, ts, CAST(250 AS BIGINT) AS budget_ms FROM events)"


def with_cte(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def spaced(source: str, key: str, us: int) -> str:
    """SQL, for a recursive query, of the first row of a key and then the first at least ``us`` microseconds after the last one kept."""
    return f"""k AS (SELECT {key} AS key, min(t) AS t, arg_min(event_id, (t, event_id)) AS event_id FROM {source} GROUP BY 1
  UNION ALL SELECT k.key, min(e.t), arg_min(e.event_id, (e.t, e.event_id)) FROM k JOIN {source} e ON e.{key} = k.key AND e.t >= k.t + {us} GROUP BY k.key)"""
