"""Queries of the aggregation operators (AGG)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..sources.relations import EVIDENCE, LISTINGS, MARKED, NOW, SNAPSHOT, evidence, listings, marked, read, snapshot, with_cte
from .registry import query


@query(
    with_cte(LISTINGS)
    + """SELECT hash, arg_min(lid, ord) AS lid, CAST(max(seeders) AS BIGINT) AS seeders,
  coalesce(arg_min(quality, ord) FILTER (quality <> 'unknown'), 'unknown') AS quality, CAST(coalesce(arg_min(size, ord) FILTER (size > 0), 0) AS BIGINT) AS size, bool_or(multi_work) AS multi_work, bool_or(lied) AS lied, count(*) AS n
FROM (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY seeders DESC, dubbed DESC, CASE indexer WHEN 5 THEN 1 WHEN 3 THEN 2 WHEN 8 THEN 3 ELSE 4 END, lid) AS ord FROM listings) GROUP BY hash"""
)
def agg1_dedupe_by_hash(spark, sf):
    return A.dedupe_by_hash(listings(spark, sf), (5, 3, 8))


@query(
    with_cte(SNAPSHOT)
    + """SELECT bucket, cached, CASE WHEN grouping(bucket) = 0 THEN 'bucket' WHEN grouping(cached) = 0 THEN 'cached' ELSE 'all' END AS level, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes, count(*) FILTER (ready) AS ready, count(*) FILTER (known) AS known
FROM snapshot GROUP BY GROUPING SETS ((), (bucket), (cached))"""
)
def agg2_catalog_report(spark, sf):
    return A.catalog_report(snapshot(spark, sf))


@query(
    with_cte(EVIDENCE)
    + f"""SELECT scope, kind, count(*) AS live, CAST(ceil(avg(left_s)) AS BIGINT) AS mean_left FROM
  (SELECT scope, kind, ttl_s - epoch(TIMESTAMP '{NOW}' - seen_at) AS left_s FROM evidence) WHERE left_s > 0 GROUP BY ROLLUP (scope, kind)"""
)
def agg3_evidence_status(spark, sf):
    return A.evidence_status(evidence(spark, sf), NOW)


@query(
    """WITH w AS (SELECT p_type AS kind, p_partkey AS work, count(l_orderkey) AS rows, bool_or(l_returnflag = 'R') AS hit, bool_and(l_returnflag = 'N') AS miss FROM part LEFT JOIN lineitem ON p_partkey = l_partkey GROUP BY 1, 2),
s AS (SELECT kind, CASE WHEN rows > 0 AND hit THEN 'hit' WHEN rows > 0 AND miss THEN 'miss' ELSE 'unknown' END AS state FROM w)
SELECT kind, count(*) AS works, count(*) FILTER (state = 'hit') AS hits, count(*) FILTER (state = 'miss') AS misses, count(*) FILTER (state = 'unknown') AS unknown,
  round(CASE WHEN count(*) FILTER (state <> 'unknown') = 0 THEN 0.0 ELSE CAST(count(*) FILTER (state = 'hit') AS DOUBLE) / count(*) FILTER (state <> 'unknown') END, 6) AS hit_ratio FROM s GROUP BY ROLLUP (kind)"""
)
def agg4_coverage_sample(spark, sf):
    cohort = read(spark, sf, "part").select(F.col("p_partkey").alias("work"), F.col("p_type").alias("kind"))
    index = read(spark, sf, "lineitem").select(F.col("l_partkey").alias("work"), F.expr("CASE l_returnflag WHEN 'R' THEN true WHEN 'N' THEN false END").alias("found"))
    return A.coverage_sample(cohort, index)


@query(
    with_cte(SNAPSHOT)
    + """SELECT account, count(*) AS total, count(*) FILTER (ready) AS ready, count(*) FILTER (status = 'Downloading') AS active, count(*) FILTER (status = 'Error') AS error, min(uploaded_at) AS oldest, count(*) >= 90 AS is_full, count(*) FILTER (status = 'Downloading') >= 40 AS is_busy FROM snapshot GROUP BY account"""
)
def agg5_account_occupancy(spark, sf):
    return A.account_occupancy(snapshot(spark, sf), full=90, busy=40)


@query(with_cte(SNAPSHOT) + "SELECT bucket, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes, count(*) FILTER (uploaded_at > TIMESTAMP '2000-01-01 00:00:00') AS recent FROM snapshot GROUP BY bucket")
def agg6_bucket_inventory(spark, sf):
    recent = F.col("uploaded_at") > F.lit("2000-01-01 00:00:00").cast("timestamp")
    return snapshot(spark, sf).groupBy("bucket").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.count_if(recent).alias("recent"))


@query(
    """SELECT event_type AS namespace, count(DISTINCT user_id) AS entries, CASE event_type WHEN 'click' THEN 100 WHEN 'view' THEN 200 ELSE 50 END AS quota,
  round(CASE WHEN count(*) = 0 THEN NULL ELSE CAST(count(*) FILTER (value > 50) AS DOUBLE) / count(*) END, 6) AS hit_rate FROM events GROUP BY 1"""
)
def agg7_cache_snapshot(spark, sf):
    quota = F.expr("CASE namespace WHEN 'click' THEN 100 WHEN 'view' THEN 200 ELSE 50 END")
    per = read(spark, sf, "events").groupBy(F.col("event_type").alias("namespace")).agg(F.countDistinct("user_id").alias("entries"), F.round(F.count_if(F.col("value") > 50) / F.nullif(F.count("*"), F.lit(0)), 6).alias("hit_rate"))
    return per.withColumn("quota", quota)


@query("SELECT event_type AS name, count(*) AS n, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS total, arg_max(value, (ts, event_id)) AS last_value FROM events GROUP BY 1")
def agg8_metric_counters(spark, sf):
    return read(spark, sf, "events").groupBy(F.col("event_type").alias("name")).agg(F.count("*").alias("n"), F.sum(F.floor("value").cast("long")).alias("total"), F.max_by("value", F.struct("ts", "event_id")).alias("last_value"))


@query(
    """WITH r AS (SELECT event_type AS name, value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events),
k AS (SELECT name, list(value ORDER BY value) AS v FROM r WHERE rn <= 256 GROUP BY name)
SELECT name, n, round(mean, 6) AS mean, top, round(v[least(len(v), CAST(floor(0.5 * len(v)) AS BIGINT) + 1)], 3) AS p50, round(v[least(len(v), CAST(floor(0.95 * len(v)) AS BIGINT) + 1)], 3) AS p95
FROM k JOIN (SELECT event_type AS name, count(*) AS n, avg(value) AS mean, max(value) AS top FROM events GROUP BY 1) USING (name)"""
)
def agg9_timer_stats(spark, sf):
    e = read(spark, sf, "events")
    return A.timer_stats(e.select(F.col("event_type").alias("name"), "value", F.struct("ts", "event_id").alias("at")), 256)


@query(
    """SELECT l_suppkey AS indexer, count(*) AS n_rows, CAST(sum(l_linenumber) AS BIGINT) AS ms FROM lineitem GROUP BY 1 HAVING count(*) FILTER (l_quantity > 45 AND l_discount > 0.05 AND l_returnflag = 'R') = 0"""
)
def agg10_wasted_queries(spark, sf):
    good = (F.col("l_quantity") > 45) & (F.col("l_discount") > 0.05) & (F.col("l_returnflag") == "R")
    per = read(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("indexer")).agg(F.count("*").alias("n_rows"), F.sum("l_linenumber").alias("ms"), F.count_if(good).alias("survivors"))
    return per.where("survivors = 0").drop("survivors")


@query(
    with_cte(LISTINGS, MARKED)
    + """, g AS (SELECT work_id, bool_or(is_series) AS asks, bool_or(coded AND season = work_id % 5 + 1 AND episode = work_id % 10 + 1) AS named, bool_or(is_br AND NOT cam AND dubbed) AS own_dubbed, bool_or(is_br AND NOT cam AND NOT sub) AS own_open,
  bool_or(dubbed AND NOT cam) AS dub, bool_or(seeders >= 10 AND NOT cam AND NOT alien) AS healthy FROM marked GROUP BY work_id)
SELECT work_id, CASE WHEN asks AND NOT named THEN 'none' WHEN own_dubbed OR own_open THEN 'priority' WHEN dub THEN 'dubbed' WHEN healthy THEN 'healthy' ELSE 'none' END AS cover, asks AND named AS names_episode FROM g"""
)
def agg11_pool_coverage(spark, sf):
    """A request for each work; those for series ask for the episode that the work's number stands for."""
    asked = lambda n: F.when(F.col("is_series"), F.col("work_id") % n + 1)
    return A.pool_coverage(marked(spark, sf).withColumns({"ask_season": asked(5), "ask_episode": asked(10)}), 10, "work_id")


@query(
    """WITH f AS (SELECT l_partkey AS hash, l_linenumber AS pos, l_extendedprice AS size, l_shipdate, l_suppkey, CASE WHEN l_returnflag = 'R' THEN 'Dual' WHEN l_returnflag = 'A' THEN 'Dublado' ELSE '' END AS audio,
  CASE WHEN l_quantity > 30 THEN '1080p' WHEN l_quantity > 15 THEN '720p' ELSE '' END AS quality, l_discount > 0.08 AS scene FROM lineitem WHERE l_tax < 0.06),
g AS (SELECT hash, arg_min(audio, (pos, l_suppkey, l_shipdate, audio)) FILTER (audio <> '') AS audio, arg_max(quality, (size, l_suppkey, l_shipdate, quality)) AS quality, bool_or(scene) AS scene FROM f GROUP BY hash)
SELECT hash, audio, quality, scene FROM g WHERE audio IS NOT NULL OR quality <> '' OR scene"""
)
def agg12_file_evidence(spark, sf):
    li = read(spark, sf, "lineitem").where("l_tax < 0.06")
    files = li.select(
        F.col("l_partkey").alias("hash"), F.col("l_linenumber").alias("pos"), F.col("l_extendedprice").alias("size"), F.expr("CASE l_returnflag WHEN 'R' THEN 'Dual' WHEN 'A' THEN 'Dublado' ELSE '' END").alias("audio"),
        F.expr("CASE WHEN l_quantity > 30 THEN '1080p' WHEN l_quantity > 15 THEN '720p' ELSE '' END").alias("quality"), (F.col("l_discount") > 0.08).alias("scene"), F.struct("l_suppkey", "l_shipdate").alias("tie"),
    )
    return A.file_evidence(files)


_FILES = "files AS (SELECT l_partkey AS hash, l_returnflag = 'R' AS mark, l_discount > 0.08 AS contrary, l_linestatus = 'O' AS promised FROM lineitem)"


def _files(spark, sf):
    return read(spark, sf, "lineitem").select(F.col("l_partkey").alias("hash"), (F.col("l_returnflag") == "R").alias("mark"), (F.col("l_discount") > 0.08).alias("contrary"), (F.col("l_linestatus") == "O").alias("promised"))


@query(with_cte(_FILES) + "SELECT hash, bool_or(promised) AND count(*) > 0 AND NOT bool_or(mark) AND bool_or(contrary) AS lie FROM files GROUP BY hash")
def agg13_lie_verdict(spark, sf):
    return _files(spark, sf).groupBy("hash").agg((F.bool_or("promised") & (F.count("*") > 0) & ~F.bool_or("mark") & F.bool_or("contrary")).alias("lie"))


@query(
    with_cte(LISTINGS, MARKED, _FILES)
    + """, n AS (SELECT work_id AS hash, arg_max(sign, lid) AS sign, arg_max(alien, lid) AS alien FROM marked GROUP BY work_id), p AS (SELECT hash, mark AS sign, contrary AS proof FROM files UNION ALL SELECT hash, sign, alien FROM n)
SELECT hash, CASE WHEN bool_or(sign) THEN 'absolved' WHEN bool_or(proof) THEN 'foreign' ELSE 'unknown' END AS verdict FROM p GROUP BY hash"""
)
def agg14_foreign_verdict(spark, sf):
    """A hash's name is the title of its last listing; what its files show is known already."""
    names = marked(spark, sf).groupBy(F.col("work_id").alias("hash")).agg(F.max_by("title", "lid").alias("text"))
    files = _files(spark, sf).select("hash", F.lit(None).cast("string").alias("text"), F.col("mark").alias("sign"), F.col("contrary").alias("proof"))
    return A.foreign_verdict(files.unionByName(names, allowMissingColumns=True))


@query(
    """SELECT o_custkey AS request, count(*) AS batches, count(*) FILTER (o_orderstatus = 'P') AS failed, count(*) FILTER (o_orderstatus = 'P') = 0 AS is_complete,
  CASE WHEN count(*) FILTER (o_orderstatus = 'P') = count(*) AND count(DISTINCT o_orderpriority) = 1 THEN min(o_orderpriority) END AS error_class, count(DISTINCT o_orderkey % 25) FILTER (o_orderstatus <> 'P') AS n_results FROM orders GROUP BY 1"""
)
def agg15_batch_completeness(spark, sf):
    return A.batch_completeness(read(spark, sf, "orders").select(F.col("o_custkey").alias("request"), (F.col("o_orderstatus") == "P").alias("failed"), F.col("o_orderpriority").alias("error"), (F.col("o_orderkey") % 25).alias("result")))


@query(with_cte(LISTINGS) + "SELECT hash, CAST(max(CASE WHEN is_br AND dubbed THEN 80 WHEN dubbed THEN 40 ELSE 5 END) AS BIGINT) AS score FROM listings GROUP BY hash ORDER BY score DESC, hash LIMIT 10")
def agg16_max_score_per_hash(spark, sf):
    score = F.when(F.col("is_br") & F.col("dubbed"), 80).when(F.col("dubbed"), 40).otherwise(5).cast("long")
    return listings(spark, sf).groupBy("hash").agg(F.max(score).alias("score")).orderBy(F.col("score").desc(), "hash").limit(10)


@query(
    """WITH f AS (SELECT user_id AS request, date_trunc('day', ts) AS pass, count(*) AS found, count(*) FILTER (event_type <> 'error') AS cached, count(*) FILTER (event_type = 'signup') AS hidden, count(*) FILTER (event_type IN ('view', 'click')) AS visible FROM events GROUP BY 1, 2)
SELECT request, CAST(pass AS TIMESTAMP) AS pass, found, cached, hidden, visible, CAST(greatest(0, visible - coalesce(max(visible) OVER (PARTITION BY request ORDER BY pass ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS BIGINT) AS late FROM f"""
)
def agg17_delivery_funnel(spark, sf):
    return A.delivery_funnel(read(spark, sf, "events"))


@query(
    """SELECT sha256(CAST(user_id AS VARCHAR)) AS scope, count(*) AS depth, count(DISTINCT event_type) AS items, CAST(least(count(*), 60) AS BIGINT) AS used, CAST(60 AS BIGINT) AS most, max(ts) AS last_at FROM events GROUP BY user_id"""
)
def agg18_queue_status(spark, sf):
    per = read(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("depth"), F.countDistinct("event_type").alias("items"), F.max("ts").alias("last_at"))
    return per.select(F.sha2(F.col("user_id").cast("string"), 256).alias("scope"), "depth", "items", F.least("depth", F.lit(60)).cast("long").alias("used"), F.lit(60).cast("long").alias("most"), "last_at")


@query(
    """WITH t AS (SELECT user_id AS request, event_type = 'purchase' AS priority, date_trunc('day', ts) AS invocation, ts AS started, CAST(floor(value * 1000) AS BIGINT) AS ms FROM events),
u AS (SELECT *, epoch_us(started) // 1000 + ms AS settled FROM t),
i AS (SELECT request, priority, invocation, max(least(settled, epoch_us(CAST(date_trunc('day', started) AS TIMESTAMP)) // 1000 + 72000000)) - min(epoch_us(started) // 1000) AS ms FROM u GROUP BY 1, 2, 3)
SELECT request, priority, CAST(sum(greatest(ms, 0)) AS BIGINT) AS ms FROM i GROUP BY 1, 2"""
)
def agg19_stage_envelopes(spark, sf):
    return A.stage_envelopes(read(spark, sf, "events"))


@query(
    with_cte(LISTINGS, EVIDENCE)
    + """, b AS (SELECT hash, bool_or(kind = 'bad') AS bad, bool_or(kind = 'hit') AS hit FROM evidence GROUP BY hash),
r AS (SELECT request_id, count(*) AS n, count(*) FILTER (lied) AS downloading, count(*) FILTER (coalesce(bad, false)) AS bad, count(*) FILTER (coalesce(hit, false)) AS hits, bool_or(is_series) AS series FROM listings LEFT JOIN b USING (hash) GROUP BY 1)
SELECT request_id, CASE WHEN hits > 0 THEN 'shown' WHEN downloading > 60 THEN 'downloading' WHEN bad = n THEN 'all bad' WHEN hits = 0 AND bad > 0 THEN 'outside cache' WHEN series THEN 'searching' ELSE 'none' END AS reason FROM r"""
)
def agg20_explain_empty(spark, sf):
    return A.explain_empty(listings(spark, sf), evidence(spark, sf))
