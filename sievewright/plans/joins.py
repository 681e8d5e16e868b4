"""Queries of the join operators (JN) and set operators (SET)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import identity as I
from ..operators import joins as J
from ..sources.relations import EVIDENCE, LISTINGS, NOW, PROBES, SNAPSHOT, WORKS, evidence, listings, probes, read, snapshot, with_cte, works
from .registry import query

_NORM = "trim(regexp_replace(strip_accents(lower({})), '[^a-z0-9]+', ' ', 'g'))"
_PIVOT = """ev AS (SELECT hash, bool_or(kind = 'alive') AS alive, bool_or(kind = 'bad') AS bad, bool_or(kind = 'hit') AS hit, bool_or(kind = 'miss') AS miss, bool_or(kind = 'blocked') AS blocked FROM evidence GROUP BY hash)"""
_TEXTS = f"tl AS (SELECT doc_id, list_distinct(string_split({_NORM.format('left(text, 200)')}, ' ')) AS tt FROM documents), nm AS (SELECT DISTINCT item_id, list_distinct(string_split({_NORM.format('left(text, 60)')}, ' ')) AS nt FROM benchmark)"


def _words(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _lead(x: str) -> str:
    return f"coalesce(list_filter({x}, lambda t: len(t) > 2 AND t NOT IN {_words([*I.ARTICLES, *I.PACK_WORDS])} AND NOT regexp_matches(t, '{I.MARKER}'))[1], {x}[1])"


def _wanted(x: str) -> str:
    telling = f"list_filter({x}, lambda t: len(t) > 2 AND t NOT IN {_words(I.ARTICLES)})"
    return f"list_sort(list_distinct(CASE WHEN len({telling}) >= 2 THEN {telling} ELSE {x} END))"


def _telling(x: str) -> str:
    silent = _words(dict.fromkeys([*I.TECHNICAL, *I.SILENT, *I.PACK_WORDS, *I.STRONG_PACK_WORDS]))
    return f"list_filter({x}, lambda t: t NOT IN {silent} AND NOT regexp_matches(t, '{I.MARKER}') AND NOT regexp_matches(t, '^[0-9]+$'))"


def _marks(x: str) -> str:
    stop = f"list_min(list_transform({x}, lambda t, i: CASE WHEN regexp_matches(t, '{I.YEAR}') OR t IN {_words([*I.TECHNICAL, *I.PACK_WORDS])} THEN i END))"
    words = "MAP {" + ", ".join(f"'{w}': {n}" for w, n in I.NUMBER_WORDS.items()) + "}"
    number = f"CASE WHEN regexp_matches(t, '^[0-9]{{1,6}}$') THEN CAST(t AS INTEGER) ELSE {words}[t] END"
    return f"list_distinct(list_filter(list_transform({x}[1:coalesce({stop} - 1, len({x}))], lambda t: {number}), lambda n: n BETWEEN 2 AND 19))"


_PRECISION = "(CASE WHEN len(telling) = 0 THEN 1.0 ELSE len(list_filter(telling, lambda t: list_contains(universe, t))) / len(telling) END)"
#: Titles (title, is_br) and works (work_id, name, all_names, year, is_series, asks) paired by the rules of ``match_works``; titles with an episode's mark do not occur.
_MATCHED = f"""tf AS (SELECT *, {_lead('tt')} AS first, {_telling('tt')} AS telling, {_marks('tt')} AS marks, list_transform(list_filter(tt, lambda t: regexp_matches(t, '{I.YEAR}')), lambda t: CAST(t AS INTEGER)) AS years
  FROM (SELECT *, string_split({_NORM.format('title')}, ' ') AS tt FROM titles)),
wf AS (SELECT *, {_lead('nt')} AS lead, {_telling('ut')} AS universe, {_wanted('nt')} AS wanted, {_marks('nt')} AS own FROM (SELECT *, string_split({_NORM.format('name')}, ' ') AS nt, string_split({_NORM.format('all_names')}, ' ') AS ut FROM named)),
covered AS (SELECT bag, wanted, len(list_intersect(bag, wanted)) AS hits FROM (SELECT DISTINCT list_sort(list_distinct(tt)) AS bag FROM tf), (SELECT DISTINCT wanted FROM wf) WHERE len(list_intersect(bag, wanted)) >= ceil(0.6 * len(wanted) - 1e-9)),
kinds AS (SELECT DISTINCT wanted, lead, universe, is_series, asks FROM wf),
near AS (SELECT DISTINCT tf.tt, tf.is_br, kinds.*, hits FROM covered JOIN tf ON list_sort(list_distinct(tf.tt)) = covered.bag JOIN kinds ON kinds.wanted = covered.wanted
  WHERE CASE WHEN is_br THEN first = lead AND {_PRECISION} >= CASE WHEN is_series THEN 0.70 ELSE 0.65 END ELSE (is_series OR first = lead) AND (NOT asks OR {_PRECISION} >= 0.70) END),
met AS (SELECT DISTINCT tf.title, tf.is_br, wf.work_id, hits FROM tf JOIN near ON tf.tt = near.tt AND tf.is_br = near.is_br JOIN wf ON wf.wanted = near.wanted AND wf.lead = near.lead AND wf.universe = near.universe AND wf.is_series = near.is_series AND wf.asks = near.asks
  WHERE (wf.is_series OR len(list_filter(marks, lambda m: NOT list_contains(own, m))) = 0)
    AND NOT CASE WHEN wf.is_series THEN len(years) > 0 AND list_max(years) < year - 2 ELSE len(years) = 1 AND abs(years[1] - year) > 2 END)"""


@query(
    with_cte(LISTINGS, WORKS)
    + f""", counted AS (SELECT concat(title, ' ', 1980 + indexer % 8 * 5) AS title, is_br, count(*) AS n FROM listings GROUP BY ALL), titles AS (SELECT title, is_br FROM counted),
named AS (SELECT work_id, alias AS name, alias AS all_names, year, is_series, is_series AS asks FROM works), {_MATCHED}
SELECT work_id, count(*) AS titles, CAST(sum(n) AS BIGINT) AS n_listings, CAST(max(hits) AS BIGINT) AS hits FROM met JOIN counted USING (title, is_br) GROUP BY work_id"""
)
def jn1_match_works(spark, sf):
    """All listings, their titles with a year, against all works, counted per work; series ask for an episode."""
    title = F.concat_ws(" ", "title", (1980 + F.col("indexer") % 8 * 5).cast("string"))
    rows = listings(spark, sf).select(title.alias("title"), "is_br", F.lit(None).cast("string").alias("magnet"))
    return J.match_counts(rows, _named(spark, sf, "alias"))


@query(
    with_cte(LISTINGS, WORKS)
    + f""", counted AS (SELECT title, is_br, count(*) AS n FROM listings GROUP BY ALL), titles AS (SELECT title, is_br FROM counted),
named AS (SELECT work_id, unnest([name, alias]) AS name, concat(name, ' ', alias) AS all_names, year, is_series, is_series AS asks FROM works), {_MATCHED},
once AS (SELECT title, is_br, work_id, max(hits) AS hits FROM met GROUP BY ALL)
SELECT work_id, count(*) AS titles, CAST(sum(n) AS BIGINT) AS n_listings, CAST(max(hits) AS BIGINT) AS hits FROM once JOIN counted USING (title, is_br) GROUP BY work_id"""
)
def jn1_match_all_works(spark, sf):
    """All listings against all works by either of their names, which share the work's universe, counted per work."""
    rows = listings(spark, sf).select("title", "is_br", F.lit(None).cast("string").alias("magnet"))
    return J.match_counts(rows, _named(spark, sf, "name", "alias"))


def _named(spark, sf, *names):
    asked = lambda c: F.when(F.col("is_series"), F.col(c)).alias(c)
    return works(spark, sf).select("work_id", F.array(*names).alias("names"), "year", "is_series", asked("season"), asked("episode"))


@query(
    with_cte(LISTINGS, SNAPSHOT, WORKS)
    + f""", best AS (SELECT hash, min(title) AS title FROM listings GROUP BY hash), items AS (SELECT service_id AS lid, title, service_id % 5 = 0 AS multi_work FROM snapshot JOIN best USING (hash)),
titles AS (SELECT DISTINCT title, FALSE AS is_br FROM items), named AS (SELECT work_id, name, name AS all_names, year, is_series, is_series AS asks FROM works), {_MATCHED},
plain AS (SELECT lid, work_id FROM items JOIN met USING (title)),
root AS (SELECT DISTINCT lid, work_id FROM items JOIN works w ON NOT w.is_series AND contains(' ' || {_NORM.format('title')} || ' ', ' ' || {_NORM.format('w.name')} || ' ') WHERE multi_work AND lid NOT IN (SELECT lid FROM plain))
SELECT work_id, how, count(*) AS n FROM (SELECT lid, work_id, 'name' AS how FROM plain UNION ALL SELECT lid, work_id, 'root' FROM root) GROUP BY work_id, how"""
)
def jn2_match_inventory(spark, sf):
    """Accounts' rows, counted per title, against works by name and by franchise; names of two words are their own roots here."""
    items = snapshot(spark, sf).join(listings(spark, sf).groupBy("hash").agg(F.min("title").alias("title")), "hash")
    items = items.groupBy("title", (F.col("service_id") % 5 == 0).alias("multi_work")).agg(F.count("*").alias("rows")).withColumn("lid", F.xxhash64("title", "multi_work"))
    asked = items.select("lid", "title", "multi_work", "rows", F.lit(False).alias("is_br"), F.lit(None).cast("string").alias("magnet"))
    return J.inventory_counts(asked, _named(spark, sf, "name"))


_INDEX = "idx AS (SELECT lid, hash, seen_at, work_id, CASE WHEN indexer % 3 = 0 THEN NULL ELSE season END AS season, CASE WHEN indexer % 3 <= 1 THEN NULL ELSE episode END AS episode FROM listings)"
_REQ = "req AS (SELECT o_orderkey AS request_id, p_partkey AS work_id, CAST(p_size % 5 + 1 AS BIGINT) AS season, CAST(p_size % 10 + 1 AS BIGINT) AS episode FROM orders JOIN part ON o_custkey % 500 = p_partkey)"


def _index(spark, sf):
    return listings(spark, sf).select("lid", "hash", "seen_at", "work_id", F.when(F.col("indexer") % 3 != 0, F.col("season")).alias("season"), F.when(F.col("indexer") % 3 == 2, F.col("episode")).alias("episode"))


def _requests(spark, sf):
    o, w = read(spark, sf, "orders"), works(spark, sf)
    return o.select(F.col("o_orderkey").alias("request_id"), (F.col("o_custkey") % 500).alias("work_id")).join(w.select("work_id", "season", "episode"), "work_id")


_LOOKUP = """, m AS (SELECT r.request_id, i.hash, i.lid, i.seen_at FROM req r JOIN idx i ON r.work_id = i.work_id AND (i.season IS NULL OR i.season = r.season) AND (i.episode IS NULL OR i.episode = r.episode) WHERE NOT (i.season IS NULL AND i.episode IS NOT NULL))
SELECT request_id, hash, lid FROM (SELECT *, row_number() OVER (PARTITION BY request_id, hash ORDER BY seen_at DESC, lid) AS rn FROM m) WHERE rn = 1"""
_REQ_ALL = "span AS (SELECT min(work_id) AS low, max(work_id) - min(work_id) + 1 AS n FROM works), req AS (SELECT o_orderkey AS request_id, work_id, season, episode FROM orders CROSS JOIN span JOIN works ON work_id = o_orderkey % n + low)"


@query(with_cte(LISTINGS, _INDEX, _REQ) + _LOOKUP)
def jn3_index_lookup(spark, sf):
    return J.index_lookup(_requests(spark, sf), _index(spark, sf)).select("request_id", "hash", "lid")


@query(with_cte(LISTINGS, WORKS, _INDEX, _REQ_ALL) + _LOOKUP)
def jn3_index_lookup_all(spark, sf):
    """Every order asks for a work, dealt by its key over the whole range of the part table's keys."""
    o, w = read(spark, sf, "orders"), works(spark, sf)
    span = w.agg(F.min("work_id").alias("low"), (F.max("work_id") - F.min("work_id") + 1).alias("n"))
    asked = o.crossJoin(F.broadcast(span)).select(F.col("o_orderkey").alias("request_id"), (F.pmod("o_orderkey", "n") + F.col("low")).alias("work_id"))
    return J.index_lookup(asked.join(w.select("work_id", "season", "episode"), "work_id"), _index(spark, sf)).select("request_id", "hash", "lid")


@query(
    with_cte(LISTINGS)
    + """, pr AS (SELECT sha1(CAST(l_partkey AS VARCHAR)) AS hash, max(CASE WHEN l_quantity > 48 THEN '2160p' END) AS pq, max(CASE WHEN l_discount > 0.09 THEN 'Dual' END) AS pa, bool_or(l_tax > 0.07) AS scene FROM lineitem GROUP BY 1)
SELECT lid, coalesce(nullif(pq, ''), quality) AS quality, CASE WHEN pa IS NOT NULL THEN true WHEN coalesce(scene, false) THEN false ELSE dubbed END AS dubbed FROM listings LEFT JOIN pr USING (hash)"""
)
def jn4_apply_file_evidence(spark, sf):
    proof = read(spark, sf, "lineitem").groupBy(F.sha1(F.col("l_partkey").cast("string").cast("binary")).alias("hash")).agg(
        F.max(F.expr("CASE WHEN l_quantity > 48 THEN '2160p' END")).alias("proof_quality"), F.max(F.expr("CASE WHEN l_discount > 0.09 THEN 'Dual' END")).alias("proof_audio"), F.bool_or(F.col("l_tax") > 0.07).alias("scene")
    )
    return J.apply_file_evidence(listings(spark, sf), proof).select("lid", "quality", "dubbed")


@query(
    with_cte(LISTINGS, EVIDENCE, _PIVOT)
    + """, m AS (SELECT DISTINCT hash, CAST(floor(value) AS BIGINT) % 5 + 1 AS season, CAST(floor(value) AS BIGINT) % 10 + 1 AS episode, true AS lacks FROM evidence WHERE kind = 'miss')
SELECT request_id, CASE WHEN coalesce(bad, false) AND NOT coalesce(blocked, false) THEN 'bad' WHEN lied THEN 'lie' WHEN coalesce(lacks, false) THEN 'missing' WHEN coalesce(miss, false) AND NOT coalesce(hit, false) THEN 'dead' END AS reason, count(*) AS n, count(*) FILTER (coalesce(bad, false) AND coalesce(blocked, false)) AS repaired
FROM listings LEFT JOIN ev USING (hash) LEFT JOIN m USING (hash, season, episode) GROUP BY 1, 2"""
)
def jn5_prune_known_broken(spark, sf):
    """A miss also tells, by its value, which episode was looked for in vain."""
    e = evidence(spark, sf)
    part = lambda n: F.floor("value").cast("long") % n + 1
    missing = e.where("kind = 'miss'").select("hash", part(5).alias("season"), part(10).alias("episode"))
    return J.prune_known_broken(listings(spark, sf), e, missing).groupBy("request_id", "reason").agg(F.count("*").alias("n"), F.count_if("repaired").alias("repaired"))


@query(
    """WITH reads AS (SELECT event_id AS read_id, user_id AS key, ts + INTERVAL 3 HOUR AS read_ts FROM events WHERE event_type = 'view'),
e AS (SELECT event_id, user_id AS key, ts, 3600 * (1 + CAST(floor(value) AS BIGINT) % 7) AS ttl, CASE event_type WHEN 'click' THEN 'alive' WHEN 'error' THEN 'bad' WHEN 'view' THEN 'hit' WHEN 'signup' THEN 'blocked' ELSE 'miss' END AS kind FROM events),
m AS (SELECT read_id, read_ts, arg_max(e, (ts, event_id)) AS last FROM reads LEFT JOIN e ON reads.key = e.key AND e.ts <= read_ts GROUP BY read_id, read_ts),
a AS (SELECT read_id, last.kind AS kind, last.ttl AS ttl, epoch_us(read_ts) / 1000000.0 - epoch_us(last.ts) / 1000000.0 AS age FROM m)
SELECT read_id, CASE WHEN age IS NULL THEN 'absent' WHEN age < ttl THEN 'fresh' WHEN age < ttl + 3600 THEN 'stale' ELSE 'absent' END AS state, CASE WHEN age < ttl + 3600 THEN kind END AS kind FROM a"""
)
def jn6_evidence_as_of(spark, sf):
    e = evidence(spark, sf)
    reads = e.where("event_type = 'view'").select(F.col("event_id").alias("read_id"), F.col("user_id").alias("key"), (F.col("seen_at") + F.expr("INTERVAL 3 HOURS")).alias("read_ts"))
    return J.evidence_as_of(reads, e, 3600)


@query(with_cte(SNAPSHOT, LISTINGS) + "SELECT account, count(*) AS n, count(*) FILTER (w IS NULL) AS unresolved, CAST(coalesce(sum(w), 0) AS BIGINT) AS checksum FROM snapshot LEFT JOIN (SELECT hash, min(work_id) AS w FROM listings GROUP BY hash) USING (hash) GROUP BY account")
def jn7_reverse_hash_join(spark, sf):
    df = J.reverse_hash_join(snapshot(spark, sf), listings(spark, sf).select("hash", "work_id"))
    return df.groupBy("account").agg(F.count("*").alias("n"), F.count_if(F.col("work_id").isNull()).alias("unresolved"), F.coalesce(F.sum("work_id"), F.lit(0)).cast("long").alias("checksum"))


@query(with_cte(LISTINGS, EVIDENCE) + "SELECT lid, hash FROM listings WHERE hash NOT IN (SELECT hash FROM evidence)")
def jn8_fresh_only(spark, sf):
    return J.anti(listings(spark, sf).select("lid", "hash"), evidence(spark, sf), "hash").select("lid", "hash")


@query(with_cte(SNAPSHOT) + "SELECT service_id, account FROM snapshot WHERE service_id % 5 <> 0 AND service_id NOT IN (SELECT service_id FROM snapshot WHERE service_id % 7 <> 0)")
def jn9_missing_from_snapshot(spark, sf):
    s = snapshot(spark, sf)
    return J.anti(s.where("service_id % 5 <> 0"), s.where("service_id % 7 <> 0"), "service_id").select("service_id", "account")


@query(
    with_cte(PROBES)
    + f""", st AS (SELECT indexer, arg_max(CASE WHEN NOT ok THEN 'offline' WHEN ms > budget_ms THEN 'degraded' ELSE 'online' END, (ts, event_id)) AS state, max(ts) AS last_ts FROM probes GROUP BY indexer)
SELECT s_suppkey AS supplier, state FROM supplier LEFT JOIN st ON s_suppkey = indexer AND last_ts > TIMESTAMP '{NOW}' - INTERVAL 48 HOUR"""
)
def jn10_decorate_sources(spark, sf):
    state = F.when(~F.col("ok"), "offline").when(F.col("ms") > F.col("budget_ms"), "degraded").otherwise("online")
    status = probes(spark, sf).groupBy("indexer").agg(F.max_by(state, F.struct("ts", "event_id")).alias("state"), F.max("ts").alias("ts"))
    items = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("indexer"))
    return J.decorate_sources(items, status, NOW, 48 * 3600).select(F.col("indexer").alias("supplier"), "state")


@query("SELECT s_suppkey AS indexer, CAST(coalesce(list_position([7, 3, 11, 2], s_suppkey), 5) AS BIGINT) AS priority FROM supplier")
def jn11_rank_by_priority(spark, sf):
    return J.rank_by_priority(read(spark, sf, "supplier").select(F.col("s_suppkey").alias("indexer")), [7, 3, 11, 2])


@query(
    """WITH i AS (SELECT l_partkey AS work, count(*) AS n, bool_or(l_returnflag = 'R') AS priority FROM lineitem GROUP BY 1), s AS (SELECT user_id AS work, max(ts) AS seen FROM events GROUP BY 1)
SELECT p_partkey AS work, coalesce(n, 0) AS n, coalesce(priority, false) AS priority, seen FROM part LEFT JOIN i ON p_partkey = i.work LEFT JOIN s ON p_partkey = s.work"""
)
def jn12_cohort_coverage_join(spark, sf):
    i = read(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("work")).agg(F.count("*").alias("n"), F.bool_or(F.col("l_returnflag") == "R").alias("priority"))
    s = read(spark, sf, "events").groupBy(F.col("user_id").alias("work")).agg(F.max("ts").alias("seen"))
    return read(spark, sf, "part").select(F.col("p_partkey").alias("work")).join(i, "work", "left").join(s, "work", "left").select("work", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("priority", F.lit(False)).alias("priority"), "seen")


@query("SELECT p_partkey AS work, p_retailprice AS votes FROM part WHERE p_partkey NOT IN (SELECT user_id FROM events) ORDER BY p_retailprice DESC, p_partkey LIMIT 40")
def jn13_not_yet_indexed(spark, sf):
    known = read(spark, sf, "events").select(F.col("user_id").alias("work"))
    pop = read(spark, sf, "part").select(F.col("p_partkey").alias("work"), F.col("p_retailprice").alias("votes"))
    return J.anti(pop, known, "work").orderBy(F.col("votes").desc(), "work").limit(40)


@query(with_cte(EVIDENCE) + "SELECT DISTINCT hash FROM evidence WHERE kind = 'bad' AND hash IN (SELECT hash FROM evidence WHERE kind = 'blocked')")
def jn14_repair_bad_blocked(spark, sf):
    e = evidence(spark, sf)
    return J.semi(e.where("kind = 'bad'").select("hash").distinct(), e.where("kind = 'blocked'").select("hash"), "hash")


@query(
    with_cte(EVIDENCE)
    + """SELECT hash, CASE WHEN bool_or(kind = 'hit') THEN true WHEN bool_or(kind = 'miss' AND scope = 0) THEN false END AS verdict FROM evidence WHERE kind IN ('hit', 'miss') AND user_id % 2 = 0 AND user_id % 10 <> 0 GROUP BY hash"""
)
def jn15_fuse_verdicts(spark, sf):
    e = evidence(spark, sf)
    v = e.where("kind in ('hit', 'miss')").select("hash", (F.col("kind") == "hit").alias("verdict"), (F.col("scope") == 0).alias("authoritative"))
    return J.fuse_verdicts(v, e.where("user_id % 2 = 0"), e.where("user_id % 10 = 0"))


@query(with_cte(SNAPSHOT) + "SELECT account, service_id FROM snapshot WHERE service_id % 7 <> 0 AND service_id NOT IN (SELECT service_id FROM snapshot WHERE protected) AND account <> 9")
def jn16_provenance_snapshot(spark, sf):
    """Rows that were there before us: the snapshot without what we submitted; accounts without a snapshot give none."""
    s = snapshot(spark, sf)
    return J.anti(s.where("service_id % 7 <> 0 and account <> 9"), s.where("protected"), "service_id").select("account", "service_id")


@query(with_cte(LISTINGS, EVIDENCE) + "SELECT request_id, bool_or(hash IN (SELECT hash FROM evidence WHERE kind = 'hit') AND is_br AND dubbed) AS priority_cached, bool_or(hash IN (SELECT hash FROM evidence WHERE kind = 'hit')) AS any_cached FROM listings GROUP BY request_id")
def jn17_has_cached_priority(spark, sf):
    return J.gate(listings(spark, sf), evidence(spark, sf).where("kind = 'hit'"))


@query("SELECT n_nationkey AS key, 1 AS source, n_name AS name FROM nation UNION ALL SELECT r_regionkey, 2, r_name FROM region")
def set1_union_sources(spark, sf):
    a = read(spark, sf, "nation").select(F.col("n_nationkey").alias("key"), F.lit(1).alias("source"), F.col("n_name").alias("name"))
    b = read(spark, sf, "region").select(F.col("r_regionkey").alias("key"), F.lit(2).alias("source"), F.col("r_name").alias("name"))
    return a.unionByName(b, allowMissingColumns=True)


@query(with_cte(LISTINGS, EVIDENCE) + "SELECT DISTINCT hash FROM listings EXCEPT SELECT hash FROM evidence WHERE kind = 'hit'")
def set2_except_hashes(spark, sf):
    return listings(spark, sf).select("hash").subtract(evidence(spark, sf).where("kind = 'hit'").select("hash"))


@query(with_cte(LISTINGS, EVIDENCE) + "SELECT hash FROM listings INTERSECT SELECT hash FROM evidence WHERE kind = 'hit'")
def set3_intersect_requested(spark, sf):
    return listings(spark, sf).select("hash").intersect(evidence(spark, sf).where("kind = 'hit'").select("hash"))


@query(with_cte(LISTINGS, EVIDENCE) + "SELECT DISTINCT hash, hash IN (SELECT hash FROM evidence WHERE kind = 'blocked') AS blocked FROM listings")
def set4_partition_blocked(spark, sf):
    blocked = evidence(spark, sf).where("kind = 'blocked'").select("hash").distinct().withColumn("b", F.lit(True))
    return listings(spark, sf).select("hash").distinct().join(blocked, "hash", "left").select("hash", F.coalesce("b", F.lit(False)).alias("blocked"))


@query(with_cte(EVIDENCE, SNAPSHOT) + "SELECT hash FROM ((SELECT hash FROM evidence WHERE kind = 'alive') UNION (SELECT hash FROM snapshot WHERE ready) UNION (SELECT hash FROM evidence WHERE kind = 'hit')) WHERE hash NOT IN (SELECT hash FROM evidence WHERE kind = 'blocked' AND value > 90)")
def set5_union_instant(spark, sf):
    e = evidence(spark, sf)
    yes = e.where("kind in ('alive', 'hit')").select("hash").union(snapshot(spark, sf).where("ready").select("hash")).distinct()
    return J.anti(yes, e.where("kind = 'blocked' and value > 90"), "hash")
