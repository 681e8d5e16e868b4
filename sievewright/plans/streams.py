"""Queries of the stream operators' batch forms (STR)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.relations import EVIDENCE, LISTINGS, NOW, PROBES, evidence, listings, probes, read, spaced, with_cte
from ..streaming import state as S
from .registry import query


def _events(spark, sf):
    return read(spark, sf, "events")


@query(
    with_cte(EVIDENCE)
    + ", k AS (SELECT scope, hash, "
    + ", ".join(f"max(seen_at) FILTER (kind = '{k}') AS {k}_at, arg_max(epoch_us(seen_at) + ttl_s * 1000000, (seen_at, event_id)) FILTER (kind = '{k}') AS {k}_until" for k in ("alive", "bad", "hit", "miss", "blocked"))
    + f""" FROM evidence GROUP BY scope, hash), n AS (SELECT *, epoch_us(TIMESTAMP '{NOW}') AS t FROM k)
SELECT scope, hash, coalesce(alive_until > t, false) AND NOT coalesce(bad_at >= alive_at, false) AS alive, coalesce(bad_until > t, false) AS bad,
  CASE WHEN coalesce(blocked_until > t, false) THEN 'blocked' WHEN coalesce(hit_until > t, false) AND NOT coalesce(miss_at > hit_at, false) THEN 'hit' WHEN coalesce(miss_until > t, false) THEN 'miss' END AS state FROM n"""
)
def str1_evidence_state(spark, sf):
    return S.evidence_state(evidence(spark, sf), NOW)


@query(
    "WITH RECURSIVE " + EVIDENCE
    + """, e AS (SELECT hash, kind = 'hit' AS hit, epoch_us(seen_at) AS t, row_number() OVER (PARTITION BY hash ORDER BY seen_at, event_id) AS nth FROM evidence WHERE kind IN ('hit', 'miss')),
f AS (SELECT DISTINCT hash, CAST(0 AS BIGINT) AS nth, CAST(0 AS BIGINT) AS misses, CAST(0 AS BIGINT) AS until FROM e
  UNION ALL SELECT hash, nth, misses, CASE WHEN misses = 0 THEN 0 ELSE t + CAST(1000000 AS BIGINT) * [600, 3600, 21600, 86400][least(misses, 4)] END
  FROM (SELECT e.hash, e.nth, e.t, CASE WHEN hit THEN 0 WHEN e.t >= until THEN 1 ELSE misses + 1 END AS misses FROM f JOIN e ON e.hash = f.hash AND e.nth = f.nth + 1))
SELECT hash, arg_max(misses, nth) AS misses, make_timestamp(nullif(arg_max(until, nth), 0)) AS until FROM f GROUP BY hash"""
)
def str2_miss_backoff(spark, sf):
    return S.miss_backoff_fold(evidence(spark, sf))


@query(
    with_cte(PROBES)
    + f""", d AS (SELECT *, CASE WHEN NOT ok THEN 'offline' WHEN ms > budget_ms THEN 'degraded' WHEN ms * 2 > budget_ms THEN 'slow' ELSE 'online' END AS state,
  CAST(ok OR coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY indexer ORDER BY ts, event_id)) > 21600000000, true) AS INT) AS brk FROM probes),
i AS (SELECT *, sum(brk) OVER (PARTITION BY indexer ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM d),
r AS (SELECT indexer, island, count(*) FILTER (NOT ok) AS fails, arg_max(state, (ts, event_id)) AS state, max(ts) AS ts FROM i GROUP BY 1, 2),
f AS (SELECT indexer, arg_max(fails, island) AS fails, arg_max(state, island) AS state, arg_max(ts, island) AS ts FROM r GROUP BY 1)
SELECT indexer, state, CAST(CASE WHEN state = 'offline' THEN fails ELSE 0 END AS BIGINT) AS streak, state = 'offline' AND fails >= 2 AND epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts) < 86400000000 AS is_open FROM f"""
)
def str3_source_health(spark, sf):
    return S.source_health(probes(spark, sf), NOW, 6 * 3600, 2, 24 * 3600)


@query(f"WITH RECURSIVE ev AS (SELECT *, epoch_us(ts) AS t FROM events), {spaced('ev', 'user_id', 43200000000)} SELECT key AS user_id, event_id FROM k")
def str4_dedupe_within(spark, sf):
    return S.dedupe_within_fold(_events(spark, sf), "user_id", 12 * 3600)


@query(
    f"""WITH RECURSIVE al AS (SELECT 'offline:' || (user_id % 20) AS kind, epoch_us(ts) AS t, event_id, props FROM events WHERE event_type = 'error' AND user_id % 20 < 5
  UNION ALL SELECT 'occupancy', epoch_us(ts), event_id, props FROM events WHERE event_type = 'signup' AND value >= 60), {spaced('al', 'kind', 21600000000)}
SELECT event_id, key AS kind, coalesce('{{' || (SELECT string_agg(to_json(x) || ':' || to_json(json_extract_string(e.props, x)), ',' ORDER BY i) FROM (SELECT unnest(json_keys(e.props)) AS x, generate_subscripts(json_keys(e.props), 1) AS i)
  WHERE NOT regexp_matches(lower(x), 'key|token|secret|password')) || '}}', '{{}}') AS fields FROM k JOIN events e USING (event_id)"""
)
def str5_alert_cooldown(spark, sf):
    """Sources of priority that are offline, and accounts filled to the limit."""
    e = _events(spark, sf)
    offline = S.offline_alerts(probes(spark, sf).join(e.select("event_id", "props"), "event_id"), tuple(range(5)))
    full = S.occupancy_alerts(e.where("event_type = 'signup'").select("event_id", "ts", F.col("value").alias("used"), "props"), 60)
    return S.alert_cooldown(offline.unionByName(full), 6 * 3600)


@query("SELECT date_trunc('hour', ts) AS hour, count(*) AS used, count(*) > 15 AS is_over FROM events GROUP BY 1")
def str6_budget_tumbling(spark, sf):
    return S.budget_tumbling(_events(spark, sf), 15)


@query(
    """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth FROM events),
f AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS nth, CAST(NULL AS BIGINT) AS event_id, false AS admitted, CAST(NULL AS BIGINT) AS last, CAST(NULL AS BIGINT) AS before FROM e
  UNION ALL SELECT user_id, nth, event_id, ok, CASE WHEN ok THEN t ELSE last END, CASE WHEN ok THEN last ELSE before END
  FROM (SELECT e.*, last, before, coalesce(before <= e.t - 21600000000, true) AS ok FROM f JOIN e ON e.user_id = f.user_id AND e.nth = f.nth + 1))
SELECT user_id, event_id FROM f WHERE admitted"""
)
def str7_sliding_admission(spark, sf):
    return S.admission_fold(_events(spark, sf), "user_id", 2, 6 * 3600)


@query("SELECT user_id, time_bucket(INTERVAL 5 MINUTE, ts) - to_minutes(5 * k) AS started, count(*) AS n FROM events, generate_series(0, 11) g(k) GROUP BY 1, 2")
def str8_sliding_rate(spark, sf):
    return S.sliding_rate(_events(spark, sf))


@query(
    """WITH b AS (SELECT *, CAST(coalesce(ts >= lag(ts) OVER w + INTERVAL 6 HOUR, true) AS INT) AS brk FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
i AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM b), g AS (SELECT user_id, s, min(ts) AS started, max(ts) + INTERVAL 6 HOUR AS ended, count(*) AS n FROM i GROUP BY 1, 2)
SELECT user_id, started, ended, n, CAST(floor(epoch(lead(started) OVER (PARTITION BY user_id ORDER BY started))) - floor(epoch(ended)) AS BIGINT) AS idle_s FROM g"""
)
def str9_idle_sessions(spark, sf):
    return S.idle_sessions(_events(spark, sf), "6 hours")


@query(
    """WITH a AS (SELECT event_id, user_id * 100 + CAST(floor(value) AS BIGINT) % 10 AS request, event_type = 'purchase' AND value > 20 AS priority, event_type IN ('purchase', 'signup') AS tp, value > 60 AS stops, ts FROM events),
b AS (SELECT *, epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY request)) AS us FROM a),
c AS (SELECT *, max(us) OVER r AS fin, min(us) FILTER (stops) OVER r AS halt, least(max(us) OVER r, min(us) FILTER (stops) OVER r, 259200000000) AS cut FROM b WINDOW r AS (PARTITION BY request)),
d AS (SELECT *, cut < fin AND coalesce(halt > cut, true) AND NOT coalesce(bool_or(priority) FILTER (us <= cut) OVER r, false) AND coalesce(max(us) FILTER (tp) OVER r > cut, false) AS more,
  min(us) FILTER (priority AND us > cut) OVER r AS wanted, max(us) FILTER (tp) OVER r AS lastp FROM c WINDOW r AS (PARTITION BY request)),
e AS (SELECT *, CASE WHEN more THEN least(fin, halt, wanted, lastp, 864000000000) ELSE cut END AS until FROM d)
SELECT event_id, request, priority, CASE WHEN until = halt THEN 'stopped' WHEN until = fin THEN 'done' WHEN more AND until = wanted THEN 'priority' WHEN more AND until = lastp THEN 'priority done' WHEN more THEN 'grace' ELSE 'budget' END AS why FROM e WHERE us <= until"""
)
def str10_collect_within_budget(spark, sf):
    """Three days, and seven of grace."""
    e = _events(spark, sf)
    request = F.col("user_id") * 100 + F.floor("value").cast("long") % 10
    a = e.select("event_id", request.alias("request"), ((F.col("event_type") == "purchase") & (F.col("value") > 20)).alias("priority"), F.col("event_type").isin("purchase", "signup").alias("task_priority"), (F.col("value") > 60).alias("stops"), F.col("ts").alias("arrived_at"), F.lit(1).alias("n"))
    return S.collect_within_budget(a, 3 * 86400, 7 * 86400).select("event_id", "request", "priority", "why")


@query(
    """WITH RECURSIVE u AS (SELECT user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS nth, CAST(floor(value) AS BIGINT) % 3 AS p, event_id % 5 AS r, event_type <> 'error' AS good, value AS v FROM events),
f AS (SELECT DISTINCT key, CAST(0 AS BIGINT) AS nth, CAST(-1 AS BIGINT) AS phase, CAST(-1 AS BIGINT) AS revision, CAST(-1 AS BIGINT) AS useful_phase, CAST(NULL AS DOUBLE) AS value, CAST(0 AS BIGINT) AS commits FROM u
  UNION ALL SELECT key, nth, CASE WHEN newer OR rescue THEN greatest(phase, p) ELSE phase END, CASE WHEN newer THEN r ELSE revision END, CASE WHEN (newer OR rescue) AND good THEN greatest(useful_phase, p) ELSE useful_phase END,
    CASE WHEN newer OR rescue THEN v ELSE value END, commits + CAST(newer OR rescue AS INT)
  FROM (SELECT u.*, phase, revision, useful_phase, value, commits, p > phase OR (p = phase AND r >= revision) AS newer, p < phase AND good AND useful_phase < p AS rescue FROM f JOIN u ON u.key = f.key AND u.nth = f.nth + 1))
SELECT key, phase, revision, useful_phase, value, commits FROM f QUALIFY row_number() OVER (PARTITION BY key ORDER BY nth DESC) = 1"""
)
def str11_latest_writer(spark, sf):
    e = _events(spark, sf)
    u = e.select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), (F.floor("value").cast("long") % 3).alias("phase"), (F.col("event_id") % 5).alias("revision"), (F.col("event_type") != "error").alias("useful"), "value")
    return S.latest_writer_fold(u)


@query(
    """WITH r AS (SELECT event_id, user_id AS request, ts, CAST(floor(value) AS BIGINT) % 30 AS n, event_type = 'error' AS partial FROM events),
g AS (SELECT *, coalesce(n > max(n) OVER (PARTITION BY request ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS grew FROM r)
SELECT event_id, CAST(CASE WHEN partial OR n IS NULL THEN 60 ELSE 3600 END AS BIGINT) AS ttl_s, CASE WHEN grew THEN 'emit' WHEN NOT partial THEN 'promote' ELSE 'keep' END AS action FROM g"""
)
def str12_partial_to_complete(spark, sf):
    r = _events(spark, sf).select("event_id", F.col("user_id").alias("request"), "ts", (F.floor("value").cast("long") % 30).alias("n"), (F.col("event_type") == "error").alias("partial"))
    return S.partial_to_complete(r, 60, 3600).select("event_id", "ttl_s", "action")


@query(
    f"""SELECT event_id, CASE WHEN left_us > 0 THEN 'fresh' WHEN left_us > -86400000000 AND event_type <> 'error' THEN 'stale' ELSE 'expired' END AS state FROM
  (SELECT event_id, event_type, epoch_us(ts + to_hours(CAST(user_id % 60 AS INTEGER))) - epoch_us(TIMESTAMP '{NOW}') AS left_us FROM events)"""
)
def str13_staleness(spark, sf):
    kv = _events(spark, sf).select("event_id", F.timestamp_micros(F.unix_micros("ts") + (F.col("user_id") % 60) * 3_600_000_000).alias("expires_at"), (F.col("event_type") != "error").alias("complete"))
    return S.staleness(kv, NOW, 86400).select("event_id", "state")


@query(
    """WITH o AS (SELECT event_id, ts, user_id AS item, CASE event_type WHEN 'purchase' THEN CASE WHEN value > 90 THEN 'ready' ELSE 'still' END WHEN 'error' THEN 'dead' WHEN 'view' THEN 'still' ELSE 'moving' END AS seen FROM events),
i AS (SELECT *, count(*) FILTER (seen = 'moving') OVER w AS since, epoch_us(ts) - epoch_us(first_value(ts) OVER w) AS age FROM o WINDOW w AS (PARTITION BY item ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
r AS (SELECT *, count(*) FILTER (seen = 'dead') OVER w AS dr, count(*) FILTER (seen = 'still') OVER w AS sr FROM i WINDOW w AS (PARTITION BY item, since ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
x AS (SELECT *, CASE WHEN seen = 'ready' THEN 'ready' WHEN seen = 'dead' AND dr >= 2 THEN 'dead' WHEN seen = 'still' AND sr >= 5 THEN 'stalled' WHEN age >= 1728000000000 THEN 'expired' END AS outcome FROM r)
SELECT item, coalesce(arg_min(outcome, (ts, event_id)) FILTER (outcome IS NOT NULL), 'pending') AS outcome, count(*) AS n FROM x GROUP BY item"""
)
def str14_recheck_outcome(spark, sf):
    seen = F.expr("CASE event_type WHEN 'purchase' THEN CASE WHEN value > 90 THEN 'ready' ELSE 'still' END WHEN 'error' THEN 'dead' WHEN 'view' THEN 'still' ELSE 'moving' END")
    return S.recheck_outcome(_events(spark, sf).select("event_id", "ts", F.col("user_id").alias("item"), seen.alias("seen")), 2, 5, 20 * 86400)


@query(
    """SELECT user_id AS work_id, ts, CASE event_type WHEN 'error' THEN 'gap' WHEN 'view' THEN 'next-episode' ELSE 'miss' END AS reason FROM events WHERE event_type = 'view' OR user_id NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)"""
)
def str15_queue_feed(spark, sf):
    return S.queue_feed(_events(spark, sf), read(spark, sf, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("work_id")))


@query(
    """WITH d AS (SELECT date_trunc('day', ts) AS taken, count(*) FILTER (event_type = 'view') AS h, count(*) FILTER (event_type IN ('view', 'purchase')) AS decided FROM events GROUP BY 1),
s AS (SELECT CAST(taken AS TIMESTAMP) AS taken, round(CAST(h AS DOUBLE) / decided, 6) AS share, decided FROM d WHERE decided > 0),
r AS (SELECT *, coalesce(epoch_us(taken) - epoch_us(lag(taken) OVER (ORDER BY taken)) > 86400000000, true) AS reset FROM s),
c AS (SELECT *, sum(CAST(reset AS INT)) OVER (ORDER BY taken ROWS UNBOUNDED PRECEDING) AS cohort FROM r),
b AS (SELECT *, first_value(share) OVER (PARTITION BY cohort ORDER BY taken) AS baseline FROM c)
SELECT taken, share, decided, reset, baseline, round(share - baseline, 6) AS gain FROM b"""
)
def str16_coverage_over_time(spark, sf):
    return S.coverage_over_time(_events(spark, sf), 86400)


@query(
    """WITH a AS (SELECT event_id, ts, user_id AS work, CASE event_type WHEN 'view' THEN 'ok' WHEN 'click' THEN 'capped' ELSE 'failed' END AS result FROM events),
f AS (SELECT *, sum(CAST(result = 'failed' AS INT)) OVER (PARTITION BY work ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS fails FROM a)
SELECT event_id, CAST(fails AS BIGINT) AS fails, CASE WHEN result = 'ok' THEN 'done' WHEN result = 'capped' THEN 'front' WHEN fails >= 3 THEN 'dropped' ELSE 'back' END AS "to" FROM f"""
)
def str17_retry_requeue(spark, sf):
    a = _events(spark, sf).select("event_id", "ts", F.col("user_id").alias("work"), F.expr("CASE event_type WHEN 'view' THEN 'ok' WHEN 'click' THEN 'capped' ELSE 'failed' END").alias("result"))
    return S.retry_requeue(a, 3).select("event_id", "fails", "to")
