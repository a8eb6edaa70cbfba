"""Registered streaming queries: batch twins with SQL oracles, and availableNow stream runs."""

from __future__ import annotations

from ..streaming import ops as ST
from .oracle import r6, sql
from .registry import query
from .tables import F


def events(spark, d):
    return spark.read.parquet(f"{d}/events.parquet")


_ENDPOINTS = sql(f"""
SELECT time_bucket(INTERVAL '5 minutes', ts) AS window_start, time_bucket(INTERVAL '5 minutes', ts) + INTERVAL '5 minutes' AS window_end,
  event_type AS endpoint, count(*) AS "count", {r6('sum(value)')} AS total_time, {r6('avg(value)')} AS avg_time,
  min(value) AS min_time, max(value) AS max_time, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS errors,
  {r6("sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) / count(*)")} AS error_rate
FROM events GROUP BY time_bucket(INTERVAL '5 minutes', ts), event_type""", "joblog")


@query("str2_endpoint_metrics", _ENDPOINTS)
def str2(spark, d):
    return ST.endpoint_metrics(events(spark, d))


@query("str2_metrics_summary", sql(f"""
SELECT count(*) AS total_requests, {r6('avg(value)')} AS avg_time,
  CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS total_errors,
  {r6("sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) / count(*)")} AS error_rate FROM events""", "joblog"))
def str2_summary(spark, d):
    return ST.metrics_summary(events(spark, d))


@query("str2_endpoint_metrics_stream", _ENDPOINTS)
def str2_stream(spark, d):
    """All windows come from the stream's stored partial sums."""
    return ST.endpoint_metrics_of(ST.run_stored(ST.event_stream(spark, d), "endpoint_metrics", ST.endpoint_rollup()))


# The limit is the reference's requests-per-minute setting scaled to the fixture's traffic
# (a handful of requests per client per minute), so that rejections actually occur.
RATE_LIMIT = 2


@query("str1_rate_limit_all_attempts", sql(f"""
SELECT event_id, ts, user_id AS client_id, prior_requests, prior_requests < {RATE_LIMIT} AS allowed,
  CASE WHEN prior_requests >= {RATE_LIMIT} THEN greatest(60.0 - datesub('microsecond', oldest, ts) / 1e6, 1.0) ELSE 0.0 END AS retry_after
FROM (SELECT e.event_id, e.ts, e.user_id,
  (SELECT count(*) FROM events p WHERE p.user_id = e.user_id AND p.ts < e.ts AND p.ts > e.ts - INTERVAL 60 SECOND) AS prior_requests,
  (SELECT min(p.ts) FROM events p WHERE p.user_id = e.user_id AND p.ts < e.ts AND p.ts > e.ts - INTERVAL 60 SECOND) AS oldest
  FROM events e)""", "joblog"))
def str1_all(spark, d):
    return ST.rate_limit_all(events(spark, d), RATE_LIMIT)


# The greedy choice by recursion: each client's requests in order, (a1, a2) the last accepted ones (RATE_LIMIT of them).
_ACCEPTED = f"""WITH RECURSIVE seq AS (SELECT event_id, ts, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events),
walk AS (SELECT event_id, ts, user_id, p, true AS allowed, 0.0::DOUBLE AS retry_after, NULL::TIMESTAMP AS a1, ts AS a2 FROM seq WHERE p = 1
  UNION ALL SELECT event_id, ts, user_id, p, NOT coalesce(full_, false),
    CASE WHEN full_ THEN greatest(60.0 - datesub('microsecond', a1, ts) / 1e6, 1.0) ELSE 0.0 END,
    CASE WHEN full_ THEN a1 ELSE a2 END, CASE WHEN full_ THEN a2 ELSE ts END
  FROM (SELECT n.event_id, n.ts, n.user_id, n.p, w.a1, w.a2, w.a1 >= n.ts - INTERVAL 60 SECOND AS full_
        FROM walk w JOIN seq n ON n.user_id IS NOT DISTINCT FROM w.user_id AND n.p = w.p + 1))
SELECT event_id, ts, user_id AS client_id, allowed, {r6('retry_after')} AS retry_after FROM walk"""


@query("str1_rate_limit_accepted", _ACCEPTED)
def str1_accepted_batch(spark, d):
    return ST.rate_limit_accepted_batch(events(spark, d), RATE_LIMIT)


@query("str1_rate_limit_accepted_stream", _ACCEPTED)
def str1_accepted(spark, d):
    return ST.run_available(ST.rate_limit_accepted(ST.event_stream(spark, d), RATE_LIMIT), "rate_limit_accepted")


_PERIODS = f"""WITH RECURSIVE e AS (SELECT *, epoch_us(ts) AS us FROM events),
after AS (SELECT DISTINCT event_type, us, min(us) OVER (PARTITION BY event_type ORDER BY us RANGE BETWEEN 300000001 FOLLOWING AND UNBOUNDED FOLLOWING) AS next FROM e),
resets AS (SELECT event_type, min(us) AS us FROM e GROUP BY event_type
  UNION ALL SELECT r.event_type, a.next FROM resets r JOIN after a ON a.event_type = r.event_type AND a.us = r.us WHERE a.next IS NOT NULL),
spans AS (SELECT *, lead(us, 1, 9000000000000000000) OVER (PARTITION BY event_type ORDER BY us) AS until FROM resets),
p AS (SELECT r.event_type AS endpoint, r.us AS reset_us, max(e.us) AS last_us, count(*) AS n, sum(value) AS total_time, avg(value) AS avg_time, min(value) AS lo, max(value) AS hi,
    count(*) FILTER (WHERE e.event_type = 'error') AS errors
  FROM e JOIN spans r ON r.event_type = e.event_type AND e.us >= r.us AND e.us < r.until GROUP BY r.event_type, r.us)
SELECT endpoint, reset_us, last_us, n AS "count", {r6('total_time')} AS total_time, {r6('avg_time')} AS avg_time, min(lo) OVER w AS min_time, max(hi) OVER w AS max_time, errors,
  {r6('errors / n')} AS error_rate
FROM p WINDOW w AS (PARTITION BY endpoint ORDER BY reset_us ROWS UNBOUNDED PRECEDING)"""


@query("str2_endpoint_periods", _PERIODS)
def str2_periods(spark, d):
    return ST.endpoint_periods(events(spark, d))


@query("str2_endpoint_periods_stream", _PERIODS)
def str2_periods_stream(spark, d):
    return ST.endpoint_periods_stream(ST.event_stream(spark, d))


_DAILY = sql(f"""
SELECT CAST(CAST(StartTime AS DATE) AS TIMESTAMP) AS day, count(*) AS jobs, {r6('avg(efficiency)')} AS avg_efficiency,
  sum(total_downtime) AS total_downtime FROM F GROUP BY CAST(StartTime AS DATE)""")


@query("str3_daily_rollup_stream", _DAILY)
def str3(spark, d):
    base = F(spark, d)  # the stored derived table, replayed as a file stream
    path = None
    for p in base.inputFiles()[:1]:
        path = p.rsplit("/", 1)[0]
    stream = ST.joblog_stream(spark, path, base.schema)
    return ST.daily_rollup_of(ST.run_stored(stream, "daily_rollup", ST.daily_partials()))


@query("str3_daily_rollup", _DAILY)
def str3_batch(spark, d):
    return ST.daily_rollup(F(spark, d))

