"""State left by logs, each with its oracle."""

from pyspark.sql import functions as F

from rolecall.checks.registry import check
from rolecall.operators import state as S

BUCKETED = """b AS (SELECT host, id, fetched_at, CASE WHEN http_status BETWEEN 200 AND 299 THEN 'HTTP_2XX' WHEN http_status = 429 THEN 'HTTP_429'
    WHEN http_status = 403 THEN 'HTTP_403' WHEN http_status >= 500 THEN 'HTTP_5XX' WHEN http_status >= 400 THEN 'HTTP_4XX'
    WHEN error_bucket LIKE '%timeout%' THEN 'ERROR_TIMEOUT' ELSE 'ERROR' END AS bucket FROM $crawl_url_attempts)"""


def backoff_sql(start):
    return f"""
WITH {BUCKETED}, s AS (SELECT host, last(bucket ORDER BY id) AS bucket, last(fetched_at ORDER BY id) AS at_time,
   list(CASE WHEN bucket IN ('HTTP_429', 'HTTP_403') THEN 1 WHEN bucket IN ('HTTP_5XX', 'ERROR_TIMEOUT', 'ERROR') THEN 2 WHEN bucket = 'HTTP_2XX' THEN 3 ELSE 4 END ORDER BY id) AS codes
   FROM b GROUP BY host),
 f AS (SELECT s.*, list_reduce(codes, lambda st, c: CASE c WHEN 1 THEN least(st + 1, 6) WHEN 2 THEN least(st + 1, 4) WHEN 3 THEN 0 ELSE greatest(st - 1, 0) END, {start}) AS state FROM s)
SELECT host, state AS backoff_state, bucket AS last_status_bucket, at_time + to_milliseconds(CASE WHEN bucket IN ('HTTP_429', 'HTTP_403') THEN least(3600, 30 * power(2, state - 1)) * 1000
   WHEN bucket IN ('HTTP_5XX', 'ERROR_TIMEOUT') THEN least(600, 15 * power(2, state - 1)) * 1000 WHEN bucket IN ('HTTP_2XX', 'HTTP_4XX') THEN 1000 ELSE 20000 END) AS next_allowed_at FROM f"""


@check("frontier_backoff", backoff_sql("0"))
def _(m):
    return S.frontier_backoff(m.crawl_url_attempts)


@check("frontier_backoff_from_state", backoff_sql("CAST(length(s.host) % 7 AS INT)"))
def _(m):
    hosts = m.sql("SELECT host, CAST(length(host) % 7 AS INT) AS backoff_state FROM $crawl_url_attempts GROUP BY host")
    return S.frontier_backoff(m.crawl_url_attempts, hosts)


@check("host_cooldown", """
WITH c AS (SELECT host, id, fetched_at, error_bucket IS NULL AND http_status BETWEEN 200 AND 299 AS good,
    CASE WHEN error_bucket IS NOT NULL THEN CASE WHEN error_bucket LIKE '%timeout%' THEN 'TIMEOUT' END
         WHEN http_status = 429 THEN 'HTTP_429_RATE_LIMIT' WHEN http_status = 408 THEN 'TIMEOUT' END AS category FROM $crawl_url_attempts),
 r AS (SELECT *, max(CASE WHEN good THEN id END) OVER (PARTITION BY host) AS last_good FROM c WHERE good OR category IS NOT NULL),
 g AS (SELECT host, count(*) FILTER (WHERE NOT good AND (last_good IS NULL OR id > last_good)) AS n, last(category ORDER BY id) FILTER (WHERE category IS NOT NULL) AS category,
   max_by(fetched_at, id) AS at_time FROM r GROUP BY host)
SELECT host, CAST(n AS INT) AS consecutive_failures, category AS last_error_category, at_time AS last_attempt_at,
  CASE WHEN n > 0 THEN at_time + to_minutes(CASE least(n, 5) WHEN 1 THEN 5 WHEN 2 THEN 15 WHEN 3 THEN 60 WHEN 4 THEN 360 ELSE 1440 END) END AS next_allowed_at
FROM g WHERE category IS NOT NULL""")
def _(m):
    return S.host_cooldown(m.crawl_url_attempts)


OUTCOMES = """
SELECT event_id AS id, user_id AS company_id, CAST(ts AS TIMESTAMP) AS observed_at,
  CASE event_type WHEN 'purchase' THEN NULL WHEN 'view' THEN 'discovery_company_cooldown' WHEN 'signup' THEN 'discovery_homepage_blocked_by_robots'
    WHEN 'click' THEN 'discovery_host_cooldown' ELSE 'discovery_fetch_failed' END AS reason_code,
  concat('https://x.example.com/', CAST(event_id AS STRING)) AS candidate_url, CASE WHEN value < 20 THEN 'http_503' WHEN value < 40 THEN 'http_404' END AS detail FROM $events"""


@check("discovery_cooldown", f"""
WITH o AS ({OUTCOMES}), k AS (SELECT *, max(CASE WHEN reason_code IS NULL THEN id END) OVER (PARTITION BY company_id) AS good FROM o
    WHERE reason_code IS NULL OR reason_code <> 'discovery_company_cooldown'),
 g AS (SELECT company_id, count(*) FILTER (WHERE reason_code IS NOT NULL AND (good IS NULL OR id > good)) AS n, last(observed_at ORDER BY id) AS at_time,
   last(reason_code ORDER BY id) AS reason, last(candidate_url ORDER BY id) AS url, last(detail ORDER BY id) AS detail FROM k GROUP BY 1)
SELECT company_id, at_time AS last_attempt_at, reason AS last_reason_code, url AS last_candidate_url, CAST(n AS INT) AS consecutive_failures,
  CASE WHEN reason = 'discovery_homepage_blocked_by_robots' THEN at_time + to_days(14)
       WHEN reason = 'discovery_host_cooldown' OR (reason = 'discovery_fetch_failed' AND detail = 'http_503')
       THEN at_time + to_minutes(CASE least(n, 5) WHEN 1 THEN 5 WHEN 2 THEN 15 WHEN 3 THEN 60 WHEN 4 THEN 360 ELSE 1440 END) END AS next_attempt_at FROM g""")
def _(m):
    return S.discovery_cooldown(m.sql(OUTCOMES))


QUEUE = "SELECT company_id, last_success_at IS NOT NULL AS succeeded, consecutive_failures AS failures_so_far, updated_at AS finished_at FROM $crawl_queue"


@check("queue_schedule", f"""
SELECT *, finished_at + to_minutes(CASE WHEN succeeded THEN 60 ELSE CASE least(failures_so_far, 4) WHEN 0 THEN 5 WHEN 1 THEN 15 WHEN 2 THEN 60 WHEN 3 THEN 360 ELSE 1440 END END) AS next_run_at
FROM ({QUEUE}) q""")
def _(m):
    return S.queue_schedule(m.sql(QUEUE))


@check("primary_failure", """
SELECT company_id, ord, reason_code, candidate_url FROM (SELECT company_id, id AS ord, reason_code, candidate_url, row_number() OVER (PARTITION BY company_id ORDER BY
  CASE WHEN reason_code = 'discovery_time_budget_exceeded' THEN 0 WHEN reason_code = 'discovery_homepage_blocked_by_robots' THEN 1
    WHEN reason_code = 'discovery_host_cooldown' THEN 2 WHEN reason_code = 'discovery_fetch_failed' THEN 3 ELSE 4 END, id) AS rn FROM $careers_discovery_failures) x WHERE rn = 1""")
def _(m):
    rows = m.careers_discovery_failures.select("company_id", F.col("id").alias("ord"), "reason_code", "candidate_url")
    return S.primary_failure(rows)


LOG = """
SELECT CAST(year(fetched_at) * 10000 + month(fetched_at) * 100 + day(fetched_at) AS BIGINT) AS run_id, id, CASE WHEN id % 17 <> 0 THEN host END AS host, http_status, error_bucket
FROM $crawl_url_attempts"""


def breach_sql(total, per_host, rate, least, errors):
    return f"""
WITH a AS ({LOG}), w AS (SELECT *, row_number() OVER r AS made, sum(CASE WHEN http_status = 429 THEN 1 ELSE 0 END) OVER r AS n429,
    CASE WHEN host IS NULL THEN 0 ELSE row_number() OVER (PARTITION BY run_id, host ORDER BY id) END AS made_to_host,
    (error_bucket IS NOT NULL OR http_status = 429 OR http_status >= 500) AS bad FROM a WINDOW r AS (PARTITION BY run_id ORDER BY id)),
 s AS (SELECT *, made - coalesce(max(CASE WHEN NOT bad THEN made END) OVER (PARTITION BY run_id ORDER BY id), 0) AS streak FROM w),
 t AS (SELECT run_id, id, CASE WHEN made > {total} THEN 'total_request_budget_exceeded' WHEN made_to_host > {per_host} THEN 'per_host_request_budget_exceeded'
    WHEN streak >= {errors} THEN 'consecutive_error_threshold_exceeded' WHEN made >= {least} AND CAST(n429 AS DOUBLE) / made >= {rate} THEN 'rate_limit_threshold_exceeded' END AS reason FROM s)
SELECT run_id, min(id) AS attempt_id, min_by(reason, id) AS reason FROM t WHERE reason IS NOT NULL GROUP BY run_id"""


@check("budget_breach", breach_sql(250, 14, 0.09, 25, 3))
def _(m):
    return S.budget_breach(m.sql(LOG), ["run_id"], 250, 14, 0.09, 25, 3)


@check("budget_breach_whole_log", """
WITH a AS (SELECT id, row_number() OVER (ORDER BY id) AS made FROM $crawl_url_attempts)
SELECT 0 AS run_id, min(id) AS attempt_id, 'total_request_budget_exceeded' AS reason FROM a WHERE made > 600""")
def _(m):
    return S.budget_breach(m.crawl_url_attempts.withColumn("run_id", F.lit(0)), ["run_id"], 600, 0, 0, 25, 0)


@check("request_budget_cut", """
SELECT id, CAST(sum(request_count) OVER w AS BIGINT) AS requests_so_far, sum(request_count) OVER w - request_count < 120 AS processed
FROM $careers_discovery_company_results WINDOW w AS (PARTITION BY discovery_run_id ORDER BY id)""")
def _(m):
    return S.request_budget_cut(m.careers_discovery_company_results, ["discovery_run_id"], "id", 120).select(
        "id", "requests_so_far", "processed")


@check("request_budget_summary", """
SELECT discovery_run_id, count(*) AS processed_count, CAST(max(c) AS BIGINT) AS request_count_total,
  CASE WHEN max(c) >= 120 THEN 'request_budget_exceeded' END AS stop_reason
FROM (SELECT discovery_run_id, request_count, sum(request_count) OVER (PARTITION BY discovery_run_id ORDER BY id) AS c FROM $careers_discovery_company_results) x
WHERE c - request_count < 120 GROUP BY 1""")
def _(m):
    return S.request_budget_summary(m.careers_discovery_company_results, ["discovery_run_id"], "id", 120)
