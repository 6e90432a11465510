"""The crawl model as views over the given tables.

Each view is one SELECT in the SQL that Spark and DuckDB share, so a query and
its oracle read the same rows. ``$name`` stands for a given table or another
view. Nulls, blanks and ties are put in on purpose by CASE; no row is dropped
but by what a row is (an expensive order is a domain record, an urgent one an
endpoint record, an error event a failure record).
"""

import re
import zlib

from pyspark.sql import DataFrame, SparkSession

BASE = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
                "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}

VIEWS = {}

VIEWS["companies"] = """
SELECT c_custkey AS id,
       concat('T', lpad(CAST(c_custkey AS STRING), 9, '0')) AS ticker,
       CASE WHEN c_custkey % 11 = 3 THEN concat(c_name, ' Trust')
            WHEN c_custkey % 13 = 5 THEN concat(c_name, ' (ETF)')
            WHEN c_custkey % 17 = 2 THEN concat(c_name, ' Acquisition-Corp')
            WHEN c_custkey % 19 = 4 THEN concat(c_name, ' & Sons Holdings, Inc.')
            ELSE c_name END AS name,
       c_mktsegment AS sector,
       CASE WHEN c_custkey % 3 = 0 THEN NULL
            ELSE concat('Customer_', CAST(c_custkey AS STRING), '_Group') END AS wikipedia_title,
       CASE WHEN c_custkey % 7 = 0 THEN NULL
            ELSE lpad(CAST(c_custkey AS STRING), 10, '0') END AS cik,
       CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'WIKIPEDIA_TITLE' WHEN 2 THEN 'CIK'
            ELSE 'HEURISTIC' END AS domain_resolution_method,
       CASE c_custkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'NO_ITEM' WHEN 2 THEN 'no_p856'
            WHEN 3 THEN 'INVALID_WEBSITE_URL' WHEN 4 THEN 'WDQS_TIMEOUT'
            ELSE 'NO_IDENTIFIER' END AS domain_resolution_status,
       CASE c_custkey % 6 WHEN 0 THEN NULL WHEN 4 THEN 'wdqs_timeout' ELSE 'no_item' END
            AS domain_resolution_error,
       CASE WHEN c_custkey % 5 = 0 THEN NULL
            ELSE TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' HOUR * CAST(c_custkey % 720 AS INT)
            END AS domain_resolution_attempted_at
FROM $customer"""

VIEWS["company_domains"] = """
SELECT o_orderkey AS id, o_custkey AS company_id,
       CASE o_orderstatus
            WHEN 'P' THEN concat('WWW.Shared', CAST(o_custkey % 40 AS STRING), '.Example.org/', CAST(o_orderkey AS STRING))
            ELSE concat('d', CAST(o_orderkey AS STRING), '.example.com') END AS domain,
       CASE WHEN o_orderstatus = 'O' THEN concat('https://d', CAST(o_orderkey AS STRING), '.example.com/careers/')
            END AS careers_hint_url,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'MANUAL' WHEN '2-HIGH' THEN 'WIKIDATA'
            WHEN '3-MEDIUM' THEN 'WIKIPEDIA' ELSE 'HEURISTIC' END AS source,
       CASE o_orderpriority WHEN '1-URGENT' THEN 1.0e0 WHEN '2-HIGH' THEN 0.95e0
            WHEN '3-MEDIUM' THEN 0.95e0 ELSE 0.7e0 END AS confidence,
       CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(o_orderdate AS TIMESTAMP) END AS resolved_at,
       CASE o_orderpriority WHEN '1-URGENT' THEN NULL WHEN '2-HIGH' THEN 'WIKIPEDIA_TITLE'
            WHEN '3-MEDIUM' THEN 'INFOBOX' WHEN '5-LOW' THEN 'HEURISTIC_IO'
            ELSE 'HEURISTIC_COM' END AS resolution_method,
       CASE WHEN o_orderpriority = '2-HIGH' THEN concat('Q', CAST(o_orderkey AS STRING)) END AS wikidata_qid
FROM $orders
WHERE o_custkey IN (SELECT c_custkey FROM $customer WHERE c_mktsegment <> 'MACHINERY')"""

VIEWS["ats_endpoints"] = """
SELECT o_orderkey AS id, o_custkey AS company_id,
       CASE o_orderkey % 7 WHEN 0 THEN 'WORKDAY' WHEN 1 THEN 'GREENHOUSE' WHEN 2 THEN 'LEVER'
            WHEN 3 THEN 'SMARTRECRUITERS' WHEN 4 THEN 'ICIMS' WHEN 5 THEN 'TALEO'
            ELSE 'SUCCESSFACTORS' END AS ats_type,
       CASE o_orderkey % 7
            WHEN 0 THEN concat('https://t', CAST(o_custkey AS STRING), '.wd5.myworkdayjobs.com/en-US/careers', CAST(o_orderkey AS STRING))
            WHEN 1 THEN concat('https://boards.greenhouse.io/b', CAST(o_orderkey AS STRING))
            WHEN 2 THEN concat('https://jobs.lever.co/l', CAST(o_orderkey AS STRING))
            WHEN 3 THEN concat('https://careers.smartrecruiters.com/s', CAST(o_orderkey AS STRING))
            WHEN 4 THEN concat('https://c', CAST(o_orderkey AS STRING), '.icims.com/jobs/search')
            WHEN 5 THEN concat('https://t', CAST(o_orderkey AS STRING), '.taleo.net/careersection/x/jobsearch.ftl')
            ELSE concat('https://f', CAST(o_orderkey AS STRING), '.successfactors.com/career') END AS ats_url,
       CASE WHEN o_orderstatus <> 'P' THEN concat('https://d', CAST(o_orderkey AS STRING), '.example.com/') END
            AS discovered_from_url,
       CASE o_orderstatus WHEN 'F' THEN 0.95e0 WHEN 'O' THEN 0.9e0 ELSE 0.85e0 END AS confidence,
       CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS detected_at,
       CASE o_orderstatus WHEN 'F' THEN 'homepage_link' WHEN 'O' THEN 'vendor_probe' ELSE 'legacy' END
            AS detection_method,
       o_orderstatus = 'F' AS verified
FROM $orders
WHERE o_orderpriority = '1-URGENT'"""

VIEWS["crawl_runs"] = """
SELECT CAST(year(ts) * 10000 + month(ts) * 100 + day(ts) AS BIGINT) AS id,
       CAST(min(ts) AS TIMESTAMP) AS started_at,
       CASE WHEN max(ts) >= TIMESTAMP '2024-01-30 00:00:00' OR day(min(ts)) = 7 THEN NULL
            ELSE CAST(max(ts) AS TIMESTAMP) END AS finished_at,
       CASE WHEN max(ts) >= TIMESTAMP '2024-01-30 00:00:00' OR day(min(ts)) = 7 THEN 'RUNNING'
            ELSE 'COMPLETED' END AS status,
       CAST(NULL AS STRING) AS notes,
       CAST(count(DISTINCT user_id) AS INT) AS companies_attempted,
       CAST(count(DISTINCT CASE WHEN event_type <> 'error' THEN user_id END) AS INT) AS companies_succeeded,
       CAST(count(DISTINCT CASE WHEN event_type = 'error' THEN user_id END) AS INT) AS companies_failed,
       CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS INT) AS jobs_extracted_count,
       CAST(max(ts) AS TIMESTAMP) AS last_heartbeat_at
FROM $events
GROUP BY CAST(year(ts) * 10000 + month(ts) * 100 + day(ts) AS BIGINT)
UNION ALL
SELECT CAST(20230001 + r_regionkey AS BIGINT), TIMESTAMP '2023-12-01 00:00:00' + INTERVAL '1' DAY * r_regionkey,
       NULL, 'RUNNING', CAST(NULL AS STRING), 0, 0, 0, 0,
       CASE WHEN r_regionkey = 3 THEN NULL ELSE TIMESTAMP '2023-12-02 00:00:00' END
FROM $region"""

VIEWS["crawl_run_company_results"] = """
SELECT event_id AS id,
       CAST(year(ts) * 10000 + month(ts) * 100 + day(ts) AS BIGINT) AS crawl_run_id,
       user_id AS company_id,
       CASE WHEN event_type = 'error' THEN 'FAILED' WHEN value < 5 THEN 'SKIPPED'
            WHEN value > 150 THEN 'RUNNING' ELSE 'SUCCEEDED' END AS status,
       CASE event_type WHEN 'signup' THEN 'DOMAIN' WHEN 'view' THEN 'ROBOTS_SITEMAP'
            WHEN 'click' THEN 'JSONLD' ELSE 'ATS_ADAPTER' END AS stage,
       CASE WHEN event_type IN ('purchase', 'error') THEN
            CASE event_id % 4 WHEN 0 THEN 'WORKDAY' WHEN 1 THEN 'GREENHOUSE' WHEN 2 THEN 'LEVER' END
            END AS ats_type,
       CASE WHEN event_type IN ('purchase', 'error') THEN
            CASE event_id % 4 WHEN 0 THEN 'WORKDAY' WHEN 1 THEN 'GREENHOUSE' WHEN 2 THEN 'LEVER' ELSE 'NONE' END
            ELSE 'NONE' END AS ats_type_key,
       CASE WHEN event_id % 3 <> 0 THEN concat('https://d', CAST(user_id AS STRING), '.example.com') END
            AS endpoint_url,
       CASE WHEN value < 1 THEN NULL ELSE CAST(ts AS TIMESTAMP) END AS started_at,
       CASE WHEN value > 150 OR event_id % 9 = 0 THEN NULL
            ELSE CAST(ts AS TIMESTAMP) + INTERVAL '1' SECOND * CAST(floor(value) AS INT) END AS finished_at,
       CASE WHEN event_id % 13 = 0 THEN NULL ELSE CAST(floor(value * 1000) AS BIGINT) END AS duration_ms,
       CASE WHEN event_type = 'purchase' THEN CAST(floor(value) AS INT)
            WHEN event_type = 'view' THEN -3 ELSE 0 END AS jobs_extracted,
       value > 100 AS truncated,
       CASE WHEN event_type = 'purchase' THEN CAST(floor(value) AS INT) + 5 END AS total_jobs_available,
       CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'COMPLETE' END AS stop_reason,
       CASE WHEN event_type <> 'error' THEN NULL WHEN value < 10 THEN 'TIMEOUT'
            WHEN value < 25 THEN 'HTTP_404' WHEN value < 40 THEN 'HTTP_5XX'
            WHEN value < 60 THEN 'ROBOTS_BLOCKED' WHEN value < 90 THEN 'HOST_COOLDOWN' END AS reason_code,
       CASE WHEN event_type <> 'error' THEN 200 WHEN value < 10 THEN NULL WHEN value < 25 THEN 404
            WHEN value < 40 THEN 503 ELSE 403 END AS http_status,
       CASE WHEN event_type <> 'error' THEN NULL WHEN value < 10 THEN 'time_budget_exceeded'
            WHEN value < 25 THEN 'sitemap_http_404' WHEN value < 40 THEN 'http_503'
            WHEN value < 60 THEN 'homepage_blocked_by_robots' ELSE ' host_cooldown ' END AS error_detail,
       event_type = 'error' AND value < 10 AS retryable
FROM $events"""

VIEWS["discovered_urls"] = """
SELECT event_id AS id,
       CAST(year(ts) * 10000 + month(ts) * 100 + day(ts) AS BIGINT) AS crawl_run_id,
       user_id AS company_id,
       concat('https://d', CAST(user_id AS STRING), '.example.com/jobs/', CAST(event_id % 50 AS STRING)) AS url,
       CASE event_id % 4 WHEN 0 THEN 'ATS_API' WHEN 1 THEN 'ATS_LANDING' WHEN 2 THEN 'CANDIDATE_JOB'
            ELSE 'OTHER' END AS url_type,
       CASE WHEN event_type = 'signup' THEN 'discovered' WHEN event_type = 'view' THEN 'no_jobposting_structured_data'
            WHEN event_type = 'purchase' THEN 'ats_fetch_success' WHEN event_type = 'click' THEN
                 CASE WHEN value < 20 THEN NULL ELSE 'jobposting_found' END
            WHEN value < 15 THEN 'http_404' WHEN value < 30 THEN 'http_503'
            WHEN value < 50 THEN 'blocked_by_robots' ELSE 'timeout' END AS fetch_status,
       CASE WHEN value < 2 THEN NULL ELSE CAST(ts AS TIMESTAMP) END AS last_fetched_at,
       CASE WHEN event_type = 'error' AND value < 15 THEN 404 WHEN event_type = 'error' AND value < 30 THEN 503
            WHEN event_type = 'error' THEN NULL ELSE 200 END AS http_status,
       CASE WHEN event_type = 'error' AND value >= 50 THEN 'timeout' END AS error_code,
       CASE event_id % 5 WHEN 0 THEN 'GREENHOUSE' WHEN 1 THEN 'LEVER' WHEN 2 THEN 'WORKDAY' END AS adapter
FROM $events"""

VIEWS["discovered_sitemaps"] = """
SELECT page_id AS id, 20240101 + page_id % 29 AS crawl_run_id, page_id % 150 AS company_id,
       concat(url, '#sitemap') AS sitemap_url,
       TIMESTAMP '2024-01-01 06:00:00' + INTERVAL '1' DAY * CAST(page_id % 29 AS INT) AS fetched_at,
       CAST(length(html) % 100 AS INT) AS url_count
FROM $pages"""

VIEWS["careers_discovery_runs"] = """
SELECT CAST(year(ts) * 10000 + month(ts) * 100 + day(ts) AS BIGINT) AS id,
       CAST(min(ts) AS TIMESTAMP) AS started_at,
       CASE WHEN max(ts) >= TIMESTAMP '2024-01-30 00:00:00' THEN NULL ELSE CAST(max(ts) AS TIMESTAMP) END AS finished_at,
       CASE WHEN max(ts) >= TIMESTAMP '2024-01-30 00:00:00' THEN 'RUNNING'
            WHEN day(min(ts)) % 6 = 0 THEN 'ABORTED' ELSE 'SUCCEEDED' END AS status,
       200 AS company_limit,
       CAST(count(DISTINCT user_id) AS INT) AS processed_count,
       CAST(count(DISTINCT CASE WHEN event_type = 'purchase' THEN user_id END) AS INT) AS succeeded_count,
       CAST(count(DISTINCT user_id) - count(DISTINCT CASE WHEN event_type = 'purchase' THEN user_id END) AS INT) AS failed_count,
       CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS INT) AS endpoints_added,
       CAST(count(*) AS INT) AS request_count_total,
       CAST(count(DISTINCT user_id) AS INT) AS companies_attempted_count,
       CAST(sum(CASE WHEN value < 3 THEN 1 ELSE 0 END) AS INT) AS cached_skip_count,
       CAST(count(*) AS INT) AS selection_eligible_count,
       CAST(count(DISTINCT user_id) AS INT) AS selection_returned_count,
       CAST(count(DISTINCT user_id) AS INT) AS companies_input_count,
       concat('{"GREENHOUSE":', CAST(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS STRING),
              ',"LEVER":', CAST(sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS STRING), '}')
              AS endpoints_found_homepage_json,
       concat('{"WORKDAY":', CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS STRING), '}')
              AS endpoints_found_vendor_json,
       CASE WHEN day(min(ts)) % 6 = 0 THEN 'request_budget_exceeded' END AS stop_reason
FROM $events
GROUP BY CAST(year(ts) * 10000 + month(ts) * 100 + day(ts) AS BIGINT)"""

VIEWS["careers_discovery_company_results"] = """
SELECT discovery_run_id * 1000000 + company_id AS id, discovery_run_id, company_id,
       CASE WHEN k % 3 = 0 THEN 'SUCCEEDED' WHEN k % 7 = 1 THEN 'SKIPPED' ELSE 'FAILED' END AS status,
       CASE WHEN k % 3 = 0 THEN NULL WHEN k % 5 = 1 THEN 'TIMEOUT' WHEN k % 5 = 2 THEN 'NO_DOMAIN'
            WHEN k % 5 = 3 THEN 'ATS_NOT_FOUND' WHEN k % 5 = 4 THEN 'HTTP_404' END AS reason_code,
       CASE k % 4 WHEN 0 THEN 'PAGE_SCAN' WHEN 1 THEN 'HOMEPAGE' WHEN 2 THEN 'SITEMAP' ELSE 'DOMAIN' END AS stage,
       CAST(k % 3 AS INT) AS found_endpoints_count,
       CASE WHEN k % 10 = 0 THEN NULL ELSE CAST(floor(v * 100) AS BIGINT) END AS duration_ms,
       CASE WHEN k % 5 = 4 THEN 404 END AS http_status,
       CASE WHEN k % 5 = 1 THEN 'timeout' END AS error_detail,
       last_ts AS created_at,
       k % 2 = 0 OR k % 3 = 0 AS careers_url_found,
       CASE WHEN k % 2 = 0 THEN concat('https://d', CAST(company_id AS STRING), '.example.com/careers') END AS careers_url_initial,
       CASE WHEN k % 2 = 0 THEN concat('https://jobs.d', CAST(company_id AS STRING), '.example.com/') END AS careers_url_final,
       CASE k % 3 WHEN 0 THEN 'HOMEPAGE_LINK' WHEN 1 THEN 'PATH_GUESS' END AS careers_discovery_method,
       CASE WHEN k % 2 <> 0 AND k % 3 <> 0 THEN
            CASE WHEN k % 5 < 2 THEN 'NO_CAREERS_LINK_ON_HOMEPAGE' ELSE 'ALL_COMMON_PATHS_404' END END
            AS careers_discovery_stage_failure,
       k % 3 = 0 OR (k % 2 = 0 AND k % 5 = 1) AS vendor_detected,
       CASE WHEN k % 3 = 0 THEN ' Greenhouse ' WHEN k % 2 = 0 AND k % 5 = 1 THEN 'LEVER' END AS vendor_name,
       k % 3 = 0 AS endpoint_extracted,
       CASE WHEN k % 3 = 0 THEN concat('https://boards.greenhouse.io/c', CAST(company_id AS STRING)) END AS endpoint_url,
       CASE WHEN k % 5 = 3 THEN 503 END AS http_status_first_failure,
       CAST(n AS INT) AS request_count
FROM (SELECT CAST(year(ts) * 10000 + month(ts) * 100 + day(ts) AS BIGINT) AS discovery_run_id, user_id AS company_id,
             max(event_id) AS k, max(value) AS v, count(*) AS n, CAST(max(ts) AS TIMESTAMP) AS last_ts
      FROM $events
      GROUP BY CAST(year(ts) * 10000 + month(ts) * 100 + day(ts) AS BIGINT), user_id) g"""

VIEWS["careers_discovery_failures"] = """
SELECT event_id AS id, user_id AS company_id,
       CASE WHEN value < 8 THEN 'discovery_fetch_failed' WHEN value < 14 THEN 'discovery_no_match'
            WHEN value < 20 THEN 'discovery_homepage_blocked_by_robots' WHEN value < 26 THEN 'discovery_time_budget_exceeded'
            WHEN value < 32 THEN 'discovery_host_cooldown' WHEN value < 40 THEN 'discovery_sitemap_no_urls'
            WHEN value < 50 THEN 'discovery_ats_detected_no_endpoint' WHEN value < 70 THEN 'discovery_fetch_failed'
            WHEN value < 90 THEN 'discovery_no_domain' ELSE 'mystery' END AS reason_code,
       CASE event_id % 7
            WHEN 0 THEN concat('https://d', CAST(user_id AS STRING), '.example.com/careers/x', CAST(event_id AS STRING))
            WHEN 1 THEN concat('https://careers.d', CAST(user_id AS STRING), '.example.com/')
            WHEN 2 THEN concat('https://boards.greenhouse.io/c', CAST(user_id AS STRING))
            WHEN 3 THEN concat('https://D', CAST(user_id AS STRING), '.Example.com')
            WHEN 4 THEN concat('https://d', CAST(user_id AS STRING), '.example.com/team/Jobs')
            WHEN 5 THEN NULL
            ELSE concat('https://t', CAST(user_id AS STRING), '.wd1.myworkdayjobs.com/ext') END AS candidate_url,
       CASE WHEN value < 3 THEN 'http_404' WHEN value < 6 THEN 'timeout' WHEN value < 8 THEN 'io_error'
            WHEN value < 26 THEN NULL WHEN value < 55 THEN 'HTTP_503 upstream' WHEN value < 62 THEN 'http_429'
            ELSE 'parse_failed' END AS detail,
       CAST(ts AS TIMESTAMP) AS observed_at
FROM $events
WHERE event_type = 'error'"""

# customers of a lower balance stand for companies that were never looked at
VIEWS["careers_discovery_state"] = """
SELECT c_custkey AS company_id,
       CASE WHEN c_custkey % 8 = 0 THEN NULL
            ELSE TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' HOUR * CAST(c_custkey % 700 AS INT) END AS last_attempt_at,
       CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'discovery_no_match' WHEN 2 THEN 'DISCOVERY_SITEMAP_NO_URLS'
            WHEN 3 THEN 'discovery_fetch_failed' ELSE 'discovery_host_cooldown' END AS last_reason_code,
       CAST(NULL AS STRING) AS last_candidate_url,
       CAST(c_custkey % 6 AS INT) AS consecutive_failures,
       CASE WHEN c_custkey % 3 = 0 THEN TIMESTAMP '2024-01-20 00:00:00' + INTERVAL '1' HOUR * CAST(c_custkey % 500 AS INT) END
            AS next_attempt_at
FROM $customer
WHERE c_acctbal >= 500"""

VIEWS["host_crawl_state"] = """
SELECT host, CAST(max(page_id) % 6 AS INT) AS consecutive_failures,
       CASE max(page_id) % 3 WHEN 0 THEN 'TIMEOUT' WHEN 1 THEN 'HTTP_429_RATE_LIMIT' END AS last_error_category,
       TIMESTAMP '2024-01-30 00:00:00' AS last_attempt_at,
       CASE WHEN max(page_id) % 4 <> 0 THEN
            TIMESTAMP '2024-01-30 00:00:00' + INTERVAL '1' MINUTE * CAST(max(page_id) % 300 - 100 AS INT) END AS next_allowed_at
FROM (SELECT page_id, regexp_extract(lower(url), '^https?://([^/?#]+)', 1) AS host FROM $pages) p
GROUP BY host"""

VIEWS["crawl_hosts"] = """
SELECT host,
       CASE WHEN min(page_id) % 5 <> 0 THEN
            TIMESTAMP '2024-01-15 00:00:00' + INTERVAL '1' HOUR * CAST(min(page_id) % 48 - 24 AS INT) END AS next_allowed_at,
       CAST(min(page_id) % 7 AS INT) AS backoff_state,
       CASE min(page_id) % 3 WHEN 0 THEN 'HTTP_2XX' WHEN 1 THEN 'HTTP_429' END AS last_status_bucket,
       CASE WHEN min(page_id) % 9 = 0 THEN 1 ELSE 0 END AS inflight_count,
       TIMESTAMP '2024-01-15 00:00:00' AS updated_at
FROM (SELECT page_id, regexp_extract(lower(url), '^https?://([^/?#]+)', 1) AS host FROM $pages) p
GROUP BY host"""

VIEWS["crawl_urls"] = """
SELECT page_id AS id, url, regexp_extract(lower(url), '^https?://([^/?#]+)', 1) AS host,
       lower(url) AS canonical_url,
       CASE WHEN page_id % 4 = 0 THEN 'SITEMAP' ELSE 'CANDIDATE' END AS url_kind,
       CAST(page_id % 5 * 25 AS INT) AS priority,
       TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' HOUR * CAST(page_id % 600 AS INT) AS next_fetch_at,
       CASE page_id % 6 WHEN 0 THEN 'FETCHED' WHEN 1 THEN 'FAILED' WHEN 5 THEN 'FETCHING' ELSE 'QUEUED' END AS status,
       CASE WHEN page_id % 6 < 2 THEN TIMESTAMP '2024-01-10 00:00:00' END AS last_fetch_at,
       CASE WHEN page_id % 6 = 1 THEN 'http_503' END AS last_error,
       CASE WHEN page_id % 6 = 5 THEN TIMESTAMP '2024-01-15 01:00:00'
            WHEN page_id % 11 = 3 THEN TIMESTAMP '2024-01-14 00:00:00' END AS locked_until,
       CASE WHEN page_id % 6 = 5 THEN 'w1' END AS lock_owner,
       TIMESTAMP '2024-01-10 00:00:00' AS updated_at
FROM $pages"""

VIEWS["crawl_url_attempts"] = """
SELECT event_id AS id, user_id AS url_id, concat('h', CAST(user_id % 40 AS STRING), '.example.com') AS host,
       CAST(ts AS TIMESTAMP) AS fetched_at,
       CASE WHEN event_type = 'error' THEN
                 CASE WHEN value < 10 THEN 429 WHEN value < 20 THEN 403 WHEN value < 35 THEN 503
                      WHEN value < 50 THEN 404 WHEN value < 60 THEN 408 ELSE 0 END
            ELSE 200 END AS http_status,
       CAST(floor(value * 10) AS BIGINT) AS elapsed_ms,
       CASE WHEN event_type = 'error' AND value >= 60 AND value < 100 THEN 'read_timeout'
            WHEN event_type = 'error' AND value >= 100 THEN 'io_error' END AS error_bucket
FROM $events"""

VIEWS["crawl_queue"] = """
SELECT c_custkey AS company_id,
       TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' HOUR * CAST(c_custkey % 900 AS INT) AS next_run_at,
       CASE c_custkey % 6 WHEN 0 THEN TIMESTAMP '2024-01-16 00:00:00' WHEN 1 THEN TIMESTAMP '2024-01-10 00:00:00' END AS locked_until,
       CASE c_custkey % 6 WHEN 0 THEN 'w1' WHEN 1 THEN 'w2' END AS lock_owner,
       CAST(c_custkey % 3 AS INT) AS lock_count,
       TIMESTAMP '2024-01-09 00:00:00' AS last_started_at,
       CASE WHEN c_custkey % 5 = 0 THEN NULL
            ELSE TIMESTAMP '2024-01-09 00:00:00' + INTERVAL '1' MINUTE * CAST(c_custkey % 1000 AS INT) END AS last_finished_at,
       CASE WHEN c_custkey % 2 = 0 THEN TIMESTAMP '2024-01-08 00:00:00' END AS last_success_at,
       CASE WHEN c_custkey % 4 = 1 THEN concat('err', CAST(c_custkey % 3 AS STRING)) END AS last_error,
       CAST(c_custkey % 7 AS INT) AS consecutive_failures,
       CAST(c_custkey % 20 AS INT) AS total_runs,
       CAST(c_custkey % 11 AS INT) AS total_successes,
       CAST(c_custkey % 9 AS INT) AS total_failures,
       TIMESTAMP '2024-01-10 00:00:00' AS updated_at
FROM $customer"""

VIEWS["canary_runs"] = """
SELECT CAST(year(ts) * 10000 + month(ts) * 100 + day(ts) AS BIGINT) AS id,
       CASE WHEN day(min(ts)) % 2 = 0 THEN 'SEC' ELSE 'SEC_FULL_CYCLE' END AS type,
       CAST(count(*) AS INT) AS requested_limit,
       CAST(min(ts) AS TIMESTAMP) AS started_at, CAST(max(ts) AS TIMESTAMP) AS finished_at,
       CASE WHEN day(min(ts)) % 5 = 0 THEN 'ABORTED' ELSE 'COMPLETED' END AS status,
       concat('{"jobsExtracted":', CAST(count(*) AS STRING), '}') AS summary_json,
       concat('{"http_404":', CAST(sum(CASE WHEN event_type = 'error' AND value < 15 THEN 1 ELSE 0 END) AS STRING),
              ',"timeout":', CAST(sum(CASE WHEN event_type = 'error' AND value >= 15 THEN 1 ELSE 0 END) AS STRING), '}')
              AS error_summary_json
FROM $events
GROUP BY CAST(year(ts) * 10000 + month(ts) * 100 + day(ts) AS BIGINT)"""

VIEWS["job_postings"] = """
SELECT (l_orderkey * 10 + l_linenumber) * 1000000000 + l_partkey * 1000 + l_suppkey % 1000 AS id,
       o_custkey AS company_id,
       CASE WHEN day(l_shipdate) = 31 THEN NULL ELSE CAST(20240100 + day(l_shipdate) AS BIGINT) END AS crawl_run_id,
       CASE WHEN l_suppkey % 29 = 7 THEN concat('https://community.workday.com/invalid-url?x=', CAST(l_partkey AS STRING))
            ELSE concat('https://api.lever.co/v0/postings/c', CAST(o_custkey AS STRING)) END AS source_url,
       CASE WHEN l_partkey % 19 = 0 THEN concat('https://community.workday.com/invalid-url/', CAST(l_partkey AS STRING))
            WHEN l_partkey % 23 = 0 THEN NULL
            WHEN l_partkey % 3 = 0 THEN concat('https://t', CAST(o_custkey AS STRING), '.wd5.myworkdayjobs.com/en-US/careers/job/', CAST(l_orderkey AS STRING), '-', CAST(l_partkey AS STRING))
            ELSE concat('https://boards.greenhouse.io/c', CAST(o_custkey AS STRING), '/jobs/', CAST(l_orderkey AS STRING), '-', CAST(l_partkey AS STRING)) END AS canonical_url,
       concat(p_name, ' engineer') AS title,
       CASE WHEN l_suppkey % 13 = 0 THEN NULL ELSE concat(p_brand, ' Corp') END AS org_name,
       CASE l_returnflag WHEN 'A' THEN 'Austin, TX' WHEN 'N' THEN 'New York, NY' ELSE NULL END AS location_text,
       p_type AS employment_type,
       CAST(l_shipdate AS DATE) AS date_posted,
       concat('<p>Build the ', p_name, ' &amp; ship it.</p><br>Team ', p_brand) AS description_text,
       concat('Build the ', p_name, ' & ship it. Team ', p_brand) AS description_plain,
       CASE WHEN l_linenumber = 1 THEN NULL WHEN l_linenumber = 2 THEN ' '
            ELSE concat('R', CAST(l_orderkey % 5 AS STRING), '-', CAST(l_partkey AS STRING)) END AS external_identifier,
       concat(md5(concat(CAST(l_orderkey AS STRING), '/', CAST(l_linenumber AS STRING))),
              md5(concat(CAST(l_partkey AS STRING), '/', CAST(l_suppkey AS STRING)))) AS content_hash,
       TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' DAY * CAST(day(l_shipdate) - 1 - l_linenumber % 3 AS INT)
            + INTERVAL '1' MINUTE * CAST(l_partkey % 1440 AS INT) AS first_seen_at,
       TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' DAY * CAST(day(l_shipdate) - 1 AS INT)
            + INTERVAL '1' MINUTE * CAST(l_partkey % 1440 AS INT) AS last_seen_at,
       l_linestatus = 'O' AS is_active
FROM $lineitem JOIN $orders ON l_orderkey = o_orderkey JOIN $part ON l_partkey = p_partkey"""

VIEWS["document_postings"] = """
SELECT doc_id AS id, doc_id % 150 AS company_id, source AS org_name, lang AS location_text,
       CAST(NULL AS STRING) AS title, CAST(NULL AS STRING) AS employment_type,
       text AS description_text, text AS description_plain
FROM $documents"""

VIEWS["raw_urls"] = """
SELECT page_id AS pos, regexp_extract(url, '^https?://([^/?#]+)', 1) AS source,
       CASE page_id % 12
            WHEN 0 THEN replace(replace(url, 'http://', 'HTTP://'), 'https://', 'HTTPS://')
            WHEN 1 THEN concat(' ', replace(replace(url, 'http://', ''), 'https://', ''), ' ')
            WHEN 2 THEN replace(replace(url, '.example', '.Example'), '/en/', '//en//jobs/')
            WHEN 3 THEN replace(replace(url, 'https://', 'https://u:p@'), '/en/', ':443/en/')
            WHEN 4 THEN replace(replace(url, '/en/', ':8080/careers/a%20b/'), '/fr/', ':80/fr/')
            WHEN 5 THEN concat('https://x.example.com/p?b=2&gclid=9&A=%41%20z&a=1&utm_x=1&c&a=0#f', CAST(page_id % 3 AS STRING))
            WHEN 6 THEN concat('https://bad host.example.com/', CAST(page_id AS STRING))
            WHEN 7 THEN concat('https://boards.greenhouse.io/acme', CAST(page_id % 5 AS STRING), '/jobs/', CAST(page_id AS STRING), '?gh_src=abc&x=1')
            WHEN 8 THEN concat('https://t', CAST(page_id AS STRING), '.wd5.myworkdayjobs.com/en-US/ext/job/', CAST(page_id AS STRING), '/')
            WHEN 9 THEN concat('//cdn.example.com/logo', CAST(page_id AS STRING), '.png')
            WHEN 10 THEN concat('https://www.example.net/find?q=career+', CAST(page_id % 4 AS STRING), '&source=mail&keep=1')
            ELSE url END AS url
FROM $pages"""

VIEWS["failure_keys"] = """
SELECT event_id AS id,
       CASE event_type WHEN 'error' THEN CASE WHEN value < 20 THEN 404 WHEN value < 30 THEN 401 WHEN value < 40 THEN 408
            WHEN value < 50 THEN 429 WHEN value < 80 THEN 502 WHEN value < 90 THEN 0 END ELSE 200 END AS http_status,
       CASE event_id % 5 WHEN 0 THEN 'IO_ERROR' WHEN 1 THEN 'read_Timeout' WHEN 2 THEN ' ' WHEN 3 THEN 'other' END AS error_code,
       CASE event_id % 4 WHEN 0 THEN 'java.net.UnknownHostException' WHEN 1 THEN 'SSL handshake' WHEN 2 THEN 'reset' END AS error_message,
       CASE event_id % 16 WHEN 0 THEN 'homepage_blocked_by_robots' WHEN 1 THEN 'Host_Cooldown' WHEN 2 THEN 'no_sitemaps'
            WHEN 3 THEN 'sitemap_fetch_failed' WHEN 4 THEN 'no_jobposting_structured_data' WHEN 5 THEN 'json_parse_error'
            WHEN 6 THEN 'time_budget_exceeded' WHEN 7 THEN 'sitemap_http_503' WHEN 8 THEN 'http_404_then_http_429'
            WHEN 9 THEN 'http_' WHEN 10 THEN '' WHEN 11 THEN 'HTTP_418' WHEN 12 THEN 'gzip_decode_error'
            WHEN 13 THEN 'dns failure' WHEN 14 THEN 'TLS alert' END AS error_key
FROM $events"""

_REF = re.compile(r"\$(\w+)")


class Model:
    """Given tables and crawl-model views of one data folder as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark = spark
        self.folder = folder.rstrip("/")
        self.prefix = "given_%08x_" % zlib.crc32(self.folder.encode())

    def _given(self, name: str) -> str:
        view = self.prefix + name
        path = f"{self.folder}/{name}.parquet"
        self.spark.read.schema(BASE[name]).parquet(path).createOrReplaceTempView(view)
        return view

    def sql(self, text: str) -> DataFrame:
        return self.spark.sql(compose(text, self._given))

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            return self.sql(VIEWS[name])
        if name in BASE:
            return self.spark.table(self._given(name))
        raise AttributeError(name)


def compose(body: str, base_name) -> str:
    """SQL text with the views a body names as ``$view`` put in front of it as CTEs."""
    order: list[str] = []
    named: dict[str, str] = {}

    def visit(text):
        for name in _REF.findall(text):
            if name in BASE:
                named.setdefault(name, base_name(name))
            elif name in VIEWS and name not in order:
                visit(VIEWS[name])
                order.append(name)

    def plain(text):
        return _REF.sub(lambda m: named.get(m.group(1), m.group(1)), text).strip()

    visit(body)
    ctes = ", ".join(f"{n} AS ({plain(VIEWS[n])})" for n in order)
    body = plain(body)
    if not ctes:
        return body
    for word in ("WITH RECURSIVE ", "WITH "):
        if body.upper().startswith(word):
            return f"{word}{ctes}, {body[len(word):]}"
    return f"WITH {ctes} {body}"


def oracle_text(body: str) -> str:
    """DuckDB text, where the given tables go by their own names."""
    return compose(body, lambda name: name)
