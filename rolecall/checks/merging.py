"""Keyed merges and deletions, each with its oracle."""

from pyspark.sql import functions as F

from rolecall.checks.registry import check
from rolecall.operators import merges as M

NOW = "2024-02-01 00:00:00"
NOW_SQL = f"TIMESTAMP '{NOW}'"

LAST = "last({0} ORDER BY ord)"
LAST_VALUE = "last({0} ORDER BY ord) FILTER (WHERE {0} IS NOT NULL)"
FIRST_VALUE = "first({0} ORDER BY ord) FILTER (WHERE {0} IS NOT NULL)"


def merged(target, batch, keys, new=(), fill=(), keep=(), rest=None, insert=True, pre=""):
    """Oracle of a merge: fold the batch by key, full join, combine column by column.

    ``rest`` gives the other target columns with the value an inserted row gets.
    """
    folds = [LAST.format(c) + f" AS {c}" for c in new]
    folds += [LAST_VALUE.format(c) + f" AS {c}" for c in fill]
    folds += [FIRST_VALUE.format(c) + f" AS {c}" for c in keep]
    same = " AND ".join(f"t.{k} = s.{k}" for k in keys)
    hit, had = "s.hit IS NOT NULL", "t.had IS NOT NULL"
    cols = [f"coalesce(t.{k}, s.{k}) AS {k}" for k in keys]
    cols += [f"CASE WHEN {hit} THEN s.{c} ELSE t.{c} END AS {c}" for c in new]
    cols += [f"coalesce(s.{c}, t.{c}) AS {c}" for c in fill]
    cols += [f"coalesce(t.{c}, s.{c}) AS {c}" for c in keep]
    cols += [f"CASE WHEN {had} THEN t.{c} ELSE {v} END AS {c}" for c, v in (rest or {}).items()]
    return f"""WITH {pre} batch AS ({batch}), folded AS (
    SELECT {', '.join(keys)}, {', '.join(folds)}, true AS hit FROM batch GROUP BY {', '.join(keys)})
SELECT {', '.join(cols)} FROM (SELECT *, true AS had FROM {target}) t
{'FULL' if insert else 'LEFT'} JOIN folded s ON {same}"""


COMPANY_BATCH = """
SELECT event_id AS ord, 900000 + user_id AS id, concat('T', lpad(CAST(user_id * 12 AS STRING), 9, '0')) AS ticker,
       concat('Renamed ', CAST(event_id AS STRING)) AS name,
       CASE WHEN event_id % 3 = 0 THEN event_type END AS sector,
       CASE WHEN event_id % 40 = 1 THEN concat('Title_', CAST(event_id AS STRING)) END AS wikipedia_title,
       CASE WHEN event_type = 'click' THEN '0000000042' END AS cik FROM $events"""
RESOLUTION = ["domain_resolution_method", "domain_resolution_status", "domain_resolution_error",
              "domain_resolution_attempted_at"]


@check("merge_companies", merged("$companies", COMPANY_BATCH, ["ticker"], ["name"],
       ["sector", "wikipedia_title", "cik"], ["id"], {c: "NULL" for c in RESOLUTION}))
def _(m):
    return M.merge_companies(m.companies, m.sql(COMPANY_BATCH))


DOMAIN_BATCH = """
SELECT o_orderkey * 2 AS ord, 70000000 + o_orderkey AS id, o_custkey AS company_id, concat('d', CAST(o_orderkey AS STRING), '.example.com') AS domain,
       CASE WHEN o_orderkey % 3 = 0 THEN 'https://hint.example.com/' END AS careers_hint_url,
       CASE o_orderkey % 4 WHEN 0 THEN 'MANUAL' WHEN 1 THEN 'HEURISTIC' ELSE 'WIKIDATA' END AS source,
       0.5e0 AS confidence, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE TIMESTAMP '2024-02-01 00:00:00' END AS resolved_at,
       CASE WHEN o_orderkey % 2 = 0 THEN 'M1' END AS resolution_method, CASE WHEN o_orderkey % 7 = 0 THEN 'Q7' END AS wikidata_qid FROM $orders
UNION ALL
SELECT o_orderkey * 2 + 1, 80000000 + o_orderkey, o_custkey, concat('d', CAST(o_orderkey AS STRING), '.example.com'),
       CASE WHEN o_orderkey % 8 = 1 THEN 'https://late.example.com/' END,
       CASE o_orderkey % 3 WHEN 0 THEN 'MANUAL' ELSE 'WIKIPEDIA' END, 0.6e0, NULL,
       CASE WHEN o_orderkey % 9 = 0 THEN 'M2' END, NULL FROM $orders WHERE o_orderstatus <> 'O'"""


@check("merge_domains", f"""
WITH batch AS ({DOMAIN_BATCH}),
 b AS (SELECT b.*, EXISTS (SELECT 1 FROM $company_domains t WHERE t.company_id = b.company_id AND t.domain = b.domain AND t.source = 'MANUAL') AS locked,
   min(ord) FILTER (WHERE source = 'MANUAL') OVER (PARTITION BY company_id, domain) AS first_manual FROM batch b),
 e AS (SELECT *, source = 'MANUAL' OR (NOT locked AND (first_manual IS NULL OR ord < first_manual)) AS counts FROM b),
 f AS (SELECT company_id, domain, last(careers_hint_url ORDER BY ord) FILTER (WHERE careers_hint_url IS NOT NULL) AS careers_hint_url,
   first(id ORDER BY ord) FILTER (WHERE counts) AS id, last(source ORDER BY ord) FILTER (WHERE counts) AS source,
   last(confidence ORDER BY ord) FILTER (WHERE counts) AS confidence, last(resolved_at ORDER BY ord) FILTER (WHERE counts) AS resolved_at,
   last(resolution_method ORDER BY ord) FILTER (WHERE counts AND resolution_method IS NOT NULL) AS resolution_method,
   last(wikidata_qid ORDER BY ord) FILTER (WHERE counts AND wikidata_qid IS NOT NULL) AS wikidata_qid FROM e GROUP BY 1, 2)
SELECT coalesce(t.id, f.id) AS id, coalesce(t.company_id, f.company_id) AS company_id, coalesce(t.domain, f.domain) AS domain,
  coalesce(f.careers_hint_url, t.careers_hint_url) AS careers_hint_url,
  CASE WHEN f.source IS NULL THEN t.source ELSE f.source END AS source,
  CASE WHEN f.source IS NULL THEN t.confidence ELSE f.confidence END AS confidence,
  CASE WHEN f.source IS NULL THEN t.resolved_at ELSE f.resolved_at END AS resolved_at,
  coalesce(f.resolution_method, t.resolution_method) AS resolution_method, coalesce(f.wikidata_qid, t.wikidata_qid) AS wikidata_qid
FROM $company_domains t FULL JOIN f ON f.company_id = t.company_id AND f.domain = t.domain""")
def _(m):
    return M.merge_domains(m.company_domains, m.sql(DOMAIN_BATCH))


ENDPOINT_BATCH = """
SELECT o_orderkey AS ord, 50000000 + o_orderkey AS id, o_custkey AS company_id, 'GREENHOUSE' AS ats_type,
       CASE o_orderkey % 3 WHEN 0 THEN concat('https://job-boards.greenhouse.io/b', CAST(o_orderkey AS STRING), '/')
            WHEN 1 THEN concat('boards.greenhouse.io/b', CAST(o_orderkey AS STRING)) ELSE ' ' END AS ats_url,
       CASE WHEN o_orderkey % 2 = 0 THEN 'https://from.example.com/' END AS discovered_from_url, 0.5e0 AS confidence,
       CAST(o_orderdate AS TIMESTAMP) AS detected_at, CASE WHEN o_orderkey % 4 = 0 THEN 'sitemap' END AS detection_method,
       CASE WHEN o_orderkey % 6 <> 0 THEN o_orderkey % 4 = 1 END AS verified FROM $orders"""


@check("merge_endpoints", merged("$ats_endpoints", f"""
SELECT * EXCLUDE (ats_url), concat('https://boards.greenhouse.io/b', CAST(ord AS VARCHAR)) AS ats_url FROM ({ENDPOINT_BATCH}) x
WHERE trim(ats_url) <> ''""", ["company_id", "ats_type", "ats_url"], ["detected_at", "confidence"],
    ["discovered_from_url", "detection_method", "verified"], ["id"]))
def _(m):
    return M.merge_endpoints(m.ats_endpoints, m.sql(ENDPOINT_BATCH))


# every fourth posting comes back under its identifier with a new hash, every fifth with its old hash
POSTING_BATCH = """
SELECT id AS ord, id + 7 AS id, company_id, 20240130 AS crawl_run_id, concat(source_url, '?seen=2') AS source_url, canonical_url,
       concat(title, ' II') AS title, org_name, location_text, employment_type, date_posted, description_text, external_identifier,
       CASE WHEN id % 4 = 0 THEN concat(md5(concat('n', CAST(id AS STRING))), md5(title)) ELSE content_hash END AS content_hash,
       TIMESTAMP '2024-02-01 00:00:00' AS fetched_at
FROM $job_postings WHERE is_active"""

FIT = """canonical_url IS NOT NULL AND strpos(canonical_url, 'invalid-url') = 0
    AND source_url NOT LIKE 'https://community.workday.com/invalid-url%'"""
NEWF = ["source_url", "title", "org_name", "location_text", "employment_type", "date_posted", "description_text",
        "description_plain", "external_identifier"]
PLAIN = "trim(regexp_replace(replace(regexp_replace(description_text, '<[^>]*>', ' ', 'g'), '&amp;', '&'), ' +', ' ', 'g'))"

MOVED = f"""
batch AS (SELECT *, {PLAIN} AS description_plain FROM ({POSTING_BATCH}) x WHERE {FIT}),
ident AS (SELECT company_id, external_identifier, {', '.join(LAST.format(c) + ' AS ' + c for c in NEWF if c != 'external_identifier')},
   {LAST_VALUE.format('canonical_url')} AS canonical_url, {LAST_VALUE.format('crawl_run_id')} AS crawl_run_id,
   {LAST.format('content_hash')} AS content_hash, {LAST.format('fetched_at')} AS fetched_at
   FROM batch WHERE trim(external_identifier) <> '' GROUP BY 1, 2),
moved AS (SELECT t.id, t.company_id, t.external_identifier, t.first_seen_at, coalesce(i.canonical_url, t.canonical_url) AS canonical_url,
   coalesce(i.crawl_run_id, t.crawl_run_id) AS crawl_run_id,
   {', '.join(f"CASE WHEN i.company_id IS NULL THEN t.{c} ELSE i.{c} END AS {c}" for c in NEWF if c != 'external_identifier')},
   coalesce(i.content_hash, t.content_hash) AS content_hash, coalesce(i.fetched_at, t.last_seen_at) AS last_seen_at,
   CASE WHEN i.company_id IS NULL THEN t.is_active ELSE true END AS is_active
   FROM $job_postings t LEFT JOIN ident i ON i.company_id = t.company_id AND i.external_identifier = t.external_identifier)"""


@check("merge_postings", f"""
WITH {MOVED},
 uniq AS (SELECT * FROM (SELECT DISTINCT ON (company_id, content_hash) * FROM moved ORDER BY company_id, content_hash, last_seen_at DESC, id DESC) u),
 f AS (SELECT company_id, content_hash, {FIRST_VALUE.format('id')} AS id, {', '.join(LAST.format(c) + ' AS ' + c for c in NEWF)},
   {LAST_VALUE.format('canonical_url')} AS canonical_url, {LAST_VALUE.format('crawl_run_id')} AS crawl_run_id,
   {FIRST_VALUE.format('fetched_at')} AS first_seen_at, {LAST.format('fetched_at')} AS last_seen_at FROM batch GROUP BY 1, 2)
SELECT coalesce(u.id, f.id) AS id, coalesce(u.company_id, f.company_id) AS company_id, coalesce(u.content_hash, f.content_hash) AS content_hash,
  coalesce(f.canonical_url, u.canonical_url) AS canonical_url, coalesce(f.crawl_run_id, u.crawl_run_id) AS crawl_run_id,
  {', '.join(f"CASE WHEN f.company_id IS NULL THEN u.{c} ELSE f.{c} END AS {c}" for c in NEWF)},
  coalesce(u.first_seen_at, f.first_seen_at) AS first_seen_at, coalesce(f.last_seen_at, u.last_seen_at) AS last_seen_at,
  CASE WHEN f.company_id IS NULL THEN u.is_active ELSE true END AS is_active
FROM uniq u FULL JOIN f ON f.company_id = u.company_id AND f.content_hash = u.content_hash""")
def _(m):
    return M.merge_postings(m.job_postings, m.sql(POSTING_BATCH), parts=16)


@check("posting_conflicts", f"""
WITH {MOVED} SELECT company_id, CAST(sum(n - 1) AS BIGINT) AS conflicts FROM (
  SELECT company_id, content_hash, count(*) AS n FROM moved GROUP BY 1, 2) x WHERE n > 1 GROUP BY 1""")
def _(m):
    return M.posting_conflicts(m.job_postings, m.sql(POSTING_BATCH))


SAFE = """
SELECT company_id, crawl_run_id FROM (SELECT company_id, max(crawl_run_id) AS crawl_run_id, count(*) AS n,
  sum(CASE WHEN status = 'FAILED' THEN 1 ELSE 0 END) AS bad FROM $crawl_run_company_results GROUP BY company_id) s WHERE bad * 5 < n"""


@check("close_out_postings", f"""
SELECT p.* EXCLUDE (is_active), p.is_active AND (s.company_id IS NULL OR p.crawl_run_id IS NOT DISTINCT FROM s.crawl_run_id) AS is_active
FROM $job_postings p LEFT JOIN ({SAFE}) s ON s.company_id = p.company_id""")
def _(m):
    return M.close_out_postings(m.job_postings, m.sql(SAFE))


@check("purge_invalid_postings", """
SELECT * FROM $job_postings WHERE coalesce(canonical_url, '') NOT LIKE 'https://community.workday.com/invalid-url%'
  AND source_url NOT LIKE 'https://community.workday.com/invalid-url%'""")
def _(m):
    return M.purge_invalid_postings(m.job_postings)


WORKDAY_URLS = """
SELECT id, CASE WHEN id % 6 = 0 THEN concat('https://community.workday.com/invalid-url?from=myworkdayjobs.com/', CAST(id AS STRING))
  ELSE canonical_url END AS canonical_url FROM $job_postings"""


@check("invalid_posting_report", f"""
SELECT count(*) AS scanned, count(*) FILTER (WHERE canonical_url LIKE 'https://community.workday.com/invalid-url%') AS invalid, max(id) AS last_id
FROM ({WORKDAY_URLS}) x WHERE lower(canonical_url) LIKE '%workdayjobs%'""")
def _(m):
    return M.invalid_posting_report(m.sql(WORKDAY_URLS))


@check("delete_by_ids", """
SELECT * FROM $crawl_url_attempts WHERE id NOT IN (SELECT event_id FROM $events WHERE event_type = 'error')""")
def _(m):
    return M.delete_by_ids(m.crawl_url_attempts, m.sql("SELECT event_id AS id FROM $events WHERE event_type = 'error'"))


# known URLs hold one row per key, so start from the first seen
KNOWN_URLS = """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY crawl_run_id, company_id, url ORDER BY id) AS rn FROM $discovered_urls) k WHERE rn = 1"""
URL_BATCH = """
SELECT event_id AS ord, event_id AS id, CAST(year(ts) * 10000 + month(ts) * 100 + day(ts) AS BIGINT) AS crawl_run_id, user_id AS company_id,
  concat('https://d', CAST(user_id AS STRING), '.example.com/jobs/', CAST(event_id % 60 AS STRING)) AS url,
  CASE event_id % 3 WHEN 0 THEN 'ATS_API' ELSE 'OTHER' END AS url_type, CASE WHEN event_type = 'error' THEN 'http_500' END AS fetch_status,
  CASE WHEN value > 20 THEN TIMESTAMP '2024-02-01 00:00:00' END AS last_fetched_at, CASE WHEN value > 60 THEN 500 END AS http_status,
  CASE WHEN event_type = 'view' THEN 'gone' END AS error_code, CAST(NULL AS STRING) AS adapter FROM $events"""


@check("merge_discovered_urls", merged(f"({KNOWN_URLS}) q", URL_BATCH, ["crawl_run_id", "company_id", "url"], ["url_type"],
       ["fetch_status", "last_fetched_at", "http_status", "error_code", "adapter"], ["id"]))
def _(m):
    return M.merge_discovered_urls(m.sql(KNOWN_URLS).drop("rn"), m.sql(URL_BATCH))


@check("update_url_status", merged(f"({KNOWN_URLS}) q", URL_BATCH, ["crawl_run_id", "company_id", "url"], ["fetch_status", "last_fetched_at"],
       rest={c: "NULL" for c in ["id", "url_type", "http_status", "error_code", "adapter"]}, insert=False))
def _(m):
    return M.update_url_status(m.sql(KNOWN_URLS).drop("rn"), m.sql(URL_BATCH))


KNOWN_RESULTS = """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY crawl_run_id, company_id, stage, ats_type_key ORDER BY id) AS rn
  FROM $crawl_run_company_results) k WHERE rn = 1"""
RESULT_BATCH = """
SELECT event_id AS ord, 100000000 + event_id AS id, CAST(year(ts) * 10000 + month(ts) * 100 + day(ts) AS BIGINT) AS crawl_run_id, user_id AS company_id,
  CASE WHEN event_type = 'error' THEN 'FAILED' ELSE 'RUNNING' END AS status, CASE event_id % 3 WHEN 0 THEN 'JSONLD' ELSE 'ATS_ADAPTER' END AS stage,
  CASE event_id % 4 WHEN 0 THEN ' workday ' WHEN 1 THEN '' WHEN 2 THEN 'Lever' END AS ats_type,
  CASE WHEN event_id % 5 = 0 THEN 'https://e.example.com/' END AS endpoint_url, CAST(ts AS TIMESTAMP) AS started_at,
  TIMESTAMP '2024-02-01 00:00:00' AS finished_at, CAST(event_id AS BIGINT) AS duration_ms, 3 AS jobs_extracted, event_id % 2 = 0 AS truncated,
  CAST(NULL AS INT) AS total_jobs_available, 'COMPLETE' AS stop_reason, event_type AS reason_code, 200 AS http_status,
  concat(' detail ', event_type, ' ') AS error_detail, event_type = 'error' AS retryable FROM $events"""
RESULT_KEY = ["crawl_run_id", "company_id", "stage", "ats_type_key"]
KEYED = f"""SELECT *, CASE WHEN coalesce(trim(ats_type), '') = '' THEN 'NONE' ELSE upper(trim(ats_type)) END AS ats_type_key
  FROM ({RESULT_BATCH}) x"""


@check("merge_run_results_start", merged(f"({KNOWN_RESULTS}) q", KEYED, RESULT_KEY, ["status", "retryable"], ["ats_type", "endpoint_url"],
       ["id", "started_at"], {"finished_at": "NULL", "duration_ms": "NULL", "jobs_extracted": "0", "truncated": "false",
       "total_jobs_available": "NULL", "stop_reason": "NULL", "reason_code": "NULL", "http_status": "NULL", "error_detail": "NULL"}))
def _(m):
    return M.merge_run_results_start(m.sql(KNOWN_RESULTS).drop("rn"), m.sql(RESULT_BATCH))


@check("merge_run_results_finish", merged(f"({KNOWN_RESULTS}) q",
       KEYED.replace("SELECT *", "SELECT * EXCLUDE (error_detail), trim(error_detail) AS error_detail"), RESULT_KEY,
       ["status", "finished_at", "duration_ms", "jobs_extracted", "truncated", "total_jobs_available", "stop_reason", "reason_code",
        "http_status", "error_detail", "retryable"], ["ats_type", "endpoint_url"], ["id", "started_at"]))
def _(m):
    return M.merge_run_results_finish(m.sql(KNOWN_RESULTS).drop("rn"), m.sql(RESULT_BATCH))


DISCOVERY_BATCH = """
SELECT event_id AS ord, * FROM (SELECT event_id, CAST(8000000 + event_id AS BIGINT) AS id, CAST(20240101 + event_id % 40 AS BIGINT) AS discovery_run_id,
  user_id AS company_id, event_type AS status, CASE WHEN value > 50 THEN 'R' END AS reason_code, 'HOMEPAGE' AS stage, 1 AS found_endpoints_count,
  CAST(event_id AS BIGINT) AS duration_ms, 200 AS http_status, CAST(NULL AS STRING) AS error_detail, CAST(ts AS TIMESTAMP) AS created_at, true AS careers_url_found,
  CAST(NULL AS STRING) AS careers_url_initial, 'u' AS careers_url_final, 'm' AS careers_discovery_method, CAST(NULL AS STRING) AS careers_discovery_stage_failure,
  false AS vendor_detected, CAST(NULL AS STRING) AS vendor_name, false AS endpoint_extracted, CAST(NULL AS STRING) AS endpoint_url,
  CAST(NULL AS INT) AS http_status_first_failure, 2 AS request_count FROM $events) e"""
DISCOVERY_NEW = ["status", "reason_code", "stage", "found_endpoints_count", "duration_ms", "http_status", "error_detail", "created_at",
                 "careers_url_found", "careers_url_initial", "careers_url_final", "careers_discovery_method", "careers_discovery_stage_failure",
                 "vendor_detected", "vendor_name", "endpoint_extracted", "endpoint_url", "http_status_first_failure", "request_count"]


@check("merge_discovery_results", merged("$careers_discovery_company_results", DISCOVERY_BATCH, ["discovery_run_id", "company_id"],
                                         DISCOVERY_NEW, keep=["id"]))
def _(m):
    return M.merge_discovery_results(m.careers_discovery_company_results, m.sql(DISCOVERY_BATCH))


STATE_BATCH = """
SELECT event_id AS ord, user_id * 3 AS company_id, CAST(ts AS TIMESTAMP) AS last_attempt_at, CASE WHEN event_type = 'error' THEN 'discovery_fetch_failed' END AS last_reason_code,
  CAST(NULL AS STRING) AS last_candidate_url, CAST(event_id % 4 - 1 AS INT) AS consecutive_failures, CASE WHEN value > 50 THEN TIMESTAMP '2024-02-01 00:00:00' END AS next_attempt_at FROM $events"""


@check("merge_discovery_state", merged("$careers_discovery_state",
       f"SELECT * EXCLUDE (consecutive_failures), greatest(consecutive_failures, 0) AS consecutive_failures FROM ({STATE_BATCH}) b",
       ["company_id"], ["last_attempt_at", "last_reason_code", "last_candidate_url", "consecutive_failures", "next_attempt_at"]))
def _(m):
    return M.merge_discovery_state(m.careers_discovery_state, m.sql(STATE_BATCH))


HOST_BATCH = """
SELECT page_id AS ord, CASE WHEN page_id % 9 = 0 THEN ' ' WHEN page_id % 9 = 1 THEN concat('NEW', CAST(page_id AS STRING), '.Example.com')
  ELSE regexp_extract(url, '^https?://([^/?#]+)', 1) END AS host, CAST(page_id % 5 - 1 AS INT) AS consecutive_failures, 'TIMEOUT' AS last_error_category,
  TIMESTAMP '2024-02-01 00:00:00' AS last_attempt_at, CASE WHEN page_id % 2 = 0 THEN TIMESTAMP '2024-02-02 00:00:00' END AS next_allowed_at FROM $pages"""


@check("merge_host_state", merged("$host_crawl_state", f"""SELECT * EXCLUDE (host, consecutive_failures), lower(host) AS host,
       greatest(consecutive_failures, 0) AS consecutive_failures FROM ({HOST_BATCH}) b WHERE trim(host) <> ''""", ["host"],
       ["consecutive_failures", "last_error_category", "last_attempt_at", "next_allowed_at"]))
def _(m):
    return M.merge_host_state(m.host_crawl_state, m.sql(HOST_BATCH))


CACHE_BATCH = """
SELECT event_id AS ord, user_id * 12 AS id, 'CIK' AS domain_resolution_method, event_type AS domain_resolution_status,
  CASE WHEN event_type = 'error' THEN 'wdqs_error' END AS domain_resolution_error, CAST(ts AS TIMESTAMP) AS domain_resolution_attempted_at FROM $events"""


@check("update_resolution_cache", merged("$companies", CACHE_BATCH, ["id"], RESOLUTION,
       rest={c: "NULL" for c in ["ticker", "name", "sector", "wikipedia_title", "cik"]}, insert=False))
def _(m):
    return M.update_resolution_cache(m.companies, m.sql(CACHE_BATCH))


ENQUEUE_BATCH = """
SELECT page_id AS ord, page_id + 1000000 AS id, CASE page_id % 4 WHEN 0 THEN 'not a url at all' WHEN 1 THEN concat('https://new.example.com/p', CAST(page_id % 30 AS STRING))
    ELSE lower(url) END AS url, CASE WHEN page_id % 5 = 0 THEN 'SITEMAP' ELSE 'CANDIDATE' END AS url_kind, CAST(page_id % 120 - 10 AS INT) AS priority,
  CASE WHEN page_id % 3 <> 0 THEN TIMESTAMP '2024-01-05 00:00:00' + INTERVAL '1' HOUR * CAST(page_id % 50 AS INT) END AS next_fetch_at FROM $pages"""
# stored canonical form of the plain page URLs in this batch
PAGE_CANON = """regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''),
   '[?]utm_source=feed$', ''), '([^/])/$', '\\1'), 'page=2&ref=x', 'page=2&ref=x'), '^(https?://[^/]+)$', '\\1/')"""
STORED_URLS = """
SELECT id, url, host, regexp_replace(regexp_replace(regexp_replace(canonical_url, '#.*$', ''), '[?]utm_source=feed$', ''), '/$', '') AS canonical_url,
  url_kind, priority, next_fetch_at, status, last_fetch_at, last_error, locked_until, lock_owner, updated_at FROM $crawl_urls"""


@check("enqueue_urls", f"""
WITH batch AS (SELECT * EXCLUDE (priority, next_fetch_at), greatest(priority, 0) AS priority, coalesce(next_fetch_at, {NOW_SQL}) AS next_fetch_at,
    {PAGE_CANON} AS canonical_url, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM ({ENQUEUE_BATCH}) x WHERE strpos(url, ' ') = 0),
 f AS (SELECT canonical_url, first(url_kind ORDER BY ord) AS first_kind, max(CASE WHEN url_kind = 'SITEMAP' THEN 'SITEMAP' END) AS sitemap,
    first(url ORDER BY ord) AS url, first(host ORDER BY ord) AS host, max(priority) AS priority, min(next_fetch_at) AS next_fetch_at, first(id ORDER BY ord) AS id
    FROM batch GROUP BY 1)
SELECT coalesce(t.id, f.id) AS id, coalesce(t.url, f.url) AS url, coalesce(t.host, f.host) AS host, coalesce(t.canonical_url, f.canonical_url) AS canonical_url,
  coalesce(f.sitemap, t.url_kind, f.first_kind) AS url_kind, greatest(t.priority, f.priority) AS priority, least(t.next_fetch_at, f.next_fetch_at) AS next_fetch_at,
  CASE WHEN f.host IS NOT NULL AND t.status IN ('FAILED', 'BLOCKED') THEN 'QUEUED' ELSE coalesce(t.status, 'QUEUED') END AS status,
  t.last_fetch_at, t.last_error, t.locked_until, t.lock_owner, CASE WHEN f.host IS NULL THEN t.updated_at ELSE {NOW_SQL} END AS updated_at
FROM ({STORED_URLS}) t FULL JOIN f ON f.canonical_url = t.canonical_url""")
def _(m):
    return M.enqueue_urls(m.sql(STORED_URLS), m.sql(ENQUEUE_BATCH), NOW)


@check("ensure_hosts", f"""
WITH b AS (SELECT DISTINCT lower(trim(host)) AS host FROM ({HOST_BATCH}) x WHERE trim(host) <> '')
SELECT coalesce(h.host, b.host) AS host, CASE WHEN h.host IS NULL THEN {NOW_SQL} ELSE h.next_allowed_at END AS next_allowed_at,
  coalesce(h.backoff_state, 0) AS backoff_state, h.last_status_bucket, coalesce(h.inflight_count, 0) AS inflight_count,
  CASE WHEN b.host IS NULL THEN h.updated_at ELSE {NOW_SQL} END AS updated_at FROM $crawl_hosts h FULL JOIN b ON b.host = h.host""")
def _(m):
    return M.ensure_hosts(m.crawl_hosts, m.sql(HOST_BATCH), NOW)


OUTCOMES = """
SELECT page_id AS ord, page_id % 100 AS url_id, regexp_extract(lower(url), '^https?://([^/?#]+)', 1) AS host,
  CASE page_id % 3 WHEN 0 THEN 'FETCHED' WHEN 1 THEN 'FAILED' END AS url_status, CASE WHEN page_id % 3 = 1 THEN 'http_500' END AS last_error,
  CASE WHEN page_id % 4 <> 0 THEN TIMESTAMP '2024-01-31 00:00:00' END AS fetched_at, CAST(200 + page_id % 3 * 100 AS INT) AS http_status,
  page_id * 10 AS elapsed_ms, CASE WHEN page_id % 5 = 0 THEN 'timeout' END AS error_bucket,
  CASE WHEN page_id % 2 = 0 THEN TIMESTAMP '2024-02-01 01:00:00' END AS host_next_allowed_at, CAST(page_id % 6 - 1 AS INT) AS host_backoff_state,
  'HTTP_2XX' AS host_status_bucket FROM $pages"""
DONE_SQL = f"""SELECT ord, url_id AS id, coalesce(url_status, 'FAILED') AS status, coalesce(fetched_at, {NOW_SQL}) AS last_fetch_at, last_error,
  CAST(NULL AS TIMESTAMP) AS locked_until, CAST(NULL AS VARCHAR) AS lock_owner, {NOW_SQL} AS updated_at FROM ({OUTCOMES}) o"""


@check("apply_fetch_outcomes_urls", merged("$crawl_urls", DONE_SQL, ["id"],
       ["status", "last_fetch_at", "last_error", "locked_until", "lock_owner", "updated_at"],
       rest={c: "NULL" for c in ["url", "host", "canonical_url", "url_kind", "priority", "next_fetch_at"]}, insert=False))
def _(m):
    return M.apply_fetch_outcomes(m.crawl_urls, m.crawl_hosts, m.sql(OUTCOMES), NOW)[0]


@check("apply_fetch_outcomes_hosts", f"""
WITH g AS (SELECT host, last(coalesce(host_next_allowed_at, {NOW_SQL}) ORDER BY ord) AS n, last(greatest(host_backoff_state, 0) ORDER BY ord) AS s,
  last(host_status_bucket ORDER BY ord) AS b, count(*) AS c FROM ({OUTCOMES}) o GROUP BY 1)
SELECT h.host, CASE WHEN c IS NULL THEN h.next_allowed_at ELSE n END AS next_allowed_at, coalesce(s, h.backoff_state) AS backoff_state,
  CASE WHEN c IS NULL THEN h.last_status_bucket ELSE b END AS last_status_bucket,
  CASE WHEN c IS NULL THEN h.inflight_count ELSE CAST(greatest(h.inflight_count - c, 0) AS INT) END AS inflight_count,
  CASE WHEN c IS NULL THEN h.updated_at ELSE {NOW_SQL} END AS updated_at FROM $crawl_hosts h LEFT JOIN g ON g.host = h.host""")
def _(m):
    return M.apply_fetch_outcomes(m.crawl_urls, m.crawl_hosts, m.sql(OUTCOMES), NOW)[1]


@check("apply_fetch_outcomes_attempts", f"""
SELECT url_id, coalesce(fetched_at, {NOW_SQL}) AS fetched_at, http_status, elapsed_ms, error_bucket FROM ({OUTCOMES}) o""")
def _(m):
    return M.apply_fetch_outcomes(m.crawl_urls, m.crawl_hosts, m.sql(OUTCOMES), NOW)[2]


# companies that ran less often are not in the queue yet
PART_QUEUE = "SELECT * FROM $crawl_queue WHERE total_runs > 2"


@check("bootstrap_queue", f"""
SELECT c.id AS company_id, {NOW_SQL} AS next_run_at, q.locked_until, q.lock_owner, coalesce(q.lock_count, 0) AS lock_count, q.last_started_at,
  q.last_finished_at, q.last_success_at, q.last_error, coalesce(q.consecutive_failures, 0) AS consecutive_failures, coalesce(q.total_runs, 0) AS total_runs,
  coalesce(q.total_successes, 0) AS total_successes, coalesce(q.total_failures, 0) AS total_failures, {NOW_SQL} AS updated_at
FROM $companies c LEFT JOIN ({PART_QUEUE}) q ON q.company_id = c.id""")
def _(m):
    return M.bootstrap_queue(m.sql(PART_QUEUE), m.companies, NOW)


# company 3 never succeeds, so that failures alone are counted for it
QUEUE_OUTCOMES = """
SELECT event_id AS ord, user_id AS company_id, CASE event_type WHEN 'error' THEN 'FAILURE' WHEN 'view' THEN 'RELEASE' WHEN 'click' THEN 'FAILURE' ELSE 'SUCCESS' END AS outcome,
  CASE WHEN event_type <> 'view' THEN CAST(ts AS TIMESTAMP) + INTERVAL '1' HOUR END AS next_run_at, CASE WHEN event_type = 'error' THEN concat('boom ', CAST(event_id AS STRING)) END AS error
FROM $events WHERE user_id <> 3 OR event_type IN ('view', 'click')"""


@check("apply_queue_outcomes", f"""
WITH o AS ({QUEUE_OUTCOMES}), g AS (SELECT *, max(CASE WHEN outcome = 'SUCCESS' THEN ord END) OVER (PARTITION BY company_id) AS lastgood FROM o),
 s AS (SELECT company_id, count(*) FILTER (WHERE outcome <> 'RELEASE') AS runs, count(*) FILTER (WHERE outcome = 'SUCCESS') AS good,
   count(*) FILTER (WHERE outcome = 'FAILURE') AS bad, count(*) FILTER (WHERE outcome = 'FAILURE' AND (lastgood IS NULL OR ord > lastgood)) AS streak,
   last(next_run_at ORDER BY ord) FILTER (WHERE outcome <> 'RELEASE') AS nxt,
   last(CASE WHEN outcome = 'FAILURE' THEN error END ORDER BY ord) FILTER (WHERE outcome <> 'RELEASE') AS err FROM g GROUP BY 1)
SELECT q.company_id, CASE WHEN runs > 0 THEN nxt ELSE q.next_run_at END AS next_run_at, CASE WHEN s.company_id IS NULL THEN q.locked_until END AS locked_until,
  CASE WHEN s.company_id IS NULL THEN q.lock_owner END AS lock_owner, q.lock_count, q.last_started_at,
  CASE WHEN runs > 0 THEN {NOW_SQL} ELSE q.last_finished_at END AS last_finished_at, CASE WHEN good > 0 THEN {NOW_SQL} ELSE q.last_success_at END AS last_success_at,
  CASE WHEN runs > 0 THEN err ELSE q.last_error END AS last_error,
  CAST(CASE WHEN runs > 0 THEN CASE WHEN good > 0 THEN streak ELSE q.consecutive_failures + streak END ELSE q.consecutive_failures END AS INT) AS consecutive_failures,
  CAST(q.total_runs + coalesce(runs, 0) AS INT) AS total_runs, CAST(q.total_successes + coalesce(good, 0) AS INT) AS total_successes,
  CAST(q.total_failures + coalesce(bad, 0) AS INT) AS total_failures, CASE WHEN s.company_id IS NULL THEN q.updated_at ELSE {NOW_SQL} END AS updated_at
FROM $crawl_queue q LEFT JOIN s ON s.company_id = q.company_id""")
def _(m):
    return M.apply_queue_outcomes(m.crawl_queue, m.sql(QUEUE_OUTCOMES), NOW)


@check("append_failures", """
SELECT id, company_id, reason_code, candidate_url, detail, observed_at FROM $careers_discovery_failures
UNION ALL SELECT NULL, user_id, 'discovery_no_match', NULL, event_type, CAST(ts AS TIMESTAMP) FROM $events WHERE event_type = 'view'""")
def _(m):
    new = m.sql("""SELECT user_id AS company_id, 'discovery_no_match' AS reason_code, event_type AS detail, CAST(ts AS TIMESTAMP) AS observed_at,
        value AS ignored FROM $events WHERE event_type = 'view'""")
    return M.append_rows(m.careers_discovery_failures, new)


PROGRESS = """
SELECT event_id AS ord, CAST(year(ts) * 10000 + month(ts) * 100 + day(ts) AS BIGINT) AS id, CAST(event_id % 1000000000 AS INT) AS companies_attempted,
  CAST(event_id % 7 - 2 AS INT) AS jobs_extracted_count, CASE WHEN event_type = 'view' THEN CAST(ts AS TIMESTAMP) END AS last_heartbeat_at FROM $events"""


@check("update_run_progress", merged("$crawl_runs", f"SELECT * EXCLUDE (jobs_extracted_count), greatest(jobs_extracted_count, 0) AS jobs_extracted_count FROM ({PROGRESS}) p",
       ["id"], ["companies_attempted", "jobs_extracted_count"], ["last_heartbeat_at"],
       rest={c: "NULL" for c in ["started_at", "finished_at", "status", "notes", "companies_succeeded", "companies_failed"]}, insert=False))
def _(m):
    return M.update_run_progress(m.crawl_runs, m.sql(PROGRESS))


COMPLETIONS = """
SELECT max(event_id) AS ord, CAST(year(ts) * 10000 + month(ts) * 100 + day(ts) AS BIGINT) AS id, CAST(max(ts) AS TIMESTAMP) AS finished_at, 'COMPLETED' AS status,
  CASE WHEN max(value) > 200 THEN 'budget' END AS stop_reason FROM $events GROUP BY CAST(year(ts) * 10000 + month(ts) * 100 + day(ts) AS BIGINT)"""


@check("complete_runs", merged("$careers_discovery_runs", COMPLETIONS, ["id"], ["finished_at", "status"], ["stop_reason"],
       rest={"started_at": "NULL", "endpoints_added": "NULL", "processed_count": "NULL"}, insert=False))
def _(m):
    return M.complete_runs(m.careers_discovery_runs, m.sql(COMPLETIONS)).select(
        "id", "finished_at", "status", "stop_reason", "started_at", "endpoints_added", "processed_count")


@check("append_sitemaps", """
SELECT id, crawl_run_id, company_id, sitemap_url, fetched_at, url_count FROM $discovered_sitemaps
UNION ALL SELECT NULL, 20240131, page_id, url, TIMESTAMP '2024-01-31 00:00:00', 0 FROM $pages""")
def _(m):
    new = m.sql("SELECT CAST(20240131 AS BIGINT) AS crawl_run_id, page_id AS company_id, url AS sitemap_url, TIMESTAMP '2024-01-31 00:00:00' AS fetched_at, 0 AS url_count FROM $pages")
    return M.append_rows(m.discovered_sitemaps, new)
