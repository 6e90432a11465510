"""Diagnostics, run listings and frontier selection, each with its oracle."""

from pyspark.sql import functions as F

from rolecall.checks.registry import check
from rolecall.operators import diagnostics as D

AS_OF = "2024-01-31 00:00:00"
FRONTIER_AS_OF = "2024-01-15 00:00:00"
COUNTED = ["companies", "company_domains", "ats_endpoints", "crawl_runs", "discovered_urls", "job_postings"]
NAMES = "c.ticker, c.name AS company_name"


@check("table_counts", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS total FROM ${t}" for t in COUNTED))
def _(m):
    return D.table_counts({t: getattr(m, t) for t in COUNTED})


@check("endpoints_by_type", "SELECT ats_type, count(*) AS total FROM $ats_endpoints WHERE ats_type IS NOT NULL GROUP BY 1")
def _(m):
    return D.endpoints_by_type(m.ats_endpoints)


@check("endpoints_by_method", "SELECT detection_method, count(*) AS total FROM $ats_endpoints GROUP BY 1")
def _(m):
    return D.endpoints_by_method(m.ats_endpoints)


@check("endpoints_for_company", "SELECT count(*) AS total FROM $ats_endpoints WHERE company_id = 10")
def _(m):
    return D.endpoints_for_company(m.ats_endpoints, 10)


@check("discovery_failures_by_reason",
       "SELECT reason_code, count(DISTINCT company_id) AS total FROM $careers_discovery_failures GROUP BY 1")
def _(m):
    return D.discovery_failures_by_reason(m.careers_discovery_failures)


@check("stage_failures", """
SELECT discovery_run_id, careers_discovery_stage_failure, count(*) AS total
FROM $careers_discovery_company_results WHERE careers_discovery_stage_failure IS NOT NULL GROUP BY 1, 2""")
def _(m):
    return D.stage_failures(m.careers_discovery_company_results)


@check("run_funnel", """
SELECT discovery_run_id, count(*) FILTER (WHERE careers_url_found) AS careers_url_found_count,
       count(*) FILTER (WHERE vendor_detected) AS vendor_detected_count,
       count(*) FILTER (WHERE endpoint_extracted) AS endpoint_extracted_count
FROM $careers_discovery_company_results GROUP BY 1""")
def _(m):
    return D.run_funnel(m.careers_discovery_company_results)


@check("run_funnel_unknown_run", """
SELECT CAST(coalesce(sum(CASE WHEN careers_url_found THEN 1 ELSE 0 END), 0) AS BIGINT) AS careers_url_found_count,
       CAST(coalesce(sum(CASE WHEN vendor_detected THEN 1 ELSE 0 END), 0) AS BIGINT) AS vendor_detected_count,
       CAST(coalesce(sum(CASE WHEN endpoint_extracted THEN 1 ELSE 0 END), 0) AS BIGINT) AS endpoint_extracted_count
FROM $careers_discovery_company_results WHERE discovery_run_id = 19990101""")
def _(m):
    return D.run_funnel(m.careers_discovery_company_results, 19990101)


@check("discovery_company_failures_by_reason", """
SELECT discovery_run_id, reason_code, count(*) AS total FROM $careers_discovery_company_results
WHERE status = 'FAILED' AND reason_code IS NOT NULL GROUP BY 1, 2""")
def _(m):
    return D.company_failures_by_reason(m.careers_discovery_company_results, "discovery_run_id")


@check("crawl_company_failures_by_reason", """
SELECT crawl_run_id, reason_code, count(*) AS total FROM $crawl_run_company_results
WHERE status = 'FAILED' AND reason_code IS NOT NULL GROUP BY 1, 2""")
def _(m):
    return D.company_failures_by_reason(m.crawl_run_company_results, "crawl_run_id")


@check("ats_attempts_by_status", """
SELECT fetch_status, count(*) AS total FROM $discovered_urls
WHERE url_type = 'ATS_API' AND fetch_status IS NOT NULL GROUP BY 1""")
def _(m):
    return D.attempts_by_status(m.discovered_urls)


@check("run_companies_by_type", """
SELECT crawl_run_id, coalesce(ats_type, 'UNKNOWN') AS ats_type, count(DISTINCT company_id) AS total
FROM $crawl_run_company_results WHERE stage = 'ATS_ADAPTER' GROUP BY 1, 2""")
def _(m):
    return D.run_companies_by_type(m.crawl_run_company_results)


@check("run_jobs_by_type", """
SELECT crawl_run_id, coalesce(ats_type, 'UNKNOWN') AS ats_type,
       CAST(greatest(sum(coalesce(jobs_extracted, 0)), 0) AS BIGINT) AS total
FROM $crawl_run_company_results WHERE stage = 'ATS_ADAPTER' GROUP BY 1, 2""")
def _(m):
    return D.run_jobs_by_type(m.crawl_run_company_results)


@check("jobs_for_run", """
SELECT r.id AS crawl_run_id, count(p.last_seen_at) AS total
FROM $crawl_runs r LEFT JOIN $job_postings p ON p.crawl_run_id = r.id
  OR (p.crawl_run_id IS NULL AND p.last_seen_at >= r.started_at
      AND p.last_seen_at <= coalesce(r.finished_at, TIMESTAMP '2024-01-31 00:00:00'))
GROUP BY r.id""")
def _(m):
    return D.jobs_for_run(m.job_postings, m.crawl_runs, AS_OF)


@check("top_errors", """
SELECT fetch_status, count(*) AS total FROM $discovered_urls
WHERE crawl_run_id = 20240112 AND fetch_status IS NOT NULL AND fetch_status NOT IN ('discovered',
  'jobposting_found', 'ats_detected', 'ats_detected_probe_failed', 'ats_detected_from_hint',
  'ats_fetch_success', 'no_jobposting_structured_data', 'skipped_known_no_structured_data')
GROUP BY 1 ORDER BY total DESC, fetch_status LIMIT 5""")
def _(m):
    return D.top_errors(m.discovered_urls, 20240112, 5)


@check("run_activity_counts", """
SELECT r.id AS crawl_run_id, coalesce(u.n, 0) AS discovered_urls, coalesce(s.n, 0) AS discovered_sitemaps,
       coalesce(p.n, 0) AS job_postings
FROM $crawl_runs r
LEFT JOIN (SELECT crawl_run_id, count(*) AS n FROM $discovered_urls GROUP BY 1) u ON u.crawl_run_id = r.id
LEFT JOIN (SELECT crawl_run_id, count(*) AS n FROM $discovered_sitemaps GROUP BY 1) s ON s.crawl_run_id = r.id
LEFT JOIN (SELECT crawl_run_id, count(*) AS n FROM $job_postings GROUP BY 1) p ON p.crawl_run_id = r.id""")
def _(m):
    return D.run_activity_counts(m.crawl_runs, m.discovered_urls, m.discovered_sitemaps, m.job_postings)


@check("last_activity", """
SELECT crawl_run_id, max(moment) AS last_activity FROM (
  SELECT crawl_run_id, last_fetched_at AS moment FROM $discovered_urls
  UNION ALL SELECT crawl_run_id, fetched_at FROM $discovered_sitemaps
  UNION ALL SELECT crawl_run_id, last_seen_at FROM $job_postings WHERE crawl_run_id IS NOT NULL) a GROUP BY 1""")
def _(m):
    return D.last_activity(m.discovered_urls, m.discovered_sitemaps, m.job_postings)


@check("queue_stats", """
SELECT count(*) FILTER (WHERE next_run_at <= TIMESTAMP '2024-01-15 00:00:00'
         AND (locked_until IS NULL OR locked_until < TIMESTAMP '2024-01-15 00:00:00')) AS due_count,
       count(*) FILTER (WHERE locked_until > TIMESTAMP '2024-01-15 00:00:00') AS locked_count,
       min(next_run_at) AS next_due_at FROM $crawl_queue""")
def _(m):
    return D.queue_stats(m.crawl_queue, FRONTIER_AS_OF)


@check("queue_errors", """
SELECT company_id, last_error, last_finished_at, consecutive_failures FROM $crawl_queue
WHERE last_error IS NOT NULL ORDER BY last_finished_at DESC NULLS FIRST, company_id LIMIT 20""")
def _(m):
    return D.queue_errors(m.crawl_queue, 20)


@check("url_status_counts", "SELECT status, count(*) AS total FROM $crawl_urls GROUP BY 1")
def _(m):
    return D.url_status_counts(m.crawl_urls)


@check("domain_source_counts", """
SELECT source, count(*) AS total FROM (SELECT DISTINCT ON (company_id) company_id, source
  FROM $company_domains ORDER BY company_id, resolved_at DESC NULLS LAST, id DESC) x GROUP BY 1
UNION ALL SELECT NULL, count(DISTINCT company_id) FROM $company_domains""")
def _(m):
    return D.domain_source_counts(m.company_domains)


@check("crawl_run_id_null_split", """
SELECT count(*) FILTER (WHERE crawl_run_id IS NULL) AS crawl_run_id_null,
       count(*) FILTER (WHERE crawl_run_id IS NOT NULL) AS crawl_run_id_non_null FROM $job_postings""")
def _(m):
    return D.null_split(m.job_postings, "crawl_run_id")


@check("resolution_method_counts", """
SELECT resolution_method, count(*) AS total FROM $company_domains WHERE source = 'HEURISTIC' GROUP BY 1""")
def _(m):
    return D.resolution_method_counts(m.company_domains, "HEURISTIC")


@check("high_water_marks", """
SELECT 'crawl_url_attempts' AS table_name, max(id) AS max_id FROM $crawl_url_attempts
UNION ALL SELECT 'ats_endpoints', max(id) FROM $ats_endpoints
UNION ALL SELECT 'nothing', coalesce(max(id), 0) FROM $ats_endpoints WHERE id < 0""")
def _(m):
    return D.high_water_marks({
        "crawl_url_attempts": m.crawl_url_attempts, "ats_endpoints": m.ats_endpoints,
        "nothing": m.ats_endpoints.where("id < 0"),
    })


@check("active_runs", """
SELECT r.id AS crawl_run_id, r.started_at, r.last_heartbeat_at, a.last_activity FROM $crawl_runs r
LEFT JOIN (SELECT crawl_run_id, max(moment) AS last_activity FROM (
    SELECT crawl_run_id, last_fetched_at AS moment FROM $discovered_urls
    UNION ALL SELECT crawl_run_id, fetched_at FROM $discovered_sitemaps
    UNION ALL SELECT crawl_run_id, last_seen_at FROM $job_postings) x GROUP BY 1) a ON a.crawl_run_id = r.id
WHERE r.status = 'RUNNING' AND (r.started_at > TIMESTAMP '2024-01-30 18:00:00'
  OR a.last_activity > TIMESTAMP '2024-01-30 18:00:00' OR r.last_heartbeat_at > TIMESTAMP '2024-01-30 18:00:00')""")
def _(m):
    activity = D.last_activity(m.discovered_urls, m.discovered_sitemaps, m.job_postings)
    return D.active_runs(m.crawl_runs, activity, AS_OF, minutes=360)


@check("stale_runs", """
SELECT r.id AS crawl_run_id, r.started_at, TIMESTAMP '2024-01-31 00:00:00' AS finished_at,
       'ABORTED' AS status, 'aborted_on_startup_no_activity' AS notes
FROM $crawl_runs r WHERE r.status = 'RUNNING' AND r.started_at <= TIMESTAMP '2024-01-30 23:50:00'
  AND (r.last_heartbeat_at IS NULL OR r.last_heartbeat_at <= TIMESTAMP '2024-01-30 23:50:00')
  AND r.id NOT IN (SELECT crawl_run_id FROM $discovered_urls)
  AND r.id NOT IN (SELECT crawl_run_id FROM $discovered_sitemaps)
  AND r.id NOT IN (SELECT crawl_run_id FROM $job_postings WHERE crawl_run_id IS NOT NULL)""")
def _(m):
    counts = D.run_activity_counts(m.crawl_runs, m.discovered_urls, m.discovered_sitemaps, m.job_postings)
    return D.stale_runs(m.crawl_runs, counts, AS_OF)


@check("recent_runs", "SELECT id, started_at, finished_at, status FROM $crawl_runs ORDER BY started_at DESC, id DESC LIMIT 10")
def _(m):
    return D.recent_runs(m.crawl_runs, 10)


@check("latest_run", "SELECT id, started_at, finished_at, status FROM $crawl_runs ORDER BY started_at DESC, id DESC LIMIT 1")
def _(m):
    return D.latest_run(m.crawl_runs)


@check("running_runs", "SELECT id, started_at, finished_at, status FROM $crawl_runs WHERE status = 'RUNNING'")
def _(m):
    return D.running_runs(m.crawl_runs)


@check("run_by_id", "SELECT id, started_at, finished_at, status FROM $crawl_runs WHERE id = 20240112")
def _(m):
    return D.run_by_id(m.crawl_runs, 20240112)


@check("crawl_run_status", """
SELECT id, started_at, finished_at, status, companies_attempted, companies_succeeded, companies_failed,
       jobs_extracted_count, last_heartbeat_at FROM $crawl_runs""")
def _(m):
    return D.crawl_run_status(m.crawl_runs)


@check("discovery_run_status", """
SELECT id, status, stop_reason, CAST(json_extract(endpoints_found_homepage_json, '$.GREENHOUSE') AS INT) AS greenhouse,
       CAST(json_extract(endpoints_found_homepage_json, '$.LEVER') AS INT) AS lever,
       CAST(json_extract(endpoints_found_vendor_json, '$.WORKDAY') AS INT) AS workday
FROM $careers_discovery_runs""")
def _(m):
    return D.discovery_run_status(m.careers_discovery_runs).select(
        "id", "status", "stop_reason", F.col("endpoints_found_homepage")["GREENHOUSE"].alias("greenhouse"),
        F.col("endpoints_found_homepage")["LEVER"].alias("lever"),
        F.col("endpoints_found_vendor")["WORKDAY"].alias("workday"),
    )


@check("discovery_run_latest", "SELECT id, status, started_at FROM $careers_discovery_runs ORDER BY started_at DESC, id DESC LIMIT 1")
def _(m):
    return D.discovery_run_status(m.careers_discovery_runs, latest=True).select("id", "status", "started_at")


@check("canary_latest_of_type", "SELECT * FROM $canary_runs WHERE type = 'SEC' ORDER BY started_at DESC, id DESC LIMIT 1")
def _(m):
    return D.canary_status(m.canary_runs, run_type="SEC", latest=True)


@check("canary_by_id", "SELECT * FROM $canary_runs WHERE id = 20240105")
def _(m):
    return D.canary_status(m.canary_runs, run_id=20240105)


@check("endpoints_of_company", """
SELECT company_id, ats_type, ats_url, discovered_from_url, confidence, detected_at FROM $ats_endpoints WHERE company_id = 10""")
def _(m):
    return D.endpoints_of_company(m.ats_endpoints, 10)


@check("hosts_in_cooldown", """
SELECT * FROM $host_crawl_state WHERE next_allowed_at > TIMESTAMP '2024-01-30 00:30:00' ORDER BY next_allowed_at, host LIMIT 100""")
def _(m):
    return D.hosts_in_cooldown(m.host_crawl_state, "2024-01-30 00:30:00", 100)


@check("host_state", "SELECT * FROM $host_crawl_state WHERE host = 'm.ththth.example.net'")
def _(m):
    return D.host_state(m.host_crawl_state, "M.ththth.example.net")


@check("company_state", "SELECT * FROM $careers_discovery_state WHERE company_id = 12")
def _(m):
    return D.company_state(m.careers_discovery_state, 12)


@check("discovery_results_view", f"""
SELECT r.*, {NAMES} FROM $careers_discovery_company_results r JOIN $companies c ON c.id = r.company_id""")
def _(m):
    return D.company_results_view(m.careers_discovery_company_results, m.companies, "discovery_run_id", "created_at")


@check("discovery_results_view_top", f"""
SELECT r.*, {NAMES} FROM $careers_discovery_company_results r JOIN $companies c ON c.id = r.company_id
WHERE r.discovery_run_id = 20240112 AND r.status = 'FAILED' ORDER BY r.created_at DESC, r.id DESC LIMIT 20""")
def _(m):
    return D.company_results_view(m.careers_discovery_company_results, m.companies, "discovery_run_id",
                                  "created_at", 20240112, "FAILED", 20)


@check("crawl_results_view", f"""
SELECT r.*, {NAMES} FROM $crawl_run_company_results r JOIN $companies c ON c.id = r.company_id""")
def _(m):
    return D.company_results_view(m.crawl_run_company_results, m.companies, "crawl_run_id", "started_at")


@check("overall_company_results", f"""
SELECT r.* EXCLUDE (rn), {NAMES} FROM (SELECT *, row_number() OVER (PARTITION BY crawl_run_id, company_id ORDER BY
    CASE status WHEN 'RUNNING' THEN 4 WHEN 'SUCCEEDED' THEN 3 WHEN 'FAILED' THEN 2 WHEN 'SKIPPED' THEN 1 ELSE 0 END DESC,
    CASE stage WHEN 'ATS_ADAPTER' THEN 4 WHEN 'JSONLD' THEN 3 WHEN 'ROBOTS_SITEMAP' THEN 2 WHEN 'DOMAIN' THEN 1 ELSE 0 END DESC,
    CASE WHEN started_at IS NULL THEN 1 ELSE 0 END, started_at DESC, id DESC) AS rn FROM $crawl_run_company_results) r
JOIN $companies c ON c.id = r.company_id WHERE r.rn = 1 AND r.status = 'SUCCEEDED'""")
def _(m):
    return D.overall_company_results(m.crawl_run_company_results, m.companies, status="SUCCEEDED")


@check("recent_discovery_failures", f"""
SELECT {NAMES}, f.candidate_url, f.detail, f.observed_at, f.reason_code
FROM $careers_discovery_failures f JOIN $companies c ON c.id = f.company_id
ORDER BY f.observed_at DESC, f.id DESC LIMIT 20""")
def _(m):
    return D.recent_discovery_failures(m.careers_discovery_failures, m.companies, 20)


@check("recent_discovery_run_failures", f"""
SELECT {NAMES}, r.stage, r.reason_code, r.http_status, r.error_detail, r.created_at
FROM $careers_discovery_company_results r JOIN $companies c ON c.id = r.company_id
WHERE r.discovery_run_id = 20240112 AND r.status = 'FAILED' ORDER BY r.created_at DESC, r.id DESC LIMIT 50""")
def _(m):
    return D.recent_run_failures(m.careers_discovery_company_results, m.companies, "discovery_run_id",
                                 "created_at", 20240112, 50)


@check("recent_crawl_run_failures", f"""
SELECT {NAMES}, r.stage, r.reason_code, r.http_status, r.error_detail, r.finished_at
FROM $crawl_run_company_results r JOIN $companies c ON c.id = r.company_id
WHERE r.crawl_run_id = 20240112 AND r.status = 'FAILED' ORDER BY r.finished_at DESC NULLS LAST, r.id DESC LIMIT 50""")
def _(m):
    return D.recent_run_failures(m.crawl_run_company_results, m.companies, "crawl_run_id", "finished_at",
                                 20240112, 50, nulls_last=True)


@check("recent_api_failures", """
SELECT c.ticker, u.adapter AS ats_type, u.url, u.fetch_status, u.last_fetched_at
FROM $discovered_urls u JOIN $companies c ON c.id = u.company_id
WHERE u.url_type = 'ATS_API' AND u.fetch_status <> 'ats_fetch_success'
ORDER BY u.last_fetched_at DESC NULLS FIRST, u.id DESC LIMIT 20""")
def _(m):
    return D.recent_api_failures(m.discovered_urls, m.companies, 20)


DUE = """u.status = 'QUEUED' AND u.next_fetch_at <= TIMESTAMP '2024-01-15 00:00:00'
    AND (u.locked_until IS NULL OR u.locked_until < TIMESTAMP '2024-01-15 00:00:00')"""


@check("eligible_urls", f"""
SELECT u.id, u.url, u.host, u.canonical_url, u.url_kind, u.priority, u.next_fetch_at, u.status
FROM $crawl_urls u JOIN $crawl_hosts h ON h.host = u.host
WHERE u.url_kind = 'CANDIDATE' AND {DUE} AND h.inflight_count < 1
  AND (h.next_allowed_at IS NULL OR h.next_allowed_at <= TIMESTAMP '2024-01-15 00:00:00')""")
def _(m):
    return D.eligible_urls(m.crawl_urls, m.crawl_hosts, "CANDIDATE", FRONTIER_AS_OF)


@check("next_eligible_url", f"""
SELECT u.id, u.url, u.host, u.canonical_url, u.url_kind, u.priority, u.next_fetch_at, u.status
FROM $crawl_urls u JOIN $crawl_hosts h ON h.host = u.host
WHERE u.url_kind = 'SITEMAP' AND {DUE} AND h.inflight_count < 1
  AND (h.next_allowed_at IS NULL OR h.next_allowed_at <= TIMESTAMP '2024-01-15 00:00:00')
ORDER BY u.priority DESC, u.next_fetch_at, u.id LIMIT 1""")
def _(m):
    return D.eligible_urls(m.crawl_urls, m.crawl_hosts, "SITEMAP", FRONTIER_AS_OF, 1)


@check("blocked_url_count", f"""
SELECT count(*) AS total FROM $crawl_urls u JOIN $crawl_hosts h ON h.host = u.host
WHERE u.url_kind = 'CANDIDATE' AND {DUE} AND h.next_allowed_at > TIMESTAMP '2024-01-15 00:00:00'""")
def _(m):
    return D.blocked_url_count(m.crawl_urls, m.crawl_hosts, "CANDIDATE", FRONTIER_AS_OF)
