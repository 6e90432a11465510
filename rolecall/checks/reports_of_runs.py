"""Funnels, roll-ups, snapshots and gates, each with its oracle."""

from pyspark.sql import functions as F

from rolecall.checks.lookups import LATEST_DOMAIN
from rolecall.checks.registry import check
from rolecall.operators import rollups as R
from rolecall.operators.targets import cohort_domain_state, missing_domain_cohort

AS_OF = "2024-01-31 00:00:00"
JOINED = f"""WITH {LATEST_DOMAIN}, j AS (SELECT r.*, coalesce(ld.source, 'NONE') AS domain_source, coalesce(ld.resolution_method, 'NONE') AS domain_resolution_method
  FROM $careers_discovery_company_results r LEFT JOIN latest_domains ld ON ld.company_id = r.company_id)"""


@check("source_funnel", f"{JOINED} SELECT * FROM j")
def _(m):
    return R.source_funnel(m.careers_discovery_company_results, m.company_domains)


@check("source_funnel_crosstab", f"""{JOINED} SELECT discovery_run_id, domain_source, domain_resolution_method, status, careers_url_found, vendor_detected,
  endpoint_extracted, count(*) AS total FROM j GROUP BY ALL""")
def _(m):
    return R.source_funnel_crosstab(m.careers_discovery_company_results, m.company_domains)


@check("source_funnel_summary", f"""{JOINED}, s AS (SELECT discovery_run_id, domain_source, count(*) AS attempted_count, count(*) FILTER (WHERE careers_url_found) AS careers_url_found_count,
  count(*) FILTER (WHERE vendor_detected) AS vendor_detected_count, count(*) FILTER (WHERE endpoint_extracted) AS endpoint_extracted_count,
  count(*) FILTER (WHERE status = 'SUCCEEDED') AS succeeded_count, count(*) FILTER (WHERE status = 'FAILED') AS failed_count FROM j GROUP BY 1, 2)
SELECT *, CAST(careers_url_found_count AS DOUBLE) / nullif(attempted_count, 0) AS careers_url_found_rate,
  CAST(vendor_detected_count AS DOUBLE) / nullif(careers_url_found_count, 0) AS vendor_detected_rate_among_found,
  CAST(endpoint_extracted_count AS DOUBLE) / nullif(vendor_detected_count, 0) AS endpoint_extracted_rate_among_vendor_detected FROM s""")
def _(m):
    return R.source_funnel_summary(m.careers_discovery_company_results, m.company_domains, places=None)


@check("stage_durations", """
SELECT discovery_run_id, stage, count(*) AS total, CAST(sum(duration_ms) AS BIGINT) AS total_duration_ms, avg(duration_ms) AS avg_duration_ms,
  min(duration_ms) AS min_duration_ms, max(duration_ms) AS max_duration_ms FROM $careers_discovery_company_results WHERE duration_ms IS NOT NULL GROUP BY 1, 2""")
def _(m):
    return R.stage_durations(m.careers_discovery_company_results)


@check("funnel_samples", """
SELECT r.*, c.ticker, c.name AS company_name FROM $careers_discovery_company_results r JOIN $companies c ON c.id = r.company_id
WHERE r.discovery_run_id = 20240112 ORDER BY r.created_at DESC, r.id DESC LIMIT 30""")
def _(m):
    return R.funnel_samples(m.careers_discovery_company_results, m.companies, 20240112, 30)


@check("failures_in_run_window", """
SELECT f.*, w.id AS discovery_run_id, r.stage, r.careers_discovery_method, r.careers_discovery_stage_failure, c.ticker, c.name AS company_name
FROM $careers_discovery_failures f JOIN $careers_discovery_runs w ON f.observed_at >= w.started_at
   AND f.observed_at <= coalesce(w.finished_at, TIMESTAMP '2024-01-31 00:00:00')
JOIN $companies c ON c.id = f.company_id
LEFT JOIN $careers_discovery_company_results r ON r.company_id = f.company_id AND r.discovery_run_id = w.id""")
def _(m):
    return R.failures_in_run_window(m.careers_discovery_failures, m.careers_discovery_runs,
                                    m.careers_discovery_company_results, m.companies, AS_OF)


EVIDENCE_FAILURES = """
SELECT f.id AS ord, f.company_id, f.reason_code, f.candidate_url, f.detail, r.careers_discovery_method FROM $careers_discovery_failures f
LEFT JOIN $careers_discovery_company_results r ON r.company_id = f.company_id
  AND r.discovery_run_id = CAST(year(f.observed_at) * 10000 + month(f.observed_at) * 100 + day(f.observed_at) AS BIGINT)"""
EVIDENCE_RESULTS = "SELECT *, id AS ord FROM $careers_discovery_company_results"


@check("attempt_evidence", f"""
WITH f AS (SELECT *, lower(regexp_extract(candidate_url, '^https?://([^/?#]*)', 1)) AS h,
    CASE WHEN regexp_extract(candidate_url, '^https?://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE lower(regexp_extract(candidate_url, '^https?://[^/?#]*([^?#]*)', 1)) END AS p
    FROM ({EVIDENCE_FAILURES}) x WHERE candidate_url <> ''),
 u AS (SELECT CASE WHEN h LIKE '%greenhouse.io%' OR h LIKE '%myworkdayjobs.com%' THEN 'vendor_probe_attempts' WHEN h LIKE 'careers.%' THEN 'subdomain_attempts'
    WHEN p LIKE '/careers%' AND coalesce(careers_discovery_method, '') <> 'HOMEPAGE_LINK' THEN 'fallback_path_attempts'
    WHEN p LIKE '/careers%' THEN 'careers_candidate_attempts'
    WHEN p = '/' AND (reason_code LIKE '%homepage%' OR careers_discovery_method = 'HOMEPAGE_LINK') THEN 'homepage_fetch_attempts' ELSE 'careers_candidate_attempts' END AS evidence_group,
    0 AS src, ord, 0 AS fld, company_id, candidate_url AS url, try_cast(nullif(regexp_extract(lower(coalesce(detail, '')), 'http_([0-9][0-9][0-9])', 1), '') AS INT) AS status_code, reason_code, detail FROM f
  UNION ALL SELECT 'careers_candidate_attempts', 1, ord, 0, company_id, careers_url_initial, coalesce(http_status, http_status_first_failure), reason_code, careers_discovery_stage_failure FROM ({EVIDENCE_RESULTS}) r WHERE careers_url_initial <> ''
  UNION ALL SELECT 'fallback_path_attempts', 1, ord, 1, company_id, careers_url_final, coalesce(http_status, http_status_first_failure), reason_code, careers_discovery_stage_failure FROM ({EVIDENCE_RESULTS}) r WHERE careers_url_final <> ''
  UNION ALL SELECT 'vendor_probe_attempts', 1, ord, 2, company_id, endpoint_url, coalesce(http_status, http_status_first_failure), reason_code, careers_discovery_stage_failure FROM ({EVIDENCE_RESULTS}) r WHERE endpoint_url <> '')
SELECT evidence_group, ord, company_id, url, status_code, reason_code, detail FROM (SELECT *, row_number() OVER (PARTITION BY evidence_group ORDER BY src, ord, fld) AS rn FROM u) x WHERE rn <= 20""")
def _(m):
    return R.attempt_evidence(m.sql(EVIDENCE_FAILURES), m.sql(EVIDENCE_RESULTS))


@check("failing_url_patterns", """
WITH f AS (SELECT id, candidate_url, concat(lower(regexp_extract(candidate_url, '^https?://([^/?#]*)', 1)), '/',
    split_part(lower(regexp_extract(candidate_url, '^https?://[^/?#]*([^?#]*)', 1)), '/', 2)) AS url_pattern,
    try_cast(nullif(regexp_extract(lower(coalesce(detail, '')), 'http_([0-9][0-9][0-9])', 1), '') AS INT) AS status FROM $careers_discovery_failures WHERE candidate_url IS NOT NULL)
SELECT url_pattern, status, count(*) AS total, min_by(candidate_url, id) AS sample_url FROM f GROUP BY 1, 2
ORDER BY total DESC, url_pattern, coalesce(CAST(status AS VARCHAR), 'ERR') LIMIT 20""")
def _(m):
    return R.failing_url_patterns(m.careers_discovery_failures.withColumn("ord", F.col("id")), 20)


STATUSES = """
SELECT r.id AS run_id, r.id AS batch, r.status, r.processed_count, r.succeeded_count, r.failed_count, r.selection_eligible_count, r.selection_returned_count,
  r.companies_input_count, r.companies_attempted_count, CASE WHEN r.cached_skip_count > 3 THEN r.cached_skip_count END AS cached_skip_count,
  f.careers_url_found_count, f.vendor_detected_count, f.endpoint_extracted_count FROM $careers_discovery_runs r
LEFT JOIN (SELECT discovery_run_id, sum(CASE WHEN careers_url_found THEN 1 ELSE 0 END) AS careers_url_found_count, sum(CASE WHEN vendor_detected THEN 1 ELSE 0 END) AS vendor_detected_count,
    sum(CASE WHEN endpoint_extracted THEN 1 ELSE 0 END) AS endpoint_extracted_count FROM $careers_discovery_company_results GROUP BY discovery_run_id) f ON f.discovery_run_id = r.id"""
SUMS = ["selection_eligible_count", "selection_returned_count", "companies_input_count", "companies_attempted_count", "cached_skip_count",
        "careers_url_found_count", "vendor_detected_count", "endpoint_extracted_count"]
ROLLED = f"""s AS (SELECT CAST(sum(processed_count) AS BIGINT) AS processed, CAST(sum(succeeded_count) AS BIGINT) AS succeeded, CAST(sum(failed_count) AS BIGINT) AS failed,
  {', '.join(f'CAST(coalesce(sum({c}), 0) AS BIGINT) AS {c}' for c in SUMS)} FROM ({STATUSES}) x)"""


@check("batch_rollup", f"""
WITH {ROLLED} SELECT *, CAST(succeeded AS DOUBLE) / processed AS success_rate, CAST(careers_url_found_count AS DOUBLE) / processed AS careers_url_found_rate,
  CAST(vendor_detected_count AS DOUBLE) / careers_url_found_count AS vendor_detected_rate_among_found,
  CAST(endpoint_extracted_count AS DOUBLE) / vendor_detected_count AS endpoint_extracted_rate_among_vendor_detected FROM s""")
def _(m):
    return R.batch_rollup(m.sql(STATUSES), None)


def with_maps(m):
    """Batches with their failure maps, as run artefacts carry them."""
    results = m.careers_discovery_company_results

    def as_map(column, rows):
        counts = rows.where(F.col(column).isNotNull()).groupBy("discovery_run_id", column).agg(F.count("*").cast("int").alias("n"))
        return counts.groupBy("discovery_run_id").agg(F.map_from_entries(F.collect_list(F.struct(column, "n"))).alias("m"))

    out = m.sql(STATUSES)
    for column, name, rows in [
        ("careers_discovery_stage_failure", "careers_stage_failures_by_reason", results),
        ("reason_code", "failures_by_reason", results.where("status = 'FAILED'")),
    ]:
        out = out.join(as_map(column, rows).select(F.col("discovery_run_id").alias("run_id"), F.col("m").alias(name)), "run_id", "left")
    return out


@check("batch_failures", """
SELECT 'careers_stage_failures_by_reason' AS kind, careers_discovery_stage_failure AS key, count(*) AS total FROM $careers_discovery_company_results
  WHERE careers_discovery_stage_failure IS NOT NULL GROUP BY 2
UNION ALL SELECT 'failures_by_reason', reason_code, count(*) FROM $careers_discovery_company_results WHERE status = 'FAILED' AND reason_code IS NOT NULL GROUP BY 2""")
def _(m):
    return R.batch_failures(with_maps(m))


@check("merged_top_errors", """
SELECT reason_code AS key, count(*) AS total FROM $careers_discovery_company_results WHERE status = 'FAILED' AND reason_code IS NOT NULL GROUP BY 1
ORDER BY total DESC, key LIMIT 3""")
def _(m):
    return R.merged_top_errors(with_maps(m).withColumnRenamed("failures_by_reason", "top_errors"), 3)


@check("top_n_map", "SELECT event_type AS key, count(*) AS total FROM $events GROUP BY 1 ORDER BY total DESC, key LIMIT 3")
def _(m):
    from rolecall.operators.diagnostics import top_n
    return top_n(m.events.groupBy(F.col("event_type").alias("key")).agg(F.count("*").alias("total")), 3)


@check("selection_metrics", f"""
SELECT batch, run_id, status, CAST(selection_eligible_count AS BIGINT) AS selection_eligible_count, CAST(selection_returned_count AS BIGINT) AS selection_returned_count,
  CAST(companies_input_count AS BIGINT) AS companies_input_count, CAST(companies_attempted_count AS BIGINT) AS companies_attempted_count,
  CAST(coalesce(cached_skip_count, 0) AS BIGINT) AS cached_skip_count, CAST(coalesce(vendor_detected_count, 0) AS BIGINT) AS vendor_detected_count,
  CAST(coalesce(endpoint_extracted_count, 0) AS BIGINT) AS endpoint_extracted_count, CAST(processed_count AS BIGINT) AS processed_count FROM ({STATUSES}) s""")
def _(m):
    return R.selection_metrics(m.sql(STATUSES))


RESOLVES = """
SELECT CAST(year(ts) * 10000 + month(ts) * 100 + day(ts) AS BIGINT) AS batch, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS resolved_count,
  sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS no_item_count, max(CAST(floor(value) AS INT)) AS wdqs_error_count,
  array('timeout', concat('e', CAST(day(min(ts)) % 7 AS STRING)), '') AS sample_errors FROM $events GROUP BY CAST(year(ts) * 10000 + month(ts) * 100 + day(ts) AS BIGINT)"""


@check("resolve_rollup", """
SELECT count(DISTINCT CAST(ts AS DATE)) AS batch_count, count(*) FILTER (WHERE event_type = 'purchase') AS resolved_count,
  count(*) FILTER (WHERE event_type = 'error') AS no_item_count FROM $events""")
def _(m):
    return R.resolve_rollup(m.sql(RESOLVES), ["resolved_count", "no_item_count"])


@check("distinct_sample_errors", """
WITH d AS (SELECT DISTINCT CAST(ts AS DATE) AS d FROM $events), t AS (SELECT d, 0 AS pos, 'timeout' AS error FROM d UNION ALL SELECT d, 1, concat('e', CAST(day(d) % 7 AS VARCHAR)) FROM d)
SELECT error FROM t GROUP BY 1 ORDER BY min((d, pos)) LIMIT 50""")
def _(m):
    return R.distinct_sample_errors(m.sql(RESOLVES), 50)


CYCLES = """
SELECT CAST(year(ts) * 10000 + month(ts) * 100 + day(ts) AS BIGINT) AS cycle, min(event_id) AS domains_before, max(event_id) AS domains_after, count(*) AS selection_eligible_count,
  count(DISTINCT user_id) AS selection_returned_count, count(DISTINCT user_id) AS companies_attempted_count, sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS vendor_detected_count,
  sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS endpoint_extracted_count FROM $events GROUP BY CAST(year(ts) * 10000 + month(ts) * 100 + day(ts) AS BIGINT)"""


@check("soak_report", f"""
SELECT count(*) AS cycles_completed, min_by(domains_before, cycle) AS domains_before, max_by(domains_after, cycle) AS domains_after,
  max_by(domains_after, cycle) - min_by(domains_before, cycle) AS domains_delta, CAST(sum(selection_eligible_count) AS BIGINT) AS selection_eligible_count,
  CAST(sum(selection_returned_count) AS BIGINT) AS selection_returned_count, CAST(sum(companies_attempted_count) AS BIGINT) AS companies_attempted_count,
  CAST(sum(vendor_detected_count) AS BIGINT) AS vendor_detected_count, CAST(sum(endpoint_extracted_count) AS BIGINT) AS endpoint_extracted_count FROM ({CYCLES}) c""")
def _(m):
    return R.soak_report(m.sql(CYCLES))


@check("soak_buckets", """
SELECT careers_discovery_stage_failure AS key, count(*) AS total FROM $careers_discovery_company_results WHERE careers_discovery_stage_failure IS NOT NULL
GROUP BY 1 ORDER BY total DESC, key LIMIT 10""")
def _(m):
    return R.soak_buckets(with_maps(m), "careers_stage_failures_by_reason")


@check("throughput", """
WITH d AS (SELECT *, (epoch_us(coalesce(finished_at, TIMESTAMP '2024-01-31 00:00:00')) - epoch_us(started_at)) / 1000000.0e0 AS s FROM $careers_discovery_runs)
SELECT id AS run_id, s AS duration_seconds, companies_attempted_count * 3600.0e0 / s AS companies_per_hour, endpoints_added * 3600.0e0 / s AS endpoints_per_hour,
  request_count_total * 3600.0e0 / s AS requests_per_hour FROM d""")
def _(m):
    return R.throughput(m.careers_discovery_runs, AS_OF, None)


NEW_ATTEMPTS, NEW_ENDPOINTS = 400, 700


@check("metric_snapshot", f"""
SELECT 'crawl_hosts_count' AS metric, '' AS dim1, '' AS dim2, count(*) AS value FROM $crawl_hosts
UNION ALL SELECT 'inflight_sum', '', '', CAST(sum(inflight_count) AS BIGINT) FROM $crawl_hosts
UNION ALL SELECT 'crawl_urls_count', '', '', count(*) FROM $crawl_urls
UNION ALL SELECT 'queued_total', '', '', count(*) FROM $crawl_urls WHERE status = 'QUEUED'
UNION ALL SELECT 'fetching_rows', '', '', count(*) FROM $crawl_urls WHERE status = 'FETCHING'
UNION ALL SELECT 'locked_rows', '', '', count(*) FROM $crawl_urls WHERE locked_until > TIMESTAMP '2024-01-15 00:00:00'
UNION ALL SELECT 'crawl_url_attempts_count', '', '', count(*) FROM $crawl_url_attempts
UNION ALL SELECT 'attempts_created_run_scope', '', '', count(*) FROM $crawl_url_attempts WHERE id > {NEW_ATTEMPTS}
UNION ALL SELECT 'ats_endpoints_count', '', '', count(*) FROM $ats_endpoints
UNION ALL SELECT 'ats_companies_count', '', '', count(DISTINCT company_id) FROM $ats_endpoints
UNION ALL SELECT 'ats_endpoints_created_run_scope', '', '', count(*) FROM $ats_endpoints WHERE id > {NEW_ENDPOINTS}
UNION ALL SELECT 'ats_companies_created_run_scope', '', '', count(DISTINCT company_id) FROM $ats_endpoints WHERE id > {NEW_ENDPOINTS}
UNION ALL SELECT 'crawl_urls_status', url_kind, status, count(*) FROM $crawl_urls GROUP BY 2, 3
UNION ALL SELECT * FROM (SELECT 'attempt_error_bucket_run_scope', coalesce(error_bucket, '<null>') AS d, '', count(*) AS n FROM $crawl_url_attempts WHERE id > {NEW_ATTEMPTS} GROUP BY 2 ORDER BY n DESC, d LIMIT 20) t
UNION ALL SELECT 'ats_type_total', ats_type, '', count(*) FROM $ats_endpoints GROUP BY 2
UNION ALL SELECT 'ats_type_created_run_scope', ats_type, '', count(*) FROM $ats_endpoints WHERE id > {NEW_ENDPOINTS} GROUP BY 2""")
def _(m):
    return R.metric_snapshot(m.crawl_hosts, m.crawl_urls, m.crawl_url_attempts, m.ats_endpoints, "2024-01-15 00:00:00", NEW_ATTEMPTS, NEW_ENDPOINTS, top_errors=20)


@check("scale_snapshot", """
SELECT 'crawl_hosts_count' AS metric, '' AS dim1, '' AS dim2, count(*) AS value FROM $crawl_hosts UNION ALL SELECT 'crawl_urls_count', '', '', count(*) FROM $crawl_urls
UNION ALL SELECT 'crawl_url_attempts_count', '', '', count(*) FROM $crawl_url_attempts UNION ALL SELECT 'companies_with_endpoint_count', '', '', count(DISTINCT company_id) FROM $ats_endpoints
UNION ALL SELECT 'endpoints_by_vendor', ats_type, '', count(*) FROM $ats_endpoints GROUP BY 2
UNION ALL SELECT 'endpoints_by_validation', CASE WHEN verified THEN 'validated' ELSE 'unvalidated' END, '', count(*) FROM $ats_endpoints GROUP BY 2
UNION ALL SELECT 'attempts_by_error_bucket', reason_code, '', count(*) FROM $careers_discovery_company_results WHERE discovery_run_id = 20240112 AND reason_code IS NOT NULL GROUP BY 2""")
def _(m):
    return R.scale_snapshot(m.crawl_hosts, m.crawl_urls, m.crawl_url_attempts, m.ats_endpoints, m.careers_discovery_company_results, 20240112)


SNAPSHOT = """SELECT 'ats_endpoints_count' AS metric, '' AS dim1, '' AS dim2, count(*) AS value FROM {0} UNION ALL SELECT 'companies_with_ats_endpoint_count', '', '', count(DISTINCT company_id) FROM {0}
UNION ALL SELECT 'companies_with_domain_count', '', '', count(DISTINCT company_id) FROM $company_domains UNION ALL SELECT 'endpoints_by_type', ats_type, '', count(*) FROM {0} GROUP BY 2"""
EARLIER = "(SELECT * FROM $ats_endpoints WHERE detected_at < TIMESTAMP '1999-01-01 00:00:00' AND ats_type <> 'TALEO') e"


@check("snapshot_metrics", SNAPSHOT.format("$ats_endpoints"))
def _(m):
    return R.snapshot_metrics(m.ats_endpoints, m.company_domains)


@check("snapshot_delta", f"""
WITH a AS ({SNAPSHOT.format(EARLIER)}), b AS ({SNAPSHOT.format('$ats_endpoints')})
SELECT coalesce(a.metric, b.metric) AS metric, coalesce(a.dim1, b.dim1) AS dim1, coalesce(a.dim2, b.dim2) AS dim2, coalesce(b.value, 0) - coalesce(a.value, 0) AS delta
FROM a FULL JOIN b ON a.metric = b.metric AND a.dim1 = b.dim1 AND a.dim2 = b.dim2""")
def _(m):
    old = m.ats_endpoints.where((F.col("detected_at") < F.lit("1999-01-01").cast("timestamp")) & (F.col("ats_type") != "TALEO"))
    ok = F.lit(True)
    return R.snapshot_delta(R.snapshot_metrics(old, m.company_domains).withColumn("ok", ok),
                            R.snapshot_metrics(m.ats_endpoints, m.company_domains).withColumn("ok", ok))


def cohort(m):
    """Companies without a cheap domain before, and their state with all domains after."""
    before = missing_domain_cohort(m.companies, m.company_domains.where("confidence >= 0.9"))
    return R.cohort_report(before, cohort_domain_state(m.companies, m.company_domains, before))


COHORT = f"""WITH {LATEST_DOMAIN}, co AS (SELECT c.id, c.domain_resolution_method FROM $companies c WHERE c.id NOT IN (SELECT company_id FROM $company_domains WHERE confidence >= 0.9)),
 rep AS (SELECT co.id AS company_id, ld.domain IS NOT NULL AS resolved, CASE WHEN ld.domain IS NOT NULL THEN coalesce(ld.resolution_method, co.domain_resolution_method, 'UNKNOWN') END AS resolved_by
   FROM co LEFT JOIN latest_domains ld ON ld.company_id = co.id)"""


@check("cohort_report", f"{COHORT} SELECT * FROM rep")
def _(m):
    return cohort(m)


@check("cohort_summary", f"""{COHORT} SELECT count(*) AS cohort_size, count(*) FILTER (WHERE resolved) AS resolved_count,
  CAST(count(*) FILTER (WHERE resolved) AS DOUBLE) / nullif(count(*), 0) AS resolution_rate FROM rep""")
def _(m):
    return R.cohort_summary(cohort(m), None)


@check("cohort_methods", f"{COHORT} SELECT resolved_by, count(*) AS total FROM rep WHERE resolved GROUP BY 1")
def _(m):
    return R.cohort_methods(cohort(m))


@check("release_gate", """
WITH v AS (SELECT (SELECT count(*) FROM $crawl_hosts) AS crawl_hosts_count, (SELECT count(*) FROM $crawl_urls) AS crawl_urls_count,
  (SELECT count(*) FROM $crawl_url_attempts WHERE id > 100) AS attempts_created_run_scope, (SELECT count(*) FROM $ats_endpoints WHERE id > 50) AS ats_endpoints_created_run_scope,
  (SELECT count(DISTINCT company_id) FROM $ats_endpoints WHERE id > 50) AS ats_companies_created_run_scope),
 w AS (SELECT *, attempts_created_run_scope / 20.0e0 AS attempts_per_minute FROM v),
 g AS (SELECT *, crawl_hosts_count >= 1000 AND crawl_urls_count >= 2000 AS frontier_pass, attempts_created_run_scope > 0 AND attempts_per_minute > 10 AS fetch_pass,
   ats_endpoints_created_run_scope > 0 AND ats_companies_created_run_scope > 0 AS ats_pass FROM w)
SELECT *, CASE WHEN frontier_pass AND fetch_pass AND ats_pass THEN 'GO' ELSE 'NO-GO' END AS decision FROM g""")
def _(m):
    snap = R.metric_snapshot(m.crawl_hosts, m.crawl_urls, m.crawl_url_attempts, m.ats_endpoints, AS_OF, 100, 50)
    return R.release_gate(snap, snap, snap, 1200)


@check("full_mode_gate", f"""
WITH {ROLLED} SELECT processed, CAST(succeeded AS DOUBLE) / processed AS success_rate, round(CAST(succeeded AS DOUBLE) / processed, 4) >= 0.45 AS threshold_pass, true AS insufficient_sample, false AS gate_pass,
  concat('insufficient_sample: vendor_probe_status_aborted', CASE WHEN processed < 20 THEN concat(', processed_below_minimum (', processed, ' < 20)') ELSE '' END) AS gate_reason,
  true AS run_full, true AS run_reduced_budget, 'insufficient_sample_reduced_budget_full_mode' AS decision_reason, 1 AS planned_batches, 50 AS planned_discover_batch_size FROM s""")
def _(m):
    return R.full_mode_gate(m.sql(STATUSES), batches=4, batch_size=100)


@check("full_mode_gate_forced", f"""
WITH {ROLLED.replace(') x)', ") x WHERE status <> 'ABORTED')")} SELECT processed, CAST(succeeded AS DOUBLE) / processed AS success_rate, round(CAST(succeeded AS DOUBLE) / processed, 4) >= 0.999 AS threshold_pass,
  false AS insufficient_sample, false AS gate_pass, concat('vendor_probe_success_rate_below_threshold (', round(CAST(succeeded AS DOUBLE) / processed, 4), ' < 0.999)') AS gate_reason, true AS run_full,
  false AS run_reduced_budget, 'forced_by_run_full_mode_flag' AS decision_reason, 4 AS planned_batches, 100 AS planned_discover_batch_size FROM s""")
def _(m):
    done = m.sql(STATUSES).where("status <> 'ABORTED'")
    return R.full_mode_gate(done, threshold=0.999, explicit=True, batches=4, batch_size=100)


@check("domain_bottleneck", """
SELECT r.id AS run_id, coalesce(n, 0) > 0 OR r.processed_count / 200.0e0 < 0.8 AS likely_domain_limited, coalesce(n, 0) AS no_domain_reason_count, r.processed_count / 200.0e0 AS processed_fill_rate
FROM $careers_discovery_runs r LEFT JOIN (SELECT discovery_run_id, count(*) AS n FROM $careers_discovery_company_results WHERE status = 'FAILED' AND lower(reason_code) LIKE '%domain%' GROUP BY 1) f
  ON f.discovery_run_id = r.id""")
def _(m):
    return R.domain_bottleneck(m.careers_discovery_company_results, m.careers_discovery_runs, 200, 0, 3)


@check("rate_limit_share", """
SELECT count(*) AS requests, count(*) FILTER (WHERE http_status = 429) AS rate_limited, CAST(count(*) FILTER (WHERE http_status = 429) AS DOUBLE) / count(*) AS rate FROM $crawl_url_attempts""")
def _(m):
    return R.rate_limit_share(m.crawl_url_attempts)


@check("step_errors", """
WITH a AS (SELECT reason_code AS key, count(*) AS total FROM $crawl_run_company_results WHERE status = 'FAILED' AND reason_code IS NOT NULL GROUP BY 1
  UNION ALL SELECT reason_code, count(DISTINCT company_id) FROM $careers_discovery_failures GROUP BY 1)
SELECT key, CAST(sum(total) AS BIGINT) AS total FROM (SELECT * FROM a UNION ALL SELECT 'HOST_COOLDOWN', total FROM a WHERE lower(key) LIKE '%host_cooldown%' AND key <> 'HOST_COOLDOWN') b GROUP BY 1""")
def _(m):
    from rolecall.operators.diagnostics import discovery_failures_by_reason
    failed = m.crawl_run_company_results.where("status = 'FAILED' AND reason_code IS NOT NULL")
    crawl = failed.groupBy(F.col("reason_code").alias("key")).agg(F.count("*").alias("total"))
    found = discovery_failures_by_reason(m.careers_discovery_failures).withColumnRenamed("reason_code", "key")
    return R.step_errors({"crawl": crawl, "discovery": found})
