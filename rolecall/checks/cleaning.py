"""Normalising and classifying jobs, each with its oracle."""

from pyspark.sql import functions as F

from rolecall.checks.registry import check
from rolecall.operators import normalize as N

# URL parts of $raw_urls as DuckDB sees them; a blank inside makes a URL unparsable
PARTS = """
parts AS (SELECT *, lower(regexp_extract(w, '^([A-Za-z]+)://', 1)) AS scheme,
    regexp_extract(w, '^[A-Za-z]+://([^/?#]*)', 1) AS auth,
    regexp_extract(w, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS path,
    regexp_extract(w, '^[^?#]*[?]([^#]*)', 1) AS q
  FROM (SELECT pos, source, url, CASE WHEN regexp_matches(lower(trim(url)), '^https?://') THEN trim(url)
                     ELSE concat('https://', trim(url)) END AS w FROM $raw_urls) x
  WHERE strpos(w, ' ') = 0),
named AS (SELECT *, lower(regexp_replace(regexp_replace(auth, '^.*@', ''), ':[0-9]*$', '')) AS host,
    try_cast(nullif(regexp_extract(auth, ':([0-9]+)$', 1), '') AS INT) AS port FROM parts)"""

CANONICAL = PARTS + """,
pieces AS (SELECT *,
    regexp_replace(url_decode(replace(path, '+', '%2B')), '/{2,}', '/', 'g') AS p1,
    list_sort(list_filter(list_transform(list_filter(string_split(q, '&'), lambda x: trim(x) <> ''),
        lambda x: {'k': lower(url_decode(replace(split_part(x, '=', 1), '+', ' '))),
                   'v': url_decode(replace(CASE WHEN strpos(x, '=') > 0 THEN substr(x, strpos(x, '=') + 1) ELSE '' END, '+', ' '))}),
        lambda x: x.k NOT LIKE 'utm\\_%' ESCAPE '\\' AND x.k NOT IN ('gclid', 'fbclid', 'mc_cid', 'mc_eid', '_hsenc', '_hsmi'))) AS pairs
  FROM named WHERE host <> ''),
canon AS (SELECT pos, source, url, host, concat(scheme, '://', host,
    CASE WHEN port > 0 AND port <> CASE scheme WHEN 'http' THEN 80 ELSE 443 END THEN concat(':', port) ELSE '' END,
    CASE WHEN p1 = '' THEN '/' WHEN length(p1) > 1 AND right(p1, 1) = '/' THEN left(p1, length(p1) - 1) ELSE p1 END,
    CASE WHEN len(pairs) > 0 THEN concat('?', list_aggregate(list_transform(pairs,
        lambda x: concat(url_encode(x.k), '=', url_encode(x.v))), 'string_agg', '&')) ELSE '' END) AS canonical_url
  FROM pieces)"""


@check("canonicalize_urls", f"""
WITH {CANONICAL} SELECT pos, source, url, canonical_url, CASE WHEN strpos(canonical_url, ' ') = 0 THEN host END AS host
FROM (SELECT DISTINCT ON (canonical_url) * FROM canon ORDER BY canonical_url, pos) x""")
def _(m):
    return N.canonicalize_urls(m.raw_urls)


@check("url_hosts", """
SELECT host, min(pos) AS pos FROM (SELECT id AS pos, regexp_extract(lower(domain), '^([^/]+)', 1) AS host
  FROM $company_domains) x GROUP BY host""")
def _(m):
    return N.url_hosts(m.company_domains.select("domain", F.col("id").alias("pos")))


@check("seed_domains", """
WITH best AS (SELECT company_id, domain FROM (SELECT *, row_number() OVER (PARTITION BY company_id
    ORDER BY confidence DESC, CASE WHEN resolved_at IS NULL THEN 1 ELSE 0 END, resolved_at DESC, id DESC) AS rn
    FROM $company_domains) d WHERE rn = 1),
 listed AS (SELECT c.ticker, b.domain FROM $companies c JOIN best b ON b.company_id = c.id)
SELECT regexp_extract(lower(domain), '^([^/]+)', 1) AS host, min(ticker) AS pos FROM listed GROUP BY 1
ORDER BY min(ticker), 1 LIMIT 100""")
def _(m):
    from rolecall.operators.targets import seed_domains
    return seed_domains(m.companies, m.company_domains, 100)


LANDING = "(" + " OR ".join(f"strpos(host, '{h}') > 0" for h in [
    "workdayjobs", "greenhouse.io", "grnh.se", "jobs.lever.co", "api.lever.co", "apply.lever.co",
    "smartrecruiters.com", "icims.com", "taleo.net", "successfactors.com", "jobs.sap.com"]) + ")"

# these two take URLs as they are: no scheme means no host
STRICT = """
strict AS (SELECT *, lower(regexp_replace(regexp_replace(regexp_extract(url, '^[A-Za-z]*:?//([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', '')) AS host,
    lower(url_decode(regexp_extract(url, '^[A-Za-z]*:?//[^/?#]*([^?#]*)', 1))) AS path,
    lower(regexp_extract(url, '^[^?#]*[?]([^#]*)', 1)) AS q FROM $raw_urls)"""


@check("classify_discovered_urls", f"""
WITH {STRICT} SELECT pos, source, url, CASE WHEN host = '' OR strpos(trim(url), ' ') > 0 OR url <> trim(url) THEN 'OTHER'
    WHEN {LANDING} THEN 'ATS_LANDING'
    WHEN regexp_matches(path, '/careers|/jobs|/job|/openings|/positions|/job-search|/search-jobs') THEN 'CANDIDATE_JOB'
    ELSE 'OTHER' END AS url_type FROM strict""")
def _(m):
    return N.classify_discovered_urls(m.raw_urls)


@check("url_class_counts", f"""
WITH {STRICT} SELECT CASE WHEN host = '' OR strpos(trim(url), ' ') > 0 OR url <> trim(url) THEN 'OTHER'
    WHEN {LANDING} THEN 'ATS_LANDING'
    WHEN regexp_matches(path, '/careers|/jobs|/job|/openings|/positions|/job-search|/search-jobs') THEN 'CANDIDATE_JOB'
    ELSE 'OTHER' END AS url_type, count(*) AS total FROM strict GROUP BY 1""")
def _(m):
    return N.url_class_counts(m.raw_urls)


@check("job_like_urls", f"""
WITH {STRICT}, liked AS (SELECT pos, source, url FROM strict WHERE host <> '' AND url = trim(url) AND strpos(url, ' ') = 0
    AND NOT regexp_matches(concat(host, path), '[.](css|js|jpg|jpeg|png|gif|svg|ico|pdf|zip|xml|gz)$')
    AND ({LANDING} OR regexp_matches(path, '/careers|/career|/jobs|/job|/join-us|/opportunit|/vacanc|/open-positions|/work-with-us')
         OR strpos(q, 'job') > 0 OR strpos(q, 'career') > 0))
SELECT pos, source, url FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY pos) AS rn FROM liked) x WHERE rn <= 3""")
def _(m):
    return N.job_like_urls(m.raw_urls, 3)


@check("sanitize_posting_urls", """
SELECT * FROM $job_postings WHERE canonical_url IS NOT NULL
  AND strpos(lower(canonical_url), 'invalid-url') = 0
  AND source_url NOT LIKE 'https://community.workday.com/invalid-url%'""")
def _(m):
    return N.sanitize_posting_urls(m.job_postings)


@check("sanitize_api_urls", """
SELECT id FROM $job_postings WHERE source_url IS NOT NULL AND strpos(source_url, 'api.lever.co') = 0
  AND strpos(source_url, 'invalid-url') = 0""")
def _(m):
    rows = m.job_postings.select("id", F.col("source_url").alias("canonical_url"),
                                 F.lit("https://x.example.com/").alias("source_url"))
    return N.sanitize_posting_urls(rows).select("id")


RAW_ENDPOINTS = """
SELECT id, company_id, ats_type, detected_at,
       CASE id % 5 WHEN 0 THEN concat(' ', ats_url, '/ ') WHEN 1 THEN replace(ats_url, 'https://', '')
            WHEN 2 THEN concat(replace(ats_url, 'boards.', 'job-boards.'), CASE ats_type WHEN 'WORKDAY' THEN '.,' ELSE '?x=1' END)
            WHEN 3 THEN replace(ats_url, 'boards.greenhouse.io/', 'api.greenhouse.io/v1/boards/') ELSE ats_url END AS ats_url
FROM $ats_endpoints"""


@check("normalize_endpoints", f"""
WITH raw AS ({RAW_ENDPOINTS}),
 a AS (SELECT *, regexp_replace(trim(ats_url), '^https?://', '') AS rest FROM raw),
 b AS (SELECT *, lower(regexp_extract(rest, '^([^/?]+)', 1)) AS host, regexp_extract(rest, '^[^/?]+([^?]*)', 1) AS path FROM a),
 c AS (SELECT *, CASE WHEN ats_type = 'GREENHOUSE' AND host = 'api.greenhouse.io' THEN 'boards-api.greenhouse.io'
        WHEN ats_type = 'GREENHOUSE' AND host = 'job-boards.greenhouse.io' THEN 'boards.greenhouse.io' ELSE host END AS h2,
     CASE ats_type WHEN 'WORKDAY' THEN regexp_replace(path, '[.,;]+$', '') WHEN 'ICIMS' THEN '/jobs/search'
        WHEN 'TALEO' THEN '/careersection/x/jobsearch.ftl' WHEN 'SUCCESSFACTORS' THEN '/career' ELSE path END AS p2 FROM b),
 d AS (SELECT id, company_id, ats_type, detected_at, regexp_replace(concat('https://', h2, p2), '/$', '') AS ats_url FROM c)
SELECT * FROM (SELECT DISTINCT ON (company_id, ats_type, ats_url) * FROM d
  ORDER BY company_id, ats_type, ats_url, detected_at DESC, id DESC) x""")
def _(m):
    return N.normalize_endpoints(m.sql(RAW_ENDPOINTS))


@check("detect_vendors_by_url", f"""
WITH {PARTS} SELECT pos, CASE WHEN strpos(host, 'workdayjobs') > 0 THEN 'WORKDAY' WHEN strpos(host, 'greenhouse.io') > 0 THEN 'GREENHOUSE'
    ELSE 'UNKNOWN' END AS vendor FROM named WHERE host <> ''""")
def _(m):
    pages = N.detect_vendors(m.raw_urls.withColumn("url", F.trim("url")).withColumn("html", F.lit("")))
    return pages.where(~F.col("url").contains(" ") & ~F.col("url").startswith("//")).select("pos", "vendor")


VENDOR_PAGES = """
SELECT page_id, url, concat(html, CASE page_id % 9
    WHEN 0 THEN '<a href="https://Jobs.Lever.co/x">' WHEN 1 THEN '<script src="https://boards.greenhouse.io/embed/job_board?for=a">'
    WHEN 2 THEN '/WDAY/cxs/a/b' WHEN 3 THEN 'https://careers.icims.com/jobs' WHEN 4 THEN 'https://a.taleo.net/careersection/2'
    WHEN 5 THEN 'career2.successfactors.eu' WHEN 6 THEN 'api.smartrecruiters.com/v1/companies/a' ELSE '' END) AS html FROM $pages"""


@check("detect_vendors", f"""
SELECT *, CASE WHEN strpos(lower(html), 'workdayjobs') > 0 OR strpos(lower(html), '/wday/cxs/') > 0 THEN 'WORKDAY'
    WHEN strpos(lower(html), 'greenhouse.io') > 0 OR strpos(lower(html), 'grnh.se/') > 0 THEN 'GREENHOUSE'
    WHEN strpos(lower(html), 'lever.co') > 0 THEN 'LEVER' WHEN strpos(lower(html), 'smartrecruiters.com') > 0 THEN 'SMARTRECRUITERS'
    WHEN regexp_matches(lower(html), 'icims[.]com/jobs|careers[.]icims[.]com|jobs[.]icims[.]com') THEN 'ICIMS'
    WHEN regexp_matches(lower(html), 'taleo[.]net/careersection2?/') THEN 'TALEO'
    WHEN strpos(lower(html), 'successfactors') > 0 OR strpos(lower(html), 'jobs.sap.com') > 0 THEN 'SUCCESSFACTORS'
    ELSE 'UNKNOWN' END AS vendor FROM ({VENDOR_PAGES}) v""")
def _(m):
    return N.detect_vendors(m.sql(VENDOR_PAGES))


@check("normalize_candidate_urls", """
WITH v AS (SELECT pos, 0 AS variant, trim(url) AS w FROM $raw_urls WHERE regexp_matches(trim(url), '^https?://')
  UNION ALL SELECT pos, 0, concat('https:', CASE WHEN trim(url) LIKE '//%' THEN trim(url) ELSE concat('//', trim(url)) END)
    FROM $raw_urls WHERE NOT regexp_matches(trim(url), '^https?://')
  UNION ALL SELECT pos, 1, concat('http:', CASE WHEN trim(url) LIKE '//%' THEN trim(url) ELSE concat('//', trim(url)) END)
    FROM $raw_urls WHERE NOT regexp_matches(trim(url), '^https?://')),
 p AS (SELECT pos, variant, lower(regexp_extract(w, '^([A-Za-z]+)://', 1)) AS scheme,
    lower(regexp_replace(regexp_replace(regexp_extract(w, '^[A-Za-z]+://([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', '')) AS host,
    url_decode(replace(regexp_extract(w, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '+', '%2B')) AS path,
    list_filter(string_split(regexp_extract(w, '^[^?#]*[?]([^#]*)', 1), '&'), lambda x: trim(x) <> ''
        AND NOT regexp_matches(lower(split_part(x, '=', 1)), '^(utm_.*|ref|source|gh_src|lever-source)$')) AS kept
   FROM v WHERE strpos(w, ' ') = 0 AND NOT regexp_matches(w, '^https?://HTTP')),
 f AS (SELECT pos, variant, scheme, concat(scheme, '://', host, path,
    CASE WHEN len(kept) > 0 THEN concat('?', array_to_string(kept, '&')) ELSE '' END) AS full_url FROM p WHERE host <> ''),
 g AS (SELECT pos, variant, CASE WHEN right(full_url, 1) = '/' AND length(full_url) > length(scheme) + 5
    THEN left(full_url, length(full_url) - 1) ELSE full_url END AS candidate_url FROM f)
SELECT candidate_url, pos, variant FROM (SELECT DISTINCT ON (candidate_url) * FROM g ORDER BY candidate_url, pos, variant) x""")
def _(m):
    return N.normalize_candidate_urls(m.raw_urls.where(~F.trim("url").startswith("HTTP")))


@check("registrable_hosts", f"""
WITH {PARTS} SELECT pos, regexp_replace(host, '^www[.]', '') AS domain FROM named WHERE regexp_matches(trim(url), '^https?://')""")
def _(m):
    rows = N.registrable_hosts(m.raw_urls).where(F.trim("url").rlike("^https?://"))
    return rows.where(F.col("domain").isNotNull()).select("pos", "domain")


STATUS_CASE = """CASE WHEN {0} IN (401, 403) THEN 'HTTP_401_403' WHEN {0} = 404 THEN 'HTTP_404' WHEN {0} = 408 THEN 'TIMEOUT'
    WHEN {0} = 429 THEN 'HTTP_429_RATE_LIMIT' WHEN {0} BETWEEN 500 AND 599 THEN 'HTTP_5XX' ELSE 'UNKNOWN' END"""
EMBEDDED = """try_cast(nullif(regexp_extract(CASE WHEN strpos(k, 'http_') > 0 THEN
    regexp_extract(k, '^.*http_(.*)$', 1) ELSE '' END, '^([0-9]+)', 1), '') AS INT)"""
KEY_CASE = f"""CASE WHEN k LIKE '%blocked_by_robots%' THEN 'ROBOTS_BLOCKED' WHEN k LIKE '%host_cooldown%' THEN 'HOST_COOLDOWN'
    WHEN regexp_matches(k, 'no_sitemaps|sitemap_no_urls|no_candidate_urls|sitemap_fetch_failed') THEN 'SITEMAP_NOT_FOUND'
    WHEN regexp_matches(k, 'no_jobposting|ats_detected_no_endpoint') THEN 'ATS_NOT_FOUND'
    WHEN regexp_matches(k, 'parse|invalid_payload|gzip_decode_error|empty_sitemap_payload') THEN 'PARSING_FAILED'
    WHEN regexp_matches(k, 'time_budget|budget_exceeded|timeout') THEN 'TIMEOUT'
    ELSE {STATUS_CASE.format('e')} END"""


@check("reason_codes", f"""
WITH x AS (SELECT *, lower(error_key) AS k FROM $failure_keys), y AS (SELECT *, {EMBEDDED} AS e FROM x),
z AS (SELECT id, http_status, error_code, error_message, error_key, e AS embedded_status,
  {STATUS_CASE.format('http_status')} AS status_reason,
  CASE WHEN lower(error_code) LIKE '%timeout%' THEN 'TIMEOUT'
       WHEN lower(error_code) LIKE '%io_error%' AND regexp_matches(lower(coalesce(error_message, '')), 'unknownhost|name or service not known|no such host') THEN 'DNS_FAILURE'
       WHEN lower(error_code) LIKE '%io_error%' AND regexp_matches(lower(coalesce(error_message, '')), 'ssl|handshake') THEN 'TLS_FAILURE'
       ELSE 'UNKNOWN' END AS error_reason, {KEY_CASE} AS reason_code FROM y)
SELECT *, reason_code IN ('TIMEOUT', 'DNS_FAILURE', 'TLS_FAILURE', 'HTTP_429_RATE_LIMIT', 'HTTP_5XX') AS retryable FROM z""")
def _(m):
    return N.reason_codes(m.failure_keys)


@check("map_discovery_failures", f"""
WITH x AS (SELECT *, lower(detail) AS k FROM $careers_discovery_failures), y AS (SELECT *, {EMBEDDED} AS e FROM x)
SELECT id, CASE reason_code WHEN 'discovery_homepage_blocked_by_robots' THEN 'ROBOTS_BLOCKED'
    WHEN 'discovery_sitemap_no_urls' THEN 'SITEMAP_NOT_FOUND' WHEN 'discovery_host_cooldown' THEN 'HOST_COOLDOWN'
    WHEN 'discovery_time_budget_exceeded' THEN 'TIMEOUT' WHEN 'discovery_no_domain' THEN 'NO_DOMAIN'
    WHEN 'discovery_ats_detected_no_endpoint' THEN 'ATS_NOT_FOUND' WHEN 'discovery_no_match' THEN 'ATS_NOT_FOUND'
    WHEN 'discovery_fetch_failed' THEN CASE WHEN e IS NOT NULL THEN {STATUS_CASE.format('e')} ELSE {KEY_CASE} END
    ELSE 'UNKNOWN' END AS mapped_reason,
  CASE reason_code WHEN 'discovery_homepage_blocked_by_robots' THEN 'HOMEPAGE' WHEN 'discovery_sitemap_no_urls' THEN 'SITEMAP'
    WHEN 'discovery_host_cooldown' THEN 'COOLDOWN' WHEN 'discovery_time_budget_exceeded' THEN 'BUDGET'
    WHEN 'discovery_no_domain' THEN 'DOMAIN' WHEN 'discovery_ats_detected_no_endpoint' THEN 'ATS_DETECTED'
    ELSE 'PAGE_SCAN' END AS stage,
  CASE WHEN reason_code = 'discovery_fetch_failed' THEN e END AS http_status FROM y""")
def _(m):
    rows = N.map_discovery_failures(m.careers_discovery_failures)
    return rows.select("id", "mapped_reason", "stage", "http_status")


@check("failure_types", """
WITH c AS (SELECT error_key AS reason, lower(trim(error_key)) AS k, count(*) AS total FROM $failure_keys GROUP BY 1, 2),
 t AS (SELECT total, CASE WHEN k IS NULL OR k = '' THEN 'unknown' WHEN k LIKE '%host_cooldown%' THEN 'host_cooldown' WHEN k LIKE '%robot%' THEN 'robots'
    WHEN regexp_matches(k, 'time_budget|budget_exceeded|timeout') THEN 'timeout'
    WHEN regexp_matches(k, 'parse|invalid_payload|gzip_decode|empty_sitemap_payload') THEN 'parse_miss'
    WHEN regexp_matches(k, 'unknownhost|name or service not known|dns') THEN 'dns' WHEN regexp_matches(k, 'ssl|tls|handshake') THEN 'tls'
    WHEN regexp_matches(k, 'no_sitemaps|sitemap_no_urls|sitemap_fetch_failed|sitemap_not_found') THEN 'sitemap_not_found'
    WHEN regexp_matches(k, 'no_jobposting|ats_detected_no_endpoint|ats_not_found') THEN 'ats_not_found'
    WHEN regexp_matches(k, 'http[_ ]?(401|403)') THEN 'http_401_403' WHEN regexp_matches(k, 'http_404') THEN 'http_404'
    WHEN regexp_matches(k, 'http_429') THEN 'http_429_rate_limit' WHEN regexp_matches(k, 'http_5[0-9][0-9]') THEN 'http_5xx'
    WHEN regexp_matches(k, 'http[_ ]?[0-9]{3}') THEN 'http_other' ELSE 'other' END AS failure_type FROM c)
SELECT failure_type, CAST(sum(total) AS BIGINT) AS total FROM t GROUP BY 1 ORDER BY total DESC, failure_type LIMIT 10""")
def _(m):
    counts = m.failure_keys.groupBy(F.col("error_key").alias("reason")).agg(F.count("*").alias("total"))
    return N.failure_types(counts, 10)


@check("status_buckets", """
SELECT CASE WHEN http_status BETWEEN 200 AND 299 THEN 'HTTP_2XX' WHEN http_status = 429 THEN 'HTTP_429'
    WHEN http_status = 403 THEN 'HTTP_403' WHEN http_status >= 500 THEN 'HTTP_5XX' WHEN http_status >= 400 THEN 'HTTP_4XX'
    WHEN lower(coalesce(error_bucket, '')) LIKE '%timeout%' THEN 'ERROR_TIMEOUT' ELSE 'ERROR' END AS bucket, count(*) AS total
FROM $crawl_url_attempts GROUP BY 1""")
def _(m):
    return N.status_buckets(m.crawl_url_attempts)


PROBES = """
SELECT id, CASE id % 3 WHEN 0 THEN 'HOMEPAGE_LINK' WHEN 1 THEN 'PATH_GUESS' ELSE 'SUBDOMAIN_GUESS' END AS method,
       CASE WHEN id % 7 = 0 THEN 404 ELSE http_status END AS http_status,
       CASE id % 11 WHEN 1 THEN 'io_ssl' WHEN 2 THEN 'DNS_fail' WHEN 3 THEN 'read_timeout' WHEN 4 THEN 'invalid_url' WHEN 5 THEN '' END AS error_code,
       CAST(id % 9 AS INT) AS hops, id % 13 <> 0 AS robots_allowed,
       CASE WHEN id % 4 = 0 THEN 'LEVER' WHEN id % 4 = 1 THEN 'UNKNOWN' END AS vendor
FROM $crawl_url_attempts"""


@check("landing_failure_reasons", f"""
SELECT *, CASE WHEN NOT robots_allowed THEN 'BOT_PROTECTION_403' WHEN hops > 5 THEN 'REDIRECT_CHAIN_TOO_LONG'
    WHEN http_status = 403 THEN 'BOT_PROTECTION_403' WHEN http_status = 429 THEN 'RATE_LIMIT_429'
    WHEN error_code = 'io_ssl' THEN 'TLS_ERROR' WHEN error_code = 'DNS_fail' THEN 'DNS_ERROR' WHEN error_code <> '' THEN 'NETWORK_ERROR'
    WHEN vendor = 'LEVER' THEN NULL WHEN http_status = 200 THEN 'CAREERS_PAGE_200_NO_VENDOR_SIGNATURE'
    WHEN http_status = 404 AND method = 'SUBDOMAIN_GUESS' THEN 'SUBDOMAIN_PROBES_404'
    WHEN http_status = 404 THEN 'ALL_COMMON_PATHS_404' END AS failure_reason FROM ({PROBES}) p""")
def _(m):
    return N.landing_failure_reasons(m.sql(PROBES))


FAILED_ATTEMPTS = """
SELECT f.id, f.company_id, f.reason_code, f.candidate_url, f.detail, f.observed_at, r.careers_discovery_method, r.http_status
FROM $careers_discovery_failures f LEFT JOIN $careers_discovery_company_results r ON r.company_id = f.company_id
  AND r.discovery_run_id = CAST(year(f.observed_at) * 10000 + month(f.observed_at) * 100 + day(f.observed_at) AS BIGINT)"""
HOST_PATH = """lower(regexp_extract(coalesce(candidate_url, ''), '^https?://([^/?#]*)', 1)) AS h,
    CASE WHEN candidate_url IS NULL THEN '' WHEN regexp_extract(candidate_url, '^https?://[^/?#]*([^?#]*)', 1) = '' THEN '/'
         ELSE lower(regexp_extract(candidate_url, '^https?://[^/?#]*([^?#]*)', 1)) END AS p"""


@check("attempt_stages", f"""
SELECT id, CASE WHEN h LIKE '%greenhouse.io%' OR h LIKE '%myworkdayjobs.com%' THEN 'vendor_probe_attempts'
    WHEN h LIKE 'careers.%' OR h LIKE 'jobs.%' THEN 'subdomain_attempts'
    WHEN (p LIKE '/careers%' OR p LIKE '/jobs%') AND coalesce(careers_discovery_method, '') <> 'HOMEPAGE_LINK' THEN 'fallback_path_attempts'
    WHEN p LIKE '/careers%' OR p LIKE '/jobs%' THEN 'careers_candidate_attempts'
    WHEN p IN ('', '/') AND (reason_code LIKE '%homepage%' OR careers_discovery_method = 'HOMEPAGE_LINK') THEN 'homepage_fetch_attempts'
    ELSE 'careers_candidate_attempts' END AS attempt_stage
FROM (SELECT *, {HOST_PATH} FROM ({FAILED_ATTEMPTS}) a) b""")
def _(m):
    return N.attempt_stages(m.sql(FAILED_ATTEMPTS)).select("id", "attempt_stage")


@check("url_patterns", f"""
SELECT id, CASE WHEN h <> '' THEN concat(h, '/', split_part(p, '/', 2)) END AS url_pattern,
       coalesce(http_status, try_cast(nullif(regexp_extract(lower(coalesce(detail, '')), 'http_([0-9][0-9][0-9])', 1), '') AS INT)) AS status_code
FROM (SELECT *, {HOST_PATH} FROM ({FAILED_ATTEMPTS}) a) b""")
def _(m):
    return N.url_patterns(m.sql(FAILED_ATTEMPTS), ["http_status"]).select("id", "url_pattern", "status_code")


@check("stop_reasons", """
SELECT id, trim(error_detail) AS error_detail, CASE WHEN status <> 'FAILED' THEN 'COMPLETE'
    WHEN regexp_matches(coalesce(error_detail, ''), 'time_budget|budget_exceeded') THEN 'TIME_BUDGET' ELSE 'ERROR' END AS stop_reason
FROM $crawl_run_company_results""")
def _(m):
    return N.stop_reasons(m.crawl_run_company_results).select("id", "error_detail", "stop_reason")


@check("discovery_validation", """
SELECT id, CASE WHEN endpoint_extracted AND endpoint_url IS NOT NULL THEN 'VALIDATED' WHEN vendor_name IS NOT NULL THEN 'UNVALIDATED'
    WHEN reason_code IS NOT NULL THEN 'FAILED' ELSE 'NOT_FOUND' END AS validation_status,
  upper(trim(vendor_name)) AS result_vendor, CASE WHEN endpoint_extracted THEN endpoint_url END AS result_endpoint_url,
  coalesce(lower(careers_discovery_method), 'none') AS evidence,
  CASE WHEN endpoint_extracted AND endpoint_url IS NOT NULL THEN NULL ELSE reason_code END AS error_bucket
FROM $careers_discovery_company_results""")
def _(m):
    return N.discovery_validation(m.careers_discovery_company_results).select(
        "id", "validation_status", "result_vendor", "result_endpoint_url", "evidence", "error_bucket")


@check("plain_descriptions", "SELECT id, description_plain FROM $job_postings")
def _(m):
    return N.plain_descriptions(m.job_postings).select("id", "description_plain")


@check("tag_free_descriptions", """
SELECT id, regexp_replace(description_text, '<[^>]*>', ' ', 'g') AS description_plain FROM $job_postings""")
def _(m):
    rows = m.job_postings.withColumn("description_plain", F.lit(None).cast("string"))
    return N.tag_free_descriptions(rows).select("id", "description_plain")


@check("plain_page_text", """
WITH a AS (SELECT page_id, regexp_replace(html, '(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>', ' ', 'g') AS t FROM $pages),
 i AS (SELECT page_id, regexp_replace(t, '(?s)<!--.*?-->|</?[ab](\\s[^>]*)?>', '', 'g') AS t FROM a),
 b AS (SELECT page_id, regexp_replace(t, '<[^>]*>', ' ', 'g') AS t FROM i),
 c AS (SELECT page_id, replace(replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'),
    '&nbsp;', ' '), '&middot;', '·'), '&copy;', '©'), '&amp;', '&') AS t
    FROM (SELECT page_id, regexp_replace(t, '&amp($|[^a-zA-Z0-9;])', '&amp;\\1', 'g') AS t FROM b) o)
SELECT page_id AS id, trim(regexp_replace(replace(t, chr(160), ' '), '\\s+', ' ', 'g')) AS description_plain FROM c""")
def _(m):
    rows = m.pages.select(F.col("page_id").alias("id"), F.col("html").alias("description_text"))
    return N.plain_descriptions(rows).select("id", "description_plain")


@check("content_hashes", """
SELECT id, sha256(concat('{"canonical_url":"', coalesce(canonical_url, ''), '","date_posted":"', CAST(date_posted AS VARCHAR),
  '","description":"', description_text, '","employment_type":"', employment_type, '","identifier":"', trim(coalesce(external_identifier, '')),
  '","location_text":"', coalesce(location_text, ''), '","org_name":"', coalesce(org_name, ''), '","title":"', title, '"}')) AS content_hash
FROM $job_postings""")
def _(m):
    return N.content_hashes(m.job_postings).select("id", "content_hash")


RAW_COMPANIES = """
SELECT event_id AS pos, CASE event_id % 9 WHEN 0 THEN NULL WHEN 1 THEN '  ' ELSE concat(' t', CAST(user_id AS STRING), '[1] ') END AS ticker,
       CASE WHEN event_id % 10 = 3 THEN '' ELSE concat('Company ', CAST(user_id AS STRING), event_type, ' [note 2]') END AS name,
       CASE WHEN event_id % 2 = 0 THEN event_type END AS sector,
       CASE event_id % 4 WHEN 0 THEN concat('CIK ', CAST(user_id AS STRING)) WHEN 1 THEN 'none' WHEN 2 THEN concat('12345', '67890', CAST(user_id AS STRING)) END AS cik,
       CASE WHEN event_id % 3 = 0 THEN concat('Page_', CAST(event_id AS STRING)) END AS wikipedia_title
FROM $events"""


@check("normalize_companies", f"""
WITH r AS (SELECT pos, upper(trim(replace(ticker, '[1]', ''))) AS ticker, trim(replace(name, '[note 2]', '')) AS name, sector,
    CASE WHEN regexp_replace(cik, '[^0-9]', '', 'g') <> '' THEN
        CASE WHEN length(regexp_replace(cik, '[^0-9]', '', 'g')) < 10 THEN lpad(regexp_replace(cik, '[^0-9]', '', 'g'), 10, '0')
             ELSE regexp_replace(cik, '[^0-9]', '', 'g') END END AS cik, wikipedia_title FROM ({RAW_COMPANIES}) x)
SELECT ticker, max_by(name, pos) AS name, max_by(sector, pos) FILTER (WHERE sector IS NOT NULL) AS sector,
       max_by(cik, pos) FILTER (WHERE cik IS NOT NULL) AS cik,
       max_by(wikipedia_title, pos) FILTER (WHERE wikipedia_title IS NOT NULL) AS wikipedia_title
FROM r WHERE ticker <> '' AND name <> '' GROUP BY ticker""")
def _(m):
    return N.normalize_companies(m.sql(RAW_COMPANIES))


@check("fill_synthetic_ticker", f"""
WITH RECURSIVE r AS (SELECT pos, upper(trim(replace(ticker, '[1]', ''))) AS ticker,
    regexp_replace(upper(trim(replace(name, '[note 2]', ''))), '[^A-Z0-9]', '', 'g') AS plain FROM ({RAW_COMPANIES}) x),
 d AS (SELECT DISTINCT plain FROM r WHERE plain <> ''),
 h(plain, i, code) AS (SELECT plain, 0, CAST(0 AS BIGINT) FROM d
    UNION ALL SELECT plain, i + 1, (code * 31 + ascii(substr(plain, i + 1, 1))) % 4294967296 FROM h WHERE i < length(plain)),
 g AS (SELECT plain, substr(concat('N', substr(plain, 1, 7), lpad(upper(to_hex(code)), 8, '0')), 1, 16) AS made FROM h WHERE i = length(plain))
SELECT r.pos, coalesce(nullif(r.ticker, ''), g.made) AS ticker FROM r LEFT JOIN g ON g.plain = r.plain""")
def _(m):
    return N.fill_synthetic_ticker(m.sql(RAW_COMPANIES)).select("pos", "ticker")


CELLS = """
SELECT page_id AS id, CASE page_id % 6 WHEN 0 THEN concat('<b>x</b><a class="l" href="/wiki/Acme_', CAST(page_id AS STRING), '?a=1#s">Acme</a>')
    WHEN 1 THEN concat('<a href="//en.wikipedia.org/wiki/Foo', CAST(page_id AS STRING), '#h">F</a>') WHEN 2 THEN '<a href="/other/x">o</a>'
    WHEN 3 THEN concat('<a href=''https://en.wikipedia.org/wiki/Bar_%26_', CAST(page_id AS STRING), '''>B</a>') WHEN 4 THEN 'no link'
    ELSE concat('<A HREF="', url, '">p</A>') END AS cell_html FROM $pages"""


@check("wiki_titles", f"""
SELECT *, CASE id % 6 WHEN 0 THEN concat('Acme_', CAST(id AS VARCHAR)) WHEN 1 THEN concat('Foo', CAST(id AS VARCHAR))
    WHEN 3 THEN concat('Bar_%26_', CAST(id AS VARCHAR)) END AS wikipedia_title FROM ({CELLS}) c""")
def _(m):
    return N.wiki_titles(m.sql(CELLS))


NAMED = "SELECT id AS company_id, name, ticker, cik, wikipedia_title FROM $companies"


@check("identity_variants", """
SELECT id AS company_id, 'TITLE' AS kind, 0 AS rank, concat('Customer ', CAST(id AS VARCHAR), ' Group') AS variant
FROM $companies WHERE wikipedia_title IS NOT NULL
UNION ALL SELECT id, 'TITLE', 1, concat('Customer ', CAST(id AS VARCHAR)) FROM $companies WHERE wikipedia_title IS NOT NULL
UNION ALL SELECT id, 'CIK', 0, cik FROM $companies WHERE cik IS NOT NULL
UNION ALL SELECT id, 'CIK', 1, CAST(id AS VARCHAR) FROM $companies WHERE cik IS NOT NULL""")
def _(m):
    return N.identity_variants(m.sql(NAMED))


@check("domain_candidates", """
WITH w AS (SELECT id AS company_id, CASE WHEN name LIKE '%Acquisition-Corp' THEN concat('customer ', substr(name, 10, 9), ' acquisition corp')
    WHEN name LIKE '%Sons%' THEN concat('customer ', substr(name, 10, 9), ' sons') ELSE concat('customer ', substr(name, 10, 9)) END AS words FROM $companies),
 r AS (SELECT company_id, unnest([0, 1, 2, 3, 4, 5]) AS rank, replace(words, ' ', '') AS compact, replace(words, ' ', '-') AS hyphened FROM w)
SELECT company_id, CAST(rank AS INT) AS rank, concat(CASE rank % 2 WHEN 0 THEN compact ELSE hyphened END, CASE WHEN rank < 2 THEN '.com' WHEN rank < 4 THEN '.io' ELSE '.ai' END) AS candidate_domain FROM r""")
def _(m):
    return N.domain_candidates(m.sql(NAMED), limit=6)


@check("vendor_slug_candidates", """
WITH t AS (SELECT c.id AS company_id, d.domain, c.ticker, trim(regexp_replace(replace(lower(c.name), '&', 'and'), '[^a-z0-9]+', ' ', 'g')) AS w
    FROM $companies c JOIN (SELECT company_id, min(domain) AS domain FROM $company_domains GROUP BY 1) d ON d.company_id = c.id),
 r AS (SELECT company_id, unnest([0, 1, 2, 3]) AS k, unnest([split_part(regexp_replace(lower(domain), '^www[.]', ''), '.', 1),
    replace(w, ' ', ''), replace(w, ' ', '-'), lower(ticker)]) AS slug FROM t),
 f AS (SELECT company_id, slug, min(k) AS k FROM r GROUP BY 1, 2)
SELECT company_id, CAST(row_number() OVER (PARTITION BY company_id ORDER BY k) - 1 AS INT) AS rank, slug FROM f""")
def _(m):
    lowest = m.company_domains.groupBy("company_id").agg(F.min("domain").alias("domain"))
    return N.vendor_slug_candidates(m.sql(NAMED).join(lowest, "company_id"))


@check("landing_candidates", """
SELECT company_id, CAST(k AS INT) AS rank, replace(pattern, '@', lower(domain)) AS candidate_url
FROM $company_domains, (VALUES (0, 'https://@/careers'), (1, 'https://@/careers/'), (2, 'https://@/jobs'), (3, 'https://@/jobs/'),
  (4, 'https://@/about/careers'), (5, 'https://@/careers/jobs'), (6, 'https://careers.@/'), (7, 'https://jobs.@/')) v(k, pattern)""")
def _(m):
    return N.landing_candidates(m.company_domains)


PLAIN_DOMAINS = "SELECT id AS company_id, domain, careers_hint_url FROM $company_domains"


@check("careers_candidates", f"""
WITH d AS (SELECT company_id, lower(domain) AS domain, domain AS raw_domain, careers_hint_url FROM ({PLAIN_DOMAINS}) x),
 p(k, path) AS (VALUES (0, '/careers'), (1, '/jobs'), (2, '/careers/jobs'), (3, '/about/careers'), (4, '/join-us'), (5, '/careers/search'),
    (6, '/careers/opportunities'), (7, '/careers/openings'), (8, '/jobs/search')),
 t AS (SELECT company_id, 0 AS k, rtrim(careers_hint_url, '/') AS u FROM d WHERE careers_hint_url IS NOT NULL
   UNION ALL SELECT company_id, 10 + 2 * k + s, concat(CASE s WHEN 0 THEN 'https://' ELSE 'http://' END,
        split_part(domain, '/', 1), substr(raw_domain, length(split_part(raw_domain, '/', 1)) + 1), path)
     FROM d, p, (VALUES (0), (1)) z(s)
   UNION ALL SELECT company_id, 40 + 2 * k + s, concat(CASE s WHEN 0 THEN 'https://www.' ELSE 'http://www.' END,
        split_part(domain, '/', 1), substr(raw_domain, length(split_part(raw_domain, '/', 1)) + 1), path)
     FROM d, p, (VALUES (0), (1)) z(s) WHERE raw_domain NOT LIKE 'www.%'
   UNION ALL SELECT company_id, 80 + s, concat(CASE s WHEN 0 THEN 'https://careers.' ELSE 'http://careers.' END, split_part(domain, '/', 1),
        substr(raw_domain, length(split_part(raw_domain, '/', 1)) + 1)) FROM d, (VALUES (0), (1)) z(s)
   UNION ALL SELECT company_id, 90 + s, concat(CASE s WHEN 0 THEN 'https://jobs.' ELSE 'http://jobs.' END, split_part(domain, '/', 1),
        substr(raw_domain, length(split_part(raw_domain, '/', 1)) + 1)) FROM d, (VALUES (0), (1)) z(s)),
 f AS (SELECT company_id, u, min(k) AS k FROM t GROUP BY 1, 2)
SELECT company_id, CAST(row_number() OVER (PARTITION BY company_id ORDER BY k) - 1 AS INT) AS rank, u AS candidate_url FROM f""")
def _(m):
    return N.careers_candidates(m.sql(PLAIN_DOMAINS))


CANDIDATE_PAGES = """
SELECT c.id AS company_id, c.name, 0 AS rank, concat('customer', substr(c.name, 10, 9), '.com') AS candidate_domain FROM $companies c"""
FETCHED = """
SELECT concat('customer', substr(c.name, 10, 9), '.com') AS candidate_domain,
  CASE c.id % 6 WHEN 1 THEN 'https://www.hugedomains.com/x' WHEN 2 THEN 'https://other.example.com/'
       WHEN 3 THEN 'not a url' ELSE concat('https://www.customer', substr(c.name, 10, 9), '.com/') END AS final_url,
  CASE WHEN c.id % 7 = 0 THEN 404 ELSE 200 END AS http_status,
  CASE c.id % 5 WHEN 0 THEN '<html><head><title>Nobody</title></head><body>Buy this domain now</body></html>'
       WHEN 1 THEN '<html><head><title>Nobody</title></head><body>Nothing here</body></html>'
       ELSE concat('<html><head><title>', c.name, '</title></head><body>Customer pages</body></html>') END AS body
FROM $companies c"""


@check("verify_domain_candidates", f"""
WITH j AS (SELECT a.company_id, a.rank, a.candidate_domain, f.final_url, f.http_status, f.body, f.company_no
  FROM ({CANDIDATE_PAGES}) a JOIN (SELECT *, candidate_domain AS company_no FROM ({FETCHED}) b) f ON f.candidate_domain = a.candidate_domain),
 v AS (SELECT company_id, rank, candidate_domain, CASE WHEN http_status <> 200 THEN 'fetch_failed' WHEN final_url = 'not a url' THEN 'no_resolved_domain'
    WHEN final_url LIKE '%hugedomains%' THEN 'parked_host' WHEN body LIKE '%Buy this domain%' THEN 'parked_page'
    WHEN EXISTS (SELECT 1 FROM $companies c WHERE c.id = company_id AND regexp_matches(c.name, '^Customer#[0-9]+$|\\(ETF\\)|Trust')) THEN
      CASE WHEN final_url LIKE '%other.example.com%' AND body LIKE '%Nothing here%' THEN 'name_not_found' ELSE 'accepted' END
    ELSE 'root_mismatch' END AS verdict FROM j)
SELECT *, CASE WHEN verdict = 'accepted' THEN (SELECT regexp_extract(final_url, '^https://(www[.])?([^/]+)', 2) FROM j WHERE j.company_id = v.company_id) END AS domain FROM v""")
def _(m):
    return N.verify_domain_candidates(m.sql(CANDIDATE_PAGES), m.sql(FETCHED))


INFOBOXES = """
SELECT page_id, concat('https://en.wikipedia.org/wiki/P', CAST(page_id AS STRING)) AS url,
  concat(html, '<table class="infobox vcard"><tr><th>Founded</th><td><a href="https://no.example.com">x</a></td></tr><tr><th> Website </th><td>',
  CASE page_id % 7 WHEN 0 THEN concat('<a href="http://plain.example.com">a</a> <a href="https://www.Secure', CAST(page_id AS STRING), '.example.com/x">b</a>')
    WHEN 1 THEN concat('<a href="http://only', CAST(page_id AS STRING), '.example.com">a</a>') WHEN 2 THEN 'see https://text.example.com/y now'
    WHEN 3 THEN '<a href="https://boards.greenhouse.io/x">jobs</a>' WHEN 4 THEN '<a href="/wiki/Thing">t</a>' WHEN 5 THEN 'none'
    ELSE '<a href="//cdn.example.com/q">c</a>' END, '</td></tr></table>') AS html FROM $pages"""


@check("infobox_websites", f"""
SELECT * FROM (SELECT page_id, url, CASE page_id % 7 WHEN 0 THEN concat('https://www.Secure', CAST(page_id AS VARCHAR), '.example.com/x')
    WHEN 1 THEN concat('http://only', CAST(page_id AS VARCHAR), '.example.com') WHEN 2 THEN 'https://text.example.com/y'
    WHEN 6 THEN 'https://cdn.example.com/q' END AS website_url,
  CASE page_id % 7 WHEN 0 THEN concat('secure', CAST(page_id AS VARCHAR), '.example.com') WHEN 1 THEN concat('only', CAST(page_id AS VARCHAR), '.example.com')
    WHEN 2 THEN 'text.example.com' WHEN 6 THEN 'cdn.example.com' END AS domain FROM ({INFOBOXES}) i) x WHERE domain IS NOT NULL""")
def _(m):
    return N.infobox_websites(m.sql(INFOBOXES))
