"""Lookups, selections and other joins, each with its oracle."""

from pyspark.sql import functions as F

from rolecall.checks.registry import check
from rolecall.operators import latest as L
from rolecall.operators import targets as T

AS_OF = "2024-01-15 00:00:00"

BEST = """
best AS (SELECT company_id, domain, careers_hint_url FROM (
    SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY confidence DESC,
        CASE WHEN resolved_at IS NULL THEN 1 ELSE 0 END, resolved_at DESC, id DESC) AS rn
    FROM $company_domains) d WHERE rn = 1),
targets AS (SELECT c.id AS company_id, c.ticker, c.name, c.sector, b.domain, b.careers_hint_url
    FROM $companies c JOIN best b ON b.company_id = c.id)"""

LATEST_DOMAIN = """
latest_domains AS (SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY resolved_at DESC NULLS LAST, id DESC) AS rn
    FROM $company_domains) d WHERE rn = 1)"""

TARGET_COLS = "company_id, ticker, name, sector, domain, careers_hint_url"

ELIGIBLE = f"""
NOT EXISTS (SELECT 1 FROM company_domains d WHERE d.company_id = c.id)
  AND (c.domain_resolution_attempted_at IS NULL
       OR c.domain_resolution_attempted_at <= TIMESTAMP '2024-01-14 12:00:00')
  AND (c.domain_resolution_status IS NULL
       OR upper(c.domain_resolution_status) NOT IN ('NO_ITEM', 'NO_P856', 'INVALID_WEBSITE_URL')
       OR c.domain_resolution_attempted_at IS NULL
       OR c.domain_resolution_attempted_at <= TIMESTAMP '2024-01-08 00:00:00')"""

NAME = """lower(concat(' ', replace(replace(replace(replace(replace(replace(replace(
    coalesce(c.name, ''), '.', ' '), ',', ' '), '/', ' '), '-', ' '), '&', ' '), '(', ' '), ')', ' '), ' '))"""
NON_EMPLOYER = "(" + " OR ".join(
    f"{NAME} LIKE '% {w} %'" for w in
    ["etf", "fund", "trust", "acquisition", "spac", "lp", "holdings trust", "depositary",
     "depository", "notes", "warrant", "unit", "units"]
) + ")"

IDENTITY = """c.id AS company_id, c.ticker, c.name, c.sector, c.wikipedia_title, c.cik,
    c.domain_resolution_method, c.domain_resolution_status, c.domain_resolution_error,
    c.domain_resolution_attempted_at"""

DISCOVERY_ELIGIBLE = """
NOT EXISTS (SELECT 1 FROM ats_endpoints e WHERE e.company_id = t.company_id)
  AND (s.next_attempt_at IS NULL OR s.next_attempt_at <= TIMESTAMP '2024-01-15 00:00:00')
  AND (s.last_attempt_at IS NULL OR s.last_attempt_at <= TIMESTAMP '2024-01-14 12:00:00')
  AND (s.last_reason_code IS NULL
       OR upper(s.last_reason_code) NOT IN ('DISCOVERY_NO_MATCH', 'DISCOVERY_ATS_DETECTED_NO_ENDPOINT',
            'DISCOVERY_SITEMAP_NO_URLS', 'DISCOVERY_SITEMAP_FETCH_FAILED', 'DISCOVERY_HOMEPAGE_TOO_LARGE')
       OR s.last_attempt_at IS NULL OR s.last_attempt_at <= TIMESTAMP '2024-01-08 00:00:00')"""


@check("best_domain", f"WITH {BEST} SELECT * FROM targets")
def _(m):
    return L.best_domain(m.companies, m.company_domains)


@check("latest_endpoint_all_ties", """
SELECT e.* FROM $ats_endpoints e JOIN (
    SELECT company_id, max(detected_at) AS top FROM $ats_endpoints GROUP BY company_id) x
  ON x.company_id = e.company_id AND x.top = e.detected_at""")
def _(m):
    return L.latest_endpoint(m.ats_endpoints, ties="all")


@check("latest_endpoint_one", """
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (
    PARTITION BY company_id ORDER BY detected_at DESC, id DESC) AS rn FROM $ats_endpoints) x WHERE rn = 1""")
def _(m):
    return L.latest_endpoint(m.ats_endpoints)


@check("latest_domain", f"WITH {LATEST_DOMAIN} SELECT * EXCLUDE (rn) FROM latest_domains")
def _(m):
    return L.latest_domain(m.company_domains)


@check("dedupe_first_source", """
SELECT * FROM (SELECT DISTINCT ON (company_id, source) company_id, source, id, domain
    FROM $company_domains ORDER BY company_id, source, id) x""")
def _(m):
    rows = L.dedupe_first(m.company_domains, ["company_id", "source"], [F.asc("id")])
    return rows.select("company_id", "source", "id", "domain")


@check("flag_non_employers", f"SELECT c.*, {NON_EMPLOYER} AS likely_non_employer FROM $companies c")
def _(m):
    return T.flag_non_employers(m.companies)


@check("companies_missing_domain",
       f"SELECT {IDENTITY} FROM $companies c, (SELECT count(*) FROM $company_domains) one WHERE {ELIGIBLE}")
def _(m):
    return T.companies_missing_domain(m.companies, m.company_domains, AS_OF)


@check("companies_missing_domain_employers_top", f"""
SELECT {IDENTITY} FROM $companies c, (SELECT count(*) FROM $company_domains) one
WHERE {ELIGIBLE} AND NOT {NON_EMPLOYER} ORDER BY c.ticker LIMIT 10""")
def _(m):
    return T.companies_missing_domain(
        m.companies, m.company_domains, AS_OF, limit=10, include_non_employer=False
    )


@check("companies_missing_domain_by_ticker", f"""
SELECT {IDENTITY} FROM $companies c
WHERE c.ticker IN (SELECT concat('T', lpad(CAST(user_id AS STRING), 9, '0')) FROM $events)
  AND NOT EXISTS (SELECT 1 FROM $company_domains d WHERE d.company_id = c.id)""")
def _(m):
    wanted = m.sql("SELECT concat('T', lpad(CAST(user_id AS STRING), 9, '0')) AS ticker FROM $events")
    return T.companies_missing_domain_by_ticker(m.companies, m.company_domains, wanted)


@check("count_missing_domain",
       f"SELECT count(*) AS total FROM $companies c, (SELECT count(*) FROM $company_domains) one WHERE {ELIGIBLE}")
def _(m):
    return T.count_missing_domain(m.companies, m.company_domains, AS_OF)


@check("count_non_employers", f"""
SELECT count(*) AS total FROM $companies c, (SELECT count(*) FROM $company_domains) one
WHERE {ELIGIBLE} AND {NON_EMPLOYER}""")
def _(m):
    return T.count_non_employers(m.companies, m.company_domains, AS_OF)


@check("sample_non_employers", f"""
SELECT c.ticker, concat(c.ticker, ' (', c.name, ')') AS label
FROM $companies c, (SELECT count(*) FROM $company_domains) one
WHERE {ELIGIBLE} AND {NON_EMPLOYER} ORDER BY c.ticker LIMIT 10""")
def _(m):
    return T.sample_non_employers(m.companies, m.company_domains, AS_OF)


@check("missing_domain_cohort", """
SELECT c.id AS company_id, c.ticker, c.name, c.wikipedia_title, c.cik, c.domain_resolution_status,
       c.domain_resolution_method, c.domain_resolution_attempted_at
FROM $companies c WHERE NOT EXISTS (SELECT 1 FROM $company_domains d WHERE d.company_id = c.id)
ORDER BY c.ticker LIMIT 3000""")
def _(m):
    return T.missing_domain_cohort(m.companies, m.company_domains, 3000)


@check("companies_without_endpoint", f"""
WITH {BEST} SELECT t.* FROM targets t LEFT JOIN $careers_discovery_state s ON s.company_id = t.company_id,
    (SELECT count(*) FROM $ats_endpoints) one
WHERE {DISCOVERY_ELIGIBLE}
ORDER BY coalesce(s.last_attempt_at, TIMESTAMP '1970-01-01 00:00:00'), t.ticker LIMIT 200""")
def _(m):
    return T.companies_without_endpoint(
        m.companies, m.company_domains, m.ats_endpoints, m.careers_discovery_state, AS_OF, 200
    )


@check("companies_without_endpoint_by_ticker", f"""
WITH {BEST} SELECT t.* FROM targets t LEFT JOIN $careers_discovery_state s ON s.company_id = t.company_id,
    (SELECT count(*) FROM $ats_endpoints) one
WHERE {DISCOVERY_ELIGIBLE}
  AND t.ticker IN (SELECT concat('T', lpad(CAST(user_id AS STRING), 9, '0')) FROM $events)""")
def _(m):
    wanted = m.sql("SELECT concat('T', lpad(CAST(user_id AS STRING), 9, '0')) AS ticker FROM $events")
    return T.companies_without_endpoint(
        m.companies, m.company_domains, m.ats_endpoints, m.careers_discovery_state, AS_OF,
        tickers=wanted,
    )


@check("count_without_endpoint", f"""
WITH {BEST} SELECT count(*) AS total FROM targets t
LEFT JOIN $careers_discovery_state s ON s.company_id = t.company_id,
    (SELECT count(*) FROM $ats_endpoints) one
WHERE {DISCOVERY_ELIGIBLE}""")
def _(m):
    return T.count_without_endpoint(
        m.companies, m.company_domains, m.ats_endpoints, m.careers_discovery_state, AS_OF
    )


@check("crawl_targets", f"WITH {BEST} SELECT * FROM targets ORDER BY ticker LIMIT 50")
def _(m):
    return T.crawl_targets(m.companies, m.company_domains, limit=50)


@check("crawl_targets_all", f"WITH {BEST} SELECT * FROM targets")
def _(m):
    return T.crawl_targets(m.companies, m.company_domains)


@check("crawl_targets_with_endpoint", f"""
WITH {BEST} SELECT t.* FROM targets t JOIN (
    SELECT company_id, max(detected_at) AS top FROM $ats_endpoints GROUP BY company_id) e
  ON e.company_id = t.company_id ORDER BY e.top DESC, t.ticker LIMIT 50""")
def _(m):
    return T.crawl_targets_with_endpoint(m.companies, m.company_domains, m.ats_endpoints, limit=50)


@check("crawl_targets_with_endpoint_since", f"""
WITH {BEST} SELECT t.* FROM targets t JOIN (
    SELECT company_id, max(detected_at) AS top FROM $ats_endpoints
    WHERE detected_at >= TIMESTAMP '2001-01-01 00:00:00' GROUP BY company_id) e
  ON e.company_id = t.company_id""")
def _(m):
    return T.crawl_targets_with_endpoint(
        m.companies, m.company_domains, m.ats_endpoints, since="2001-01-01 00:00:00"
    )


@check("company_target_by_id", f"WITH {BEST} SELECT * FROM targets WHERE company_id = 7")
def _(m):
    return T.company_target_by_id(m.companies, m.company_domains, 7)


@check("merge_targets", """
WITH recent AS (SELECT company_id, max(detected_at) AS d FROM $ats_endpoints
        WHERE detected_at >= TIMESTAMP '2001-01-01 00:00:00' GROUP BY company_id),
     r AS (SELECT company_id, 0 AS s, row_number() OVER (ORDER BY d DESC, company_id) AS pos FROM recent),
     f AS (SELECT company_id, 1 AS s, row_number() OVER (ORDER BY max(detected_at) DESC, company_id) AS pos
           FROM $ats_endpoints GROUP BY company_id),
     u AS (SELECT * FROM r UNION ALL SELECT * FROM f),
     w AS (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY s, pos) AS rn FROM u)
SELECT company_id FROM w WHERE rn = 1 ORDER BY s, pos LIMIT 400""")
def _(m):
    def listed(df):
        top = df.groupBy("company_id").agg(F.max("detected_at").alias("d"))
        return top.select("company_id", F.struct((-F.unix_timestamp("d")).alias("d"), "company_id").alias("pos"))

    new = m.ats_endpoints.where(F.col("detected_at") >= F.lit("2001-01-01").cast("timestamp"))
    return T.merge_targets(listed(new), listed(m.ats_endpoints), 400)


@check("company_search", """
SELECT c.id, c.ticker, c.name, d.domain FROM $companies c
LEFT JOIN (SELECT company_id, min(domain) AS domain FROM $company_domains GROUP BY company_id) d
  ON d.company_id = c.id
WHERE lower(c.ticker) LIKE '%12%' OR lower(c.name) LIKE '%12%' OR lower(coalesce(d.domain, '')) LIKE '%12%'
ORDER BY CASE WHEN lower(c.ticker) = '12' THEN 0 WHEN lower(c.name) = '12' THEN 1 ELSE 2 END, c.ticker
LIMIT 20""")
def _(m):
    return T.company_search(m.companies, m.company_domains, " 12 ", 20)


@check("existing_tickers", """
SELECT ticker FROM $companies
WHERE ticker IN (SELECT concat('T', lpad(CAST(user_id * 3 AS STRING), 9, '0')) FROM $events)""")
def _(m):
    wanted = m.sql("SELECT concat('T', lpad(CAST(user_id * 3 AS STRING), 9, '0')) AS ticker FROM $events")
    return T.existing_tickers(m.companies, wanted)


@check("cohort_domain_state", f"""
WITH {LATEST_DOMAIN}
SELECT c.id AS company_id, c.ticker, c.domain_resolution_status,
       c.domain_resolution_method AS company_domain_resolution_method, c.domain_resolution_attempted_at,
       ld.domain, ld.source, ld.resolution_method, ld.resolved_at
FROM $companies c LEFT JOIN latest_domains ld ON ld.company_id = c.id
WHERE c.id IN (SELECT user_id FROM $events)""")
def _(m):
    cohort = m.sql("SELECT user_id AS company_id FROM $events")
    return T.cohort_domain_state(m.companies, m.company_domains, cohort)
