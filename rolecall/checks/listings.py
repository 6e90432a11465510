"""Posting listings, search and deltas, each with its oracle."""

from rolecall.checks.registry import check
from rolecall.operators import postings as P

VIEW_COLS = """jp.id, jp.company_id, c.ticker, c.name AS company_name, e.ats_type AS latest_ats_type,
    jp.source_url, jp.canonical_url, jp.title, jp.org_name, jp.location_text, jp.employment_type,
    jp.date_posted, jp.first_seen_at, jp.last_seen_at, jp.is_active"""

ONE = """one AS (SELECT company_id, ats_type FROM (SELECT *, row_number() OVER (
    PARTITION BY company_id ORDER BY detected_at DESC, id DESC) AS rn FROM $ats_endpoints) x WHERE rn = 1)"""
ALL = """tied AS (SELECT ae.company_id, ae.ats_type FROM $ats_endpoints ae JOIN (
    SELECT company_id, max(detected_at) AS top FROM $ats_endpoints GROUP BY company_id) r
    ON r.company_id = ae.company_id AND r.top = ae.detected_at)"""

FROM_ONE = """FROM $job_postings jp JOIN $companies c ON c.id = jp.company_id
    LEFT JOIN one e ON e.company_id = jp.company_id"""
PUBLIC = """jp.canonical_url IS NOT NULL
    AND jp.canonical_url NOT LIKE 'https://community.workday.com/invalid-url%'"""


def like(q, alias="jp"):
    fields = ["title", "org_name", "location_text", "employment_type", "description_plain"]
    return "(" + " OR ".join(f"lower(CAST({alias}.{f} AS VARCHAR)) LIKE '%{q}%'" for f in fields) + ")"


WORDS = """concat(' ', trim(regexp_replace(lower(concat_ws(' ', coalesce(title, ''), coalesce(org_name, ''),
    coalesce(location_text, ''), coalesce(employment_type, ''), coalesce(description_plain, ''))),
    '[^\\p{L}\\p{N}]+', ' ', 'g')), ' ')"""


@check("posting_view", f"WITH {ONE} SELECT {VIEW_COLS} {FROM_ONE}")
def _(m):
    return P.posting_view(m.job_postings, m.companies, m.ats_endpoints)


@check("posting_view_all_ties", f"""
WITH {ALL} SELECT {VIEW_COLS} FROM $job_postings jp JOIN $companies c ON c.id = jp.company_id
LEFT JOIN tied e ON e.company_id = jp.company_id""")
def _(m):
    return P.posting_view(m.job_postings, m.companies, m.ats_endpoints, ties="all")


@check("postings_with_endpoint_type", f"""
WITH {ONE} SELECT {VIEW_COLS} {FROM_ONE}
WHERE jp.company_id IN (SELECT company_id FROM $ats_endpoints WHERE ats_type = 'GREENHOUSE')""")
def _(m):
    return P.postings_with_endpoint_type(m.job_postings, m.companies, m.ats_endpoints, "GREENHOUSE")


@check("newest_postings", f"""
WITH {ONE} SELECT {VIEW_COLS} {FROM_ONE}
WHERE jp.is_active AND {like('widget')}
  AND jp.company_id IN (SELECT company_id FROM $ats_endpoints WHERE ats_type = 'LEVER')
ORDER BY jp.last_seen_at DESC, jp.id DESC LIMIT 50""")
def _(m):
    return P.newest_postings(m.job_postings, m.companies, m.ats_endpoints, 50, vendor="LEVER",
                             active=True, query=" Widget ")


@check("postings_page", f"""
WITH {ONE} SELECT {VIEW_COLS} {FROM_ONE} WHERE {PUBLIC}
ORDER BY jp.first_seen_at DESC, jp.id DESC LIMIT 50 OFFSET 100""")
def _(m):
    return P.postings_page(m.job_postings, m.companies, m.ats_endpoints, page=2, size=50)


@check("postings_page_filtered", f"""
WITH {ONE} SELECT {VIEW_COLS} {FROM_ONE} WHERE {PUBLIC} AND NOT jp.is_active AND jp.company_id = 7
  AND jp.company_id IN (SELECT company_id FROM $ats_endpoints WHERE ats_type IS NOT NULL)
ORDER BY jp.first_seen_at DESC, jp.id DESC LIMIT 25""")
def _(m):
    return P.postings_page(m.job_postings, m.companies, m.ats_endpoints, size=25, company_id=7,
                           active=False)


@check("filtered_posting_count", f"""
SELECT count(*) AS total FROM $job_postings jp
WHERE {PUBLIC} AND jp.is_active AND {like('ring')}
  AND EXISTS (SELECT 1 FROM $ats_endpoints e WHERE e.company_id = jp.company_id AND e.ats_type = 'WORKDAY')""")
def _(m):
    return P.filtered_posting_count(m.job_postings, m.ats_endpoints, vendor="WORKDAY", active=True,
                                    query="ring")


@check("new_postings_since", f"""
WITH {ONE} SELECT {VIEW_COLS} {FROM_ONE} WHERE jp.first_seen_at > TIMESTAMP '2024-01-10 00:00:00'
ORDER BY jp.first_seen_at DESC, jp.id DESC LIMIT 200""")
def _(m):
    return P.new_postings_since(m.job_postings, m.companies, m.ats_endpoints,
                                "2024-01-10 00:00:00", 200)


@check("new_postings_since_all", f"""
WITH {ONE} SELECT {VIEW_COLS} {FROM_ONE} WHERE jp.first_seen_at > TIMESTAMP '2024-01-26 00:00:00'""")
def _(m):
    return P.new_postings_since(m.job_postings, m.companies, m.ats_endpoints, "2024-01-26 00:00:00")


@check("closed_postings_since", f"""
WITH {ONE} SELECT {VIEW_COLS} {FROM_ONE} WHERE NOT jp.is_active
  AND jp.last_seen_at > TIMESTAMP '2024-01-20 00:00:00' AND {like('red')}
ORDER BY jp.last_seen_at DESC, jp.id DESC LIMIT 200""")
def _(m):
    return P.closed_postings_since(m.job_postings, m.companies, m.ats_endpoints,
                                   "2024-01-20 00:00:00", 200, query="red")


@check("posting_detail", f"""
WITH {ONE} SELECT {VIEW_COLS}, jp.description_text, jp.external_identifier, jp.content_hash
{FROM_ONE} WHERE {PUBLIC}""")
def _(m):
    return P.posting_detail(m.job_postings, m.companies, m.ats_endpoints)


@check("run_delta_counts", """
SELECT company_id,
       count(*) FILTER (WHERE crawl_run_id = 20240112 AND first_seen_at >= w.started_at AND first_seen_at <= w.finished_at) AS new_count,
       count(*) FILTER (WHERE crawl_run_id = 20240111 AND NOT is_active) AS removed_count,
       CAST(0 AS BIGINT) AS updated_count
FROM $job_postings, (SELECT started_at, finished_at FROM $crawl_runs WHERE id = 20240112) w
WHERE crawl_run_id IN (20240111, 20240112) GROUP BY company_id""")
def _(m):
    return P.run_delta_counts(m.job_postings, m.crawl_runs, 20240111, 20240112)


@check("run_delta_postings", f"""
WITH {ONE}, d AS (
  SELECT p.id, p.company_id, p.title, p.location_text, p.source_url, p.first_seen_at, p.last_seen_at, 'NEW' AS change
  FROM $job_postings p, (SELECT started_at, finished_at FROM $crawl_runs WHERE id = 20240112) w
  WHERE crawl_run_id = 20240112 AND first_seen_at >= w.started_at AND first_seen_at <= w.finished_at
  UNION ALL
  SELECT id, company_id, title, location_text, source_url, first_seen_at, last_seen_at, 'REMOVED'
  FROM $job_postings WHERE crawl_run_id = 20240111 AND NOT is_active)
SELECT d.*, one.ats_type AS latest_ats_type FROM d LEFT JOIN one ON one.company_id = d.company_id""")
def _(m):
    return P.run_delta_postings(m.job_postings, m.crawl_runs, m.ats_endpoints, 20240111, 20240112)


@check("postings_after_id", """
SELECT id, canonical_url FROM $job_postings
WHERE id > 5000000000 AND lower(canonical_url) LIKE '%workdayjobs%' ORDER BY id LIMIT 500""")
def _(m):
    return P.postings_after_id(m.job_postings, 5000000000, 500)


@check("text_match_like", f"SELECT id, org_name FROM $document_postings d WHERE {like('the', 'd')}")
def _(m):
    return P.text_match(m.document_postings, "the").select("id", "org_name")


@check("text_match_words", f"""
SELECT id FROM (SELECT id, {WORDS} AS words FROM $document_postings) x
WHERE (words LIKE '% the %' AND words LIKE '% of the %' AND words NOT LIKE '% src1 %')
   OR words LIKE '% une %'""")
def _(m):
    return P.text_match(m.document_postings, 'the "of the" -src1 OR une', "words").select("id")


@check("text_match_words_postings", f"""
SELECT id FROM (SELECT id, {WORDS} AS words FROM $job_postings) x
WHERE words LIKE '% red widget %' AND words LIKE '% engineer %' AND words NOT LIKE '% austin %'""")
def _(m):
    return P.text_match(m.job_postings, '"Red Widget" engineer -Austin', "words").select("id")
