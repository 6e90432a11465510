"""Extraction from documents, each with its oracle.

Documents are strings built around the columns of the given tables, so their
number and content grow with them; every page text is kept whole.
"""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolecall.checks.registry import check
from rolecall.operators import feeds as D
from rolecall.operators import pages as P
from rolecall.operators import sitemaps as S
from rolecall.operators.resolution import resolve_domains

LINK_PAGES = """
SELECT page_id, CASE WHEN page_id % 13 = 5 THEN concat('https://jobs.lever.co/u', CAST(page_id AS STRING), '/apply') ELSE url END AS url,
  concat(html, CASE page_id % 13
    WHEN 0 THEN concat('<a href="https://boards.greenhouse.io/Acme', CAST(page_id AS STRING), '.">x</a> //boards.greenhouse.io/acme', CAST(page_id AS STRING))
    WHEN 1 THEN concat('<script src="//boards.greenhouse.io/embed/job_board?x=1&FOR=e', CAST(page_id AS STRING), '"></script> https://job-boards.greenhouse.io/j', CAST(page_id AS STRING), '/jobs/1')
    WHEN 2 THEN concat('https://API.greenhouse.io/v1/boards/a', CAST(page_id AS STRING), '/jobs https://apply.lever.co/l', CAST(page_id AS STRING), ' https://api.lever.co/v0/postings/p', CAST(page_id AS STRING))
    WHEN 3 THEN concat('href="https://T', CAST(page_id AS STRING), '.wd5.myworkdayjobs.com/en-US/Ext', CAST(page_id AS STRING), '/job/1?x=2"')
    WHEN 4 THEN concat('https://t', CAST(page_id AS STRING), '.wd1.myworkdayjobs.com/wday/cxs/ten/Site', CAST(page_id AS STRING), '/jobs')
    WHEN 6 THEN concat('https://jobs.smartrecruiters.com/S', CAST(page_id AS STRING), ' https://api.smartrecruiters.com/v1/companies/s', CAST(page_id AS STRING), '/postings')
    WHEN 7 THEN concat('https://Co', CAST(page_id AS STRING), '.icims.com/jobs/search?ss=1 https://careers.icims.com/jobs/c', CAST(page_id AS STRING), '/jobs')
    WHEN 8 THEN concat('https://x', CAST(page_id AS STRING), '.taleo.net/careersection/sec', CAST(page_id AS STRING), '/jobsearch.ftl?lang=en')
    WHEN 9 THEN concat('https://career', CAST(page_id AS STRING), '.successfactors.eu/career?company=x https://jobs.sap.com/careers')
    WHEN 10 THEN 'https://t.myworkdayjobs.com https://boards.greenhouse.io/embed' ELSE '' END) AS html FROM $pages"""
ID = "CAST(page_id AS VARCHAR)"


@check("vendor_endpoints", f"""
SELECT page_id, vendor, ats_url FROM (
 SELECT page_id, 'GREENHOUSE' AS vendor, concat('https://boards.greenhouse.io/Acme', {ID}) AS ats_url FROM $pages WHERE page_id % 13 = 0
 UNION ALL SELECT page_id, 'GREENHOUSE', concat('https://boards.greenhouse.io/j', {ID}) FROM $pages WHERE page_id % 13 = 1
 UNION ALL SELECT page_id, 'GREENHOUSE', concat('https://boards.greenhouse.io/e', {ID}) FROM $pages WHERE page_id % 13 = 1
 UNION ALL SELECT page_id, 'GREENHOUSE', concat('https://boards.greenhouse.io/a', {ID}) FROM $pages WHERE page_id % 13 = 2
 UNION ALL SELECT page_id, 'LEVER', concat('https://jobs.lever.co/l', {ID}) FROM $pages WHERE page_id % 13 = 2
 UNION ALL SELECT page_id, 'LEVER', concat('https://jobs.lever.co/p', {ID}) FROM $pages WHERE page_id % 13 = 2
 UNION ALL SELECT page_id, 'WORKDAY', concat('https://t', {ID}, '.wd5.myworkdayjobs.com/en-US/Ext', {ID}) FROM $pages WHERE page_id % 13 = 3
 UNION ALL SELECT page_id, 'WORKDAY', concat('https://t', {ID}, '.wd1.myworkdayjobs.com/Site', {ID}) FROM $pages WHERE page_id % 13 = 4
 UNION ALL SELECT page_id, 'LEVER', concat('https://jobs.lever.co/u', {ID}) FROM $pages WHERE page_id % 13 = 5
 UNION ALL SELECT page_id, 'SMARTRECRUITERS', concat('https://careers.smartrecruiters.com/S', {ID}) FROM $pages WHERE page_id % 13 = 6
 UNION ALL SELECT page_id, 'ICIMS', concat('https://co', {ID}, '.icims.com/jobs/search') FROM $pages WHERE page_id % 13 = 7
 UNION ALL SELECT page_id, 'ICIMS', 'https://careers.icims.com/jobs/search' FROM $pages WHERE page_id % 13 = 7
 UNION ALL SELECT page_id, 'ICIMS', concat('https://careers.icims.com/jobs/c', {ID}, '/jobs') FROM $pages WHERE page_id % 13 = 7
 UNION ALL SELECT page_id, 'TALEO', concat('https://x', {ID}, '.taleo.net/careersection/sec', {ID}, '/jobsearch.ftl') FROM $pages WHERE page_id % 13 = 8
 UNION ALL SELECT page_id, 'SUCCESSFACTORS', concat('https://career', {ID}, '.successfactors.eu/career') FROM $pages WHERE page_id % 13 = 9
 UNION ALL SELECT page_id, 'SUCCESSFACTORS', 'https://jobs.sap.com/career' FROM $pages WHERE page_id % 13 = 9) x""")
def _(m):
    return P.vendor_endpoints(m.sql(LINK_PAGES)).select("page_id", "vendor", "ats_url")


CAREER_PAGES = """
SELECT page_id, url, concat(html, '<a class="x" href="/careers?a=1&amp;b=2">Our <b>Jobs</b></a><a href=''https://jobs.lever.co/z', CAST(page_id AS STRING), '/1''>Open positions</a>',
  '<a href="team/join-us">Join</a><a href="mailto:jobs@example.com">jobs</a><a href="https://grnh.se/q', CAST(page_id AS STRING), '">short</a>') AS html FROM $pages"""
ROOT = "concat(lower(regexp_extract(url, '^(https?)', 1)), '://', regexp_extract(url, '^https?://([^/?#]+)', 1))"


@check("endpoints_from_anchors", f"""
SELECT page_id, concat('https://jobs.lever.co/z', {ID}, '/1') AS discovered_from_url, 'LEVER' AS vendor, concat('https://jobs.lever.co/z', {ID}) AS ats_url FROM $pages""")
def _(m):
    return P.endpoints_from_anchors(m.sql(CAREER_PAGES)).drop("pos")


@check("short_links", f"SELECT page_id, 0 AS pos, concat('https://grnh.se/q', {ID}) AS short_url FROM $pages")
def _(m):
    return P.short_links(m.sql(CAREER_PAGES))


SCORED = " + ".join(
    [f"CASE WHEN lower(u) LIKE '%{w}%' THEN 6 ELSE 0 END + CASE WHEN lower(t) LIKE '%{w}%' THEN 4 ELSE 0 END"
     for w in ["careers", "career", "jobs", "job", "join", "talent", "opportunit", "work-with-us", "open-positions"]]
    + ["CASE WHEN lower(u) LIKE '%/careers%' OR lower(u) LIKE '%/jobs%' THEN 4 ELSE 0 END",
       "CASE WHEN lower(u) LIKE '%jobs.%' OR lower(u) LIKE '%careers.%' THEN 3 ELSE 0 END"])


@check("ranked_career_links", f"""
WITH a AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a[^>]* href=["'']([^"'']*)["''][^>]*>(.*?)</a>', 1)) AS h,
    unnest(regexp_extract_all(html, '<a[^>]* href=["'']([^"'']*)["''][^>]*>(.*?)</a>', 2)) AS raw FROM ({CAREER_PAGES}) p),
 b AS (SELECT page_id, replace(h, '&amp;', '&') AS h, regexp_replace(raw, '<[^>]*>', ' ', 'g') AS t, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS root,
    regexp_extract(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '^(.*/)', 1) AS folder FROM a),
 c AS (SELECT page_id, t, CASE WHEN h LIKE 'http%' THEN h WHEN h LIKE '/%' THEN concat(root, h) ELSE concat(root, CASE WHEN folder = '' THEN '/' ELSE folder END, h) END AS u FROM b WHERE h NOT LIKE 'mailto:%'),
 s AS (SELECT page_id, u, {SCORED} AS score FROM c), m AS (SELECT page_id, u, max(score) AS score FROM s WHERE score > 0 GROUP BY 1, 2)
SELECT page_id, candidate_url, score FROM (SELECT page_id, u AS candidate_url, score, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, u) AS rn FROM m) x WHERE rn <= 5""")
def _(m):
    return P.ranked_career_links(m.sql(CAREER_PAGES), 5)


@check("endpoints_from_sitemap_urls", f"""
SELECT source, min(pos) AS pos, 'GREENHOUSE' AS vendor, ats_url, min_by(url, pos) AS discovered_from_url FROM (
  SELECT 'all' AS source, pos, url, regexp_replace(url, '/jobs/.*$', '') AS ats_url FROM $raw_urls WHERE url LIKE 'https://boards.greenhouse.io/%') x GROUP BY ats_url, source
UNION ALL SELECT 'all', pos, 'WORKDAY', regexp_replace(url, '/job/.*$', ''), url FROM $raw_urls WHERE url LIKE '%myworkdayjobs%'""")
def _(m):
    return P.endpoints_from_urls(m.raw_urls.withColumn("source", F.lit("all")), "source")


DETECTIONS = """
SELECT o_custkey AS company_id, CASE o_orderkey % 6 WHEN 0 THEN 'link' WHEN 1 THEN 'vendor_probe' WHEN 2 THEN 'homepage_link' WHEN 3 THEN 'careers_path' WHEN 4 THEN 'sitemap'
   ELSE 'careers_landing' END AS method, o_orderkey AS pos, CASE o_orderkey % 2 WHEN 0 THEN 'LEVER' ELSE 'GREENHOUSE' END AS vendor,
  CASE WHEN o_orderkey % 11 = 0 THEN ' ' ELSE concat('https://host.example.com/', CASE WHEN o_orderstatus = 'F' THEN 'A' ELSE 'a' END, CAST(o_custkey % 3 AS STRING)) END AS ats_url,
  concat('https://from.example.com/', CAST(o_orderkey AS STRING)) AS discovered_from_url FROM $orders"""


@check("endpoint_candidates", f"""
SELECT company_id, vendor AS ats_type, ats_url, discovered_from_url, method AS detection_method, c AS confidence, true AS verified FROM (
  SELECT *, row_number() OVER (PARTITION BY company_id, vendor, lower(ats_url) ORDER BY k, pos) AS rn FROM (SELECT *,
    CASE method WHEN 'homepage_link' THEN 0 WHEN 'sitemap' THEN 1 WHEN 'careers_landing' THEN 2 WHEN 'vendor_probe' THEN 3 WHEN 'link' THEN 4 ELSE 5 END AS k,
    CASE method WHEN 'homepage_link' THEN 0.95e0 WHEN 'sitemap' THEN 0.92e0 WHEN 'careers_landing' THEN 0.9e0 WHEN 'vendor_probe' THEN 0.9e0 ELSE 0.85e0 END AS c
    FROM ({DETECTIONS}) d WHERE trim(ats_url) <> '') e) f WHERE rn = 1""")
def _(m):
    return P.endpoint_candidates(m.sql(DETECTIONS))


# --- JSON-LD: one block per part, in five shapes ---------------------------

JSONLD_PAGES = """
SELECT p_partkey AS page_id, concat('https://acme', CAST(p_partkey AS STRING), '.example.com/careers/list') AS url,
 concat('<html><head><script type="application/ld+json">', CASE p_partkey % 6
  WHEN 0 THEN concat('{"@type":"JobPosting","title":" ', p_name, ' ","hiringOrganization":{"@type":"Organization","name":"', p_brand, '"},"employmentType":["FULL_TIME","INTERN","FULL_TIME"],',
     '"datePosted":"2024-01-1', CAST(p_partkey % 10 AS STRING), 'T08:00","description":"Make a ', p_name, '","identifier":{"@type":"PropertyValue","value":', CAST(p_partkey AS STRING), '},',
     '"jobLocation":[{"address":{"addressLocality":"Austin","addressRegion":"TX","addressCountry":"US"}},{"name":"Remote"},{"address":{"addressLocality":"Austin","addressRegion":"TX","addressCountry":"US"}}],',
     '"url":"https://jobs.example.com/', CAST(p_partkey AS STRING), '"}')
  WHEN 1 THEN concat('{"@context":"https://schema.org","@graph":[{"@type":"WebSite","name":"x"},{"@type":["Thing","jobposting"],"name":"', p_name, '","jobLocation":"Paris","identifier":"R-', CAST(p_partkey AS STRING),
     '","employmentType":"PART_TIME","datePosted":"soon","url":"../open/', CAST(p_partkey AS STRING), '"}]}')
  WHEN 2 THEN concat('{"@type":"JobPosting","title":"broken ', p_name)
  WHEN 3 THEN concat('[{"@type":"JobPosting","title":"', p_name, '","url":"https://api.lever.co/v0/postings/x"},{"@type":"JobPosting","title":"second","jobLocation":{"address":{"addressCountry":"DE"}}}]')
  WHEN 4 THEN '{"@type":"Person","name":"nobody"}' ELSE '' END, '</script></head><body>', p_name, '</body></html>') AS html FROM $part"""

HASHED = """SELECT *, sha256(concat('{"canonical_url":"', canonical_url, '","date_posted":"', coalesce(CAST(date_posted AS VARCHAR), ''), '","description":"', coalesce(description_text, ''),
  '","employment_type":"', coalesce(employment_type, ''), '","identifier":"', coalesce(external_identifier, ''), '","location_text":"', coalesce(location_text, ''),
  '","org_name":"', coalesce(org_name, ''), '","title":"', coalesce(title, ''), '"}')) AS content_hash FROM p"""
PART = "CAST(p_partkey AS VARCHAR)"


@check("jsonld_postings", f"""
WITH p AS (
 SELECT p_partkey AS page_id, concat('https://acme', {PART}, '.example.com/careers/list') AS source_url, 0 AS block, 0 AS pos, concat('https://jobs.example.com/', {PART}) AS canonical_url, p_name AS title,
   p_brand AS org_name, 'Austin, TX, US | Remote' AS location_text, 'FULL_TIME, INTERN' AS employment_type, CAST(concat('2024-01-1', CAST(p_partkey % 10 AS VARCHAR)) AS DATE) AS date_posted,
   concat('Make a ', p_name) AS description_text, {PART} AS external_identifier FROM $part WHERE p_partkey % 6 = 0
 UNION ALL SELECT p_partkey, concat('https://acme', {PART}, '.example.com/careers/list'), 0, 0, concat('https://acme', {PART}, '.example.com/open/', {PART}), p_name, NULL, 'Paris', 'PART_TIME', NULL, NULL,
   concat('R-', {PART}) FROM $part WHERE p_partkey % 6 = 1
 UNION ALL SELECT p_partkey, concat('https://acme', {PART}, '.example.com/careers/list'), 0, 0, concat('https://acme', {PART}, '.example.com/careers/list'), p_name, NULL, NULL, NULL, NULL, NULL, NULL FROM $part WHERE p_partkey % 6 = 3
 UNION ALL SELECT p_partkey, concat('https://acme', {PART}, '.example.com/careers/list'), 0, 1, concat('https://acme', {PART}, '.example.com/careers/list'), 'second', NULL, 'DE', NULL, NULL, NULL, NULL FROM $part WHERE p_partkey % 6 = 3)
{HASHED}""")
def _(m):
    return P.jsonld_postings(m.sql(JSONLD_PAGES))


# --- vendor payloads: one feed per brand -----------------------------------

GREENHOUSE_FEEDS = """
SELECT p_partkey AS payload_id, p_partkey % 25 AS company_id, p_brand AS company_name, concat('https://boards-api.greenhouse.io/v1/boards/b', CAST(p_partkey AS STRING), '/jobs?content=true') AS source_url,
 concat('{"jobs":[{"id":', CAST(p_partkey AS STRING), ',"title":"', p_name, '","absolute_url":"https://job-boards.greenhouse.io/b/jobs/', CAST(p_partkey AS STRING), '/",',
   '"content":"&lt;p&gt;Build &amp;amp; run ', p_name, '&#39;s&lt;/p&gt;","location":{"name":"Austin"},"updated_at":"2024-02-0', CAST(p_partkey % 9 + 1 AS STRING), 'T10:00:00Z",',
   '"metadata":[{"name":"Employment Type","value":["Full","Part"]},{"name":"Team","value":"X"},{"name":"employment note","value":" ok "}]},',
   '{"id":"z', CAST(p_partkey AS STRING), '","title":"derived","absolute_url":null,"location":null,"updated_at":"n/a"},{"id":1,"title":" ","absolute_url":"https://boards.greenhouse.io/x/jobs/1"}]',
   CASE WHEN p_partkey % 10 = 3 THEN '' ELSE '}' END) AS body FROM $part"""


@check("greenhouse_postings", f"""
WITH f AS (SELECT *, p_partkey AS payload_id, p_partkey % 25 AS company_id, concat('https://boards-api.greenhouse.io/v1/boards/b', {PART}, '/jobs?content=true') AS source_url FROM $part WHERE p_partkey % 10 <> 3),
p AS (SELECT payload_id, company_id, 0 AS pos, source_url, concat('https://boards.greenhouse.io/b/jobs/', {PART}) AS canonical_url, p_name AS title, p_brand AS org_name, 'Austin' AS location_text,
  'Full, Part, ok' AS employment_type, CAST(concat('2024-02-0', CAST(p_partkey % 9 + 1 AS VARCHAR)) AS DATE) AS date_posted, concat('<p>Build &amp; run ', p_name, '''s</p>') AS description_text, {PART} AS external_identifier FROM f
 UNION ALL SELECT payload_id, company_id, 1, source_url, concat('https://boards.greenhouse.io/b', {PART}, '/jobs/z', {PART}), 'derived', p_brand, NULL, NULL, NULL, NULL, concat('z', {PART}) FROM f)
{HASHED}""")
def _(m):
    return D.greenhouse_postings(m.sql(GREENHOUSE_FEEDS))


LEVER_FEEDS = """
SELECT p_partkey AS payload_id, p_partkey % 25 AS company_id, p_brand AS company_name, concat('https://api.lever.co/v0/postings/b', CAST(p_partkey AS STRING)) AS source_url,
 concat('[{"id":"l', CAST(p_partkey AS STRING), '","text":"', p_name, '","hostedUrl":" ","applyUrl":"https://jobs.lever.co/b/', CAST(p_partkey AS STRING), '/apply","descriptionPlain":"","description":"<div>Work on <b>', p_name,
   '</b></div>","categories":{"location":"Berlin","commitment":"Full-time"},"createdAt":', CAST(1704067200000 + p_partkey * 86400000 AS STRING), '},{"id":"n","text":"no url"}]') AS body FROM $part"""


@check("lever_postings", f"""
WITH p AS (SELECT p_partkey AS payload_id, p_partkey % 25 AS company_id, 0 AS pos, concat('https://api.lever.co/v0/postings/b', {PART}) AS source_url, concat('https://jobs.lever.co/b/', {PART}, '/apply') AS canonical_url,
  p_name AS title, p_brand AS org_name, 'Berlin' AS location_text, 'Full-time' AS employment_type, DATE '2024-01-01' + CAST(p_partkey AS INT) AS date_posted, concat('Work on ', p_name) AS description_text,
  concat('l', {PART}) AS external_identifier FROM $part) {HASHED}""")
def _(m):
    return D.lever_postings(m.sql(LEVER_FEEDS))


WORKDAY_FEEDS = """
SELECT p_partkey AS payload_id, p_partkey % 25 AS company_id, CAST(p_partkey AS INT) AS page_no, concat('https://t', CAST(p_partkey % 25 AS STRING), '.wd5.myworkdayjobs.com/en-US/External') AS endpoint_url,
 concat('https://t', CAST(p_partkey % 25 AS STRING), '.wd5.myworkdayjobs.com/wday/cxs/t/External/jobs') AS source_url,
 concat('{"total":', CAST(p_partkey % 7 AS STRING), ',"paging":{"totalCount":"9"},"jobPostings":[{"title":"', p_name, '","externalPath":"/job/Austin/', 'X_R', CAST(p_partkey AS STRING), '","postedOn":"Posted today","bulletinDate":"2024-02-01",',
   '"locationsText":"Austin","timeType":"Full time","shortDescription":"<p>Do ', p_name, '</p>"},{"jobTitle":"second","externalPath":"https://community.workday.com/invalid-url","jobUrl":"https://t.wd1.myworkdayjobs.com/External/job/a/B_', CAST(p_partkey AS STRING),
   '?q=1","locations":[{"name":"Paris"},{"city":"Rome"}],"id":"S', CAST(p_partkey AS STRING), '","workerSubType":"Regular","startDate":"2024-03-01"},{"title":"no url"},{"title":"api","url":"https://t.wd1.myworkdayjobs.com/External/jobs"}]}') AS body FROM $part"""


@check("workday_postings", f"""
WITH f AS (SELECT *, p_partkey AS payload_id, p_partkey % 25 AS company_id, CAST(p_partkey AS INT) AS page_no, concat('https://t', CAST(p_partkey % 25 AS VARCHAR), '.wd5.myworkdayjobs.com/wday/cxs/t/External/jobs') AS source_url FROM $part),
p AS (SELECT payload_id, company_id, page_no, 0 AS pos, source_url, concat('https://t', CAST(company_id AS VARCHAR), '.wd5.myworkdayjobs.com/en-US/External/job/Austin/X_R', {PART}) AS canonical_url, p_name AS title, CAST(NULL AS VARCHAR) AS org_name,
  'Austin' AS location_text, 'Full time' AS employment_type, DATE '2024-02-01' AS date_posted, concat('Do ', p_name) AS description_text, concat('R', {PART}) AS external_identifier FROM f
 UNION ALL SELECT payload_id, company_id, page_no, 1, source_url, concat('https://t.wd1.myworkdayjobs.com/External/job/a/B_', {PART}, '?q=1'), 'second', NULL, 'Paris | Rome', 'Regular', DATE '2024-03-01', NULL, concat('S', {PART}) FROM f)
{HASHED}""")
def _(m):
    return D.workday_postings(m.sql(WORKDAY_FEEDS))


@check("workday_summary", """
SELECT p_partkey % 25 AS company_id, least(count(*) * 2, 100) AS extracted, count(*) * 2 >= 100 AS truncated, max(CASE WHEN p_partkey % 7 > 0 THEN CAST(p_partkey % 7 AS INT) ELSE 9 END) AS total_jobs_available FROM $part GROUP BY 1""")
def _(m):
    return D.workday_summary(m.sql(WORKDAY_FEEDS), 100)


@check("workday_feed_cap", """
SELECT company_id, page_no, pos FROM (SELECT p_partkey % 25 AS company_id, CAST(p_partkey AS INT) AS page_no, pos, row_number() OVER (PARTITION BY p_partkey % 25 ORDER BY p_partkey, pos) AS rn
  FROM $part, (VALUES (0), (1)) v(pos)) x WHERE rn <= 50""")
def _(m):
    return D.cap_feed(D.workday_postings(m.sql(WORKDAY_FEEDS)), ["company_id"], 50).select("company_id", "page_no", "pos")


@check("greenhouse_feed_summary", """
SELECT p_partkey % 25 AS company_id, least(count(*) * 2, 90) AS extracted, count(*) * 2 > 90 AS truncated FROM $part WHERE p_partkey % 10 <> 3 GROUP BY 1""")
def _(m):
    return D.feed_summary(D.greenhouse_postings(m.sql(GREENHOUSE_FEEDS)), ["company_id"], 90)


# --- sitemaps: an index per customer naming documents of parts -------------

SITEMAP_DOCS = """
SELECT concat('https://s', CAST(p_partkey AS STRING), '.example.com/sitemap.xml') AS url, CAST(NULL AS STRING) AS final_url, CASE WHEN p_partkey % 5 = 1 THEN 'GZIP' END AS content_encoding,
 CASE WHEN p_partkey % 4 = 0 THEN concat('<?xml version="1.0"?><sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><sitemap><loc> https://s', CAST(p_partkey + 1 AS STRING), '.example.com/sitemap.xml </loc></sitemap>',
    '<sitemap><loc>s', CAST(p_partkey + 2 AS STRING), '.example.com/sitemap.xml</loc></sitemap><sitemap><loc>https://s', CAST(p_partkey + 4 AS STRING), '.example.com/sitemap.xml</loc></sitemap></sitemapindex>')
  WHEN p_partkey % 4 = 1 THEN concat('<urlset><url><loc>https://x.example.com/', CAST(p_partkey AS STRING), '?a=1&amp;b=2</loc><lastmod>2024-01-01</lastmod></url><url><image:image><image:loc>https://i.example.com/1.png</image:loc></image:image>',
    '<loc><![CDATA[https://x.example.com/shared]]></loc></url><url><loc>https://x.example.com/', CAST(p_partkey AS STRING), '?a=1&amp;b=2</loc></url><url><loc> </loc></url></urlset>')
  ELSE concat('<urlset><url><loc>https://x.example.com/only', CAST(p_partkey AS STRING), '</loc></url>') END AS xml FROM $part"""


@F.pandas_udf(T.BinaryType())
def packed(texts):
    import gzip
    return texts.map(lambda t: gzip.compress(t.encode()))


def documents(m):
    """The stored documents: every fifth is gzip bytes, the others plain."""
    docs = m.sql(SITEMAP_DOCS)
    zipped = docs.where("content_encoding = 'GZIP'").withColumn("body", packed("xml"))
    plain = docs.where("content_encoding IS NULL").withColumn("body", F.encode("xml", "UTF-8"))
    return S.document_texts(zipped.unionByName(plain).drop("xml"))


@check("document_texts", f"SELECT url, xml AS text FROM ({SITEMAP_DOCS}) d")
def _(m):
    return documents(m).select("url", "text")


CHILDREN = """
SELECT concat('https://s', CAST(p_partkey AS VARCHAR), '.example.com/sitemap.xml') AS url, CAST(v.pos AS INT) AS pos, concat('https://s', CAST(p_partkey + v.step AS VARCHAR), '.example.com/sitemap.xml') AS child_url
FROM $part, (VALUES (0, 1), (1, 2), (2, 4)) v(pos, step) WHERE p_partkey % 4 = 0"""
PAGE_URLS = f"""
SELECT concat('https://s', {PART}, '.example.com/sitemap.xml') AS url, 0 AS pos, concat('https://x.example.com/', {PART}, '?a=1&b=2') AS loc, '2024-01-01' AS lastmod FROM $part WHERE p_partkey % 4 = 1
UNION ALL SELECT concat('https://s', {PART}, '.example.com/sitemap.xml'), 1, 'https://x.example.com/shared', NULL FROM $part WHERE p_partkey % 4 = 1
UNION ALL SELECT concat('https://s', {PART}, '.example.com/sitemap.xml'), 0, concat('https://x.example.com/only', {PART}), NULL FROM $part WHERE p_partkey % 4 > 1"""


@check("child_sitemaps", CHILDREN)
def _(m):
    return S.child_sitemaps(documents(m))


@check("sitemap_page_urls", PAGE_URLS)
def _(m):
    return S.page_urls(documents(m), 2000)


SEEDS = """
SELECT c_custkey AS company_id, 0 AS pos, concat('https://s', CAST(c_custkey AS STRING), '.example.com/sitemap.xml') AS url FROM $customer
UNION ALL SELECT c_custkey, 1, concat('s', CAST(c_custkey + 4 AS STRING), '.example.com/sitemap.xml') FROM $customer WHERE c_acctbal > 5000"""

def closure_sql(children):
    return f"""
WITH RECURSIVE links AS ({children}),
 seeds AS (SELECT company_id, CAST(pos AS INT) AS pos, CASE WHEN url LIKE 'https://%' THEN url ELSE concat('https://', url) END AS url FROM ({SEEDS}) s),
 l0 AS (SELECT company_id, url, 0 AS depth, row_number() OVER (PARTITION BY company_id ORDER BY pos) AS rank FROM seeds),
 n1 AS (SELECT l.company_id, k.child_url AS url, min((l.rank, k.pos)) AS place FROM l0 l JOIN links k ON k.url = l.url GROUP BY 1, 2),
 l1 AS (SELECT company_id, url, 1 AS depth, row_number() OVER (PARTITION BY company_id ORDER BY place) AS rank FROM n1 n WHERE NOT EXISTS (SELECT 1 FROM l0 WHERE l0.company_id = n.company_id AND l0.url = n.url)),
 n2 AS (SELECT l.company_id, k.child_url AS url, min((l.rank, k.pos)) AS place FROM l1 l JOIN links k ON k.url = l.url GROUP BY 1, 2),
 l2 AS (SELECT company_id, url, 2 AS depth, row_number() OVER (PARTITION BY company_id ORDER BY place) AS rank FROM n2 n WHERE NOT EXISTS (SELECT 1 FROM (SELECT company_id, url FROM l0 UNION ALL SELECT company_id, url FROM l1) v
     WHERE v.company_id = n.company_id AND v.url = n.url)),
 n3 AS (SELECT l.company_id, k.child_url AS url, min((l.rank, k.pos)) AS place FROM l2 l JOIN links k ON k.url = l.url GROUP BY 1, 2),
 l3 AS (SELECT company_id, url, 3 AS depth, row_number() OVER (PARTITION BY company_id ORDER BY place) AS rank FROM n3 n WHERE NOT EXISTS (SELECT 1 FROM (SELECT company_id, url FROM l0 UNION ALL SELECT company_id, url FROM l1
     UNION ALL SELECT company_id, url FROM l2) v WHERE v.company_id = n.company_id AND v.url = n.url)),
 every AS (SELECT * FROM l0 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3),
 closed AS (SELECT company_id, url, depth, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY depth, rank) AS rn FROM every) x WHERE rn <= 7)"""


CLOSURE = closure_sql(CHILDREN)


@check("sitemap_closure", f"{CLOSURE} SELECT * FROM closed")
def _(m):
    return S.sitemap_closure(documents(m), m.sql(SEEDS), max_documents=7)


@check("sitemap_closure_urls", f"""{CLOSURE}, pu AS ({PAGE_URLS}),
 f AS (SELECT DISTINCT ON (c.company_id, p.loc) c.company_id, p.loc, p.lastmod, c.depth, c.rank, p.pos FROM closed c JOIN pu p ON p.url = c.url ORDER BY c.company_id, p.loc, c.depth, c.rank, p.pos)
SELECT company_id, loc, lastmod FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY depth, rank, pos) AS rn FROM f) x WHERE rn <= 4""")
def _(m):
    docs = documents(m)
    return S.closure_urls(docs, S.sitemap_closure(docs, m.sql(SEEDS), max_documents=7), 4)


# --- robots ----------------------------------------------------------------

ROBOTS_DOCS = """
SELECT host, concat('# hello', chr(10), 'User-agent: googlebot', chr(10), 'Disallow: /private', chr(10), chr(10), 'User-Agent: a', chr(10), 'user-agent: *', chr(10),
  'Disallow: /', CASE WHEN k % 3 = 0 THEN 'en' ELSE 'fr' END, '/ # no', chr(10), 'junk line', chr(10), 'Allow: /en/', CAST(k % 10 AS STRING), '*', chr(10), 'Disallow: /*.html$', chr(10),
  'Sitemap: https://', host, '/map.xml', chr(10), 'Allow:', chr(10), 'Disallow: fr/9', chr(13), chr(10), '# gap', chr(10), 'Disallow: /lost', chr(10), 'Sitemap: https://', host, '/late.xml') AS text
FROM (SELECT regexp_extract(lower(url), '^https?://([^/?#]+)', 1) AS host, min(page_id) AS k FROM $pages GROUP BY regexp_extract(lower(url), '^https?://([^/?#]+)', 1)) h"""
HOSTS = "(SELECT regexp_extract(lower(url), '^https?://([^/?#]+)', 1) AS host, min(page_id) AS k FROM $pages GROUP BY 1) h"
RULES_SQL = f"""SELECT host, 'L1' AS r, concat('/', CASE WHEN k % 3 = 0 THEN 'en' ELSE 'fr' END, '/') AS path, false AS allow FROM {HOSTS}
 UNION ALL SELECT host, 'L2', concat('/en/', CAST(k % 10 AS VARCHAR), '*'), true FROM {HOSTS} UNION ALL SELECT host, 'L3', '/*.html$', false FROM {HOSTS} UNION ALL SELECT host, 'L4', 'fr/9', false FROM {HOSTS}"""


@check("robots_rules", f"SELECT host, path, allow FROM ({RULES_SQL}) r")
def _(m):
    return S.robots_rules(m.sql(ROBOTS_DOCS)).select("host", "path", "allow")


@check("robots_sitemaps", f"""
SELECT host, concat('https://', host, '/map.xml') AS sitemap_url FROM {HOSTS} UNION ALL SELECT host, concat('https://', host, '/late.xml') FROM {HOSTS}""")
def _(m):
    return S.robots_sitemaps(m.sql(ROBOTS_DOCS)).select("host", "sitemap_url")


@check("robots_decisions", f"""
WITH r AS ({RULES_SQL}), u AS (SELECT page_id AS url_id, regexp_extract(lower(url), '^https?://([^/?#]+)', 1) AS host,
    concat(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), CASE WHEN strpos(url, '?') > 0 THEN concat('?', regexp_extract(url, '[?]([^#]*)', 1)) ELSE '' END) AS subject FROM $pages),
 hit AS (SELECT url_id, length(path) AS n, allow FROM u JOIN r ON r.host = u.host WHERE CASE r.r WHEN 'L2' THEN starts_with(subject, rtrim(path, '*')) WHEN 'L3' THEN subject LIKE '/%.html' WHEN 'L4' THEN starts_with(subject, '/fr/9')
    ELSE starts_with(subject, path) END)
SELECT u.url_id, coalesce((SELECT max((n, allow)) FROM hit WHERE hit.url_id = u.url_id)[2], true) AS allowed FROM u""")
def _(m):
    urls = m.pages.select(F.col("page_id").alias("url_id"), "url")
    return S.robots_decisions(urls, S.robots_rules(m.sql(ROBOTS_DOCS)))


SEED_DOMAINS = "SELECT page_id AS company_id, CASE WHEN page_id % 2 = 0 THEN concat(' ', upper(regexp_extract(url, '^https?://([^/?#]+)', 1))) ELSE concat('lone', CAST(page_id AS STRING), '.example.com') END AS domain FROM $pages"


@check("seed_sitemaps", f"""
SELECT page_id AS company_id, host, concat('https://', host, v.path) AS sitemap_url FROM (SELECT page_id, regexp_extract(lower(url), '^https?://([^/?#]+)', 1) AS host FROM $pages WHERE page_id % 2 = 0) x,
  (VALUES ('/map.xml'), ('/late.xml')) v(path)
UNION ALL SELECT page_id, concat('lone', {ID}, '.example.com'), concat('https://', w.www, 'lone', {ID}, '.example.com/sitemap.xml') FROM $pages, (VALUES (''), ('www.')) w(www) WHERE page_id % 2 = 1""")
def _(m):
    robots = S.robots_sitemaps(m.sql(ROBOTS_DOCS))
    return S.seed_sitemaps(m.sql(SEED_DOMAINS), robots, with_www=True).select("company_id", "host", "sitemap_url")


@check("urls_worth_reading", """
SELECT DISTINCT company_id, url FROM $discovered_urls u WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.company_id = u.company_id AND k.url = u.url)""".replace(
    "SELECT DISTINCT", "WITH known AS (SELECT company_id, url FROM $discovered_urls WHERE fetch_status = 'no_jobposting_structured_data') SELECT DISTINCT", 1))
def _(m):
    urls = m.discovered_urls.select("company_id", "url").distinct()
    return S.split_known_unstructured(urls, m.discovered_urls)[0]


@check("known_unstructured", """
SELECT DISTINCT company_id, url FROM $discovered_urls WHERE fetch_status = 'no_jobposting_structured_data'""")
def _(m):
    urls = m.discovered_urls.select("company_id", "url").distinct()
    return S.split_known_unstructured(urls, m.discovered_urls)[1]


PROBE_COMPANIES = "SELECT c_custkey AS company_id, concat('d', CAST(c_custkey AS STRING), '.example.com') AS domain, CASE WHEN c_custkey % 2 = 0 THEN concat(' https://d', CAST(c_custkey AS STRING), '.example.com/jobs ') END AS careers_hint_url FROM $customer"
PROBE_LANDING = "SELECT o_custkey AS company_id, o_orderkey AS pos, concat('https://boards.greenhouse.io/', CAST(o_orderkey % 3 AS STRING)) AS url FROM $orders WHERE o_orderstatus = 'P'"
PROBE_CANDIDATES = "SELECT o_custkey AS company_id, o_orderkey AS pos, concat('https://d', CAST(o_custkey AS STRING), '.example.com/', CASE WHEN o_orderkey % 9 = 0 THEN 'careers' ELSE CAST(o_orderkey AS STRING) END) AS url FROM $orders"


@check("probe_plan", f"""
WITH h AS (SELECT company_id, 0 AS kind, p AS pos, url FROM (SELECT company_id, 0 AS p, trim(careers_hint_url) AS url FROM ({PROBE_COMPANIES}) a WHERE careers_hint_url IS NOT NULL
    UNION ALL SELECT company_id, 1, concat('https://', domain, '/careers') FROM ({PROBE_COMPANIES}) a UNION ALL SELECT company_id, 2, concat('https://', domain, '/jobs') FROM ({PROBE_COMPANIES}) a) x
  UNION ALL SELECT company_id, 1, pos, url FROM ({PROBE_LANDING}) l UNION ALL SELECT company_id, 2, pos, url FROM ({PROBE_CANDIDATES}) c),
 f AS (SELECT company_id, kind, min(pos) AS pos, url FROM (SELECT *, min(kind) OVER (PARTITION BY company_id, url) AS best FROM h) y WHERE kind = best GROUP BY 1, 2, 4),
 n AS (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY kind, pos, url) AS rn FROM f)
SELECT company_id, url, kind FROM n WHERE kind < 2 OR rn <= 8""")
def _(m):
    return S.probe_plan(m.sql(PROBE_COMPANIES), m.sql(PROBE_LANDING), m.sql(PROBE_CANDIDATES), 8).select("company_id", "url", "kind")


# every eleventh sitemap is broken in one of four ways, every thirteenth blocked
FETCHED = f"""
SELECT d.url, final_url, CASE WHEN k % 11 = 3 THEN 'gzip' WHEN k % 11 <> 5 THEN content_encoding END AS content_encoding, CASE WHEN k % 11 = 5 THEN ' ' ELSE xml END AS xml,
  CASE WHEN k % 11 = 6 THEN 503 WHEN k % 11 = 7 THEN 0 ELSE 200 END AS http_status, CASE WHEN k % 22 = 7 THEN 'timeout' END AS error_code, k
FROM ({SITEMAP_DOCS}) d JOIN (SELECT concat('https://s', CAST(p_partkey AS STRING), '.example.com/sitemap.xml') AS url, p_partkey AS k FROM $part) p ON p.url = d.url"""
OUTCOMES = f"""
SELECT url, k, CASE WHEN k % 13 = 6 THEN 'blocked_by_robots' WHEN k % 22 = 7 THEN 'timeout' WHEN k % 11 = 6 THEN 'http_503' WHEN k % 11 = 7 THEN 'unknown_error'
  WHEN k % 11 = 3 THEN 'gzip_decode_error' WHEN k % 11 = 5 THEN 'empty_sitemap_payload' END AS error FROM ({FETCHED}) f"""


def outcomes(m):
    docs = m.sql(FETCHED)
    # those of k % 11 = 3 say gzip and are not
    good = F.expr("content_encoding = 'GZIP' AND k % 11 <> 3")
    zipped = docs.where(good).withColumn("body", packed("xml"))
    plain = docs.where(~F.coalesce(good, F.lit(False))).withColumn("body", F.encode("xml", "UTF-8"))
    return S.sitemap_outcomes(zipped.unionByName(plain), docs.where("k % 13 = 6"))


@check("sitemap_outcomes", f"SELECT url, error, error IS NULL AS has_text FROM ({OUTCOMES}) o")
def _(m):
    return outcomes(m).select("url", "error", F.col("text").isNotNull().alias("has_text"))


GOOD = f"(SELECT url AS good FROM ({OUTCOMES}) o WHERE error IS NULL)"
FETCHES = closure_sql(f"SELECT c.* FROM ({CHILDREN}) c JOIN {GOOD} g ON g.good = c.url") + f""",
 pu AS (SELECT p.* FROM ({PAGE_URLS}) p JOIN {GOOD} g ON g.good = p.url),
 f AS (SELECT DISTINCT ON (c.company_id, p.loc) c.company_id, p.loc, c.url FROM closed c JOIN pu p ON p.url = c.url ORDER BY c.company_id, p.loc, c.depth, c.rank, p.pos),
 n AS (SELECT company_id, url, count(*) AS new FROM f GROUP BY 1, 2),
 v AS (SELECT c.company_id, c.url, c.depth, c.rank, CASE WHEN o.url IS NULL THEN 'unknown_error' ELSE o.error END AS error, coalesce(n.new, 0) AS new FROM closed c
   LEFT JOIN ({OUTCOMES}) o ON o.url = c.url LEFT JOIN n ON n.company_id = c.company_id AND n.url = c.url),
 t AS (SELECT *, coalesce(sum(new) OVER (PARTITION BY company_id ORDER BY depth, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS had FROM v),
 fetches AS (SELECT company_id, url, depth, rank, error, CAST(CASE WHEN error IS NULL THEN least(new, 4 - had) END AS BIGINT) AS new_urls FROM t WHERE had < 4)"""


def fetches(m):
    known = outcomes(m)
    closure = S.sitemap_closure(known.where("error IS NULL"), m.sql(SEEDS), max_documents=7)
    return S.sitemap_fetches(known, closure, 4)


@check("sitemap_fetches", f"{FETCHES} SELECT * FROM fetches")
def _(m):
    return fetches(m)


@check("sitemap_errors", f"{FETCHES} SELECT company_id, error, count(*) AS total FROM fetches WHERE error IS NOT NULL GROUP BY 1, 2")
def _(m):
    return S.sitemap_errors(fetches(m))


# --- company tables and domain resolution ----------------------------------

TABLE_PAGES = """
SELECT page_id, concat(html, CASE page_id % 3 WHEN 0 THEN '<table><tr><th>Name</th><th>Other</th></tr><tr><td>a</td><td>b</td></tr></table>' ELSE '' END,
 CASE page_id % 4 WHEN 3 THEN '' ELSE concat('<table class="w"', CASE page_id % 4 WHEN 1 THEN ' id="constituents"' ELSE '' END, '><tbody><tr><th>Symbol</th><th><a href="/x">Security</a></th><th>GICS&nbsp;Sector</th><th>CIK</th></tr>',
   '<tr><td><a>t', CAST(page_id AS STRING), '</a></td><td><a href="/wiki/Co_', CAST(page_id AS STRING), '#x">Company &amp; ', CAST(page_id AS STRING), '</a>[2]</td><td>Energy</td><td>', CAST(page_id AS STRING), '</td></tr>',
   '<tr><td></td><td>lost</td><td>x</td><td>1</td></tr><tr><td>only</td></tr></tbody></table>') END) AS html FROM $pages"""


@check("constituents", f"""
SELECT page_id, 1 AS pos, concat('T', {ID}) AS ticker, concat('Company & ', {ID}) AS name, 'Energy' AS sector, lpad({ID}, 10, '0') AS cik, concat('Co_', {ID}) AS wikipedia_title FROM $pages WHERE page_id % 4 <> 3""")
def _(m):
    return P.constituents(m.sql(TABLE_PAGES))


MATCH_TITLES = """
SELECT concat('Customer ', CAST(c_custkey AS STRING), CASE WHEN c_custkey % 2 = 0 THEN ' Group' ELSE '' END) AS variant, concat('Q', CAST(c_custkey AS STRING)) AS qid,
  CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'http://bad host/' ELSE concat('https://www.t', CAST(c_custkey AS STRING), '.example.com/home') END AS website FROM $customer WHERE c_acctbal > 2000"""
MATCH_CIKS = """
SELECT CAST(c_custkey AS STRING) AS variant, concat('QC', CAST(c_custkey AS STRING)) AS qid, CASE c_custkey % 4 WHEN 0 THEN ' ' ELSE concat('c', CAST(c_custkey AS STRING), '.example.com') END AS website
FROM $customer WHERE c_acctbal < 6000"""
MATCH_BOXES = "SELECT c_custkey AS company_id, concat('i', CAST(c_custkey AS STRING), '.example.com') AS domain FROM $customer WHERE c_nationkey < 5"
MATCH_VERIFIED = """SELECT c_custkey AS company_id, 1 AS rank, concat('v', CAST(c_custkey AS STRING), '.example.io') AS domain FROM $customer WHERE c_nationkey > 18
UNION ALL SELECT c_custkey, 0, concat('w', CAST(c_custkey AS STRING), '.example.co') FROM $customer WHERE c_nationkey > 21"""


@check("resolve_domains", f"""
WITH t AS ({MATCH_TITLES}), k AS ({MATCH_CIKS}), b AS ({MATCH_BOXES}), v AS (SELECT company_id, min_by(domain, rank) AS domain FROM ({MATCH_VERIFIED}) x GROUP BY 1),
 c AS (SELECT *, id AS company_id, coalesce(domain_resolution_attempted_at + INTERVAL 720 MINUTE > TIMESTAMP '2024-01-15 00:00:00', false) AS fresh FROM $companies),
 s AS (SELECT c.*, wikipedia_title IS NOT NULL AS ht, cik IS NOT NULL AS hc, fresh AND coalesce(domain_resolution_method = 'WIKIPEDIA_TITLE', false) AS tc, fresh AND coalesce(domain_resolution_method = 'CIK', false) AS kc,
    coalesce(t1.variant, t2.variant) IS NOT NULL AS t_hit, CASE WHEN t1.variant IS NOT NULL THEN t1.website ELSE t2.website END AS t_web, CASE WHEN t1.variant IS NOT NULL THEN t1.qid ELSE t2.qid END AS t_qid,
    k.variant IS NOT NULL AS k_hit, k.website AS k_web, k.qid AS k_qid, b.domain AS b_dom, v.domain AS v_dom
   FROM c LEFT JOIN t t1 ON t1.variant = concat('Customer ', CAST(c.id AS VARCHAR), ' Group') AND c.wikipedia_title IS NOT NULL LEFT JOIN t t2 ON t2.variant = concat('Customer ', CAST(c.id AS VARCHAR)) AND c.wikipedia_title IS NOT NULL
   LEFT JOIN k ON k.variant = CAST(c.id AS VARCHAR) AND c.cik IS NOT NULL LEFT JOIN b ON b.company_id = c.id LEFT JOIN v ON v.company_id = c.id),
 z AS (SELECT *, CASE WHEN NOT t_hit THEN 'NO_ITEM' WHEN t_web IS NULL THEN 'NO_P856' WHEN strpos(t_web, ' ') > 0 THEN 'INVALID_WEBSITE_URL' ELSE 'RESOLVED' END AS ts,
    CASE WHEN NOT k_hit THEN 'NO_ITEM' WHEN trim(k_web) = '' THEN 'NO_P856' ELSE 'RESOLVED' END AS ks FROM s),
 y AS (SELECT *, ht AND NOT tc AS ut, CASE WHEN ht THEN tc AND NOT (hc AND NOT kc) ELSE hc AND kc END AS cached FROM z),
 x AS (SELECT *, hc AND NOT kc AND NOT (ut AND ts = 'RESOLVED') AS uk FROM y),
 w AS (SELECT *, CASE WHEN cached THEN 'CACHED' WHEN ut AND ts = 'RESOLVED' THEN 'WIKIPEDIA_TITLE' WHEN uk AND ks = 'RESOLVED' THEN 'CIK' WHEN (ut OR uk) AND ht AND b_dom IS NOT NULL THEN 'WIKIPEDIA_INFOBOX'
    WHEN v_dom IS NOT NULL THEN 'HEURISTIC_NAME' END AS how FROM x)
SELECT company_id, CASE WHEN how = 'CACHED' THEN 'CACHED' WHEN how IS NOT NULL THEN 'RESOLVED' WHEN uk THEN ks WHEN ut THEN ts ELSE 'NO_IDENTIFIER' END AS status,
  CASE WHEN how = 'CACHED' THEN domain_resolution_method WHEN how IS NOT NULL THEN how WHEN uk THEN 'CIK' WHEN ut THEN 'WIKIPEDIA_TITLE' WHEN ht AND NOT tc THEN 'WIKIPEDIA_TITLE' WHEN hc THEN 'CIK' ELSE 'NONE' END AS method,
  CASE WHEN how IS NULL THEN CASE WHEN uk THEN lower(ks) WHEN ut THEN lower(ts) WHEN ht AND NOT tc THEN 'no_wikipedia_title' WHEN hc THEN 'no_cik' ELSE 'no_identifier' END END AS error,
  CASE how WHEN 'WIKIPEDIA_TITLE' THEN regexp_replace(t_web, '^https://www[.]([^/]+)/.*$', '\\1') WHEN 'CIK' THEN k_web WHEN 'WIKIPEDIA_INFOBOX' THEN b_dom WHEN 'HEURISTIC_NAME' THEN v_dom END AS domain,
  CASE how WHEN 'WIKIPEDIA_TITLE' THEN 'WIKIDATA' WHEN 'CIK' THEN 'WIKIDATA' WHEN 'WIKIPEDIA_INFOBOX' THEN 'WIKIPEDIA' WHEN 'HEURISTIC_NAME' THEN 'HEURISTIC' END AS source,
  CASE how WHEN 'WIKIPEDIA_TITLE' THEN 0.95e0 WHEN 'CIK' THEN 0.95e0 WHEN 'WIKIPEDIA_INFOBOX' THEN 0.9e0 WHEN 'HEURISTIC_NAME' THEN 0.7e0 END AS confidence,
  CASE how WHEN 'WIKIPEDIA_TITLE' THEN 'enwiki_sitelink' WHEN 'CIK' THEN 'cik' WHEN 'WIKIPEDIA_INFOBOX' THEN 'WIKIPEDIA_INFOBOX'
    WHEN 'HEURISTIC_NAME' THEN concat('HEURISTIC_NAME_', upper(regexp_extract(v_dom, '[.]([a-z]+)$', 1))) END AS resolution_method,
  CASE how WHEN 'WIKIPEDIA_TITLE' THEN t_qid WHEN 'CIK' THEN k_qid END AS wikidata_qid FROM w""")
def _(m):
    rows = m.companies.withColumnRenamed("id", "company_id")
    return resolve_domains(rows, m.sql(MATCH_TITLES), m.sql(MATCH_CIKS), m.sql(MATCH_BOXES), m.sql(MATCH_VERIFIED), "2024-01-15 00:00:00")
