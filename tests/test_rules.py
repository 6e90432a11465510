"""Literal rows for single rules: URLs, vendors, names, texts."""

import pytest
from pyspark.sql import functions as F

from rolecall.functions import reasons, urls, vendors
from rolecall.functions.hashing import string_hash_hex
from rolecall.functions.text import html_to_text, iso_date, like_contains, strip_controls, unescape_html
from rolecall.operators import feeds, normalize, pages, postings, targets


def each(rows, expr, cases, kind="string"):
    """Apply an expression of column ``x`` to the inputs of cases and compare."""
    df = rows("i int, x string", *[(i, c[0]) for i, c in enumerate(cases)])
    got = [r[0] for r in df.orderBy("i").select(expr(F.col("x"))).collect()]
    assert got == [c[1] for c in cases]


def test_canonical_url(rows):
    each(rows, urls.canonical_url, [
        ("HTTPS://Example.COM:443/Jobs//Open/?utm_source=x&B=2&a=1#top", "https://example.com/Jobs/Open?a=1&b=2"),
        ("example.com", "https://example.com/"),
        ("http://example.com:80/", "http://example.com/"),
        ("http://example.com:8080/a/", "http://example.com:8080/a"),
        ("https://user:pw@example.com/x?b=2&b=1&gclid=9", "https://example.com/x?b=1&b=2"),
        ("https://example.com/a+b?q=c+d", "https://example.com/a+b?q=c%20d"),
        ("https://example.com/%41?x=%26", "https://example.com/A?x=%26"),
        ("https://exa mple.com/", None), ("   ", None), (None, None), ("ftp://example.com/", "https://ftp/example.com"),
    ])


def test_candidate_url(rows):
    each(rows, urls.candidate_url, [
        ("Example.com/Careers/?ref=a&z=1&utm_medium=b&a=2", "https://example.com/Careers/?z=1&a=2"),
        ("//example.com/jobs/", "https://example.com/jobs"), ("http://x.co/?gh_src=1", "http://x.co"),
    ])


def test_posting_url(rows):
    each(rows, urls.posting_url, [
        (" https://x.example.com/job/1 ", "https://x.example.com/job/1"),
        ("https://community.workday.com/invalid-url", None), ("ftp://x.example.com/", None),
        ("https://boards-api.greenhouse.io/v1/boards/a/jobs/1", None),
        ("https://api.lever.co/v0/postings/a/1", None), ("https://api.lever.co/other", "https://api.lever.co/other"),
        ("https://a.wd5.myworkdayjobs.com/Ext/jobs/", None), ("https://a.wd5.myworkdayjobs.com/wday/cxs/a/b/jobs", None),
        ("https://a.wd5.myworkdayjobs.com/Ext/job/1", "https://a.wd5.myworkdayjobs.com/Ext/job/1"), ("job/1", None),
    ])


def test_resolve_url(rows):
    base = F.lit("https://example.com/careers/list?x=1")
    each(rows, lambda x: urls.resolve_url(base, x), [
        ("/jobs", "https://example.com/jobs"), ("open/1", "https://example.com/careers/open/1"),
        ("../team/./a", "https://example.com/team/a"), ("//cdn.example.com/z", "https://cdn.example.com/z"),
        ("?p=2", "https://example.com/careers/list?p=2"), ("https://other.example.com/", "https://other.example.com/"),
        ("../../../x", "https://example.com/x"),
    ])


def test_endpoint_url(rows):
    def stored(vendor):
        return lambda x: vendors.endpoint_url(F.lit(vendor), x)

    each(rows, stored("GREENHOUSE"), [
        ("job-boards.greenhouse.io/acme/", "https://boards.greenhouse.io/acme"),
        ("https://api.greenhouse.io/v1/boards/acme?x=1", "https://boards-api.greenhouse.io/v1/boards/acme?x=1"),
        ("bad url here", "bad url here"), (" ", None),
    ])
    each(rows, stored("WORKDAY"), [("https://A.wd1.myworkdayjobs.com/Ext.,", "https://a.wd1.myworkdayjobs.com/Ext")])
    each(rows, stored("ICIMS"), [
        ("https://careers.icims.com/jobs/acme/intro", "https://careers.icims.com/jobs/acme/jobs"),
        ("https://careers.icims.com/jobs/acme", "https://careers.icims.com/jobs/search"),
        ("https://acme.icims.com/x", "https://acme.icims.com/jobs/search"),
    ])
    each(rows, stored("TALEO"), [
        ("https://a.taleo.net/careersection/2/moresearch.ftl?lang=en", "https://a.taleo.net/careersection/2/jobsearch.ftl"),
        ("https://a.taleo.net/other", "https://a.taleo.net/other"),
    ])
    each(rows, stored("SUCCESSFACTORS"), [("https://career5.successfactors.eu/x?y", "https://career5.successfactors.eu/career")])


@pytest.mark.parametrize("html, found", [
    ('<a href="https://boards.greenhouse.io/acme">', [("GREENHOUSE", "https://boards.greenhouse.io/acme")]),
    ('"https://boards.greenhouse.io/embed/job_board?for=acme&b=1"', [("GREENHOUSE", "https://boards.greenhouse.io/acme")]),
    ("https://jobs.lever.co/acme/1 https://jobs.lever.co/ACME", [("LEVER", "https://jobs.lever.co/acme")]),
    ("https://acme.wd5.myworkdayjobs.com/en-US/External/job/1", [("WORKDAY", "https://acme.wd5.myworkdayjobs.com/en-US/External")]),
    ("https://acme.wd5.myworkdayjobs.com/wday/cxs/acme/Ext/jobs", [("WORKDAY", "https://acme.wd5.myworkdayjobs.com/Ext")]),
    ("https://jobs.smartrecruiters.com/Acme/1", [("SMARTRECRUITERS", "https://careers.smartrecruiters.com/Acme")]),
    ("https://acme.icims.com/jobs/search?a=b", [("ICIMS", "https://acme.icims.com/jobs/search")]),
    ("https://acme.taleo.net/careersection/2/jobsearch.ftl?lang=en", [("TALEO", "https://acme.taleo.net/careersection/2/jobsearch.ftl")]),
    ("https://career4.successfactors.com/career?company=A", [("SUCCESSFACTORS", "https://career4.successfactors.com/career")]),
    ("nothing here", []),
])
def test_vendor_endpoints(rows, html, found):
    df = pages.vendor_endpoints(rows("page_id int, url string, html string", (1, "https://x.example.com/", html)))
    assert [(r.vendor, r.ats_url) for r in df.orderBy("pos").collect()] == found


def test_workday_candidates(rows):
    def made(x):
        return feeds.workday_url_candidates(F.lit("acme.wd5.myworkdayjobs.com"), F.lit("External"), x)

    df = rows("i int, x string", (0, "https://acme.wd5.myworkdayjobs.com/en-US/External/job/R/E_R1"),
              (1, "https://community.workday.com/invalid-url"), (2, "External/job/R/E_R1"), (3, "job/R/E_R1"),
              (4, "https://acme.wd5.myworkdayjobs.com/job/R/E_R1"), (5, "https://acme.wd5.myworkdayjobs.com/External/job/R/E_R1"),
              (6, "https://elsewhere.example.com/job/1"))
    got = [r[0] for r in df.orderBy("i").select(made(F.col("x"))).collect()]
    root = "https://acme.wd5.myworkdayjobs.com"
    assert got[0] == [f"{root}/en-US/External/job/R/E_R1"]
    assert got[1] == [] and got[6] == []
    assert got[2][:2] == [f"{root}/en-US/External/job/R/E_R1", f"{root}/External/job/R/E_R1"]
    assert got[3][0] == f"{root}/en-US/External/job/R/E_R1" and f"{root}/job/R/E_R1" in got[3]
    assert got[4][0] == f"{root}/en-US/External/job/R/E_R1" and got[4][-1] == f"{root}/job/R/E_R1"
    assert got[5][0] == f"{root}/External/job/R/E_R1"


def test_reasons(rows):
    each(rows, reasons.from_key, [
        ("homepage_blocked_by_robots", "ROBOTS_BLOCKED"), ("sitemap_fetch_failed_http_404", "SITEMAP_NOT_FOUND"),
        ("http_404_then_http_503", "HTTP_5XX"), ("http_418", "UNKNOWN"), ("time_budget", "TIMEOUT"), (None, "UNKNOWN"),
    ])
    each(rows, reasons.failure_type, [
        ("HTTP 429", "http_429_rate_limit"), ("http_418", "http_other"), ("", "unknown"), ("host_cooldown_robots", "host_cooldown"),
    ])


def test_backslash_in_search(rows):
    companies = rows("id int, ticker string, name string", (1, "A", "back\\slash"), (2, "B", "plain"))
    domains = rows("company_id int, domain string", (1, "a.example.com"))
    assert [r.id for r in targets.company_search(companies, domains, "k\\s", 5).collect()] == [1]
    assert targets.company_search(companies, domains, "plain\\", 5).collect() == []
    each(rows, lambda c: like_contains(c, "\\"), [("a\\b", True), ("ab", False)])


def test_text(rows):
    each(rows, strip_controls, [("\t a b \n", "a b"), (" x", " x")])
    each(rows, unescape_html, [("a &amp;lt; &lt;b&gt; &#39;&#x41;&#233; &bogus; &", "a &lt; <b> 'Aé &bogus; &"), (None, None)])
    each(rows, unescape_html, [
        ("Caf&eacute; &uuml;ber &notin; &NotEqualTilde;", "Café über ∉ \u2242\u0338"), ("a &amp b &copy", "a & b ©"),
        ("&#x26;lt; &lt;", "&lt; <"), ("&ampx; &unknown; &#0; &#xD800; &#1114112;", "&ampx; &unknown; &#0; &#xD800; &#1114112;"),
        ("&&lt;&", "&<&"), ("no reference", "no reference"), ("", "")])
    each(rows, html_to_text, [
        ("<p>a&nbsp; b</p><script>x<y</script><!-- c -->d", "a b d"), ("plain  text", "plain text"),
        ("Soft<b>ware</b> en<i class=x>gine</i>er<br>line<p>two</p>three<!-- c -->four", "Software engineer line two threefour"),
        ("<ul><li>one<li>two</ul>3 &lt; 4", "one two 3 < 4")])
    df = rows("i int, x string", (0, "2024-02-29T10:00"), (1, "2024-02-30"), (2, "24-1-1"), (3, " 2024-01-05 "))
    got = [str(r[0]) for r in df.orderBy("i").select(iso_date(F.col("x"))).collect()]
    assert got == ["2024-02-29", "None", "None", "2024-01-05"]


def java_hash(text):
    h = 0
    for ch in text:
        h = (h * 31 + ord(ch)) % 2**32
    return f"{h:08X}"


def test_names(rows):
    each(rows, string_hash_hex, [(t, java_hash(t)) for t in ("ACME", "A", "LONGERNAME123")])
    each(rows, normalize.synthetic_ticker, [
        ("Acme, Inc.", ("NACMEINC" + java_hash("ACMEINC"))[:16]), ("???", None), (None, None),
    ])
    each(rows, normalize.strip_corporate_suffixes, [
        ("Acme Holdings, Inc.", "Acme"), ("Group", "Group"), ("Acme Widgets", "Acme Widgets"), ("Trust Co", "Trust"),
    ])
    df = rows("company_id int, name string, ticker string", (1, "The Acme Group (Delaware)", "ACM"), (2, "X & Y Corp", "LONGER"))
    got = {}
    for r in normalize.domain_candidates(df, limit=6).orderBy("company_id", "rank").collect():
        got.setdefault(r.company_id, []).append(r.candidate_domain)
    assert got[1] == ["theacme.com", "the-acme.com", "theacme.io", "the-acme.io", "theacme.ai", "the-acme.ai"]
    assert got[2][:2] == ["xy.com", "x-y.com"]


def test_web_search(rows):
    df = rows("id int, title string, org_name string, location_text string, employment_type string, description_plain string",
              (1, "Senior Software Engineer", "Acme", "Austin", "Full-time", "build things"),
              (2, "Software Sales", "Acme", None, None, "sell things"), (3, "Data Scientist", None, "Paris", None, None))

    def found(query, mode="words"):
        return sorted(r.id for r in postings.text_match(df, query, mode).collect())

    assert found("software") == [1, 2]
    assert found("software -sales") == [1]
    assert found('"software engineer" OR scientist') == [1, 3]
    assert found('"full time"') == [1]
    assert found("things acme") == [1, 2]
    assert found("soft%eng", "like") == [1]
    assert found("  ") == [1, 2, 3]


def test_careers_urls_of_plain_domains_are_those_that_parsing_gives(rows, monkeypatch):
    names = ["acme.com", "WWW.Acme.com", "www.acme.com", "acme.com/x", "Acme.com/X/", "acme.com/", "acme.com//", "acme.com/a/../b", "1.2.3.4", "a.b1",
             "a.1b", "a-.com", "-a.com", "a_b.com", "a.com.", "a..com", ".com", "a.com:80", "a.com/a%20b", "a.com?q=1", "a.com/x?q=1#f", "a.com#f", " a.com ",
             "a.com\n", "a b.com", "//a.com", "https://a.com/y/", "u@a.com", "café.fr", "a.com/café", "a", "a/~b", "", " ", None]
    companies = rows("company_id int, domain string, careers_hint_url string",
                     *[(i, n, h) for i, n in enumerate(names) for h in (None, "https://acme.com/careers/", " ")])
    got = sorted(map(tuple, normalize.careers_candidates(companies).collect()))
    assert got and len(normalize.PLAIN_DOMAIN) > 9
    monkeypatch.setattr(normalize, "PLAIN_DOMAIN", "^(?!)")
    assert got == sorted(map(tuple, normalize.careers_candidates(companies).collect()))


def test_feeds_are_dealt_to_all_cores_before_they_are_parsed(rows):
    payloads = rows("payload_id bigint, company_id bigint, company_name string, source_url string, body string, page_no int, endpoint_url string",
                    (1, 1, "a", "b", "c", 0, "d")).coalesce(1)
    for parse in (feeds.greenhouse_postings, feeds.workday_postings):
        plan = parse(payloads)._jdf.queryExecution().optimizedPlan().toString()
        assert "RepartitionByExpression [payload_id" in plan.split("Generate")[-1]
