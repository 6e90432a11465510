"""Literal tables for merges, selections, folds and documents."""

import datetime
import gzip
import random

import pytest
from pyspark.sql import functions as F

from rolecall.operators import diagnostics, feeds, latest, merges, normalize, ordered, pages, rollups, sitemaps, state, targets

T0 = datetime.datetime(2024, 1, 1)


def ts(minutes):
    return T0 + datetime.timedelta(minutes=minutes)


def test_best_and_latest_domain_disagree(rows):
    domains = rows(
        "id int, company_id int, domain string, careers_hint_url string, confidence double, resolved_at timestamp",
        (1, 1, "old.example.com", None, 0.9, ts(0)), (2, 1, "new.example.com", None, 0.5, ts(9)),
        (3, 2, "a.example.com", None, 0.9, None), (4, 2, "b.example.com", None, 0.9, ts(1)),
        (5, 3, "x.example.com", None, 0.9, ts(1)), (6, 3, "y.example.com", None, 0.9, ts(1)))
    best = {r.company_id: r.domain for r in latest.best_domain_rows(domains).collect()}
    newest = {r.company_id: r.domain for r in latest.latest_domain(domains).collect()}
    assert best == {1: "old.example.com", 2: "b.example.com", 3: "y.example.com"}
    assert newest == {1: "new.example.com", 2: "b.example.com", 3: "y.example.com"}


POSTING = ("id bigint, company_id int, crawl_run_id int, source_url string, canonical_url string, title string, org_name string, "
           "location_text string, employment_type string, date_posted date, description_text string, description_plain string, "
           "external_identifier string, content_hash string, first_seen_at timestamp, last_seen_at timestamp, is_active boolean")
BATCH = ("ord int, id bigint, company_id int, crawl_run_id int, source_url string, canonical_url string, title string, org_name string, "
         "location_text string, employment_type string, date_posted date, description_text string, external_identifier string, "
         "content_hash string, fetched_at timestamp")


def stored(i, ident, digest, run=1, company=1, active=True):
    return (i, company, run, "s", f"https://x.example.com/{i}", f"t{i}", None, None, None, None, None, None, ident, digest, ts(i), ts(i), active)


def fresh(order, ident, digest, run=2, company=1, url="https://x.example.com/new"):
    return (order, None, company, run, "s2", url, f"new{order}", None, None, None, None, "<b>d</b>", ident, digest, ts(100))


def test_merge_postings(rows):
    target = rows(POSTING, stored(1, "A", "h1"), stored(2, None, "h2"), stored(3, "C", "h3", active=False))
    batch = rows(BATCH, fresh(1, "A", "h9"), fresh(2, None, "h2"), fresh(3, "D", "h4"), fresh(4, "E", "h5", url=None),
                 fresh(5, "F", "h6", url="https://community.workday.com/invalid-url/1"))
    got = {r.content_hash: r for r in merges.merge_postings(target, batch).collect()}
    assert set(got) == {"h9", "h2", "h3", "h4"}
    assert got["h9"].id == 1 and got["h9"].first_seen_at == ts(1) and got["h9"].last_seen_at == ts(100)
    assert got["h9"].title == "new1" and got["h9"].crawl_run_id == 2 and got["h9"].description_plain == "d"
    assert got["h3"].title == "t3" and not got["h3"].is_active
    assert got["h4"].first_seen_at == ts(100) and got["h4"].is_active


def test_merge_postings_keeps_the_newest_of_a_shared_identifier(rows):
    target = rows(POSTING, stored(1, "A", "h1"), stored(2, "A", "h2"))
    batch = rows(BATCH, fresh(1, "A", "h9"))
    assert [r.id for r in merges.merge_postings(target, batch).collect()] == [2]
    assert [r.conflicts for r in merges.posting_conflicts(target, batch).collect()] == [1]


def test_close_out_leaves_unsafe_companies_alone(rows):
    postings = rows(POSTING, stored(1, "A", "h1", run=1), stored(2, "B", "h2", run=2), stored(3, "C", "h3", run=1, company=2),
                    stored(4, "D", "h4", run=None))
    safe = rows("company_id int, crawl_run_id int", (1, 2))
    got = {r.id: r.is_active for r in merges.close_out_postings(postings, safe).collect()}
    assert got == {1: False, 2: True, 3: True, 4: False}
    twice = rows("company_id int, crawl_run_id int", (1, 1), (1, 2), (1, 2))
    assert {r.id: r.is_active for r in merges.close_out_postings(postings, twice).collect()} == got
    assert merges.close_out_postings(postings, twice).count() == 4


def test_seed_domains_count_hosts_after_deduplication(rows):
    companies = rows("id int, ticker string, name string, sector string", *[(i, f"T{i:04}", "n", "s") for i in range(300)])
    domains = rows("id int, company_id int, domain string, careers_hint_url string, confidence double, resolved_at timestamp",
                   *[(i, i, "shared.example.com" if i < 200 else f"h{i}.example.com", None, 0.9, None) for i in range(300)])
    assert [r.host for r in targets.seed_domains(companies, domains, 3).collect()] == [
        "shared.example.com", "h200.example.com", "h201.example.com"]
    assert targets.seed_domains(companies, domains).count() == 101


def test_feeds_are_whole_without_a_limit(rows):
    postings = rows("company_id int, pos int", *[(1, i) for i in range(401)])
    assert feeds.cap_feed(postings, ["company_id"]).count() == 401
    assert feeds.cap_feed(postings, ["company_id"], 400).count() == 400
    assert [tuple(r) for r in feeds.feed_summary(postings, ["company_id"]).collect()] == [(1, 401, False)]
    assert [tuple(r) for r in feeds.feed_summary(postings, ["company_id"], 400).collect()] == [(1, 400, True)]


def test_nested_tables(rows):
    listing = ("<table id=constituents><tr><th>Symbol<th>Security<th>GICS Sector</tr>"
               "<tr><td>A<td>Alpha <table><tr><td>note</td></tr></table><td>Tech</tr><tr><td>B<td>Beta<td>Oil</tr></table>")
    got = pages.constituents(rows("page_id int, html string", (1, listing))).collect()
    assert sorted((r.ticker, r.sector) for r in got) == [("A", "Tech"), ("B", "Oil")]
    box = ('<table><tr><td><table class="infobox"><tr><td><table><tr><th>Website</th><td>no</td></tr></table></td></tr>'
           '<tr><th>Website</th><td><a href="https://acme.example.com">x</a></td></tr></table></td></tr></table>')
    found = normalize.infobox_websites(rows("page_id int, url string, html string", (1, "https://w.example.org/x", box))).collect()
    assert len(found) == 1 and "acme.example.com" in str(found[0])


def test_unreadable_jsonld_ends_no_job(rows):
    script = '<script type="application/ld+json">{}</script>'
    posting = '{"@type":"JobPosting","title":"t","url":"https://x.example.com/job/1"}'
    html = script.format("[" * 100_000) + script.format('{"a":' * 5000) + script.format('{"x":NaN}') + script.format(posting)
    got = pages.jsonld_postings(rows("page_id int, url string, html string", (1, "https://x.example.com/list", html))).collect()
    assert [r.title for r in got] == ["t"]


def test_merge_domains_manual_rows_resist(rows):
    schema = ("id int, company_id int, domain string, careers_hint_url string, source string, confidence double, resolved_at timestamp, "
              "resolution_method string, wikidata_qid string")
    target = rows(schema, (1, 1, "a", None, "MANUAL", 1.0, ts(0), "m", None), (2, 2, "b", None, "HEURISTIC", 0.7, ts(0), "h", "Q1"))
    batch = rows("ord int, " + schema, (1, None, 1, "a", "hint", "WIKIDATA", 0.9, ts(5), "w", "Q9"),
                 (2, None, 2, "b", None, "WIKIDATA", 0.9, ts(5), None, None), (3, None, 3, "c", None, "MANUAL", 1.0, ts(1), None, None),
                 (4, None, 3, "c", "late", "HEURISTIC", 0.7, ts(2), "h", None))
    got = {r.company_id: r for r in merges.merge_domains(target, batch).collect()}
    assert (got[1].source, got[1].resolution_method, got[1].careers_hint_url) == ("MANUAL", "m", "hint")
    assert (got[2].source, got[2].resolution_method, got[2].wikidata_qid) == ("WIKIDATA", "h", "Q1")
    assert (got[3].source, got[3].confidence, got[3].careers_hint_url) == ("MANUAL", 1.0, "late")


def test_run_results_keep_stages_apart(rows):
    schema = ("id int, crawl_run_id int, company_id int, status string, stage string, ats_type string, ats_type_key string, "
              "endpoint_url string, started_at timestamp, retryable boolean, jobs_extracted int, truncated boolean")
    empty = rows(schema).limit(0)
    batch = rows("ord int, crawl_run_id int, company_id int, status string, stage string, ats_type string, endpoint_url string, "
                 "started_at timestamp, retryable boolean",
                 (1, 1, 1, "RUNNING", "ATS_ADAPTER", "lever", "u", ts(1), False), (2, 1, 1, "RUNNING", "ATS_ADAPTER", " ", None, ts(2), False),
                 (3, 1, 1, "RUNNING", "JSONLD", None, None, ts(3), False), (4, 1, 1, "SUCCEEDED", "ATS_ADAPTER", "LEVER", None, ts(4), False))
    got = {(r.stage, r.ats_type_key): r for r in merges.merge_run_results_start(empty, batch).collect()}
    assert set(got) == {("ATS_ADAPTER", "LEVER"), ("ATS_ADAPTER", "NONE"), ("JSONLD", "NONE")}
    one = got[("ATS_ADAPTER", "LEVER")]
    assert (one.status, one.endpoint_url, one.started_at, one.jobs_extracted) == ("SUCCEEDED", "u", ts(1), 0)


def test_snapshot_delta(rows):
    schema = "metric string, dim1 string, dim2 string, value bigint, ok boolean"
    start = rows(schema, ("n", "", "", 5, True), ("by", "A", "", 2, True), ("by", "B", "", 1, True))
    end = rows(schema, ("n", "", "", 9, True), ("by", "A", "", 4, True), ("by", "C", "", 3, True))
    got = {(r.metric, r.dim1): r.delta for r in rollups.snapshot_delta(start, end).collect()}
    assert got == {("n", ""): 4, ("by", "A"): 2, ("by", "B"): -1, ("by", "C"): 3}
    assert rollups.snapshot_delta(start, end.withColumn("ok", F.lit(False))).count() == 0


def test_running_totals_over_one_hot_key(rows, spark):
    random.seed(3)
    data = [(random.choice(["hot", "hot", "cold", None]), i * 3, random.randint(0, 5)) for i in range(9000)]
    df = rows("k string, seq bigint, v int", *data)
    got = {r.seq: (r.total, r.top) for r in ordered.running(
        df, ["k"], "seq", {"total": F.col("v")}, {"top": F.when(F.col("v") > 4, F.col("seq"))}).collect()}
    sums, tops = {}, {}
    for k, seq, v in data:
        sums[k] = sums.get(k, 0) + v
        if v > 4:
            tops[k] = seq
        assert got[seq] == (sums[k], tops.get(k))
    assert len(got) == len(data)


def test_ordered_fold_joins_blocks_in_order(rows):
    big = 1 << 50
    data = [("a", 1, "x"), ("a", 70000, "y"), ("a", big, "z"), ("b", 5, "q")] + [("c", i, str(i % 10)) for i in range(500)]
    random.seed(1)
    random.shuffle(data)
    df = rows("k string, seq bigint, v string", *data)
    got = {r.k: r.folded for r in ordered.ordered_fold(df, ["k"], "seq", F.col("v"), F.concat).collect()}
    assert got == {"a": "xyz", "b": "q", "c": "".join(str(i % 10) for i in range(500))}


def test_frontier_backoff_steps(rows):
    answers = [200, 429, 429, 403, 503, 404, 200, 429, 429, 429, 429, 429, 429, 429]
    log = rows("host string, id bigint, fetched_at timestamp, http_status int, error_bucket string",
               *[("h", i, ts(i), s, None) for i, s in enumerate(answers)],
               *[("t", i, ts(i), 0, "read_timeout") for i in range(6)], ("o", 1, ts(0), 0, "io"))
    got = {r.host: r for r in state.frontier_backoff(log).collect()}
    assert got["h"].backoff_state == 6
    assert got["h"].next_allowed_at == ts(len(answers) - 1) + datetime.timedelta(seconds=30 * 32)
    assert got["t"].backoff_state == 4 and got["t"].next_allowed_at == ts(5) + datetime.timedelta(seconds=120)
    assert got["o"].next_allowed_at == ts(0) + datetime.timedelta(seconds=20)


def test_host_cooldown_clears_on_success(rows):
    schema = "host string, id bigint, fetched_at timestamp, http_status int, error_bucket string"
    log = rows(schema, ("a", 1, ts(1), 429, None), ("a", 2, ts(2), 408, None), ("a", 3, ts(3), 500, None), ("b", 1, ts(1), 429, None),
               ("b", 2, ts(2), 200, None), ("c", 1, ts(1), 200, None), ("d", 1, ts(1), 0, "dns"))
    got = {r.host: r for r in state.host_cooldown(log).collect()}
    assert set(got) == {"a", "b"}
    assert got["a"].consecutive_failures == 2 and got["a"].next_allowed_at == ts(17)
    assert got["b"].consecutive_failures == 0 and got["b"].next_allowed_at is None
    assert got["b"].last_error_category == "HTTP_429_RATE_LIMIT"


ROBOTS = """User-agent: special
Disallow: /secret

User-agent: one
User-agent: *
Disallow: /jobs   # all of it
Allow: /jobs/open
Disallow: /*.pdf$
Disallow: /a?b
Sitemap: https://x.example.com/map.xml

Disallow: /nowhere
"""


def test_robots(rows):
    docs = rows("host string, text string", ("x.example.com", ROBOTS), ("y.example.com", ""))
    rules = sitemaps.robots_rules(docs)
    assert [(r.path, r.allow) for r in rules.orderBy("no").collect()] == [
        ("/jobs", False), ("/jobs/open", True), ("/*.pdf$", False), ("/a?b", False)]
    assert [r.sitemap_url for r in sitemaps.robots_sitemaps(docs).collect()] == ["https://x.example.com/map.xml"]
    cases = {"https://x.example.com/jobs/1": False, "https://x.example.com/jobs/open/2": True, "https://x.example.com/f/a.pdf": False,
             "https://x.example.com/f/a.pdf?x": True, "https://x.example.com/secret": True, "https://x.example.com": True,
             "https://x.example.com/a?bc": False, "https://y.example.com/jobs": True, "https://X.example.com/jobs": False,
             "https://x.example.com/nowhere": True}
    urls = rows("url_id int, url string", *enumerate(cases))
    got = {r.url_id: r.allowed for r in sitemaps.robots_decisions(urls, rules).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())


def test_robots_tie_goes_to_allow(rows):
    rules = rows("host string, path string, allow boolean", ("x.example.com", "/ab", False), ("x.example.com", "/a*", True), ("x.example.com", "/ab", True))
    urls = rows("url_id int, url string", (1, "https://x.example.com/abc"))
    assert sitemaps.robots_decisions(urls, rules).collect()[0].allowed


def test_gzip_documents(rows):
    xml = "<urlset><url><loc>https://x.example.com/1</loc></url></urlset>"
    docs = rows("url string, final_url string, content_encoding string, body binary",
                ("https://x.example.com/a.xml", None, None, xml.encode()), ("https://x.example.com/b.xml.gz", None, None, gzip.compress(xml.encode())),
                ("https://x.example.com/c.xml", None, "gzip", gzip.compress(xml.encode())), ("https://x.example.com/d.xml", None, None, gzip.compress(xml.encode())),
                ("https://x.example.com/e.xml.gz", None, None, b"broken"))
    texts = {r.url[22:23]: r.text for r in sitemaps.document_texts(docs).collect()}
    assert texts == {"a": xml, "b": xml, "c": xml, "d": xml, "e": None}


def test_jsonld_shapes(rows):
    block = '<script type="application/ld+json">%s</script>'
    html = block % '{"@graph":[{"@type":["x","JobPosting"],"name":"Deep","url":"/open/1","jobLocation":[["Rome"],{"name":"Hub"}]}]}'
    html += block % "not json" + block % '{"@type":"jobposting","title":"T","identifier":{"name":"N7"},"datePosted":"2024-13-01"} trailing'
    got = pages.jsonld_postings(rows("page_id int, url string, html string", (1, "https://x.example.com/list", html))).orderBy("block").collect()
    assert [(r.title, r.canonical_url, r.location_text, r.external_identifier) for r in got] == [
        ("Deep", "https://x.example.com/open/1", "Rome | Hub", None), ("T", "https://x.example.com/list", None, "N7")]
    assert got[1].date_posted is None and len(got[0].content_hash) == 64


def test_ranked_career_links(rows):
    html = ('<a href="/about">About</a><a href="/careers">Careers</a><a href="https://jobs.example.com/x">See</a><a href="/careers">x</a>'
            '<a href="mailto:jobs@example.com">jobs</a><a href="/join">Join our talent</a>')
    got = pages.ranked_career_links(rows("page_id int, url string, html string", (1, "https://example.com/", html)), 3)
    assert [(r.candidate_url, r.score) for r in got.orderBy(F.desc("score"), "candidate_url").collect()] == [
        ("https://example.com/careers", 24), ("https://jobs.example.com/x", 19), ("https://example.com/join", 14)]


def test_sitemap_closure_breadth_first_and_capped(rows):
    def index(*names):
        return "<sitemapindex>" + "".join(f"<sitemap><loc>https://{n}.example.com/</loc></sitemap>" for n in names) + "</sitemapindex>"

    url = "https://{}.example.com/".format
    docs = rows("url string, text string", (url("a"), index("b", "c", "a")), (url("b"), index("d")), (url("c"), index("e", "d")), (url("d"), index("f")), (url("f"), index("g")))
    seeds = rows("company_id int, pos int, url string", (1, 0, url("a")))

    def reached(**limits):
        found = sitemaps.sitemap_closure(docs, seeds, **limits).orderBy("depth", "rank").collect()
        return [(r.url[8], r.depth) for r in found]

    assert reached() == [("a", 0), ("b", 1), ("c", 1), ("d", 2), ("e", 2), ("f", 3)]
    assert reached(max_documents=4) == [("a", 0), ("b", 1), ("c", 1), ("d", 2)]
    assert reached(max_depth=1) == [("a", 0), ("b", 1), ("c", 1)]


def test_eligibility_waits_for_the_cache(rows):
    companies = rows("id int, ticker string, name string, sector string, wikipedia_title string, cik string, domain_resolution_method string, "
                     "domain_resolution_status string, domain_resolution_error string, domain_resolution_attempted_at timestamp",
                     (1, "A", "Acme", None, None, None, None, None, None, None), (2, "B", "Beta", None, None, None, None, "NO_ITEM", None, ts(0)),
                     (3, "C", "Gamma", None, None, None, None, "OTHER", None, ts(0)), (4, "D", "Delta Fund", None, None, None, None, None, None, None))
    domains = rows("company_id int", (9,))
    later = ts(60 * 24)
    got = targets.companies_missing_domain(companies, domains, later, include_non_employer=False)
    assert [r.ticker for r in got.collect()] == ["A", "C"]
    week = ts(60 * 24 * 8)
    assert [r.ticker for r in targets.companies_missing_domain(companies, domains, week).collect()] == ["A", "B", "C", "D"]


def test_budget_breach_first_limit_wins(rows):
    log = rows("run int, id bigint, host string, http_status int, error_bucket string", *[(1, i, "h", 500 if i in (3, 4, 5) else 200, None) for i in range(20)],
               *[(2, i, "h", 200, None) for i in range(20)])
    got = {r.run: (r.attempt_id, r.reason) for r in state.budget_breach(log, ["run"], 10, 15, 0.5, 5, 3).collect()}
    assert got == {1: (5, "consecutive_error_threshold_exceeded"), 2: (10, "total_request_budget_exceeded")}


def test_windows_are_inclusive(rows):
    points = rows("p int, at timestamp", (1, ts(0)), (2, ts(10)), (3, ts(11)), (4, ts(60 * 24)))
    windows = rows("w int, a timestamp, b timestamp", (1, ts(0), ts(10)), (2, ts(10), ts(60 * 24)))
    got = sorted((r.w, r.p) for r in diagnostics.by_window(points, windows, "at", "a", "b").collect())
    assert got == [(1, 1), (1, 2), (2, 2), (2, 3), (2, 4)]


PLANNED = ["postings_page", "posting_view", "crawl_targets", "companies_without_endpoint", "source_funnel_crosstab",
           "failures_in_run_window", "merge_companies", "merge_domains", "merge_postings", "budget_breach", "robots_decisions"]


@pytest.mark.parametrize("name", PLANNED)
def test_plans_have_no_product_and_read_few_columns(spark, name):
    from rolecall.checks import catalog
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # what large inputs meet
    try:
        plan = catalog.run(name, spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "BroadcastExchange", "SinglePartition, REPARTITION"):
        assert word not in plan



# ---- one scan of a run's requests

def breach_by_rows(log, max_total, max_per_host, rate, least, errors):
    runs, out = {}, {}
    for run, i, host, status, bucket in sorted(log, key=lambda r: r[1]):
        s = runs.setdefault(run, {"made": 0, "limited": 0, "streak": 0, "hosts": {}})
        if run in out:
            continue
        bad = bool(bucket) or status == 429 or (status or 0) >= 500
        s["made"] += 1
        s["limited"] += status == 429
        s["streak"] = s["streak"] + 1 if bad else 0
        s["hosts"][host] = s["hosts"].get(host, 0) + 1
        for hit, name in (
                (s["made"] > max_total > 0, "total_request_budget_exceeded"),
                (host is not None and s["hosts"][host] > max_per_host > 0, "per_host_request_budget_exceeded"),
                (s["streak"] >= errors > 0, "consecutive_error_threshold_exceeded"),
                (rate > 0 and s["made"] >= least and s["limited"] / s["made"] >= rate, "rate_limit_threshold_exceeded")):
            if hit:
                out[run] = (i, name)
                break
    return out


@pytest.mark.parametrize("limits", [(60, 0, 0, 1, 0), (0, 9, 0, 1, 0), (0, 0, 0, 1, 3), (0, 0, 0.3, 8, 0),
                                    (70, 14, 0.34, 9, 5), (0, 0, 0, 1, 0)])
def test_budget_breach_over_many_blocks(rows, monkeypatch, limits):
    monkeypatch.setattr(state, "BLOCK", 3)
    chance = random.Random(sum(limits))
    log = [(chance.choice([1, 1, 1, 2, None]), i * 2, chance.choice(["a", "b", "c", None]),
            chance.choice([200, 200, 200, 429, 500, None]), chance.choice([None] * 5 + ["timeout"])) for i in range(400)]
    df = rows("run int, id bigint, host string, http_status int, error_bucket string", *log)
    got = state.budget_breach(df, ["run"], *limits)
    assert {r.run: (r.attempt_id, r.reason) for r in got.collect()} == breach_by_rows(log, *limits)


def test_budget_breach_in_ten_exchanges(rows):
    df = rows("run int, id bigint, host string, http_status int, error_bucket string", (1, 1, "a", 200, None))
    plan = state.budget_breach(df, ["run"])._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[-1].count("Exchange") <= 10


# ---- postings: narrow keys first

def test_identifiers_move_postings_and_the_newest_of_a_hash_stays(rows):
    target = rows(POSTING, stored(1, "A", "h1"), stored(2, "B", "h2"), stored(3, "C", "h3"), stored(4, " ", "h4"),
                  stored(5, None, "h5"), stored(6, "A", "h6", company=2), stored(7, "E", "h7"))
    batch = rows(BATCH, fresh(1, "A", "hx"), fresh(2, "B", "hx"), fresh(3, "C", "h7"), fresh(4, " ", "h4"),
                 fresh(5, None, "new"))
    got = {(r.company_id, r.content_hash): r for r in merges.merge_postings(target, batch).collect()}
    assert set(got) == {(1, "hx"), (1, "h7"), (1, "h4"), (1, "h5"), (1, "new"), (2, "h6")}
    # both A and B move to hx and are seen at the same time: the higher id stays
    assert got[1, "hx"].id == 2 and got[1, "hx"].first_seen_at == ts(2) and got[1, "hx"].title == "new2"
    # C moves onto the stored h7, which the batch saw no later
    assert got[1, "h7"].id == 3 and got[1, "h7"].external_identifier == "C"
    assert got[1, "h4"].id == 4 and got[1, "h4"].title == "new4" and got[1, "new"].id is None
    assert got[1, "h5"].title == "t5" and got[2, "h6"].title == "t6"
    conflicts = merges.posting_conflicts(target, batch).collect()
    assert [(r.company_id, r.conflicts) for r in conflicts] == [(1, 2)]


def test_only_keys_and_times_of_stored_postings_are_joined(rows):
    target = rows(POSTING, stored(1, "A", "h1"))
    found = merges.affected_postings(target, merges.prepare_postings(rows(BATCH, fresh(1, "A", "h9"))))
    wide = {"title", "description_text", "description_plain", "org_name"}
    assert not wide & set(found.columns)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" in plan and "html" not in plan


def shuffles_of(spark, build):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # what large inputs meet
    try:
        plan = build()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    return [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]


def test_a_posting_merge_shuffles_each_side_once_at_full_width(rows, spark):
    target, batch = rows(POSTING, stored(1, "A", "h1")), rows(BATCH, fresh(1, "A", "h9"))
    assert len(shuffles_of(spark, lambda: merges.merge_postings(target, batch))) <= 6


def test_hashes_of_any_form_survive_packing(rows):
    hashes = ["ab" * 32, "AB" * 32, "abc", "", " ", "00", "h1", "ab\n", "\u00e9", None]
    df = rows("content_hash string", *[(h,) for h in hashes])
    key = merges.packed_hash(F.col("content_hash"))
    got = df.select("content_hash", key.alias("k"), merges.unpacked_hash(key).alias("back")).collect()
    assert [r.back for r in got] == hashes and len({bytes(r.k) for r in got}) == len(hashes)
    assert len(got[0].k) == 33


def test_a_posting_without_hash_moves_and_one_without_identifier_stays(rows):
    target = rows(POSTING, stored(1, "A", None), stored(2, None, None, company=2))
    batch = rows(BATCH, fresh(1, "A", "ab" * 32))
    got = {(r.company_id, r.id): r.content_hash for r in merges.merge_postings(target, batch).collect()}
    assert got == {(1, 1): "ab" * 32, (2, 2): None}


# ---- few rows, however they came about, meet a large table without shuffling it

def seems_large(spark, expr):
    return spark.range(3_000_000).where("id < 3").groupBy("id").count().selectExpr(*expr)


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_close_out_shuffles_no_postings(spark):
    postings = spark.range(3_000_000).selectExpr("id", "id % 5 AS company_id", "id % 2 AS crawl_run_id", "id % 3 > 0 AS is_active")
    got = merges.close_out_postings(postings, seems_large(spark, ["id AS company_id", "1L AS crawl_run_id"]))
    assert "BroadcastHashJoin" in planned(got) and "SortMergeJoin" not in planned(got)
    want = postings.where("id % 3 > 0 AND (id % 5 > 2 OR id % 2 = 1)").count()
    assert got.where("is_active").count() == want


def test_windows_shuffle_no_points(spark):
    points = spark.range(3_000_000).selectExpr("id", "timestamp_millis(id * 1000) AS at")
    windows = seems_large(spark, ["id AS w", "timestamp_millis(id * 1000000) AS a", "timestamp_millis(id * 1000000 + 9000) AS b"])
    got = diagnostics.by_window(points, windows, "at", "a", "b")
    assert "BroadcastHashJoin" in planned(got) and "SortMergeJoin" not in planned(got)
    assert got.count() == 30


def test_postings_that_move_are_worked_out_once(rows, spark):
    target, batch = rows(POSTING, stored(1, "A", "h1")), rows(BATCH, fresh(1, "A", "h9"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = merges.merge_postings(target, batch)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.split("== Initial Plan ==")[-1].count("SortMergeJoin") == 2  # by identifier, and by hash


def test_conflicts_take_one_join(rows, spark):
    target = rows(POSTING, stored(1, "A", "h1"), stored(2, " ", "h2"), stored(3, None, None), stored(4, "B", "h4"))
    batch = rows(BATCH, fresh(1, "A", "h2"), fresh(2, "B", "h4"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = merges.posting_conflicts(target, batch)
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.split("== Initial Plan ==")[-1].count("SortMergeJoin") == 1
    assert [(r.company_id, r.conflicts) for r in found.collect()] == [(1, 1)]


def test_hashes_of_posting_details_travel_packed(spark):
    from rolecall.checks import catalog
    plan = catalog.run("posting_detail", spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Join"):]
    assert "unhex(" in below and "lower(hex(" in plan[:plan.index("Join")]
