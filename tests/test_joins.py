"""Vendor links, robots rules and time windows against plain loops, and how their joins spread."""

import random
import re

from pyspark.sql import functions as F

from rolecall.functions import fixed_values as V
from rolecall.operators import diagnostics, pages, sitemaps
from test_tables import ts

# ---- vendor links

PIECES = [
    "https://boards.greenhouse.io/acme", "//job-boards.greenhouse.io/two", "HTTPS://API.greenhouse.io/v1/boards/three/jobs",
    "https://boards.greenhouse.io/embed/job_board?x=1&for=four", "https://jobs.lever.co/five/abc", "//apply.lever.co/six",
    "https://api.lever.co/v0/postings/seven?mode=json", "https://t8.wd5.myworkdayjobs.com/en-US/Ext/job/1",
    "https://t9.wd1.myworkdayjobs.com/wday/cxs/t9/Site/jobs", "https://jobs.smartrecruiters.com/Ten/1",
    "https://www.smartrecruiters.com/Eleven", "https://co.icims.com/jobs/search?ss=1", "https://careers.icims.com/jobs/c12/login",
    "https://x.taleo.net/careersection/13/jobsearch.ftl?lang=en", "https://c.successfactors.eu/career?company=14",
    "https://my.jobs.sap.com/career", "https://example.com/about", "lever.co", "//", "greenhouse.io/acme", "<a href=", "<b>", "'",
    '"', " ", "\n", ">", "<", "https://example.com/?u=", "?u=", "&", ",", "http:", "x", ")",
]


def test_one_pass_finds_what_every_pattern_finds(rows):
    chance = random.Random(11)
    texts = ["".join(chance.choice(PIECES) for _ in range(chance.randrange(1, 14))) for _ in range(400)]
    df = rows("page_id int, html string", *enumerate(texts))
    tokens = F.array_join(F.regexp_extract_all("html", F.lit(pages.LINK_TOKEN), F.lit(0)), "\n")
    got = {r.page_id: r.found for r in df.select("page_id", F.array(*[
        F.regexp_extract_all(tokens, F.lit(p), F.lit(0)) for _, p, _ in V.VENDOR_LINKS]).alias("found")).collect()}
    want = {i: [[m.group() for m in re.finditer(p, t, re.ASCII)] for _, p, _ in V.VENDOR_LINKS] for i, t in enumerate(texts)}
    assert got == want and sum(len(x) for w in want.values() for x in w) > 500


def test_several_vendors_on_a_page_and_pages_without(rows):
    df = rows("page_id int, url string, html string",
              (1, "https://jobs.lever.co/first", "<a href='https://boards.greenhouse.io/b'>x</a> https://jobs.lever.co/First "
               "<a href=\"https://example.com/?u=https://t.wd5.myworkdayjobs.com/Site\">"),
              (2, None, None), (3, "https://example.com/", "no vendor here"), (4, "", "//boards.greenhouse.io/embed"))
    got = sorted(tuple(r) for r in pages.vendor_endpoints(df).drop("pos").collect())
    assert got == [(1, "GREENHOUSE", "https://boards.greenhouse.io/b"), (1, "LEVER", "https://jobs.lever.co/first"),
                   (1, "WORKDAY", "https://t.wd5.myworkdayjobs.com/Site")]


def test_the_html_is_searched_once(rows):
    df = rows("page_id int, url string, html string", (1, "u", "h"))
    plan = pages.vendor_endpoints(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(coalesce(html") == 1


# ---- robots

def allowed(subject, rules):
    best = None
    for path, allow in rules:
        raw = path if path.startswith("/") else "/" + path
        if "*" in raw or "$" in raw:
            end = raw.endswith("$")
            pattern = ".*".join(re.escape(x) for x in raw.rstrip("$").split("*")) + ("$" if end else "")
            hit = re.match(pattern, subject)
        else:
            hit = subject.startswith(raw)
        if hit:
            best = max(best or (-1, False), (len(path), allow))
    return best is None or best[1]


def robots_case(n=600, seed=3):
    chance = random.Random(seed)
    words = ["a", "jobs", "en", "careers-and-more", "x.html", "deep/er/path"]
    rules = [(chance.choice(["hot.com", "B.com"]), chance.choice(["/", "", "/*"]) + "/".join(
        chance.choice(words) for _ in range(chance.randrange(1, 4))) + chance.choice(["", "*", "$", "/"]),
        chance.random() < 0.5) for _ in range(60)] + [("hot.com", "/*.html$", False), ("hot.com", "/", True)]
    urls = [(i, f"https://{'hot.com' if i % 3 else chance.choice(['b.com', 'free.com'])}/" + "/".join(
        chance.choice(words) for _ in range(chance.randrange(0, 5))) + chance.choice(["", "?q=1", "/"])) for i in range(n)]
    return rules, urls + [(n, "not a url"), (n + 1, None)]


def test_robots_decisions_against_a_loop(rows):
    rules, urls = robots_case()
    got = {r.url_id: r.allowed for r in sitemaps.robots_decisions(
        rows("url_id int, url string", *urls), rows("host string, path string, allow boolean", *rules)).collect()}
    want = {}
    for i, url in urls:
        host, _, rest = (url or "").removeprefix("https://").partition("/")
        subject = "/" + rest
        want[i] = allowed(subject, [(p, a) for h, p, a in rules if h.lower() == host])
    assert got == want and 50 < sum(got.values()) < 600


def test_a_hot_host_meets_its_wildcards_at_every_salt(rows, spark):
    urls = rows("url_id int, url string", *[(i, f"https://hot.com/p{i}.html") for i in range(4000)])
    rules = rows("host string, path string, allow boolean", ("hot.com", "/*.html$", False))
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        joined = sitemaps.robots_decisions(urls, rules)
        assert joined.where("NOT allowed").count() == 4000
        dealt = urls.select(F.lit("hot.com").alias("host"), F.pmod(F.xxhash64("url_id"), F.lit(sitemaps.SALTS)).alias("salt"))
        sizes = [r[0] for r in dealt.groupBy("host", "salt").count().select("count").collect()]
        assert len(sizes) == sitemaps.SALTS and max(sizes) < 4000 / 10
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


# ---- windows

def test_points_in_many_overlapping_windows_of_a_day(rows, spark):
    windows = spark.range(10000).select(
        F.col("id").alias("w"), F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0, id / 3)").alias("a"),
        F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0, id / 3 + (id * 7919 % 40000))").alias("b"))
    points = rows("p int, t timestamp", *[(i, ts(i * 17)) for i in range(60)])
    got = diagnostics.by_window(points, windows, "t", "a", "b").groupBy("p").count().collect()
    want = points.crossJoin(windows).where("t >= a AND t <= b").groupBy("p").count().collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and sum(r["count"] for r in got) > 50000


def test_window_ends_are_inclusive_and_every_pair_comes_once(rows):
    windows = rows("w int, a timestamp, b timestamp", (1, ts(5), ts(5)), (2, ts(0), ts(525600)), (3, ts(9), ts(3)),
                   (4, None, ts(9)), (5, ts(5), ts(6)))
    points = rows("p int, t timestamp", (1, ts(5)), (2, ts(6)), (3, ts(7)), (4, None))
    got = sorted((r.p, r.w) for r in diagnostics.by_window(points, windows, "t", "a", "b").collect())
    assert got == [(1, 1), (1, 2), (1, 5), (2, 2), (2, 5), (3, 2)]


def test_a_window_is_cut_into_two_pieces_a_level_at_most(rows):
    windows = rows("w int, a timestamp, b timestamp", (1, ts(1), ts(100000)))
    met = diagnostics.by_window(rows("t timestamp", (ts(50),)), windows, "t", "a", "b")
    plan = met._jdf.queryExecution().optimizedPlan().toString()
    assert "Cartesian" not in plan and met.count() == 1


def test_no_windows_and_no_points(rows):
    windows = rows("w int, a timestamp, b timestamp", (1, ts(1), ts(2)))
    points = rows("p int, t timestamp", (1, ts(1)))
    assert diagnostics.by_window(points, windows.limit(0), "t", "a", "b").count() == 0
    assert diagnostics.by_window(points.limit(0), windows, "t", "a", "b").count() == 0
