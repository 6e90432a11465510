"""Posting listings, search, run deltas and point lookups."""

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolecall.functions import fixed_values as V
from rolecall.functions.hashing import packed_hash, unpacked_hash
from rolecall.functions.text import like_contains
from rolecall.operators.latest import latest_endpoint
from rolecall.operators.targets import take

POSTING_FIELDS = [
    "source_url", "canonical_url", "title", "org_name", "location_text", "employment_type",
    "date_posted", "first_seen_at", "last_seen_at", "is_active",
]
SEARCH_FIELDS = ["title", "org_name", "location_text", "employment_type", "description_plain"]


def posting_view(postings: DataFrame, companies: DataFrame, endpoints: DataFrame,
                 ties: str = "one", extra: list[str] = ()) -> DataFrame:
    """Postings with their company and its latest vendor, fifteen columns.

    Company and vendor are put together first, so the postings are joined once.
    Spark broadcasts that side while it is small; beyond that it sorts and merges,
    and splits the partition of a company with very many postings. A hash among
    the ``extra`` columns travels packed, as its hex digits do not compress.
    """
    names = companies.select(F.col("id").alias("company_id"), "ticker",
                             F.col("name").alias("company_name"))
    vendor = latest_endpoint(
        endpoints.select("id", "company_id", "ats_type", "detected_at"), ties
    ).select("company_id", F.col("ats_type").alias("latest_ats_type"))
    packed = [packed_hash(F.col(c)).alias(c) if c == "content_hash" else c for c in extra]
    plain = [unpacked_hash(F.col(c)).alias(c) if c == "content_hash" else c for c in extra]
    return (
        postings.select("id", "company_id", *POSTING_FIELDS, *packed)
        .join(names.join(vendor, "company_id", "left"), "company_id")
        .select("id", "company_id", "ticker", "company_name", "latest_ats_type",
                *POSTING_FIELDS, *plain)
    )


def of_companies_with_vendor(postings: DataFrame, endpoints: DataFrame, vendor: str) -> DataFrame:
    """Postings of companies that have any endpoint of a vendor, latest or not."""
    having = endpoints.where(F.col("ats_type") == vendor).select("company_id")
    return postings.join(having, "company_id", "left_semi")


def postings_with_endpoint_type(postings, companies, endpoints, vendor, ties="one") -> DataFrame:
    rows = of_companies_with_vendor(postings, endpoints, vendor)
    return posting_view(rows, companies, endpoints, ties)


def search_text(postings: DataFrame) -> Column:
    """All searched fields as lower-cased words, each with a space on both sides."""
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in SEARCH_FIELDS]
    words = F.regexp_replace(F.lower(F.concat_ws(" ", *fields)), r"[^\p{L}\p{N}]+", " ")
    return F.concat(F.lit(" "), F.trim(words), F.lit(" "))


def _matches(text: Column, term: str) -> Column:
    words = re.sub(r"[\W_]+", " ", term.lower()).strip()
    return text.contains(f" {words} ") if words else F.lit(True)


def web_search(text: Column, query: str) -> Column:
    """Words are required, "quoted words" must follow each other, -word must be absent, OR splits.

    Plain lower-cased words: no stemming and no stop words.
    """
    groups: list[list[Column]] = [[]]
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', query):
        if not minus and word.lower() == "or":
            groups.append([])
            continue
        test = _matches(text, phrase or word)
        groups[-1].append(~test if minus else test)
    found = F.lit(False)
    for tests in groups:
        if tests:
            every = tests[0]
            for t in tests[1:]:
                every = every & t
            found = found | every
    return found


def text_match(postings: DataFrame, query: str | None, mode: str = "like") -> DataFrame:
    """Postings that match a search text: LIKE over five fields, or web-search words."""
    if query is None or not query.strip():
        return postings
    query = query.strip()
    if mode == "like":
        hit = F.lit(False)
        for name in SEARCH_FIELDS:
            hit = hit | F.coalesce(like_contains(F.col(name).cast("string"), query), F.lit(False))
        return postings.where(hit)
    if mode == "words":
        return postings.where(web_search(search_text(postings), query))
    raise ValueError("mode is 'like' or 'words'")


def has_public_url(url: Column) -> Column:
    return url.isNotNull() & ~url.startswith(V.INVALID_POSTING_PREFIX)


def filter_postings(postings, endpoints, company_id=None, vendor=None, active=None, query=None,
                    mode="like", since=None, seen="first_seen_at") -> DataFrame:
    """Each filter applies only when its argument is given; ``since`` is exclusive."""
    rows = postings
    if company_id is not None:
        rows = rows.where(F.col("company_id") == company_id)
    if active is not None:
        rows = rows.where(F.col("is_active") == F.lit(active))
    if since is not None:
        rows = rows.where(F.col(seen) > F.lit(since).cast("timestamp"))
    rows = text_match(rows, query, mode)
    if vendor is not None:
        rows = of_companies_with_vendor(rows, endpoints, vendor)
    return rows


def _top_view(rows, companies, endpoints, order, limit, offset=0, ties="one") -> DataFrame:
    """Cut to the page before joining names and vendors.

    The sort uses posting columns only and the joins never lose a posting that
    has a company, so the rows that can reach the page are known beforehand.
    """
    known = companies.select(F.col("id").alias("company_id"))
    rows = rows.join(known, "company_id", "left_semi")
    if limit is not None:
        rows = rows.orderBy(*order).limit(offset + limit)
    view = posting_view(rows, companies, endpoints, ties).orderBy(*order, F.asc("latest_ats_type"))
    if offset:
        view = view.offset(offset)
    return view if limit is None else view.limit(limit)


def newest_postings(postings, companies, endpoints, limit=None, company_id=None, vendor=None,
                    active=None, query=None, mode="like", ties="one") -> DataFrame:
    rows = filter_postings(postings, endpoints, company_id, vendor, active, query, mode)
    return _top_view(rows, companies, endpoints, [F.desc("last_seen_at"), F.desc("id")], limit,
                     ties=ties)


def postings_page(postings, companies, endpoints, page=0, size=50, company_id=None, vendor=None,
                  active=None, query=None, mode="like", ties="one") -> DataFrame:
    """One page of postings with a public URL, newest first seen first."""
    rows = filter_postings(postings, endpoints, company_id, vendor, active, query, mode)
    rows = rows.where(has_public_url(F.col("canonical_url")))
    size = max(1, size)
    return _top_view(rows, companies, endpoints, [F.desc("first_seen_at"), F.desc("id")], size,
                     offset=max(0, page) * size, ties=ties)


def filtered_posting_count(postings, endpoints, company_id=None, vendor=None, active=None,
                           query=None, mode="like") -> DataFrame:
    rows = filter_postings(postings, endpoints, company_id, vendor, active, query, mode)
    rows = rows.where(has_public_url(F.col("canonical_url")))
    return rows.agg(F.count("*").alias("total"))


def new_postings_since(postings, companies, endpoints, since, limit=None, company_id=None,
                       query=None, mode="like", ties="one") -> DataFrame:
    rows = filter_postings(postings, endpoints, company_id, query=query, mode=mode, since=since)
    return _top_view(rows, companies, endpoints, [F.desc("first_seen_at"), F.desc("id")], limit,
                     ties=ties)


def closed_postings_since(postings, companies, endpoints, since, limit=None, company_id=None,
                          query=None, mode="like", ties="one") -> DataFrame:
    rows = filter_postings(postings, endpoints, company_id, active=False, query=query, mode=mode,
                           since=since, seen="last_seen_at")
    return _top_view(rows, companies, endpoints, [F.desc("last_seen_at"), F.desc("id")], limit,
                     ties=ties)


def posting_detail(postings, companies, endpoints, posting_id=None, ties="one") -> DataFrame:
    """Postings with text, identifier and hash; invalid URLs are hidden."""
    rows = postings.where(has_public_url(F.col("canonical_url")))
    if posting_id is not None:
        rows = rows.where(F.col("id") == posting_id)
    extra = ["description_text", "external_identifier", "content_hash"]
    return posting_view(rows, companies, endpoints, ties, extra)


def run_delta_counts(postings: DataFrame, runs: DataFrame, from_run: int, to_run: int,
                     company_id: int | None = None, as_of=None) -> DataFrame:
    """New, removed and updated postings of every company between two runs.

    New: attributed to the later run and first seen inside its window. Removed:
    inactive and still attributed to the earlier run. Updated is always 0.
    """
    rows = postings if company_id is None else postings.where(F.col("company_id") == company_id)
    rows = rows.where(F.col("crawl_run_id").isin(from_run, to_run))
    window = _run_window(runs, to_run, as_of)
    rows = rows.join(window, F.col("crawl_run_id") == F.col("_run"), "left")
    return rows.groupBy("company_id").agg(
        F.count_if(_is_new(to_run)).alias("new_count"),
        F.count_if(_is_removed(from_run)).alias("removed_count"),
        F.lit(0).cast("bigint").alias("updated_count"),
    )


def _run_window(runs: DataFrame, run_id: int, as_of) -> DataFrame:
    """Start and end of a run; a run still going ends at ``as_of``."""
    end = F.coalesce(F.col("finished_at"), F.lit(as_of).cast("timestamp"))
    return runs.where(F.col("id") == run_id).select(
        F.col("id").alias("_run"), F.col("started_at").alias("_from"), end.alias("_to")
    )


def _is_new(to_run: int) -> Column:
    seen = F.col("first_seen_at")
    return (F.col("crawl_run_id") == to_run) & (seen >= F.col("_from")) & (seen <= F.col("_to"))


def _is_removed(from_run: int) -> Column:
    return (F.col("crawl_run_id") == from_run) & ~F.col("is_active")


DELTA = ["id", "company_id", "title", "location_text", "source_url", "first_seen_at",
         "last_seen_at"]


def run_delta_postings(postings, runs, endpoints, from_run, to_run, company_id=None, limit=None,
                       ties="one", as_of=None) -> DataFrame:
    """The new and removed postings themselves, newest first within each kind.

    With a company the limit applies to each kind, as in the point report.
    """
    rows = postings if company_id is None else postings.where(F.col("company_id") == company_id)
    new = rows.join(_run_window(runs, to_run, as_of), F.col("crawl_run_id") == F.col("_run"))
    new = new.where(_is_new(to_run)).select(*DELTA)
    gone = rows.where(_is_removed(from_run)).select(*DELTA)
    new = take(new, [F.desc("first_seen_at"), F.desc("id")], limit) if limit else new
    gone = take(gone, [F.desc("last_seen_at"), F.desc("id")], limit) if limit else gone
    both = new.withColumn("change", F.lit("NEW")).unionByName(
        gone.withColumn("change", F.lit("REMOVED"))
    )
    vendor = latest_endpoint(endpoints, ties).select(
        "company_id", F.col("ats_type").alias("latest_ats_type")
    )
    return both.join(vendor, "company_id", "left")


def postings_after_id(postings: DataFrame, after_id: int, limit: int | None) -> DataFrame:
    """Keyset page of one vendor's posting URLs."""
    rows = postings.where(
        (F.col("id") > max(0, after_id)) & F.lower("canonical_url").like("%workdayjobs%")
    ).select("id", "canonical_url")
    return take(rows, [F.asc("id")], limit)
