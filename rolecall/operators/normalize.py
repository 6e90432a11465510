"""Normalising, classifying and deduplicating jobs over whole tables."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolecall.functions import fixed_values as V
from rolecall.functions import reasons as R
from rolecall.functions import urls as U
from rolecall.functions import vendors as N
from rolecall.functions.hashing import content_hash, string_hash_hex
from rolecall.functions.text import (
    blank_to_null, contains_any, host_under, html_tables, html_to_text, is_blank, let, record, strip_controls,
    texts,
)
from rolecall.operators.latest import dedupe_first, top_per_group
from rolecall.operators.targets import take

# --- companies -------------------------------------------------------------


def clean_text(c: Column) -> Column:
    """No-break spaces to spaces, footnote marks removed, trimmed; empty is null."""
    plain = strip_controls(F.translate(c, "\u00a0", " "))
    out = strip_controls(F.regexp_replace(plain, r"\[[^\]]+\]", ""))
    return F.when(F.length(out) > 0, out)


def clean_cik(c: Column) -> Column:
    """Digits only, left-padded with zeros to ten; longer numbers are kept."""
    return let(F.regexp_replace(c, r"\D", ""), lambda digits: F.when(
        F.length(digits) > 0, F.lpad(digits, F.greatest(F.length(digits), F.lit(10)), F.lit("0"))))


def synthetic_ticker(name: Column) -> Column:
    """N, seven letters or digits of the name, and its hash in hex; sixteen characters at most."""
    return let(F.regexp_replace(F.upper(name), "[^A-Z0-9]", ""), lambda plain: F.when(
        F.length(plain) > 0,
        F.substring(F.concat(F.lit("N"), F.substring(plain, 1, 7), string_hash_hex(plain)), 1, 16),
    ))


def normalize_companies(raw: DataFrame) -> DataFrame:
    """Clean company rows, the last row of a ticker first in line to be kept.

    ``raw`` has pos, ticker, name, sector, cik and wikipedia_title. Rows without
    ticker or name are dropped; of equal tickers the last row gives the name and
    the last non-null value of each other column stays.
    """
    rows = raw.select(
        "pos", F.upper(clean_text(F.col("ticker"))).alias("ticker"),
        clean_text(F.col("name")).alias("name"), clean_text(F.col("sector")).alias("sector"),
        clean_cik(clean_text(F.col("cik"))).alias("cik"),
        blank_to_null(F.col("wikipedia_title")).alias("wikipedia_title"),
    ).where(F.col("ticker").isNotNull() & F.col("name").isNotNull())
    last = [
        F.max_by(c, F.when(F.col(c).isNotNull(), F.col("pos"))).alias(c)
        for c in ("name", "sector", "cik", "wikipedia_title")
    ]
    return rows.groupBy("ticker").agg(*last)


def fill_synthetic_ticker(raw: DataFrame) -> DataFrame:
    ticker = F.upper(clean_text(F.col("ticker")))
    return raw.withColumn("ticker", F.coalesce(ticker, synthetic_ticker(clean_text(F.col("name")))))


def wiki_title(href: Column) -> Column:
    """Article title of a link, without query and fragment."""
    title = F.regexp_extract(strip_controls(href), r"^(?:(?:https?:)?//.*?)?/wiki/(.*)$", 1)
    return blank_to_null(no_fragment_or_query(title))


def no_fragment_or_query(c: Column) -> Column:
    """Text before '#', then before '?', unless the mark comes first."""
    return F.regexp_replace(F.regexp_replace(c, r"(?<=.)#.*$", ""), r"(?<=.)\?.*$", "")


def wiki_titles(cells: DataFrame) -> DataFrame:
    """Title of the first link in each table cell of HTML."""
    href = F.regexp_extract(F.col("cell_html"), r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["']""", 1)
    return cells.withColumn("wikipedia_title", wiki_title(blank_to_null(href)))


# --- URLs ------------------------------------------------------------------


def canonicalize_urls(urls: DataFrame) -> DataFrame:
    """One row per canonical URL, with its host; the first ``pos`` gives the raw URL."""
    rows = urls.withColumn("canonical_url", U.canonical_url(F.col("url")))
    rows = rows.where(F.col("canonical_url").isNotNull())
    first = dedupe_first(rows, ["canonical_url"], [F.asc("pos")])
    return first.withColumn("host", U.host_of(F.col("canonical_url")))


def url_hosts(domains: DataFrame, limit: int | None = None) -> DataFrame:
    """Distinct hosts of domain texts in the order of their first ``pos``."""
    hosts = domains.select(U.domain_host(F.col("domain")).alias("host"), "pos")
    first = hosts.where(F.col("host").isNotNull()).groupBy("host").agg(F.min("pos").alias("pos"))
    return take(first, [F.asc("pos"), F.asc("host")], limit)


def classify_discovered_urls(urls: DataFrame) -> DataFrame:
    return urls.withColumn("url_type", U.url_class(F.col("url")))


def url_class_counts(urls: DataFrame) -> DataFrame:
    return classify_discovered_urls(urls).groupBy("url_type").agg(F.count("*").alias("total"))


def job_like_urls(urls: DataFrame, per_source_limit: int | None = None) -> DataFrame:
    """Job-like URLs of each source in order, up to the budget of a source if there is one."""
    rows = urls.where(U.is_job_like(F.col("url")))
    return rows if per_source_limit is None else top_per_group(rows, ["source"], [F.asc("pos")], per_source_limit)


def sanitize_posting_urls(postings: DataFrame) -> DataFrame:
    """Postings with a public canonical URL and a valid source URL."""
    rows = postings.where(
        U.is_posting_url(F.col("canonical_url")) & ~U.is_invalid_posting_url(F.col("source_url"))
    )
    return rows.withColumn("canonical_url", strip_controls(F.col("canonical_url")))


def normalize_endpoints(endpoints: DataFrame) -> DataFrame:
    """Endpoints in stored form, the latest row of each (company, vendor, URL)."""
    rows = endpoints.withColumn("ats_url", N.endpoint_url(F.col("ats_type"), F.col("ats_url")))
    rows = rows.where(F.col("ats_url").isNotNull())
    return dedupe_first(
        rows, ["company_id", "ats_type", "ats_url"], [F.desc("detected_at"), F.desc("id")]
    )


def detect_vendors(pages: DataFrame) -> DataFrame:
    return pages.withColumn("vendor", N.vendor_of_page(F.col("url"), F.col("html")))


def both_schemes(c: Column) -> Column:
    """The URL itself, or its https and http forms when it has no scheme."""
    def forms(t):
        rest = F.regexp_replace(t, "^(//)?", "//")
        both = F.array(F.concat(F.lit("https:"), rest), F.concat(F.lit("http:"), rest))
        return F.when(t.rlike("^https?://"), F.array(t)).otherwise(both)

    return let(strip_controls(c), forms)


def normalize_candidate_urls(urls: DataFrame) -> DataFrame:
    """Careers candidates, both schemes when none is given; first ``pos`` of a URL wins."""
    rows = urls.where(~is_blank(F.col("url"))).select(
        "pos", F.posexplode(both_schemes(F.col("url"))).alias("variant", "raw_url")
    ).select(U.candidate_url(F.col("raw_url")).alias("candidate_url"), F.struct("pos", "variant").alias("place"))
    first = rows.where(F.col("candidate_url").isNotNull()).groupBy("candidate_url").agg(
        F.min("place").alias("place")
    )
    return first.select("candidate_url", "place.pos", "place.variant")


def registrable_hosts(urls: DataFrame) -> DataFrame:
    return urls.withColumn("domain", U.registrable_host(F.col("url")))


# --- failures --------------------------------------------------------------


def reason_codes(results: DataFrame) -> DataFrame:
    """Reason by status, by error, by key, the embedded status and whether to retry.

    ``results`` has http_status, error_code, error_message and error_key.
    """
    return results.withColumns({
        "status_reason": R.from_status(F.col("http_status")),
        "error_reason": R.from_error(F.col("error_code"), F.col("error_message")),
        "reason_code": R.from_key(F.col("error_key")),
        "embedded_status": R.embedded_status(F.col("error_key")),
    }).withColumn("retryable", R.is_retryable(F.col("reason_code")))


def map_discovery_failures(failures: DataFrame) -> DataFrame:
    """Raw discovery reason to reason code, stage and status."""
    raw = F.col("reason_code")
    fetch = raw == "discovery_fetch_failed"
    status = F.when(fetch, R.embedded_status(F.col("detail")))
    code, stage = F, F
    for name, (reason, step) in V.DISCOVERY_REASONS.items():
        code, stage = code.when(raw == name, reason), stage.when(raw == name, step)
    by_fetch = F.when(status.isNotNull(), R.from_status(status)).otherwise(
        R.from_key(F.col("detail"))
    )
    mapped = F.when(raw.isNull(), F.lit("ATS_NOT_FOUND")).when(fetch, by_fetch)
    return failures.withColumns({
        "mapped_reason": F.coalesce(mapped, code.otherwise("UNKNOWN")),
        "stage": F.coalesce(stage.otherwise("PAGE_SCAN"), F.lit("PAGE_SCAN")),
        "http_status": status,
    })


def failure_types(counts: DataFrame, n: int | None = None) -> DataFrame:
    """Counts per reason summed to failure types, largest first."""
    out = counts.groupBy(R.failure_type(F.col("reason")).alias("failure_type")).agg(
        F.sum("total").alias("total")
    ).where(F.col("total") > 0)
    return take(out, [F.desc("total"), F.asc("failure_type")], n)


def status_buckets(attempts: DataFrame) -> DataFrame:
    bucket = R.status_bucket(F.col("http_status"), F.col("error_bucket"))
    return attempts.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("total"))


def landing_failure_reasons(probes: DataFrame, max_hops: int = 5) -> DataFrame:
    """Why each careers probe failed; null when it found a page or a vendor.

    ``probes`` has method, http_status, error_code, hops, robots_allowed and
    vendor. Rules apply in the order a probe meets them.
    """
    code = F.lower("error_code")
    error = ~is_blank(F.col("error_code"))
    status = F.col("http_status")
    no_page = F.when(F.col("method") == "SUBDOMAIN_GUESS", F.lit("SUBDOMAIN_PROBES_404")).otherwise(
        F.lit("ALL_COMMON_PATHS_404")
    )
    network = (
        F.when(code.contains("timeout"), F.lit("NETWORK_ERROR"))
        .when(contains_any(code, ["ssl", "tls"]), F.lit("TLS_ERROR"))
        .when(contains_any(code, ["dns", "unknownhost"]), F.lit("DNS_ERROR"))
        .otherwise(F.lit("NETWORK_ERROR"))
    )
    vendor = F.coalesce(F.col("vendor"), F.lit(V.UNKNOWN_VENDOR)) != V.UNKNOWN_VENDOR
    reason = (
        F.when(~F.col("robots_allowed"), F.lit("BOT_PROTECTION_403"))
        .when(F.col("hops") > max_hops, F.lit("REDIRECT_CHAIN_TOO_LONG"))
        .when(status == 403, F.lit("BOT_PROTECTION_403"))
        .when(status == 429, F.lit("RATE_LIMIT_429"))
        .when(error, network)
        .when(vendor, F.lit(None))
        .when(status == 200, F.lit("CAREERS_PAGE_200_NO_VENDOR_SIGNATURE"))
        .when(status == 404, no_page)
    )
    return probes.withColumn("failure_reason", reason)


def text_parts(url: Column) -> Column:
    """Host and path of a URL text without validation; no URL has neither."""
    def split(t):
        authority = F.regexp_extract(t, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
        host = F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":\d*$", "")
        path = F.regexp_extract(t, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)
        return record(
            host=F.lower(host),
            path=F.when(t == "", F.lit("")).when(path == "", F.lit("/")).otherwise(F.lower(path)),
        )

    return let(F.trim(F.coalesce(url, F.lit(""))), split)


def attempt_stage(url: Column, reason: Column, method: Column) -> Column:
    linked = F.coalesce(method == "HOMEPAGE_LINK", F.lit(False))
    home = F.coalesce(reason.contains("homepage"), F.lit(False)) | linked
    common = "^(" + "|".join(V.ATTEMPT_COMMON_PATHS) + ")"
    return let(text_parts(url), lambda u: (
        F.when(contains_any(u["host"], V.ATTEMPT_VENDOR_HOSTS), F.lit("vendor_probe_attempts"))
        .when(u["host"].rlike(r"^(careers|jobs)\."), F.lit("subdomain_attempts"))
        .when(u["path"].rlike(common) & ~linked, F.lit("fallback_path_attempts"))
        .when(u["path"].rlike(common), F.lit("careers_candidate_attempts"))
        .when(u["path"].isin("", "/") & home, F.lit("homepage_fetch_attempts"))
        .otherwise(F.lit("careers_candidate_attempts"))
    ))


def attempt_stages(attempts: DataFrame) -> DataFrame:
    stage = attempt_stage(
        F.col("candidate_url"), F.col("reason_code"), F.col("careers_discovery_method")
    )
    return attempts.withColumn("attempt_stage", stage)


def url_pattern(url: Column) -> Column:
    """Host and first path segment, null without a host."""
    return let(text_parts(url), lambda u: F.when(
        u["host"] != "", F.concat(u["host"], F.lit("/"), F.regexp_extract(u["path"], "^/*([^/]*)", 1))
    ))


def attempt_status(columns: list[str], detail: str) -> Column:
    """First status column that is set, else a three-digit status in the detail text."""
    text = F.regexp_extract(F.col(detail), r"(?i)http_(\d{3})", 1).try_cast("int")
    return F.coalesce(*[F.col(c) for c in columns], text)


def url_patterns(attempts: DataFrame, status_columns: list[str] = ()) -> DataFrame:
    return attempts.withColumns({
        "url_pattern": url_pattern(F.col("candidate_url")),
        "status_code": attempt_status(list(status_columns), "detail"),
    })


def stop_reasons(results: DataFrame) -> DataFrame:
    """Stop reason per result, and the error detail trimmed and cut to its stored length."""
    detail = F.substring(strip_controls(F.col("error_detail")), 1, V.ERROR_DETAIL_CHARS)
    return results.withColumns({
        "stop_reason": R.stop_reason(F.col("status"), F.col("error_detail")),
        "error_detail": detail,
    })


def discovery_validation(results: DataFrame) -> DataFrame:
    """Validation status of a discovery result with vendor, evidence and error in stored form."""
    vendor = F.upper(strip_controls(blank_to_null(F.col("vendor_name"))))
    valid = F.col("endpoint_extracted") & ~is_blank(F.col("endpoint_url"))
    error = F.upper(strip_controls(blank_to_null(F.col("reason_code"))))
    status = (
        F.when(valid, F.lit("VALIDATED"))
        .when(vendor.isNotNull(), F.lit("UNVALIDATED"))
        .when(error.isNotNull(), F.lit("FAILED"))
        .otherwise(F.lit("NOT_FOUND"))
    )
    evidence = F.coalesce(
        F.lower(strip_controls(blank_to_null(F.col("careers_discovery_method")))), F.lit("none")
    )
    return results.withColumns({
        "validation_status": status,
        "result_vendor": F.when(valid | vendor.isNotNull(), vendor),
        "result_endpoint_url": F.when(valid, F.col("endpoint_url")),
        "evidence": evidence,
        "error_bucket": F.when(~valid, error),
    })


# --- postings --------------------------------------------------------------


def plain_descriptions(postings: DataFrame) -> DataFrame:
    """Search text of a description: null when blank."""
    text = F.when(~is_blank(F.col("description_text")), html_to_text(F.col("description_text")))
    return postings.withColumn("description_plain", text)


def tag_free_descriptions(postings: DataFrame) -> DataFrame:
    """Migration form: each tag becomes one space, nothing else changes; filled only when null."""
    plain = F.regexp_replace(F.col("description_text"), "<[^>]*>", " ")
    return postings.withColumn("description_plain", F.coalesce("description_plain", plain))


def content_hashes(postings: DataFrame) -> DataFrame:
    names = ["canonical_url", "date_posted", "description_text", "employment_type",
             "external_identifier", "location_text", "org_name", "title"]
    return postings.withColumn("content_hash", content_hash(*[F.col(c) for c in names]))


# --- identities and candidates ---------------------------------------------


def cleanup_title(c: Column) -> Column:
    """Text before a slash, without a closing bracket part, white space collapsed."""
    t = strip_controls(c)
    t = F.regexp_replace(t, r"\s*/.*$", "")
    t = F.regexp_replace(t, r"\s*\(.*\)$", "")
    return strip_controls(F.regexp_replace(t, r"\s+", " "))


def strip_corporate_suffixes(c: Column) -> Column:
    """Drop closing words such as Inc or Holdings, but never the first word."""
    def is_suffix(word):
        return F.upper(F.regexp_replace(word, "[^A-Za-z]", "")).isin(V.CORPORATE_SUFFIXES)

    def kept(words):
        places = F.transform(words, lambda w, i: F.when(is_suffix(w), 1).otherwise(i + 1))
        return F.array_join(F.slice(words, F.lit(1), F.array_max(places)), " ")

    return strip_controls(let(F.split(strip_controls(c), " "), kept))


def title_variants(title: Column) -> Column:
    """Title as found, without company suffixes, and with 'and' for '&', in this order."""
    bare = no_fragment_or_query(strip_controls(title))
    spaced = let(bare, lambda t: F.translate(F.coalesce(F.try_url_decode(t), t), "_", " "))
    return let(cleanup_title(spaced), lambda clean: F.array_distinct(texts(
        clean, strip_corporate_suffixes(clean), F.replace(clean, F.lit("&"), F.lit("and")))))


def cik_variants(cik: Column) -> Column:
    """Digits as given, without leading zeros, and padded to ten when shorter."""
    def forms(digits):
        bare = F.regexp_replace(digits, r"^0+(?!$)", "")
        padded = F.when(F.length(digits) < 10, F.lpad(bare, 10, "0"))
        return F.when(digits != "", F.array_distinct(texts(digits, bare, padded)))

    return let(F.regexp_replace(cik, r"\D", ""), forms)


def identity_variants(companies: DataFrame) -> DataFrame:
    """One row per company, kind (TITLE or CIK) and variant, with the rank to try it in."""
    titles = companies.select("company_id", F.lit("TITLE").alias("kind"), F.posexplode(
        title_variants(F.col("wikipedia_title"))).alias("rank", "variant"))
    ciks = companies.select("company_id", F.lit("CIK").alias("kind"), F.posexplode(
        cik_variants(F.col("cik"))).alias("rank", "variant"))
    return titles.unionByName(ciks)


def slugs(c: Column) -> Column:
    """Compact and hyphenated forms, and both again without a leading 'the'."""
    spelled = F.replace(F.lower(c), F.lit("&"), F.lit(" and "))
    words = F.trim(F.regexp_replace(spelled, "[^a-z0-9]+", " "))
    return let(words, lambda w: texts(*[
        F.replace(form, F.lit(" "), F.lit(mark))
        for form in (w, F.regexp_extract(w, "^the (.*)$", 1)) for mark in ("", "-")
    ]))


def domain_candidates(companies: DataFrame, tlds: list[str] = V.DOMAIN_TLDS,
                      limit: int | None = None) -> DataFrame:
    """Ranked domain guesses per company name: two best slugs on .com, then on the
    other endings in order, then the remaining slugs on .com."""
    others = [t.lower() for t in tlds if t.lower() != "com"]
    top = V.TOP_SLUGS_ON_ALL_TLDS

    def on(part, tld):
        return F.transform(part, lambda s: F.concat(s, F.lit("." + tld)))

    def ranked(all_slugs):
        best, rest = F.slice(all_slugs, 1, top), F.slice(all_slugs, top + 1, 1 << 20)
        return F.concat(on(best, "com"), *[on(best, t) for t in others], on(rest, "com"))

    short = F.when(F.length(strip_controls(F.col("ticker"))) <= 4, F.col("ticker"))
    found = let(cleanup_title(F.translate("name", "&", " ")), lambda clean: F.array_distinct(F.concat(
        slugs(strip_corporate_suffixes(clean)), slugs(clean), slugs(F.coalesce(short, F.lit(""))))))
    guesses = F.array_distinct(let(found, ranked))
    guesses = guesses if limit is None else F.slice(guesses, 1, limit)
    return companies.where(~is_blank(F.col("name"))).select(
        "company_id", F.posexplode(guesses).alias("rank", "candidate_domain")
    )


def vendor_slug_candidates(companies: DataFrame, limit: int = 8) -> DataFrame:
    """Ranked account names to try at vendors: domain root, name forms, ticker."""
    host = U.registrable_host(F.lower(strip_controls(F.col("domain"))))
    root = F.regexp_replace(F.substring_index(host, ".", 1), "[^a-z0-9-]", "")
    words = F.trim(F.regexp_replace(
        F.replace(F.lower("name"), F.lit("&"), F.lit("and")), "[^a-z0-9]+", " "))
    forms = F.array(
        root, F.replace(words, F.lit(" "), F.lit("")), F.replace(words, F.lit(" "), F.lit("-")),
        F.lower(strip_controls(F.col("ticker"))),
    )
    kept = F.array_distinct(F.filter(forms, lambda s: ~is_blank(s)))
    return companies.select("company_id", F.posexplode(F.slice(kept, 1, limit)).alias("rank", "slug"))


def landing_candidates(companies: DataFrame) -> DataFrame:
    """Fixed careers URLs of a domain in the order they are probed."""
    d = F.lower(strip_controls(F.col("domain")))
    urls = [F.concat(F.lit("https://"), d, F.lit(p)) for p in V.LANDING_FALLBACK_PATHS]
    urls += [F.concat(F.lit("https://careers."), d, F.lit("/")), F.concat(F.lit("https://jobs."), d, F.lit("/"))]
    return companies.where(~is_blank(F.col("domain"))).select(
        "company_id", F.posexplode(F.array(*urls)).alias("rank", "candidate_url")
    )


#: A lower- or upper-case host name, and perhaps a path, that a URL takes over letter by letter.
PLAIN_DOMAIN = r"^(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)*[A-Za-z](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:/[A-Za-z0-9._~/-]*)?\z"


def careers_candidates(companies: DataFrame) -> DataFrame:
    """Hint, common paths on the domain and its www form, and careers and jobs hosts.

    ``companies`` has company_id, domain and careers_hint_url; every text without
    scheme is tried with https and then http, and a URL keeps its first rank.

    URLs of a plain domain are put together from its host and path; only others are
    parsed one by one.
    """
    d = blank_to_null(F.col("domain"))
    www = F.when(~d.startswith("www."), F.concat(F.lit("www."), d))
    raw = [F.concat(h, F.lit(p)) for h in (d, www) for p in V.CAREERS_COMMON_PATHS]
    raw += [F.concat(F.lit("careers."), d), F.concat(F.lit("jobs."), d)]

    def parsed(*cols):
        forms = F.flatten(F.transform(texts(*cols), both_schemes))
        return F.array_compact(F.transform(forms, U.candidate_url))

    host = F.lower(F.substring_index("domain", "/", 1))
    tail = F.substr(F.col("domain"), F.length(F.substring_index("domain", "/", 1)) + 1)
    end = F.when(F.col("_tail").endswith("/"), U.drop_end(F.col("_tail"))).otherwise(F.col("_tail"))
    more = F.when(~F.col("domain").startswith("www."), F.lit("www."))
    plain = [(h, p) for h in (F.lit(""), more) for p in V.CAREERS_COMMON_PATHS]
    made = [F.concat(F.lit(s), h, "_host", "_tail", F.lit(p)) for h, p in plain for s in ("https://", "http://")]
    made += [F.concat(F.lit(f"{s}{h}."), "_host", "_end") for h in ("careers", "jobs") for s in ("https://", "http://")]

    rows = companies.select("company_id", "domain", "careers_hint_url", host.alias("_host"), tail.alias("_tail"))
    urls = F.when(F.col("domain").rlike(PLAIN_DOMAIN), F.array_compact(F.array(*made))).otherwise(parsed(*raw))
    hints = F.when(F.col("careers_hint_url").isNotNull(), parsed(F.col("careers_hint_url"))).otherwise(
        F.array().cast("array<string>"))
    return rows.withColumn("_end", end).select("company_id", F.posexplode(
        F.array_distinct(F.concat(hints, urls))).alias("rank", "candidate_url"))


def name_signals(name: Column) -> Column:
    """Strong name tokens, and the host labels a company may use."""
    def signals(clean):
        stripped = strip_corporate_suffixes(clean)
        words = F.trim(F.regexp_replace(F.lower(stripped), "[^a-z0-9]+", " "))
        tokens = let(words, lambda w: F.when(
            F.exists(F.split(w, " "), _is_strong), F.array_distinct(F.filter(F.split(w, " "), _is_strong))
        ).otherwise(texts(F.replace(w, F.lit(" "), F.lit("")))))
        roots = F.array_distinct(F.concat(slugs(clean), slugs(stripped)))
        return record(tokens=tokens, roots=roots)

    return let(cleanup_title(F.translate(name, "&", " ")), signals)


def _is_strong(token: Column) -> Column:
    return (F.length(token) >= 3) & ~token.isin(V.WEAK_NAME_TOKENS)


def verify_domain_candidates(candidates: DataFrame, pages: DataFrame) -> DataFrame:
    """Verdict for each fetched candidate domain.

    ``candidates`` has company_id, name, rank and candidate_domain; ``pages`` has
    candidate_domain, final_url, http_status and body. A candidate without a page
    counts as not fetched.
    """
    body = F.when(F.col("http_status").between(200, 299), blank_to_null(F.col("body")))
    title = html_to_text(F.regexp_extract(F.col("body"), r"(?is)<title[^>]*>(.*?)</title>", 1))
    inner = html_to_text(F.regexp_replace(F.col("body"), r"(?is)<head\b.*?</head>", " "))
    page = pages.select(
        "candidate_domain", body.alias("body"),
        U.registrable_host(F.col("final_url")).alias("resolved"),
        F.lower(F.concat(title, F.lit(" "), inner)).alias("page_text"),
    )

    def rooted(host):
        return F.coalesce(F.arrays_overlap(F.split(host, r"\."), F.col("signals.roots")), F.lit(False))

    rows = candidates.withColumn("signals", name_signals(F.col("name"))).join(
        page, "candidate_domain", "left"
    ).withColumns({
        "named": F.exists(F.col("signals.tokens"), lambda t: F.col("page_text").contains(t)),
        "resolved_rooted": rooted(F.col("resolved")),
        "candidate_rooted": rooted(F.lower("candidate_domain")),
    })
    verdict = (
        F.when(F.col("body").isNull(), F.lit("fetch_failed"))
        .when(is_blank(F.col("resolved")), F.lit("no_resolved_domain"))
        .when(host_under(F.col("resolved"), V.PARKED_HOSTS), F.lit("parked_host"))
        .when(contains_any(F.lower("body"), V.PARKED_PAGE_HINTS), F.lit("parked_page"))
        .when(F.coalesce(F.size("signals.tokens"), F.lit(0)) < 1, F.lit("no_name_signals"))
        .when(~F.col("candidate_rooted") & ~F.col("resolved_rooted"), F.lit("root_mismatch"))
        .when(~F.col("named") & ~F.col("resolved_rooted"), F.lit("name_not_found"))
        .otherwise(F.lit("accepted"))
    )
    rows = rows.withColumn("verdict", verdict)
    return rows.select(
        "company_id", "rank", "candidate_domain", "verdict",
        F.when(F.col("verdict") == "accepted", F.col("resolved")).alias("domain"),
    )


def heuristic_method(domain: Column) -> Column:
    """HEURISTIC_ and the ending of the domain in capitals."""
    tld = F.upper(F.substring_index(domain, ".", -1))
    return F.concat(F.lit("HEURISTIC_NAME_"), F.regexp_replace(tld, "[^A-Z0-9]", "_"))


def infobox_websites(pages: DataFrame) -> DataFrame:
    """Website of the first infobox of each page, https links first, vendor hosts refused.

    ``pages`` has page_id, url and html.
    """
    opening = r"""(?is)^<table\b[^>]*\bclass\s*=\s*["'](?:[^"']*\s)?infobox(?:\s[^"']*)?["'][^>]*>"""
    box = F.get(F.filter(html_tables(F.col("html")), lambda t: t.rlike(opening)), 0)
    rows = F.regexp_extract_all(box, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))

    def is_website(r):
        head = F.regexp_extract(r, r"(?is)<th\b[^>]*>(.*?)</th>", 1)
        return F.lower(F.regexp_replace(head, "<[^>]*>", " ")).contains("website") & r.rlike(r"(?is)<td\b")

    cell = F.regexp_extract(F.get(F.filter(rows, is_website), 0), r"(?is)<td\b[^>]*>(.*?)</td>", 1)
    cells = pages.select("page_id", "url", cell.alias("cell")).where(F.col("cell").isNotNull())
    hrefs = F.regexp_extract_all(
        F.col("cell"), F.lit(r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["']"""), F.lit(1)
    )

    def first(links, pattern):
        return F.get(F.filter(links, lambda h: h.rlike(pattern)), 0)

    full = F.transform(hrefs, lambda h: U.resolve_url(F.col("url"), h))
    linked = let(full, lambda links: F.coalesce(first(links, "(?i)^https://"), first(links, "(?i)^http://")))
    in_text = F.regexp_extract(html_to_text(F.col("cell")), r"""(?i)(https?://[^\s<>"']+)""", 1)
    out = cells.select("page_id", "url", F.coalesce(linked, blank_to_null(in_text)).alias("website_url"))
    out = out.withColumn("domain", U.registrable_host(F.col("website_url")))
    refused = V.INFOBOX_VENDOR_HOSTS + V.PARKED_HOSTS + ["wikipedia.org"]
    return out.where(F.col("domain").isNotNull() & ~host_under(F.col("domain"), refused))
