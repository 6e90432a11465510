"""URL parsing, normalising and classifying as column expressions.

Parsing uses the built-in ``try_parse_url``, which yields null parts for a
malformed URL; hosts come back in their original case and are lowered here.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolecall.functions import fixed_values as V
from rolecall.functions.text import (
    blank_to_null, contains_any, is_blank, let, record, strip_controls,
)


def part(url: Column, name: str) -> Column:
    return F.try_parse_url(url, F.lit(name))


def with_scheme(c: Column) -> Column:
    """Trimmed text with https:// put in front when it has no http(s) scheme."""
    return F.regexp_replace(strip_controls(c), r"(?i)^(?!https?://)", "https://")


def with_lower_scheme(c: Column) -> Column:
    """As above, but only a lower-case scheme counts as one."""
    return F.regexp_replace(strip_controls(c), r"^(?!https?://)", "https://")


def host_of(url: Column) -> Column:
    return F.lower(part(url, "HOST"))


def decode(raw: Column) -> Column:
    """Percent-decoded text; '+' stays '+'."""
    return let(F.coalesce(raw, F.lit("")), lambda r: F.coalesce(
        F.try_url_decode(F.replace(r, F.lit("+"), F.lit("%2B"))), r))


def decoded_path(url: Column) -> Column:
    return decode(part(url, "PATH"))


def drop_end(c: Column, count: int = 1) -> Column:
    return c.substr(F.lit(1), F.length(c) - count)


def parts_of(url: Column) -> Column:
    """Scheme, lower-cased host, authority, decoded path and raw query of a URL."""
    return let(url, lambda u: record(
        scheme=F.lower(part(u, "PROTOCOL")), host=host_of(u), authority=part(u, "AUTHORITY"),
        path=decoded_path(u), query=part(u, "QUERY"),
    ))


def raw_parts_of(url: Column) -> Column:
    """Lower-cased host, path as written and raw query of a URL."""
    return let(url, lambda u: record(host=host_of(u), path=part(u, "PATH"), query=part(u, "QUERY")))


def canonical_url(c: Column) -> Column:
    """Canonical form of a URL, null when it cannot be parsed.

    Lower-cases scheme and host, drops default port, user info, fragment and
    tracking parameters, collapses slashes, and sorts the query by key then value.
    """
    return F.when(~is_blank(c), let(parts_of(with_scheme(c)), _canonical))


def _canonical(u: Column) -> Column:
    port = F.regexp_extract(u["authority"], r":0*([1-9]\d*)$", 1)
    default = F.when(u["scheme"] == "http", "80").otherwise("443")
    port_text = F.when((port != "") & (port != default), F.concat(F.lit(":"), port)).otherwise("")
    tail = let(canonical_query(u["query"]), lambda q: F.when(
        q != "", F.concat(F.lit("?"), q)).otherwise(""))
    return F.concat(u["scheme"], F.lit("://"), u["host"], port_text, _one_slash(u["path"]), tail)


def _one_slash(path: Column) -> Column:
    collapsed = F.regexp_replace(path, "/{2,}", "/")
    return F.coalesce(blank_to_null(F.regexp_replace(collapsed, "(?<=.)/$", "")), F.lit("/"))


def canonical_query(raw: Column) -> Column:
    """Kept pairs sorted by key, then value, and encoded again; empty text for none."""
    pairs = F.filter(F.split(raw, "&"), lambda p: ~is_blank(p))
    decoded = F.transform(
        pairs,
        lambda p: record(
            k=F.lower(F.coalesce(F.try_url_decode(F.substring_index(p, "=", 1)), p)),
            v=F.coalesce(F.try_url_decode(F.regexp_extract(p, r"^[^=]*=(.*)$", 1)), F.lit("")),
        ),
    )
    kept = F.filter(decoded, lambda p: ~is_tracking_key(p["k"]))
    pair_texts = F.transform(
        F.array_sort(kept), lambda p: F.concat(url_encode(p["k"]), F.lit("="), url_encode(p["v"]))
    )
    return F.when(raw.isNull(), F.lit("")).otherwise(F.array_join(pair_texts, "&"))


def url_encode(c: Column) -> Column:
    return F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))


def is_tracking_key(key: Column) -> Column:
    return key.startswith(V.TRACKING_PREFIX) | key.isin(V.TRACKING_KEYS)


def candidate_url(c: Column) -> Column:
    """Careers-candidate form: other tracking list, query order kept, no trailing slash."""
    value = F.regexp_replace(strip_controls(c), "^//", "https://")
    return F.when(~is_blank(c), let(parts_of(with_lower_scheme(value)), _candidate))


def _candidate(u: Column) -> Column:
    kept = F.array_join(F.filter(
        F.split(u["query"], "&"),
        lambda p: ~is_blank(p) & ~_candidate_tracking(F.lower(F.substring_index(p, "=", 1))),
    ), "&")
    tail = F.when(u["query"].isNull(), F.lit("")).otherwise(
        let(kept, lambda k: F.when(k != "", F.concat(F.lit("?"), k)).otherwise("")))
    full = F.concat(u["scheme"], F.lit("://"), u["host"], u["path"], tail)
    return F.regexp_replace(full, "^([a-z]+://..+)/$", "$1")


def _candidate_tracking(key: Column) -> Column:
    return key.startswith(V.TRACKING_PREFIX) | key.isin(V.CANDIDATE_TRACKING_KEYS)


def domain_host(c: Column) -> Column:
    """Host of a domain-like text: canonical host, else the text up to the first slash."""
    bare = F.regexp_replace(F.lower(strip_controls(c)), "^https?://", "")
    fallback = F.substring_index(bare, "/", 1)
    return blank_to_null(F.coalesce(host_of(canonical_url(c)), fallback))


def registrable_host(c: Column) -> Column:
    """Lower-cased host without a leading www."""
    host = F.regexp_replace(host_of(with_lower_scheme(c)), r"^www\.", "")
    return F.when(~is_blank(c), host)


def is_vendor_landing_host(host: Column) -> Column:
    return contains_any(host, V.VENDOR_LANDING_HOSTS)


def url_class(url: Column) -> Column:
    """ATS_LANDING, CANDIDATE_JOB or OTHER."""
    return let(parts_of(url), lambda u: (
        F.when(u["host"].isNull(), F.lit("OTHER"))
        .when(is_vendor_landing_host(u["host"]), F.lit("ATS_LANDING"))
        .when(contains_any(F.lower(u["path"]), V.JOB_PATH_HINTS), F.lit("CANDIDATE_JOB"))
        .otherwise(F.lit("OTHER"))
    ))


def is_job_like(url: Column) -> Column:
    """Not an asset, and a vendor host or a path or query that hints at jobs."""
    ending = "(" + "|".join(e.replace(".", r"\.") for e in V.ASSET_EXTENSIONS) + ")$"

    def test(u):
        full = F.lower(F.concat(u["host"], u["path"]))
        hinted = (
            is_vendor_landing_host(u["host"])
            | contains_any(F.lower(u["path"]), V.JOB_LIKE_PATH_HINTS)
            | contains_any(F.lower(decode(u["query"])), ["job", "career"])
        )
        return F.coalesce(~full.rlike(ending) & hinted, F.lit(False))

    return let(parts_of(url), test)


API_HINT = r"(?i)api\.greenhouse\.io|api\.lever\.co|myworkdayjobs\.com"


def _is_public(text: Column) -> Column:
    def is_api(u):
        return (
            u["host"].contains("api.greenhouse.io")
            | (u["host"].contains("api.lever.co") & u["path"].contains("/postings/"))
            | (u["host"].contains("myworkdayjobs.com") & u["path"].rlike("/wday/cxs/|/jobs/?$"))
        )

    parts = record(host=host_of(text), path=F.lower(decoded_path(text)))
    api = F.when(text.rlike(API_HINT), let(parts, is_api)).otherwise(F.lit(False))
    plain = text.rlike("(?i)^https?:") & ~F.lower(text).contains("invalid-url")
    return plain & part(text, "HOST").isNotNull() & ~api


def is_posting_url(c: Column) -> Column:
    """A public posting URL: http(s) with a host, not marked invalid, not a vendor API URL."""
    return F.coalesce(let(strip_controls(c), _is_public), F.lit(False))


def posting_url(c: Column) -> Column:
    """Trimmed public posting URL, null when it is not one."""
    return let(strip_controls(c), lambda t: F.when(_is_public(t), t))


def is_invalid_posting_url(c: Column) -> Column:
    prefix = F.lower(strip_controls(c)).startswith(V.INVALID_POSTING_PREFIX)
    return F.coalesce(prefix, F.lit(False))


def path_segments(path: Column) -> Column:
    return F.filter(F.split(F.coalesce(path, F.lit("")), "/"), lambda s: ~is_blank(s))


def resolve_url(base: Column, ref: Column) -> Column:
    """Resolve a link against its page, for the forms that occur in pages.

    Absolute, scheme-relative, root-relative, query-only and path-relative
    references; dot segments are removed.
    """
    def relative(b, r):
        folder = F.coalesce(
            blank_to_null(F.regexp_extract(b["path"], r"^(.*/)", 1)), F.lit("/"))
        merged = (
            F.when(r.startswith("/"), r)
            .when(r.startswith("?"), F.concat(b["path"], r))
            .otherwise(F.concat(folder, r))
        )
        return F.concat(b["root"], let(merged, lambda m: F.concat(
            _no_dots(F.regexp_extract(m, r"^([^?#]*)", 1)),
            F.regexp_extract(m, r"^[^?#]*(.*)$", 1),
        )))

    page = let(base, lambda b: record(
        scheme=part(b, "PROTOCOL"),
        root=F.concat(part(b, "PROTOCOL"), F.lit("://"), part(b, "AUTHORITY")),
        path=F.coalesce(part(b, "PATH"), F.lit("")),
    ))
    return let(record(page=page, ref=strip_controls(ref)), lambda x: (
        F.when(x["ref"].rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), x["ref"])
        .when(x["ref"].startswith("//"), F.concat(x["page"]["scheme"], F.lit(":"), x["ref"]))
        .otherwise(relative(x["page"], x["ref"]))
    ))


def _no_dots(path: Column) -> Column:
    """Path without . and .. segments."""
    kept = F.aggregate(
        F.split(path, "/"),
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == ".", acc)
        .when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1))))
        .otherwise(F.concat(acc, F.array(s))),
    )
    tail = F.when(path.rlike(r"/\.\.?$"), F.lit("/")).otherwise("")
    return F.when(
        path.rlike(r"(^|/)\.\.?(/|$)"), F.concat(F.array_join(kept, "/"), tail)
    ).otherwise(path)
