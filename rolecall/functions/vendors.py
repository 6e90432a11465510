"""Hiring-vendor detection and endpoint normalising as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolecall.functions import fixed_values as V
from rolecall.functions.text import (
    blank_to_null, case_first, contains_any, is_blank, let, strip_controls,
)
from rolecall.functions.urls import host_of, parts_of, path_segments, with_lower_scheme


def vendor_of_host(host: Column) -> Column:
    return case_first(
        [(contains_any(host, words), name) for name, words in V.VENDOR_HOSTS], V.UNKNOWN_VENDOR
    )


def vendor_of_url(url: Column) -> Column:
    host = F.coalesce(host_of(url), host_of(F.concat(F.lit("https://"), url)))
    return let(host, lambda h: F.when(h.isNull(), F.lit(V.UNKNOWN_VENDOR)).otherwise(vendor_of_host(h)))


def vendor_of_html(html: Column) -> Column:
    return let(F.lower(html), lambda low: case_first(
        [(contains_any(low, words), name) for name, words in V.VENDOR_HTML_MARKERS],
        V.UNKNOWN_VENDOR,
    ))


def vendor_of_page(url: Column, html: Column) -> Column:
    return let(vendor_of_url(url), lambda by_url: F.when(
        by_url != V.UNKNOWN_VENDOR, by_url
    ).otherwise(vendor_of_html(html)))


def strip_punctuation(c: Column) -> Column:
    """Drop trailing punctuation that page text leaves behind a URL."""
    return F.regexp_replace(strip_controls(c), r'[.,;)\]}"&?]+$', "")


def clean_token(c: Column) -> Column:
    return blank_to_null(strip_punctuation(c))


def endpoint_url(vendor: Column, raw: Column) -> Column:
    """Stored form of a vendor endpoint URL; unparsable text is kept trimmed."""
    made = let(parts_of(with_lower_scheme(raw)), lambda u: _endpoint(vendor, u))
    return F.when(~is_blank(raw) & vendor.isNotNull(), F.coalesce(made, strip_controls(raw)))


def _endpoint(vendor: Column, u: Column) -> Column:
    greenhouse = vendor == "GREENHOUSE"
    api = greenhouse & u["host"].isin("api.greenhouse.io", "boards-api.greenhouse.io")
    host = (
        F.when(api, F.lit("boards-api.greenhouse.io"))
        .when(greenhouse & (u["host"] == "job-boards.greenhouse.io"), F.lit("boards.greenhouse.io"))
        .otherwise(u["host"])
    )
    query = F.when(api & ~is_blank(u["query"]), F.concat(F.lit("?"), u["query"])).otherwise("")
    path = (
        F.when(vendor == "WORKDAY", strip_punctuation(u["path"]))
        .when(vendor == "ICIMS", icims_path(u["host"], u["path"], 3))
        .when(vendor == "TALEO", taleo_path(u["path"]))
        .when(vendor == "SUCCESSFACTORS", F.lit("/career"))
        .otherwise(u["path"])
    )
    return cut_slash(F.concat(F.lit("https://"), host, path, query))


def cut_slash(full: Column) -> Column:
    """Drop one trailing slash when more than a one-letter host stands before it."""
    return F.regexp_replace(full, "^(https://..+)/$", "$1")


def icims_path(host: Column, path: Column, least: int) -> Column:
    """Account path on the shared host with enough segments, the search path otherwise."""
    def shared(seg):
        named = (F.size(seg) >= least) & (F.lower(F.get(seg, 0)) == "jobs")
        return F.when(named, F.concat(F.lit("/jobs/"), F.get(seg, 1), F.lit("/jobs")))

    account = F.when(host == "careers.icims.com", let(path_segments(path), shared))
    return F.coalesce(account, F.lit("/jobs/search"))


def taleo_path(path: Column) -> Column:
    def section(seg):
        named = (F.size(seg) >= 2) & (F.lower(F.get(seg, 0)) == "careersection")
        return F.when(named, F.concat(F.lit("/careersection/"), F.get(seg, 1), F.lit("/jobsearch.ftl")))

    return F.coalesce(let(path_segments(path), section), path)
