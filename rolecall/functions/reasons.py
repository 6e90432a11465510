"""Failure taxonomies as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolecall.functions import fixed_values as V
from rolecall.functions.text import case_first, contains_any, is_blank


def from_status(status: Column) -> Column:
    return (
        F.when(status.isin(401, 403), F.lit("HTTP_401_403"))
        .when(status == 404, F.lit("HTTP_404"))
        .when(status == 408, F.lit("TIMEOUT"))
        .when(status == 429, F.lit("HTTP_429_RATE_LIMIT"))
        .when((status >= 500) & (status < 600), F.lit("HTTP_5XX"))
        .otherwise(F.lit("UNKNOWN"))
    )


def from_error(code: Column, message: Column) -> Column:
    code = F.lower(code)
    text = F.lower(F.coalesce(message, F.lit("")))
    io = code.contains("io_error")
    dns = contains_any(text, ["unknownhost", "name or service not known", "no such host"])
    return (
        F.when(code.contains("timeout"), F.lit("TIMEOUT"))
        .when(io & dns, F.lit("DNS_FAILURE"))
        .when(io & contains_any(text, ["ssl", "handshake"]), F.lit("TLS_FAILURE"))
        .otherwise(F.lit("UNKNOWN"))
    )


def embedded_status(key: Column) -> Column:
    """Number right after the last ``http_``; null when none follows."""
    return F.regexp_extract(F.lower(key), r"^.*http_(\d+)(?!.*http_)", 1).try_cast("int")


def from_key(key: Column) -> Column:
    low = F.lower(key)
    rules = [
        (["blocked_by_robots"], "ROBOTS_BLOCKED"),
        (["host_cooldown"], "HOST_COOLDOWN"),
        (["no_sitemaps", "sitemap_no_urls", "no_candidate_urls", "sitemap_fetch_failed"],
         "SITEMAP_NOT_FOUND"),
        (["no_jobposting", "ats_detected_no_endpoint"], "ATS_NOT_FOUND"),
        (["parse", "invalid_payload", "gzip_decode_error", "empty_sitemap_payload"],
         "PARSING_FAILED"),
        (["time_budget", "budget_exceeded", "timeout"], "TIMEOUT"),
    ]
    by_word = case_first([(contains_any(low, words), code) for words, code in rules])
    return F.coalesce(by_word, from_status(embedded_status(key)))


def is_retryable(reason: Column) -> Column:
    return F.coalesce(reason.isin(V.RETRYABLE_REASONS), F.lit(False))


def failure_type(reason: Column) -> Column:
    """Fourteen-way type used by the roll-ups; its order differs from the reason codes."""
    low = F.lower(F.trim(reason))
    rules = [
        (["host_cooldown"], "host_cooldown"),
        (["robot"], "robots"),
        (["time_budget", "budget_exceeded", "timeout"], "timeout"),
        (["parse", "invalid_payload", "gzip_decode", "empty_sitemap_payload"], "parse_miss"),
        (["unknownhost", "name or service not known", "dns"], "dns"),
        (["ssl", "tls", "handshake"], "tls"),
        (["no_sitemaps", "sitemap_no_urls", "sitemap_fetch_failed", "sitemap_not_found"],
         "sitemap_not_found"),
        (["no_jobposting", "ats_detected_no_endpoint", "ats_not_found"], "ats_not_found"),
    ]
    code = F.regexp_extract(low, r"http[_ ]?(\d{3})", 1).try_cast("int")
    by_status = (
        F.when(code.isin(401, 403), F.lit("http_401_403"))
        .when(code == 404, F.lit("http_404"))
        .when(code == 429, F.lit("http_429_rate_limit"))
        .when((code >= 500) & (code < 600), F.lit("http_5xx"))
        .when(code.isNotNull(), F.lit("http_other"))
    )
    by_word = case_first([(contains_any(low, words), name) for words, name in rules])
    return F.when(is_blank(low), F.lit("unknown")).otherwise(
        F.coalesce(by_word, by_status, F.lit("other"))
    )


def status_bucket(status: Column, error: Column) -> Column:
    timeout = F.lower(F.coalesce(error, F.lit(""))).contains("timeout")
    return (
        F.when((status >= 200) & (status < 300), F.lit("HTTP_2XX"))
        .when(status == 429, F.lit("HTTP_429"))
        .when(status == 403, F.lit("HTTP_403"))
        .when(status >= 500, F.lit("HTTP_5XX"))
        .when(status >= 400, F.lit("HTTP_4XX"))
        .when(timeout, F.lit("ERROR_TIMEOUT"))
        .otherwise(F.lit("ERROR"))
    )


def stop_reason(status: Column, detail: Column) -> Column:
    budget = contains_any(F.lower(F.coalesce(detail, F.lit(""))), ["time_budget", "budget_exceeded"])
    return (
        F.when((F.upper(status) == "FAILED") & budget, F.lit("TIME_BUDGET"))
        .when(F.upper(status) == "FAILED", F.lit("ERROR"))
        .otherwise(F.lit("COMPLETE"))
    )
