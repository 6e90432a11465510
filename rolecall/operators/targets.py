"""Selection of companies: what to resolve, discover and crawl next."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolecall.functions import fixed_values as V
from rolecall.functions.text import like_text
from rolecall.operators.latest import best_domain, dedupe_first, latest_domain

IDENTITY = [
    "ticker", "name", "sector", "wikipedia_title", "cik", "domain_resolution_method",
    "domain_resolution_status", "domain_resolution_error", "domain_resolution_attempted_at",
]
TARGET = ["company_id", "ticker", "name", "sector", "domain", "careers_hint_url"]


def take(df: DataFrame, order: list[Column], limit: int | None) -> DataFrame:
    """Sorted rows, cut to ``limit`` when it is given and positive."""
    out = df.orderBy(*order)
    return out.limit(limit) if limit is not None and limit > 0 else out


def only_tickers(companies: DataFrame, tickers) -> DataFrame:
    """Rows whose ticker is in a list of texts or in a one-column table of tickers."""
    if tickers is None:
        return companies
    if isinstance(tickers, DataFrame):
        wanted = tickers.select(F.col(tickers.columns[0]).alias("ticker"))
        return companies.join(wanted, "ticker", "left_semi")
    return companies.where(F.col("ticker").isin(list(tickers)))


def without(companies: DataFrame, other: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key has no row in ``other`` by company_id."""
    taken = other.select(F.col("company_id").alias(key))
    return companies.join(taken, key, "left_anti")


def likely_non_employer(name: Column) -> Column:
    """Name reads like a fund, trust, unit or the like."""
    marks = "./,-&()"
    padded = F.lower(F.concat(F.lit(" "), F.translate(F.coalesce(name, F.lit("")), marks, " " * 7),
                              F.lit(" ")))
    return padded.rlike(" (" + "|".join(V.NON_EMPLOYER_WORDS) + ") ")


def flag_non_employers(companies: DataFrame) -> DataFrame:
    return companies.withColumn("likely_non_employer", likely_non_employer(F.col("name")))


def _cutoff(as_of, amount: int, unit: str) -> Column:
    now = F.lit(as_of).cast("timestamp")
    if amount <= 0:
        return now
    return now - F.expr(f"INTERVAL '{int(amount)}' {unit}")


def _not_before(when: Column, cutoff: Column) -> Column:
    return when.isNull() | (when <= cutoff)


def resolution_eligible(companies: DataFrame, domains: DataFrame, as_of,
                        cache_ttl_minutes: int = V.CACHE_TTL_MINUTES,
                        retry_hours: int = V.SEMI_PERMANENT_RETRY_HOURS) -> DataFrame:
    """Companies without a domain whose cached attempt is old enough to try again."""
    attempted = F.col("domain_resolution_attempted_at")
    status = F.upper("domain_resolution_status")
    lasting = F.coalesce(status.isin(V.SEMI_PERMANENT_RESOLUTION), F.lit(False))
    return without(companies, domains).where(
        _not_before(attempted, _cutoff(as_of, cache_ttl_minutes, "MINUTE"))
        & (~lasting | _not_before(attempted, _cutoff(as_of, retry_hours, "HOUR")))
    )


def companies_missing_domain(companies, domains, as_of, limit=None, include_non_employer=True,
                             **retry) -> DataFrame:
    rows = resolution_eligible(companies, domains, as_of, **retry)
    if not include_non_employer:
        rows = rows.where(~likely_non_employer(F.col("name")))
    rows = rows.select(F.col("id").alias("company_id"), *IDENTITY)
    return take(rows, [F.asc("ticker")], limit)


def count_missing_domain(companies, domains, as_of, include_non_employer=True, **retry):
    rows = resolution_eligible(companies, domains, as_of, **retry)
    if not include_non_employer:
        rows = rows.where(~likely_non_employer(F.col("name")))
    return rows.agg(F.count("*").alias("total"))


def count_non_employers(companies, domains, as_of, **retry):
    rows = resolution_eligible(companies, domains, as_of, **retry)
    return rows.where(likely_non_employer(F.col("name"))).agg(F.count("*").alias("total"))


def sample_non_employers(companies, domains, as_of, limit=10, **retry):
    """First rows by ticker as 'TICKER (name)'."""
    rows = resolution_eligible(companies, domains, as_of, **retry)
    rows = rows.where(likely_non_employer(F.col("name")))
    label = F.concat(F.col("ticker"), F.lit(" ("), F.coalesce("name", F.lit("")), F.lit(")"))
    return take(rows, [F.asc("ticker")], max(1, limit)).select("ticker", label.alias("label"))


def companies_missing_domain_by_ticker(companies, domains, tickers, limit=None) -> DataFrame:
    rows = without(only_tickers(companies, tickers), domains)
    rows = rows.select(F.col("id").alias("company_id"), *IDENTITY)
    return take(rows, [F.asc("ticker")], limit)


def missing_domain_cohort(companies, domains, limit=None) -> DataFrame:
    rows = without(companies, domains).select(
        F.col("id").alias("company_id"), "ticker", "name", "wikipedia_title", "cik",
        "domain_resolution_status", "domain_resolution_method", "domain_resolution_attempted_at",
    )
    return take(rows, [F.asc("ticker")], limit)


def discovery_eligible(companies, domains, endpoints, state, as_of,
                       cache_ttl_minutes: int = V.CACHE_TTL_MINUTES,
                       retry_hours: int = V.SEMI_PERMANENT_RETRY_HOURS) -> DataFrame:
    """Companies with a domain, no endpoint, and no cool-down in force."""
    now = F.lit(as_of).cast("timestamp")
    last = F.col("last_attempt_at")
    lasting = F.coalesce(
        F.upper("last_reason_code").isin(V.SEMI_PERMANENT_DISCOVERY), F.lit(False)
    )
    targets = without(best_domain(companies, domains), endpoints, "company_id")
    known = state.select("company_id", "last_attempt_at", "last_reason_code", "next_attempt_at")
    return targets.join(known, "company_id", "left").where(
        _not_before(F.col("next_attempt_at"), now)
        & _not_before(last, _cutoff(as_of, cache_ttl_minutes, "MINUTE"))
        & (~lasting | _not_before(last, _cutoff(as_of, retry_hours, "HOUR")))
    )


def companies_without_endpoint(companies, domains, endpoints, state, as_of, limit=None,
                               tickers=None, **retry) -> DataFrame:
    """Eligible companies, longest untried first; never tried counts as 1970."""
    rows = discovery_eligible(
        only_tickers(companies, tickers), domains, endpoints, state, as_of, **retry
    )
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp")
    oldest = F.coalesce("last_attempt_at", epoch)
    return take(rows, [oldest.asc(), F.asc("ticker")], limit).select(*TARGET)


def count_without_endpoint(companies, domains, endpoints, state, as_of, **retry) -> DataFrame:
    rows = discovery_eligible(companies, domains, endpoints, state, as_of, **retry)
    return rows.agg(F.count("*").alias("total"))


def crawl_targets(companies, domains, tickers=None, limit=None) -> DataFrame:
    rows = best_domain(only_tickers(companies, tickers), domains)
    return take(rows.select(*TARGET), [F.asc("ticker")], limit)


def crawl_targets_with_endpoint(companies, domains, endpoints, tickers=None, limit=None,
                                since=None) -> DataFrame:
    """Targets that have an endpoint, latest detection first; ``since`` filters before the max."""
    found = endpoints.select("company_id", "detected_at")
    if since is not None:
        found = found.where(F.col("detected_at") >= F.lit(since).cast("timestamp"))
    newest = found.groupBy("company_id").agg(F.max("detected_at").alias("max_detected_at"))
    rows = best_domain(only_tickers(companies, tickers), domains).join(newest, "company_id")
    return take(rows, [F.desc("max_detected_at"), F.asc("ticker")], limit).select(*TARGET)


def company_target_by_id(companies, domains, company_id: int) -> DataFrame:
    one = companies.where(F.col("id") == company_id)
    return best_domain(one, domains.where(F.col("company_id") == company_id)).select(*TARGET)


def merge_targets(recent: DataFrame, fallback: DataFrame, limit: int) -> DataFrame:
    """Recent targets first, then fallback ones; the first row of a company wins.

    Both inputs carry ``pos``, their place in their own list. A recent list that
    already fills the limit is returned as it is, as in the crawl selection.
    """
    both = recent.withColumn("_source", F.lit(0)).unionByName(
        fallback.withColumn("_source", F.lit(1))
    )
    first = dedupe_first(both, ["company_id"], [F.asc("_source"), F.asc("pos")])
    return take(first, [F.asc("_source"), F.asc("pos")], limit).drop("_source", "pos")


def company_search(companies, domains, text: str, limit: int) -> DataFrame:
    """LIKE on ticker, name and lowest domain; exact ticker first, then exact name."""
    wanted = text.strip().lower()
    like = f"%{like_text(wanted)}%"
    lowest = domains.groupBy("company_id").agg(F.min("domain").alias("domain"))
    rows = companies.select("id", "ticker", "name").join(
        lowest.withColumnRenamed("company_id", "id"), "id", "left"
    )
    hit = (
        F.lower("ticker").like(like)
        | F.lower("name").like(like)
        | F.lower(F.coalesce("domain", F.lit(""))).like(like)
    )
    place = F.when(F.lower("ticker") == wanted, 0).when(F.lower("name") == wanted, 1).otherwise(2)
    return take(rows.where(hit), [place.asc(), F.asc("ticker")], limit)


def existing_tickers(companies: DataFrame, tickers) -> DataFrame:
    return only_tickers(companies.select("ticker"), tickers)


def cohort_domain_state(companies, domains, cohort: DataFrame) -> DataFrame:
    """State of the companies in a cohort table, with the latest domain if any."""
    ids = cohort.select(F.col("company_id").alias("id"))
    rows = companies.join(ids, "id", "left_semi").select(
        F.col("id").alias("company_id"), "ticker", "domain_resolution_status",
        F.col("domain_resolution_method").alias("company_domain_resolution_method"),
        "domain_resolution_attempted_at",
    )
    newest = latest_domain(domains).select(
        "company_id", "domain", "source", "resolution_method", "resolved_at"
    )
    return rows.join(newest, "company_id", "left").orderBy("ticker")


def seed_domains(companies, domains, limit: int | None = None) -> DataFrame:
    """Hosts of the best domains in ticker order, each host once, first place kept.

    All domains are deduplicated; ``limit`` cuts the hosts, not what is read for them.
    """
    from rolecall.operators.normalize import url_hosts

    rows = best_domain(companies, domains)
    return url_hosts(rows.select("domain", F.col("ticker").alias("pos")), limit)
