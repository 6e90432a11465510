"""Composite reports: each names the DataFrames it is made of.

Nothing runs until a part is used. ``t`` is a dict of tables by name, for the
names in the data model.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolecall.operators import diagnostics as D
from rolecall.operators import postings as P
from rolecall.operators import rollups as R
from rolecall.operators import targets as T
from rolecall.operators.normalize import failure_types, status_buckets

Tables = dict[str, DataFrame]
Report = dict[str, DataFrame]

COUNTED = ["companies", "company_domains", "ats_endpoints", "crawl_runs", "discovered_urls",
           "job_postings"]
COVERED = ["company_domains", "discovered_urls", "ats_endpoints", "job_postings"]


def recent_run_summary(t: Tables, as_of) -> DataFrame:
    """The latest crawl run with its postings, running seconds and last activity."""
    run = D.latest_run(t["crawl_runs"])
    meta = run.withColumnRenamed("id", "crawl_run_id")
    jobs = D.jobs_for_run(t["job_postings"], run, as_of)
    activity = D.last_activity(t["discovered_urls"], t["discovered_sitemaps"], t["job_postings"])
    end = F.coalesce("finished_at", F.lit(as_of).cast("timestamp"))
    seconds = F.floor((F.unix_micros(end) - F.unix_micros("started_at")) / 1000000)
    out = meta.join(jobs.withColumnRenamed("total", "jobs_extracted"), "crawl_run_id", "left")
    out = out.join(activity, "crawl_run_id", "left")
    return out.withColumns({
        "seconds_running": seconds, "last_activity": F.coalesce("last_activity", "started_at"),
    })


def latest_run_top_errors(t: Tables, limit: int = 5) -> DataFrame:
    run = D.latest_run(t["crawl_runs"]).select(F.col("id").alias("crawl_run_id"))
    return D.top_errors(t["discovered_urls"].join(run, "crawl_run_id", "left_semi"), None, limit)


def service_status(t: Tables, as_of) -> Report:
    return {
        "counts": D.table_counts({n: t[n] for n in COUNTED}),
        "recent_run": recent_run_summary(t, as_of),
        "top_errors": latest_run_top_errors(t),
    }


def coverage_diagnostics(t: Tables) -> Report:
    return {
        "counts": D.table_counts({n: t[n] for n in COVERED}),
        "by_type": D.endpoints_by_type(t["ats_endpoints"]),
        "by_method": D.endpoints_by_method(t["ats_endpoints"]),
    }


def discovery_failure_diagnostics(t: Tables, limit: int = 20) -> Report:
    counts = D.discovery_failures_by_reason(t["careers_discovery_failures"])
    reasons = counts.withColumnRenamed("reason_code", "reason")
    return {
        "by_reason": counts,
        "by_type": failure_types(reasons),
        "top_types": failure_types(reasons, 10),
        "top_reasons": D.top_n(reasons, 10, key="reason"),
        "recent": D.recent_discovery_failures(t["careers_discovery_failures"], t["companies"], limit),
    }


def attempt_diagnostics(t: Tables, limit: int = 20) -> Report:
    return {
        "by_status": D.attempts_by_status(t["discovered_urls"]),
        "recent": D.recent_api_failures(t["discovered_urls"], t["companies"], limit),
    }


def crawl_run_diagnostics(t: Tables, limit: int = 10) -> DataFrame:
    """The newest runs with their activity counts."""
    runs = D.recent_runs(t["crawl_runs"], limit)
    counts = D.run_activity_counts(runs, t["discovered_urls"], t["discovered_sitemaps"], t["job_postings"])
    return runs.withColumnRenamed("id", "crawl_run_id").join(counts, "crawl_run_id").orderBy(
        F.desc("started_at"), F.desc("crawl_run_id"))


def crawl_run_report(t: Tables, run_id: int, status: str | None = None, limit: int = 200) -> Report:
    results = t["crawl_run_company_results"]
    activity = D.last_activity(t["discovered_urls"], t["discovered_sitemaps"], t["job_postings"], run_id)
    state = D.crawl_run_status(t["crawl_runs"], run_id)
    return {
        "status": state.join(activity.withColumnRenamed("crawl_run_id", "id"), "id", "left"),
        "failures_by_reason": D.company_failures_by_reason(results, "crawl_run_id", run_id),
        "results": D.company_results_view(results, t["companies"], "crawl_run_id", "started_at", run_id, status, limit),
        "overall": D.overall_company_results(results, t["companies"], run_id, status, limit),
        "recent_failures": D.recent_run_failures(
            results, t["companies"], "crawl_run_id", "finished_at", run_id, 20, nulls_last=True),
    }


def discovery_run_report(t: Tables, run_id: int, status: str | None = None, limit: int = 200) -> Report:
    results = t["careers_discovery_company_results"]
    return {
        "status": D.discovery_run_status(t["careers_discovery_runs"], run_id),
        "funnel": D.run_funnel(results, run_id),
        "stage_failures": D.stage_failures(results, run_id),
        "failures_by_reason": D.company_failures_by_reason(results, "discovery_run_id", run_id),
        "results": D.company_results_view(
            results, t["companies"], "discovery_run_id", "created_at", run_id, status, limit),
        "recent_failures": D.recent_run_failures(
            results, t["companies"], "discovery_run_id", "created_at", run_id, 20),
    }


def missing_domain_diagnostics(t: Tables, as_of, limit: int = 50) -> Report:
    """Companies still without a domain, and how many for each cached reason."""
    lacking = T.without(t["companies"], t["company_domains"])
    reason = F.coalesce(F.upper("domain_resolution_status"), F.lit("NOT_ATTEMPTED"))
    return {
        "total": lacking.agg(F.count("*").alias("total")),
        "by_reason": lacking.groupBy(reason.alias("reason")).agg(F.count("*").alias("total")),
        "eligible": T.count_missing_domain(t["companies"], t["company_domains"], as_of),
        "non_employers": T.count_non_employers(t["companies"], t["company_domains"], as_of),
        "companies": T.companies_missing_domain(t["companies"], t["company_domains"], as_of, limit),
    }


def crawl_target_preview(t: Tables, limit: int, since=None, tickers=None, with_endpoint: bool = True) -> DataFrame:
    """The companies a crawl would take: recently detected first, then all with an endpoint."""
    companies, domains, endpoints = t["companies"], t["company_domains"], t["ats_endpoints"]
    if not with_endpoint:
        return T.crawl_targets(companies, domains, tickers, limit)
    if tickers is not None or since is None:
        return T.crawl_targets_with_endpoint(companies, domains, endpoints, tickers, limit)

    def placed(found):
        rows = T.best_domain(companies, domains).join(found, "company_id")
        order = F.struct((-F.unix_micros("max_detected_at")).alias("newest"), F.col("ticker").alias("ticker"))
        return rows.select(*T.TARGET, order.alias("pos"))

    newest = endpoints.groupBy("company_id").agg(F.max("detected_at").alias("max_detected_at"))
    recent = newest.where(F.col("max_detected_at") >= F.lit(since).cast("timestamp"))
    return T.merge_targets(placed(recent), placed(newest), limit).select(*T.TARGET)


def canary_report(t: Tables, run_id: int, domain_errors: DataFrame, discovery_errors: DataFrame) -> Report:
    """A canary's crawl by vendor, and its errors by step and over all steps.

    The error tables hold key and total of the domain and discovery steps.
    """
    results = t["crawl_run_company_results"]
    crawl = D.company_failures_by_reason(results, "crawl_run_id", run_id).select(
        F.col("reason_code").alias("key"), "total")
    steps = {"crawl": crawl, "domain_resolution": domain_errors.where(F.col("total") > 0),
             "discovery": discovery_errors}
    return {
        "companies_by_type": D.run_companies_by_type(results, run_id),
        "jobs_by_type": D.run_jobs_by_type(results, run_id),
        "errors_by_step": D.union_all([
            df.select(F.lit(name).alias("step"), "key", F.col("total").cast("bigint").alias("total"))
            for name, df in steps.items()
        ]),
        "errors": R.step_errors(steps),
    }


def domain_assessment(t: Tables, requested: int, resolved: int, attempted: int) -> Report:
    """Is discovery held back by missing domains, and how does each source fare?"""
    results = t["careers_discovery_company_results"]
    return {
        "by_source": R.source_funnel_summary(results, t["company_domains"]),
        "bottleneck": R.domain_bottleneck(results, t["careers_discovery_runs"], requested, resolved, attempted),
    }


def seed_run_report(t: Tables) -> Report:
    """Answers of a seed run by bucket, the share of 429 answers, and the queue by status."""
    return {
        "buckets": status_buckets(t["crawl_url_attempts"]),
        "rate_limit": R.rate_limit_share(t["crawl_url_attempts"]),
        "queue": D.url_status_counts(t["crawl_urls"]),
    }


def company_postings_report(t: Tables, company_id: int, from_run: int, to_run: int, as_of,
                            limit: int = 50) -> Report:
    """What changed for a company between two runs: counts and lists."""
    return {
        "counts": P.run_delta_counts(t["job_postings"], t["crawl_runs"], from_run, to_run, company_id, as_of),
        "changes": P.run_delta_postings(t["job_postings"], t["crawl_runs"], t["ats_endpoints"], from_run,
                                        to_run, company_id, limit, as_of=as_of),
    }
