"""Funnels, roll-ups, snapshots and gates over runs and batches."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolecall.functions import fixed_values as V
from rolecall.functions import reasons as R
from rolecall.functions.text import blank_to_null
from rolecall.operators.diagnostics import by_window, of_run, top_n, union_all, with_company
from rolecall.operators.latest import latest_domain, top_per_group
from rolecall.operators.normalize import attempt_stage, attempt_status, url_pattern
from rolecall.operators.targets import take

FUNNEL = ["careers_url_found", "vendor_detected", "endpoint_extracted"]


def rate(num: Column, den: Column, places: int | None = 4) -> Column:
    """Ratio, null when the denominator is zero."""
    out = F.try_divide(num.cast("double"), den.cast("double"))
    return out if places is None else F.round(out, places)


# --- discovery funnels -----------------------------------------------------


def source_funnel(results: DataFrame, domains: DataFrame, run_id=None) -> DataFrame:
    """Company results with the source and method of the latest domain, NONE without one."""
    newest = latest_domain(
        domains.select("id", "company_id", "source", "resolution_method", "resolved_at")
    ).select("company_id", "source", "resolution_method")
    rows = of_run(results, "discovery_run_id", run_id).join(newest, "company_id", "left")
    return rows.withColumns({
        "domain_source": F.coalesce("source", F.lit("NONE")),
        "domain_resolution_method": F.coalesce("resolution_method", F.lit("NONE")),
    }).drop("source", "resolution_method")


def source_funnel_crosstab(results, domains, run_id=None) -> DataFrame:
    keys = ["discovery_run_id", "domain_source", "domain_resolution_method", "status", *FUNNEL]
    return source_funnel(results, domains, run_id).groupBy(*keys).agg(F.count("*").alias("total"))


def source_funnel_summary(results, domains, run_id=None, places=4) -> DataFrame:
    """Per source: attempts, funnel steps, outcomes and the rates between steps."""
    rows = source_funnel(results, domains, run_id)
    out = rows.groupBy("discovery_run_id", "domain_source").agg(
        F.count("*").alias("attempted_count"),
        *[F.count_if(F.col(c)).alias(f"{c}_count") for c in FUNNEL],
        F.count_if(F.col("status") == "SUCCEEDED").alias("succeeded_count"),
        F.count_if(F.col("status") == "FAILED").alias("failed_count"),
    )
    return out.withColumns(funnel_rates("attempted_count", places))


def funnel_rates(base: str, places=4) -> dict[str, Column]:
    return {
        "careers_url_found_rate": rate(F.col("careers_url_found_count"), F.col(base), places),
        "vendor_detected_rate_among_found": rate(
            F.col("vendor_detected_count"), F.col("careers_url_found_count"), places),
        "endpoint_extracted_rate_among_vendor_detected": rate(
            F.col("endpoint_extracted_count"), F.col("vendor_detected_count"), places),
    }


def stage_durations(results: DataFrame, run_id=None) -> DataFrame:
    d = F.col("duration_ms")
    rows = of_run(results, "discovery_run_id", run_id).where(d.isNotNull())
    return rows.groupBy("discovery_run_id", F.coalesce("stage", F.lit("UNKNOWN")).alias("stage")).agg(
        F.count("*").alias("total"), F.sum(d).alias("total_duration_ms"),
        F.avg(d).alias("avg_duration_ms"), F.min(d).alias("min_duration_ms"),
        F.max(d).alias("max_duration_ms"),
    )


def funnel_samples(results, companies, run_id=None, limit=None) -> DataFrame:
    rows = with_company(of_run(results, "discovery_run_id", run_id), companies)
    return take(rows, [F.desc("created_at"), F.desc("id")], limit)


def failures_in_run_window(failures, runs, results, companies, as_of, run_id=None) -> DataFrame:
    """Failures observed while a run was on, with that run's result of the company."""
    window = of_run(runs, "id", run_id).select(
        F.col("id").alias("discovery_run_id"), F.col("started_at").alias("_from"),
        F.coalesce("finished_at", F.lit(as_of).cast("timestamp")).alias("_to"),
    )
    inside = by_window(failures, window, "observed_at", "_from", "_to").drop("_from", "_to")
    outcome = results.select(
        "discovery_run_id", "company_id", "stage", "careers_discovery_method",
        "careers_discovery_stage_failure",
    )
    return with_company(inside.join(outcome, ["discovery_run_id", "company_id"], "left"), companies)


# --- attempted URLs --------------------------------------------------------


def attempt_evidence(failures: DataFrame, results: DataFrame, n: int = 20) -> DataFrame:
    """First ``n`` attempted URLs of each evidence group.

    Failures come first in their order (``ord``), then the URLs that company
    results name: initial, final and endpoint URL, each in its own group.
    """
    failed = failures.where(F.col("candidate_url") != "").select(
        attempt_stage(F.col("candidate_url"), F.col("reason_code"),
                      F.col("careers_discovery_method")).alias("evidence_group"),
        F.lit(0).alias("_source"), F.col("ord"), F.lit(0).alias("_field"),
        F.col("company_id"), F.col("candidate_url").alias("url"),
        attempt_status([], "detail").alias("status_code"), "reason_code", "detail",
    )
    named = F.explode(F.array(*[
        F.struct(F.lit(i).alias("field"), F.lit(g).alias("grp"), F.col(c).alias("url"))
        for i, (c, g) in enumerate([
            ("careers_url_initial", "careers_candidate_attempts"),
            ("careers_url_final", "fallback_path_attempts"),
            ("endpoint_url", "vendor_probe_attempts"),
        ])
    ]))
    status = F.coalesce("http_status", "http_status_first_failure")
    found = results.select(named.alias("x"), "ord", "company_id", status.alias("status_code"),
                           "reason_code", F.col("careers_discovery_stage_failure").alias("detail"))
    found = found.where(F.col("x.url") != "").select(
        F.col("x.grp").alias("evidence_group"), F.lit(1).alias("_source"), "ord",
        F.col("x.field").alias("_field"), "company_id", F.col("x.url").alias("url"), "status_code",
        "reason_code", "detail",
    )
    order = [F.asc("_source"), F.asc("ord"), F.asc("_field")]
    return top_per_group(failed.unionByName(found), ["evidence_group"], order, n).drop(
        "_source", "_field")


def failing_url_patterns(failures: DataFrame, n: int | None = None) -> DataFrame:
    """Host and first path segment by status, with the count and the first URL seen."""
    rows = failures.select(
        url_pattern(F.col("candidate_url")).alias("url_pattern"),
        attempt_status([], "detail").alias("status"), "candidate_url", "ord",
    ).where(F.col("url_pattern").isNotNull())
    out = rows.groupBy("url_pattern", "status").agg(
        F.count("*").alias("total"), F.min_by("candidate_url", "ord").alias("sample_url"))
    shown = F.coalesce(F.col("status").cast("string"), F.lit("ERR"))
    return take(out, [F.desc("total"), F.asc("url_pattern"), shown.asc()], n)


# --- count maps ------------------------------------------------------------


def merged_counts(rows: DataFrame, maps: str, *keys: str) -> DataFrame:
    """Sum of a count-map column by map key."""
    return rows.select(*keys, F.explode(maps).alias("key", "_n")).groupBy(*keys, "key").agg(
        F.sum("_n").alias("total"))


def merged_top_errors(summaries: DataFrame, n: int) -> DataFrame:
    return top_n(merged_counts(summaries, "top_errors"), n)


BATCH_SUMS = {
    "processed_count": "processed", "succeeded_count": "succeeded", "failed_count": "failed",
    "selection_eligible_count": "selection_eligible_count",
    "selection_returned_count": "selection_returned_count",
    "companies_input_count": "companies_input_count",
    "companies_attempted_count": "companies_attempted_count",
    "cached_skip_count": "cached_skip_count",
    "careers_url_found_count": "careers_url_found_count",
    "vendor_detected_count": "vendor_detected_count",
    "endpoint_extracted_count": "endpoint_extracted_count",
}


def batch_rollup(statuses: DataFrame, places: int | None = 4) -> DataFrame:
    """One row with the summed counters of all batches and the funnel rates."""
    out = statuses.agg(*[
        F.coalesce(F.sum(F.coalesce(F.col(c), F.lit(0)).cast("bigint")), F.lit(0)).alias(name)
        for c, name in BATCH_SUMS.items()
    ])
    return out.withColumns(
        {"success_rate": rate(F.col("succeeded"), F.col("processed"), places)}
        | funnel_rates("processed", places)
    )


def batch_failures(statuses: DataFrame) -> DataFrame:
    """Summed failure maps of all batches: kind, key and total."""
    return union_all([
        merged_counts(statuses, c).select(F.lit(c).alias("kind"), "key", "total")
        for c in ("careers_stage_failures_by_reason", "failures_by_reason")
    ])


def selection_metrics(statuses: DataFrame) -> DataFrame:
    """Per batch: the selection counters, missing ones as zero."""
    names = ["selection_eligible_count", "selection_returned_count", "companies_input_count",
             "companies_attempted_count", "cached_skip_count", "vendor_detected_count",
             "endpoint_extracted_count", "processed_count"]
    return statuses.select("batch", "run_id", "status", *[
        F.coalesce(F.col(n), F.lit(0)).cast("bigint").alias(n) for n in names
    ])


def resolve_rollup(batches: DataFrame, counters: list[str]) -> DataFrame:
    """Summed counters of domain-resolve batches and the number of batches."""
    return batches.agg(F.count("*").alias("batch_count"), *[
        F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counters
    ])


def distinct_sample_errors(batches: DataFrame, limit: int | None = None) -> DataFrame:
    """First distinct error texts over the batches, in order."""
    texts = batches.select("batch", F.posexplode("sample_errors").alias("pos", "error"))
    first = texts.where(F.col("error") != "").groupBy("error").agg(
        F.min(F.struct("batch", "pos")).alias("place"))
    return take(first, [F.asc("place"), F.asc("error")], limit).select("error")


def soak_report(cycles: DataFrame) -> DataFrame:
    """Domains before the first and after the last cycle, and summed counters."""
    totals = ["selection_eligible_count", "selection_returned_count", "companies_attempted_count",
              "vendor_detected_count", "endpoint_extracted_count"]
    out = cycles.agg(
        F.count("*").alias("cycles_completed"),
        F.min_by("domains_before", "cycle").alias("domains_before"),
        F.max_by("domains_after", "cycle").alias("domains_after"),
        *[F.sum(c).alias(c) for c in totals],
    )
    return out.withColumn("domains_delta", F.col("domains_after") - F.col("domains_before"))


def soak_buckets(cycles: DataFrame, maps: str, n: int = 10) -> DataFrame:
    return top_n(merged_counts(cycles, maps).where(F.col("total") > 0), n)


# --- throughput, snapshots, cohorts ----------------------------------------


def per_hour(count: Column, seconds: Column, places: int | None = 3) -> Column:
    """Rate per hour, zero when no time has passed."""
    out = F.when(seconds > 0, count * F.lit(3600.0) / seconds).otherwise(F.lit(0.0))
    return out if places is None else F.round(out, places)


def throughput(runs: DataFrame, as_of, places: int | None = 3) -> DataFrame:
    """Companies, endpoints and requests per hour of every run."""
    end = F.coalesce("finished_at", F.lit(as_of).cast("timestamp"))
    seconds = (F.unix_micros(end) - F.unix_micros("started_at")) / F.lit(1e6)
    return runs.select(
        F.col("id").alias("run_id"), seconds.alias("duration_seconds"),
        per_hour(F.col("companies_attempted_count"), seconds, places).alias("companies_per_hour"),
        per_hour(F.col("endpoints_added"), seconds, places).alias("endpoints_per_hour"),
        per_hour(F.col("request_count_total"), seconds, places).alias("requests_per_hour"),
    )


METRIC = ["metric", "dim1", "dim2", "value"]


def _scalars(df: DataFrame, **aggs: Column) -> DataFrame:
    """Several aggregates of one table in one pass, as metric rows."""
    wide = df.agg(*[c.cast("bigint").alias(n) for n, c in aggs.items()])
    pairs = F.explode(F.array(*[
        F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in aggs
    ]))
    return wide.select(pairs.alias("x")).select(
        "x.metric", F.lit("").alias("dim1"), F.lit("").alias("dim2"), "x.value")


def _grouped(df: DataFrame, metric: str, dim1: str, dim2: str | None = None) -> DataFrame:
    one = F.coalesce(F.col(dim1), F.lit("<null>")).alias("dim1")
    two = F.lit("").alias("dim2") if dim2 is None else F.coalesce(
        F.col(dim2), F.lit("<null>")).alias("dim2")
    return df.groupBy(one, two).agg(F.count("*").alias("value")).select(
        F.lit(metric).alias("metric"), "dim1", "dim2", "value")


def metric_snapshot(hosts, urls, attempts, endpoints, as_of, before_attempt_id=0,
                    before_endpoint_id=0, top_errors: int | None = None) -> DataFrame:
    """Table counts and distributions in long form; run scope is what is above the marks.

    ``top_errors`` keeps only so many error buckets, the largest.
    """
    now = F.lit(as_of).cast("timestamp")
    one = F.count("*")
    new_attempt = F.col("id") > before_attempt_id
    new_endpoint = F.col("id") > before_endpoint_id
    buckets = _grouped(attempts.where(new_attempt), "attempt_error_bucket_run_scope", "error_bucket")
    return union_all([
        _scalars(hosts, crawl_hosts_count=one,
                 inflight_sum=F.coalesce(F.sum("inflight_count"), F.lit(0))),
        _scalars(urls, crawl_urls_count=one, queued_total=F.count_if(F.col("status") == "QUEUED"),
                 fetching_rows=F.count_if(F.col("status") == "FETCHING"),
                 locked_rows=F.count_if(F.col("locked_until") > now)),
        _scalars(attempts, crawl_url_attempts_count=one,
                 attempts_created_run_scope=F.count_if(new_attempt)),
        _scalars(endpoints, ats_endpoints_count=one,
                 ats_companies_count=F.countDistinct("company_id"),
                 ats_endpoints_created_run_scope=F.count_if(new_endpoint),
                 ats_companies_created_run_scope=F.countDistinct(
                     F.when(new_endpoint, F.col("company_id")))),
        _grouped(urls, "crawl_urls_status", "url_kind", "status"),
        take(buckets, [F.desc("value"), F.asc("dim1")], top_errors),
        _grouped(endpoints, "ats_type_total", "ats_type"),
        _grouped(endpoints.where(new_endpoint), "ats_type_created_run_scope", "ats_type"),
    ]).select(*METRIC)


def scale_snapshot(hosts, urls, attempts, endpoints, results, run_id) -> DataFrame:
    """Table counts, endpoints by vendor and validation, and failures of a run, long form."""
    checked = endpoints.withColumn(
        "validation", F.when(F.col("verified"), F.lit("validated")).otherwise("unvalidated"))
    failed = of_run(results, "discovery_run_id", run_id).where(F.col("reason_code").isNotNull())
    return union_all([
        _scalars(hosts, crawl_hosts_count=F.count("*")),
        _scalars(urls, crawl_urls_count=F.count("*")),
        _scalars(attempts, crawl_url_attempts_count=F.count("*")),
        _scalars(endpoints, companies_with_endpoint_count=F.countDistinct("company_id")),
        _grouped(endpoints, "endpoints_by_vendor", "ats_type"),
        _grouped(checked, "endpoints_by_validation", "validation"),
        _grouped(failed, "attempts_by_error_bucket", "reason_code"),
    ]).select(*METRIC)


def snapshot_metrics(endpoints: DataFrame, domains: DataFrame) -> DataFrame:
    """Endpoint rows, companies with an endpoint or a domain, and endpoints by type."""
    by_type = endpoints.groupBy(F.coalesce("ats_type", F.lit("UNKNOWN")).alias("dim1")).agg(
        F.count("*").alias("value"))
    return union_all([
        _scalars(endpoints, ats_endpoints_count=F.count("*"),
                 companies_with_ats_endpoint_count=F.countDistinct("company_id")),
        _scalars(domains, companies_with_domain_count=F.countDistinct("company_id")),
        by_type.select(F.lit("endpoints_by_type").alias("metric"), "dim1", F.lit("").alias("dim2"), "value"),
    ]).select(*METRIC)


def snapshot_delta(start: DataFrame, end: DataFrame) -> DataFrame:
    """End minus start for every metric either side has.

    Both sides carry a boolean ``ok``; without an ok start and an ok end there
    are no rows.
    """
    keys = ["metric", "dim1", "dim2"]
    a = start.where(F.col("ok")).select(*keys, F.col("value").alias("_start"))
    b = end.where(F.col("ok")).select(*keys, F.col("value").alias("_end"))
    both = a.join(b, keys, "full")
    sides = both.agg(F.max(F.col("_start").isNotNull()).alias("_has_start"),
                     F.max(F.col("_end").isNotNull()).alias("_has_end"))
    usable = sides.where(F.col("_has_start") & F.col("_has_end")).select(F.lit(True).alias("_usable"))
    delta = F.coalesce("_end", F.lit(0)) - F.coalesce("_start", F.lit(0))
    return both.withColumn("_usable", F.lit(True)).join(usable, "_usable", "left_semi").select(
        *keys, delta.alias("delta"))


def cohort_report(cohort: DataFrame, after: DataFrame) -> DataFrame:
    """Companies of a cohort with what became of them.

    ``after`` is the state of the companies (``cohort_domain_state``).
    """
    state = after.select("company_id", "domain", "source", "resolution_method",
                         "company_domain_resolution_method")
    rows = cohort.select("company_id").distinct().join(state, "company_id", "left")
    resolved = F.coalesce(F.trim("domain") != "", F.lit(False))
    method = F.coalesce(blank_to_null(F.col("resolution_method")),
                        blank_to_null(F.col("company_domain_resolution_method")), F.lit("UNKNOWN"))
    return rows.select("company_id", resolved.alias("resolved"),
                       F.when(resolved, method).alias("resolved_by"))


def cohort_summary(report: DataFrame, places: int | None = 4) -> DataFrame:
    out = report.agg(F.count("*").alias("cohort_size"),
                     F.count_if(F.col("resolved")).alias("resolved_count"))
    return out.withColumn("resolution_rate", rate(F.col("resolved_count"), F.col("cohort_size"), places))


def cohort_methods(report: DataFrame) -> DataFrame:
    return report.where(F.col("resolved")).groupBy("resolved_by").agg(F.count("*").alias("total"))


# --- gates -----------------------------------------------------------------


def metric_columns(snapshot: DataFrame, names: list[str]) -> DataFrame:
    """One row with the named scalar metrics as columns, zero when absent."""
    return snapshot.agg(*[
        F.coalesce(F.sum(F.when(F.col("metric") == n, F.col("value"))), F.lit(0)).alias(n)
        for n in names
    ])


def release_gate(after_seed: DataFrame, after_fetch: DataFrame, after_endpoints: DataFrame,
                 fetch_seconds: float) -> DataFrame:
    """GO only if frontier, fetch and endpoint stage all pass their thresholds."""
    def tagged(df, names):
        return metric_columns(df, names).withColumn("_one", F.lit(1))

    row = tagged(after_seed, ["crawl_hosts_count", "crawl_urls_count"]).join(
        tagged(after_fetch, ["attempts_created_run_scope"]), "_one"
    ).join(
        tagged(after_endpoints, ["ats_endpoints_created_run_scope", "ats_companies_created_run_scope"]),
        "_one",
    )
    minutes = float(fetch_seconds) / 60.0
    per_minute = F.col("attempts_created_run_scope") / F.lit(minutes) if minutes > 0 else F.lit(0.0)
    row = row.withColumn("attempts_per_minute", per_minute).withColumns({
        "frontier_pass": (F.col("crawl_hosts_count") >= V.GATE_MIN_HOSTS)
        & (F.col("crawl_urls_count") >= V.GATE_MIN_URLS),
        "fetch_pass": (F.col("attempts_created_run_scope") > 0)
        & (F.col("attempts_per_minute") > V.GATE_MIN_ATTEMPTS_PER_MINUTE),
        "ats_pass": (F.col("ats_endpoints_created_run_scope") > 0)
        & (F.col("ats_companies_created_run_scope") > 0),
    })
    go = F.col("frontier_pass") & F.col("fetch_pass") & F.col("ats_pass")
    return row.withColumn("decision", F.when(go, F.lit("GO")).otherwise("NO-GO")).drop("_one")


def full_mode_gate(statuses: DataFrame, threshold: float = V.GATE_SUCCESS_RATE, requested: bool = True,
                   explicit: bool = False, batches: int = 1, batch_size: int = 200) -> DataFrame:
    """Whether the full run may follow the vendor-probe batches, and at what size.

    Too few companies or an aborted batch still allow a full run, at one batch of
    half the size; an explicit request always runs.
    """
    row = batch_rollup(statuses, None).withColumn("_one", F.lit(1)).join(
        statuses.agg(F.coalesce(F.max(F.upper("status") == "ABORTED"), F.lit(False)).alias("aborted"))
        .withColumn("_one", F.lit(1)), "_one")
    met = F.coalesce(F.round("success_rate", 4) >= threshold, F.lit(False))
    few = F.col("aborted") | (F.col("processed") < V.GATE_MIN_PROCESSED)
    passed = ~few & met
    below = F.concat(
        F.lit("vendor_probe_success_rate_below_threshold ("),
        F.coalesce(F.round("success_rate", 4), F.lit(0.0)).cast("string"), F.lit(f" < {threshold})"))
    why_few = F.concat(F.lit("insufficient_sample: "), F.concat_ws(
        ", ",
        F.when(F.col("aborted"), F.lit("vendor_probe_status_aborted")),
        F.when(F.col("processed") < V.GATE_MIN_PROCESSED, F.concat(
            F.lit("processed_below_minimum ("), F.col("processed"),
            F.lit(f" < {V.GATE_MIN_PROCESSED})"))),
    ))
    gate_reason = F.when(few, why_few).when(
        passed, F.lit("vendor_probe_success_rate_met_threshold")).otherwise(below)
    forced = bool(requested and explicit)
    if forced:
        run_full, reduced = F.lit(True), F.lit(False)
        reason = F.when(passed, F.lit("run_full_mode_enabled_threshold_also_passed")).otherwise(
            "forced_by_run_full_mode_flag")
    elif not requested:
        run_full, reduced, reason = F.lit(False), F.lit(False), F.lit("disabled_by_flag")
    else:
        run_full, reduced = few | met, few
        reason = F.when(few, F.lit("insufficient_sample_reduced_budget_full_mode")).when(
            met, F.lit("threshold_passed")).otherwise(gate_reason)
    small = max(1, batch_size // 2)
    return row.select(
        "processed", "success_rate", met.alias("threshold_pass"), few.alias("insufficient_sample"),
        passed.alias("gate_pass"), gate_reason.alias("gate_reason"), run_full.alias("run_full"),
        reduced.alias("run_reduced_budget"), reason.alias("decision_reason"),
        F.when(reduced, min(batches, 1)).otherwise(batches).alias("planned_batches"),
        F.when(reduced, small).otherwise(batch_size).alias("planned_discover_batch_size"),
    )


def domain_bottleneck(results: DataFrame, runs: DataFrame, requested: int, resolved: int,
                      attempted: int) -> DataFrame:
    """Per run: is discovery limited by missing domains?"""
    lost = results.where((F.col("status") == "FAILED") & F.lower("reason_code").contains("domain"))
    lost = lost.groupBy(F.col("discovery_run_id").alias("id")).agg(
        F.count("*").alias("no_domain_reason_count"))
    rows = runs.select("id", "processed_count").join(lost, "id", "left").na.fill(
        0, ["no_domain_reason_count"])
    fill = F.col("processed_count") / F.lit(float(requested)) if requested else F.lit(0.0)
    short = (fill < 0.8) & F.lit(resolved == 0 and attempted > 0)
    return rows.select(
        F.col("id").alias("run_id"), ((F.col("no_domain_reason_count") > 0) | short).alias("likely_domain_limited"),
        "no_domain_reason_count", fill.alias("processed_fill_rate"),
    )


def rate_limit_share(attempts: DataFrame) -> DataFrame:
    """Requests, 429 answers and their share; zero without requests."""
    bucket = R.status_bucket(F.col("http_status"), F.col("error_bucket"))
    out = attempts.agg(F.count("*").alias("requests"), F.count_if(bucket == "HTTP_429").alias("rate_limited"))
    return out.withColumn(
        "rate", F.when(F.col("requests") > 0, F.col("rate_limited") / F.col("requests")).otherwise(0.0))


def step_errors(steps: dict[str, DataFrame]) -> DataFrame:
    """Errors of all steps summed by key; every cool-down key also counts as HOST_COOLDOWN.

    ``steps`` maps a step name to rows of key and total.
    """
    rows = union_all([df.select("key", F.col("total").cast("bigint").alias("total"))
                      for df in steps.values()])
    cooled = rows.where(F.lower("key").contains("host_cooldown") & (F.col("key") != "HOST_COOLDOWN"))
    extra = cooled.select(F.lit("HOST_COOLDOWN").alias("key"), "total")
    return rows.unionByName(extra).groupBy("key").agg(F.sum("total").alias("total"))
