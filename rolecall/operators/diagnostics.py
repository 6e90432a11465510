"""Counts and listings that describe the state of the tables and of runs.

Run-scoped operators take ``run_id``; None answers for every run at once, keyed
by the run column, where the service asked run by run.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolecall.functions import fixed_values as V
from rolecall.operators.latest import latest_domain, top_per_group
from rolecall.operators.targets import take
from rolecall.session import sized


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def of_run(df: DataFrame, column: str, run_id: int | None) -> DataFrame:
    return df if run_id is None else df.where(F.col(column) == run_id)


def count_by(df: DataFrame, key: str, *more: str) -> DataFrame:
    """Rows per key, largest first; null keys are left out."""
    out = df.where(F.col(key).isNotNull()).groupBy(*more, key).agg(F.count("*").alias("total"))
    return out.orderBy(*more, F.desc("total"), F.asc(key))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per table name with its row count."""
    return union_all([
        df.agg(F.count("*").alias("total")).select(F.lit(name).alias("table_name"), "total")
        for name, df in tables.items()
    ])


def endpoints_by_type(endpoints: DataFrame) -> DataFrame:
    return count_by(endpoints, "ats_type")


def endpoints_by_method(endpoints: DataFrame) -> DataFrame:
    return count_by(endpoints, "detection_method")


def endpoints_for_company(endpoints: DataFrame, company_id: int) -> DataFrame:
    return endpoints.where(F.col("company_id") == company_id).agg(F.count("*").alias("total"))


def discovery_failures_by_reason(failures: DataFrame) -> DataFrame:
    """Distinct companies per reason."""
    out = failures.where(F.col("reason_code").isNotNull()).groupBy("reason_code").agg(
        F.countDistinct("company_id").alias("total")
    )
    return out.orderBy(F.desc("total"), "reason_code")


def stage_failures(results: DataFrame, run_id=None) -> DataFrame:
    return count_by(of_run(results, "discovery_run_id", run_id),
                    "careers_discovery_stage_failure", "discovery_run_id")


def run_funnel(results: DataFrame, run_id=None) -> DataFrame:
    """Companies that reached each step of the funnel; one zero row for an unknown run."""
    sums = [
        F.coalesce(F.count_if(F.col(c)), F.lit(0)).alias(f"{c}_count")
        for c in ("careers_url_found", "vendor_detected", "endpoint_extracted")
    ]
    if run_id is None:
        return results.groupBy("discovery_run_id").agg(*sums)
    return of_run(results, "discovery_run_id", run_id).agg(*sums)


def company_failures_by_reason(results: DataFrame, run_column: str, run_id=None) -> DataFrame:
    failed = of_run(results, run_column, run_id).where(F.col("status") == "FAILED")
    return count_by(failed, "reason_code", run_column)


def attempts_by_status(urls: DataFrame) -> DataFrame:
    return count_by(urls.where(F.col("url_type") == "ATS_API"), "fetch_status")


def run_companies_by_type(results: DataFrame, run_id=None) -> DataFrame:
    rows = of_run(results, "crawl_run_id", run_id).where(F.col("stage") == "ATS_ADAPTER")
    out = rows.groupBy("crawl_run_id", F.coalesce("ats_type", F.lit("UNKNOWN")).alias("ats_type"))
    return out.agg(F.countDistinct("company_id").alias("total"))


def run_jobs_by_type(results: DataFrame, run_id=None) -> DataFrame:
    """Extracted postings per vendor, never below zero."""
    rows = of_run(results, "crawl_run_id", run_id).where(F.col("stage") == "ATS_ADAPTER")
    out = rows.groupBy("crawl_run_id", F.coalesce("ats_type", F.lit("UNKNOWN")).alias("ats_type"))
    jobs = F.sum(F.coalesce(F.col("jobs_extracted").cast("bigint"), F.lit(0)))
    return out.agg(F.greatest(jobs, F.lit(0)).alias("total"))


def jobs_for_run(postings: DataFrame, runs: DataFrame, as_of, run_id=None) -> DataFrame:
    """Postings per run: attributed to it, or unattributed and last seen inside its window.

    Unattributed postings meet the windows after being counted per second seen,
    so the range join works on distinct instants rather than on postings.
    """
    runs = of_run(runs, "id", run_id)
    own = postings.where(F.col("crawl_run_id").isNotNull()).groupBy(
        F.col("crawl_run_id").alias("id")
    ).agg(F.count("*").alias("n"))
    loose = postings.where(F.col("crawl_run_id").isNull()).groupBy("last_seen_at").agg(
        F.count("*").alias("n")
    )
    window = runs.select(
        "id", F.col("started_at").alias("_from"),
        F.coalesce("finished_at", F.lit(as_of).cast("timestamp")).alias("_to"),
    )
    seen = by_window(loose, window, "last_seen_at", "_from", "_to").groupBy("id").agg(
        F.sum("n").alias("n")
    )
    counts = own.unionByName(seen).groupBy("id").agg(F.sum("n").alias("n"))
    return runs.select("id").join(counts, "id", "left").select(
        F.col("id").alias("crawl_run_id"), F.coalesce("n", F.lit(0)).alias("total")
    )


#: Microseconds of the smallest cell of the time grid, as a power of two: about a second.
CELL_BITS = 20
LEVELS = 64 - CELL_BITS


def by_window(points: DataFrame, windows: DataFrame, at: str, start: str, end: str) -> DataFrame:
    """Points inside inclusive windows.

    A window is cut into the largest cells of a binary time grid that fit, two at
    most on each level. A point meets the windows that hold one of its cells, so
    it is compared with no window that it is not in, but for the cells at the two
    ends of a window. Points are looked up on the levels that some window uses.
    On the coarse levels many points share a cell, so windows are stored first: as
    long as they are few, Spark broadcasts them and no point is shuffled.
    """
    low, high = F.col("_low"), F.col("_high") + 1

    def cells(k):
        size = F.call_function("shiftleft", F.lit(1).cast("bigint"), k)
        first = F.call_function("shiftright", low + size - 1, k)
        stop = F.call_function("shiftright", high, k)
        odd = lambda x: x.bitwiseAND(1) == 1
        return F.array_compact(F.array(
            F.when((first < stop) & odd(first), F.struct(k.alias("level"), first.alias("cell"))),
            F.when((first < stop) & odd(stop), F.struct(k.alias("level"), (stop - 1).alias("cell")))))

    cut = sized(windows).where(F.col(start) <= F.col(end)).withColumns(
        {"_low": cell_of(start), "_high": cell_of(end)})
    pieces = cut.withColumn("_piece", F.explode(F.flatten(F.transform(
        F.sequence(F.lit(0), F.lit(LEVELS - 1)), cells)))).drop("_low", "_high")
    used = pieces.agg(F.array_sort(F.collect_set("_piece.level"))).scalar()
    own = F.transform("_levels", lambda k: F.struct(
        k.alias("level"), F.call_function("shiftright", F.col("_cell"), k).alias("cell")))
    keyed = points.withColumns({"_cell": cell_of(at), "_levels": used}).withColumn(
        "_piece", F.explode(own)).drop("_cell", "_levels")
    inside = (F.col(at) >= F.col(start)) & (F.col(at) <= F.col(end))
    return keyed.join(pieces, "_piece").where(inside).drop("_piece")


def cell_of(time: str):
    return F.shiftright(F.unix_micros(time), CELL_BITS)


def top_errors(urls: DataFrame, run_id: int, limit: int) -> DataFrame:
    rows = of_run(urls, "crawl_run_id", run_id).where(
        F.col("fetch_status").isNotNull() & ~F.col("fetch_status").isin(V.BENIGN_FETCH_STATUSES)
    )
    counts = rows.groupBy("fetch_status").agg(F.count("*").alias("total"))
    return take(counts, [F.desc("total"), F.asc("fetch_status")], limit)


def run_activity_counts(runs, urls, sitemaps, postings) -> DataFrame:
    """URLs, sitemaps and postings of every run, in one pass over each table."""
    parts = [
        (urls, "discovered_urls"), (sitemaps, "discovered_sitemaps"), (postings, "job_postings"),
    ]
    out = runs.select(F.col("id").alias("crawl_run_id"))
    for df, name in parts:
        n = df.groupBy("crawl_run_id").agg(F.count("*").alias(name))
        out = out.join(n, "crawl_run_id", "left")
    return out.na.fill(0, [name for _, name in parts])


def last_activity(urls, sitemaps, postings, run_id=None) -> DataFrame:
    """Latest activity of each run over three tables."""
    parts = [(urls, "last_fetched_at"), (sitemaps, "fetched_at"), (postings, "last_seen_at")]
    stamped = [
        of_run(df, "crawl_run_id", run_id).where(F.col("crawl_run_id").isNotNull())
        .groupBy("crawl_run_id").agg(F.max(c).alias("last_activity"))
        for df, c in parts
    ]
    return union_all(stamped).groupBy("crawl_run_id").agg(
        F.max("last_activity").alias("last_activity")
    )


def queue_stats(queue: DataFrame, as_of) -> DataFrame:
    now = F.lit(as_of).cast("timestamp")
    due = (F.col("next_run_at") <= now) & (
        F.col("locked_until").isNull() | (F.col("locked_until") < now)
    )
    return queue.agg(
        F.count_if(due).alias("due_count"),
        F.count_if(F.col("locked_until") > now).alias("locked_count"),
        F.min("next_run_at").alias("next_due_at"),
    )


def queue_errors(queue: DataFrame, limit: int) -> DataFrame:
    """Newest queue errors; a missing finish time sorts first, as in descending order."""
    rows = queue.where(F.col("last_error").isNotNull()).select(
        "company_id", "last_error", "last_finished_at", "consecutive_failures"
    )
    return take(rows, [F.desc_nulls_first("last_finished_at"), F.asc("company_id")], limit)


def url_status_counts(urls: DataFrame) -> DataFrame:
    return urls.groupBy("status").agg(F.count("*").alias("total")).orderBy("status")


def domain_source_counts(domains: DataFrame) -> DataFrame:
    """Companies by the source of their latest domain, and in all under a null source."""
    newest = latest_domain(domains.select("id", "company_id", "source", "resolved_at"))
    by_source = newest.groupBy(F.coalesce("source", F.lit("UNKNOWN")).alias("source")).agg(
        F.count("*").alias("total")
    )
    every = domains.agg(F.countDistinct("company_id").alias("total")).select(
        F.lit(None).cast("string").alias("source"), "total"
    )
    return by_source.unionByName(every)


def null_split(df: DataFrame, column: str) -> DataFrame:
    return df.agg(
        F.count_if(F.col(column).isNull()).alias(f"{column}_null"),
        F.count_if(F.col(column).isNotNull()).alias(f"{column}_non_null"),
    )


def resolution_method_counts(domains: DataFrame, source: str) -> DataFrame:
    out = domains.where(F.col("source") == source).groupBy("resolution_method").agg(
        F.count("*").alias("total")
    )
    return out.orderBy(F.desc("total"), "resolution_method")


def high_water_marks(tables: dict[str, DataFrame]) -> DataFrame:
    """Highest id per table, zero when empty."""
    return union_all([
        df.agg(F.coalesce(F.max("id"), F.lit(0)).cast("bigint").alias("max_id")).select(
            F.lit(name).alias("table_name"), "max_id"
        )
        for name, df in tables.items()
    ])


def running_with_activity(runs, activity) -> DataFrame:
    running = runs.where(F.col("status") == "RUNNING").select(
        F.col("id").alias("crawl_run_id"), "started_at", "last_heartbeat_at"
    )
    return running.join(activity, "crawl_run_id", "left")


def active_runs(runs, activity, as_of, minutes=V.RUN_ACTIVE_MINUTES) -> DataFrame:
    """Running runs whose start, heartbeat or last activity is after the cutoff."""
    cutoff = F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL '{int(minutes)}' MINUTE")
    fresh = (
        (F.col("started_at") > cutoff)
        | F.coalesce(F.col("last_activity") > cutoff, F.lit(False))
        | F.coalesce(F.col("last_heartbeat_at") > cutoff, F.lit(False))
    )
    return running_with_activity(runs, activity).where(fresh)


def stale_runs(runs, counts, as_of, minutes=V.RUN_ACTIVE_MINUTES) -> DataFrame:
    """Running runs without a fresh start or heartbeat and with no rows at all: to abort.

    The rows come back as they are to be stored, finished at ``as_of``.
    """
    now = F.lit(as_of).cast("timestamp")
    cutoff = now - F.expr(f"INTERVAL '{int(minutes)}' MINUTE")
    stale = (F.col("started_at") <= cutoff) & (
        F.col("last_heartbeat_at").isNull() | (F.col("last_heartbeat_at") <= cutoff)
    )
    total = F.col("discovered_urls") + F.col("discovered_sitemaps") + F.col("job_postings")
    out = running_with_activity(runs, counts).where(stale & (total == 0))
    return out.select(
        "crawl_run_id", "started_at", now.alias("finished_at"), F.lit("ABORTED").alias("status"),
        F.lit("aborted_on_startup_no_activity").alias("notes"),
    )


# --- listings --------------------------------------------------------------

RUN_META = ["id", "started_at", "finished_at", "status"]


def recent_runs(runs: DataFrame, limit: int | None = None) -> DataFrame:
    return take(runs.select(*RUN_META), [F.desc("started_at"), F.desc("id")], limit)


def latest_run(runs: DataFrame) -> DataFrame:
    return recent_runs(runs, 1)


def running_runs(runs: DataFrame) -> DataFrame:
    return runs.where(F.col("status") == "RUNNING").select(*RUN_META).orderBy("started_at", "id")


def run_by_id(runs: DataFrame, run_id: int) -> DataFrame:
    return runs.where(F.col("id") == run_id).select(*RUN_META)


def crawl_run_status(runs: DataFrame, run_id: int | None = None) -> DataFrame:
    return of_run(runs, "id", run_id).select(
        *RUN_META, "companies_attempted", "companies_succeeded", "companies_failed",
        "jobs_extracted_count", "last_heartbeat_at",
    )


def json_counts(c: Column) -> Column:
    """Count map from JSON text; blank or broken text is an empty map."""
    parsed = F.from_json(c, "map<string,int>")
    return F.coalesce(parsed, F.create_map().cast("map<string,int>"))


def discovery_run_status(runs: DataFrame, run_id=None, latest=False) -> DataFrame:
    """Discovery runs with their JSON count columns read as maps."""
    out = of_run(runs, "id", run_id).withColumns({
        c.removesuffix("_json"): json_counts(F.col(c))
        for c in runs.columns if c.endswith("_json")
    }).drop(*[c for c in runs.columns if c.endswith("_json")])
    return take(out, [F.desc("started_at"), F.desc("id")], 1) if latest else out


def canary_status(runs: DataFrame, run_id=None, run_type=None, latest=False) -> DataFrame:
    rows = of_run(runs, "id", run_id)
    if run_type is not None:
        rows = rows.where(F.col("type") == run_type)
    return take(rows, [F.desc("started_at"), F.desc("id")], 1) if latest else rows


def endpoints_of_company(endpoints: DataFrame, company_id: int) -> DataFrame:
    return endpoints.where(F.col("company_id") == company_id).select(
        "company_id", "ats_type", "ats_url", "discovered_from_url", "confidence", "detected_at"
    ).orderBy(F.desc("detected_at"), "ats_type", "ats_url")


def hosts_in_cooldown(states: DataFrame, as_of, limit: int | None = None) -> DataFrame:
    rows = states.where(F.col("next_allowed_at") > F.lit(as_of).cast("timestamp")).select(
        "host", "consecutive_failures", "last_error_category", "last_attempt_at", "next_allowed_at"
    )
    return take(rows, [F.asc("next_allowed_at"), F.asc("host")], limit)


def host_state(states: DataFrame, host: str) -> DataFrame:
    return states.where(F.col("host") == host.lower())


def company_state(states: DataFrame, company_id: int) -> DataFrame:
    return states.where(F.col("company_id") == company_id)


def top_n(counts: DataFrame, n: int, key: str = "key", value: str = "total") -> DataFrame:
    """Largest counts first, key ascending on equal counts."""
    return take(counts, [F.desc(value), F.asc(key)], n)


def with_company(rows: DataFrame, companies: DataFrame) -> DataFrame:
    names = companies.select(F.col("id").alias("company_id"), "ticker",
                             F.col("name").alias("company_name"))
    return rows.join(names, "company_id")


def company_results_view(results: DataFrame, companies: DataFrame, run_column: str,
                         newest: str, run_id=None, status=None, limit=None) -> DataFrame:
    """Company results of a run, newest first; all of them without a limit."""
    rows = of_run(results, run_column, run_id)
    if status is not None:
        rows = rows.where(F.col("status") == status)
    out = with_company(rows, companies)
    return take(out, [F.desc_nulls_first(newest), F.desc("id")], limit)


def overall_company_results(results, companies, run_id=None, status=None, limit=None) -> DataFrame:
    """Best row per run and company; the status filter applies after ranking."""
    def rank(column, ranks):
        out = F
        for value, place in ranks.items():
            out = out.when(F.col(column) == value, place)
        return out.otherwise(0)

    best = top_per_group(
        of_run(results, "crawl_run_id", run_id),
        ["crawl_run_id", "company_id"],
        [rank("status", V.STATUS_RANK).desc(), rank("stage", V.STAGE_RANK).desc(),
         F.desc_nulls_last("started_at"), F.desc("id")],
    )
    return company_results_view(best, companies, "crawl_run_id", "started_at", None, status, limit)


def recent_discovery_failures(failures, companies, limit: int) -> DataFrame:
    newest = take(failures, [F.desc("observed_at"), F.desc("id")], limit)
    return take(with_company(newest, companies), [F.desc("observed_at"), F.desc("id")], limit).select(
        "ticker", "company_name", "candidate_url", "detail", "observed_at", "reason_code"
    )


def recent_run_failures(results, companies, run_column, at, run_id, limit=None,
                        nulls_last=False) -> DataFrame:
    """Failed company results of a run, newest first; all of them without a limit."""
    failed = of_run(results, run_column, run_id).where(F.col("status") == "FAILED")
    newest = F.desc_nulls_last(at) if nulls_last else F.desc_nulls_first(at)
    rows = with_company(failed, companies)
    return take(rows, [newest, F.desc("id")], limit).select(
        "ticker", "company_name", "stage", "reason_code", "http_status", "error_detail", at
    )


def recent_api_failures(urls, companies, limit: int) -> DataFrame:
    failed = urls.where(
        (F.col("url_type") == "ATS_API") & (F.col("fetch_status") != "ats_fetch_success")
    )
    rows = with_company(failed, companies)
    order = [F.desc_nulls_first("last_fetched_at"), F.desc("id")]
    return take(rows, order, limit).select(
        "ticker", F.col("adapter").alias("ats_type"), "url", "fetch_status", "last_fetched_at"
    )


# --- frontier --------------------------------------------------------------

def _due(urls: DataFrame, kind: str, now: Column) -> DataFrame:
    return urls.where(
        (F.col("url_kind") == kind) & (F.col("status") == "QUEUED")
        & (F.col("next_fetch_at") <= now)
        & (F.col("locked_until").isNull() | (F.col("locked_until") < now))
    )


def eligible_urls(urls, hosts, kind, as_of, limit=None) -> DataFrame:
    """Due, unlocked URLs whose host is idle and not cooling, best first."""
    now = F.lit(as_of).cast("timestamp")
    idle = hosts.where(
        (F.col("next_allowed_at").isNull() | (F.col("next_allowed_at") <= now))
        & (F.col("inflight_count") < 1)
    ).select("host")
    rows = _due(urls, kind, now).join(idle, "host", "left_semi").select(
        "id", "url", "host", "canonical_url", "url_kind", "priority", "next_fetch_at", "status"
    )
    return take(rows, [F.desc("priority"), F.asc("next_fetch_at"), F.asc("id")], limit)


def blocked_url_count(urls, hosts, kind, as_of) -> DataFrame:
    now = F.lit(as_of).cast("timestamp")
    cooling = hosts.where(F.col("next_allowed_at") > now).select("host")
    return _due(urls, kind, now).join(cooling, "host", "left_semi").agg(F.count("*").alias("total"))
