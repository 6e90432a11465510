"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the data folder (default /root/testdata/sf0.1), BENCH_CPUS the
local cores, BENCH_ALL=1 times every registered query.
"""

import json
import os
import pathlib
import sys
import time

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent))

from rolecall.checks import catalog  # noqa: E402
from rolecall.session import build_session  # noqa: E402

HEADLINE = [
    # read queries
    "postings_page", "newest_postings", "new_postings_since", "closed_postings_since",
    "filtered_posting_count", "posting_view", "text_match_words", "run_delta_counts",
    # latest row per key and selections
    "best_domain", "latest_endpoint_all_ties", "latest_domain", "domain_source_counts",
    "companies_missing_domain", "companies_without_endpoint", "crawl_targets_with_endpoint",
    "missing_domain_cohort", "cohort_domain_state",
    # funnels and diagnostics
    "source_funnel_crosstab", "source_funnel_summary", "failures_in_run_window", "funnel_samples",
    "coverage_counts", "discovery_failures_by_reason", "run_activity_counts", "jobs_for_run",
    "overall_company_results", "metric_snapshot",
    # merges
    "merge_companies", "merge_domains", "merge_postings", "close_out_postings",
    # logs, URLs and documents
    "frontier_backoff", "host_cooldown", "budget_breach", "canonicalize_urls",
    "normalize_endpoints", "vendor_endpoints", "jsonld_postings", "greenhouse_postings",
    "robots_decisions",
]


def timed(build) -> float:
    started = time.perf_counter()
    build().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = build_session(f"local[{cpus}]", shuffle_partitions=int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    names = list(catalog.BUILDERS) if os.environ.get("BENCH_ALL") else HEADLINE
    catalog.run("best_domain", spark, folder).write.format("noop").mode("overwrite").save()  # warm up
    seconds = {}
    for name in names:
        seconds[name] = round(timed(lambda: catalog.run(name, spark, folder)), 3)
        print(f"{seconds[name]:8.3f}  {name}", file=sys.stderr, flush=True)
    sf = pathlib.Path(folder).name.removeprefix("sf")
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
