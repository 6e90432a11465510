"""Composite reports, file sources and streams, each with its oracle."""

from pyspark.sql import functions as F

from rolecall.checks.listings import WORDS
from rolecall.checks.lookups import AS_OF, BEST, ELIGIBLE
from rolecall.checks.merging import COMPANY_BATCH, POSTING_BATCH
from rolecall.checks.registry import ORACLES, BUILDERS, check
from rolecall.checks.model import VIEWS
from rolecall.checks.state_folds import OUTCOMES, backoff_sql
from rolecall.operators.merges import merge_companies, merge_postings
from rolecall.operators.search import store_tokens, token_search
from rolecall.plans import reports as C
from rolecall.session import new_folder
from rolecall.sources import files as S
from rolecall.sources.keyed import KeyedTable
from rolecall.streaming.processors import backoff_states, cooldown_states, discovery_states, keep_states
from rolecall.streaming.tables import backoff_stream, posting_stream

END = "2024-01-31 00:00:00"


class Named(dict):
    """Tables of a model by name, made when asked for."""

    def __init__(self, model):
        super().__init__()
        self.model = model

    def __missing__(self, name):
        return getattr(self.model, name)


@check("status_recent_run", """
WITH r AS (SELECT * FROM $crawl_runs ORDER BY started_at DESC, id DESC LIMIT 1)
SELECT r.id AS crawl_run_id, r.started_at, r.finished_at, r.status, (SELECT count(*) FROM $job_postings p, r r2 WHERE p.crawl_run_id = r2.id OR (p.crawl_run_id IS NULL AND p.last_seen_at >= r2.started_at
    AND p.last_seen_at <= coalesce(r2.finished_at, TIMESTAMP '2024-01-31 00:00:00'))) AS jobs_extracted,
  CAST(floor((epoch_us(coalesce(r.finished_at, TIMESTAMP '2024-01-31 00:00:00')) - epoch_us(r.started_at)) / 1000000.0) AS BIGINT) AS seconds_running,
  greatest((SELECT max(last_fetched_at) FROM $discovered_urls u, r r3 WHERE u.crawl_run_id = r3.id), (SELECT max(fetched_at) FROM $discovered_sitemaps s, r r4 WHERE s.crawl_run_id = r4.id),
    (SELECT max(last_seen_at) FROM $job_postings p, r r5 WHERE p.crawl_run_id = r5.id)) AS last_activity FROM r""")
def _(m):
    return C.service_status(Named(m), END)["recent_run"]


@check("status_top_errors", """
WITH r AS (SELECT id FROM $crawl_runs ORDER BY started_at DESC, id DESC LIMIT 1)
SELECT fetch_status, count(*) AS total FROM $discovered_urls WHERE crawl_run_id = (SELECT id FROM r) AND fetch_status IN ('http_404', 'http_503', 'blocked_by_robots', 'timeout')
GROUP BY 1 ORDER BY total DESC, fetch_status LIMIT 5""")
def _(m):
    return C.service_status(Named(m), END)["top_errors"]


@check("coverage_counts", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS total FROM ${t}" for t in C.COVERED))
def _(m):
    return C.coverage_diagnostics(Named(m))["counts"]


@check("failure_diagnostics_types", """
WITH c AS (SELECT reason_code, count(DISTINCT company_id) AS n FROM $careers_discovery_failures GROUP BY 1)
SELECT CASE WHEN reason_code LIKE '%host_cooldown%' THEN 'host_cooldown' WHEN reason_code LIKE '%robot%' THEN 'robots' WHEN reason_code LIKE '%time_budget%' THEN 'timeout'
  WHEN reason_code LIKE '%sitemap_no_urls%' THEN 'sitemap_not_found' WHEN reason_code LIKE '%ats_detected_no_endpoint%' THEN 'ats_not_found' ELSE 'other' END AS failure_type, CAST(sum(n) AS BIGINT) AS total FROM c GROUP BY 1""")
def _(m):
    return C.discovery_failure_diagnostics(Named(m))["top_types"]


@check("failure_diagnostics_reasons", """
SELECT reason_code AS reason, count(DISTINCT company_id) AS total FROM $careers_discovery_failures GROUP BY 1 ORDER BY total DESC, reason LIMIT 10""")
def _(m):
    return C.discovery_failure_diagnostics(Named(m))["top_reasons"]


@check("attempt_diagnostics", """
SELECT fetch_status, count(*) AS total FROM $discovered_urls WHERE url_type = 'ATS_API' AND fetch_status IS NOT NULL GROUP BY 1""")
def _(m):
    return C.attempt_diagnostics(Named(m))["by_status"]


@check("crawl_run_diagnostics", """
WITH r AS (SELECT id, started_at, finished_at, status FROM $crawl_runs ORDER BY started_at DESC, id DESC LIMIT 10)
SELECT r.id AS crawl_run_id, r.started_at, r.finished_at, r.status, (SELECT count(*) FROM $discovered_urls u WHERE u.crawl_run_id = r.id) AS discovered_urls,
  (SELECT count(*) FROM $discovered_sitemaps s WHERE s.crawl_run_id = r.id) AS discovered_sitemaps, (SELECT count(*) FROM $job_postings p WHERE p.crawl_run_id = r.id) AS job_postings FROM r""")
def _(m):
    return C.crawl_run_diagnostics(Named(m))


@check("crawl_run_report_status", """
SELECT r.id, r.started_at, r.finished_at, r.status, r.companies_attempted, r.companies_succeeded, r.companies_failed, r.jobs_extracted_count, r.last_heartbeat_at,
  greatest((SELECT max(last_fetched_at) FROM $discovered_urls u WHERE u.crawl_run_id = 20240112), (SELECT max(fetched_at) FROM $discovered_sitemaps s WHERE s.crawl_run_id = 20240112),
    (SELECT max(last_seen_at) FROM $job_postings p WHERE p.crawl_run_id = 20240112)) AS last_activity FROM $crawl_runs r WHERE r.id = 20240112""")
def _(m):
    return C.crawl_run_report(Named(m), 20240112)["status"]


@check("discovery_run_report_funnel", """
SELECT count(*) FILTER (WHERE careers_url_found) AS careers_url_found_count, count(*) FILTER (WHERE vendor_detected) AS vendor_detected_count,
  count(*) FILTER (WHERE endpoint_extracted) AS endpoint_extracted_count FROM $careers_discovery_company_results WHERE discovery_run_id = 20240112""")
def _(m):
    return C.discovery_run_report(Named(m), 20240112)["funnel"]


@check("missing_domain_reasons", """
SELECT coalesce(upper(domain_resolution_status), 'NOT_ATTEMPTED') AS reason, count(*) AS total FROM $companies WHERE id NOT IN (SELECT company_id FROM $company_domains) GROUP BY 1""")
def _(m):
    return C.missing_domain_diagnostics(Named(m), AS_OF)["by_reason"]


@check("missing_domain_eligible", f"""
SELECT count(*) AS total FROM $companies c, (SELECT count(*) FROM $company_domains) one WHERE {ELIGIBLE}""")
def _(m):
    return C.missing_domain_diagnostics(Named(m), AS_OF)["eligible"]


@check("crawl_target_preview", f"""
WITH {BEST}, e AS (SELECT company_id, max(detected_at) AS d FROM $ats_endpoints GROUP BY 1)
SELECT t.* FROM targets t JOIN e ON e.company_id = t.company_id ORDER BY e.d DESC, t.ticker LIMIT 300""")
def _(m):
    return C.crawl_target_preview(Named(m), 300, since="2001-01-01 00:00:00")


@check("canary_errors_by_step", """
SELECT 'crawl' AS step, reason_code AS key, count(*) AS total FROM $crawl_run_company_results WHERE crawl_run_id = 20240112 AND status = 'FAILED' AND reason_code IS NOT NULL GROUP BY 2
UNION ALL SELECT 'domain_resolution', lower(domain_resolution_status), count(*) FROM $companies WHERE domain_resolution_status IS NOT NULL GROUP BY 2
UNION ALL SELECT 'discovery', reason_code, count(DISTINCT company_id) FROM $careers_discovery_failures GROUP BY 2""")
def _(m):
    domain = m.companies.where("domain_resolution_status IS NOT NULL").groupBy(
        F.lower("domain_resolution_status").alias("key")).agg(F.count("*").alias("total"))
    found = m.careers_discovery_failures.groupBy(F.col("reason_code").alias("key")).agg(
        F.countDistinct("company_id").alias("total"))
    return C.canary_report(Named(m), 20240112, domain, found)["errors_by_step"]


@check("domain_assessment", """
SELECT r.id AS run_id, coalesce(n, 0) > 0 AS likely_domain_limited, coalesce(n, 0) AS no_domain_reason_count, r.processed_count / 50.0e0 AS processed_fill_rate
FROM $careers_discovery_runs r LEFT JOIN (SELECT discovery_run_id, count(*) AS n FROM $careers_discovery_company_results WHERE status = 'FAILED' AND reason_code = 'NO_DOMAIN' GROUP BY 1) f ON f.discovery_run_id = r.id""")
def _(m):
    return C.domain_assessment(Named(m), 50, 4, 9)["bottleneck"]


@check("seed_run_report", """
SELECT status, count(*) AS total FROM $crawl_urls GROUP BY 1""")
def _(m):
    return C.seed_run_report(Named(m))["queue"]


@check("company_postings_report", """
WITH w AS (SELECT started_at, finished_at FROM $crawl_runs WHERE id = 20240112)
SELECT company_id, count(*) FILTER (WHERE crawl_run_id = 20240112 AND first_seen_at >= w.started_at AND first_seen_at <= w.finished_at) AS new_count,
  count(*) FILTER (WHERE crawl_run_id = 20240111 AND NOT is_active) AS removed_count, CAST(0 AS BIGINT) AS updated_count
FROM $job_postings, w WHERE company_id = 7 AND crawl_run_id IN (20240111, 20240112) GROUP BY company_id""")
def _(m):
    return C.company_postings_report(Named(m), 7, 20240111, 20240112, END)["counts"]


# --- files: written from the tables, then read back ------------------------


def stored(m, df, name, fmt="csv"):
    path = new_folder(m.spark, name)
    writer = df.write.option("header", True).option("escape", '"')
    (writer.csv if fmt == "csv" else writer.json if fmt == "json" else writer.text)(path)
    return path


COMPANY_FILE = """
SELECT CASE WHEN c_custkey % 9 = 0 THEN '' ELSE concat(' t', CAST(c_custkey AS STRING), '[a] ') END AS `Symbol`, concat('Name, "', c_name, '"') AS `SECURITY`,
  CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS `GICS Sector`, 'x' AS other FROM $customer"""


@check("companies_csv", """
SELECT concat('T', CAST(c_custkey AS VARCHAR)) AS ticker, concat('Name, "', c_name, '"') AS name, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS sector
FROM $customer WHERE c_custkey % 9 <> 0""")
def _(m):
    return S.read_companies_csv(m.spark, stored(m, m.sql(COMPANY_FILE), "companies"))[0].drop("ord")


@check("companies_csv_errors", "SELECT concat('Name, \"', c_name, '\"') AS name, 'missing required fields' AS error FROM $customer WHERE c_custkey % 9 = 0")
def _(m):
    return S.read_companies_csv(m.spark, stored(m, m.sql(COMPANY_FILE), "companies"))[1].select("name", "error")


SEED_FILE = """
SELECT concat('t', lpad(CAST(c_custkey * 2 AS STRING), 9, '0')) AS ticker, c_name AS company_name, concat('SEED', CAST(c_custkey AS STRING), '.Example.com') AS domain,
  CASE WHEN c_custkey % 3 = 0 THEN 'https://hint.example.com/' END AS optional_careers_hint_url FROM $customer"""


@check("domain_seed_companies", """
SELECT concat('T', lpad(CAST(c_custkey * 2 AS VARCHAR), 9, '0')) AS ticker, c_name AS name FROM $customer
WHERE concat('T', lpad(CAST(c_custkey * 2 AS VARCHAR), 9, '0')) NOT IN (SELECT ticker FROM $companies)""")
def _(m):
    seeds, _ = S.read_domain_seeds_csv(m.spark, stored(m, m.sql(SEED_FILE), "seeds"))
    return S.seed_companies(seeds, m.companies)


@check("apply_domain_seeds", """
SELECT * FROM $company_domains UNION ALL
SELECT NULL, c.id, concat('seed', CAST(s.c_custkey AS VARCHAR), '.example.com'), CASE WHEN s.c_custkey % 3 = 0 THEN 'https://hint.example.com/' END, 'MANUAL', 1.0e0, TIMESTAMP '2024-02-01 00:00:00', NULL, NULL
FROM $customer s JOIN $companies c ON c.ticker = concat('T', lpad(CAST(s.c_custkey * 2 AS VARCHAR), 9, '0'))""")
def _(m):
    seeds, _ = S.read_domain_seeds_csv(m.spark, stored(m, m.sql(SEED_FILE), "seeds"))
    return S.apply_domain_seeds(seeds, m.companies, m.company_domains, "2024-02-01 00:00:00")


TICKER_FILE = """
SELECT concat('{"k', CAST(p_partkey AS STRING), '":{"ticker":', CASE WHEN p_partkey % 4 = 0 THEN 'null' ELSE concat('"x', CAST(p_partkey AS STRING), '"') END, ',"title":"Part ', CAST(p_partkey AS STRING), '","cik_str":', CAST(p_partkey AS STRING),
  '},"e', CAST(p_partkey AS STRING), '":{"ticker":"","title":" ","cik_str":"0"}}') AS value FROM $part"""


@check("ticker_records", f"""
WITH RECURSIVE d AS (SELECT p_partkey, concat('PART', CAST(p_partkey AS VARCHAR)) AS plain FROM $part),
 h(p_partkey, plain, i, code) AS (SELECT p_partkey, plain, 0, CAST(0 AS BIGINT) FROM d UNION ALL SELECT p_partkey, plain, i + 1, (code * 31 + ascii(substr(plain, i + 1, 1))) % 4294967296 FROM h WHERE i < length(plain))
SELECT 0 AS pos, concat('k', CAST(p_partkey AS VARCHAR)) AS key, CASE WHEN p_partkey % 4 = 0 THEN substr(concat('N', substr(plain, 1, 7), lpad(upper(to_hex(code)), 8, '0')), 1, 16) ELSE concat('X', CAST(p_partkey AS VARCHAR)) END AS ticker,
  concat('Part ', CAST(p_partkey AS VARCHAR)) AS name, lpad(CAST(p_partkey AS VARCHAR), 10, '0') AS cik FROM h WHERE i = length(plain)""")
def _(m):
    path = stored(m, m.sql(TICKER_FILE), "tickers", "text")
    return S.ticker_records(m.spark.read.text(path))[0]


@check("run_artifacts", """
SELECT min(event_id) AS domains_before, max(event_id) AS domains_after, count(*) + 1 AS selection_eligible_count, CAST(0 AS BIGINT) AS selection_returned_count, count(DISTINCT user_id) AS companies_attempted_count,
  CAST(0 AS BIGINT) AS vendor_detected_count, CAST(2 AS BIGINT) AS endpoint_extracted_count, count(*) FILTER (WHERE event_type = 'error') AS robots FROM $events GROUP BY CAST(ts AS DATE)""")
def _(m):
    lines = m.sql("""SELECT concat('{"pipeline":{"domain_counts_before":{"companies_with_domain_count":', CAST(min(event_id) AS STRING), '},"domain_counts_after":{"companies_with_domain_count":', CAST(max(event_id) AS STRING),
      '},"ats_selection_metrics":{"vendor_probe":{"selectionEligibleCount":', CAST(count(*) AS STRING), ',"companiesAttemptedCount":', CAST(count(DISTINCT user_id) AS STRING), '},"full":{"selectionEligibleCount":1,"endpointExtractedCount":2}}},',
      '"failureTypeBreakdown":{"robots":', CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS STRING), '}}') AS value FROM $events GROUP BY CAST(ts AS DATE)""")
    path = new_folder(m.spark, "artifacts")
    lines.repartition(30, "value").write.option("maxRecordsPerFile", 1).text(path)
    cycles = S.read_run_artifacts(m.spark, path)
    return cycles.withColumn("robots", F.col("failure_types")["robots"]).drop("cycle", "failure_types", "failure_reasons")


@check("metric_snapshot_file", ORACLES["metric_snapshot"])
def _(m):
    path = new_folder(m.spark, "snapshot")
    S.write_metric_snapshot(BUILDERS["metric_snapshot"](m), path)
    return S.read_metric_snapshots(m.spark, path).drop("snapshot")


@check("report_file", "SELECT ats_type, count(*) AS total FROM $ats_endpoints GROUP BY 1")
def _(m):
    path = new_folder(m.spark, "report")
    S.write_report(C.coverage_diagnostics(Named(m))["by_type"], path)
    return m.spark.read.schema("ats_type string, total bigint").json(path)


@check("stored_table", "SELECT * FROM $ats_endpoints")
def _(m):
    folder = new_folder(m.spark, "tables")
    S.write_table(m.ats_endpoints, folder, "ats_endpoints", ["ats_type"])
    back = S.read_table(m.spark, folder, "ats_endpoints")
    return back.select(*m.ats_endpoints.columns)


# --- streams: the stored files as a stream, run to the end -----------------


def stream_of(m, view, sql):
    """``sql`` with one given table read as a stream."""
    from rolecall.checks.model import BASE, compose
    name = m.prefix + view + "_stream"
    pattern = f"{m.folder}/[{view[0]}]{view[1:]}.parquet"  # a stream takes folders or patterns
    m.spark.readStream.schema(BASE[view]).parquet(pattern).createOrReplaceTempView(name)
    return m.spark.sql(compose(sql, lambda t: name if t == view else m._given(t)))


def kept(m, name, keys, rows):
    """The rows as a new keyed table in the shared folder."""
    return KeyedTable(new_folder(m.spark, name), tuple(keys), rows.schema, 16).create(rows)


@check("posting_stream", ORACLES["merge_postings"])
def _(m):
    table = kept(m, "postings", ["company_id"], m.job_postings)
    posting_stream(stream_of(m, "lineitem", POSTING_BATCH), table, new_folder(m.spark, "offsets")).awaitTermination()
    return table.read(m.spark)


NO_HOSTS = "SELECT host, 0 AS backoff_state, CAST(NULL AS STRING) AS last_status_bucket, CAST(NULL AS TIMESTAMP) AS next_allowed_at FROM $crawl_hosts WHERE host = ''"


@check("backoff_stream", backoff_sql("0"))
def _(m):
    table = kept(m, "hosts", ["host"], m.sql(NO_HOSTS))
    backoff_stream(stream_of(m, "events", VIEWS["crawl_url_attempts"]), table, new_folder(m.spark, "offsets")).awaitTermination()
    return table.read(m.spark)


def kept_states(m, name, key, states, like):
    """States of a stream, kept in a table that starts empty."""
    table = kept(m, name, [key], like.limit(0))
    keep_states(states, table, new_folder(m.spark, "offsets")).awaitTermination()
    return table.read(m.spark)


@check("backoff_processor", ORACLES["frontier_backoff"])
def _(m):
    attempts = stream_of(m, "events", VIEWS["crawl_url_attempts"])
    return kept_states(m, "hosts", "host", backoff_states(attempts), BUILDERS["frontier_backoff"](m))


@check("cooldown_processor", ORACLES["host_cooldown"])
def _(m):
    attempts = stream_of(m, "events", VIEWS["crawl_url_attempts"])
    return kept_states(m, "hosts", "host", cooldown_states(attempts), BUILDERS["host_cooldown"](m))


@check("discovery_processor", ORACLES["discovery_cooldown"])
def _(m):
    outcomes = stream_of(m, "events", OUTCOMES)
    return kept_states(m, "companies", "company_id", discovery_states(outcomes), BUILDERS["discovery_cooldown"](m))


# --- merges that rewrite the touched parts of a stored table ---------------


@check("keyed_merge_companies", ORACLES["merge_companies"])
def _(m):
    table = kept(m, "companies", ["ticker"], m.companies)
    table.merge(m.sql(COMPANY_BATCH), merge_companies)
    return table.read(m.spark)


@check("keyed_merge_postings", ORACLES["merge_postings"])
def _(m):
    table = kept(m, "postings", ["company_id"], m.job_postings)
    table.merge(m.sql(POSTING_BATCH), merge_postings)
    return table.read(m.spark)


# --- word search through a stored table of tokens --------------------------

STEM_SEARCH = 'engineering "building the red" -austin OR "shipped it" blue -"new york"'


@check("text_match_stems", f"""
SELECT id FROM (SELECT id, {WORDS} AS words FROM $job_postings) x
WHERE (words LIKE '% engineer %' AND words LIKE '% build the red %' AND words NOT LIKE '% austin %')
   OR (words LIKE '% ship it %' AND words LIKE '% blue %' AND words NOT LIKE '% new york %')""")
def _(m):
    tokens = store_tokens(m.job_postings, new_folder(m.spark, "tokens"), 64)
    return token_search(m.job_postings, tokens, STEM_SEARCH).select("id")
