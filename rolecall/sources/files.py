"""Readers and writers: company files, stored tables, run artefacts, metric snapshots, reports."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolecall.functions.text import blank_to_null
from rolecall.operators.merges import ORD, merge_companies, merge_domains
from rolecall.operators.normalize import clean_cik, clean_text, synthetic_ticker
from rolecall.operators.targets import take

# fixed values: accepted column names of company files, the first one present wins
TICKER_NAMES = ["ticker", "symbol"]
NAME_NAMES = ["company_name", "security", "name"]
SECTOR_NAMES = ["sector", "gics sector"]
SEED_COLUMNS = ["ticker", "company_name", "domain", "optional_careers_hint_url"]

SNAPSHOT_SCHEMA = "metric string, dim1 string, dim2 string, value bigint"


def _read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV rows as text, with their place in the file as ``ord``."""
    rows = (
        spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True)
        .option("ignoreTrailingWhiteSpace", True).option("multiLine", True)
        .option("escape", '"').csv(path)
    )
    place = F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"))
    return rows.withColumn(ORD, place)


def _aliased(rows: DataFrame, names: list[str]) -> Column:
    """First non-empty text among the columns with one of the names, whatever their case."""
    found = [
        blank_to_null(F.col(f"`{c}`")) for n in names for c in rows.columns if c.strip().lower() == n
    ]
    return found[0] if found else F.lit(None).cast("string")


def read_companies_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Company rows of a CSV file, and the rows that lack a ticker or a name."""
    raw = _read_csv(spark, path)
    rows = raw.select(
        ORD, F.upper(clean_text(_aliased(raw, TICKER_NAMES))).alias("ticker"),
        clean_text(_aliased(raw, NAME_NAMES)).alias("name"),
        clean_text(_aliased(raw, SECTOR_NAMES)).alias("sector"))
    ok = F.col("ticker").isNotNull() & F.col("name").isNotNull()
    errors = rows.where(~ok).withColumn("error", F.lit("missing required fields"))
    return rows.where(ok), errors


def read_domain_seeds_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Domain seeds of a CSV file, and the rows that lack a ticker or a domain."""
    raw = _read_csv(spark, path)
    ticker, name, domain, hint = [clean_text(_aliased(raw, [c])) for c in SEED_COLUMNS]
    rows = raw.select(
        ORD, F.upper(ticker).alias("ticker"), name.alias("company_name"),
        F.lower(domain).alias("domain"), hint.alias("careers_hint_url"))
    ok = F.col("ticker").isNotNull() & F.col("domain").isNotNull()
    errors = rows.where(~ok).withColumn("error", F.lit("missing required fields"))
    return rows.where(ok), errors


def seed_companies(seeds: DataFrame, companies: DataFrame) -> DataFrame:
    """Companies that seeds name and the table lacks, one row per ticker."""
    unknown = seeds.join(companies.select("ticker"), "ticker", "left_anti")
    name = F.min_by(F.coalesce("company_name", F.col("ticker")), ORD)
    return unknown.groupBy("ticker").agg(name.alias("name"))


def apply_domain_seeds(seeds: DataFrame, companies: DataFrame, domains: DataFrame, as_of) -> DataFrame:
    """Domain table with the seeds merged in as MANUAL rows of full confidence.

    The companies of all seeds must be in ``companies`` (see ``seed_companies``).
    """
    ids = companies.select(F.col("id").alias("company_id"), "ticker")
    batch = seeds.join(ids, "ticker").select(
        ORD, "company_id", "domain", "careers_hint_url", F.lit("MANUAL").alias("source"),
        F.lit(1.0).alias("confidence"), F.lit(as_of).cast("timestamp").alias("resolved_at"),
        F.lit(None).cast("string").alias("resolution_method"),
        F.lit(None).cast("string").alias("wikidata_qid"), F.lit(None).cast("bigint").alias("id"))
    return merge_domains(domains, batch)


TICKER_RECORD = "map<string,struct<ticker:string,title:string,cik_str:string>>"


def ticker_records(texts: DataFrame, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Companies in JSON objects whose values are records, and the records left out.

    ``texts`` has ``value``, one whole object per row. A record without ticker
    gets one made from its name. The order of an object matters only for ``limit``.
    """
    rows = texts.select(F.posexplode(F.from_json("value", TICKER_RECORD)).alias("pos", "key", "r"))
    name = clean_text(F.col("r.title"))
    rows = rows.select(
        "pos", "key", F.coalesce(F.upper(clean_text(F.col("r.ticker"))), synthetic_ticker(name)).alias("ticker"),
        name.alias("name"), clean_cik(F.col("r.cik_str")).alias("cik"))
    ok = F.col("ticker").isNotNull() & F.col("name").isNotNull()
    return take(rows.where(ok), [F.asc("pos"), F.asc("key"), F.asc("ticker"), F.asc("name")], limit), rows.where(~ok)


def read_ticker_records(spark: SparkSession, path: str, limit: int | None = None):
    return ticker_records(spark.read.text(path, wholetext=True), limit)


def ingest_companies(companies: DataFrame, rows: DataFrame) -> DataFrame:
    """Company table with cleaned rows merged in by ticker."""
    missing = [c for c in ("id", "sector", "wikipedia_title", "cik") if c not in rows.columns]
    types = companies.schema
    return merge_companies(companies, rows.withColumns(
        {c: F.lit(None).cast(types[c].dataType) for c in missing}))


# --- stored tables ---------------------------------------------------------


def read_table(spark: SparkSession, folder: str, name: str, schema: str | None = None) -> DataFrame:
    """A stored table; with a schema no file is opened to find one."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(f"{folder.rstrip('/')}/{name}")


def read_jdbc_table(spark: SparkSession, url: str, name: str, column: str, lower, upper,
                    partitions: int, properties: dict | None = None) -> DataFrame:
    """A table of a relational store, read in parallel by ranges of a numeric or time column."""
    return spark.read.jdbc(url, name, column=column, lowerBound=lower, upperBound=upper,
                           numPartitions=partitions, properties=properties or {})


def write_table(df: DataFrame, folder: str, name: str, partition_by: list[str] | None = None) -> None:
    """Write a new table version; an existing one is never overwritten."""
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(f"{folder.rstrip('/')}/{name}")


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int) -> None:
    """Save as a table bucketed by a key, so that later joins and merges on it need no shuffle."""
    df.write.mode("errorifexists").bucketBy(buckets, key).sortBy(key).saveAsTable(table)


# --- run artefacts, snapshots, reports -------------------------------------

ARTIFACT_SCHEMA = (
    "pipeline struct<"
    "domain_counts_before:struct<companies_with_domain_count:bigint>,"
    "domain_counts_after:struct<companies_with_domain_count:bigint>,"
    "ats_selection_metrics:struct<vendor_probe:{0},full:{0}>>,"
    "failureTypeBreakdown map<string,bigint>, countsByReason map<string,bigint>"
).format(
    "struct<selectionEligibleCount:bigint,selectionReturnedCount:bigint,"
    "companiesAttemptedCount:bigint,vendorDetectedCount:bigint,endpointExtractedCount:bigint>"
)
SELECTION = {
    "selection_eligible_count": "selectionEligibleCount",
    "selection_returned_count": "selectionReturnedCount",
    "companies_attempted_count": "companiesAttemptedCount",
    "vendor_detected_count": "vendorDetectedCount",
    "endpoint_extracted_count": "endpointExtractedCount",
}


def read_run_artifacts(spark: SparkSession, pattern: str) -> DataFrame:
    """JSON artefacts of many run folders, one row per file, as cycle metrics."""
    raw = spark.read.schema(ARTIFACT_SCHEMA).option("multiLine", True).json(pattern)
    zero = F.lit(0).cast("bigint")
    probe, full = "pipeline.ats_selection_metrics.vendor_probe", "pipeline.ats_selection_metrics.full"
    before = F.coalesce("pipeline.domain_counts_before.companies_with_domain_count", zero)
    after = F.coalesce("pipeline.domain_counts_after.companies_with_domain_count", zero)
    empty = F.create_map().cast("map<string,bigint>")
    return raw.select(
        F.input_file_name().alias("cycle"), before.alias("domains_before"), after.alias("domains_after"),
        *[(F.coalesce(f"{probe}.{c}", zero) + F.coalesce(f"{full}.{c}", zero)).alias(n)
          for n, c in SELECTION.items()],
        F.coalesce("failureTypeBreakdown", empty).alias("failure_types"),
        F.coalesce("countsByReason", empty).alias("failure_reasons"))


def read_metric_snapshots(spark: SparkSession, pattern: str) -> DataFrame:
    """Metric rows of snapshot files, with the file each came from; empty dimensions are ''."""
    rows = spark.read.schema(SNAPSHOT_SCHEMA).option("header", True).csv(pattern)
    return rows.na.fill("", ["dim1", "dim2"]).withColumn("snapshot", F.input_file_name())


def write_metric_snapshot(metrics: DataFrame, path: str) -> None:
    """Metric rows as CSV in name order; a snapshot is a few hundred rows."""
    rows = metrics.select("metric", "dim1", "dim2", "value").orderBy("metric", "dim1", "dim2")
    rows.write.mode("errorifexists").option("header", True).option("emptyValue", "").csv(path)


def write_report(report: DataFrame, path: str) -> None:
    """A roll-up as JSON lines."""
    report.write.mode("errorifexists").json(path)
