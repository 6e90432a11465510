"""One row per key: the winners every lookup joins through.

All use a ranking window cut at a small rank. Spark turns that cut into a limit
per key before the shuffle, so a key that holds a third of all rows still sends
only a few rows per input task.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


LIMIT_BEFORE_SHUFFLE = 1000  # Spark's default spark.sql.optimizer.windowGroupLimitThreshold
SALTS = 64


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int = 1,
                  ties: bool = False) -> DataFrame:
    """First ``n`` rows of each key; ``ties`` keeps rows equal to the last kept one.

    Past the size that Spark limits before the shuffle, each key is first cut in
    salted parts, so that one task meets at most ``SALTS * n`` rows of a key.
    """
    rows = df
    if n > LIMIT_BEFORE_SHUFFLE and not ties:
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(SALTS)))
        rows = _ranked(salted, [*keys, "_salt"], order, n, False).drop("_salt")
    return _ranked(rows, keys, order, n, ties)


def _ranked(df: DataFrame, keys: list[str], order: list[Column], n: int, ties: bool) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    rank = F.rank() if ties else F.row_number()
    return df.withColumn("_rank", rank.over(w)).where(F.col("_rank") <= n).drop("_rank")


def dedupe_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First occurrence of each key wins."""
    return top_per_group(df, keys, order)


def best_domain_rows(domains: DataFrame) -> DataFrame:
    """Per company: confidence desc, null resolved_at last, resolved_at desc, id desc."""
    return top_per_group(
        domains,
        ["company_id"],
        [F.desc("confidence"), F.desc_nulls_last("resolved_at"), F.desc("id")],
    )


def best_domain(companies: DataFrame, domains: DataFrame) -> DataFrame:
    """Companies that have a domain, with the best one."""
    best = best_domain_rows(
        domains.select("id", "company_id", "domain", "careers_hint_url", "confidence", "resolved_at")
    ).select("company_id", "domain", "careers_hint_url")
    return companies.select(
        F.col("id").alias("company_id"), "ticker", "name", "sector"
    ).join(best, "company_id")


def latest_endpoint(endpoints: DataFrame, ties: str = "one") -> DataFrame:
    """Rows at the latest detected_at of each company.

    ``all`` keeps every tied row; ``one`` keeps the highest id of them.
    """
    if ties == "all":
        return top_per_group(endpoints, ["company_id"], [F.desc("detected_at")], ties=True)
    if ties == "one":
        return top_per_group(endpoints, ["company_id"], [F.desc("detected_at"), F.desc("id")])
    raise ValueError("ties is 'all' or 'one'")


def latest_domain(domains: DataFrame) -> DataFrame:
    """Per company: resolved_at desc with nulls last, then id desc; confidence plays no part."""
    return top_per_group(
        domains, ["company_id"], [F.desc_nulls_last("resolved_at"), F.desc("id")]
    )
