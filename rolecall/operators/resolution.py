"""Domain resolution as a cascade over stored matches: title, CIK, infobox, heuristic."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolecall.functions import fixed_values as V
from rolecall.functions.text import is_blank
from rolecall.functions.urls import registrable_host
from rolecall.operators.latest import dedupe_first
from rolecall.operators.normalize import cik_variants, heuristic_method, name_signals, title_variants

TITLE, CIK, INFOBOX, HEURISTIC = "WIKIPEDIA_TITLE", "CIK", "WIKIPEDIA_INFOBOX", "HEURISTIC_NAME"


def _first_match(companies: DataFrame, variants: Column, matches: DataFrame, prefix: str) -> DataFrame:
    """Match of the first variant that has one, with its state.

    ``matches`` has variant, qid and website. A match without website or with an
    unusable one still ends the search for this kind.
    """
    one = dedupe_first(matches.select("variant", "qid", "website"), ["variant"], [F.asc("qid")])
    domain = registrable_host(F.col("website"))
    state = F.when(is_blank(F.col("website")), F.lit("NO_P856")).when(
        domain.isNull(), F.lit("INVALID_WEBSITE_URL")).otherwise("RESOLVED")
    found = companies.select("company_id", F.posexplode(variants).alias("rank", "variant")).join(one, "variant")
    found = found.select("company_id", "rank", F.struct(
        state.alias("state"), domain.alias("domain"), "qid").alias("x"))
    return found.groupBy("company_id").agg(F.min_by("x", "rank").alias(f"{prefix}_match"))


def _cached(method: str, as_of, ttl_minutes: int) -> Column:
    """The last attempt used this method and is still fresh."""
    if ttl_minutes <= 0:
        return F.lit(False)
    fresh = F.col("domain_resolution_attempted_at") + F.expr(f"INTERVAL '{int(ttl_minutes)}' MINUTE")
    hit = (F.upper("domain_resolution_method") == method) & (fresh > F.lit(as_of).cast("timestamp"))
    return F.coalesce(hit, F.lit(False))


def resolve_domains(companies: DataFrame, title_matches: DataFrame, cik_matches: DataFrame,
                    infobox: DataFrame, verified: DataFrame, as_of,
                    ttl_minutes: int = V.CACHE_TTL_MINUTES) -> DataFrame:
    """Domain, source and status of every company that is due.

    ``infobox`` and ``verified`` hold company_id and an accepted domain, the
    latter with the rank of the candidate. A knowledge-base match by title is
    tried first, then by CIK, then the infobox, then the verified candidates.
    Companies whose last attempt is still fresh come back as CACHED.
    """
    base = companies.withColumns({
        "titles": title_variants(F.col("wikipedia_title")), "ciks": cik_variants(F.col("cik")),
        "has_title": ~is_blank(F.col("wikipedia_title")), "has_cik": ~is_blank(F.col("cik")),
        "title_cached": _cached(TITLE, as_of, ttl_minutes),
        "cik_cached": _cached(CIK, as_of, ttl_minutes),
        "infobox_cached": _cached(INFOBOX, as_of, ttl_minutes),
    })
    best = verified.groupBy("company_id").agg(F.min_by("domain", "rank").alias("verified_domain"))
    boxes = infobox.groupBy("company_id").agg(F.min("domain").alias("infobox_domain"))
    rows = base
    for side in (
        _first_match(base, F.col("titles"), title_matches, "title"),
        _first_match(base, F.col("ciks"), cik_matches, "cik"), boxes, best,
    ):
        rows = rows.join(side, "company_id", "left")

    has_variants = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    rows = rows.withColumns({
        "use_title": F.col("has_title") & ~F.col("title_cached") & has_variants("titles"),
        "cik_due": F.col("has_cik") & ~F.col("cik_cached"),
        "title_state": F.coalesce("title_match.state", F.lit("NO_ITEM")),
        "cik_state": F.coalesce("cik_match.state", F.lit("NO_ITEM")),
    }).withColumns({
        "cached": F.when(F.col("has_title"), F.col("title_cached") & ~F.col("cik_due")).otherwise(
            F.col("has_cik") & F.col("cik_cached")),
        "title_ok": F.col("use_title") & (F.col("title_state") == "RESOLVED"),
    }).withColumn(
        "use_cik", F.col("cik_due") & has_variants("ciks") & ~F.col("title_ok")
    ).withColumn("cik_ok", F.col("use_cik") & (F.col("cik_state") == "RESOLVED"))

    looked_up = F.col("use_title") | F.col("use_cik")
    strong = name_signals(F.col("name"))
    long_enough = F.exists(strong["tokens"], lambda t: F.length(t) >= 4) & F.exists(
        strong["roots"], lambda r: F.length(r) >= 4)
    known = F.col("has_title") | F.col("has_cik")
    rows = rows.withColumns({
        "infobox_ok": looked_up & F.col("has_title") & ~F.col("infobox_cached")
        & F.col("infobox_domain").isNotNull(),
        "heuristic_ok": F.col("verified_domain").isNotNull() & (known | F.coalesce(long_enough, F.lit(False))),
    })
    how = (
        F.when(F.col("cached"), F.lit("CACHED")).when(F.col("title_ok"), F.lit(TITLE))
        .when(F.col("cik_ok"), F.lit(CIK)).when(F.col("infobox_ok"), F.lit(INFOBOX))
        .when(F.col("heuristic_ok"), F.lit(HEURISTIC))
    )
    # what to record when nothing was found
    miss_method = (
        F.when(F.col("use_cik"), F.lit(CIK)).when(F.col("use_title"), F.lit(TITLE))
        .when(F.col("has_title") & ~F.col("title_cached"), F.lit(TITLE))
        .when(F.col("has_cik"), F.lit(CIK)).otherwise("NONE")
    )
    miss_status = F.when(F.col("use_cik"), F.col("cik_state")).when(
        F.col("use_title"), F.col("title_state")).otherwise("NO_IDENTIFIER")
    miss_error = (
        F.when(looked_up, F.lower(miss_status))
        .when(F.col("has_title") & ~F.col("title_cached"), F.lit("no_wikipedia_title"))
        .when(F.col("has_cik"), F.lit("no_cik")).otherwise("no_identifier")
    )
    match = F.when(F.col("how") == TITLE, F.col("title_match")).when(F.col("how") == CIK, F.col("cik_match"))
    out = rows.withColumn("how", how).withColumn("match", match)
    by = F.col("how")
    base_known = by.isin(TITLE, CIK)
    return out.select(
        "company_id",
        F.when(by == "CACHED", F.lit("CACHED")).when(by.isNotNull(), F.lit("RESOLVED")).otherwise(
            miss_status).alias("status"),
        F.when(by == "CACHED", F.col("domain_resolution_method")).when(by.isNotNull(), by).otherwise(
            miss_method).alias("method"),
        F.when(by.isNull(), miss_error).alias("error"),
        F.when(base_known, F.col("match.domain")).when(by == INFOBOX, F.col("infobox_domain")).when(
            by == HEURISTIC, F.col("verified_domain")).alias("domain"),
        F.when(base_known, F.lit("WIKIDATA")).when(by == INFOBOX, F.lit("WIKIPEDIA")).when(
            by == HEURISTIC, F.lit("HEURISTIC")).alias("source"),
        F.when(base_known, F.lit(V.KNOWLEDGE_BASE_CONFIDENCE)).when(by == INFOBOX, F.lit(V.INFOBOX_CONFIDENCE))
        .when(by == HEURISTIC, F.lit(V.HEURISTIC_CONFIDENCE)).alias("confidence"),
        F.when(by == TITLE, F.lit("enwiki_sitelink")).when(by == CIK, F.lit("cik")).when(
            by == INFOBOX, F.lit(INFOBOX)).when(
            by == HEURISTIC, heuristic_method(F.col("verified_domain"))).alias("resolution_method"),
        F.col("match.qid").alias("wikidata_qid"),
    )
