"""Sitemap and robots documents: parsing, closure over stored documents, decisions."""

import gzip

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolecall.functions import fixed_values as V
from rolecall.functions import urls as U
from rolecall.functions.text import blank_to_null, is_blank, record, strip_controls, unescape_html
from rolecall.operators.latest import dedupe_first, top_per_group
from rolecall.session import cut_lineage


@F.pandas_udf(T.StringType())
def gunzip(bodies: pd.Series) -> pd.Series:
    """Text of gzip bytes, null when they are broken."""
    def one(body):
        try:
            return gzip.decompress(body).decode("utf-8", "replace")
        except (OSError, EOFError, TypeError):
            return None

    return bodies.map(one)


def is_gzip(url: Column, final_url: Column, encoding: Column, body: Column) -> Column:
    """By suffix of either URL, by content encoding, or by the first two bytes."""
    named = F.lower(url).endswith(".gz") | F.coalesce(F.lower(final_url).endswith(".gz"), F.lit(False))
    coded = F.coalesce(F.lower(encoding).contains("gzip"), F.lit(False))
    return named | coded | (F.hex(F.substring(body, 1, 2)) == "1F8B")


def document_texts(docs: DataFrame) -> DataFrame:
    """Documents with ``text`` from their bytes; gzip ones go through Arrow, others do not.

    ``docs`` has url, final_url, content_encoding and body (binary). ``packed``
    tells gzip; the text of a broken one is null.
    """
    packed = is_gzip(F.col("url"), F.col("final_url"), F.col("content_encoding"), F.col("body"))
    rows = docs.withColumn("packed", F.coalesce(packed, F.lit(False)))
    plain = rows.where(~F.col("packed")).withColumn("text", F.decode("body", "UTF-8"))
    zipped = rows.where(F.col("packed")).withColumn("text", gunzip("body"))
    return plain.unionByName(zipped).drop("body")


def sitemap_outcomes(docs: DataFrame, blocked: DataFrame | None = None) -> DataFrame:
    """What came of fetching each sitemap: ``error`` and ``text``, one of them null.

    ``docs`` has url, final_url, content_encoding, body, http_status and
    error_code; ``blocked`` the urls that robots rules forbid. The first that
    applies counts: blocked, fetch error, broken gzip, empty payload.
    """
    texts = document_texts(docs).withColumn("_spoilt", F.col("text").isNull())
    if blocked is None:
        texts = texts.withColumn("_blocked", F.lit(None).cast("boolean"))
    else:
        texts = texts.join(blocked.select("url", F.lit(True).alias("_blocked")).distinct(), "url", "left")
    status = F.col("http_status")
    error = (
        F.when(F.col("_blocked"), F.lit("blocked_by_robots"))
        .when(F.col("error_code").isNotNull(), F.col("error_code"))
        .when(~status.between(200, 299), F.when(status > 0, F.concat(F.lit("http_"), status.cast("string")))
              .otherwise(F.lit("unknown_error")))
        .when(F.col("_spoilt") & F.col("packed"), F.lit("gzip_decode_error"))
        .when(is_blank(F.col("text")), F.lit("empty_sitemap_payload"))
    )
    return texts.select("url", error.alias("error"), F.when(error.isNull(), F.col("text")).alias("text"))


def sitemap_fetches(outcomes: DataFrame, closure: DataFrame, max_urls: int = V.SITEMAP_MAX_URLS) -> DataFrame:
    """A record of every sitemap a company's closure visits: its error, or how many new URLs it gave.

    The visit ends once a company has ``max_urls`` of them; a sitemap with no
    outcome counts as ``unknown_error``.
    """
    visits = closure.join(outcomes.select("url", "error", F.lit(True).alias("_known")), "url", "left").withColumn(
        "error", F.when(F.col("_known").isNull(), F.lit("unknown_error")).otherwise(F.col("error"))).drop("_known")
    urls = page_urls(outcomes.where("error IS NULL"), max_urls).select("url", "pos", "loc")
    order = [F.asc("depth"), F.asc("rank"), F.asc("pos")]
    first = dedupe_first(closure.join(urls, "url"), ["company_id", "loc"], order)
    new = first.groupBy("company_id", "url").agg(F.count("*").alias("_new"))
    rows = visits.join(new, ["company_id", "url"], "left").withColumn("_new", F.coalesce("_new", F.lit(0)))
    before = Window.partitionBy("company_id").orderBy("depth", "rank").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_had", F.coalesce(F.sum("_new").over(before), F.lit(0))).where(F.col("_had") < max_urls)
    given = F.least(F.col("_new"), F.lit(max_urls) - F.col("_had"))
    return rows.select("company_id", "url", "depth", "rank", "error",
                       F.when(F.col("error").isNull(), given).alias("new_urls"))


def sitemap_errors(fetches: DataFrame) -> DataFrame:
    """How often each error met a company's sitemaps."""
    return fetches.where("error IS NOT NULL").groupBy("company_id", "error").agg(F.count("*").alias("total"))


def sitemap_location(c: Column) -> Column:
    t = strip_controls(c)
    return F.when(~is_blank(c), F.when(t.rlike("^https?://"), t).otherwise(F.concat(F.lit("https://"), t)))


def _element_text(block: Column, name: str) -> Column:
    inner = F.regexp_extract(block, rf"(?is)<{name}(?:\s[^>]*)?>(.*?)</{name}\s*>", 1)
    bare = F.regexp_replace(inner, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")
    return F.trim(F.regexp_replace(unescape_html(bare), r"\s+", " "))


def _blocks(text: Column, name: str) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"(?is)<{name}(?:\s[^>]*)?>(.*?)</{name}\s*>"), F.lit(1))


def child_sitemaps(docs: DataFrame, key: str = "url") -> DataFrame:
    """Distinct child sitemaps of each document, in order."""
    found = F.transform(_blocks(F.col("text"), "sitemap"), lambda b: sitemap_location(_element_text(b, "loc")))
    return docs.select(key, F.posexplode(F.array_distinct(F.array_compact(found))).alias("pos", "child_url"))


def page_urls(docs: DataFrame, max_urls: int | None = None, key: str = "url") -> DataFrame:
    """Page URLs of each document with lastmod, first occurrence kept, in order, capped."""
    entries = F.transform(_blocks(F.col("text"), "url"), lambda b: record(
        loc=sitemap_location(_element_text(b, "loc")),
        lastmod=blank_to_null(_element_text(b, "lastmod"))))
    rows = docs.select(key, F.posexplode(entries).alias("pos", "x")).select(key, "pos", "x.loc", "x.lastmod")
    first = dedupe_first(rows.where(F.col("loc").isNotNull()), [key, "loc"], [F.asc("pos")])
    return first if max_urls is None else top_per_group(first, [key], [F.asc("pos")], max(1, max_urls))


def sitemap_closure(docs: DataFrame, seeds: DataFrame, max_depth: int = V.SITEMAP_MAX_DEPTH,
                    max_documents: int = V.SITEMAP_MAX_DOCUMENTS) -> DataFrame:
    """Sitemaps reached from the seeds of each company, breadth first, up to a depth and a number.

    ``docs`` has url and text; ``seeds`` has company_id, pos and url. A sitemap
    counts once, at its first place; one without a stored document counts too.
    Every level keeps only what the limit can still admit, so a company's part
    never exceeds the limit however many sitemaps its documents name. Links and
    levels are checkpointed: each is used by every later level.
    """
    links = cut_lineage(child_sitemaps(docs))
    level = seeds.select("company_id", sitemap_location(F.col("url")).alias("url"), F.col("pos").alias("_a"),
                         F.lit(0).alias("_b"), F.lit(0).alias("depth"))
    level = level.where(F.col("url").isNotNull())
    seen = None
    for depth in range(max_depth + 1):
        first = dedupe_first(level, ["company_id", "url"], [F.asc("_a"), F.asc("_b")])
        if seen is not None:
            first = first.join(seen.select("company_id", "url"), ["company_id", "url"], "left_anti")
        best = top_per_group(first, ["company_id"], [F.asc("_a"), F.asc("_b"), F.asc("url")], max_documents)
        numbered = cut_lineage(best.withColumn("_at", _rank_in_company()))
        seen = numbered if seen is None else seen.unionByName(numbered)
        if depth < max_depth:
            level = numbered.join(links, "url").select(
                "company_id", F.col("child_url").alias("url"), F.col("_at").alias("_a"),
                F.col("pos").alias("_b"), F.lit(depth + 1).alias("depth"))
    return top_per_group(seen, ["company_id"], [F.asc("depth"), F.asc("_at")], max_documents).select(
        "company_id", "url", "depth", F.col("_at").alias("rank"))


def _rank_in_company() -> Column:
    return F.row_number().over(Window.partitionBy("company_id").orderBy("_a", "_b", "url"))


def closure_urls(docs: DataFrame, closure: DataFrame, max_urls: int = V.SITEMAP_MAX_URLS) -> DataFrame:
    """Page URLs of each company over its sitemaps in visiting order, distinct and capped."""
    urls = page_urls(docs, max_urls)
    rows = closure.join(urls, "url").select("company_id", "depth", "rank", "pos", "loc", "lastmod")
    order = [F.asc("depth"), F.asc("rank"), F.asc("pos")]
    first = dedupe_first(rows, ["company_id", "loc"], order)
    return top_per_group(first, ["company_id"], order, max_urls).select("company_id", "loc", "lastmod")


# --- robots ----------------------------------------------------------------


def robots_lines(docs: DataFrame, key: str = "host") -> DataFrame:
    """Directives of robots documents with the group they belong to.

    Lines of one document go to one task; no document is larger than the row it
    came in. A blank or comment-only line ends a group; a user-agent line after
    any other directive starts one.
    """
    lines = docs.select(key, F.posexplode(F.split("text", r"\r\n|[\n\u000B\f\r\u0085\u2028\u2029]")).alias("no", "raw"))
    line = strip_controls(F.substring_index(F.col("raw"), "#", 1))
    rows = lines.select(key, "no", line.alias("line")).where((F.col("line") == "") | F.col("line").rlike("^[^:]+:"))
    name = F.lower(strip_controls(F.substring_index("line", ":", 1)))
    value = strip_controls(F.regexp_extract("line", r"^[^:]+:(.*)$", 1))
    rows = rows.select(key, "no", F.when(F.col("line") != "", name).otherwise("").alias("name"), value.alias("value"))
    in_order = Window.partitionBy(key).orderBy("no")
    agent = F.col("name") == "user-agent"
    starts = (F.col("name") == "") | (agent & (F.coalesce(F.lag("name").over(in_order), F.lit("")) != "user-agent"))
    rows = rows.withColumn("_starts", starts.cast("int"))
    rows = rows.withColumn("grp", F.sum("_starts").over(in_order))
    everyone = (F.col("name") == "user-agent") & (F.col("value") == "*")
    return rows.withColumn("for_all", F.max(everyone).over(Window.partitionBy(key, "grp"))).drop("_starts")


def robots_rules(docs: DataFrame, key: str = "host") -> DataFrame:
    """Allow and disallow rules of the groups that name every agent, in order."""
    rows = robots_lines(docs, key)
    return rows.where(
        F.col("for_all") & F.col("name").isin("allow", "disallow") & (F.col("value") != "")
    ).select(key, "no", F.col("value").alias("path"), (F.col("name") == "allow").alias("allow"))


def robots_sitemaps(docs: DataFrame, key: str = "host") -> DataFrame:
    """Sitemaps that robots documents declare, in any group."""
    rows = robots_lines(docs, key)
    return rows.where((F.col("name") == "sitemap") & (F.col("value") != "")).select(
        key, "no", F.col("value").alias("sitemap_url"))


#: Literal starts shorter than this are shared by many URLs of a host; their rules are dealt to so many salts.
SHORT, SALTS = 12, 16


def robots_decisions(urls: DataFrame, rules: DataFrame, key: str = "url_id") -> DataFrame:
    """Is each URL allowed? The longest matching rule of its host decides, allow on a tie.

    A rule is filed under its literal start, up to a wildcard. Each host has the
    set of lengths of these starts, and a URL looks up its beginnings of these
    lengths only. URLs of a host are spread by a salt, and the rules with a short
    start, wildcards above all, stand at every salt; a longer start spreads URLs
    by itself. ``urls`` has the key, unique, and url; ``rules`` has host, path and
    allow.
    """
    raw = F.regexp_replace(F.col("path"), "^(?!/)", "/")
    pattern = F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(
        F.regexp_replace(raw, r"([\\.\[\]{}()+?^|])", r"\\$1"), r"\*", ".*"), r"\$", r"\$"))
    literal = F.regexp_extract(raw, r"^([^*$]*)", 1)
    parsed = rules.where("host IS NOT NULL AND path IS NOT NULL").select(
        F.lower("host").alias("host"), F.length("path").alias("rule_length"), "allow",
        F.when(raw.rlike(r"[*$]"), pattern).alias("pattern"), literal.alias("start"))
    salts = F.array(*[F.lit(i) for i in range(SALTS)])
    lengths = parsed.groupBy("host").agg(F.collect_set(F.length("start")).alias("lengths")).withColumn(
        "salt", F.explode(salts))
    dealt = parsed.withColumn("salt", F.explode(
        F.when(F.length("start") < SHORT, salts).otherwise(F.array(F.lit(0)))))

    query = U.part(F.col("url"), "QUERY")
    path = F.coalesce(blank_to_null(U.part(F.col("url"), "PATH")), F.lit("/"))
    tail = F.when(~is_blank(query), F.concat(F.lit("?"), query)).otherwise("")
    subjects = urls.select(key, U.host_of(F.col("url")).alias("host"), F.concat(path, tail).alias("subject"),
                           F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int").alias("salt"))
    fitting = F.filter("lengths", lambda n: n <= F.length("subject"))
    keyed = subjects.join(lengths, ["host", "salt"], "left").select(
        key, "host", "subject", "salt", F.explode_outer(fitting).alias("n"))
    keyed = keyed.withColumns({"start": F.expr("substring(subject, 1, n)"),
                               "salt": F.when(F.col("n") < SHORT, F.col("salt")).otherwise(0)})
    matches = F.col("rule_length").isNotNull() & F.coalesce(F.regexp_like("subject", F.col("pattern")), F.lit(True))
    met = keyed.join(dealt, ["host", "start", "salt"], "left")
    verdict = met.groupBy(key).agg(F.max(F.when(matches, F.struct("rule_length", "allow"))).alias("best"))
    return verdict.select(key, F.coalesce("best.allow", F.lit(True)).alias("allowed"))


def seed_sitemaps(domains: DataFrame, robots: DataFrame, with_www: bool = False) -> DataFrame:
    """Sitemaps to start from: declared ones, else the usual place on the domain.

    ``domains`` has company_id and domain, ``robots`` the rows of
    ``robots_sitemaps`` by host. With ``with_www`` the www form is tried too.
    """
    host = F.lower(strip_controls(F.col("domain")))
    rows = domains.select("company_id", host.alias("host")).where(~is_blank(F.col("host")))
    declared = rows.join(robots, "host").groupBy("company_id", "host", "sitemap_url").agg(F.min("no").alias("pos"))
    usual = [F.concat(F.lit("https://"), F.col("host"), F.lit("/sitemap.xml"))]
    if with_www:
        usual.append(F.when(~F.col("host").startswith("www."), F.concat(
            F.lit("https://www."), F.col("host"), F.lit("/sitemap.xml"))))
    default = rows.join(robots.select("host"), "host", "left_anti").select(
        "company_id", "host", F.posexplode(F.array_compact(F.array(*usual))).alias("pos", "sitemap_url"))
    return declared.unionByName(default)


NO_DATA = "no_jobposting_structured_data"


def split_known_unstructured(urls: DataFrame, discovered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """URLs still worth reading, and those known to hold no structured data."""
    known = discovered.where(F.col("fetch_status") == NO_DATA).select("company_id", "url")
    keys = ["company_id", "url"]
    return urls.join(known, keys, "left_anti"), urls.join(known, keys, "left_semi")


def probe_plan(companies: DataFrame, landing: DataFrame, candidates: DataFrame,
               limit: int = V.PROBE_LIMIT) -> DataFrame:
    """URLs to probe per company: hint, two fixed paths and landing URLs, then candidates.

    The first three kinds are always kept; candidates fill up to the limit.
    """
    root = F.concat(F.lit("https://"), F.col("domain"))
    fixed = F.array_compact(F.array(
        strip_controls(blank_to_null(F.col("careers_hint_url"))),
        F.concat(root, F.lit("/careers")), F.concat(root, F.lit("/jobs"))))
    head = companies.select("company_id", F.posexplode(fixed).alias("pos", "url")).withColumn("kind", F.lit(0))
    parts = head.unionByName(landing.select("company_id", "pos", "url").withColumn("kind", F.lit(1)))
    parts = parts.unionByName(candidates.select("company_id", "pos", "url").withColumn("kind", F.lit(2)))
    first = dedupe_first(parts, ["company_id", "url"], [F.asc("kind"), F.asc("pos")])
    sure = first.where(F.col("kind") < 2)
    room = sure.groupBy("company_id").agg(F.count("*").alias("_sure"))
    spare = top_per_group(first.where(F.col("kind") == 2), ["company_id"], [F.asc("pos"), F.asc("url")], limit)
    place = F.row_number().over(Window.partitionBy("company_id").orderBy("pos", "url"))
    spare = spare.withColumn("_place", place).join(room, "company_id", "left")
    spare = spare.where(F.col("_place") + F.coalesce("_sure", F.lit(0)) <= limit).drop("_place", "_sure")
    return sure.unionByName(spare)
