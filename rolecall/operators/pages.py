"""What fetched pages say: vendor links, career links, JSON-LD postings, company tables."""

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolecall.functions import fixed_values as V
from rolecall.functions import urls as U
from rolecall.functions.hashing import content_hash
from rolecall.functions.text import (
    blank_to_null, contains_any, first_non_blank, html_tables, html_to_text, is_blank, iso_date, let, record,
    strip_controls, texts,
)
from rolecall.functions.vendors import clean_token, strip_punctuation
from rolecall.operators.latest import dedupe_first, top_per_group
from rolecall.operators.normalize import clean_cik, clean_text, wiki_title

HREF = r"""(?is)<a\b[^>]*?\bhref\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>]+)[^>]*>.*?(?=</a\s*>|<a\b|$)"""
HREF_VALUE = r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']?((?<=")[^"]*|(?<=')[^']*|[^\s"'>]+)"""


# --- vendor links ----------------------------------------------------------


def workday_site(raw_path: Column) -> Column:
    """/site or /locale/site of a Workday path, null without a site."""
    path = strip_punctuation(F.regexp_replace(F.coalesce(raw_path, F.lit("")), r"[?#].*$", ""))

    def named(seg):
        cxs = (F.size(seg) >= 4) & (F.lower(F.get(seg, 0)) == "wday") & (F.lower(F.get(seg, 1)) == "cxs")
        locale = (F.size(seg) >= 2) & F.get(seg, 0).rlike(V.LOCALE_SEGMENT)
        site = F.when(cxs, F.get(seg, 3)).when(locale, F.get(seg, 1)).otherwise(F.get(seg, 0))
        before = F.when(locale & ~cxs, F.concat(F.lit("/"), F.get(seg, 0))).otherwise("")
        return F.concat(before, F.lit("/"), blank_to_null(strip_punctuation(site)))

    return let(U.path_segments(path), named)


def _endpoint(match: Column, pattern: str, template: str) -> Column:
    """Endpoint URL of one match; null when a part it needs is missing."""
    def group(i):
        return clean_token(F.regexp_extract(match, pattern, i))

    pieces = []
    for piece in re.split(r"(\{\w+\})", template):
        if piece == "{for}":
            url = F.regexp_replace(match, "^//", "https://")
            query = U.decode(U.part(url, "QUERY"))
            pieces.append(clean_token(F.regexp_extract(query, r"(?i)(?:^|&)for=([^&]*)", 1)))
        elif piece == "{site}":
            pieces.append(workday_site(F.regexp_extract(match, pattern, 2)))
        elif piece.startswith("{"):
            pieces.append(group(int(piece[1:-1])))
        elif piece:
            pieces.append(F.lit(piece))
    return F.concat(*pieces)


#: Whatever one of the vendor patterns may match, up to a mark that none of them crosses.
LINK_TOKEN = (r"(?i)(?:https?:)?//[A-Za-z0-9.-]*(?:" + V.VENDOR_LINK_HINT.removeprefix("(?i)")
              + r")[^\"'\s>]*")


def link_array(*texts_: Column) -> Column:
    """Vendor endpoints that texts name, text by text in pattern order: array of (vendor, ats_url).

    A text is read once, for all vendors together; the patterns of single vendors
    then go over the tokens found, which hold every match that the text holds.
    """
    def found(tokens, vendor, pattern, template):
        matches = F.regexp_extract_all(tokens, F.lit(pattern), F.lit(0))
        return F.transform(matches, lambda m: record(vendor=F.lit(vendor), raw=_endpoint(m, pattern, template)))

    def links(tokens):
        every = F.concat(*[found(tokens, *link) for link in V.VENDOR_LINKS])
        good = F.filter(every, lambda x: x["raw"].isNotNull()
                        & (F.lower(x["raw"]) != "https://boards.greenhouse.io/embed"))
        stored = F.transform(good, lambda x: record(vendor=x["vendor"], ats_url=_stored(x["raw"])))
        return F.filter(stored, lambda x: x["ats_url"].isNotNull())

    tokens = F.filter(F.array(*[
        F.array_join(F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(LINK_TOKEN), F.lit(0)), "\n")
        for t in texts_]), lambda t: t != "")
    return F.flatten(F.transform(tokens, links))


def _stored(url: Column) -> Column:
    """https, host in lower case, path as it is; null when there is no valid host."""
    return let(U.parts_of(url), lambda u: F.concat(F.lit("https://"), u["host"], u["path"]))


def vendor_endpoints(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Distinct vendor endpoints of each page: from its URL first, then from its HTML."""
    both = link_array(F.col("url"), F.col("html"))
    rows = pages.select(key, F.posexplode(both).alias("pos", "x")).select(
        key, "pos", "x.vendor", "x.ats_url", F.lower("x.ats_url").alias("_low"))
    return dedupe_first(rows, [key, "vendor", "_low"], [F.asc("pos")]).drop("_low")


def short_links(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Vendor short links of each page, in order."""
    tokens = F.regexp_extract_all(F.col("html"), F.lit(V.VENDOR_SHORT_LINK), F.lit(1))
    links = F.transform(F.transform(tokens, clean_token), lambda t: F.concat(F.lit("https://grnh.se/"), t))
    return pages.select(key, F.posexplode(F.array_compact(links)).alias("pos", "short_url"))


def endpoints_from_urls(urls: DataFrame, key: str) -> DataFrame:
    """Vendor endpoints among the URLs of each key; the first URL of one is its source.

    ``urls`` has the key, pos and url.
    """
    rows = urls.where(F.col("url").rlike(V.VENDOR_LINK_HINT)).select(
        key, "pos", "url", F.posexplode(link_array(F.col("url"))).alias("nth", "x")
    ).select(key, "pos", "nth", F.col("url").alias("discovered_from_url"), "x.vendor", "x.ats_url",
             F.lower("x.ats_url").alias("_low"))
    first = dedupe_first(rows, [key, "vendor", "_low"], [F.asc("pos"), F.asc("nth")])
    return first.drop("_low", "nth")


def anchors(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Links of each page with absolute URL and text, in order."""
    found = F.regexp_extract_all(F.col("html"), F.lit(HREF), F.lit(0))
    return pages.select(key, "url", F.posexplode(found).alias("pos", "anchor")).select(
        key, "pos",
        U.resolve_url(F.col("url"), F.replace(
            F.regexp_extract("anchor", HREF_VALUE, 1), F.lit("&amp;"), F.lit("&"))).alias("href"),
        html_to_text(F.col("anchor")).alias("text"),
    ).where(~is_blank(F.col("href")))


def endpoints_from_anchors(pages: DataFrame, key: str = "page_id") -> DataFrame:
    return endpoints_from_urls(anchors(pages, key).select(key, "pos", F.col("href").alias("url")), key)


def ranked_career_links(pages: DataFrame, n: int | None = None, key: str = "page_id") -> DataFrame:
    """Best career links of each page by the words in URL and text; URL order on equal scores."""
    def plain(u):
        tail = F.when(~is_blank(u["query"]), F.concat(F.lit("?"), u["query"])).otherwise("")
        return F.when(u["scheme"].isin("http", "https"),
                      F.concat(u["scheme"], F.lit("://"), u["host"], u["path"], tail))

    links = anchors(pages, key).withColumn(
        "candidate_url", let(U.parts_of(F.col("href")), plain))
    url, text = F.lower("candidate_url"), F.lower("text")
    score = F.lit(0)
    for word in V.CAREER_LINK_KEYWORDS:
        score = score + F.when(url.contains(word), 6).otherwise(0) + F.when(text.contains(word), 4).otherwise(0)
    score = score + F.when(contains_any(url, ["/careers", "/jobs"]), 4).otherwise(0)
    score = score + F.when(contains_any(url, ["jobs.", "careers."]), 3).otherwise(0)
    best = links.where(F.col("candidate_url").isNotNull()).select(
        key, "candidate_url", score.alias("score")
    ).where(F.col("score") > 0).groupBy(key, "candidate_url").agg(F.max("score").alias("score"))
    return best if n is None else top_per_group(best, [key], [F.desc("score"), F.asc("candidate_url")], n)


def endpoint_candidates(detections: DataFrame) -> DataFrame:
    """One endpoint per company, vendor and URL over all methods, the first method winning.

    ``detections`` has company_id, method, pos, vendor, ats_url and
    discovered_from_url; confidence follows from the method.
    """
    methods = list(V.ENDPOINT_METHODS)
    place, confidence = F, F
    for i, name in enumerate(methods):
        place = place.when(F.col("method") == name, i)
        confidence = confidence.when(F.col("method") == name, V.ENDPOINT_METHODS[name])
    rows = detections.where(~is_blank(F.col("ats_url"))).withColumns({
        "_place": place.otherwise(len(methods)), "confidence": confidence.otherwise(0.9),
        "_low": F.lower("ats_url"),
    })
    first = dedupe_first(rows, ["company_id", "vendor", "_low"], [F.asc("_place"), F.asc("pos")])
    return first.select(
        "company_id", F.col("vendor").alias("ats_type"), "ats_url", "discovered_from_url",
        F.col("method").alias("detection_method"), "confidence", F.lit(True).alias("verified"))


# --- JSON-LD ---------------------------------------------------------------

SCRIPT = r"""(?is)<script\b[^>]*\btype\s*=\s*["']?application/ld\+json["']?[^>]*>(.*?)</script\s*>"""


def _refuse(name: str):
    raise ValueError(f"{name} is no JSON")


def _postings_in(text: str) -> list[dict]:
    """JobPosting objects anywhere in a JSON text, with flattened places and employment text.

    A text that is no JSON, or is nested too deeply to be read, holds none.
    """
    try:
        root, _ = json.JSONDecoder(parse_constant=_refuse).raw_decode(text.strip())
        return [{"node": _dump(n), "places": _leaves(n.get("jobLocation")),
                 "employment": _employment(n.get("employmentType"))} for n in _posting_objects(root)]
    except (ValueError, RecursionError):
        return []


def _posting_objects(root) -> list[dict]:
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if isinstance(node, list):
            stack.extend(reversed(node))
        elif isinstance(node, dict):
            kind = node.get("@type")
            kinds = kind if isinstance(kind, list) else [kind]
            if any(isinstance(k, str) and k.lower() == "jobposting" for k in kinds):
                out.append(node)
            stack.extend(v for v in reversed(list(node.values())) if isinstance(v, (list, dict)))
    return out


def _dump(value) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def _leaves(value) -> list[str]:
    out, stack = [], [value]
    while stack:
        node = stack.pop()
        if isinstance(node, list):
            stack.extend(reversed(node))
        elif isinstance(node, dict):
            out.append(_dump(node))
        elif isinstance(node, str):
            out.append(node)
    return out


def _employment(value) -> str | None:
    if value is None or isinstance(value, str):
        return value
    names = [v for v in value if isinstance(v, str)] if isinstance(value, list) else []
    return ", ".join(dict.fromkeys(names)) if names else _dump(value)


NODES = T.ArrayType(T.StructType([
    T.StructField("node", T.StringType()), T.StructField("places", T.ArrayType(T.StringType())),
    T.StructField("employment", T.StringType()),
]))


@F.pandas_udf(NODES)
def posting_nodes(payloads: pd.Series) -> pd.Series:
    """Recursive search, which Spark's JSON functions cannot express."""
    return payloads.map(lambda p: _postings_in(p) if p else [])


def _place_text(place: Column) -> Column:
    """Locality, region and country of a place, else its name; a text is taken as it is."""
    fields = "address string, addressLocality string, addressRegion string, addressCountry string, name string"

    def of_object(text):
        node = F.from_json(text, fields)
        own = F.when(F.array_contains(F.json_object_keys(text), "address"),
                     F.from_json(node["address"], fields)).otherwise(node)
        return let(record(node=node, own=own), lambda x: F.coalesce(
            F.nullif(F.array_join(texts(x["own"]["addressLocality"], x["own"]["addressRegion"],
                                        x["own"]["addressCountry"]), ", "), F.lit("")),
            first_non_blank(x["node"]["name"], x["own"]["name"])))

    return F.when(place.startswith("{"), of_object(place)).otherwise(blank_to_null(strip_controls(place)))


def _identifier(raw: Column) -> Column:
    def of_object(text):
        n = F.from_json(text, "value string, name string, propertyID string")
        return first_non_blank(n["value"], n["name"], n["propertyID"])

    return F.when(raw.startswith("{"), of_object(raw)).otherwise(raw)


POSTING_COLUMNS = ["source_url", "canonical_url", "title", "org_name", "location_text",
                   "employment_type", "date_posted", "description_text", "external_identifier"]


def with_hash(postings: DataFrame) -> DataFrame:
    names = ["canonical_url", "date_posted", "description_text", "employment_type",
             "external_identifier", "location_text", "org_name", "title"]
    return postings.withColumn("content_hash", content_hash(*[F.col(c) for c in names]))


def jsonld_postings(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Normalised postings from the JSON-LD blocks of pages (key, url, html)."""
    blocks = F.regexp_extract_all(F.col("html"), F.lit(SCRIPT), F.lit(1))
    rows = pages.where(F.col("html").rlike(r"(?i)application/ld\+json")).select(
        key, "url", F.posexplode(blocks).alias("block", "payload"))
    rows = rows.where(~is_blank(F.col("payload"))).select(
        key, "url", "block", F.posexplode(posting_nodes("payload")).alias("pos", "x"))
    fields = ("title string, name string, hiringOrganization string, datePosted string, "
              "description string, identifier string, url string")
    rows = rows.select(key, F.col("url").alias("source_url"), "block", "pos", "x.places", "x.employment",
                       F.from_json("x.node", fields).alias("n"))
    raw = strip_controls(F.col("n.url"))
    places = F.array_distinct(F.array_compact(F.transform("places", _place_text)))
    org = F.from_json("n.hiringOrganization", "name string")["name"]
    rows = rows.select(
        key, "block", "pos", "source_url",
        F.coalesce(U.posting_url(raw), U.posting_url(F.when(
            ~is_blank(raw), U.resolve_url(F.col("source_url"), raw))),
            U.posting_url(F.col("source_url"))).alias("canonical_url"),
        first_non_blank(F.col("n.title"), F.col("n.name")).alias("title"),
        strip_controls(org).alias("org_name"),
        F.nullif(F.array_join(places, " | "), F.lit("")).alias("location_text"),
        F.col("employment").alias("employment_type"),
        iso_date(F.col("n.datePosted")).alias("date_posted"),
        strip_controls(F.col("n.description")).alias("description_text"),
        _identifier(F.col("n.identifier")).alias("external_identifier"),
    )
    return with_hash(rows.where(F.col("canonical_url").isNotNull()))


# --- company tables --------------------------------------------------------


def constituents(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Company rows of the listing table of each page (key, html).

    The table with id ``constituents``, else the first one whose header names a
    symbol, a security and a sector. Columns are found by header text.
    """
    def header(table):
        row = F.get(F.filter(F.regexp_extract_all(table, F.lit(r"(?is)<tr\b[^>]*>.*?(?=</tr>|<tr\b|$)"), F.lit(0)),
                             lambda r: r.rlike(r"(?is)<th\b")), 0)
        heads = F.regexp_extract_all(row, F.lit(r"(?is)<th\b[^>]*>(.*?)(?=</th>|<th\b|<td\b|$)"), F.lit(1))
        return F.transform(heads, lambda h: F.lower(html_to_text(h)))

    def index(heads, *names):
        def place(name):
            return F.array_position(F.transform(heads, lambda h: h.contains(name)), True)

        return F.coalesce(*[F.nullif(place(n), F.lit(0)) for n in names])

    rows = pages.select(key, F.posexplode(html_tables(F.col("html"))).alias("table_no", "table")).withColumn(
        "heads", header(F.col("table"))).select(
        key, "table_no", "table", index(F.col("heads"), "symbol", "ticker").alias("i_ticker"),
        index(F.col("heads"), "security", "name").alias("i_name"),
        index(F.col("heads"), "gics sector", "sector").alias("i_sector"),
        index(F.col("heads"), "cik").alias("i_cik"),
        F.col("table").rlike(r"""(?is)^<table\b[^>]*\bid\s*=\s*["']?constituents["'\s>]""").alias("by_id"))
    fits = F.col("by_id") | (F.col("i_ticker").isNotNull() & F.col("i_name").isNotNull()
                             & F.col("i_sector").isNotNull())
    chosen = dedupe_first(rows.where(fits), [key], [F.desc("by_id"), F.asc("table_no")])
    chosen = chosen.where(F.col("i_ticker").isNotNull() & F.col("i_name").isNotNull())
    lines = F.regexp_extract_all(F.col("table"), F.lit(r"(?is)<tr\b[^>]*>.*?(?=</tr>|<tr\b|$)"), F.lit(0))
    cells = F.regexp_extract_all(F.col("line"), F.lit(r"(?is)<td\b[^>]*>(.*?)(?=</td>|<td\b|$)"), F.lit(1))
    out = chosen.select(key, "i_ticker", "i_name", "i_sector", "i_cik", F.posexplode(lines).alias("pos", "line"))
    out = out.withColumn("cells", cells).where(F.size("cells") > 0)

    def cell(i):
        return F.get(F.col("cells"), F.col(i) - 1)

    link = F.regexp_extract(cell("i_name"), r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["']""", 1)
    out = out.select(
        key, "pos", F.upper(clean_text(html_to_text(cell("i_ticker")))).alias("ticker"),
        clean_text(html_to_text(cell("i_name"))).alias("name"),
        clean_text(html_to_text(cell("i_sector"))).alias("sector"),
        clean_cik(clean_text(html_to_text(cell("i_cik")))).alias("cik"),
        wiki_title(blank_to_null(link)).alias("wikipedia_title"))
    return out.where(F.col("ticker").isNotNull() & F.col("name").isNotNull())
