"""Postings from the JSON payloads of hiring vendors."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolecall.functions import fixed_values as V
from rolecall.functions import urls as U
from rolecall.functions.text import (
    blank_to_null, first_non_blank, html_to_text, is_blank, iso_date, let, record, strip_controls,
    texts, unescape_html,
)
from rolecall.functions.vendors import cut_slash, strip_punctuation
from rolecall.operators.latest import top_per_group
from rolecall.operators.pages import with_hash


def finish_postings(rows: DataFrame) -> DataFrame:
    """Keep rows with a public URL and a title, and hash them."""
    out = rows.where(U.is_posting_url(F.col("canonical_url")) & ~is_blank(F.col("title")))
    return with_hash(out.withColumn("canonical_url", strip_controls(F.col("canonical_url"))))


def cap_feed(postings: DataFrame, keys: list[str], limit: int | None = None) -> DataFrame:
    """The first ``limit`` postings of each feed, all of them without a limit.

    The stored maximum of Workday feeds is ``MAX_POSTINGS_PER_FEED``; other boards have none.
    """
    if limit is None:
        return postings
    order = [F.asc(c) for c in ("page_no", "pos") if c in postings.columns]
    return top_per_group(postings, keys, order, limit)


def feed_summary(postings: DataFrame, keys: list[str], limit: int | None = None) -> DataFrame:
    """Per feed: postings kept and whether the maximum, if there is one, cut some off."""
    most = F.lit(limit).cast("bigint")
    return postings.groupBy(*keys).agg(F.count("*").alias("n")).select(
        *keys, F.least("n", most).alias("extracted"), F.coalesce(F.col("n") > most, F.lit(False)).alias("truncated"))


def spread(payloads: DataFrame) -> DataFrame:
    """Payloads dealt to all cores: a small file of them, read by one task, takes long to parse."""
    return payloads.repartition("payload_id")


# --- board payloads --------------------------------------------------------

GREENHOUSE_JOB = (
    "title string, absolute_url string, content string, id string, location string, "
    "updated_at string, metadata array<struct<name:string,value:string>>"
)


def greenhouse_job_url(raw: Column) -> Column:
    """Public job URL; null for an API host, trimmed text when there is no host."""
    def public(u, t):
        host = F.when(u["host"] == "job-boards.greenhouse.io", F.lit("boards.greenhouse.io")).otherwise(u["host"])
        tail = F.when(~is_blank(u["query"]), F.concat(F.lit("?"), u["query"])).otherwise("")
        full = cut_slash(F.concat(F.lit("https://"), host, F.coalesce(u["path"], F.lit("")), tail))
        return F.when(u["host"].isNull(), t).when(~u["host"].contains("api.greenhouse.io"), full)

    def url(t):
        return F.when(t.isNotNull(), let(U.raw_parts_of(U.with_lower_scheme(t)), lambda u: public(u, t)))

    return let(strip_controls(raw), url)


def greenhouse_token(endpoint: Column) -> Column:
    """Board name of an endpoint or feed URL."""
    def token(u):
        seg = U.path_segments(u["path"])
        api = u["host"].contains("api.greenhouse.io") & (F.size(seg) >= 3) & (F.get(seg, 1) == "boards")
        return F.when(api, F.get(seg, 2)).when(u["host"].endswith("greenhouse.io"), F.get(seg, 0))

    return blank_to_null(let(U.parts_of(U.with_lower_scheme(endpoint)), token))


def _employment(metadata: Column) -> Column:
    """Values of metadata entries named like employment, joined; list values are spread."""
    entries = F.filter(metadata, lambda e: F.lower(e["name"]).contains("employment"))
    values = F.flatten(F.transform(entries, lambda e: F.when(
        e["value"].startswith("["), F.from_json(e["value"], "array<string>")
    ).otherwise(F.array(e["value"]))))
    kept = F.transform(F.filter(values, lambda v: ~is_blank(v)), strip_controls)
    return F.nullif(F.array_join(kept, ", "), F.lit(""))


def greenhouse_postings(payloads: DataFrame) -> DataFrame:
    """Postings of board payloads (payload_id, company_id, company_name, source_url, body)."""
    parsed = F.from_json("body", f"jobs array<struct<{_ddl(GREENHOUSE_JOB)}>>")
    rows = spread(payloads).select("payload_id", "company_id", "company_name", "source_url",
                                   F.posexplode(parsed["jobs"]).alias("pos", "job"))
    derived = F.concat(F.lit("https://boards.greenhouse.io/"), greenhouse_token(F.col("source_url")),
                       F.lit("/jobs/"), blank_to_null(F.col("job.id")))
    return finish_postings(rows.select(
        "payload_id", "company_id", "pos", "source_url",
        first_non_blank(greenhouse_job_url(F.col("job.absolute_url")),
                        greenhouse_job_url(derived)).alias("canonical_url"),
        F.col("job.title").alias("title"), F.col("company_name").alias("org_name"),
        F.from_json("job.location", "name string")["name"].alias("location_text"),
        _employment(F.col("job.metadata")).alias("employment_type"),
        iso_date(F.col("job.updated_at")).alias("date_posted"),
        unescape_html(F.col("job.content")).alias("description_text"),
        F.col("job.id").alias("external_identifier"),
    ))


def _ddl(fields: str) -> str:
    """'a string, b int' as struct fields 'a:string,b:int'."""
    out, depth = [], 0
    word = ""
    for ch in fields + ",":
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            name, kind = word.strip().split(" ", 1)
            out.append(f"{name}:{kind}")
            word = ""
        else:
            word += ch
    return ",".join(out)


LEVER_JOB = (
    "text string, hostedUrl string, applyUrl string, descriptionPlain string, description string, "
    "id string, categories string, createdAt string"
)


def lever_postings(payloads: DataFrame) -> DataFrame:
    """Postings of array payloads (payload_id, company_id, company_name, source_url, body)."""
    parsed = F.from_json("body", f"array<struct<{_ddl(LEVER_JOB)}>>")
    rows = spread(payloads).select("payload_id", "company_id", "company_name", "source_url",
                                   F.posexplode(parsed).alias("pos", "job"))
    made = F.col("job.createdAt").try_cast("bigint")
    place = F.from_json("job.categories", "location string, commitment string")
    return finish_postings(rows.select(
        "payload_id", "company_id", "pos", "source_url",
        first_non_blank(F.col("job.hostedUrl"), F.col("job.applyUrl")).alias("canonical_url"),
        F.col("job.text").alias("title"), F.col("company_name").alias("org_name"),
        place["location"].alias("location_text"), place["commitment"].alias("employment_type"),
        F.to_date(F.timestamp_millis(made)).alias("date_posted"),
        html_to_text(first_non_blank(F.col("job.descriptionPlain"), F.col("job.description"))
                     ).alias("description_text"),
        F.col("job.id").alias("external_identifier"),
    ))


# --- Workday payloads ------------------------------------------------------


def workday_path(raw: Column) -> Column:
    """Path without query and fragment, with a leading slash; null when blank."""
    bare = blank_to_null(F.regexp_replace(strip_controls(raw), r"[?#].*$", ""))
    return F.regexp_replace(bare, "^(?!/)", "/")


def _path_candidates(path: Column, site: Column) -> Column:
    """Paths to try for one job path: with locale and site, without, and as it is."""
    us = F.lit("/en-US")

    def made(p):
        own = F.lower(p).startswith(F.lower(F.concat(F.lit("/"), site, F.lit("/"))))
        prefixed = F.when(own, p).otherwise(F.concat(F.lit("/"), site, p))
        plain = let(prefixed, lambda x: F.array(F.concat(us, x), x, F.concat(us, p), p))
        return F.when(p.rlike("^/[a-z]{2}-[A-Z]{2}/.*"), F.array(p)).when(p.isNotNull(), plain)

    return F.coalesce(let(path, made), F.array().cast("array<string>"))


def workday_url_candidates(host: Column, site: Column, raw: Column) -> Column:
    """Ordered public URLs for one job path or URL of a Workday site."""
    empty = F.array().cast("array<string>")

    def on(a_host, paths, query):
        tail = F.when(~is_blank(query), F.concat(F.lit("?"), query)).otherwise("")
        return F.transform(paths, lambda p: F.concat(F.lit("https://"), a_host, p, tail))

    def ordered(seg, path):
        has_site = (F.lower(F.get(seg, 0)) == F.lower(site)) | (
            F.get(seg, 0).rlike(V.LOCALE_SEGMENT) & (F.lower(F.get(seg, 1)) == F.lower(site)))
        both = let(path, lambda p: record(direct=F.array_compact(F.array(p)), made=_path_candidates(p, site)))
        return let(both, lambda x: F.when(
            F.coalesce(has_site, F.lit(False)), F.concat(x["direct"], x["made"])
        ).otherwise(F.concat(x["made"], x["direct"])))

    def absolute(u):
        paths = let(U.path_segments(u["path"]), lambda seg: ordered(seg, workday_path(u["path"])))
        return F.when(u["host"].endswith("myworkdayjobs.com"), on(u["host"], paths, u["query"]))

    def candidates(t):
        made = F.when(t.rlike("^https?://"), let(U.raw_parts_of(t), absolute)).otherwise(
            on(host, _path_candidates(workday_path(t), site), F.lit(None)))
        usable = ~is_blank(t) & ~F.lower(t).contains("invalid-url")
        return F.when(usable, F.array_distinct(F.coalesce(made, empty))).otherwise(empty)

    return let(strip_controls(raw), candidates)


def is_workday_api(url: Column) -> Column:
    path = F.lower(U.decoded_path(url))
    return F.lower(url).contains("/wday/cxs/") | path.rlike("/jobs/?$")


def workday_endpoint(url: Column) -> Column:
    """Host and site of an endpoint URL, null when it is not one."""
    def parts(u):
        seg = U.path_segments(u["path"])
        cxs = (F.size(seg) >= 4) & (F.get(seg, 0) == "wday") & (F.get(seg, 1) == "cxs")
        locale = (F.size(seg) >= 2) & F.get(seg, 0).rlike(V.LOCALE_SEGMENT)
        site = F.when(cxs, F.get(seg, 3)).when(locale, F.get(seg, 1)).otherwise(F.get(seg, 0))
        site = blank_to_null(strip_punctuation(site))
        ok = u["host"].contains("myworkdayjobs.com") & u["host"].rlike(r"^[^.]+\.[^.]+\..+") & site.isNotNull()
        return F.when(ok, record(host=u["host"], site=site))

    return let(U.parts_of(U.with_lower_scheme(url)), parts)


WORKDAY_JOB = ", ".join(
    f"{n} string" for n in [
        "title", "jobTitle", *V.WORKDAY_URL_FIELDS, "bulletinId", "id", "jobReqId", "timeType",
        "workerSubType", "timeTypeLabel", "postedOn", "bulletinDate", "startDate",
        "shortDescription", "description", "jobDescription", "locationsText", "location",
    ]
) + ", locations array<struct<name:string,city:string,country:string>>"


def _location(job: Column) -> Column:
    places = F.transform(job["locations"], lambda x: first_non_blank(x["name"], x["city"], x["country"]))
    return F.coalesce(first_non_blank(job["locationsText"], job["location"]),
                      F.nullif(F.array_join(F.array_compact(places), " | "), F.lit("")))


def workday_postings(payloads: DataFrame) -> DataFrame:
    """Postings of result pages (payload_id, company_id, page_no, endpoint_url, source_url, body)."""
    parsed = F.from_json("body", f"jobPostings array<struct<{_ddl(WORKDAY_JOB)}>>")
    rows = spread(payloads).select("payload_id", "company_id", "page_no", "source_url",
                                   workday_endpoint(F.col("endpoint_url")).alias("site"),
                                   F.posexplode(parsed["jobPostings"]).alias("pos", "job"))
    raw = texts(*[F.col(f"job.{n}") for n in V.WORKDAY_URL_FIELDS])
    rows = rows.where(F.col("site").isNotNull()).withColumn("raw", raw)
    urls = F.flatten(F.transform("raw", lambda r: workday_url_candidates(
        F.col("site.host"), F.col("site.site"), r)))
    # exploding the first usable URL, if any, keeps later filters from computing it again
    usable = F.slice(F.filter(urls, lambda u: ~is_workday_api(u)), 1, 1)
    rows = rows.select("payload_id", "company_id", "page_no", "pos", "source_url", "job", "raw",
                       F.explode(usable).alias("canonical_url"))
    job = F.col("job")
    from_path = F.regexp_extract(F.get("raw", 0), r"_([A-Za-z0-9-]+)$", 1)
    out = rows.select(
        "payload_id", "company_id", "page_no", "pos", "source_url", "canonical_url",
        first_non_blank(job["title"], job["jobTitle"]).alias("title"),
        F.lit(None).cast("string").alias("org_name"), _location(job).alias("location_text"),
        first_non_blank(job["timeType"], job["workerSubType"], job["timeTypeLabel"]).alias("employment_type"),
        F.coalesce(*[iso_date(job[n]) for n in ("postedOn", "bulletinDate", "startDate")]).alias("date_posted"),
        first_non_blank(*[html_to_text(job[n]) for n in ("shortDescription", "description", "jobDescription")]
                        ).alias("description_text"),
        first_non_blank(job["bulletinId"], job["id"], job["jobReqId"], from_path).alias("external_identifier"),
    )
    return finish_postings(out.where(~U.is_invalid_posting_url(F.col("canonical_url"))))


def workday_totals(payloads: DataFrame) -> DataFrame:
    """Highest total that the result pages of each company state."""
    fields = ", ".join(f"{n} string" for n in V.WORKDAY_TOTAL_FIELDS)
    paging = ", ".join(f"{n}:string" for n in V.WORKDAY_PAGING_TOTAL_FIELDS)
    rows = payloads.select("company_id", F.from_json("body", f"{fields}, paging struct<{paging}>").alias("x"))

    def positive(name):
        n = F.col(f"x.{name}").try_cast("int")
        return F.when(n > 0, n)

    total = F.coalesce(*[positive(n) for n in V.WORKDAY_TOTAL_FIELDS],
                       *[positive(f"paging.{n}") for n in V.WORKDAY_PAGING_TOTAL_FIELDS])
    return rows.groupBy("company_id").agg(F.max(total).alias("total_jobs_available"))


def workday_summary(payloads: DataFrame, limit: int | None = None) -> DataFrame:
    """Per company: postings kept, whether reading stopped at the maximum, and the stated total."""
    most = F.lit(limit).cast("bigint")
    counts = workday_postings(payloads).groupBy("company_id").agg(F.count("*").alias("n"))
    return workday_totals(payloads).join(counts, "company_id", "left").select(
        "company_id", F.least(F.coalesce("n", F.lit(0)), most).alias("extracted"),
        F.coalesce(F.coalesce("n", F.lit(0)) >= most, F.lit(False)).alias("truncated"), "total_jobs_available")
