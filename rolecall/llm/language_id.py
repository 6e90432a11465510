"""Language identification by fusing evidence with Bayes' rule.

Four kinds of evidence meet as log probabilities: the text's trigrams, the language that the markup
declares, the language that the address names (top-level suffix or a path segment), and a prior of the
host. Host priors are counts of what the texts alone say, by grouped aggregation, smoothed towards the
host's domain, and that towards all texts. A class ``und`` stands for text that fits no language.
"""

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rolecall.llm import words

#: Texts of each language that the trigram tables are fitted on at most.
SAMPLE = 1000
#: Texts that must declare a language before it is one of the classes; fewer do where they are this share of all.
LEAST_TEXTS = 50
LEAST_SHARE = 0.005
#: Trigrams that a long text counts for: neighbouring trigrams are not independent.
WEIGHT = 40
#: How often markup and address are right.
DECLARED_RIGHT = 0.9
ADDRESS_RIGHT = 0.8
#: Texts that a prior of the level above counts for.
PRIOR_TEXTS = 20.0
UND_PRIOR = 0.001
CONFIDENCE = 0.5
#: Top-level suffixes that name a language; any other two-letter suffix names none.
SUFFIXES = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "uk": "en", "us": "en", "it": "it",
            "nl": "nl", "pl": "pl", "pt": "pt", "br": "pt", "ru": "ru", "jp": "ja", "cn": "zh"}

_BITS = 17
#: Letters stay, all else counts as a blank.
_LETTER = np.full(256, 32, np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def _trigrams(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the trigrams of lower-case texts, and how many there are before each text."""
    data = _LETTER[data]
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(len(ends), np.int64)
    value = (data[:-2].astype(np.uint32) << 16) | (data[1:-1].astype(np.uint32) << 8) | data[2:]
    blank = data == 32
    use = ~(blank[1:-1] & (blank[:-2] | blank[2:]))  # at most one blank, at an edge or alone
    row_end = np.repeat(ends[1:], np.diff(ends))[:-2]
    use &= np.arange(len(value)) + 3 <= row_end
    at = np.flatnonzero(use)
    number = (value[at] * np.uint32(2654435761)) >> np.uint32(32 - _BITS)  # wraps round
    return number.astype(np.int64), np.searchsorted(at, ends)


def fit(docs: DataFrame, languages: Sequence[str], sample: int = SAMPLE) -> np.ndarray:
    """Log probability of each trigram by language, from ``sample`` labelled texts of each at most.

    The sample is taken in the order of a hash of the id, so it does not depend on how rows are stored.
    """
    def count(batches):
        for batch in words.pieces(batches):
            labels = batch.column("label").to_numpy()
            number, before = _trigrams(*words.flat(batch.column("text")))
            both, n = np.unique((np.repeat(labels, np.diff(before)) << _BITS) + number, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (both >> _BITS, both & (1 << _BITS) - 1, n)], ["label", "at", "n"])

    order = Window.partitionBy("declared").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = (docs.where(F.col("declared").isin(*languages)).select("declared", "doc_id")
              .withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= sample)  # cut before the shuffle
              .select(F.col("doc_id").alias("_id"), (F.array_position(
                  F.array(*[F.lit(x) for x in languages]), F.col("declared")) - 1).alias("label")))
    # languages * sample ids at most
    parts = docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("label", F.lower("text").alias("text"))
    found = (parts.mapInArrow(count, "label long, at long, n long").groupBy("label", "at")
             .agg(F.sum("n").alias("n")).toPandas())  # at most languages * 2^17 numbers
    table = np.empty((len(languages), 1 << _BITS), np.float16)
    found = found.sort_values("label")
    cuts = np.searchsorted(found["label"], np.arange(len(languages) + 1))
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):  # one language at a time: there may be many
        row = np.full(1 << _BITS, 0.05)
        row[found["at"].to_numpy()[a:b]] += found["n"].to_numpy()[a:b]
        table[k] = np.log(row / row.sum())
    return table


def _text_scores(docs: DataFrame, table, classes: int) -> DataFrame:
    """doc_id, declared, url, host, whether there is a letter, trigrams and the mean log probability of one for each class."""
    def run(batches):
        model = table.value
        for batch in words.pieces(batches):
            data, ends = words.flat(batch.column("text"))
            number, before = _trigrams(data, ends)
            n = np.diff(before)
            letters = np.concatenate([[0], np.cumsum(_LETTER[data] != 32)])
            scores = np.full((len(n), classes), -np.log(1 << 16), np.float64)  # und: any trigram alike
            for k in range(classes - 1):
                sums = np.concatenate([[0.0], np.cumsum(model[k][number], dtype=np.float64)])
                scores[:, k] = (sums[before[1:]] - sums[before[:-1]]) / np.maximum(n, 1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * classes, pa.int32()),
                                             pa.array(scores.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("doc_id", "declared", "url", "host")]
                + [pa.array(letters[ends[1:]] > letters[ends[:-1]]), pa.array(n, pa.int64()), lists],
                ["doc_id", "declared", "url", "host", "lettered", "trigrams", "scores"])
    return docs.withColumn("text", F.lower("text")).mapInArrow(
        run, "doc_id long, declared string, url string, host string, lettered boolean, trigrams long, scores array<double>")


def _best(scores: str, languages: Sequence[str]) -> Column:
    return F.get(F.array(*[F.lit(x) for x in [*languages, "und"]]),
                 (F.array_position(scores, F.array_max(scores)) - 1).cast("int"))


def _address_language(url: Column, host: Column) -> Column:
    """Language that a path segment of two letters, or else the host's suffix, names."""
    path = F.regexp_extract(url, "://[^/?#]*/([a-z]{2})(?:[/?#]|$)", 1)
    suffix = F.substring_index(host, ".", -1)
    named = F.create_map(*[F.lit(x) for pair in SUFFIXES.items() for x in pair])
    return F.when(path != "", path).otherwise(F.try_element_at(named, suffix))


def identify(docs: DataFrame, evidence: DataFrame | None = None, languages: Sequence[str] | None = None,
             sample: int = SAMPLE, confidence: float = CONFIDENCE) -> DataFrame:
    """Name the language of each text from columns doc_id, text, declared, url and host of ``docs``.

    ``evidence`` may hold better values of declared, url and host by doc_id (one row each). Returns one
    row per input row: doc_id, declared, language, confidence (posterior probability), text_language (of
    the text alone) and kept (a language was found with ``confidence`` or more). Any value may be null,
    which is no evidence; a text without a letter is ``und`` and not kept. Without ``languages`` the
    classes are those declared by ``LEAST_TEXTS`` texts, or by ``LEAST_SHARE`` of all. Without any class
    every text is ``und``. Repeated rows stay; other columns are left out.
    """
    spark = docs.sparkSession
    about = [F.lower(F.col(c).cast("string")).alias(c) for c in ("declared", "url", "host")]
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *about)
    if languages is None:
        counts = words.stored(docs.where("declared IS NOT NULL").groupBy("declared").count(), "declared")
        total = counts.agg(F.sum("count")).first()[0] or 0
        chosen = counts.where(F.col("count") >= min(LEAST_TEXTS, LEAST_SHARE * total))
        languages = sorted(r["declared"] for r in chosen.collect())
    classes = len(languages) + 1
    table = spark.sparkContext.broadcast(fit(docs, languages, sample) if languages else np.zeros((0, 1 << _BITS)))
    scored = _text_scores(docs, table, classes).withColumn(
        "text_language", F.when(F.col("trigrams") > 0, _best("scores", languages)).otherwise("und"))
    if evidence is not None:  # texts have become a few numbers by now
        better = evidence.select(F.col("doc_id").cast("long").alias("_id"), F.struct(*about).alias("_better"))
        scored = scored.join(better, F.col("doc_id") == F.col("_id"), "left").select(
            "doc_id", *[F.coalesce(F.col(f"_better.{c}"), F.col(c)).alias(c) for c in ("declared", "url", "host")],
            "lettered", "trigrams", "scores", "text_language")
    scored = words.stored(scored, "language")
    host, domain = F.col("host"), F.substring_index("host", ".", -2)
    tally = [F.sum((F.col("text_language") == x).cast("long")).cast("double").alias(f"n{i}") for i, x in enumerate(languages)]
    names = [f"n{i}" for i in range(len(languages))]
    everything = [float(x or 0) for x in scored.agg(*tally).first()] if languages else []
    whole = sum(everything) + len(languages)
    top = [(x + 1) / whole for x in everything]
    hosts = scored.where("host IS NOT NULL").groupBy("host").agg(*tally, F.count("*").alias("texts")) if languages else None
    out = scored
    if languages:
        domains = hosts.groupBy(domain.alias("domain")).agg(*[F.sum(n).alias(n) for n in names])
        size = sum((F.col(n) for n in names), F.lit(0.0))
        smoothed = domains.select(F.col("domain").alias("_domain"), *[
            ((F.col(n) + PRIOR_TEXTS * t) / (size + PRIOR_TEXTS)).alias(f"d{i}") for i, (n, t) in enumerate(zip(names, top))])
        priors = words.stored(
            hosts.join(smoothed, domain == F.col("_domain")).select(
                host.alias("_host"), F.array(*[
                    F.log((F.col(n) + PRIOR_TEXTS * F.col(f"d{i}")) / (size + PRIOR_TEXTS)) for i, n in enumerate(names)
                ]).alias("prior")), "priors")
        out = scored.join(priors, host == F.col("_host"), "left")
    n = max(len(languages), 2)
    address = _address_language(F.col("url"), F.col("host"))

    def said(column: Column, language: str, right: float) -> Column:
        """Log probability that the evidence names what it names, given the language."""
        known = column.isin(*languages)
        return F.when(known, F.when(column == language, float(np.log(right))).otherwise(float(np.log((1 - right) / (n - 1))))
                      ).otherwise(0.0)

    weight = F.least(F.col("trigrams"), F.lit(WEIGHT)).cast("double")
    fused = [weight * F.get("scores", i) + F.coalesce(F.get("prior", i), F.lit(float(np.log(top[i]))))
             + said(F.col("declared"), x, DECLARED_RIGHT) + said(address, x, ADDRESS_RIGHT)
             for i, x in enumerate(languages)]
    fused.append(weight * F.get("scores", len(languages)) + float(np.log(UND_PRIOR)))
    out = out.withColumn("fused", F.array(*fused)).withColumn("high", F.array_max("fused"))
    out = out.withColumn("p", 1 / F.aggregate("fused", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("high"))))
    lettered = F.col("lettered")
    language = F.when(lettered, _best("fused", languages)).otherwise("und")
    return out.select("doc_id", "declared", language.alias("language"),
                      F.when(lettered, F.col("p")).otherwise(0.0).alias("confidence"), "text_language").withColumn(
        "kept", (F.col("language") != "und") & (F.col("confidence") >= confidence))


def page_evidence(pages: DataFrame) -> DataFrame:
    """What pages say of the documents made from them: a page's address ends in its document's number.

    Columns doc_id, declared (the markup's language), url and host. Of several pages, the first counts.
    """
    number = F.regexp_extract("url", "/([0-9]{1,18})(?:\\.[a-z]+|/)?(?:[?#].*)?$", 1)
    markup = F.regexp_extract("html", "(?i)<html[^>]*\\slang\\s*=\\s*[\"']?([a-z]{2,3})", 1)
    host = F.regexp_extract("url", "://([^/?#]*)", 1)
    return (pages.select(F.when(number != "", number).cast("long").alias("doc_id"),
                         "page_id", F.when(markup != "", markup).alias("declared"), "url",
                         F.when(host != "", host).alias("host"))
            .where("doc_id IS NOT NULL").groupBy("doc_id")
            .agg(F.min_by(F.struct("declared", "url", "host"), "page_id").alias("page")).select("doc_id", "page.*"))


def document_languages(docs: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Languages of documents (doc_id, text, lang, source): declared is lang, host is source, unless the
    document's page says better."""
    own = docs.select("doc_id", "text", F.col("lang").alias("declared"), F.lit(None).cast("string").alias("url"),
                      F.col("source").alias("host"))
    return identify(own, page_evidence(pages) if pages is not None else None)


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    out = document_languages(spark.read.parquet(f"{sf_dir}/documents.parquet"),
                             spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.withColumn("confidence", F.round("confidence", 6))
