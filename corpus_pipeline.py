"""A corpus pipeline: from documents to token ids in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last have the columns of
``documents``. A stage works on all that the one before it kept. Rows of one doc_id share a decision and
are kept if one of them is.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolecall.llm import words
from rolecall.llm.bpe_codec import encode_texts
from rolecall.llm.decontamination import benchmark_matches
from rolecall.llm.language_id import document_languages
from rolecall.llm.line_dedup import line_dedup as without_repeated_lines
from rolecall.llm.simhash_dedup import simhash_classes


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language, with ``lang`` set to the language found."""
    found = document_languages(docs, _table(spark, sf_dir, "pages")).where("kept")
    own, language = words.fresh(docs, "_id", "_language")
    kept = found.groupBy(F.col("doc_id").alias(own)).agg(F.max_by("language", "confidence").alias(language))
    return (docs.join(kept, F.col("doc_id").eqNullSafe(F.col(own)))
            .withColumn("lang", F.col(language)).select(*docs.columns))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated lines; those of which nothing is left go."""
    # the operator's own columns must not replace columns of the table
    cut = without_repeated_lines(docs.drop("n_lines", "n_removed", "removed_lines"))
    cut = cut.where("n_lines = 0 OR n_removed < n_lines")
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each class of near duplicates; those without an id stay."""
    (own,) = words.fresh(docs, "_id")
    firsts = simhash_classes(docs.select("doc_id", "text")).where("doc_id = component_id").select(
        F.col("doc_id").alias(own)).distinct()
    return docs.join(firsts, F.col("doc_id") == F.col(own), "left").where(
        F.col(own).isNotNull() | F.col("doc_id").isNull()).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    (own,) = words.fresh(docs, "_id")
    hit = benchmark_matches(docs.select("doc_id", "text"), _table(spark, sf_dir, "benchmark")).where(
        "contaminated").select(F.col("doc_id").alias(own)).distinct()
    return docs.join(hit, F.col("doc_id").eqNullSafe(F.col(own)), "left_anti")


def bpe_codec(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, ids_sha256 and decoded_sha256 of each document."""
    return encode_texts(docs).select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"),
                                     F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_dedup", simhash_dedup),
    ("decontamination", decontamination),
    ("bpe_codec", bpe_codec),
]

#: Language models, SimHash classes, latent search and merges of bytes are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = words.stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
