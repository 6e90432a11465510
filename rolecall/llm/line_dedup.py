"""Line dedup: maximal repeated runs of lines by distributed prefix doubling.

A text is a sequence of line ids, and each line starts a suffix of it. The rank of a suffix at level
``k`` is the first place, over all texts, that begins with the same ``2^k`` lines: level 0 comes from
the lines' hashes, and a level from the one before, as the pair of ranks ``2^(k-1)`` lines apart. Suffixes
of one rank are an interval of the suffix array in which the longest common prefix has ``2^k`` lines
at least; a suffix alone in its interval leaves the doubling. A suffix whose rank is not its own
place begins a run that also starts earlier. Overlapping runs join to the maximal runs of a text.

Everything is DataFrame code. Ranks come from partial aggregates joined back, so a line that a third of
all texts share is folded in each task first.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rolecall.llm import words

#: Lines of a repeated run, or else words of a single repeated line, that make it be deleted.
MIN_LINES = 4
MIN_WORDS = 5

_KEY = ["doc_id", "text_hash"]


def _lines(docs: DataFrame) -> DataFrame:
    """The lines with a word of each distinct document: number in the text, rank in order, hashes."""
    number = F.transform(
        F.split(F.col("text").cast("string"), "\n"),
        lambda line, i: F.struct(F.trim(line, F.lit(" \t\x0b\f\r")).alias("line"), i.alias("line_no")))
    return (docs.where("doc_id IS NOT NULL")
            .select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"),
                    F.posexplode(F.filter(number, lambda x: x["line"] != "")).alias("place", "x"))
            .select(*_KEY, "place", "x.line_no", F.xxhash64("x.line").alias("h1"),
                    F.xxhash64(F.lit(1), "x.line").alias("h2"),
                    F.size(F.split("x.line", words.SPACES)).alias("n_words")))


def _ranked(rows: DataFrame, *same: str) -> DataFrame:
    """Rows that share ``same`` with another place, with the first such place as their rank."""
    at = F.struct("doc_id", "place")
    first = (rows.groupBy(*same).agg(F.min(at).alias("rank"), F.max(at).alias("_last"))
             .where("rank <> _last").drop("_last"))
    return rows.join(first, list(same)).drop(*same)


def repeated_lines(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, text_hash and the sorted numbers of the lines that later copies cover."""
    level = words.stored(_ranked(_lines(docs), "h1", "h2"), "lines")
    later = F.col("rank") != F.struct("doc_id", "place")
    found = level.where(later & (F.col("n_words") >= min_words)).select(*_KEY, "place")
    ranks, length = level.select(*_KEY, "place", "rank"), 1
    while length < min_lines:
        step = min(length, min_lines - length)  # the last step may overlap
        ahead = Window.partitionBy(*_KEY).orderBy("place").rangeBetween(step, step)
        pairs = ranks.withColumn("next", F.first("rank").over(ahead)).where("next IS NOT NULL")
        ranks = words.stored(_ranked(pairs.withColumnRenamed("rank", "own"), "own", "next"), "lines")
        length += step
    runs = ranks.where(later).select(
        *_KEY, F.explode(F.sequence("place", F.col("place") + F.lit(min_lines - 1))).alias("place"))
    places = found.unionByName(runs).groupBy(*_KEY).agg(F.collect_set("place").alias("places"))
    # numbers among the lines with a word are turned into line numbers where the text is at hand
    return places.select(*_KEY, F.sort_array("places").alias("places"))


def line_dedup(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """Delete every line that lies in a run of lines which also starts earlier.

    A run counts if it has ``min_lines`` lines or is one line of ``min_words`` words or more. Lines are
    compared without white space at their ends; lines without a word are neither counted nor deleted.
    Earlier is a smaller doc_id, or the same document and an earlier line. Returns the input's rows and
    columns with text replaced by the lines kept, and n_lines (with a word), n_removed and removed_lines
    (numbers of lines from 0); input columns of these three names are replaced. A null text stays null
    with no lines. Rows that are equal in id and text are one document. A row without doc_id is neither cut
    nor a source.
    """
    docs = docs.drop("n_lines", "n_removed", "removed_lines")
    own_id, own_hash, places, lines, filled = words.fresh(docs, "_id", "_hash", "_places", "_lines", "_filled")
    found = repeated_lines(docs, min_lines, min_words).toDF(own_id, own_hash, places)
    joined = docs.join(found, (F.col("doc_id").cast("long") == F.col(own_id)) & (F.xxhash64("text") == F.col(own_hash)), "left")
    split = joined.withColumn(lines, F.coalesce(F.split(F.col("text").cast("string"), "\n"), F.array().cast("array<string>")))
    split = split.withColumn(filled, F.filter(
        F.transform(lines, lambda line, i: F.when(line.rlike("[^\\x20\\x09-\\x0D]"), i)), lambda i: i.isNotNull()))
    removed = split.withColumn("removed_lines", F.coalesce(
        F.transform(places, lambda p: F.get(filled, p)), F.array().cast("array<int>")))
    kept = F.when(F.size("removed_lines") == 0, F.col("text")).otherwise(F.array_join(F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "removed_lines"),
        lambda i: F.get(lines, i)), "\n"))
    return (removed.withColumn("text", kept)
            .withColumn("n_lines", F.size(filled).cast("long"))
            .withColumn("n_removed", F.size("removed_lines").cast("long"))
            .select(*docs.columns, "n_lines", "n_removed", "removed_lines"))


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return line_dedup(docs).select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = f"""
WITH t AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS line_no FROM t),
f AS (SELECT doc_id, line_no, trim(line, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)) AS line FROM l
      WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS place,
             len(regexp_split_to_array(line, '[\\x20\\x09-\\x0D]+')) AS n_words FROM f),
s AS (SELECT *, row_number() OVER (PARTITION BY line ORDER BY doc_id, place) AS nth FROM n),
w AS (SELECT a.doc_id, a.place, {" || chr(10) || ".join(f"a{i}.line" for i in range(MIN_LINES))} AS run
      FROM (SELECT doc_id, place FROM n) a {" ".join(f"JOIN n a{i} ON a{i}.doc_id = a.doc_id AND a{i}.place = a.place + {i}" for i in range(MIN_LINES))}),
r AS (SELECT doc_id, place, row_number() OVER (PARTITION BY run ORDER BY doc_id, place) AS nth FROM w),
x AS (SELECT doc_id, place FROM s WHERE nth > 1 AND n_words >= {MIN_WORDS}
      UNION SELECT doc_id, place + k FROM r, (SELECT unnest(range({MIN_LINES})) AS k) WHERE nth > 1),
d AS (SELECT n.doc_id, n.line_no FROM x JOIN n ON n.doc_id = x.doc_id AND n.place = x.place),
k AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.line_no) AS kept
      FROM l LEFT JOIN d ON l.doc_id = d.doc_id AND l.line_no = d.line_no WHERE d.doc_id IS NULL GROUP BY l.doc_id),
c AS (SELECT doc_id, count(*) AS n FROM n GROUP BY doc_id),
e AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id)
SELECT t.doc_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_lines, CAST(coalesce(e.n, 0) AS BIGINT) AS n_removed,
       CASE WHEN t.text IS NOT NULL THEN sha256(coalesce(k.kept, '')) END AS kept_sha256
FROM t LEFT JOIN c ON c.doc_id = t.doc_id LEFT JOIN e ON e.doc_id = t.doc_id LEFT JOIN k ON k.doc_id = t.doc_id
"""
