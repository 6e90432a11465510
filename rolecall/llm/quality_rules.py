"""Quality rules with thresholds that adapt to each language and source.

Measures of a text are built-in expressions on its row. Their quartiles come from quantile sketches
(``percentile_approx``), which Spark builds in every task and merges, per language and source, and per
language for the groups too small to speak for themselves. A text passes if each measure lies within
its group's fences. Everything is DataFrame code.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolecall.llm import words

#: Measure, side of the fence, and least spread between quartiles that counts.
MEASURES = {
    "word_length": ("both", 0.3),
    "symbols_per_word": ("above", 0.04),
    "dup_line_share": ("above", 0.1),
    "repeat_word_share": ("above", 0.1),
}
#: Spreads beyond the quartiles that a text may lie.
REACH = 5.0
#: Texts that a group needs for thresholds of its own.
LEAST = 100
#: Rank error of the sketches is one over this.
ACCURACY = 10_000

SYMBOLS = "#*$%&|<>"
_WHITE = " \t\n\x0b\f\r"


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("source").cast("string"),
                       text.alias("text"))
    split = base.select(
        "doc_id", "lang", "source",
        F.array_remove(F.split("text", words.SPACES), "").alias("w"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.length(F.translate("text", _WHITE, "")).cast("long").alias("word_chars"),
        F.filter(F.split("text", "\n"), lambda line: line.rlike("[^\\x20\\x09-\\x0D]")).alias("lines"))
    windows = split.select(
        "doc_id", "lang", "source", "n_symbols", "word_chars", F.size("w").cast("long").alias("n_words"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        # three words that follow one another, with their place, in the order of their hash
        F.sort_array(F.transform(
            F.slice("w", F.lit(1), F.greatest(F.size("w") - 2, F.lit(0))),
            lambda word, i: F.struct(F.xxhash64(word, F.get("w", i + 1), F.get("w", i + 2)).alias("h"),
                                     i.alias("i")))).alias("sorted"))
    again = windows.withColumn("again", F.sort_array(F.transform(
        F.filter("sorted", lambda x, i: (F.get("sorted", i + 1)["h"] == x["h"])
                 | ((i > 0) & (F.get("sorted", i - 1)["h"] == x["h"]))),
        lambda x: x["i"]))).drop("sorted")
    repeats = F.aggregate(
        F.transform("again", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("again", i + 1) - p, F.lit(3)))),
        F.lit(0).cast("long"), lambda a, x: a + x)
    out = again.withColumn("n_repeat_words", repeats).drop("again")
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _ratios() -> dict[str, Column]:
    n = F.col("n_words")
    return {
        "word_length": F.col("word_chars") / n,
        "symbols_per_word": F.col("n_symbols") / n,
        "dup_line_share": F.col("n_dup_lines") / n,
        "repeat_word_share": F.col("n_repeat_words") / n,
    }


def fences(measured: DataFrame, *keys: str, accuracy: int = ACCURACY) -> DataFrame:
    """Per group: number of texts with a word, and lower and upper fence of each measure."""
    ratios = measured.where("n_words > 0").select(*keys, *[c.alias(m) for m, c in _ratios().items()])
    quartiles = ratios.groupBy(*keys).agg(F.count("*").alias("texts"), *[
        F.percentile_approx(m, [0.25, 0.75], accuracy).alias(m) for m in MEASURES])
    bounds = []
    for m, (side, least) in MEASURES.items():
        low, high = F.col(m)[0], F.col(m)[1]
        spread = REACH * F.greatest(high - low, F.lit(least))
        bounds += [(low - spread if side == "both" else F.lit(None).cast("double")).alias(f"{m}_from"),
                   (high + spread).alias(f"{m}_to")]
    return quartiles.select(*keys, "texts", *bounds)


def quality_filter(docs: DataFrame, least: int = LEAST, accuracy: int = ACCURACY) -> DataFrame:
    """Judge every text; returns one row per input row.

    Columns: doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed and kept. A text that fails the base rule (under 50 words, or over half of its words in
    repeated three-word windows) is not kept; another is kept if every measure lies within the fences
    of its language and source, or of its language where the group has fewer than ``least`` texts. A
    null text has no words. Null language or source form groups of their own. Repeated rows count as
    often as they occur. Other columns are left out.
    """
    measured = words.stored(measures(docs), "quality")
    names = [f"{m}_{x}" for m in MEASURES for x in ("from", "to")]
    wide = fences(measured, "lang", accuracy=accuracy).select(
        F.col("lang").alias("_lang"), *[F.col(n).alias(f"_wide_{n}") for n in names])
    near = fences(measured, "lang", "source", accuracy=accuracy).where(F.col("texts") >= least).select(
        F.col("lang").alias("_own_lang"), F.col("source").alias("_own_source"),
        *[F.col(n).alias(f"_own_{n}") for n in names])
    joined = (measured.join(wide, F.col("lang").eqNullSafe(F.col("_lang")), "left")
              .join(near, F.col("lang").eqNullSafe(F.col("_own_lang"))
                    & F.col("source").eqNullSafe(F.col("_own_source")), "left"))
    inside = F.lit(True)
    for m, c in _ratios().items():
        for side, ok in (("from", lambda c, b: c >= b), ("to", lambda c, b: c <= b)):
            bound = F.when(F.col("_own_lang").isNotNull() | F.col("_own_source").isNotNull()
                           | F.col(f"_own_{m}_to").isNotNull(), F.col(f"_own_{m}_{side}")
                           ).otherwise(F.col(f"_wide_{m}_{side}"))
            inside &= F.when(F.col("n_words") > 0, F.coalesce(ok(c, bound), F.lit(True))).otherwise(F.lit(False))
    return joined.select(*measured.columns, (~F.col("base_failed") & inside).alias("kept"))


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_filter(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("lang", "source")


_BASE = """
WITH t AS (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, lang, source, text,
             list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM t),
p AS (SELECT doc_id, unnest(range(1, greatest(len(w) - 1, 1))) AS i, w FROM w WHERE len(w) >= 3),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM p),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g),
c AS (SELECT DISTINCT doc_id, i + k AS word FROM r, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1),
m AS (SELECT doc_id, count(*) AS n FROM c GROUP BY doc_id),
f AS (SELECT w.doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(m.n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN m USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f),
"""


def _oracle() -> str:
    parts = {"word_length": "word_chars", "symbols_per_word": "n_symbols", "dup_line_share": "n_dup_lines",
             "repeat_word_share": "n_repeat_words"}
    ratio = {m: f"CAST({c} AS DOUBLE) / n_words" for m, c in parts.items()}

    def group(name, keys):
        ranks = ", ".join(f"row_number() OVER (PARTITION BY {keys} ORDER BY {r}) AS r_{m}" for m, r in ratio.items())
        picked = ", ".join(
            f"max(CASE WHEN r_{m} = greatest(1, ceil({q} * n)) THEN {ratio[m]} END) AS {m}_{i}"
            for m in ratio for i, q in ((1, 0.25), (3, 0.75)))
        return (f"{name}r AS (SELECT *, count(*) OVER (PARTITION BY {keys}) AS n, {ranks} FROM b WHERE n_words > 0),\n"
                f"{name} AS (SELECT {keys}, max(n) AS texts, {picked} FROM {name}r GROUP BY {keys})")

    tests = []
    for m, (side, least) in MEASURES.items():
        q1, q3 = (f"CASE WHEN near.texts >= {LEAST} THEN near.{m}_{i} ELSE wide.{m}_{i} END" for i in (1, 3))
        value = f"CAST(b.{parts[m]} AS DOUBLE) / b.n_words"
        spread = f"{REACH} * greatest(({q3}) - ({q1}), {least})"
        tests.append(f"{value} <= ({q3}) + {spread}")
        if side == "both":
            tests.append(f"{value} >= ({q1}) - {spread}")
    return (_BASE + group("wide", "lang") + ",\n" + group("near", "lang, source") + f"""
SELECT b.doc_id, b.n_words, b.word_chars, b.n_symbols, b.n_dup_lines, b.n_repeat_words, b.base_failed,
       NOT b.base_failed AND b.n_words > 0 AND {' AND '.join(f'({t})' for t in tests)} AS kept
FROM b LEFT JOIN wide ON b.lang IS NOT DISTINCT FROM wide.lang
LEFT JOIN near ON b.lang IS NOT DISTINCT FROM near.lang AND b.source IS NOT DISTINCT FROM near.source
""")


ORACLE = _oracle()
