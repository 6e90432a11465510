"""Stems of English words as column expressions: the second Porter algorithm, published by the Snowball project.

Every step is a projection of its own, so no expression is copied into the next and all run as generated
code. Words are lower case, without apostrophes.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolecall.functions import fixed_values as V

VOWEL, OTHER = "[aeiouy]", "[^aeiouy]"
#: A short syllable at the end of a word.
SHORT = f"(?:{OTHER}{VOWEL}[^aeiouywxY]|^{VOWEL}{OTHER})$"


def w() -> Column:
    """The word as the steps so far have left it."""
    return F.col("_w")


def r1() -> Column:
    """Where its first region begins."""
    return F.col("_r1")


def r2() -> Column:
    return F.col("_r2")



def _without(count: int, ending: str = "") -> Column:
    return F.concat(F.substring(w(), 1, F.length(w()) - count), F.lit(ending))


def _inside(region: Column, ending: str) -> Column:
    """The ending lies in the region."""
    return F.length(w()) - len(ending) >= region


def _longest(endings, region: Column, become, also=None) -> Column:
    """The longest ending the word has is replaced if it lies in the region and ``also`` holds; else nothing is."""
    out = F
    for e in sorted(endings, key=len, reverse=True):
        test = _inside(region, e) & (also or {}).get(e, F.lit(True))
        out = out.when(w().endswith(e), F.when(test, _without(len(e), become(e))).otherwise(w()))
    return out.otherwise(w())


def _region(text: Column) -> Column:
    """Characters up to and with the first non-vowel after a vowel; all of them without one."""
    found = F.length(F.regexp_extract(text, f"^({OTHER}*{VOWEL}+{OTHER})", 1))
    return F.when(found > 0, found).otherwise(F.length(text))


def _plural() -> Column:
    return (F.when(w().endswith("sses"), _without(2))
            .when(w().rlike("ie[ds]$"), F.when(F.length(w()) > 4, _without(2)).otherwise(_without(1)))
            .when(w().rlike("[us]s$"), w())
            .when(w().rlike(f"{VOWEL}.+s$"), _without(1)).otherwise(w()))


def _past() -> Column:
    """Without ed, ing and the like; ``_cut`` tells that one went."""
    return (F.when(w().endswith("eedly"), F.when(_inside(r1(), "eedly"), _without(3)).otherwise(w()))
            .when(w().endswith("eed"), F.when(_inside(r1(), "eed"), _without(1)).otherwise(w()))
            .otherwise(F.regexp_replace(w(), f"^(.*{VOWEL}.*?)(?:ingly|edly|ing|ed)$", "$1")))


def _mended() -> Column:
    """What is left of a word whose ed or ing went, made a word again."""
    return (F.when(w().rlike("(?:at|bl|iz)$"), F.concat(w(), F.lit("e")))
            .when(w().rlike("(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)$"), _without(1))
            .when((r1() >= F.length(w())) & w().rlike(SHORT), F.concat(w(), F.lit("e"))).otherwise(w()))


def _last() -> Column:
    keep = F.substring(w(), 1, F.length(w()) - 1).rlike(SHORT)
    return (F.when(w().endswith("e"), F.when(_inside(r2(), "e") | (_inside(r1(), "e") & ~keep), _without(1)).otherwise(w()))
            .when(w().endswith("ll") & _inside(r2(), "l"), _without(1)).otherwise(w()))


def with_stems(words: DataFrame, word: str = "word", name: str = "stem") -> DataFrame:
    """The table with the stem of each word. Words of one or two letters are their own stems, null has none."""
    fixed = F.create_map(*[F.lit(x) for pair in V.STEM_EXCEPTIONS.items() for x in pair])
    rows = words.withColumn("_set", F.coalesce(
        F.try_element_at(fixed, F.col(word)), F.when(F.length(word) <= 2, F.col(word))))
    # y is a consonant at the start and after a vowel, and then written Y
    marked = F.regexp_replace(F.regexp_replace(F.col(word), "^y", "Y"), f"({VOWEL})y", "$1Y")
    rows = rows.withColumn("_w", marked)
    start = F.length(F.regexp_extract(w(), f"^({'|'.join(V.STEM_PREFIXES)})", 1))
    rows = rows.withColumn("_r1", F.when(start > 0, start).otherwise(_region(w())))
    rows = rows.withColumn("_r2", r1() + _region(F.expr("substring(_w, _r1 + 1)")))
    rows = rows.withColumn("_w", _plural())
    rows = rows.withColumn("_set", F.coalesce("_set", F.when(w().isin(V.STEM_LEFT_AFTER_PLURAL), w())))
    rows = rows.withColumn("_before", w()).withColumn("_w", _past())
    cut = (w() != F.col("_before")) & ~F.col("_before").rlike("eed(?:ly)?$")
    rows = rows.withColumn("_w", F.when(cut, _mended()).otherwise(w()))
    rows = rows.withColumn("_w", F.regexp_replace(w(), f"^(.+{OTHER})[yY]$", "$1i"))
    rows = rows.withColumn("_w", _longest(V.STEM_STEP_2, r1(), V.STEM_STEP_2.get, {
        "ogi": w().endswith("logi"), "li": w().rlike("[cdeghkmnrt]li$")}))
    rows = rows.withColumn("_w", _longest(V.STEM_STEP_3, r1(), V.STEM_STEP_3.get, {"ative": _inside(r2(), "ative")}))
    rows = rows.withColumn("_w", _longest(V.STEM_STEP_4, r2(), lambda e: "", {"ion": w().rlike("[st]ion$")}))
    rows = rows.withColumn("_w", _last())
    # always true, but no filter on stems moves through it: below, it would copy each step into the next
    kept = F.monotonically_increasing_id() >= 0
    return rows.select(*words.columns, F.when(kept, F.coalesce("_set", F.lower("_w"))).alias(name))
