"""URL filters: listed rules first, then association rules mined from labelled URLs.

An address is a set of tokens: its host and domain, the words of its host, path segments with numbers
blotted out, file ending, query keys. Spark's FP-growth finds token combinations that go with bad labels;
those with enough support and confidence become rules. A rule is filed under its rarest token, an
address looks its tokens up there, and a rule found so applies if all its tokens are there. Everything
is DataFrame code; identical token sets are matched once.
"""

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolecall.llm import words

#: Fixed values of the contract: verdict, host, path.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Share and number of labelled addresses that a combination with the bad label needs.
MIN_SUPPORT = 0.002
MIN_COUNT = 20
#: Share of a combination's labelled addresses that are bad, and how far above that of all addresses.
MIN_CONFIDENCE = 0.6
MIN_LIFT = 1.5
BAD = "label=bad"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of an address; both empty without ``://``."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    pattern = "(?s)://([^/?#]*)([^?#]*)"
    return F.translate(F.regexp_extract(text, pattern, 1), _UPPER, _LOWER), F.regexp_extract(text, pattern, 2)


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """verdict, host, path of listed rules as a table."""
    empty = spark.range(0).select(*[F.lit("").alias(c) for c in ("verdict", "host", "path")])
    if not rules:
        return empty
    return spark.range(1).select(F.inline(F.array(*[
        F.struct(F.lit(v).alias("verdict"), F.lit(h).alias("host"), F.lit(p).alias("path")) for v, h, p in rules])))


def _host_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """For each host the listed rules that fit it or a domain above it."""
    # a rule of so many labels fits the end of a host that has as many
    labels = rules.agg(F.max(F.size(F.split("host", "\\.")))).first()[0] or 1
    above = F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(labels)), lambda i: F.array_join(
        F.slice(F.split("host", "\\."), -F.least(i, F.size(F.split("host", "\\."))), i), ".")))
    listed = rules.select(F.col("host").alias("_above"), F.struct(
        F.length(F.concat("host", "path")).alias("length"), F.concat("host", "path").alias("rule"),
        F.col("path").alias("start"), "verdict").alias("listed"))
    return (hosts.withColumn("_above", F.explode(above)).join(listed, "_above")
            .groupBy("host").agg(F.collect_list("listed").alias("listed"))
            .select(F.col("host").alias("_host"), "listed"))


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """The distinct tokens of an address, sorted."""
    def tagged(tag: str, values: Column) -> Column:
        return F.transform(F.filter(values, lambda x: x != ""), lambda x: F.concat(F.lit(f"{tag}="), x))

    blotted = F.regexp_replace(F.translate(path, _UPPER, _LOWER), "[0-9]+", "#")
    query = F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), "(?s)[?]([^#]*)", 1)
    keys = F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1))
    return F.array_sort(F.array_distinct(F.concat(
        tagged("host", F.array(host)), tagged("domain", F.array(F.substring_index(host, ".", -2))),
        tagged("word", F.split(host, "[.-]")), tagged("path", F.split(blotted, "/")), tagged("key", keys))))


def token_items(labelled: DataFrame) -> DataFrame:
    """token, item of the tokens that enough labelled addresses have.

    Tokens that stand in the same addresses are one item, named by the least of them. All combinations of
    them have one support and confidence, so mining items finds what mining tokens does, without a rule
    for each choice among tokens that an address form always has together. Sets of addresses are told
    apart by their size and two 64-bit hashes.
    """
    found = labelled.select("row", F.explode("tokens").alias("token")).groupBy("token").agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("row")).alias("a"),
        F.bit_xor(F.xxhash64("row", F.lit(1))).alias("b")).where(F.col("n") >= MIN_COUNT)
    sets = ["n", "a", "b"]
    return found.join(found.groupBy(*sets).agg(F.min("token").alias("item")), sets).select("token", "item")


def with_items(table: DataFrame, key: str, items: DataFrame) -> DataFrame:
    """The key and the distinct items of each row's tokens, sorted; a row without any has an empty array."""
    return (table.select(key, F.explode_outer("tokens").alias("token")).join(items, "token", "left")
            .groupBy(key).agg(F.array_sort(F.collect_set("item")).alias("items")))


def mine_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE,
               min_lift: float = MIN_LIFT) -> DataFrame:
    """items, confidence, lift, support of the combinations that go with bad addresses.

    ``labelled`` has items and bad. A combination needs ``MIN_COUNT`` bad addresses, however small the
    table, so that chance makes no rule.
    """
    counts = labelled.agg(F.count("*").alias("n"), F.count_if("bad").alias("bad")).first()
    if counts["bad"] < MIN_COUNT:
        return labelled.sparkSession.range(0).select(
            F.array(F.lit("")).alias("items"), *[F.lit(0.0).alias(c) for c in ("confidence", "lift", "support")])
    min_support = max(min_support, MIN_COUNT / counts["n"])
    baskets = labelled.select(F.when(F.col("bad"), F.concat("items", F.array(F.lit(BAD)))).otherwise(
        F.col("items")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets)
    return (model.associationRules.where((F.col("consequent")[0] == BAD) & (F.col("lift") >= min_lift))
            .select(F.array_sort("antecedent").alias("items"), "confidence", "lift", "support"))


def url_filter(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES,
               min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE,
               min_lift: float = MIN_LIFT) -> DataFrame:
    """Allow or block every page by its address.

    ``labels`` has doc_id, quality and toxic; an address whose last path segment is a document's number
    takes that document's label, and is bad if quality is 0 or toxic is 1 (null: neither). Returns one
    row per input row: page_id, host, path, rule (the longest listed rule that fits, else null), mined_rule
    (items of the matching mined rule of highest confidence, else null; an item is the least of some tokens
    that labelled addresses have together) and verdict: the listed rule's,
    else block if a mined rule matches, else allow. A null address or one without ``://`` has empty host
    and path and is matched by no listed rule. Other columns are left out.
    """
    spark = pages.sparkSession
    host, path = host_and_path(F.col("url"))
    number = F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), "/([0-9]{1,18})(?:\\.[a-z]+|/)?(?:[?#].*)?$", 1)
    split = pages.select("page_id", F.col("url").cast("string").alias("url"), host.alias("host"), path.alias("path"))
    tokened = words.stored(split.select(
        "page_id", "host", "path", F.when(number != "", number).cast("long").alias("number"),
        url_tokens(F.col("url"), F.col("host"), F.col("path")).alias("tokens")), "urls")
    judged = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("number")).agg(
        F.max(F.coalesce((F.col("quality") == 0) | (F.col("toxic") == 1), F.lit(False))).alias("bad"))
    labelled = words.stored(tokened.where("number IS NOT NULL").join(judged, "number").select(
        F.monotonically_increasing_id().alias("row"), "tokens", "bad"), "labelled")
    items = words.stored(token_items(labelled), "items")
    baskets = with_items(labelled, "row", items).join(labelled.select("row", "bad"), "row").select("items", "bad")
    mined = words.stored(mine_rules(words.stored(baskets, "baskets"), min_support, min_confidence, min_lift)
                         .withColumn("rule_id", F.monotonically_increasing_id()), "mined")
    # the inverted index files each rule under its rarest item
    sets = words.stored(tokened.groupBy("tokens").agg(F.count("*").alias("pages")).withColumn(
        "set", F.monotonically_increasing_id()), "sets")
    held = words.stored(with_items(sets, "set", items).join(sets.select("set", "pages"), "set"), "set-items")
    item_pages = held.select(F.explode("items").alias("item"), "pages").groupBy("item").agg(F.sum("pages").alias("n"))
    index = (mined.select("rule_id", "items", "confidence", F.explode("items").alias("item"))
             .join(item_pages, "item").groupBy("rule_id")
             .agg(F.min_by("item", F.struct("n", "item")).alias("item"), F.first("items").alias("rule_items"),
                  F.first("confidence").alias("confidence")))
    hits = (held.select("set", "items", F.explode("items").alias("item")).join(index.drop("rule_id"), "item")
            .where(F.size(F.array_except("rule_items", "items")) == 0)
            .groupBy("set").agg(F.max_by("rule_items", F.struct("confidence", "rule_items")).alias("mined_rule"))
            .join(sets.select("set", F.col("tokens").alias("_tokens")), "set").drop("set"))
    listed = _host_rules(tokened.select("host").distinct(), rule_table(spark, rules))
    joined = (tokened.join(listed, F.col("host") == F.col("_host"), "left")
              .join(hits, F.col("tokens") == F.col("_tokens"), "left"))
    longest = F.array_max(F.filter("listed", lambda x: F.col("path").startswith(x["start"])))
    return joined.withColumn("_longest", longest).select(
        "page_id", "host", "path", F.col("_longest.rule").alias("rule"), "mined_rule",
        F.coalesce(F.col("_longest.verdict"), F.when(F.col("mined_rule").isNotNull(), "block").otherwise("allow")).alias("verdict"))


def op2_url_filters(spark, sf_dir: str) -> DataFrame:
    return url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
