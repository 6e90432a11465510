"""Word search in postings through a stored table of tokens.

The table files blocks of postings under the stems of their words: which postings of a block hold a word, by
number in the block, and at which places. One more row of each block, without a stem, lists the ids of its
postings, so an id is stored once and not with each word. The table is cut by a hash of the stem, so a search
opens the parts of its own stems and the one of ids, and reads their rows only; phrases are checked on places.
Stop words are not filed, but count as places.
"""

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolecall.functions import fixed_values as V
from rolecall.functions.stems import with_stems
from rolecall.operators.postings import search_text
from rolecall.sources.keyed import KeyedTable

TOKENS = "stem string, block bigint, ids array<bigint>, rows array<int>, places array<int>"
#: Postings of a block at most.
BLOCK = 1 << 14


def _block(postings: pa.RecordBatch, number: int) -> pa.RecordBatch:
    """A row for each word of the postings, in the order of postings and places, and one with their ids."""
    words = postings.column("words")
    lengths = pc.list_value_length(words).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    coded = words.flatten().dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False)
    left_out = pc.is_in(coded.dictionary, pa.array(["", *V.STOP_WORDS])).to_numpy(zero_copy_only=False)
    filed = np.flatnonzero(~left_out[code]) if len(code) else np.zeros(0, np.int64)
    filed = filed[np.argsort(code[filed], kind="stable")]
    counts = np.bincount(code[filed], minlength=len(coded.dictionary))
    found = np.flatnonzero(counts)
    ends = np.cumsum(counts[found])
    at = pa.array(np.concatenate([[0], ends, [len(filed)]]), pa.int32())  # the last row has no word
    none = pa.array(np.concatenate([np.zeros(len(found) + 1), [len(lengths)]]), pa.int32())
    return pa.RecordBatch.from_arrays([
        pa.array([*coded.dictionary.take(pa.array(found)).to_pylist(), None], pa.string()),
        pa.array(np.full(len(found) + 1, number), pa.int64()),
        pa.ListArray.from_arrays(none, postings.column("id")),
        pa.ListArray.from_arrays(at, pa.array(row[filed], pa.int32())),
        pa.ListArray.from_arrays(at, pa.array(place[filed], pa.int32()))],
        ["word", "block", "ids", "rows", "places"])


def _blocks(batches):
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK):
            yield _block(batch.slice(start, BLOCK), number)
            number += 1


def token_blocks(postings: DataFrame) -> DataFrame:
    """The rows of the table. No token is shuffled for them, and a word is stemmed once in a block.

    Postings are sorted first, so a task that runs again makes the same blocks.
    """
    texts = postings.select(F.col("id").cast("bigint").alias("id"), F.trim(search_text(postings)).alias("_text"))
    words = texts.sortWithinPartitions("id", "_text").select("id", F.split("_text", " ").alias("words"))
    rows = words.mapInArrow(_blocks, TOKENS.replace("stem", "word", 1))
    return with_stems(rows).select("stem", "block", "ids", "rows", "places")


def _tokens_of(blocks: DataFrame) -> DataFrame:
    """Block, id, stem and place of all tokens in rows of the table; a block's rows meet in one task."""
    # the lists of ids are empty in all rows of a block but one
    met = blocks.repartition("block").groupBy("block").agg(
        F.max("ids").alias("ids"),
        F.collect_list(F.when(F.col("stem").isNotNull(), F.struct("stem", "rows", "places"))).alias("words"))

    def tokens(word):
        return F.transform(word["rows"], lambda row, i: F.struct(
            F.get("ids", row).alias("id"), word["stem"].alias("stem"), F.get(word["places"], i).alias("place")))

    return met.select("block", F.explode(F.flatten(F.transform("words", tokens))).alias("_t")).select("block", "_t.*")


def posting_tokens(postings: DataFrame) -> DataFrame:
    """Stem, id and places in order of every posting and stem; ids are unique."""
    return _tokens_of(token_blocks(postings)).groupBy("block", "id", "stem").agg(
        F.array_sort(F.collect_list("place")).alias("places")).select("stem", "id", "places")


def store_tokens(postings: DataFrame, folder: str, parts: int = 256) -> KeyedTable:
    tokens = token_blocks(postings)
    schema = postings.sparkSession.createDataFrame([], TOKENS).schema
    return KeyedTable(folder, ("stem",), schema, parts).create(tokens)


def parse_search(query: str) -> list[list[tuple[bool, list[str]]]]:
    """Alternatives of (wanted, words): words are required, "quoted words" follow each other, -word must be
    absent, OR splits."""
    groups: list[list[tuple[bool, list[str]]]] = [[]]
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', query):
        if not minus and word.lower() == "or":
            groups.append([])
            continue
        found = re.findall(r"[^\W_]+", (phrase or word).lower())
        if found:
            groups[-1].append((not minus, found))
    return [g for g in groups if g]


def stems_of(spark: SparkSession, words: list[str]) -> dict[str, str]:
    """Stems of the words of a query; stop words have none."""
    kept = sorted({x for x in words if x not in V.STOP_WORDS})
    rows = with_stems(spark.createDataFrame([(x,) for x in kept], "word string")) if kept else None
    return {r.word: r.stem for r in rows.collect()} if kept else {}


def _holds(phrase: list[tuple[int, str]]) -> Column:
    """A posting's places hold the stems at the given distances."""
    at = {stem: F.try_element_at("found", F.lit(stem)) for _, stem in phrase}
    (first, stem), rest = phrase[0], phrase[1:]
    if not rest:
        return at[stem].isNotNull()

    def follows(p):
        test = F.lit(True)
        for place, other in rest:
            test = test & F.array_contains(at[other], p + (place - first))
        return test

    every = at[stem].isNotNull()
    for _, other in rest:
        every = every & at[other].isNotNull()
    return F.coalesce(every & F.exists(at[stem], follows), F.lit(False))


def token_search(postings: DataFrame, tokens: KeyedTable, query: str) -> DataFrame:
    """Postings that match a web search, by stems. Terms of stop words alone are left out; a query of
    nothing else matches nothing."""
    spark = postings.sparkSession
    groups = parse_search(query)
    stems = stems_of(spark, [x for g in groups for _, words in g for x in words])
    groups = [[(wanted, phrase) for wanted, words in g
               if (phrase := [(i, stems[x]) for i, x in enumerate(words) if x in stems])] for g in groups]
    groups = [g for g in groups if g]
    if not groups:
        return postings.limit(0)
    names = sorted(set(stems.values()))
    wanted = spark.createDataFrame([(s,) for s in names], "stem string")
    rows = tokens.read(spark, tokens.touched(wanted)).where(F.col("stem").isin(names))
    ids = tokens.read(spark, tokens.touched(spark.createDataFrame([(None,)], "stem string")))
    each = _tokens_of(rows.unionByName(ids.where(F.col("stem").isNull()))).groupBy("block", "id").agg(
        F.collect_list(F.struct("stem", "place")).alias("_all"))
    found = each.select("id", F.map_from_entries(F.transform(
        F.array_distinct(F.col("_all.stem")), lambda s: F.struct(s, F.array_sort(F.transform(
            F.filter("_all", lambda t: t["stem"] == s), lambda t: t["place"]))))).alias("found"))
    hit = F.lit(False)
    for g in groups:
        every = F.lit(True)
        for positive, phrase in g:
            every = every & (_holds(phrase) if positive else ~_holds(phrase))
        hit = hit | every
    if all(any(positive for positive, _ in g) for g in groups):
        return postings.join(found.where(hit).select("id"), "id", "left_semi").select(*postings.columns)
    # an alternative that only excludes also takes postings that hold none of the stems
    none = F.create_map().cast("map<string,array<int>>")
    rows = postings.join(found, "id", "left").withColumn("found", F.coalesce("found", none))
    return rows.where(hit).select(*postings.columns)
