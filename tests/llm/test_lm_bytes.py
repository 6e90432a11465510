"""One way at every size, and how many bytes it sends."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rolecall.llm import lm_scoring

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("n", [0, 1, 1000])
def test_sequences_and_counts_come_back(n):
    random = np.random.default_rng(3)
    one = np.unique(random.integers(0, 2**64, n, dtype=np.uint64))
    two = np.unique(random.integers(0, 2**48, 2 * n, dtype=np.uint64))
    parts = (one, random.integers(0, 2**32, len(one))), (two, np.zeros(len(two), np.int64))
    got = lm_scoring._unpacked(lm_scoring._packed(*parts))
    assert [[x.tolist() for x in part] for part in got] == [[x.tolist() for x in part] for part in parts]


def test_what_is_sent_stays_near_the_entropy_of_its_hashes(spark):
    texts = lm_scoring._held_out(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").coalesce(1)).cache()
    blocks = texts.mapInArrow(lm_scoring._tokenized, lm_scoring._BLOCKS).cache()
    size, own = (t.agg(F.sum(F.length(F.encode(c, "UTF-8") if c == "text" else c))).first()[0]
                 for t, c in ((texts, "text"), (blocks, "own")))
    asked = [r.asked for r in blocks.select("block", "own").mapInArrow(lm_scoring._ask(8), lm_scoring._ASKED).collect()]
    held = [sum(len(part[n][0]) for part in map(lm_scoring._unpacked, asked)) for n in (0, 1)]
    sent = sum(map(len, asked))
    assert sent < 5 * held[1] + 7 * held[0]  # as whole numbers 6 a pair and 8 a word, counts not included
    assert 2 * own + sent < 2 * size  # blocks are stored and sent once each


def test_no_filter_is_sent_unless_asked_for(spark, monkeypatch):
    def refuse(*_):
        raise AssertionError("broadcast")

    monkeypatch.setattr(type(spark.sparkContext), "broadcast", refuse)
    assert lm_scoring.op5_lm_scoring(spark, FOLDER).count() == spark.read.parquet(f"{FOLDER}/documents.parquet").count()


def test_buckets_grow_with_the_input(spark, monkeypatch):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    few = {r.doc_id: r for r in lm_scoring.score_texts(docs).collect()}
    made = []
    monkeypatch.setattr(lm_scoring, "BUCKET", 200)
    learn = lm_scoring._learn_and_answer
    monkeypatch.setattr(lm_scoring, "_learn_and_answer", lambda n: made.append(n) or learn(n))
    many = {r.doc_id: r for r in lm_scoring.score_texts(docs.repartition(3)).collect()}
    assert made[0] > 2 * int(spark.conf.get("spark.sql.shuffle.partitions")) and few.keys() == many.keys()
    for i, r in few.items():
        assert many[i][:5] == r[:5] and many[i].base_score == pytest.approx(r.base_score, rel=1e-9)


def test_a_bucket_is_probed_once_for_all_blocks(monkeypatch):
    grams = np.unique(np.random.default_rng(4).integers(0, 2**48, 500, dtype=np.uint64))
    asked = [lm_scoring._packed((grams[i::50], np.ones(len(grams[i::50]), int)), (grams[:i], np.ones(i, int)))
             for i in range(50)]
    probed = []
    levels = lm_scoring.Filter.levels
    monkeypatch.setattr(lm_scoring.Filter, "levels", lambda self, x, n: probed.append(len(x)) or levels(self, x, n))
    out = lm_scoring._learn_and_answer(1)(pd.DataFrame({"bucket": 0, "block": range(50), "asked": asked}))
    assert probed == [len(grams), 50 * 49 // 2] and out["block"].tolist() == [*range(50), -1]
    for i, row in enumerate(out.itertuples()):
        if row.block >= 0:
            counts, end = lm_scoring._counts(lm_scoring._whole(row.words))
            assert counts.tolist() == [1] * len(grams[i::50])
            found = np.frombuffer(lm_scoring._whole(row.pairs), "u1")
            assert (found >= [int(49 - j).bit_length() for j in range(i)]).all()  # never below the true one
