"""Counts beyond 32 bits, and the score against sums over the exact size classes."""

import collections
import math
import re
import zlib

import numpy as np
import pandas as pd
import pytest

from rolecall.llm import lm_scoring

LARGE = [1, 7, 2**32 - 1, 2**32, 2**32 + 7, 5, 2**40 + 3]


@pytest.mark.parametrize("counts", [LARGE, [], [3], [2**33]])
def test_counts_of_any_size_come_back(counts):
    counts = np.array(counts, np.int64)
    blob = lm_scoring._count_bytes(counts) + b"after"
    got, end = lm_scoring._counts(b"1234" + blob, 4)
    assert got.tolist() == counts.tolist() and (b"1234" + blob)[end:] == b"after"
    grams = np.sort(np.random.default_rng(1).integers(0, 2**64, len(counts), dtype=np.uint64))
    back, counts_back = lm_scoring._unpack(lm_scoring._pack(grams, counts))
    assert back.tolist() == grams.tolist() and counts_back.tolist() == counts.tolist()


def test_small_counts_take_four_bytes():
    assert len(lm_scoring._count_bytes(np.ones(1000, np.int64))) == 4008


def test_large_counts_are_summed_and_looked_up():
    grams = np.sort(np.random.default_rng(2).integers(0, 2**48, len(LARGE), dtype=np.uint64))
    counts = np.array(LARGE, np.int64)
    one = lm_scoring._pack(grams, counts)
    made = lm_scoring._segment()(pd.DataFrame({"n": [1, 1], "bucket": [0, 0], "grams": [one, one]}))
    assert made["total"][0] == 2 * sum(LARGE)
    entries = grams[::-1].astype("<u8").tobytes() + np.arange(len(grams), dtype="<u4").tobytes()
    asked = pd.DataFrame({"block": [-1, 3], "entries": [made["exact"][0], entries], "docs": [None, None]})
    (blob,) = lm_scoring._lookup(asked)["found"]
    found, end = lm_scoring._counts(blob)
    assert found.tolist() == [2 * c for c in LARGE[::-1]]
    assert np.frombuffer(blob, "<u4", -1, end).tolist() == list(range(len(LARGE)))
    group = pd.DataFrame({"bucket": [0, 0], "block": [-1, 9], "words": [made["exact"][0], grams.tobytes()],
                          "pairs": [made["segment"][0], b""], "bits": [made["bits"][0], None], "docs": [None, None]})
    (answer,) = lm_scoring._answer(1)(group)["words"]
    found, end = lm_scoring._counts(answer)
    assert found.tolist() == [2 * c for c in LARGE]
    # the filter never gives a level below the true one
    levels = np.frombuffer(answer, "u1", -1, end)
    assert (levels >= [int(2 * c).bit_length() for c in LARGE]).all()


def test_scores_are_those_of_exact_size_classes(spark):
    """The filter may take a pair that never occurred for a rare one; nothing else differs."""
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = {i: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower)), None] for i, t in docs.items()}
    one, two = collections.Counter(), collections.Counter()
    for i, x in tokens.items():
        if zlib.crc32(str(i).encode()) % 10:
            one.update(x)
            two.update(zip([None, *x], x))
    norm = sum(one.values()) + lm_scoring.ADDED * (len(one) + 1)

    def middle(n):
        return 1.5 * 2 ** (n.bit_length() - 1) - 0.5 if n else 0.0

    def score(x):
        out = 0.0
        for before, token in zip([None, *x], x):
            b, o, t = middle(one[before]), middle(one[token]), middle(two[before, token])
            out += math.log10((min(t, b) + lm_scoring.PRIOR * (o + lm_scoring.ADDED) / norm) / (b + lm_scoring.PRIOR))
        return out

    got = {r.doc_id: r.score for r in lm_scoring.op5_lm_scoring(spark, "/root/testdata/sf0.001").collect()}
    apart = {i: abs(got[i] / score(x) - 1) for i, x in tokens.items()}
    assert got.keys() == docs.keys() and sorted(apart.values())[len(apart) // 2] < 0.01
    # a text that repeats one such pair moves further
    assert sum(x > 0.05 for x in apart.values()) < 0.03 * len(apart)
