"""Tokens that always come together are mined as one item."""

import random

import pytest
from pyspark.sql import functions as F

from rolecall.llm import url_filters


def addresses(seed, n=900):
    chance = random.Random(seed)
    out = []
    for i in range(n):
        kind = chance.choice(["shop", "blog", "plain"])
        if kind == "shop":
            url = f"https://www.my-shop.example.co.uk/en/sale/{chance.choice(['cheap', 'deals'])}/{i}?utm=1&ref=2"
        elif kind == "blog":
            url = f"https://{chance.choice(['a', 'b', 'c'])}.blog.org/{chance.choice(['win', 'news', 'en'])}/post/{i}"
        else:
            url = f"https://site{i % 7}.net/{chance.choice(['x', 'y', 'win'])}/{i}.html"
        bad = chance.random() < (0.9 if "cheap" in url or "win" in url else 0.1)
        out.append((i, url, bad))
    return out


def run(spark, rows):
    pages = spark.createDataFrame([(i, u) for i, u, _ in rows], "page_id long, url string")
    labels = spark.createDataFrame([(i, 1, int(b)) for i, _, b in rows if b is not None], "doc_id long, quality int, toxic int")
    return {r.page_id: r.verdict for r in url_filters.url_filter(pages, labels, ()).collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_verdicts_are_those_of_all_single_tokens(spark, monkeypatch, seed):
    rows = addresses(seed)
    got = run(spark, rows)
    monkeypatch.setattr(url_filters, "token_items", lambda labelled: labelled.select(
        F.explode("tokens").alias("token")).distinct().withColumn("item", F.col("token")))
    assert got == run(spark, rows) and 100 < sum(v == "block" for v in got.values()) < 800


def test_rules_of_an_address_form_do_not_multiply(spark):
    deep = "/".join(f"part{chr(97 + k)}" for k in range(20))
    rows = [(i, f"https://www.one-shop.example.com/{deep}/{i}?k=1&l=2", True) for i in range(60)]
    rows += [(i, f"https://other{i}.net/{i}", False) for i in range(60, 200)]
    tokens = url_filters.url_tokens(F.col("url"), *url_filters.host_and_path(F.col("url")))
    labelled = spark.createDataFrame(rows, "row long, url string, bad boolean").withColumn("tokens", tokens)
    items = url_filters.token_items(labelled)
    assert items.count() >= 25 and items.select("item").distinct().count() <= 3
    baskets = url_filters.with_items(labelled, "row", items).join(labelled.select("row", "bad"), "row")
    assert url_filters.mine_rules(baskets).count() <= 4
    got = run(spark, rows)
    assert {i for i, v in got.items() if v == "block"} == set(range(60))
    # one token of the form is enough for an address without a label, as it is with a rule for each token
    more = rows + [(900, "https://new.elsewhere.org/parta/900", None), (901, "https://new.elsewhere.org/none/901", None)]
    found = run(spark, more)
    assert (found[900], found[901]) == ("block", "allow")


def test_rows_without_frequent_tokens_keep_their_weight(spark):
    labelled = spark.createDataFrame([(1, ["a"]), (2, []), (3, None)], "row long, tokens array<string>")
    items = spark.createDataFrame([("a", "a")], "token string, item string")
    got = {r.row: r["items"] for r in url_filters.with_items(labelled, "row", items).collect()}
    assert got == {1: ["a"], 2: [], 3: []}
