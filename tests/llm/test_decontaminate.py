import random

import pytest
from pyspark.sql import functions as F

from glyphmill.llm import decontaminate as D


def cases():
    rng = random.Random(3)
    words = ["a", "b", "c", "dé", "E9", "f"]
    items = {1: "x y", 2: " ".join(rng.choices(words, k=15)), 3: None, 4: "...", 5: "A b-C", 6: " ".join(rng.choices(words, k=40)), 7: " ".join(f"w{i}" for i in range(20))}
    texts = {i: " ".join(rng.choices(words, k=rng.randrange(0, 60))) for i in range(60)}
    texts |= {100: None, 101: "", 102: items[2].replace(" ", ", "), 103: "X\ny", 104: "q " * 30000 + items[6] + " tail", 105: items[7], 106: "x", 107: " ".join(f"w{i}" for i in range(5, 18)) + " z" * 300}
    return texts, items


@pytest.mark.parametrize("limit", [1 << 20, 60])
def test_matches_brute_force(spark, limit):
    texts, items = cases()
    docs = spark.createDataFrame([(i, t, "clash", 5) for i, t in texts.items()], "doc_id long, text string, found string, n_words int").repartition(3)
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string").coalesce(1)
    df, found = D.contamination(docs, bench, keep=["doc_id"], limit=limit)
    got = {r.doc_id: r for r in df.select("doc_id", F.col(f"`{found}`.items").alias("ids"), *[c.alias(k) for k, c in D.verdict(found).items()]).collect()}
    want = D.brute(texts, items)
    assert {i: (r.n_words, r.n_hit, r.ids) for i, r in got.items()} == want
    assert all(r.items_sha256 == D.digest(r.ids) for r in got.values())
    assert got[104].contaminated is False and got[102].contaminated and got[105].longest_words == 20 and got[107].n_hit == 13
    left = D.decontaminate(docs, bench, limit=limit)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == {i for i, (n, h, _) in want.items() if not (h and 20 * h >= n)}


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert D.decontaminate(docs, bench).count() == 0
    docs = spark.createDataFrame([(None, "one two")], "doc_id long, text string")
    assert D.decontaminate(docs, bench).count() == 1
