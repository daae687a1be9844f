import hashlib
import random
import re

from pyspark.sql import functions as F

from glyphmill.llm import lines as L


def brute(rows, min_words):
    """Every repeated run, by brute force: line i of a document goes if it lies in a qualifying run with an earlier copy."""
    docs = sorted({(i is not None, i or 0, hashlib.md5(t.encode()).digest(), t) for i, t in rows if t is not None})
    first, gone = {}, {}
    for d, (*_, t) in enumerate(docs):
        ls = t.split("\n")
        n = [len(re.findall("[^ \t-\r]+", x)) for x in ls]
        for s in range(len(ls)):
            for e in range(s + 1, len(ls) + 1):
                if sum(n[s:e]) >= min_words:
                    run = tuple(ls[s:e])
                    if run in first:
                        gone.setdefault(d, set()).update(range(s, e))
                    else:
                        first[run] = (d, s)
    out = {}
    for d, (has, i, _, t) in enumerate(docs):
        out[(i if has else None, t)] = "\n".join(x for j, x in enumerate(t.split("\n")) if j not in gone.get(d, ()))
    return out


def rows():
    rng = random.Random(8)
    pool = [" ".join(rng.choice("abcdef") for _ in range(k)) for k in (0, 1, 2, 3, 5, 9, 14)] + ["ünïcode wörds", " ", "\t"]
    out = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(0, 14)))) for i in range(40)]
    long = "\n".join(f"line {j} of it" for j in range(40))
    out += [(100, long), (101, long), (102, "x\n" + long), (103, long + "\ny"), (None, long), (104, "a b c\n" * 30), (105, None), (106, ""), (3, "twice " * 20), (3, "twice " * 20), (4, "solo\r\nx")]
    return out


def test_brute_force(spark):
    data = rows()
    docs = spark.createDataFrame([(i, t, "k") for i, t in data], "doc_id long, text string, lines string").repartition(4)
    for least in (4, 12):
        df, name = L.mark(docs, min_words=least)
        assert name == "lines_"
        want = brute(data, least)
        got = df.select("doc_id", "text", F.col(f"{name}.text").alias("clean"), F.col(f"{name}.n_deleted").alias("n")).collect()
        assert len(got) == len(data)
        for r in got:
            assert r.clean == (None if r.text is None else want[(r.doc_id, r.text)]), (least, r)
    left = L.dedup(docs, min_words=4)
    assert left.columns == docs.columns


def test_empty_and_native(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    df = L.dedup(docs)
    assert df.count() == 0
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
