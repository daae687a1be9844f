import os

import duckdb
import pytest

from glyphmill.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return c


def tidy(v):
    return round(v, 9) if isinstance(v, float) else v if isinstance(v, (int, str, type(None))) else str(v)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")
@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_equals_sql(spark, con, name):
    df = catalogue.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(tidy(r[c]) for c in columns) for r in df.collect()), key=repr)
    cur = con.execute(catalogue.ORACLES[name])
    found = [x[0] for x in cur.description]
    assert sorted(found) == columns
    at = [found.index(c) for c in columns]
    assert got == sorted((tuple(tidy(r[i]) for i in at) for r in cur.fetchall()), key=repr)


def test_no_python_in_plans(spark):
    for name, fn in catalogue.QUERIES.items():
        plan = fn(spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "CartesianProduct" not in plan, name


def test_whole_tables(spark, con):
    rows = dict(catalogue.QUERIES["text_histogram"](spark, DATA).collect())
    assert sum(rows.values()) == con.execute("SELECT sum(length(text)) FROM documents").fetchone()[0] and any(ord(c) > 127 for c in rows)
    assert catalogue.QUERIES["similar_supplier"](spark, DATA).count() > 10


@pytest.mark.parametrize("names", [["bg_s", "bg_t", "c10s1", "xx", "bb"], ["nothing alike"], ["ab", "ab"], []])
def test_similar_unique_is_best_unique_over_all_pairs(spark, names):
    from pyspark.sql import functions as F

    from glyphmill.operators import pairing as P

    left = spark.createDataFrame([(i, s) for i, s in enumerate(["bg0_s", "c10s1a0", "b", "", "ab", "bbb", "zéé", None])], "k long, stem string")
    right = spark.createDataFrame([*enumerate(names)], "o long, name string")
    score, lcp = P.similarity(F.col("stem"), F.col("name"))
    pairs = left.where("stem IS NOT NULL").crossJoin(right).select("k", "o", score.alias("score"), lcp.alias("lcp"))
    want = P.best_unique(pairs, ["k"], "score", "lcp", ["o"], 2).select("k", "o", "score").collect()
    assert sorted(P.similar_unique(left, "k", "stem", right, "o", "name", 2).collect()) == sorted(want)
