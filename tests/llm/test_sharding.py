import random
import zlib

from glyphmill.llm import sharding as S


def check(spark, rows, tolerance):
    df = spark.createDataFrame(rows, "doc_id long, size long, g long, shard_note string").repartition(4)
    got = S.shard(df, key="doc_id", size="size", group="g").collect()
    assert sorted(((r.doc_id, r["size"], r.g) for r in got), key=repr) == sorted(((a, b, c) for a, b, c, _ in rows), key=repr)
    held, slots = {}, {}
    for r in got:
        held[r.shard] = held.get(r.shard, 0) + r["size"]
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    if tolerance is not None:
        assert set(held) == set(range(8)) and max(held.values()) - min(held.values()) <= tolerance
    return got


def test_even_bytes(spark):
    rng = random.Random(1)
    check(spark, [(i, rng.choice([1, 5, 900, 20000]), rng.getrandbits(60), "x") for i in range(3000)], 40000)


def test_hot_group_ties_and_nulls(spark):
    rows = [(i, 10, 7, "hot") for i in range(2000)] + [(None, 10, 7, "null")] * 50 + [(1, 10, 7, "again")] * 500 + [(i, 10, i * 7919 - 10**9, "o") for i in range(1500)]
    check(spark, rows, 40)


def test_small_and_empty(spark):
    check(spark, [(1, 5, 3, "a")], None)
    empty = spark.createDataFrame([], "doc_id long, size long, g long")
    assert S.shard(empty, key="doc_id", size="size", group="g").count() == 0


def test_one_row_of_most_bytes(spark):
    got = check(spark, [(0, 10**6, 5, "big"), *[(i, 1, i, "s") for i in range(1, 200)]], None)
    assert len(got) == 200


def test_clashing_names(spark):
    names = ["shard", "slot", "__at", "__row", "__bytes", "__rows", "__first", "__h", "__k", "__range", "__upto"]
    df = spark.createDataFrame([(i, 5, i * 31, *range(len(names))) for i in range(100)], "doc_id long, size long, g long, " + ", ".join(f"`{n}` int" for n in names))
    got = S.shard(df, key="doc_id", size="size", group="g")
    assert got.columns == [*df.columns, "shard_", "slot_"]
    rows = got.collect()
    assert len(rows) == 100 and all([r[n] for n in names] == list(range(len(names))) for r in rows) and {r.shard_ for r in rows} == set(range(8))


def test_query_columns(spark, tmp_path):
    texts = [None, "", "é" * 10, "same text", "same text", "long " * 100_000, *[f"text {i} " * (i % 30) for i in range(400)]]
    rows = [(i if i else None, t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = S.op5(spark, str(tmp_path)).collect()
    size = lambda t: len((t or "").encode()) + 1
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in got), key=repr) == sorted(((i, size(t), zlib.crc32((t or "").encode())) for i, t in rows), key=repr)
    assert {(r.law, r.grown_shard) for r in got} == {("bytes", None)}
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert len({r.shard for r in got if r.text_crc32 == zlib.crc32(b"same text")}) == 1
