"""What grows with the rows of a table is not held at once: contents are made in small batches, exploded sides are not broadcast."""

import pyarrow as pa


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_contents_are_made_in_batches_of_bounded_bytes():
    from glyphmill.plans.round_trips import in_steps

    parts = [[1], [1, 1], [9] * 9, [], [1], [1]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6), pa.int64()), pa.array(parts, pa.list_(pa.int64()))], names=["blob", "parts"])
    made = [*in_steps(lambda p: bytes(1000 * len(p)), 3000)([batch, batch.slice(0, 0), batch.slice(1, 1)])]
    assert [[(b, len(c)) for b, c in m.to_pydict().items()] for m in made] == [[("blob", n), ("content", n)] for n in (2, 1, 3, 1)]
    rows = [(b, len(c)) for m in made for b, c in zip(*m.to_pydict().values(), strict=True)]
    assert rows == [(k, 1000 * len(p)) for k, p in [*enumerate(parts), (1, parts[1])]]


def test_images_are_made_in_such_batches(spark):
    from glyphmill.plans import round_trips

    df = round_trips.cartridge_regions(spark, "/root/testdata/sf0.001")
    assert "MapInArrow" in plan(df) and df.count() == 4


def test_longest_prefix_explodes_no_side_of_a_broadcast(spark):
    from pyspark.sql import functions as F

    from glyphmill.operators import pairing as P
    from glyphmill.plans import resources

    assert "BroadcastHashJoin" not in plan(resources.shared_prefix_tiles(spark, "/root/testdata/sf0.001"))
    names, ends = ["abc", "abc", "ab", "b", "", None, "abcé1"], ["a", "ab", "abc", "ab", None, "abcé", "zz"]
    left = spark.createDataFrame([(g, k, n, k % 3) for g in (1, 2) for k, n in enumerate(names)], "g int, k long, n string, room int")
    right = spark.createDataFrame([(1, f"t{i}", p, i) for i, p in enumerate(ends)], "g int, o string, p string, need int")
    got = P.longest_prefix(left, "k", "n", right, "o", "p", ["g"]).collect()
    pairs = [(k, len(p), f"t{i}") for k, n in enumerate(names) for i, p in enumerate(ends) if n and p and n.startswith(p)]
    assert sorted(got) == [(1, k, max((x[1:] for x in pairs if x[0] == k))[1]) for k in sorted({x[0] for x in pairs})]
    got = P.longest_prefix(left, "k", "n", right, "o", "p", ["g"], F.col("need") <= F.col("room"), ["room"]).collect()
    pairs = [x for x in pairs if int(x[2][1:]) <= x[0] % 3]
    assert sorted(got) == [(1, k, max((x[1:] for x in pairs if x[0] == k))[1]) for k in sorted({x[0] for x in pairs})]


def test_similar_unique_explodes_no_side_of_a_broadcast(spark):
    from glyphmill.operators import pairing as P
    from glyphmill.plans import catalogue

    assert "BroadcastHashJoin" not in plan(catalogue.similar_supplier(spark, "/root/testdata/sf0.001"))
    one = spark.createDataFrame([(g, k, n) for g in (1, 2) for k, n in enumerate(["bg_s", "bg_t", "x"])], "g int, k long, n string")
    other = one.where("g = 1 OR k = 0").select("g", "k", "n").toDF("g", "o", "m")
    found = P.similar_unique(one, "k", "n", other, "o", "m", 2, ["g"])
    # the second group has an only candidate, which is taken whatever its score
    assert "BroadcastHashJoin" not in plan(found)
    assert sorted(found.collect()) == [(1, 0, 0, 4), (1, 1, 1, 4), (2, 0, 0, 4), (2, 1, 0, 3), (2, 2, 0, 0)]
