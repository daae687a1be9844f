"""Sharding by sampled splitters, under the law `bytes`: shards of near equal size.

Records are ordered by (hash of the text, key): equal texts are neighbours, and a group that no shard could
hold is divided by the key. A size-weighted sample of sort keys gives quantile boundaries; records
are range-partitioned by them; ranges whose exact size came out overfull are subdivided by a second,
finer sample of their own. Exact sizes of the ranges and running sums inside them then give each record its place in
the whole order, and the shard is the place's share of the total. Only narrow rows are shuffled.

Defined cases: a null text has no bytes and size 1; null keys are sorted first; equal rows are neighbours and, as
they can't be told apart, a run of them is divided by the running sum like any other; a text is only measured and hashed, however long; columns of any name are passed
through; an empty table gives no rows.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, settle

SHARDS = 8
#: Ranges are this many to a shuffle partition, the sample this many to a range.
RANGES_PER_PARTITION, SAMPLE_PER_RANGE = 1, 64
OVERFULL = 2.0


def shard(df: DataFrame, *, key: str, size: str, group: str, shards: int = SHARDS, seed: int = 11) -> DataFrame:
    """All columns of df, and shard and slot (under free names, if it has columns of these). size: a long column of at least 1; group: a long column that keeps like records together."""
    spark = df.sparkSession
    names = df.columns
    h, k, r, s_col, at_, row, bytes_, rows_, first_ = (free_name(x, names) for x in ("__h", "__k", "__range", "__upto", "__at", "__row", "__bytes", "__rows", "__first"))
    shard_, slot_ = (free_name(x, names) for x in ("shard", "slot"))
    keyed = df.withColumns({h: F.col(f"`{group}`"), k: F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(-(1 << 63)))})
    total = keyed.agg(F.sum(f"`{size}`"), F.count(F.lit(1))).first()
    whole, rows = total[0] or 0, total[1]
    if not rows:
        return df.select(*[F.col(f"`{c}`") for c in names], F.lit(0).alias(shard_), F.lit(0).cast("long").alias(slot_))
    ranges = max(shards, RANGES_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions")))

    def splitters(source: DataFrame, weight: int, parts: int, seed: int) -> list[tuple[int, int]]:
        """Quantile boundaries of a sample in which a record is as likely as its share of the bytes."""
        rate = SAMPLE_PER_RANGE * parts / max(1, weight)
        draw = source.where(F.rand(seed) < F.col(f"`{size}`") * F.lit(rate)).select(h, k)
        keys = sorted((x[0], x[1]) for x in draw.collect())  # about SAMPLE_PER_RANGE * parts
        return sorted({keys[i * len(keys) // parts] for i in range(1, parts)}) if keys else []

    def ranged(source: DataFrame, bounds: list[tuple[int, int]]) -> DataFrame:
        held = spark.sparkContext.broadcast(bounds)

        def find(batches):
            major = np.array([b[0] for b in held.value], np.int64)
            for batch in batches:
                a, b = (batch.column(c).to_numpy(zero_copy_only=False) for c in (h, k))
                lo, hi = np.searchsorted(major, a, "left"), np.searchsorted(major, a, "right")
                for i in np.flatnonzero(lo < hi):
                    lo[i] = bisect.bisect_right(held.value, (int(a[i]), int(b[i])), int(lo[i]), int(hi[i]))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lo.astype(np.int64))], names=[*batch.schema.names, r])

        return source.mapInArrow(find, source.withColumn(r, F.lit(0).cast("long")).schema)

    keyed = settle(keyed, "sharding-rows")
    bounds = splitters(keyed, whole, ranges, seed)
    sizes = {x[0]: x[1] for x in ranged(keyed, bounds).groupBy(r).agg(F.sum(f"`{size}`")).collect()}  # a row a range
    full = [x for x, v in sizes.items() if v > OVERFULL * whole / ranges]
    if full:
        held = ranged(keyed, bounds).where(F.col(r).isin(full)).drop(r)
        weight = sum(sizes[x] for x in full)
        bounds = sorted({*bounds, *splitters(held, weight, max(2, 2 * -(-weight * ranges // whole)), seed + 1)})
    placed = settle(ranged(keyed, bounds).repartition(F.col(r)), "sharding-ranges")
    inside = Window.partitionBy(r).orderBy(h, k, *[F.col(f"`{c}`") for c in names if c in (size,)])
    running = placed.withColumn(s_col, F.sum(f"`{size}`").over(inside.rowsBetween(Window.unboundedPreceding, -1))).withColumn(row, F.row_number().over(inside) - 1)
    before, at, n = {}, 0, 0
    for x in sorted(placed.groupBy(r).agg(F.sum(f"`{size}`"), F.count(F.lit(1))).collect()):  # a row a range
        before[x[0]] = (at, n)
        at, n = at + x[1], n + x[2]
    base = spark.createDataFrame([(x, *v) for x, v in before.items()], f"`{r}` long, `{bytes_}` long, `{rows_}` long")
    done = running.join(F.broadcast(base), r)
    start = F.col(bytes_) + F.coalesce(F.col(s_col), F.lit(0))
    done = done.select(*[F.col(f"`{c}`") for c in names], F.least(F.lit(shards - 1), F.floor((start * 2 + F.col(f"`{size}`")) * shards / (2 * whole))).cast("int").alias(shard_), (F.col(rows_) + F.col(row)).alias(at_))
    done = settle(done, "sharding-places")
    first = done.groupBy(shard_).agg(F.min(at_).alias(first_))  # a row a shard
    return done.join(F.broadcast(first), shard_).select(*[F.col(f"`{c}`") for c in names], shard_, (F.col(at_) - F.col(first_)).cast("long").alias(slot_))


def op5(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce("text", F.lit(""))
    narrow = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("text_hash"))
    done = shard(narrow, key="doc_id", size="size", group="text_hash")
    return done.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
