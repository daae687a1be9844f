"""Best-fit packing by exact-complement hashing.

Documents become pieces of at most `size` tokens: only longer ones are cut, and all pieces but the
first are full then. A full piece is a sequence of its own. The rest is planned on the histogram of
lengths, at most `size` counts: for the largest length left, an index of single, pair and triple
sums is asked for what fills the gap exactly, and the combination is used as often as the availability
counts allow; where none fills it, the best fitting length is put in and the smaller gap is asked again.
The plan is a short list of patterns with multiplicities. Pieces then find their place by their
rank among the pieces of their length, by arithmetic; ranks come from counts by task and length.

Defined cases: a null or empty text is its end id alone; null ids are ids; repeated rows are pieces of
their own; a very long text is cut to pieces where it is; of other columns none is read; an empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import SMALL_STEP, release, settle, steps, tokenizer_path
from .tokens import encoder

SIZE = 2048
#: On executors that earlier stages have filled: rows that go to a worker at a time, and chunks whose ids it keeps.
BATCH_ROWS, SMALL_CACHE = 1000, 400_000


def plan(counts: np.ndarray) -> list[tuple[int, list[int]]]:
    """Patterns (times, lengths) that use up counts[length], each sum at most len(counts) - 1."""
    size, left = len(counts) - 1, counts.astype(np.int64).copy()
    left[0] = 0
    patterns = []

    def exact(gap: int) -> list[int] | None:
        """Lengths left that sum to gap: one, two or three."""
        if left[gap]:
            return [gap]
        have = left > 0
        low = np.arange(1, gap // 2 + 1)
        pairs = low[have[low] & have[gap - low]]
        pairs = pairs[(2 * pairs != gap) | (left[pairs] > 1)]
        if len(pairs):
            return [gap - int(pairs[0]), int(pairs[0])]
        for a in np.flatnonzero(have[: gap - 1])[::-1]:
            a, rest = int(a), gap - int(a)
            if 3 * a < gap:
                break
            low = np.arange(1, rest // 2 + 1)
            found = low[have[low] & have[rest - low]]
            for b in found:
                trio = [a, rest - int(b), int(b)]
                if all(left[x] >= trio.count(x) for x in trio):
                    return trio
        return None

    while (lengths := np.flatnonzero(left)).size:
        top = int(lengths[-1])
        chosen, gap = [top], size - top
        left[top] -= 1
        while gap:
            more = exact(gap)
            if more:
                chosen += more
                for x in more:
                    left[x] -= 1
                gap = 0
                break
            fits = np.flatnonzero(left[: gap + 1])
            if not fits.size:
                break
            best = int(fits[-1])
            chosen.append(best)
            left[best] -= 1
            gap -= best
        again = min(int(left[x]) // chosen.count(x) for x in set(chosen))
        for x in chosen:
            left[x] -= again
        patterns.append((1 + again, chosen))
    return patterns


def places(patterns: list[tuple[int, list[int]]]) -> list[tuple]:
    """For each pattern and length: length, first rank, last rank + 1, how many a sequence holds, first sequence, offset of the first."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for times, lengths in patterns:
        at = 0
        for x in sorted(set(lengths), reverse=True):
            k = lengths.count(x)
            first = used.get(x, 0)
            rows.append((x, first, first + times * k, k, sequence, at))
            used[x] = first + times * k
            at += k * x
        sequence += times
    return rows


def pieces(docs: DataFrame, path: str, *, end: int, size: int, key: str, text: str) -> DataFrame:
    """key, piece, start, length, ids_crc32, ids of every piece, without a shuffle."""
    schema = T.StructType([docs.schema[key], *[T.StructField(n, T.LongType() if n != "piece" else T.IntegerType()) for n in ("piece", "start", "length", "ids_crc32")]])
    arrow = to_arrow_schema(schema)
    tail = np.array([end], np.uint32)

    def run(batches):
        code = encoder(path)
        code.most = SMALL_CACHE
        for batch in batches:
            for part in steps(batch, text, SMALL_STEP):
                row, piece, start, length, crc = [], [], [], [], []
                for i, ids in enumerate(code.ids(part.column(text).cast(pa.binary()).to_pylist())):
                    ids = np.append(ids, tail)
                    n = len(ids)
                    count = -(-n // size)
                    a = 0
                    for k in range(count):
                        b = n - size * (count - 1 - k)
                        row.append(i)
                        piece.append(k)
                        start.append(a)
                        length.append(b - a)
                        crc.append(zlib.crc32(ids[a:b]))
                        a = b
                keys = part.column(key).take(pa.array(row, pa.int32()))
                yield pa.RecordBatch.from_arrays([keys, *[pa.array(x, arrow.field(n + 1).type) for n, x in enumerate((piece, start, length, crc))]], schema=arrow)
        release()

    return docs.select(F.col(f"`{key}`"), F.col(f"`{text}`")).mapInArrow(run, schema)


def pack(docs: DataFrame, path: str | None = None, *, end: int = 0, size: int = SIZE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The pieces with their sequence_id and offset."""
    spark = docs.sparkSession
    made = settle(pieces(docs, path or tokenizer_path("byte_bpe_50k.json"), end=end, size=size, key=key, text=text).withColumn("__task", F.spark_partition_id()), "packing-pieces", BATCH_ROWS)
    by_task = made.groupBy("__task", "length").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("__task").rowsBetween(Window.unboundedPreceding, -1))
    base = settle(by_task.select("__task", "length", "n", F.coalesce(before, F.lit(0)).alias("base")), "packing-counts")
    counts = np.zeros(size + 1, np.int64)
    for r in base.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `size` rows
        counts[r["length"]] = r["n"]
    rows = places(plan(counts))
    spots = spark.createDataFrame(rows or [(0, 0, 0, 1, 0, 0)], "length long, lo long, hi long, k long, first long, at long")
    # patterns of each length as one sorted array, at most as many in all as the plan has parts
    spots = spots.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "k", "first", "at"))).alias("spots"))
    in_task = Window.partitionBy("__task", "length").orderBy(key, "piece", "ids_crc32")
    ranked = made.withColumn("__row", F.row_number().over(in_task) - 1).join(base.drop("n"), ["__task", "length"])
    ranked = ranked.withColumn("__rank", F.col("__row") + F.col("base")).join(F.broadcast(spots), "length")
    spot = F.expr("element_at(filter(spots, s -> s.lo <= __rank and __rank < s.hi), 1)")
    ranked = ranked.withColumn("__s", spot).withColumn("__i", F.col("__rank") - F.col("__s.lo"))
    return ranked.select(
        F.col(f"`{key}`"),
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("__s.first") + F.expr("__i div __s.k")).alias("sequence_id"),
        (F.col("__s.at") + (F.col("__i") % F.col("__s.k")) * F.col("length")).alias("offset"),
    )


def op10(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
