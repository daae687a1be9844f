"""What the operators share: the folder all executors see, Arrow passes over documents, skew-safe joins."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_OWN: str | None = None
#: Text bytes that one step of an Arrow pass holds at a time; single longer texts are steps of their own.
STEP_BYTES = 4 << 20
#: The same where it runs in the pipeline, on executors that earlier stages have filled.
SMALL_STEP = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of our own only where that is unset and all tasks run on this machine."""
    global _OWN
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _OWN is None:
        _OWN = "file://" + tempfile.mkdtemp(prefix="glyphmill-")
        atexit.register(shutil.rmtree, _OWN[7:], True)
    return _OWN


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the JVM may be gone already; the folder is scratch
        pass


#: Has Spark remove an execution's shuffle files as it ends: what was settled is read from its table.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Rows that go to a Python worker at a time, and Spark's own number of them: of long texts 32 MB and more, in the JVM and in the worker.
BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


def settle(df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
    """Cuts the lineage: the rows as a table in the shared folder, which a lost executor does not take along. batch_rows: for its Arrow passes."""
    spark = df.sparkSession
    path = work_dir(spark, name)
    before = {CLEAN: spark.conf.get(CLEAN, "false"), BATCH: spark.conf.get(BATCH, BATCH_ROWS)}
    spark.conf.set(CLEAN, "true")
    if batch_rows:
        spark.conf.set(BATCH, str(batch_rows))
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    done = spark.read.schema(df.schema).parquet(path)
    done.settled_at = path
    return done


def drop(*tables: DataFrame | None) -> None:
    """Removes tables made by settle that no later step reads."""
    for df in tables:
        if df is not None and getattr(df, "settled_at", None):
            remove(df.sparkSession, df.settled_at)
            df.settled_at = None


#: Broadcast sides are at most this large by count of their rows and values; beyond it the join is a shuffle.
BROADCAST_BYTES = 32 << 20


def maybe_broadcast(df: DataFrame, row_bytes: int) -> DataFrame:
    """df, marked for broadcast if its counted rows are few enough."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def free_name(name: str, taken) -> str:
    low = {x.lower() for x in taken}
    while name.lower() in low:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def steps(batch: pa.RecordBatch, column: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batch of at most `limit` bytes in `column`, a row at least."""
    n = batch.num_rows
    if not n:
        return
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start = held = 0
    for i in range(n):
        if held and held + sizes[i] > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(sizes[i])
    yield batch.slice(start, n - start)


def release() -> None:
    """Gives back what a pass has freed: a worker that waits for its next task else keeps its most."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library than glibc
        pass


def annotate(df: DataFrame, text: str, fn: Callable, fields: T.StructType, keep: list[str], name: str = "found", drop: Callable | None = None, limit: int = STEP_BYTES) -> DataFrame:
    """One Arrow pass, no shuffle: `keep` columns and a struct `name` (renamed if taken) made by fn(texts as bytes or None, batch).

    fn returns a dict of lists or arrays, one for each field. drop(dict) may return a boolean
    mask of rows to keep; then no struct is added.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    out = free_name(name, keep)
    kept = df.select(*[F.col(f"`{c}`") for c in keep]).schema
    inner = pa.struct(list(to_arrow_schema(fields)))
    schema = kept if drop else T.StructType([*kept.fields, T.StructField(out, fields, False)])
    extra = [c for c in (text,) if c not in keep]

    def run(batches):
        for batch in batches:
            for part in steps(batch, text, limit):
                got = fn(part.column(text).cast(pa.binary()).to_pylist(), part)
                columns, names = [part.column(c) for c in keep], list(keep)
                if drop:
                    result = pa.RecordBatch.from_arrays(columns, names=names)
                    yield result.filter(pa.array(drop(got)))
                    continue
                arrays = [pa.array(got[f.name], type=inner.field(f.name).type) for f in fields]
                yield pa.RecordBatch.from_arrays([*columns, pa.StructArray.from_arrays(arrays, fields=list(inner))], names=[*names, out])
        release()

    return df.select(*[F.col(f"`{c}`") for c in [*keep, *extra]]).mapInArrow(run, schema)


def spread_join(big: DataFrame, small: DataFrame, key: str, total: int | None = None, size: str = "n") -> DataFrame:
    """Left join of `big` with `small` (one row a key, `size` = the key's rows in big), safe for hot keys.

    Keys with at least max(1000, total/2000) rows are at most 2000: that part is broadcast. The
    rest is joined by shuffle, where no key has more than that. Rows whose key is null keep nulls.
    """
    if total is None:
        total = small.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    hot_rows = max(1000, total // 2000)
    hot = F.broadcast(small.where(F.col(size) >= hot_rows))
    cold = small.where(F.col(size) < hot_rows)
    names = [c for c in big.columns if c != key]
    more = [c for c in small.columns if c != key]
    both = big.join(hot.withColumns({"__hot": F.lit(True)}), key, "left")
    first = both.where("__hot").select(key, *names, *more)
    rest = both.where("__hot IS NULL").select(key, *names)
    null = rest.where(F.col(key).isNull()).select(key, *names, *[F.lit(None).cast(small.schema[c].dataType).alias(c) for c in more])
    return first.unionByName(rest.where(F.col(key).isNotNull()).join(cold, key, "left")).unionByName(null)


def tokenizer_path(name: str) -> str:
    """Default place of a public tokenizer's file; operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


