"""Token-ID files: ids of whole documents in ascending id order, coded by the context-mixing range coder.

A file: magic, a zlib-packed header (documents' ids, which of them are null, token counts), then blocks of
at most coder.BLOCK ids, each with its id count, alphabet, payload length, crc32 of the payload and crc32 of
its ids. Blocks are coded from fresh models and need nothing but their own bytes. Documents are range-sorted by id; each
task writes its files under temporary names and renames them; the manifest, a table written from
the tasks' answers, names the files that count, so that a retried task's earlier files are
never read. Readers take the files from the manifest and check every block.

Defined cases: ids must be whole numbers (a column of another type is refused); a null or empty text has only the end
id; null document ids come first; rows with equal ids follow one another by their text's crc32 and 64-bit hash;
repeated rows are documents of their own and may be dealt to several files; a text longer than a file has one of its
own; columns other than the id and the text are not read, whatever they are called; an empty table gives no files and
no rows; token ids of coder.MOST_IDS or more are refused.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import coder, files
from .common import remove, steps, tokenizer_path, work_dir
from .tokens import encoder

MAGIC = b"GMTOK2\n"
#: Most ids in a file; a longer single document has a file of its own.
FILE_IDS = 8_000_000
#: Files that a reading task decodes at a time, for longer numpy vectors: some 250 MB.
AT_ONCE = 2
MANIFEST = "part int, part_file int, file string, docs long, tokens long"
BLOCK_HEAD = struct.Struct("<IIIII")


class Corrupt(ValueError):
    """A file or block that doesn't hold what its checksums say."""


def pack_file(keys: list[int | None], counts: np.ndarray, ids: np.ndarray, alphabet: int = 1) -> bytes:
    """alphabet: a number that ids are known to be below; files of one alphabet are decoded together."""
    ids = ids.astype("<u4", copy=False)
    cut = [ids[k : k + coder.BLOCK] for k in range(0, len(ids), coder.BLOCK)]
    # blocks are coded together; each says how large its alphabet is
    alphabet = max(min(alphabet, coder.MOST_IDS), int(ids.max()) + 1 if len(ids) else 1)
    payloads = coder.encode(cut, alphabet)
    null = np.array([k is None for k in keys], bool)
    known = np.array([k or 0 for k in keys], "<i8")
    head = zlib.compress(b"".join([struct.pack("<QQ", len(keys), len(cut)), known.tobytes(), null.tobytes(), counts.astype("<u8").tobytes()]))
    out = [MAGIC, struct.pack("<II", len(head), zlib.crc32(head)), head]
    for own, p in zip(cut, payloads, strict=True):
        out += [BLOCK_HEAD.pack(len(own), alphabet, len(p), zlib.crc32(p), zlib.crc32(own)), p]
    return b"".join(out)


def unpack_file(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, which of them are null, token counts, and all ids."""
    return unpack_files([data])[0]


def unpack_files(many: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """What unpack_file gives of each file; blocks of one alphabet are decoded together, of whatever file."""
    heads, starts, found = [], [0], {}
    for data in many:
        if data[: len(MAGIC)] != MAGIC:
            raise Corrupt("not a token file")
        at = len(MAGIC)
        size, crc = struct.unpack_from("<II", data, at)
        head = data[at + 8 : at + 8 + size]
        at += 8 + size
        if zlib.crc32(head) != crc:
            raise Corrupt("header")
        head = zlib.decompress(head)
        docs, n_blocks = struct.unpack_from("<QQ", head)
        cut = np.cumsum([16, 8 * docs, docs, 8 * docs])
        heads.append([np.frombuffer(head[a:b], t) for a, b, t in zip(cut, cut[1:], ("<i8", bool, "<u8"), strict=False)])
        for k in range(n_blocks):
            n, alphabet, length, crc, own = BLOCK_HEAD.unpack_from(data, at)
            p = data[at + BLOCK_HEAD.size : at + BLOCK_HEAD.size + length]
            at += BLOCK_HEAD.size + length
            if zlib.crc32(p) != crc or len(p) != length:
                raise Corrupt("block payload")
            found.setdefault(alphabet, []).append((starts[-1] + k, n, p, own))
        starts.append(starts[-1] + n_blocks)
    blocks: list = [None] * starts[-1]
    for alphabet, group in found.items():
        decoded = coder.decode([p for _, _, p, _ in group], [n for _, n, _, _ in group], alphabet)
        for (k, _, _, own), ids in zip(group, decoded, strict=True):
            blocks[k] = ids.astype("<u4", copy=False)
            if zlib.crc32(blocks[k]) != own:
                raise Corrupt("block ids")
    ids = [np.concatenate(blocks[a:b]) if b > a else np.zeros(0, "<u4") for a, b in zip(starts, starts[1:], strict=False)]
    return [(keys, null, counts.astype(np.int64), x) for (keys, null, counts), x in zip(heads, ids, strict=True)]


def write(docs: DataFrame, folder: str, path: str, *, end: int = 1, key: str = "doc_id", text: str = "text", file_ids: int = FILE_IDS) -> DataFrame:
    """Writes the files and their manifest (folder/manifest); returns the manifest as read back."""
    if not isinstance(docs.schema[key].dataType, T.IntegralType):
        raise TypeError(f"{key} must be a whole number, not {docs.schema[key].dataType.simpleString()}")
    df = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").alias("text"))
    # equal rows can be dealt to several tasks: which of them comes first makes no difference
    order = ["key", F.crc32(F.col("text").cast("binary")), F.xxhash64("text"), F.monotonically_increasing_id()]
    df = df.repartitionByRange(*order).sortWithinPartitions(*order[:3])
    tail = np.array([end], np.uint32)

    def run(batches):
        from pyspark import TaskContext

        code, part = encoder(path), TaskContext.get().partitionId()
        keys: list = []
        held: list = []
        total, count = 0, 0

        def flush():
            nonlocal keys, held, total, count
            name = f"tokens-{part:06d}-{count:04d}-{uuid.uuid4().hex[:8]}.gmtok"
            sizes = np.array([len(x) + 1 for x in held], np.int64)
            ids = np.concatenate([x for own in held for x in (own, tail)])
            files.put(folder, name, pack_file(keys, sizes, ids, code.library.get_vocab_size()))
            row = pd.DataFrame({"part": [part], "part_file": [count], "file": [name], "docs": [len(held)], "tokens": [len(ids)]})
            keys, held, total, count = [], [], 0, count + 1
            return pa.RecordBatch.from_pandas(row.astype({"part": "int32", "part_file": "int32"}), preserve_index=False)

        for batch in batches:
            for piece in steps(batch, "text"):
                for k, ids in zip(piece.column("key").to_pylist(), code.ids(piece.column("text").cast(pa.binary()).to_pylist()), strict=True):
                    if held and total + len(ids) + 1 > file_ids:
                        yield flush()
                    keys.append(k)
                    held.append(ids)
                    total += len(ids) + 1
        if held:
            yield flush()

    df.mapInArrow(run, MANIFEST).write.parquet(f"{folder}/manifest")
    return docs.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read(spark, folder: str, *, key: str = "doc_id") -> DataFrame:
    """key, start, n_tokens, ids_crc32 and file of each document, from the files the manifest names."""
    named = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    # a running sum over one row a task, then inside each task's files
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = named.groupBy("part").agg(F.sum("tokens").alias("own")).select("part", F.coalesce(F.sum("own").over(upto), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("part_file").rowsBetween(Window.unboundedPreceding, -1)
    todo = named.join(parts, "part").select("part", "part_file", "file", (F.col("base") + F.coalesce(F.sum("tokens").over(inside), F.lit(0))).alias("first"))
    schema = T.StructType([T.StructField(key, T.LongType()), *[T.StructField(n, T.LongType()) for n in ("start", "n_tokens", "ids_crc32")], T.StructField("file", T.StringType())])

    def run(batches):
        for batch in batches:
            rows = list(zip(batch.column("file").to_pylist(), batch.column("first").to_pylist(), strict=True))
            for some in (rows[k : k + AT_ONCE] for k in range(0, len(rows), AT_ONCE)):
                got = unpack_files([files.read(folder, name) for name, _ in some])
                for (name, first), (keys, null, counts, ids) in zip(some, got, strict=True):
                    ends = np.cumsum(counts)
                    crc = [zlib.crc32(ids[b - n : b]) for b, n in zip(ends.tolist(), counts.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64(), mask=null), pa.array(first + ends - counts), pa.array(counts), pa.array(crc, pa.int64()), pa.array([name] * len(keys), pa.string())], names=schema.names)

    # a task for AT_ONCE files, or for one if that leaves cores idle, dealt by number: their names are far too small for the runtime to judge the work by
    n = named.count()
    tasks = max(1, min(n, spark.sparkContext.defaultParallelism), -(-n // AT_ONCE))
    return todo.repartitionByRange(tasks, "part", "part_file").select("file", "first").mapInArrow(run, schema)


def op2(spark, sf_dir: str) -> DataFrame:
    folder = work_dir(spark, "token-files")
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder, tokenizer_path("word_bpe_49k.json"))
    return read(spark, folder)


__all__ = ["Corrupt", "op2", "pack_file", "read", "remove", "unpack_file", "unpack_files", "write"]
