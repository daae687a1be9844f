"""Deterministic sharded WARC writer and reader.

Digests are taken JVM-side; records with equal payloads of at least LEAST_REVISIT bytes are reduced to their
smallest id by an aggregation, and joined back without gathering a hot payload in one task. Records
are range-sorted by id; each task rolls its files by compressed size (a gzip member a record),
writes them under temporary names, and renames them. The manifest, a table of the tasks' answers,
names the files that count. Headers, record ids and digests are regenerated from the data alone,
so that equal input gives equal records.

Defined cases: a null payload is empty; a null url is written as an empty target; null ids come last
and are never the response of others with an id; rows with equal ids and payloads are all but one revisits;
a very long payload is a record and a step of its own; columns other than the three are not read, whatever they are
called; an empty table gives no files.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import files
from .common import settle, spread_join, steps, work_dir

LEAST_REVISIT = 100
ROLL_BYTES = 64 << 20
#: Compressed bytes that are read at a time.
PIECE = 1 << 16
DATE = "2026-01-01T00:00:00Z"
MANIFEST = "part int, part_file int, file string, records long, bytes long"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(key, url: str, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{key} {digest} {url}')}>"


def record(key, url: str, payload: bytes, digest: str, refers_to, refers_url: str, date: str) -> bytes:
    """One record, uncompressed. A revisit has the HTTP headers with the full payload's length, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(key, url, digest)}", f"WARC-Date: {date}", f"WARC-Target-URI: {url}"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", f"X-Page-ID: {'' if key is None else key}"]
    if refers_to is not None:
        of = int(refers_to) if refers_to else None
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {record_id(of, refers_url, digest)}", f"WARC-Refers-To-Target-URI: {refers_url}", f"X-Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def safe(url: str) -> str:
    """A header's value is one line."""
    return url.replace("\r", "%0D").replace("\n", "%0A")


def member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class Broken(ValueError):
    """An archive that doesn't hold what its headers say."""


def parse(data: bytes):
    """Headers and block of each record of an archive of gzip members; digests are checked."""
    view, at = memoryview(data), 0
    while at < len(view):
        z, parts = zlib.decompressobj(31), []
        while not z.eof:
            if at >= len(view):
                raise Broken("the archive ends inside a record")
            piece = view[at : at + PIECE]
            parts.append(z.decompress(piece))
            at += len(piece)
        at -= len(z.unused_data)
        raw = b"".join(parts)
        head, _, rest = raw.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise Broken("no record where one should begin")
        fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        block = rest[: int(fields["Content-Length"])]
        if "sha256:" + hashlib.sha256(block).hexdigest() != fields["WARC-Block-Digest"]:
            raise Broken(f"block digest of {fields['WARC-Record-ID']}")
        yield fields, block


def write(pages: DataFrame, folder: str, *, key: str = "page_id", url: str = "url", payload: str = "html", roll: int = ROLL_BYTES, date: str = DATE) -> DataFrame:
    """Writes the archives and their manifest (folder/manifest); returns the manifest as read back."""
    body = F.coalesce(F.col(f"`{payload}`").cast("binary"), F.lit(b""))
    df = pages.select(F.col(f"`{key}`").cast("long").alias("key"), F.coalesce(F.col(f"`{url}`"), F.lit("")).alias("url"), body.alias("payload"), F.sha2(body, 256).alias("digest"), F.length(body).alias("size"))
    order = F.struct(F.col("key").isNull(), F.col("key"), F.col("url"))
    large = df.where(F.col("size") >= LEAST_REVISIT)
    groups = large.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first")).where("n > 1")
    groups = settle(groups.select("digest", "n", F.col("first.key").alias("first_key"), F.col("first.url").alias("first_url")), "warc-groups")
    narrow = spread_join(df, groups, "digest")
    # of fully equal rows one alone is the response: told apart by a number within the task and the task
    narrow = narrow.withColumn("refers", F.when(F.col("n").isNotNull() & ~(F.col("key").eqNullSafe(F.col("first_key")) & (F.col("url") == F.col("first_url"))), F.coalesce(F.col("first_key").cast("string"), F.lit(""))))
    narrow = narrow.select(F.coalesce("key", F.lit((1 << 63) - 1)).alias("sort"), "key", "url", "payload", "digest", "refers", "first_url")
    tidy = narrow.repartitionByRange("sort").sortWithinPartitions("sort", "url", "digest", F.col("refers").isNotNull())

    def run(batches):
        from pyspark import TaskContext

        part, count = TaskContext.get().partitionId(), 0
        sink, name, records = None, "", 0
        last = None

        def close():
            sink.commit()
            row = pd.DataFrame({"part": [part], "part_file": [count], "file": [name], "records": [records], "bytes": [sink.size]})
            return pa.RecordBatch.from_pandas(row.astype({"part": "int32", "part_file": "int32"}), preserve_index=False)

        for batch in batches:
            for piece in steps(batch, "payload"):
                for k, u, p, d, refers, of in zip(*[piece.column(c).to_pylist() for c in ("key", "url", "payload", "digest", "refers", "first_url")], strict=True):
                    if (k, u, d) == last and refers is None and len(p) >= LEAST_REVISIT:
                        refers, of = "" if k is None else str(k), u
                    last = (k, u, d)
                    data = member(record(k, safe(u), p, d, refers, safe(of or ""), date))
                    if sink and records and sink.size + len(data) > roll:
                        yield close()
                        sink, count = None, count + 1
                    if sink is None:
                        name, records = f"pages-{part:06d}-{count:04d}-{uuid.uuid4().hex[:8]}.warc.gz", 0
                        sink = files.Sink(folder, name)
                    sink.write(data)
                    records += 1
        if sink:
            yield close()

    tidy.mapInArrow(run, MANIFEST).write.parquet(f"{folder}/manifest")
    return pages.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read(spark, folder: str, *, key: str = "page_id") -> DataFrame:
    """A row a record of the archives that the manifest names."""
    named = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").select("file")
    names = [key, "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "file"]
    schema = T.StructType([T.StructField(n, T.LongType() if n in (key, "payload_bytes", "refers_to") else T.StringType()) for n in names])

    def run(batches):
        for batch in batches:
            for name in batch.column("file").to_pylist():
                rows = []
                for h, block in parse(files.read(folder, name)):
                    http, _, body = block.partition(b"\r\n\r\n")
                    size = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))[16:])
                    digest = h["WARC-Payload-Digest"].removeprefix("sha256:")
                    if h["WARC-Type"] == "response" and (len(body) != size or hashlib.sha256(body).hexdigest() != digest):
                        raise Broken(f"payload of {h['WARC-Record-ID']}")
                    number = lambda x: int(x) if x else None
                    rows.append((number(h["X-Page-ID"]), size, digest, h["WARC-Type"], number(h.get("X-Refers-To-Page-ID", "")), h["WARC-Target-URI"], name))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()], strict=True)], names=names)

    # a task a file, dealt by number: their names say nothing of their size
    return named.repartition(max(1, named.count()), "file").mapInArrow(run, schema)


def op4(spark, sf_dir: str) -> DataFrame:
    folder = work_dir(spark, "warc")
    write(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS size FROM pages),
g AS (SELECT html, min(page_id) AS first FROM p WHERE size >= {LEAST_REVISIT} GROUP BY html)
SELECT p.page_id, CAST(size AS BIGINT) AS payload_bytes, sha256(p.html) AS payload_digest,
       CASE WHEN first IS NULL OR first = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> p.page_id THEN first END AS refers_to
FROM p LEFT JOIN g ON p.html = g.html
"""
