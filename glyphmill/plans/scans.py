"""Queries that scan archives made of parts' rows, and read tables that say where things are.

Drawing, editing and putting back what a scan finds is tested on small files (tests/test_workflow.py)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from glyphmill.codecs import bios
from glyphmill.containers import build as B
from glyphmill.containers import tables as T
from glyphmill.sources import workflow as W

from .catalogue import query
from .round_trips import BLOB, blobs, bytes_udf, members_of


def archive(parts) -> bytes:
    """A palette, a tile of one colour for each part, a map of one column that shows them in turn, and cells of the first four."""
    n = len(parts)
    tiles = B.tiles(b"".join(bytes([p["p_size"]]) * 64 for p in parts), 1, n)
    cell = B.cells([(8 * (k % 2), 8 * (k // 2), 2 * k) for k in range(4)])
    return B.narc([("a.bin", B.palette(list(range(256)))), ("b.bin", tiles), ("c.bin", B.screen(1, n, list(range(n)))), ("d.bin", cell)])


def packs(spark, d):
    """Archives as files, every third packed."""
    made = bytes_udf(lambda parts: archive(parts) if parts[0]["p_partkey"] % 3 else bios.rle_encode(archive(parts)))
    return blobs(spark, d).select(F.concat(F.lit("pack/"), F.col("blob").cast("string"), F.lit(".narc")).alias("path"), made("parts").alias("content"))


FIRST = f"(SELECT {BLOB} AS blob, min(p_partkey) AS least, count(*) AS n, string_agg(repeat(chr(CAST(p_size AS INTEGER)), 64), '' ORDER BY p_partkey) AS tiles, list(p_size ORDER BY p_partkey) AS sizes FROM part GROUP BY 1)"
WAY = "'pack/' || blob || '.narc#' || CASE WHEN least % 3 = 0 THEN 'codec:rle/' ELSE '' END || 'narc:'"


@query(f"""SELECT k.kind, {WAY} || 1 AS char, {WAY} || 0 AS pal, {WAY} || k.m AS map, 'pack/' || blob || '.narc/' || k.f AS name, 'ordered' AS layout
  FROM {FIRST}, (VALUES ('bg', 2, 'c.bin'), ('cell', 3, 'd.bin')) k(kind, m, f)""")
def scan_resources(spark, d):
    """Resources that a scan finds in archives, plain and packed."""
    return W.scan(packs(spark, d)).select("kind", "char", "pal", "map", "name", "layout")


def member_sql(name: str) -> str:
    return f"SELECT {BLOB} AS blob, {name} AS name, CAST(octet_length(encode(p_name)) AS INTEGER) AS size, sha256(p_name) AS sha256 FROM part"


MEMBERS = "array<struct<name:string,off:bigint,size:bigint>>"


@query(member_sql(f"lpad(CAST(row_number() OVER (PARTITION BY {BLOB} ORDER BY p_partkey) - 1 AS VARCHAR), 8, '0') || '.bin'"))
def archive_cpk(spark, d):
    """Archives of typed row packets: aligned files by id."""
    made = bytes_udf(lambda parts: T.cpk([b for _, b in members_of(parts)]))
    listed = F.udf(lambda data: [(e.name, e.off, e.size) for e in T.cpk_entries(bytes(data))], MEMBERS, useArrow=True)
    df = blobs(spark, d).select("blob", made("parts").alias("content")).withColumn("m", F.explode(listed("content")))
    body = F.col("content").substr((F.col("m.off") + 1).cast("int"), F.col("m.size").cast("int"))
    return df.select("blob", "m.name", F.col("m.size").cast("int").alias("size"), F.sha2(body, 256).alias("sha256"))


@query(f"SELECT {BLOB} AS blob, 'd' || p_partkey % 3 || '/' || p_partkey || '.ncgr' AS path FROM part")
def name_trees(spark, d):
    """Names of an archive without any, from the tree beside it."""
    made = bytes_udf(lambda parts: T.tree([f"d{p['p_partkey'] % 3}/{p['p_partkey']}.ncgr" for p in parts]))
    read = F.udf(lambda data: (lambda n: [p for _, p in sorted(T.assigned(["NCGR"] * len(n), n).items())])(T.tree_names(bytes(data))), "array<string>", useArrow=True)
    return blobs(spark, d).select("blob", F.explode(read(made("parts"))).alias("path"))


@query(f"SELECT {BLOB} AS blob, CAST(16 AS BIGINT) AS base, CAST(8 AS BIGINT) AS stride, CAST(1.0 AS DOUBLE) AS cover, count(*) AS sizes FROM part GROUP BY 1")
def offset_tables(spark, d):
    """A container's table of offsets, found from where its members lie."""

    def found(parts):
        bodies = [b.ljust(-(-len(b) // 4) * 4, b".") for _, b in members_of(parts)]
        at, head, spans = 8 + 8 * len(bodies), [0x4D4F, 0], []
        for b in bodies:
            spans.append((at, len(b)))
            head += [at - 16, len(b)]
            at += len(b)
        t = T.offset_table(np.array(head, "<u4").tobytes() + b"".join(bodies), spans)
        return t.base, t.stride, t.cover, len(t.sizes)

    seen = F.udf(found, "struct<base:bigint,stride:bigint,cover:double,sizes:bigint>", useArrow=True)
    return blobs(spark, d).select("blob", seen("parts").alias("t")).select("blob", "t.*")
