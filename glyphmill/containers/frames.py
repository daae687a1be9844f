"""Archives as tables: one row per member, and archives written again from changed members."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.containers import archives as A

SPANS = "struct<container:string,spans:array<struct<ordinal:int,name:string,off:bigint,size:bigint,how:string,full:bigint,flags:bigint>>>"


def members(df: DataFrame, key: str, content: str = "content", kind: str | None = None) -> DataFrame:
    """(key, container, ordinal, name, off, size, how, payload) for each member of each archive.

    Python gives the spans only; stored members are sliced in the JVM, and just those with a codec go back to
    Python. Rows that are no archive (of `kind`, if named), nulls and empty contents give no rows; empty slots give
    an empty payload; a member whose codec fails a null one.
    """

    @F.udf(SPANS, useArrow=True)
    def spans(data):
        if data is None:
            return None
        data = bytes(data)
        found = A.detect(data) if kind is None else (kind, A.KINDS[kind].spans(data))
        return found and found[1] and (found[0], [(s.ordinal, s.name, s.off, s.size, s.how, s.full, s.flags) for s in found[1]]) or None

    @F.udf("binary", useArrow=True)
    def payload(how, raw, full):
        try:
            return None if how == "stored" else A.decode(how, bytes(raw), full)
        except (ValueError, A.zlib.error):
            return None

    if kind and A.KINDS[kind].magic:
        magic = A.KINDS[kind].magic
        df = df.where(F.substring(F.col(content), 1, len(magic)) == F.lit(magic))
    rows = df.select(key, content, spans(content).alias("__s")).where("__s IS NOT NULL")
    rows = rows.select(key, content, "__s.container", F.explode("__s.spans").alias("__m")).select(key, content, "container", "__m.*")
    raw = F.col(content).substr((F.col("off") + 1).cast("int"), F.col("size").cast("int"))
    rows = rows.select(key, "container", "ordinal", "name", "off", "size", "how", "full", raw.alias("__raw"))
    body = F.when(F.col("how") == "stored", F.col("__raw")).otherwise(payload("how", F.when(F.col("how") != "stored", F.col("__raw")), "full"))
    return rows.select(key, "container", "ordinal", "name", "off", "size", "how", body.alias("payload"))


def repack(df: DataFrame, changes: DataFrame, key: str, content: str = "content") -> DataFrame:
    """df with `content` rewritten where `changes` (key, ordinal, payload) names members; `error` says why one was not.

    The changes of one archive are gathered in one row, no more than the archive itself. Of two changes of a member
    the one with the greater payload counts. Archives without changes keep their bytes and never reach Python.
    """
    one = changes.groupBy(key, "ordinal").agg(F.max("payload").alias("payload"))
    edits = one.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("ordinal", "payload"))).alias("__edits"))

    @F.udf("struct<data:binary,error:string>", useArrow=True)
    def run(data, new):
        if new is None:
            return None
        data = bytes(data)
        found = A.detect(data)
        if found is None:
            return None, "no archive"
        try:
            return A.pack(found[0], data, {int(k): bytes(v) for k, v in dict(new).items()}), None
        except ValueError as e:
            return None, str(e)

    both = df.join(edits, key, "left")
    has: Column = F.col("__edits").isNotNull()
    both = both.withColumn("__new", F.when(has, run(F.when(has, F.col(content)), "__edits")))
    return both.select(*[F.coalesce("__new.data", content).alias(content) if c == content else F.col(c) for c in df.columns], F.col("__new.error").alias("error"))


def pack_group(path: Column) -> Column:
    """The name that sibling packs share: the first type word of the file's stem removed, `pack` where nothing is left.

    Members of sibling packs with the same ordinal belong together: join on the group and the ordinal.
    """
    folder = F.regexp_extract(path, "^(.*)/[^/]*$", 1)
    stem = F.regexp_replace(F.regexp_extract(path, "([^/]*)$", 1), r"\.[^.]*$", "")
    shared = F.regexp_replace(stem, f"(?i)^(.*?)({'|'.join(A.PACK_TYPES)})", "$1")
    return F.concat(F.when(folder != "", F.concat(folder, F.lit("/"))).otherwise(""), F.when(shared == "", "pack").otherwise(shared))
