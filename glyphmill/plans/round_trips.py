"""Queries that write bytes and read them back: rows of the driver's tables are packed into archives, streams, images and
graphics files inside the query, parsed again by the operators, and compared with plain SQL over the same rows.

A blob is the parts of BLOCK consecutive keys: bounded groups, however many parts there are.
"""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.codecs import studio
from glyphmill.containers import archives as A
from glyphmill.containers import build as B
from glyphmill.containers import frames
from glyphmill.formats import graphics as G
from glyphmill.formats import nitro
from glyphmill.sources import cartridge as C
from glyphmill.sources.explore import explore
from glyphmill.sources.tables import table

from .catalogue import ORACLES, QUERIES, query

BLOCK = 64
BLOB = f"CAST(p_partkey // {BLOCK} AS BIGINT)"


def named(name: str, oracle: str):
    """Registers a query under a name made from a table of kinds."""

    def add(fn):
        fn.__name__ = name
        return query(oracle)(fn)

    return add


def blobs(spark, d: str) -> DataFrame:
    """blob, parts (key, name in key order) and content: the names, a line each."""
    parts = table(spark, d, "part", "p_partkey", "p_name", "p_size", "p_retailprice")
    row = F.struct("p_partkey", "p_name", "p_size", F.floor("p_retailprice").cast("int").alias("price"))
    made = parts.groupBy(F.expr(f"p_partkey div {BLOCK}").alias("blob")).agg(F.array_sort(F.collect_list(row)).alias("parts"))
    return made.withColumn("content", F.array_join("parts.p_name", "\n").cast("binary"))


def bytes_udf(fn):
    return F.udf(lambda *a: None if a[0] is None else fn(*a), "binary", useArrow=True)


def members_of(parts) -> list[tuple[str, bytes]]:
    return [(f"{p['p_partkey']}.bin", p["p_name"].encode()) for p in parts]


# --- codecs --------------------------------------------------------------------------------

CODEC_SQL = f"""
SELECT {BLOB} AS blob, CAST(octet_length(encode(string_agg(p_name, chr(10) ORDER BY p_partkey))) AS INTEGER) AS size,
  sha256(string_agg(p_name, chr(10) ORDER BY p_partkey)) AS sha256, true AS consumed FROM part GROUP BY 1
"""


def codec_query(codec: str):
    @named(f"codec_{codec}", CODEC_SQL)
    def run(spark, d):
        decode, encode = studio.CODECS[codec]

        def there_and_back(data):
            raw = bytes(data)
            # halfwords; and bytes that one codec leaves plain
            raw = bytes(studio.PLAIN_START if codec == "crilayla" else 0) + raw + bytes(len(raw) % 2 if codec == "diff16" else 0)
            packed = encode(raw)
            out, used = decode(packed)
            start = out.index(data[:1]) if codec == "crilayla" else 0
            return out[start : start + len(data)], len(packed) - 4 < used <= len(packed)

        back = F.udf(there_and_back, "struct<data:binary,consumed:boolean>", useArrow=True)
        df = blobs(spark, d).select("blob", back("content").alias("b"))
        return df.select("blob", F.length("b.data").alias("size"), F.sha2("b.data", 256).alias("sha256"), "b.consumed")


for _codec in studio.CODECS:
    codec_query(_codec)


# --- archives ------------------------------------------------------------------------------

#: Layouts that store no names.
NAMELESS = {"ntrp", "offset_archive", "member_table", "pair_table", "indexpack", "lzchain"}


def archive_sql(named_: bool, payload: str) -> str:
    label = "p_partkey || '.bin'" if named_ else "CAST(NULL AS VARCHAR)"
    return f"""SELECT {BLOB} AS blob, CAST(row_number() OVER (PARTITION BY {BLOB} ORDER BY p_partkey) - 1 AS INTEGER) AS ordinal, {label} AS name,
  CAST(octet_length(encode({payload})) AS INTEGER) AS size, sha256({payload}) AS sha256 FROM part"""


def archive_rows(df: DataFrame) -> DataFrame:
    return df.select("blob", "ordinal", "name", F.length("payload").alias("size"), F.sha2("payload", 256).alias("sha256"))


def archive_queries(kind: str):
    def archives(spark, d):
        written = bytes_udf(lambda parts: B.BUILDERS[kind](members_of(parts)))
        return blobs(spark, d).select("blob", "parts", written("parts").alias("content"))

    @named(f"archive_{kind}", archive_sql(kind not in NAMELESS, "p_name"))
    def read(spark, d):
        return archive_rows(frames.members(archives(spark, d).select("blob", "content"), "blob", kind=kind))

    if A.KINDS[kind].lay is None:
        return
    # every third key's member is written anew; a table whose first body moves no longer shows where it ends
    edited = "CASE WHEN p_partkey % 3 = 1 AND p_partkey % 64 > 1 THEN p_name || ' (edited) ' || p_name ELSE p_name END"

    @named(f"archive_{kind}_edited", archive_sql(kind not in NAMELESS, edited))
    def edit(spark, d):
        made = archives(spark, d)
        each = made.select("blob", F.posexplode("parts").alias("ordinal", "p")).where("p.p_partkey % 3 = 1 AND p.p_partkey % 64 > 1")
        changes = each.select("blob", "ordinal", F.concat("p.p_name", F.lit(" (edited) "), "p.p_name").cast("binary").alias("payload"))
        again = frames.repack(made.select("blob", "content"), changes, "blob")
        return archive_rows(frames.members(again.select("blob", "content"), "blob", kind=kind))


for _kind in B.BUILDERS:
    archive_queries(_kind)


@query(f"""SELECT {BLOB} AS blob, {BLOB} || '/inner.narc.l/' || p_partkey || '.bin' AS item, sha256(p_name) AS sha256,
  'narc:0 codec:lz10 narc:' || (row_number() OVER (PARTITION BY {BLOB} ORDER BY p_partkey) - 1) AS loc FROM part""")
def nested_archives(spark, d):
    """Archives inside an LZ stream inside an archive, walked by the explore pass."""
    made = bytes_udf(lambda parts: B.narc([("inner.narc.l", studio.lz_encode_best(B.narc([(n, nitro_file(b)) for n, b in members_of(parts)])))]))
    files = blobs(spark, d).select(F.col("blob").cast("string").alias("path"), made("parts").alias("content"))
    found = explore(files).where("kind = 'NCLR'")
    body = F.expr("substring(content, 41, length(content) - 40)")
    return found.select(F.col("path").cast("long").alias("blob"), "item", F.sha2(body, 256).alias("sha256"), F.array_join("loc", " ").alias("loc"))


def nitro_file(body: bytes) -> bytes:
    """A file with a palette's header whose block ends with the given bytes."""
    return B.nitro(b"RLCN", (b"TTLP", struct.pack("<4I", 3, 0, len(body), 16) + body))


# --- finding files inside others -----------------------------------------------------------

SPANS = "array<struct<off:bigint,size:bigint,kind:string>>"


@query(f"""SELECT {BLOB} AS blob, CAST(row_number() OVER (PARTITION BY {BLOB} ORDER BY p_partkey) - 1 AS INTEGER) AS ordinal,
  CAST(40 + octet_length(encode(p_name)) AS BIGINT) AS size, 'NCLR' AS kind, sha256(p_name) AS sha256 FROM part""")
def carved(spark, d):
    """Files with a header between junk bytes, in the order of their offsets."""
    made = bytes_udf(lambda parts: b"junk ".join(nitro_file(b) for _, b in members_of(parts)))
    spans = F.udf(lambda data: [*nitro.carve(bytes(data))], SPANS, useArrow=True)
    df = blobs(spark, d).select("blob", made("parts").alias("content"))
    each = df.select("blob", "content", F.posexplode(spans("content")).alias("ordinal", "s"))
    body = F.expr("substring(content, cast(s.off as int) + 41, cast(s.size as int) - 40)")
    return each.select("blob", "ordinal", "s.size", "s.kind", F.sha2(body, 256).alias("sha256"))


@query(f"SELECT {BLOB} AS blob, CAST(count(*) AS INTEGER) AS n, CAST(sum(40 + octet_length(encode(p_name))) AS BIGINT) AS size, 'lz10' AS codec, 'NCLR' AS kind FROM part GROUP BY 1")
def carved_streams(spark, d):
    """Packed streams inside other bytes, by the header that their payload begins with."""
    made = bytes_udf(lambda parts: b"".join(A.aligned(studio.lz_encode_best(nitro_file(b))) + b"junk" for _, b in members_of(parts)))
    spans = F.udf(lambda data: [(a, n, c, k) for a, c, n, k in nitro.carve_packed(bytes(data))], "array<struct<off:bigint,size:bigint,codec:string,kind:string>>", useArrow=True)
    each = blobs(spark, d).select("blob", F.explode(spans(made("parts"))).alias("s"))
    return each.groupBy("blob", "s.codec", "s.kind").agg(F.count(F.lit(1)).cast("int").alias("n"), F.sum("s.size").alias("size"))


# --- cartridge images ----------------------------------------------------------------------


def image(parts) -> bytes:
    files = [(f"d{p['p_partkey'] % 4}/{p['p_partkey']}.bin" if p["p_partkey"] % 2 else f"{p['p_partkey']}.bin", p["p_name"].encode()) for p in parts]
    icon = bytes(p["p_size"] & 0xFF for p in parts).ljust(512, b"\0")
    banner = B.banner(icon, [p["price"] & 0x7FFF for p in parts[:16]] + [0] * (16 - len(parts[:16])), [parts[0]["p_name"]] * 6)
    return B.cartridge(f"BLOB{parts[0]['p_partkey']}", "ABCE", files, arm9=parts[0]["p_name"].encode(), arm7=parts[-1]["p_name"].encode(), banner=banner, overlays=[p["p_name"].upper().encode() for p in parts[:2]])


#: Bytes of made contents that Python holds and sends at a time; a longer one goes alone.
STEP_BYTES = 2 << 20


def in_steps(make, limit: int = STEP_BYTES):
    """For mapInArrow over (blob, parts): (blob, content) in batches of at most `limit` bytes, however many rows come in at once."""

    def run(batches):
        for batch in batches:
            blob, parts = batch.columns
            done, start, size = [], 0, 0
            send = lambda: pa.RecordBatch.from_arrays([blob.slice(start, len(done)), pa.array(done, pa.binary())], names=["blob", "content"])  # noqa: B023, E731
            for k in range(batch.num_rows):
                one = make(parts[k].as_py())
                if done and size + len(one) > limit:
                    yield send()
                    done, start, size = [], k, 0
                done.append(one)
                size += len(one)
            if done:
                yield send()

    return run


def images(spark, d: str) -> DataFrame:
    """An image is some 20 KB even of a few parts: Arrow's batches of 10,000 rows would be 200 MB of them."""
    return blobs(spark, d).select("blob", "parts").mapInArrow(in_steps(image), "blob long, content binary")


PATH = "CASE WHEN p_partkey % 2 = 1 THEN 'd' || p_partkey % 4 || '/' ELSE '' END || p_partkey || '.bin'"
FIRST_TWO = f"SELECT *, row_number() OVER (PARTITION BY {BLOB} ORDER BY p_partkey) AS r FROM part"
FILES_SQL = f"""
SELECT {BLOB} AS blob, {PATH} AS path, CAST(octet_length(encode(p_name)) AS BIGINT) AS size, sha256(p_name) AS sha256 FROM part
UNION ALL SELECT {BLOB}, 'overlay9/overlay_000' || (r - 1) || '.bin', CAST(octet_length(encode(upper(p_name))) AS BIGINT), sha256(upper(p_name)) FROM ({FIRST_TWO}) WHERE r <= 2
"""


@query(FILES_SQL)
def cartridge_files(spark, d):
    """Named files and overlays of images, through folders of their name tables."""
    return C.files(images(spark, d), "blob").select("blob", "path", "size", F.sha2("content", 256).alias("sha256"))


@query(f"""SELECT {BLOB} AS blob, CAST(r - 1 AS BIGINT) AS id, CAST(octet_length(encode(p_name)) AS BIGINT) AS ram_size, CAST(count(*) OVER (PARTITION BY {BLOB}) + r - 1 AS BIGINT) AS fid, false AS compressed
  FROM ({FIRST_TWO}) QUALIFY r <= 2""")
def cartridge_overlays(spark, d):
    rows = F.udf(lambda data: [(o["id"], o["size"], o["fid"], o["compressed"]) for o in C.Cartridge(bytes(data)).overlays], "array<struct<id:bigint,ram_size:bigint,fid:bigint,compressed:boolean>>", useArrow=True)
    return images(spark, d).select("blob", F.explode(rows("content")).alias("o")).select("blob", "o.*")


@query(f"""SELECT {BLOB} AS blob, 'BLOB' || min(p_partkey) AS title, 'ABCE' AS code, sha256(arg_min(p_name, p_partkey)) AS arm9, sha256(arg_max(p_name, p_partkey)) AS arm7,
  CAST(2112 AS INTEGER) AS banner_size, arg_min(p_name, p_partkey) AS banner_title, true AS looks_like FROM part GROUP BY 1""")
def cartridge_regions(spark, d):
    """Program regions named by the header, sliced in the JVM; header texts; the banner's size by its version, and its title."""

    def region(cpu: int):
        at, size = (C.word(F.col("content"), 0x20 + 4 * C.REGIONS.index(f"arm{cpu}_{x}")) for x in ("off", "size"))
        return F.sha2(F.col("content").substr((at + 1).cast("int"), size.cast("int")), 256).alias(f"arm{cpu}")

    seen = F.udf(lambda data: (lambda c: (c.text("title"), c.text("code"), len(c.banner()), G.Banner(c.banner()).titles()[0]))(C.Cartridge(bytes(data))), "struct<title:string,code:string,banner_size:int,banner_title:string>", useArrow=True)
    return images(spark, d).select("blob", seen("content").alias("c"), region(9), region(7), C.looks_like_cartridge(F.col("content")).alias("looks_like")).select("blob", "c.*", "arm9", "arm7", "looks_like")


EDITED = "CASE WHEN p_partkey % 5 = 2 THEN p_name || p_name || '!' ELSE p_name END"


@query(FILES_SQL.replace("octet_length(encode(p_name))", f"octet_length(encode({EDITED}))").replace("sha256(p_name)", f"sha256({EDITED})"))
def cartridge_rebuilt(spark, d):
    """Images with some files changed, read again: all others keep their bytes."""

    def rebuild(data):
        c = C.Cartridge(bytes(data))
        return c.rebuild({i: c.read(i) * 2 + b"!" for i, p, _, _ in c.files() if not p.startswith("overlay") and int(p.split("/")[-1][:-4]) % 5 == 2})

    made = images(spark, d).select("blob", bytes_udf(rebuild)("content").alias("content"))
    return C.files(made, "blob").select("blob", "path", "size", F.sha2("content", 256).alias("sha256"))


@query(f"SELECT {BLOB} AS blob, {PATH} AS path FROM part WHERE p_partkey % 5 = 2")
def cartridge_changed(spark, d):
    """Which files an edit has changed, by digests, and by file ids inside the image."""

    def rebuild(data):
        c = C.Cartridge(bytes(data))
        out = c.rebuild({i: c.read(i) * 2 + b"!" for i, p, _, _ in c.files() if not p.startswith("overlay") and int(p.split("/")[-1][:-4]) % 5 == 2})
        assert [c.names[i] for i in C.differing(bytes(data), out)] == [p for _, p, _, _ in c.files() if not p.startswith("overlay") and int(p.split("/")[-1][:-4]) % 5 == 2]
        return out

    before = images(spark, d)
    after = before.select("blob", bytes_udf(rebuild)("content").alias("content"))
    return C.changed(C.files(before, "blob"), C.files(after, "blob"), "blob").select("blob", "path")


# --- graphics files ------------------------------------------------------------------------

WORD = "(p_size * 613 + CAST(floor(p_retailprice) AS INTEGER)) & 32767"


def words_of(parts) -> list[int]:
    return [(p["p_size"] * 613 + p["price"]) & 0x7FFF for p in parts]


def eight(shift: int) -> str:
    v = f"(({WORD}) >> {shift} & 31)"
    return f"CAST(({v} << 3) | ({v} >> 2) AS INTEGER)"


INDEX = f"CAST(row_number() OVER (PARTITION BY {BLOB} ORDER BY p_partkey) - 1 AS INTEGER)"


@query(f"SELECT {BLOB} AS blob, {INDEX} AS idx, {eight(0)} AS r, {eight(5)} AS g, {eight(10)} AS b FROM part")
def palette_file(spark, d):
    made = bytes_udf(lambda parts: B.palette(words_of(parts)))
    df = blobs(spark, d).select("blob", G.palette(made("parts")).alias("p")).select("blob", F.posexplode("p.value.colours").alias("idx", "c"))
    return df.select("blob", "idx", F.col("c")[0].alias("r"), F.col("c")[1].alias("g"), F.col("c")[2].alias("b"))


@query(f"SELECT {BLOB} AS blob, {INDEX} AS idx, CAST(({WORD}) & 1023 AS INTEGER) AS tile, CAST(({WORD}) >> 10 & 3 AS INTEGER) AS flip, CAST(({WORD}) >> 12 AS INTEGER) AS pal FROM part")
def screen_file(spark, d):
    """Map entries: tile number, mirroring, palette row."""
    made = bytes_udf(lambda parts: B.screen(1, len(parts), words_of(parts)))
    df = blobs(spark, d).select("blob", G.screen(made("parts")).alias("s")).select("blob", F.posexplode("s.value.entries").alias("idx", "e"))
    e = F.col("e")
    return df.select("blob", "idx", e.bitwiseAND(1023).alias("tile"), F.shiftright(e, 10).bitwiseAND(3).alias("flip"), F.shiftright(e, 12).alias("pal"))


@query(f"SELECT {BLOB} AS blob, CAST(count(*) * 64 AS INTEGER) AS n, CAST(sum(p_size) * 64 AS BIGINT) AS total, CAST(1 AS INTEGER) AS width, CAST(count(*) AS INTEGER) AS height FROM part GROUP BY 1")
def tiles_file(spark, d):
    """A tile of one colour for each part."""
    made = bytes_udf(lambda parts: B.tiles(b"".join(bytes([p["p_size"]]) * 64 for p in parts), 1, len(parts)))
    df = blobs(spark, d).select("blob", G.tiles(made("parts")).alias("t")).select("blob", "t.value.*")
    total = F.expr("aggregate(transform(sequence(1, length(pixels)), i -> cast(ascii(decode(substring(pixels, i, 1), 'ISO-8859-1')) as long)), 0L, (a, x) -> a + x)")
    return df.select("blob", F.length("pixels").alias("n"), total.alias("total"), "width", "height")


@query(f"SELECT {BLOB} AS blob, {INDEX} AS ordinal, CAST(p_size - 25 AS INTEGER) AS x, CAST(p_partkey % 100 - 50 AS INTEGER) AS y, CAST(p_size AS INTEGER) AS tile FROM part")
def cells_file(spark, d):
    """Sprite pieces: signed places and tile numbers."""
    made = bytes_udf(lambda parts: B.cells([(p["p_size"] - 25, p["p_partkey"] % 100 - 50, p["p_size"]) for p in parts]))
    df = blobs(spark, d).select("blob", G.pieces(made("parts")).alias("c")).select("blob", F.explode("c.value.pieces").alias("p"))
    return df.select("blob", "p.ordinal", "p.x", "p.y", "p.tile")


__all__ = ["ORACLES", "QUERIES"]
