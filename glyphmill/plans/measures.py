"""Queries over names, locators and headerless contents made from the driver's tables, each with its SQL."""

from __future__ import annotations

import struct

from pyspark.sql import functions as F

from glyphmill.functions import names as N
from glyphmill.functions import raw as R
from glyphmill.sources.tables import table

from .catalogue import query
from .round_trips import BLOB, blobs, bytes_udf, words_of

#: Paths made of a part's row: folders of one kind, several extensions, packing suffixes.
EXTENSIONS = (".NCGR", ".ncbr", ".nclr_", ".ncl.l", ".bin", ".NSCR.lz", "_LZ.ncer", "", ".sdat", ".txt")
FOLDERS = ("Cell", "Character", "ui", "overlay9", "Data/ColorPalette")
PATH_SQL = f"""(CASE WHEN p_partkey % 7 = 0 THEN '' ELSE replace(p_brand, '#', '') || '/' END || list_extract({list(FOLDERS)}, CAST(p_partkey % {len(FOLDERS)} AS INTEGER) + 1) || '/'
  || replace(p_name, ' ', '_') || (p_partkey % 20) || list_extract({list(EXTENSIONS)}, CAST(p_size % {len(EXTENSIONS)} AS INTEGER) + 1))"""


def paths(spark, d):
    parts = table(spark, d, "part", "p_partkey", "p_name", "p_brand", "p_size", "p_retailprice")
    pick = lambda values, k: F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))
    key, size = F.col("p_partkey"), F.col("p_size")
    start = F.when(key % 7 == 0, "").otherwise(F.concat(F.regexp_replace("p_brand", "#", ""), F.lit("/")))
    return parts.withColumn("path", F.concat(start, pick(FOLDERS, key), F.lit("/"), F.regexp_replace("p_name", " ", "_"), (key % 20).cast("string"), pick(EXTENSIONS, size)))


LAST = "regexp_extract(path, '([^/]*)$', 1)"
STEM_SQL = rf"regexp_replace(regexp_replace(regexp_replace({LAST}, '(?i)\.(lz|cmp|z|lz77|l)$', ''), '\.[^.]*$', ''), '(?i)_(lz|cmp)$', '')"
EXT_SQL = rf"""CASE regexp_replace(lower(regexp_extract({LAST}, '(\.[^.]+)$', 1)), '_+$', '') WHEN '.l' THEN lower(regexp_extract({LAST}, '(\.[^.]+)\.[^.]+$', 1))
  WHEN '.ncbr' THEN '.ncgr' ELSE regexp_replace(lower(regexp_extract({LAST}, '(\.[^.]+)$', 1)), '_+$', '') END"""


@query(rf"""WITH p AS (SELECT p_partkey, {PATH_SQL} AS path FROM part)
SELECT p_partkey, {STEM_SQL} AS stem, {EXT_SQL} AS ext, starts_with(path, 'overlay9/') OR starts_with(path, 'overlay7/') AS code,
  CASE WHEN path LIKE '%/Cell/%' OR path LIKE '%/Character/%' OR path LIKE '%/ColorPalette/%' THEN regexp_extract(path, '^(.*)/[^/]+/[^/]+$', 1)
    WHEN path LIKE 'Cell/%' OR path LIKE 'Character/%' THEN '.' ELSE regexp_extract(path, '^(.*)/[^/]+$', 1) END AS folder FROM p""")
def path_parts(spark, d):
    """Stems, extensions, folders that pair, and code, which a scan leaves out unless asked."""
    p = F.col("path")
    return paths(spark, d).select("p_partkey", N.stem(p).alias("stem"), N.extension(p).alias("ext"), N.is_code(p).alias("code"), N.pair_folder(p).alias("folder"))


@query(rf"""WITH p AS (SELECT p_partkey, p_size, {PATH_SQL} AS path, p_partkey % 4 = 0 AS tex FROM part)
SELECT p_partkey, CASE WHEN tex THEN 'tex/' ELSE 'bg/' END || replace(replace(replace(path, '_', '@'), '@', '_at_'), ':', '_') || CASE WHEN tex THEN '_t' || p_size ELSE '' END || '_' || lpad(CAST(p_partkey AS VARCHAR), CAST(greatest(5, length(CAST(p_partkey AS VARCHAR))) AS INTEGER), '0') || '.png' AS png,
  'x/' || path || CASE WHEN tex THEN '_t' || p_size ELSE '' END || '__' || CASE WHEN tex THEN 'tex' ELSE 'bg' END || '_' || lpad(CAST(p_partkey AS VARCHAR), CAST(greatest(5, length(CAST(p_partkey AS VARCHAR))) AS INTEGER), '0') || '.png' AS mirrored,
  p_partkey % 3 = 0 OR p_partkey % 5 = 1 AS escapes,
  CASE WHEN p_size < 8 THEN p_size || ' B' WHEN p_size < 20 THEN printf('%.1f KB', CAST(p_size AS BIGINT) * 50000 / 1024.0) WHEN p_size < 35 THEN printf('%.1f MB', CAST(p_size AS BIGINT) * 2000000 / 1048576.0) ELSE printf('%.1f GB', CAST(p_size AS BIGINT) * 100000000 / 1073741824.0) END AS human FROM p""")
def output_names(spark, d):
    """Safe names of written pictures, paths that leave their folder, sizes to read."""
    key, size = F.col("p_partkey"), F.col("p_size")
    kind = F.when(key % 4 == 0, "tex").otherwise("bg")
    wild = F.regexp_replace("path", "_", "@")
    bad = F.when(key % 3 == 0, F.concat(F.lit("a/../../"), "path")).when(key % 5 == 1, F.concat(F.lit("/"), "path")).otherwise(F.concat(F.lit("./a/../"), "path"))
    n = F.when(size < 8, size.cast("long")).when(size < 20, size.cast("long") * 50000).when(size < 35, size.cast("long") * 2000000).otherwise(size.cast("long") * 100000000)
    big = n.cast("long")
    return paths(spark, d).select("p_partkey", N.png_name(kind, wild, size, key).alias("png"), N.mirrored_png_name(kind, F.col("path"), F.lit("x"), size, key).alias("mirrored"), N.escapes(bad).alias("escapes"), N.human_size(big).alias("human"))


@query(rf"""WITH p AS (SELECT p_partkey, p_size * 4 AS size, {PATH_SQL} AS path FROM part)
SELECT CASE WHEN starts_with(path, 'overlay9/') THEN 'code' WHEN path LIKE '%.sdat' THEN 'sound' WHEN path LIKE '%.txt' THEN 'text' WHEN size < 64 THEN 'tiny' ELSE 'unknown' END AS reason, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM p GROUP BY 1""")
def file_reasons(spark, d):
    df = paths(spark, d).withColumn("size", (F.col("p_size") * 4).cast("long"))
    return df.groupBy(N.reason(F.col("path"), F.col("size")).alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))


@query(rf"""WITH p AS (SELECT p_partkey, p_size, {PATH_SQL} AS path FROM part)
SELECT p_partkey, 'file:' || path || CASE WHEN p_size % 3 = 0 THEN ' > codec:lz11 > narc:' || p_partkey WHEN p_size % 3 = 1 THEN ' > lz:0 > slice:4' ELSE ' > narc:1 > lz:16' END AS text,
  CASE WHEN p_size % 3 = 0 THEN 'lz11' ELSE 'lz10' END AS codecs, CASE WHEN p_size % 3 = 1 THEN '-' ELSE 'narc' END AS container, path AS file,
  'file:' || path || CASE WHEN p_size % 3 = 0 THEN '/codec:lz11/narc:' || p_partkey WHEN p_size % 3 = 1 THEN '/codec:lz10/slice:4:8' ELSE '/narc:1/lz:16:lz10' END AS key,
  'container narc of ' || p_size || ' members, packed: ' || CASE WHEN p_size % 3 = 0 THEN 'no' ELSE 'lz10 + rle' END AS diagnosis FROM p""")
def locators(spark, d):
    """Ways into a file as text: codecs and containers on them, the file, and keys that hold across edits."""
    key, k = F.col("p_partkey").cast("string"), F.col("p_size") % 3
    steps = F.when(k == 0, F.array(F.lit("codec:lz11"), F.concat(F.lit("narc:"), key))).when(k == 1, F.array(F.lit("lz:0:lz10:99"), F.lit("slice:4:8"))).otherwise(F.array(F.lit("narc:1"), F.lit("lz:16:lz10:77")))
    df = paths(spark, d).withColumn("loc", F.concat(F.array(F.concat(F.lit("file:"), "path")), steps))
    loc, none = F.col("loc"), F.lit(None).cast("string")
    codecs = F.when(k == 0, F.array(F.lit("none"))).otherwise(F.array(F.lit("rle"), F.lit("none"), F.lit("lz10"), F.lit("rle")))
    return df.select(
        "p_partkey", N.locator_text(loc).alias("text"), N.codecs_of(loc).alias("codecs"), N.container_of(loc).alias("container"), N.resource_file(loc, none, none).alias("file"),
        N.locator_key(loc).alias("key"), N.diagnosis(F.lit("narc"), F.col("p_size"), codecs).alias("diagnosis"),
    )


@query(f"""SELECT {BLOB} AS blob, count(*) % 16 = 0 AND count(*) <= 256 AND bool_and((p_size * 613 + CAST(floor(p_retailprice) AS INTEGER) + p_partkey % 2 * 0) & 65535 < 32768) AS palette,
  count(DISTINCT (p_size * 613 + CAST(floor(p_retailprice) AS INTEGER)) & 1023) FILTER (((p_size * 613 + CAST(floor(p_retailprice) AS INTEGER)) & 1023) > 0) >= 8 AND count(*) >= 64
    AND (count(DISTINCT ((p_size * 613 + CAST(floor(p_retailprice) AS INTEGER)) & 65535) >> 12) >= 2 OR bool_or(((p_size * 613 + CAST(floor(p_retailprice) AS INTEGER)) & 3072) > 0)) AS screen,
  CAST(max(p_size) AS INTEGER) AS bits FROM part GROUP BY 1""")
def headerless(spark, d):
    """Palettes and maps told by their words alone."""
    made = bytes_udf(lambda parts: struct.pack(f"<{len(parts)}H", *[(p["p_size"] * 613 + p["price"]) & 0xFFFF for p in parts]))
    df = blobs(spark, d).withColumn("raw", made("parts"))
    return df.select("blob", R.is_palette(F.col("raw")).alias("palette"), R.is_screen(F.col("raw")).alias("screen"), F.array_max("parts.p_size").alias("bits"))


def exports(spark, d):
    """Stripped exports and header files made of blobs: tiles, colours, a map, a bitmap's header, and broken ones."""

    def made(parts, blob):
        n, w = len(parts), words_of(parts)
        kind = blob % 6
        if kind == 0:
            return b"NCG\0" + struct.pack("<HBB", n, 0, 0) + bytes(32 * n)
        if kind == 1:
            return b"NCG\0" + struct.pack("<HBB", n, 1, 0) + bytes(64 * n)
        if kind == 2:
            return b"NCL\0" + struct.pack("<HH", n, 0) + struct.pack(f"<{n}H", *w)
        if kind == 3:
            return b"NSC\0" + struct.pack("<HHBBH", n, 0, 1, n, 0) + struct.pack(f"<{n}H", *w)
        if kind == 4:
            return b"SBMP" + struct.pack("<BBHH", 0, 8, n, 2 * n)
        return struct.pack("<3I", n, 1, 12) + struct.pack(f"<{n}H", *w)

    build = F.udf(lambda parts, blob: made(parts, blob), "binary", useArrow=True)
    return blobs(spark, d).withColumn("raw", build("parts", "blob")).withColumn("n", F.size("parts"))


@query(f"""WITH b AS (SELECT {BLOB} AS blob, CAST(count(*) AS INTEGER) AS n FROM part GROUP BY 1)
SELECT blob, CASE blob % 6 WHEN 0 THEN 'NCG' || chr(0) WHEN 1 THEN 'NCG' ELSE '' END = 'NCG' AS wide, CASE blob % 6 WHEN 0 THEN 'char' WHEN 1 THEN 'char' WHEN 2 THEN 'pal' WHEN 3 THEN 'screen' END AS kind,
  CAST(CASE blob % 6 WHEN 0 THEN 4 WHEN 1 THEN 8 END AS INTEGER) AS bpp, CAST(CASE WHEN blob % 6 = 4 THEN n END AS INTEGER) AS bitmap_width, CAST(CASE WHEN blob % 6 = 4 THEN 2 * n END AS INTEGER) AS bitmap_height,
  CAST(CASE WHEN blob % 6 = 3 THEN 1 WHEN blob % 6 = 5 THEN n END AS INTEGER) AS cols, CAST(CASE WHEN blob % 6 = 3 THEN n WHEN blob % 6 = 5 THEN 1 END AS INTEGER) AS rows,
  CASE blob % 6 WHEN 4 THEN 'SBMP' WHEN 5 THEN 'x' || lpad(printf('%x', n), 2, '0') || '000000' WHEN 2 THEN 'x4e434c00' WHEN 3 THEN 'x4e534300' ELSE 'x4e434700' END AS magic FROM b""")
def stripped_exports(spark, d):
    df, raw = exports(spark, d), F.col("raw")
    small, head, size = R.lite(raw), R.bitmap_header(raw), R.screen_size(raw)
    told = lambda f: F.when(size["declared"], size[f])
    return df.select("blob", F.coalesce(small["bpp"] == 8, F.lit(False)).alias("wide"), small["kind"].alias("kind"), small["bpp"].alias("bpp"), head["width"].alias("bitmap_width"), head["height"].alias("bitmap_height"), told("cols").alias("cols"), told("rows").alias("rows"), R.magic(raw).alias("magic"))


@query("""SELECT p_partkey, CAST(CASE WHEN n IN (16, 64, 256, 1024) THEN CAST(sqrt(n) AS BIGINT) WHEN n % 256 = 0 THEN 256 WHEN n % 128 = 0 THEN 128 WHEN n % 64 = 0 THEN 64 WHEN n % 32 = 0 THEN 32 WHEN n % 16 = 0 THEN 16 WHEN n % 8 = 0 THEN 8 ELSE 64 END AS BIGINT) AS width
  FROM (SELECT p_partkey, p_size * 8 + CASE WHEN p_partkey % 9 = 0 THEN 3 ELSE 0 END AS n FROM part)""")
def texture_widths(spark, d):
    n = F.col("p_size").cast("long") * 8 + F.when(F.col("p_partkey") % 9 == 0, 3).otherwise(0)
    return table(spark, d, "part", "p_partkey", "p_size").select("p_partkey", R.texture_size(n)["width"].alias("width"))


@query(f"""SELECT {BLOB} AS blob, md5(string_agg(p_name, chr(10) ORDER BY p_partkey) || '(' || count(*) || ', 1)') AS pixel_hash,
  CAST(length(string_agg(p_name, chr(10) ORDER BY p_partkey)) AS INTEGER) AS size FROM part GROUP BY 1""")
def pixel_hashes(spark, d):
    """A picture's hash takes its shape in."""
    df = blobs(spark, d)
    shape = F.concat(F.lit("("), F.size("parts").cast("string"), F.lit(", 1)"))
    return df.select("blob", R.pixel_hash(F.col("content"), shape).alias("pixel_hash"), F.length("content").alias("size"))
