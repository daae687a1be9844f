"""Scan, dump, insert: files to resources, resources to pictures in a folder, edited pictures back into files.

Everything is a table: files (path, content), resources (id, kind, name, char, pal, map: locators `path#step/step`), pictures
(id, png, hash, image, ...). A locator without steps is the whole file. A dump is a folder with the pictures, `manifest` (a row
a resource) and `source` (what it was made from); an insert takes all of it or nothing.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.containers.archives import Refused
from glyphmill.formats import layout, png
from glyphmill.functions import names as N
from glyphmill.operators import resources as R

from . import cartridge as C
from .explore import explore
from .publish import exists, publish_files, publish_new
from .session import EditError, contents, edited

RENDERED = ("bg", "cell", "atlas")


def locator(path: str = "path", loc: str = "loc") -> Column:
    return F.concat(F.col(path), F.lit("#"), F.array_join(F.coalesce(F.col(loc), F.array().cast("array<string>")), "/"))


def path_of(at: Column) -> Column:
    return F.regexp_extract(at, "^(.*)#[^#]*$", 1)


def steps_of(at: Column) -> Column:
    last = F.regexp_extract(at, "#([^#]*)$", 1)
    return F.when(last == "", F.array().cast("array<string>")).otherwise(F.split(last, "/"))


def scan(files: DataFrame, only: str | None = None, include_code: bool = False, include_3d: bool = True) -> DataFrame:
    """Resources (id, kind, name, char, pal, map, layout, owner) of files (path, content); paths are filtered before contents are read."""
    if only:
        files = files.where(N.matches(F.col("path"), only))
    if not include_code:
        files = files.where(~N.is_code(F.col("path")))
    found = explore(files).where("kind IS NOT NULL").select("path", "pos", "item", "kind", locator().alias("loc"), F.size("loc").alias("depth"), "loc")
    # kept for the session, without contents: files are walked once
    found = found.toDF("path", "pos", "item", "kind", "at", "depth", "steps").persist()
    # codecs alone don't make a container: such files pair by their names
    held = F.exists("steps", lambda s: ~s.startswith("codec:"))
    loose = found.where(~held)
    alone = R.pair_loose(loose.select("path", "kind", F.col("at").alias("loc"))).select("kind", "char", "pal", "map", F.lit("loose").alias("layout"), path_of(F.col("char")).alias("owner"))
    # items of a container: the path and all steps but the last
    owner = F.concat_ws("#", "path", F.array_join(F.slice("steps", 1, F.greatest(F.size("steps") - 1, F.lit(0))), "/"))
    inside = R.pair_ordered(found.where(held).select(owner.alias("owner"), "pos", "kind", F.col("at").alias("loc"))).select("kind", "char", "pal", "map", F.lit("ordered").alias("layout"), "owner")
    flat = alone.unionByName(inside)
    if include_3d:
        solid = found.where(F.col("kind").isin("NSBTX", "NSBMD")).select(F.lit("tex").alias("kind"), F.col("at").alias("char"), F.lit(None).cast("string").alias("pal"), F.lit(None).cast("string").alias("map"), F.lit("3d").alias("layout"), F.col("path").alias("owner"))
        flat = flat.unionByName(solid)
    name = found.select(F.col("at").alias("char"), F.col("item").alias("char_item"))
    map_name = found.select(F.col("at").alias("map"), F.col("item").alias("map_item"))
    flat = flat.join(name, "char", "left").join(map_name, "map", "left").withColumn("name", F.coalesce("map_item", "char_item"))
    flat = R.numbered(flat.withColumn("phase", F.when(F.col("layout") == "loose", 1).otherwise(0)), "phase", "name", "char")
    return flat.select("id", "kind", "name", "char", "pal", "map", "layout", "owner")


def stats(resources: DataFrame) -> DataFrame:
    """Resources by kind and layout, and how many have no palette."""
    return resources.groupBy("kind", "layout").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("pal").isNull()).alias("without_palette"))


def with_parts(files: DataFrame, resources: DataFrame) -> DataFrame:
    """resources with the bytes of their tiles, palettes and maps."""
    ways = resources.select(F.explode(F.array("char", "pal", "map")).alias("at")).where("at IS NOT NULL").distinct()
    got = contents(files, ways.select("at", path_of(F.col("at")).alias("path"), steps_of(F.col("at")).alias("loc"))).select("at", "payload")
    for part in ("char", "pal", "map"):
        resources = resources.join(got.select(F.col("at").alias(part), F.col("payload").alias(f"{part}_bytes")), part, "left")
    return resources


PICTURE = "struct<png:binary,hash:string,image:string,width:int,height:int,error:string>"


def drawn(kind: str, char: bytes, pal: bytes | None, map_: bytes | None) -> tuple:
    p = layout.resource_picture(kind, char, pal, map_)
    pixels = p.pixels()
    clear = bytes(0 if i % 16 == 0 and p.bpp == 4 or i == 0 else 255 for i in range(256))
    data = png.encode(pixels, p.w, p.h, p.palette, 1)
    return data, png.pixel_hash(pixels, p.w, p.h), png.table_digest(p.palette, clear[:1]), p.w, p.h, None


def pictures(files: DataFrame, resources: DataFrame) -> DataFrame:
    """resources of kinds that are drawn, with png, hash, image (the palette's digest), width, height, or the error."""

    def one(kind, char, pal, map_):
        if kind not in RENDERED:
            return None, None, None, None, None, "only seen, not drawn"
        try:
            if char is None:
                raise Refused("no tiles")
            return drawn(kind, bytes(char), None if pal is None else bytes(pal), None if map_ is None else bytes(map_))
        except (ValueError, IndexError) as e:
            return None, None, None, None, None, f"{type(e).__name__}: {e}"

    run = F.udf(one, PICTURE, useArrow=True)
    return with_parts(files, resources).withColumn("p", run("kind", "char_bytes", "pal_bytes", "map_bytes")).select(*resources.columns, "p.*")


def identity(files: DataFrame) -> DataFrame:
    """One row: number of files, bytes, and a digest of all paths, sizes and contents, by partial digests of 256 groups."""
    each = files.select(F.concat_ws("\0", "path", F.length("content").cast("string"), F.sha2("content", 256)).alias("line"), F.length("content").cast("long").alias("size"), F.pmod(F.xxhash64("path"), F.lit(256)).alias("g"))
    some = each.groupBy("g").agg(F.sha2(F.array_join(F.sort_array(F.collect_list(F.sha2("line", 256))), ""), 256).alias("part"), F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))
    return some.agg(F.coalesce(F.sum("files"), F.lit(0)).alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.sha2(F.array_join(F.sort_array(F.collect_list(F.concat(F.lpad(F.col("g").cast("string"), 3, "0"), "part"))), ""), 256).alias("sha256"))


def dump(files: DataFrame, resources: DataFrame, folder: str) -> dict:
    """Writes the pictures, the manifest and the source's identity; a resource that can't be drawn is a row with its error."""
    if exists(folder):
        raise EditError(f"{folder} is there already")
    none = F.lit(None).cast("int")
    made = pictures(files, resources)
    made = made.withColumn("file", F.when(F.col("png").isNotNull(), N.png_name(F.col("kind"), F.col("name"), none, F.col("id"))))
    rows = made.drop("png").withColumns({"editable": F.col("error").isNull(), "schema_version": F.lit(3)})
    n = publish_files(made.where("file IS NOT NULL").select(F.col("file").alias("path"), F.col("png").alias("content")), folder)
    rows.write.parquet(f"{folder}/manifest")
    identity(files).write.parquet(f"{folder}/source")
    return {"dumped": n, "errors": rows.where("error IS NOT NULL").count()}


def read_dump(spark, folder: str) -> tuple[DataFrame, DataFrame]:
    """The manifest, and the pictures (file, png) that lie in the folder."""
    manifest = spark.read.parquet(f"{folder}/manifest")
    root = folder.rstrip("/") + "/"
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.png").load(folder)
    place = F.locate(root.split(":", 1)[-1].lstrip("/"), F.col("path"))
    return manifest, found.select(F.expr("substring(path, 1)").alias("path"), F.col("content").alias("png"), place.alias("p")).select(F.col("path").substr(F.col("p") + len(root.split(":", 1)[-1].lstrip("/")), F.lit(1 << 20)).alias("file"), "png")


EDIT = "struct<changed:boolean,payload:binary,error:string>"


def insert(files: DataFrame, folder: str, drawn_again: DataFrame | None = None) -> DataFrame:
    """files with the edited pictures of a dump put in; EditError, and nothing done, if any picture can't be taken.

    Every picture of the manifest must be there and be readable, of the same size, palette and clear entries; the resource must
    still be drawn from the files as the manifest has it; an edit must not ask for two values of one stored pixel; and drawn
    again after the edit, it must show what was asked for.
    """
    spark = files.sparkSession
    manifest, found = read_dump(spark, folder)
    if identity(files).first() != spark.read.parquet(f"{folder}/source").first():
        raise EditError("the files are not those of the dump")
    wanted = manifest.where("file IS NOT NULL").join(found, "file", "left")
    checked = with_parts(files, wanted).withColumn("e", F.udf(one_edit, EDIT, useArrow=True)("kind", "char_bytes", "pal_bytes", "map_bytes", "hash", "image", "width", "height", "png"))
    bad = checked.where("e.error IS NOT NULL").select("file", "e.error").orderBy("file").first()
    if bad:
        raise EditError(f"{bad['file']}: {bad['error']}")
    changes = checked.where("e.changed").select("id", "char", F.col("e.payload").alias("payload"), "png")
    twice = changes.groupBy("char").agg(F.count_distinct(F.sha2("payload", 256)).alias("n")).where("n > 1").first()
    if twice:
        raise EditError(f"{twice['char']}: two pictures change the same tiles")
    one = changes.groupBy("char").agg(F.first("payload").alias("payload"))
    done = edited(files, one.select(path_of(F.col("char")).alias("path"), steps_of(F.col("char")).alias("loc"), "payload"))
    bad = done.where("error IS NOT NULL").first()
    if bad:
        raise EditError(f"{bad['path']}: {bad['error']}")
    done = done.drop("error")
    again = pictures(done, manifest.where("file IS NOT NULL").join(changes.select("id", F.col("png").alias("asked")), "id").select("id", "kind", "name", "char", "pal", "map", "layout", "owner", "asked"))
    lost = again.where(~F.coalesce(F.udf(same_pixels, "boolean", useArrow=True)("png", "asked"), F.lit(False))).first()
    if lost:
        raise EditError(f"{lost['name']}: the pixels asked for can't be kept")
    return done


def same_pixels(a, b) -> bool:
    return bool(a and b) and bool((png.decode(bytes(a))[0] == png.decode(bytes(b))[0]).all())


def one_edit(kind, char, pal, map_, want_hash, image, w, h, data):
    """Whether a picture differs from what was dumped, its tiles' file with the new pixels, or why it can't be taken."""
    try:
        if data is None:
            return False, None, "no picture"
        pixels, pw, ph, palette, alphas = png.decode(bytes(data))
        if (pw, ph) != (w, h) or png.table_digest(palette, alphas) != image:
            return False, None, "other size, palette or clear entries"
        if png.pixel_hash(pixels, pw, ph) == want_hash:
            return False, None, None
        p = layout.resource_picture(kind, bytes(char), None if pal is None else bytes(pal), None if map_ is None else bytes(map_))
        if png.pixel_hash(p.pixels(), p.w, p.h) != want_hash:
            return False, None, "the files no longer show what was dumped"
        new, lost = p.write(pixels.astype(np.int64))
        if lost:
            return False, None, f"{lost} pixels of shared tiles disagree"
        return True, new, None
    except (ValueError, IndexError) as e:
        return False, None, f"{type(e).__name__}: {e}"


# --- images --------------------------------------------------------------------------------


def rom_info(title: str | None = None, code: str | None = None, banner: str | None = None) -> dict:
    """The header texts to change; EditError for texts that don't fit."""
    out = {}
    if title is not None:
        if len(title) > 12 or not title.isascii() or not title.isprintable():
            raise EditError("a title has at most 12 printable ASCII characters")
        out["title"] = title
    if code is not None:
        if len(code) != 4 or not code.isascii() or not code.isalnum():
            raise EditError("a code has four ASCII letters or digits")
        out["code"] = code.upper()
    if banner is not None:
        if len(banner) > 127 or banner.count("\n") > 2:
            raise EditError("a banner's title has at most three lines and 127 characters")
        out["banner"] = banner
    return out


def verified(old: bytes, new: bytes, changes: dict[str, bytes], allowed: list[tuple[int, int]] = ()) -> bytes:
    """`new` if it is `old` with just the changed files: same size and names, every file as it should be, nothing else moved but `allowed`."""
    a, b = C.Cartridge(old), C.Cartridge(new)
    if len(old) != len(new):
        raise EditError("the image's size changed")
    if a.names != b.names or len(a.fat) != len(b.fat):
        raise EditError("the image's files changed")
    for i in range(len(a.fat)):
        lo, hi = b.fat[i]
        if not 0 <= lo <= hi <= len(new) or b.read(i) != changes.get(a.names.get(i), a.read(i)):
            raise EditError(f"file {i} is not what it should be")
    fat = a.regions["fat_off"]
    end = fat + 8 * len(a.fat)
    start = min([int(lo) for lo, hi in a.fat if lo >= end and hi > lo], default=len(old))
    expected = bytearray(old[:start])
    for lo, hi in [(fat, end), (C.USED_AT, C.USED_AT + 4), (C.CRC_AT, C.CRC_AT + 2), *allowed]:
        expected[lo:hi] = new[lo:hi]
    if bytes(expected) != new[:start]:
        raise EditError("something besides files, sizes and checksums changed")
    if int.from_bytes(new[C.CRC_AT : C.CRC_AT + 2], "little") != C.crc16(new[: C.CRC_AT]):
        raise EditError("the header's checksum is wrong")
    return new


def insert_image(image: bytes, changes: dict[str, bytes], destination: str, **info) -> str:
    """Publishes the image with changed files and header texts as a new file; returns its sha256."""
    texts = rom_info(**info)
    if not changes and not texts:
        raise EditError("nothing to insert")
    c = C.Cartridge(image)
    banner = None
    allowed = [(at, at + n) for what, (at, n) in C.TEXTS.items() if what in texts]
    if "banner" in texts:
        from glyphmill.formats.graphics import Banner

        banner = Banner(c.banner()).write(title=texts.pop("banner"))
        at = int(C.words(image, C.BANNER_AT, 1)[0])
        allowed.append((at, at + len(banner)))
    new = verified(image, c.rebuild(dict(changes), banner, texts=texts), changes, allowed)
    publish_new(destination, new)
    return hashlib.sha256(new).hexdigest()


__all__ = ["EditError", "Refused", "dump", "identity", "insert", "insert_image", "pictures", "publish_files", "scan", "stats"]
