"""Contents without a header: predicates and measures on bytes as columns, JVM only where a look at a few bytes is enough."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .names import file_name


def byte(content: Column, at: int) -> Column:
    return F.conv(F.hex(F.substring(content, at + 1, 1)), 16, 10).cast("int")


def short(content: Column, at: int) -> Column:
    return byte(content, at) + 256 * byte(content, at + 1)


def word(content: Column, at: int) -> Column:
    return short(content, at).cast("long") + 65536 * short(content, at + 2)


def magic(content: Column) -> Column:
    """The first four bytes as text if they are printable, else in hex; `tiny` where there are fewer."""
    raw = F.substring(content, 1, 4)
    printable = F.hex(raw).rlike("^([2-6][0-9A-F]|7[0-9A-E]){4}$")
    return F.when(F.length(content) < 4, "tiny").when(printable, F.decode(raw, "ISO-8859-1")).otherwise(F.concat(F.lit("x"), F.lower(F.hex(raw))))


def shorts(content: Column) -> Column:
    """All whole little-endian 16-bit words."""

    @F.pandas_udf("array<int>")
    def run(data: pd.Series) -> pd.Series:
        return data.map(lambda d: None if d is None else np.frombuffer(bytes(d), "<u2", len(d) // 2).tolist())

    return run(content)


def is_palette(content: Column) -> Column:
    """Whole rows of 16 colours, at most 16 of them, none with the top bit."""
    n = F.length(content)
    sized = n.between(32, 512) & (n % 32 == 0)
    return F.coalesce(sized & ~F.hex(F.when(sized, content)).rlike("^(....)*..[89A-F]"), F.lit(False))


def is_screen(content: Column) -> Column:
    """A map without its tiles: many different ones, and palette rows or mirrored tiles, which other tables lack."""
    n = F.length(content)
    w = shorts(F.when((n >= 128) & (n % 2 == 0), content))
    tiles = F.transform(w, lambda e: e.bitwiseAND(1023))
    many = F.size(F.array_distinct(F.filter(tiles, lambda t: t > 0))) >= 8
    rows = F.size(F.array_distinct(F.transform(w, lambda e: F.shiftright(e, 12)))) >= 2
    return F.coalesce(w.isNotNull() & (F.array_max(tiles) < 2048) & many & (rows | F.exists(w, lambda e: e.bitwiseAND(0xC00) > 0)), F.lit(False))


def lite(content: Column) -> Column:
    """struct<kind, head, bpp> of a stripped export whose sizes agree exactly; null for any other content."""
    n, size, m = short(content, 4), F.length(content), F.substring(content, 1, 4)
    is_ = lambda t: m == F.lit(t + b"\0")
    wide = byte(content, 6)
    bpp = F.when(wide == 1, 8).when(wide == 0, 4)
    found = lambda kind, head, bits: F.struct(F.lit(kind).alias("kind"), F.lit(head).alias("head"), bits.cast("int").alias("bpp"))
    none = F.lit(None)
    return F.when((size >= 12) & (n > 0), F.when(is_(b"NCG") & (size == 8 + n * bpp * 8), found("char", 8, bpp)).when(is_(b"NCL") & (size == 8 + 2 * n), found("pal", 8, none)).when(is_(b"NSC") & (byte(content, 8) * byte(content, 9) == n) & (size == 12 + 2 * n), found("screen", 12, none)))


def bitmap_header(content: Column) -> Column:
    """struct<bpp, width, height> of a ten-byte header beside its pixels; null for any other content."""
    bpp, w, h = byte(content, 5), short(content, 6), short(content, 8)
    return F.when((F.length(content) >= 10) & (F.substring(content, 1, 4) == F.lit(b"SBMP")) & bpp.isin(4, 8) & (w > 0) & (h > 0), F.struct(bpp.alias("bpp"), w.alias("width"), h.alias("height")))


def screen_size(content: Column) -> Column:
    """struct<cols, rows, head, declared> of a map's entries: by a header that describes the rest exactly, or else 32, 64 or 16 wide."""
    size = F.length(content)
    cols, rows, head = (word(content, 4 * k) for k in range(3))
    told = (size >= 16) & head.between(8, 64) & (head % 4 == 0) & cols.between(1, 256) & rows.between(1, 256) & (head + 2 * cols * rows == size)
    n = F.floor(size / 2)
    wide = F.when(n % 32 == 0, 32).when(n % 64 == 0, 64).when(n % 16 == 0, 16).otherwise(32)
    made = lambda c, r, h, d: F.struct(c.cast("int").alias("cols"), r.cast("int").alias("rows"), h.cast("int").alias("head"), F.lit(d).alias("declared"))
    small = lite(content)
    return F.when(small["kind"] == "screen", made(byte(content, 8), byte(content, 9), F.lit(12), True)).when(told, made(cols, rows, head, True)).otherwise(made(wide, F.ceil(n / wide), F.lit(0), False))


def texture_size(n: Column) -> Column:
    """struct<width, height>: a square of a power of two, or the widest such width that divides n texels."""
    side = F.floor(F.sqrt(n.cast("double"))).cast("long")
    square = (side * side == n) & (side.bitwiseAND(side - 1) == 0)
    wide = F.lit(None).cast("long")
    for w in (8, 16, 32, 64, 128, 256):
        wide = F.when((n % w == 0) & (n / w <= 1024), w).otherwise(wide)
    width = F.when(square, side).otherwise(F.coalesce(wide, F.lit(64)))
    return F.struct(width.cast("long").alias("width"), F.when(square, side).otherwise(F.ceil(n / width)).cast("long").alias("height"))


def crc16_of(content: Column) -> Column:
    """CRC-16, reflected polynomial 0xA001, from 0xFFFF."""
    from glyphmill.sources.cartridge import crc16

    return F.udf(lambda d: None if d is None else crc16(bytes(d)), "int", useArrow=True)(content)


def pixel_hash(pixels: Column, shape: Column) -> Column:
    """md5 of the pixels and their shape as text."""
    return F.md5(F.concat(pixels, shape.cast("binary")))


def ramp_digest(colours: Column) -> Column:
    """sha256 of all 256 palette entries as four bytes each (r, g, b, alpha), black and opaque beyond the given ones."""

    @F.udf("string", useArrow=True)
    def run(rows):
        import hashlib

        raw = b"".join(bytes(list(c)[:4] if len(c) > 3 else [*c, 255]) for c in rows)
        return hashlib.sha256(raw + b"\0\0\0\xff" * (256 - len(rows))).hexdigest()

    return run(colours)


def pack_shorts(values: list[int]) -> bytes:
    return struct.pack(f"<{len(values)}H", *values)


__all__ = ["bitmap_header", "byte", "crc16_of", "file_name", "is_palette", "is_screen", "lite", "magic", "pack_shorts", "pixel_hash", "ramp_digest", "screen_size", "short", "shorts", "texture_size", "word"]
