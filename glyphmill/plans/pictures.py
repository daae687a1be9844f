"""Queries that draw pictures from parts' rows in each format, read them, turn them over, write and read them again."""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import functions as F

from glyphmill.codecs import studio
from glyphmill.containers.build import nitro
from glyphmill.formats import pictures as P

from .round_trips import BLOB, blobs, named

SIDE = 32
WORDS = struct.pack("<256H", *range(256))


def tiled(pixels: np.ndarray) -> np.ndarray:
    """Pixels as 8x8 tiles behind one another."""
    return pixels.reshape(SIDE // 8, 8, SIDE // 8, 8).swapaxes(1, 2).ravel()


def drawn(kind: str, p: np.ndarray, bpp: int) -> bytes:
    """A file of the kind that shows the pixels, row by row."""
    flat, n = P.repacked(p, bpp), SIDE * SIDE
    if kind == "bpg1":
        order = np.argsort(P.in_blocks(SIDE, SIDE, 24, 8))
        return b"BPG1" + struct.pack("<HBBHHHH", 256, bpp, 0, SIDE, SIDE, 24, 8) + WORDS + P.repacked(p[order], bpp)
    if kind == "ebp":
        return struct.pack("<3I", SIDE, SIDE, 0x08 if bpp == 8 else 0x04) + bytes(range(256)) * (4 if bpp == 8 else 0) + (b"" if bpp == 8 else bytes(64)) + flat
    if kind == "bmp":
        raw = P.repacked(p.reshape(SIDE, SIDE)[::-1].ravel(), bpp, bpp == 4)
        at = 54 + 4 * (1 << bpp)
        return b"BM" + struct.pack("<IIIIiiHHIIiiII", at + len(raw), 0, at, 40, SIDE, SIDE, 1, bpp, 0, 0, 0, 0, 0, 0) + bytes(4 << bpp) + raw
    if kind == "cbp1":
        head = b"CBP1" + struct.pack("<HBBHHHH", 256, 8, 0, SIDE, SIDE, 16, 16) + bytes(4) + WORDS
        at = -(-(len(head) + 8) // 64) * 64
        blocks = p.reshape(2, 2, 8, 2, 2, 8).transpose(0, 3, 1, 4, 2, 5).reshape(4, 256).astype(np.uint8)
        return (head + struct.pack("<4H", *(at + 256 * k for k in range(4)))).ljust(at, b"\0") + blocks.tobytes()
    if kind == "obp1":
        order = np.argsort(P.in_blocks(SIDE, SIDE, 16, 8))
        return b"OBP1" + struct.pack("<6H", 1, 0, SIDE, SIDE, bpp == 8, 512) + WORDS + P.repacked(p[order], bpp)
    if kind in ("bgp1", "level5_bg"):
        # every second tile is stored mirrored, and shown so
        tiles = tiled(p).reshape(16, 8, 8).copy()
        tiles[1::2] = tiles[1::2, ::-1, ::-1]
        entries = struct.pack("<16H", *(t | (0xC00 if t % 2 else 0) for t in range(16)))
        raw = P.repacked(tiles.ravel(), bpp)
        if kind == "level5_bg":
            return studio.envelope_encode(struct.pack("<I", 256) + WORDS + struct.pack("<I", 16) + raw + struct.pack("<HH", 4, 4) + entries, 2)
        at = 0x28 + 512
        return b"BGP1" + struct.pack("<IHHBBH6I", 0, SIDE, SIDE, 8, bpp, 0, 0x28, 512, at, len(raw), at + len(raw), 32) + WORDS + raw + entries
    if kind == "sir":
        at = 16 + 36
        return b"SIR0" + struct.pack("<3I", 16, 0, 0) + struct.pack("<9I", 0, 0, 3, 3, 0, 0, at, at + len(flat), at + len(flat) + 512) + flat + WORDS
    if kind == "sir_icon":
        raw = P.repacked(tiled(p), bpp)
        pal = WORDS if bpp == 8 else WORDS[:32]
        return b"SIR0" + struct.pack("<3I", 16 + len(raw) + len(pal), 0, 0) + raw + pal + struct.pack("<2I", 16, 16 + len(raw))
    if kind == "sir_sprite":
        body, pieces = b"SIR0" + bytes(12) + WORDS + flat, struct.pack("<10H", SIDE, 16, 0, 0, 0, SIDE, 16, 0, 16, SIDE * 16) + bytes(10)
        rest = 16 + 512 + n
        q = rest + len(pieces) + 20
        table = q + 12
        groups = [q, 4, 4]
        coded = b"".join(bytes([g >> 14 | 128] * (g >> 14 > 0) + [g >> 7 & 127 | 128] * (g >> 7 > 0) + [g & 127]) for g in groups) + b"\0"
        out = body + pieces + struct.pack("<I", n) + bytes(16) + struct.pack("<3I", 16, 16 + 512, rest) + coded
        return out[:4] + struct.pack("<3I", 0, table, 0) + out[16:]
    if kind == "level5_ani":
        parts = b"".join(struct.pack("<4H", 0, 16 * k, 2, 1) + P.repacked(p.reshape(2, -1)[k], bpp) for k in range(2))
        return studio.envelope_encode(struct.pack("<HH4H", 1, 3 if bpp == 4 else 4, SIDE, SIDE, 2, 0) + parts + struct.pack("<I", 256) + WORDS, 4)
    if kind == "tex":
        code = {2: 2, 4: 3, 8: 4}[bpp]

        def entries(unit: int, raw: bytes, name: bytes) -> bytes:
            return bytes([0, 1]) + struct.pack("<HHH", 0, 0, 8) + struct.pack("<HH", unit, 0) + raw + name.ljust(16, b"\0")

        names = entries(8, struct.pack("<HHI", 0, 2 << 4 | 2 << 7 | code << 10, 0), b"one")
        pals = entries(4, struct.pack("<HH", 0, 0), b"one_pl")
        head, at = bytearray(60), 60 + len(names) + len(pals)
        struct.pack_into("<H", head, 0x0E, 60)
        struct.pack_into("<I", head, 0x14, at)
        struct.pack_into("<I", head, 0x30, 512 // 8)
        struct.pack_into("<I", head, 0x34, 60 + len(names))
        struct.pack_into("<I", head, 0x38, at + len(flat))
        block = bytes(head) + names + pals + flat + WORDS
        block = b"TEX0" + struct.pack("<I", len(block)) + block[8:]
        return b"BTX0\xff\xfe\x00\x01" + struct.pack("<IHHI", 20 + len(block), 16, 1, 20) + block
    assert kind == "font"
    glyphs = p.reshape(4, -1)  # of 32 x 8, and a byte of padding each
    raw = b"".join(P.repacked(g, bpp, True) + b"\x5a" for g in glyphs)
    size = len(raw) // 4
    return nitro(
        b"RTFN",
        (b"FNIF", bytes([0, 11]) + bytes(18)),
        (b"PLGC", struct.pack("<BBHBBBBH", SIDE, 8, size, SIDE, 8, bpp, 0, 0) + raw),
        (b"HDWC", struct.pack("<HHI", 0, 3, 0) + bytes(range(12))),
        (b"PAMC", struct.pack("<HHII", 65, 68, 0, 0)),
    )


def opened(kind: str, data: bytes) -> P.Picture:
    if kind == "level5_ani":
        return P.level5_animation(data)[0]
    if kind == "tex":
        return P.textures(data)[0]
    return {**P.READERS, "ebp": P.ebp, "level5_bg": P.level5_background}[kind](data)


#: Kinds and their depths. A picture's pixels are the parts' sizes, again and again.
DEPTHS = {
    "bpg1": (4, 8), "ebp": (4, 8), "bmp": (4, 8), "cbp1": (8,), "obp1": (4, 8), "bgp1": (4, 8), "sir": (4, 8), "sir_icon": (4, 8),
    "sir_sprite": (8,), "level5_bg": (8,), "level5_ani": (4, 8), "tex": (2, 4, 8), "font": (1, 2, 4, 8),
}


def picture_sql(mask: int) -> str:
    return f"""WITH p AS (SELECT {BLOB} AS blob, string_agg(chr(CAST(p_size & {mask} AS INTEGER)), '' ORDER BY p_partkey) AS s FROM part GROUP BY 1),
q AS (SELECT blob, substr(repeat(s, {SIDE * SIDE} // length(s) + 1), 1, {SIDE * SIDE}) AS s FROM p)
SELECT blob, {SIDE * SIDE} AS pixels, sha256(s) AS sha256, sha256(reverse(s)) AS turned, 0 AS lost FROM q"""


def picture_query(kind: str, bpp: int):
    mask = (1 << min(bpp, 6)) - 1

    @named(f"picture_{kind}_{bpp}", picture_sql(mask))
    def run(spark, d):
        def there_and_back(parts):
            sizes = np.array([p["p_size"] & mask for p in parts], np.uint8)
            seen = opened(kind, drawn(kind, np.resize(sizes, SIDE * SIDE), bpp))
            new, lost = seen.write(seen.pixels()[::-1])
            again = opened(kind, new)
            return seen.w * seen.h, *(bytes(x.pixels().astype(np.uint8)) for x in (seen, again)), lost

        back = F.udf(there_and_back, "struct<pixels:int,one:binary,two:binary,lost:int>", useArrow=True)
        df = blobs(spark, d).select("blob", back("parts").alias("b"))
        return df.select("blob", "b.pixels", F.sha2("b.one", 256).alias("sha256"), F.sha2("b.two", 256).alias("turned"), "b.lost")


for _kind, _depths in DEPTHS.items():
    for _bpp in _depths:
        picture_query(_kind, _bpp)
