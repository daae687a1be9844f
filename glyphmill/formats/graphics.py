"""Palettes, tile sets, screens, cells and banners: bytes to values, and changed values back into the same bytes.

Declared sizes are not trusted: each is cut to its block and to the file. Bytes without the block raise Refused.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphmill.containers.archives import Refused, need, patched, words
from glyphmill.formats import nitro
from glyphmill.sources.cartridge import BANNER_SIZES, crc16

#: Fixed values: (width, height) of a cell's piece by shape, then size.
PIECES = (((8, 8), (16, 16), (32, 32), (64, 64)), ((16, 8), (32, 8), (32, 16), (64, 32)), ((8, 16), (8, 32), (16, 32), (32, 64)), ((8, 8), (16, 16), (32, 32), (64, 64)))


def block(data: bytes, magic: bytes) -> tuple[int, int]:
    """Where the block begins and where it ends at the latest; its magic may be stored either way round."""
    for found, at, size in nitro.blocks(data):
        if found in (magic, magic[::-1]):
            return at, min(at + size, len(data))
    raise Refused(f"no {magic.decode()} block")


def part(data: bytes, at: int, end: int, declared: int, offset: int, usual: int) -> tuple[int, int]:
    """Start and length of a block's payload: a bad offset means the usual place, a bad size all that is there."""
    start = at + 8 + offset if 0 < offset < end - at else at + usual
    room = max(0, end - start)
    return start, declared if 0 < declared <= room else room


def colours(raw: bytes) -> np.ndarray:
    """(n, 3) eight-bit channels of fifteen-bit colours; high bits repeat."""
    v = np.frombuffer(raw, "<u2", len(raw) // 2).astype(np.int64)
    five = np.stack([v >> s & 31 for s in (0, 5, 10)], axis=1)
    return five << 3 | five >> 2


def fifteen(rgb: np.ndarray, before: bytes = b"") -> bytes:
    """The words of the colours; where a word of `before` has the same colour it stays, top bit and all."""
    five = np.asarray(rgb, np.int64).reshape(-1, 3) >> 3
    new = (five << np.array([0, 5, 10])).sum(axis=1)
    old = np.frombuffer(before, "<u2", min(len(before) // 2, len(new))).astype(np.int64)
    same = (colours(old.astype("<u2").tobytes()) == np.asarray(rgb).reshape(-1, 3)[: len(old)]).all(axis=1)
    new[: len(old)] = np.where(same, old, new[: len(old)])
    return new.astype("<u2").tobytes()


def indices(raw: bytes, bpp: int) -> np.ndarray:
    """Pixels of four (low half first) or eight bits."""
    b = np.frombuffer(raw, np.uint8)
    return b.copy() if bpp == 8 else np.stack([b & 15, b >> 4], axis=1).ravel()


def packed(pixels: np.ndarray, bpp: int) -> bytes:
    p = np.asarray(pixels, np.uint8)
    return p.tobytes() if bpp == 8 else (p[0::2] & 15 | (p[1::2] & 15) << 4).astype(np.uint8).tobytes()


@dataclass
class Palette:
    data: bytes
    bpp: int
    at: int
    size: int
    rgb: np.ndarray
    slots: list[int] | None

    @classmethod
    def read(cls, data: bytes) -> Palette:
        at, end = block(data, b"TTLP")
        start, n = part(data, at, end, *(int(x) for x in words(data, at + 16, 2)), 24)
        n -= n % 2
        slots = None
        try:
            own, _ = block(data, b"PMCP")
        except Refused:
            own = None
        if own is not None:
            slots = words(data, own + 8 + int(words(data, own + 12, 1)[0]), int(words(data, own + 8, 1, "<u2")[0]), "<u2").tolist()
        return cls(data, 8 if words(data, at + 8, 1)[0] == 4 else 4, start, n, colours(data[start : start + n]), slots)

    def full(self) -> np.ndarray:
        """At least 256 colours, each sub-palette in the slot that it says it belongs to, black between."""
        rgb = self.rgb
        if self.slots:
            per = 16 if self.bpp == 4 else 256
            rgb = np.zeros(((max(self.slots) + 1) * per, 3), np.int64)
            for i, slot in enumerate(self.slots):
                one = self.rgb[i * per : (i + 1) * per]
                rgb[slot * per : (slot + 1) * per] = 0
                rgb[slot * per : slot * per + len(one)] = one
        return np.concatenate([rgb, np.zeros((max(0, 256 - len(rgb)), 3), np.int64)])

    def write(self, rgb: np.ndarray) -> bytes:
        return patched(self.data, {self.at: fifteen(np.asarray(rgb)[: self.size // 2], self.data[self.at : self.at + self.size])})


@dataclass
class Tiles:
    data: bytes
    bpp: int
    at: int
    size: int
    pixels: np.ndarray
    width: int
    height: int
    linear: bool

    @classmethod
    def read(cls, data: bytes) -> Tiles:
        at, end = block(data, b"RAHC")
        high, wide = (int(x) for x in words(data, at + 8, 2, "<u2"))
        depth, _, flags, size, offset = (int(x) for x in words(data, at + 12, 5))
        bpp = 8 if depth == 4 else 4
        start, n = part(data, at, end, size, offset, 32)
        pixels = indices(data[start : start + n], bpp)
        if {wide, high} & {0, 0xFFFF}:  # no grid declared: rows of at most 32 tiles
            wide = min(32, len(pixels) // 64) or 1
            high = -(-(len(pixels) // 64) // wide)
        return cls(data, bpp, start, n, pixels, wide, high, bool(flags & 1))

    def write(self, pixels: np.ndarray) -> bytes:
        raw = packed(pixels, self.bpp)
        if len(raw) != self.size:
            raise ValueError(f"{len(raw)} bytes of pixels for {self.size}")
        return patched(self.data, {self.at: raw})


@dataclass
class Screen:
    cols: int
    rows: int
    entries: np.ndarray

    @classmethod
    def read(cls, data: bytes) -> Screen:
        at, end = block(data, b"NRCS")
        wide, high = (int(x) for x in words(data, at + 8, 2, "<u2"))
        start, n = part(data, at, end, int(words(data, at + 16, 1)[0]), 0, 20)
        entries = words(data, start, n // 2, "<u2")
        cols, rows = max(1, wide // 8), high // 8
        return cls(cols, rows if cols * rows <= len(entries) else -(-len(entries) // cols), entries)


def cells(data: bytes) -> tuple[int, list[int] | None, list[dict]]:
    """The shift of tile numbers, each cell's place in the tile data (None: no table), and the pieces of all cells."""
    at, end = block(data, b"KBEC")
    n, wide = (int(x) for x in words(data, at + 8, 2, "<u2"))
    offset, mapping = (int(x) for x in words(data, at + 12, 2))
    table = at + 8 + offset
    step = 16 if wide == 1 else 8
    out = []
    for c in range(n):
        count, _ = (int(x) for x in words(data, table + c * step, 2, "<u2"))
        first = table + n * step + int(words(data, table + c * step + 4, 1)[0])
        fit = min(count, max(0, len(data) - first) // 6)
        for i, (y, x, t) in enumerate(words(data, first, 3 * fit, "<u2").reshape(-1, 3).tolist()):
            turned = y >> 8 & 1
            w, h = PIECES[y >> 14][x >> 14]
            out.append(
                {"cell": c, "ordinal": i, "x": ((x & 511) ^ 256) - 256, "y": ((y & 255) ^ 128) - 128, "w": w, "h": h, "tile": t & 1023, "pal": t >> 12, "rotscale": turned}
                | {"hflip": 0 if turned else x >> 12 & 1, "vflip": 0 if turned else x >> 13 & 1}
            )
    return mapping, places(data, at, end, n), out


def places(data: bytes, at: int, end: int, n: int) -> list[int] | None:
    offset = int(words(data, at + 20, 1)[0]) if end - at >= 24 else 0
    if not offset:
        return None
    try:
        first = at + 8 + offset + int(words(data, at + 8 + offset + 4, 1)[0])
    except Refused:
        return None
    fit = min(n, max(0, len(data) - first) // 8)
    return words(data, first, 2 * fit)[::2].tolist() + [0] * (n - fit)


#: Place of each checksum in a banner and the span it covers; how many each version has, and its titles.
BANNER_CRCS = ((2, 0x20, 0x840), (4, 0x20, 0x940), (6, 0x20, 0xA40), (8, 0x1240, 0x23C0))
BANNER_HAS = {1: (1, 6), 2: (2, 7), 3: (3, 8), 0x103: (4, 8)}


@dataclass
class Banner:
    data: bytes

    def __post_init__(self):
        self.version = int(words(self.data, 0, 1, "<u2")[0])
        need(self.version in BANNER_HAS and len(self.data) >= BANNER_SIZES[1])

    def icon(self) -> np.ndarray:
        """32 x 32 indices from four rows of four tiles."""
        return indices(self.data[0x20:0x220], 4).reshape(4, 4, 8, 8).swapaxes(1, 2).reshape(32, 32)

    def titles(self) -> list[str]:
        return [self.data[at : at + 256].decode("utf-16-le", "ignore").split("\0")[0] for at in range(0x240, 0x840, 256)]

    def write(self, icon: np.ndarray | None = None, title: str | None = None) -> bytes:
        edits = {}
        if icon is not None:
            edits[0x20] = packed(np.asarray(icon).reshape(4, 8, 4, 8).swapaxes(1, 2).ravel(), 4)
        if title is not None:
            if len(title) > 127:
                raise ValueError("a title has at most 127 characters")
            edits[0x240] = title.encode("utf-16-le").ljust(256, b"\0") * BANNER_HAS[self.version][1]
        out = patched(self.data, edits)
        sums = BANNER_CRCS[: BANNER_HAS[self.version][0]]
        return patched(out, {at: crc16(out[lo:hi]).to_bytes(2, "little") for at, lo, hi in sums if hi <= len(out)})


# --- Spark -----------------------------------------------------------------------------------------------------------


def parsed(content: Column, schema: str, read: Callable[[bytes], tuple]) -> Column:
    """struct<value, error> by an Arrow UDF: what `read` gives, or null and why not. Nulls stay null."""

    def one(data):
        if data is None:
            return None
        try:
            return read(bytes(data)), None
        except ValueError as e:
            return None, str(e) or type(e).__name__

    return F.udf(one, f"struct<value:{schema},error:string>", useArrow=True)(content)


def palette(content: Column) -> Column:
    return parsed(content, "struct<bpp:int,colours:array<array<int>>>", lambda d: (lambda p: (p.bpp, p.rgb.tolist()))(Palette.read(d)))


def tiles(content: Column) -> Column:
    return parsed(content, "struct<bpp:int,width:int,height:int,linear:boolean,pixels:binary>", lambda d: (lambda t: (t.bpp, t.width, t.height, t.linear, t.pixels.tobytes()))(Tiles.read(d)))


def screen(content: Column) -> Column:
    return parsed(content, "struct<cols:int,rows:int,entries:array<int>>", lambda d: (lambda s: (s.cols, s.rows, s.entries.tolist()))(Screen.read(d)))


def pieces(content: Column) -> Column:
    fields = ("cell", "ordinal", "x", "y", "w", "h", "tile", "pal", "rotscale", "hflip", "vflip")
    each = "array<struct<" + ",".join(f"{f}:int" for f in fields) + ">>"
    return parsed(content, f"struct<mapping:int,places:array<bigint>,pieces:{each}>", lambda d: (lambda m, v, p: (m, v, [tuple(x[f] for f in fields) for x in p]))(*cells(d)))
