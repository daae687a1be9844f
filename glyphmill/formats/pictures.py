"""Pictures of many formats under one shape: where each pixel is stored, how wide it is, and the palette.

A reader checks a format's sizes and gives a Picture; reading, editing and writing back are the same for all: a pixel
of the picture is a stored value (`places`), blocks, tiles, rows from the bottom and maps with mirrored tiles alike. Only
pixel values are ever written.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column

from glyphmill.codecs import studio
from glyphmill.codecs.bios import CodecError
from glyphmill.containers.archives import Refused, need

from .graphics import colours, parsed
from .nitro import blocks

#: A pixel that nothing is stored for.
NOWHERE = -1


def unpacked(raw: bytes, bpp: int, high_first: bool = False) -> np.ndarray:
    """Values of 1, 2, 4 or 8 bits, the lowest bits first unless said otherwise."""
    data = np.frombuffer(raw, np.uint8)
    if bpp == 8:
        return data.copy()
    shifts = np.arange(0, 8, bpp, dtype=np.uint8)
    return (data[:, None] >> (shifts[::-1] if high_first else shifts) & np.uint8((1 << bpp) - 1)).ravel()


def repacked(values: np.ndarray, bpp: int, high_first: bool = False) -> bytes:
    if bpp == 8:
        return values.astype(np.uint8).tobytes()
    shifts = np.arange(0, 8, bpp, dtype=np.uint8)
    rows = values.astype(np.uint8).reshape(-1, 8 // bpp)
    return np.bitwise_or.reduce(rows << (shifts[::-1] if high_first else shifts), axis=1).astype(np.uint8).tobytes()


def bright(raw: bytes) -> np.ndarray:
    """The second rule for fifteen-bit colours: 31 is 255, and others in proportion."""
    w = np.frombuffer(raw, "<u2", len(raw) // 2).astype(np.int64)
    return np.stack([(w >> s & 31) * 255 // 31 for s in (0, 5, 10)], 1)


@dataclass
class Picture:
    data: bytes
    kind: str
    w: int
    h: int
    bpp: int
    at: int
    size: int
    palette: np.ndarray
    places: np.ndarray | None = None
    rows: np.ndarray | None = None
    high_first: bool = False
    wrap: Callable[[bytes], bytes] | None = None
    extra: dict = field(default_factory=dict)

    def stored(self) -> np.ndarray:
        return unpacked(self.data[self.at : self.at + self.size], self.bpp, self.high_first)

    def where(self) -> np.ndarray:
        return np.arange(self.w * self.h) if self.places is None else self.places

    def pixels(self) -> np.ndarray:
        """The picture's values, row by row; 0 where nothing is stored; in maps of four bits the palette row is in the high half."""
        stored, at = self.stored(), self.where()
        out = np.where((at >= 0) & (at < len(stored)), stored[np.clip(at, 0, len(stored) - 1)], 0)
        return out if self.rows is None else np.where(at >= 0, out | self.rows << 4, 0)

    def write(self, pixels: np.ndarray) -> tuple[bytes, int]:
        """The file with new pixels, and how many could not be kept: where the picture shows a stored value twice, the first counts."""
        pixels = np.asarray(pixels, np.int64).ravel()
        if len(pixels) != self.w * self.h:
            raise ValueError("another size")
        stored, at = self.stored(), self.where()
        value = pixels & ((1 << self.bpp) - 1)
        inside = np.flatnonzero((at >= 0) & (at < len(stored)))
        spot, first = np.unique(at[inside], return_index=True)
        stored[spot] = value[inside[first]]
        shown = stored[np.clip(at, 0, len(stored) - 1)]
        lost = int((shown[inside] != value[inside]).sum())
        raw = repacked(stored, self.bpp, self.high_first)
        out = self.data[: self.at] + raw + self.data[self.at + self.size :]
        return (self.wrap(out) if self.wrap else out), lost


def in_blocks(w: int, h: int, bw: int, bh: int) -> np.ndarray:
    """Where each pixel is stored if blocks (clipped at the edges) lie behind one another, each row by row."""
    y, x = np.divmod(np.arange(w * h), w)
    order = np.lexsort((x % bw, y % bh, x // bw, y // bh))
    places = np.empty(w * h, np.int64)
    places[order] = np.arange(w * h)
    return places


def on_map(entries: np.ndarray, cols: int, wide: int = 1023) -> tuple[np.ndarray, np.ndarray]:
    """Where each pixel of a map of 8x8 tiles is stored, and its palette row: ten bits of tile, two of mirroring, four of row."""
    rows = -(-len(entries) // cols)
    full = np.full(rows * cols, NOWHERE, np.int64)
    full[: len(entries)] = entries
    y, x = np.divmod(np.arange(rows * cols * 64), cols * 8)
    e = full[y // 8 * cols + x // 8]
    px = np.where(e & 0x400, 7 - x % 8, x % 8) if wide == 1023 else x % 8
    py = np.where(e & 0x800, 7 - y % 8, y % 8) if wide == 1023 else y % 8
    places = (e & wide) * 64 + py * 8 + px
    return np.where(e < 0, NOWHERE, places), (np.where(e < 0, 0, e) >> 12 & 15 if wide == 1023 else np.zeros_like(e))


def fields(fmt: str, data: bytes, at: int = 0) -> tuple:
    need(len(data) >= at + struct.calcsize(fmt))
    return struct.unpack_from(fmt, data, at)


# --- bitmaps of one studio, and the desktop's ------------------------------------------------


def bpg1(data: bytes) -> Picture:
    need(data[:4] == b"BPG1")
    n, bpp, _, w, h, bw, bh = fields("<HBBHHHH", data, 4)
    need(bpp in (4, 8) and w and h and bw and bh and 0 < n <= 256 and 16 + 2 * n + w * h * bpp // 8 == len(data))
    return Picture(data, "bpg1", w, h, bpp, 16 + 2 * n, w * h * bpp // 8, bright(data[16 : 16 + 2 * n]), in_blocks(w, h, bw, bh))


#: Format word -> bits, palette entries, bytes of an entry.
EBP = {0x35: (8, 32, 2), 0x53: (8, 8, 2), 0x08: (8, 256, 4), 0x04: (4, 16, 4)}


def ebp(data: bytes) -> Picture:
    w, h, kind = fields("<3I", data)
    need(kind in EBP and 0 < w <= 1024 and 0 < h <= 1024)
    bpp, n, size = EBP[kind]
    at = 12 + n * size
    need(at + (w * h * bpp + 7) // 8 == len(data))
    raw = data[12:at]
    return Picture(data, "ebp", w, h, bpp, at, len(data) - at, bright(raw) if size == 2 else np.frombuffer(raw, np.uint8).reshape(-1, 4)[:, :3])


def ebp_rgba(data: bytes) -> np.ndarray:
    """Pictures of direct colours (0x18) or of the hardware's 4x4 blocks (0x4444): h x w x 4."""
    w, h, kind = fields("<3I", data)
    need(0 < w <= 1024 and 0 < h <= 1024)
    if kind == 0x18:
        need(12 + 2 * w * h == len(data))
        return direct(data[12:], w, h)
    n, index, texel = fields("<3I", data, 12)
    need(kind == 0x4444 and index == w // 4 * (h // 4) * 2 and texel == 2 * index and 24 + n + texel + index == len(data))
    at = 24 + n
    return four_by_four(data[at : at + texel], data[at + texel :], data[24:at], w, h, 2)


def direct(raw: bytes, w: int, h: int) -> np.ndarray:
    rgb = colours(raw[: 2 * w * h])
    alpha = (np.frombuffer(raw, "<u2", w * h) >> 15) * 255
    return np.concatenate([rgb, alpha[:, None]], 1).reshape(h, w, 4).astype(np.uint8)


def four_by_four(texel: bytes, index: bytes, palette: bytes, w: int, h: int, step: int = 1) -> np.ndarray:
    """Blocks of 4x4 pixels of two bits each; a block's word has the place of its colours, and how the third and fourth are made."""
    n = w // 4 * (h // 4)
    word = np.frombuffer(index, "<u2", n).astype(np.int64)
    rgb = np.concatenate([colours(palette), np.zeros((1, 3), np.int64)])
    at = (word & 0x3FFF) * step
    c = np.stack([rgb[np.minimum(at + k, len(rgb) - 1)] for k in range(4)], 1).astype(np.int64)
    c = np.concatenate([c, np.full((n, 4, 1), 255)], 2)
    mode = word >> 14
    one, two = c[:, 0], c[:, 1]
    c[mode == 1, 2, :3] = ((one + two) // 2)[mode == 1, :3]
    c[mode == 3, 2, :3] = ((5 * one + 3 * two) // 8)[mode == 3, :3]
    c[mode == 3, 3, :3] = ((3 * one + 5 * two) // 8)[mode == 3, :3]
    c[mode < 2, 3] = 0
    code = np.frombuffer(texel, "<u4", n)[:, None] >> (2 * np.arange(16, dtype=np.uint32)) & 3
    out = c[np.arange(n)[:, None], code].reshape(h // 4, w // 4, 4, 4, 4)
    return out.swapaxes(1, 2).reshape(h // 4 * 4, w // 4 * 4, 4).astype(np.uint8)


def bmp(data: bytes) -> Picture:
    """The desktop's: rows of whole words, from the bottom unless the height is negative; direct colours as their bytes."""
    need(data[:2] == b"BM" and len(data) >= 54)
    size, _, at, dib, w, h, planes, bpp, packing = fields("<IIIIiiHHI", data, 2)
    need(dib >= 40 and size == len(data) and 54 <= at <= size and planes == 1 and bpp in (4, 8, 16, 24, 32) and packing in (0, 3))
    high, wide, unit = abs(h), abs(w), max(1, bpp // 8)
    row = (wide * bpp + 31) // 32 * 4
    need(wide and high and at + row * high <= size)
    y, x = np.divmod(np.arange(high * wide * unit), wide * unit)
    y = high - 1 - y if h > 0 else y
    places = y * (row * 8 // min(bpp, 8)) + x
    n, start = (1 << bpp if bpp < 16 else 0), 14 + dib + (12 if packing == 3 and dib == 40 else 0)
    palette = np.frombuffer(data[start : start + 4 * n].ljust(4 * n, b"\0"), np.uint8).reshape(-1, 4)[:, 2::-1]
    # a direct colour is `unit` values side by side; four-bit rows begin with the high half
    return Picture(data, "bmp", wide * unit, high, min(bpp, 8), at, row * high, palette, places, high_first=bpp == 4, extra={"bytes": unit})


def cbp1(data: bytes) -> Picture:
    """A large picture of blocks, which may repeat, by their places in the file."""
    need(data[:4] == b"CBP1")
    n, bpp, _, w, h, bw, bh = fields("<HBBHHHH", data, 4)
    need(bpp == 8 and w and h and bw and bh and bw % 8 == bh % 8 == 0 and 0 < n <= 256)
    cols, rows = w // bw, h // bh
    table = 20 + 2 * n
    pool = table + 2 * cols * rows
    need(cols * rows and pool <= len(data))
    offs = np.frombuffer(data, "<u2", cols * rows, table).astype(np.int64)
    live = offs >= pool
    need((offs[live] % 64 == 0).all() and (offs[live] + bw * bh <= len(data)).all())
    tiles = offs.reshape(rows, 1, cols, 1) // 64 + np.arange(bw * bh // 64).reshape(1, bh // 8, 1, bw // 8)
    entries = np.where(live.reshape(rows, 1, cols, 1), tiles, NOWHERE).reshape(-1)
    places, _ = on_map(entries, cols * bw // 8, wide=(1 << 40) - 1)
    return Picture(data, "cbp1", cols * bw, rows * bh, 8, 0, len(data), bright(data[20:table]), places)


# --- sprites and backgrounds of another --------------------------------------------------------


def obp1(data: bytes) -> Picture:
    need(data[:4] == b"OBP1")
    a, b, w, h, flags, n = fields("<6H", data, 4)
    bpp, bw, bh = (8 if flags & 1 else 4), 8 << (a & 3), 8 << (b & 3)
    need(w and h)
    size, at, start = w * h * bpp // 8, 16 + n, 16
    if flags & 0x200:  # a table of blocks, taken only where it says what the plain header would
        _, _, table, count, start, n, at, told = fields("<8I", data, 16)
        need(count and table + 8 * count <= len(data) and told == size)
        rec = np.frombuffer(data, np.dtype([("f", "<u4"), ("off", "<u2"), ("x", "u1"), ("y", "u1")]), count, table)
        per = int((rec["y"] == 0).sum())
        need(per and count % per == 0 and w % per == 0 and h % (count // per) == 0 and (w // per, h * per // count) == (bw, bh))
        k = np.arange(count)
        need((rec["off"].astype(int) * 32 == k * (bw * bh * bpp // 8)).all() and (rec["x"] == k % per * bw % 256).all() and (rec["y"] == k // per * bh % 256).all())
    else:
        bw, bh = min(bw, w), min(bh, h)
        need(w % bw == 0 and h % bh == 0)
    need(at + size <= len(data))
    return Picture(data, "obp1", w, h, bpp, at, size, colours(data[start : start + n]), in_blocks(w, h, bw, bh))


def bgp1(data: bytes) -> Picture:
    need(data[:4] == b"BGP1")
    _, w, h, tile, bpp = fields("<IHHBB", data, 4)
    pal, n, at, size, where, wide = fields("<6I", data, 16)
    need(tile == 8 and bpp in (4, 8) and where + wide <= len(data) and w >= 8)
    places, rows = on_map(np.frombuffer(data, "<u2", wide // 2, where).astype(np.int64), w // 8)
    return Picture(data, "bgp1", w // 8 * 8, len(places) // (w // 8 * 8), bpp, at, size, colours(data[pal : pal + n]), places, rows if bpp == 4 else None)


def records(data: bytes) -> list[tuple[int, int, str]]:
    """(offset, size, magic) of sprites and backgrounds behind one another: each reaches to the next."""
    import re

    at = [m.start() for m in re.finditer(b"OBP1|BGP1", data) if m.start() % 4 == 0]
    return [(a, b - a, data[a : a + 4].decode()) for a, b in zip(at, [*at[1:], len(data)], strict=True)]


# --- relocatable files ---------------------------------------------------------------------


def pointers(data: bytes) -> list[int]:
    """Offsets that hold pointers: distances in groups of seven bits, the highest first, up to a zero."""
    need(data[:4] == b"SIR0" and len(data) >= 16)
    at, out, place, value = fields("<I", data, 8)[0], [], 0, 0
    for byte in data[at:]:
        value = value << 7 | byte & 127
        if byte < 128:
            if not value:
                break
            place += value
            out.append(place)
            value = 0
    return out


def sir_image(data: bytes) -> Picture:
    need(data[:4] == b"SIR0")
    x0, y0, x1, y1, _, _, at, pal, end = fields("<9I", data, fields("<I", data, 4)[0])
    need(x0 <= x1 < 256 and y0 <= y1 < 256 and 16 <= at < pal < end <= len(data) and (end - pal) % 2 == 0 and 32 <= end - pal <= 512)
    w, h = 8 * (x1 - x0 + 1), 8 * (y1 - y0 + 1)
    need(pal - at in (w * h, w * h // 2))
    return Picture(data, "sir", w, h, 8 * (pal - at) // (w * h), at, pal - at, colours(data[pal:end]))


def sir_icon(data: bytes) -> Picture:
    need(data[:4] == b"SIR0")
    end = fields("<I", data, 4)[0]
    at, pal = fields("<2I", data, end)
    need(16 <= at < pal < end and end - pal in (32, 512))
    bpp = 4 if end - pal == 32 else 8
    side = math.isqrt((pal - at) * 8 // bpp)
    need(side * side * bpp // 8 == pal - at and side % 8 == 0)
    return Picture(data, "sir_icon", side, side, bpp, at, pal - at, colours(data[pal:end]), in_blocks(side, side, 8, 8))


def sir_sprite(data: bytes) -> Picture:
    """Pieces (w, h, x, y) of a sprite behind one another, as a strip; found by three pointers in a row."""
    at = set(pointers(data))
    for q in sorted(at):
        if {q + 4, q + 8} <= at and q >= 36:
            pal, pix, rest = fields("<3I", data, q)
            if 16 <= pal < pix < rest <= len(data) and fields("<I", data, q - 20)[0] == rest - pix:
                break
    else:
        raise Refused
    need((pix - pal) % 2 == 0 and 32 <= pix - pal <= 512)
    pieces, total = [], 0
    for o in range(rest, len(data) - 9, 10):
        w, h, x, y, off = fields("<5H", data, o)
        if total >= rest - pix or not w * h:
            break
        need(off == total & 0xFFFF and total + w * h <= rest - pix)
        pieces.append((w, h, x, y, total))
        total += w * h
    need(pieces)
    return Picture(data, "sir_sprite", rest - pix, 1, 8, pix, rest - pix, colours(data[pal:pix]), extra={"pieces": pieces})


# --- enveloped backgrounds and animations -------------------------------------------------------


def enveloped(data: bytes) -> tuple[bytes, Callable[[bytes], bytes]]:
    try:
        out, _ = studio.envelope_decode(data)
    except CodecError:
        raise Refused from None
    kind = fields("<I", data)[0]
    return out, lambda new: studio.envelope_encode(new, kind)


def level5_background(data: bytes) -> Picture:
    raw, wrap = enveloped(data)
    n = fields("<I", raw)[0]
    need(0 < n <= 256)
    tiles = fields("<I", raw, 4 + 2 * n)[0]
    at = 8 + 2 * n
    cols, rows = fields("<HH", raw, at + 64 * tiles)
    need(tiles and cols * rows and at + 64 * tiles + 4 + 2 * cols * rows == len(raw))
    places, _ = on_map(np.frombuffer(raw, "<u2", cols * rows, at + 64 * tiles + 4).astype(np.int64), cols)
    return Picture(raw, "level5_bg", 8 * cols, 8 * rows, 8, at, 64 * tiles, colours(raw[4 : 4 + 2 * n]), places, wrap=wrap, extra={"tiles": tiles})


def level5_animation(data: bytes, offsets: bool = False) -> list[Picture]:
    """A picture an image, of parts that are placed on it; `offsets`: the kind whose parts have places of their own before."""
    raw, wrap = enveloped(data)
    count, depth = fields("<HH", raw)
    need(depth in (3, 4) and 0 < count <= 512)
    bpp, at = (4 if depth == 3 else 8), 4 + 4 * offsets
    found = []
    for _ in range(count):
        w, h, parts, _ = fields("<4H", raw, at)
        need(0 < parts <= 256)
        at += 8
        own = []
        for _ in range(parts):
            at += 4 * offsets
            x, y, lw, lh = fields("<4H", raw, at)
            need(lw <= 3 and lh <= 3)
            pw, ph = 8 << lw, 8 << lh
            own.append((x, y, pw, ph, at + 8))
            at += 8 + pw * ph * bpp // 8
            need(at <= len(raw))
        found.append((max([w, *(x + pw for x, _, pw, _, _ in own)]), max([h, *(y + ph for _, y, _, ph, _ in own)]), own))
    n = fields("<I", raw, 4)[0] if offsets else fields("<I", raw, at)[0]
    at += 0 if offsets else 4
    need(0 < n <= 256 and at + 2 * n <= len(raw))
    palette, out = colours(raw[at : at + 2 * n]), []
    for w, h, own in found:
        start, end = own[0][4], own[-1][4] + own[-1][2] * own[-1][3] * bpp // 8
        places = np.full((h, w), NOWHERE, np.int64)
        for x, y, pw, ph, o in own:
            places[y : y + ph, x : x + pw] = (o - start) * 8 // bpp + np.arange(pw * ph).reshape(ph, pw)
        out.append(Picture(raw, "level5_ani", w, h, bpp, start, end - start, palette, places.ravel(), wrap=wrap))
    return out


# --- textures and fonts --------------------------------------------------------------------

#: Texture format -> bits a pixel.
TEXTURE_BITS = {2: 2, 3: 4, 1: 8, 4: 8, 6: 8}


def g3d_blocks(data: bytes) -> list[tuple[bytes, int, int]]:
    """(magic, offset, size): these files have a table of offsets behind their header."""
    need(data[:4] in (b"BTX0", b"BMD0", b"BCA0", b"BTP0", b"BTA0", b"BMA0", b"BVA0") and len(data) >= 16)
    n = fields("<H", data, 14)[0]
    return [(data[o : o + 4], o, fields("<I", data, o + 4)[0]) for o in fields(f"<{n}I", data, 16) if o + 8 <= len(data)]


def named_entries(data: bytes, at: int) -> list[tuple[str, bytes]]:
    n = data[at + 1]
    p = at + fields("<H", data, at + 6)[0]
    unit = fields("<H", data, p)[0]
    names = p + 4 + n * unit
    need(names + 16 * n <= len(data))
    return [(data[names + 16 * i :][:16].split(b"\0")[0].decode("ascii", "replace"), data[p + 4 + i * unit :][:unit]) for i in range(n)]


def textures(data: bytes) -> list[Picture | np.ndarray]:
    """Textures in order: pictures of indices, or h x w x 4 arrays of direct and block colours. extra: name, format, palette's name."""
    base = next((o for m, o, _ in g3d_blocks(data) if m == b"TEX0"), None)
    need(base is not None)
    u = lambda o, f="<I": fields(f, data, base + o)[0]
    texel, blocks_, index = base + u(0x14), base + u(0x24), base + u(0x28)
    size, pals, start = u(0x30) * 8, u(0x34), base + u(0x38)
    palettes = [(name, 8 * fields("<H", raw)[0]) for name, raw in named_entries(data, base + pals)] if pals else []
    out = []
    for i, (name, raw) in enumerate(named_entries(data, base + u(0x0E, "<H"))):
        off, params = fields("<HH", raw)
        off, kind, w, h = 8 * off, params >> 10 & 7, 8 << (params >> 4 & 7), 8 << (params >> 7 & 7)
        wanted = (name + "_pl", name[:13] + "_pl", name)
        pal = next((p for p in palettes if p[0] in wanted), palettes[i] if i < len(palettes) else palettes[0] if palettes else (None, 0))
        raw_pal = data[start + pal[1] : start + size] if palettes else b""
        extra = {"name": name, "format": kind, "palette": pal[0]}
        if kind in TEXTURE_BITS:
            bpp = TEXTURE_BITS[kind]
            need(texel + off + w * h * bpp // 8 <= len(data))
            out.append(Picture(data, "tex", w, h, bpp, texel + off, w * h * bpp // 8, colours(raw_pal[: 2 << bpp]), extra=extra))
        elif kind == 5:
            n = w * h // 16
            out.append(four_by_four(data[blocks_ + off :][: 4 * n], data[index + off // 2 :][: 2 * n], raw_pal, w, h))
        else:
            need(kind == 7)
            out.append(direct(data[texel + off :][: 2 * w * h], w, h))
    return out


def font(data: bytes) -> Picture:
    """All glyphs below one another; extra: line height, widths by glyph, glyph by code. Bits run on from row to row of a glyph."""
    found: dict = {}
    for m, o, n in blocks(data):
        name = next((k for k in (b"FINF", b"CGLP", b"CWDH", b"CMAP") if m in (k, k[::-1])), None)
        if name:
            found.setdefault(name, (o, n))
    need(b"FINF" in found and b"CGLP" in found)
    o, n = found[b"CGLP"]
    w, h, size, _, _, bpp = fields("<BBHBBB", data, o + 8)
    need(w and h and size and bpp in (1, 2, 4, 8))
    at, glyphs = o + 18, (o + n - o - 18) // size
    need(w * h * bpp <= 8 * size and o + n <= len(data))
    per = 8 * size // bpp
    places = (np.arange(glyphs)[:, None] * per + np.arange(w * h)).ravel()
    widths = {}
    if b"CWDH" in found:
        o, n = found[b"CWDH"]
        first, last = fields("<HH", data, o + 8)
        widths = {g: tuple(data[p : p + 3]) for g in range(first, last + 1) if (p := o + 16 + 3 * (g - first)) + 3 <= o + n}
    return Picture(data, "font", w, h * glyphs, bpp, at, glyphs * size, np.zeros((0, 3)), places, high_first=True, extra={"line_height": data[found[b"FINF"][0] + 9], "widths": widths, "codes": codes_of(data, found.get(b"CMAP"))})


def codes_of(data: bytes, block) -> dict[int, int]:
    out, seen, at = {}, set(), block and block[0]
    while at and at not in seen and at + 20 <= len(data) and data[at : at + 4] in (b"CMAP", b"PAMC"):
        seen.add(at)
        first, last, kind, after = fields("<HHII", data, at + 8)
        body = at + 24
        try:
            if kind == 0:
                out |= {c: c - first for c in range(first, last + 1)}
            elif kind == 1:
                out |= {c: g for c, g in zip(range(first, last + 1), fields(f"<{last - first + 1}H", data, body), strict=True) if g != 0xFFFF}
            elif kind == 2:
                out |= dict(fields("<HH", data, body + 2 + 4 * i) for i in range(fields("<H", data, body)[0]))
        except Refused:
            pass
        at = after
    return out


# --- which one -----------------------------------------------------------------------------

#: Signatures of pictures that others decode.
PHOTOS = ((0, b"\xff\xd8\xff", "JPEG"), (0, b"\x89PNG\r\n\x1a\n", "PNG"), (0, b"GIF87a", "GIF"), (0, b"GIF89a", "GIF"), (4, b"pu\x01\x01", "PU"))
READERS = {"bpg1": bpg1, "bmp": bmp, "cbp1": cbp1, "obp1": obp1, "bgp1": bgp1, "sir_sprite": sir_sprite, "sir": sir_image, "sir_icon": sir_icon, "font": font}
BY_NAME = {".ebp": {"ebp": ebp}, ".arc": {"level5_bg": level5_background}}


def photo(data: bytes, name: str = "") -> str | None:
    for at, mark, kind in PHOTOS:
        if data[at : at + len(mark)] == mark:
            return kind
    if name.lower().endswith(".tga") and len(data) >= 18:
        w, h = struct.unpack_from("<HH", data, 12)
        plain = data[2] in (1, 2, 3)
        if data[2] in (1, 2, 3, 9, 10, 11) and data[1] < 2 and 0 < w <= 1024 and 0 < h <= 1024 and data[16] in (8, 15, 16, 24, 32) and (not plain or 18 + data[0] + w * h * data[16] // 8 <= len(data)):
            return "TGA"
    return None


def open_picture(data: bytes, name: str = "") -> Picture:
    """The first reader that takes the bytes; formats without a magic only by their extension."""
    ext = "." + name.lower().rsplit(".", 1)[-1]
    for read in (BY_NAME.get(ext, {}) | READERS).values():
        try:
            return read(data)
        except Refused:
            continue
    raise Refused("no picture")


def picture(content: Column, name: Column | None = None) -> Column:
    """struct<value: struct<kind, w, h, bpp, pixels>, error>."""
    from pyspark.sql import functions as F

    schema = "struct<kind:string,w:int,h:int,bpp:int,pixels:binary>"
    show = lambda p: (p.kind, p.w, p.h, p.bpp, p.pixels().astype(np.uint8).tobytes())
    if name is None:
        return parsed(content, schema, lambda d: show(open_picture(d)))

    def one(data, n):
        try:
            return show(open_picture(bytes(data), n or "")), None
        except ValueError as e:
            return None, str(e) or type(e).__name__

    return F.udf(lambda d, n: None if d is None else one(d, n), f"struct<value:{schema},error:string>", useArrow=True)(content, name)
