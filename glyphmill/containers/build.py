"""New archives, cartridge images and graphics files from their parts: what the readers of this package take."""

from __future__ import annotations

import io
import struct
import zipfile
from itertools import accumulate

from glyphmill.codecs import bios
from glyphmill.sources.cartridge import BANNER_AT, CRC_AT, REGIONS, USED_AT, crc16

from .archives import aligned, encode, u32

Parts = list[tuple[str, bytes]]


def name_table(paths: list[str]) -> tuple[bytes, list[int]]:
    """A file-name table of the paths, and each path's file id: a folder's files are numbered in a row, folder after folder."""
    tree: dict = {}
    for p in paths:
        *folders, name = p.split("/")
        at = tree
        for f in folders:
            at = at.setdefault(f, {})
        at[name] = None
    queue, rows, ids, first = [("", tree, 0)], [], {}, 0
    for number, (path, folder, _) in enumerate(queue):  # grows while it is read
        body, start = b"", first
        for name, child in folder.items():
            raw, whole = name.encode("cp932"), f"{path}{name}"
            if child is None:
                body += bytes([len(raw)]) + raw
                ids[whole] = first
                first += 1
            else:
                queue.append((whole + "/", child, number))
                body += bytes([0x80 | len(raw)]) + raw + struct.pack("<H", 0xF000 + len(queue) - 1)
        rows.append((start, body + b"\0"))
    heads, at = b"", 8 * len(rows)
    for k, (start, body) in enumerate(rows):
        heads += struct.pack("<IHH", at, start, len(rows) if k == 0 else 0xF000 + queue[k][2])
        at += len(body)
    return heads + b"".join(b for _, b in rows), [ids[p] for p in paths]


def laid(bodies: list[bytes], base: int = 0, fill: int = 0xFF) -> tuple[bytes, list[int]]:
    """The bodies behind one another, each padded to four bytes, and start and end of each."""
    out, ends = b"", []
    for b in bodies:
        ends += [base + len(out), base + len(out) + len(b)]
        out += aligned(b, fill)
    return out, ends


def in_order(parts: Parts) -> tuple[bytes, list[bytes]]:
    """The name table, and the bodies by file id."""
    table, ids = name_table([n for n, _ in parts])
    return table, [b for _, b in sorted(zip(ids, (b for _, b in parts), strict=True))]


def narc(parts: Parts) -> bytes:
    table, bodies = in_order(parts)
    body, ends = laid(bodies)
    blocks = ((b"BTAF", u32(len(bodies), *ends)), (b"BTNF", aligned(table, 0xFF)), (b"GMIF", body))
    rest = b"".join(m + u32(8 + len(b)) + b for m, b in blocks)
    return b"NARC\xfe\xff\x00\x01" + struct.pack("<IHH", 16 + len(rest), 16, 3) + rest


def nitrofs(parts: Parts) -> bytes:
    table, bodies = in_order(parts)
    fat = 16 + len(table)
    base = -(-(fat + 8 * len(bodies)) // 4) * 4
    body, ends = laid(bodies, base)
    return (u32(16, len(table), fat, 8 * len(bodies)) + table + u32(*ends)).ljust(base, b"\xff") + body


def ccb(parts: Parts) -> bytes:
    rows, bodies = b"", []
    for name, b in parts:
        packed = bios.lz_encode(b)[4:]
        bodies.append(packed)
        rows += name.encode().ljust(24, b"\0") + u32(7 | len(packed) << 8, 0x10 | len(b) << 8)
    return b"CCB \0\1" + struct.pack("<H", len(parts)) + rows + b"".join(bodies)


def zipped(parts: Parts) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, b in parts:
            info = zipfile.ZipInfo(name)
            info.compress_type = zipfile.ZIP_DEFLATED
            z.writestr(info, b, compresslevel=9)
    return out.getvalue()


def cingpack(parts: Parts) -> bytes:
    bodies = [encode("zlib", b) for _, b in parts]
    rows = b"".join(bytes([len(n)]) + n.encode("ascii") + len(b).to_bytes(4, "big") for (n, _), b in zip(parts, bodies, strict=True))
    return bytes(4) + struct.pack(">III", len(parts), 12 + len(rows), sum(len(b) for _, b in parts)) + rows + b"".join(bodies)


def offsets(bodies: list[bytes], base: int) -> list[int]:
    return [base, *(base + x for x in accumulate(map(len, bodies)))]


def ntrp(parts: Parts) -> bytes:
    bodies = [b for _, b in parts]
    base = 12 + 8 * len(bodies) + 8
    rows = [x for o, b in zip(offsets(bodies, base), bodies, strict=False) for x in (o, len(b))]
    return b"NTRP\4\4\4\0" + u32(0, *rows, 0, 0) + b"".join(bodies)


def offset_archive(parts: Parts) -> bytes:
    bodies = [b for _, b in parts]
    return u32(len(bodies), *offsets(bodies, 8 + 4 * len(bodies))) + b"".join(bodies)


def member_table(parts: Parts) -> bytes:
    bodies = [b for _, b in parts]
    return u32(*offsets(bodies, 4 * len(bodies))[:-1]) + b"".join(bodies)


def pair_table(parts: Parts) -> bytes:
    body, ends = laid([b for _, b in parts], 4 + 8 * len(parts), 0)
    rows = [x for a, b in zip(ends[::2], ends[1::2], strict=True) for x in (a, b - a)]
    return u32(len(parts), *rows) + body


def indexpack(parts: Parts) -> bytes:
    bodies = [b for _, b in parts]
    at = offsets(bodies, 8 + 12 * len(bodies))
    rows = [x for o, b in zip(at, bodies, strict=False) for x in (1, o, len(b))]
    return bytes(8) + u32(*rows) + b"".join(bodies)


def lzchain(parts: Parts) -> bytes:
    return b"".join(aligned(bios.lz_encode(b), 0, 16) for _, b in parts)


BUILDERS = {f.__name__: f for f in (narc, nitrofs, ccb, cingpack, ntrp, offset_archive, member_table, pair_table, indexpack, lzchain)} | {"zip": zipped}


# --- cartridge images ------------------------------------------------------------------------

#: Where the first region lies, the least image, and rows of the overlay table.
FIRST, LEAST, OVERLAY_ROW = 0x4000, 0x4000, 32


def cartridge(title: str, code: str, parts: Parts, *, arm9: bytes = b"", arm7: bytes = b"", banner: bytes = b"", overlays: list[bytes] = ()) -> bytes:
    """An image with the named files; overlays have no names and the first file ids."""
    table, bodies = in_order(parts) if parts else name_table([])
    # names count from 0, so that overlays take the ids behind them
    bodies = [*bodies, *overlays]
    ov9 = b"".join(struct.pack("<8I", k, 0x2000000, len(b), 0, 0, 0, len(bodies) - len(overlays) + k, 0) for k, b in enumerate(overlays))
    out, place = bytearray(FIRST), dict.fromkeys(REGIONS, 0)

    def put(what: str, data: bytes) -> int:
        at = len(out)
        place[f"{what}_off"], place[f"{what}_size"] = at, len(data)
        out.extend(aligned(data, 0xFF))
        return at

    for what, data in (("arm9", arm9), ("ov9", ov9), ("arm7", arm7), ("ov7", b""), ("fnt", table)):
        put(what, data)
    banner_at = put("banner", banner)
    fat_at = put("fat", bytes(8 * len(bodies)))
    body, ends = laid(bodies, len(out))
    out[fat_at : fat_at + 8 * len(bodies)] = u32(*ends)
    out += body
    out[0x20:0x60] = u32(*(place[r] for r in REGIONS))
    out[0:16] = title.encode("ascii").ljust(12, b"\0") + code.encode("ascii")
    out[BANNER_AT : BANNER_AT + 4], out[USED_AT : USED_AT + 4] = u32(banner_at), u32(len(out))
    out[CRC_AT : CRC_AT + 2] = crc16(bytes(out[:CRC_AT])).to_bytes(2, "little")
    return bytes(out)


# --- graphics files --------------------------------------------------------------------------


def nitro(magic: bytes, *blocks: tuple[bytes, bytes]) -> bytes:
    body = b"".join(m + u32(8 + len(b)) + b for m, b in blocks)
    return magic + b"\xff\xfe\x00\x01" + struct.pack("<IHH", 16 + len(body), 16, len(blocks)) + body


def palette(words: list[int]) -> bytes:
    return nitro(b"RLCN", (b"TTLP", u32(3, 0, 2 * len(words), 16) + struct.pack(f"<{len(words)}H", *words)))


def tiles(pixels: bytes, width: int, height: int) -> bytes:
    """Eight-bit tiles in reading order."""
    return nitro(b"RGCN", (b"RAHC", struct.pack("<HH5I", height, width, 4, 0, 0, len(pixels), 24) + pixels))


def screen(cols: int, rows: int, entries: list[int]) -> bytes:
    return nitro(b"RCSN", (b"NRCS", struct.pack("<HHII", 8 * cols, 8 * rows, 0, 2 * len(entries)) + struct.pack(f"<{len(entries)}H", *entries)))


def cells(pieces: list[tuple[int, int, int]]) -> bytes:
    """One cell of 8x8 pieces (x, y, tile)."""
    raw = b"".join(struct.pack("<3H", y & 0xFF, x & 0x1FF, t) for x, y, t in pieces)
    return nitro(b"RECN", (b"KBEC", struct.pack("<HHIIII", 1, 0, 24, 0, 0, 0) + bytes(4) + struct.pack("<HHI", len(pieces), 0, 0) + raw))


def banner(pixels: bytes, words: list[int], titles: list[str]) -> bytes:
    """Version 1: 32x32 pixels of four bits as they are stored, 16 colours, six titles."""
    body = pixels + struct.pack("<16H", *words) + b"".join(t.encode("utf-16-le").ljust(256, b"\0") for t in titles)
    return struct.pack("<HH", 1, crc16(body)) + bytes(28) + body
