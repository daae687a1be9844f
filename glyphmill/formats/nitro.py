"""Graphics files with a common 16-byte header: header, blocks, and finding them inside other bytes."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from glyphmill.codecs import bios

#: Magics on disk (most are stored reversed) and their kinds.
MAGICS = {
    b"RLCN": "NCLR", b"RGCN": "NCGR", b"RCSN": "NSCR", b"RECN": "NCER", b"RNAN": "NANR", b"RCMN": "NMCR", b"RAMN": "NMAR", b"RTFN": "NFTR", b"RPCN": "NCPR",
    b"NCLR": "NCLR", b"NCGR": "NCGR", b"NSCR": "NSCR", b"NCER": "NCER", b"NANR": "NANR", b"NFTR": "NFTR",
    b"BMD0": "NSBMD", b"BTX0": "NSBTX", b"BCA0": "NSBCA", b"BTP0": "NSBTP", b"BTA0": "NSBTA", b"BMA0": "NSBMA", b"BVA0": "NSBVA",
    b"NARC": "NARC", b"SDAT": "SDAT",
}
#: Kinds whose first block must fit before a hit inside other bytes counts.
BLOCKY = {"NCLR", "NCGR", "NSCR", "NCER", "NANR"}
ANY = re.compile(b"|".join(map(re.escape, MAGICS)))


@dataclass(frozen=True)
class Header:
    kind: str
    version: int
    size: int
    first: int
    blocks: int


def header(data: bytes, at: int = 0) -> Header | None:
    raw = data[at : at + 16]
    kind = MAGICS.get(raw[:4])
    if kind is None or len(raw) < 16 or raw[4:6] not in (b"\xff\xfe", b"\xfe\xff"):
        return None
    h = Header(kind, *(int.from_bytes(raw[a:b], "little") for a, b in ((6, 8), (8, 12), (12, 14), (14, 16))))
    return h if 16 <= h.first <= 64 and 1 <= h.blocks <= 16 and h.size >= h.first + 8 else None


def blocks(data: bytes, at: int = 0) -> list[tuple[bytes, int, int]]:
    """(magic, offset, size) of the file's blocks; a size under 8 is the last one read."""
    h, out = header(data, at), []
    if h:
        pos, end = at + h.first, min(at + h.size, len(data))
        while len(out) < h.blocks and pos + 8 <= end and (not out or out[-1][2] >= 8):
            out.append((data[pos : pos + 4], pos, int.from_bytes(data[pos + 4 : pos + 8], "little")))
            pos += out[-1][2]
    return out


def carve(data: bytes, kinds: set[str] | None = None) -> Iterator[tuple[int, int, str]]:
    """(offset, size, kind) of the files inside `data`, none inside another; up to 3 bytes may be cut off the last."""
    free = 0
    for hit in ANY.finditer(data):
        at = hit.start()
        h = header(data, at) if at >= free else None
        if h is None or at + h.size > len(data) + 3 or kinds and h.kind not in kinds:
            continue
        if h.kind in BLOCKY and not any(size <= h.size for *_, size in blocks(data, at)[:1]):
            continue
        free = at + h.size
        yield at, min(h.size, len(data) - at), h.kind


#: Sizes a packed stream inside other bytes may declare.
LEAST, MOST = 24, 16 << 20


def carve_packed(data: bytes, step: int = 4) -> Iterator[tuple[int, str, int, str]]:
    """(offset, codec, decoded size, kind) of packed streams whose payload begins with a header.

    The first flag byte must say that the payload begins with plain bytes: no magic starts with a match.
    """
    for found in re.finditer(rb"[\x10\x11\x30]", data):
        at = found.start()
        size = int.from_bytes(data[at + 1 : at + 4], "little")
        if at % step or at + 8 >= len(data) or not LEAST <= size <= MOST:
            continue
        flag = data[at + 4]
        if flag & 0x80 or data[at] == 0x30 and flag < 15:
            continue
        name = {0x10: "lz10", 0x11: "lz11", 0x30: "rle"}[data[at]]
        # the same stream, said to end after 16 bytes
        try:
            start = bios.CODECS[name][1](data[at : at + 1] + bytes([16, 0, 0]) + data[at + 4 : at + 4 + 64])[0]
        except bios.CodecError:
            continue
        h = header(start)
        if h:
            yield at, name, size, h.kind
