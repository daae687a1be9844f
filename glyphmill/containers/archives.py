"""Archive layouts: each maps bytes to spans (where its members lie) and lays new bodies out again.

A kind's `spans` returns None for anything that is not exactly its layout, so that layouts without a magic can be
tried on arbitrary bytes. `pack` with no changes gives the input back wherever the layout describes all of its bytes.
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np

from glyphmill.codecs import bios


class Refused(ValueError):
    """Bytes that are not the layout in question."""


@dataclass(frozen=True)
class Span:
    ordinal: int
    name: str | None
    off: int
    size: int
    how: str = "stored"
    full: int = 0
    flags: int = 0


@dataclass(frozen=True)
class Kind:
    name: str
    magic: bytes
    read: Callable[[bytes], list[Span]]
    lay: Callable[[bytes, list[Span], dict[int, tuple[bytes, int]]], bytes] | None

    def spans(self, data: bytes) -> list[Span] | None:
        if not data.startswith(self.magic):
            return None
        try:
            return self.read(data)
        except Refused:
            return None


def need(ok) -> None:
    if not ok:
        raise Refused


def words(data: bytes, at: int, n: int, kind: str = "<u4") -> np.ndarray:
    unit = np.dtype(kind)
    need(0 <= at and n >= 0 and at + unit.itemsize * n <= len(data))
    return np.frombuffer(data, unit, n, at).astype(np.int64)


def u32(*values: int) -> bytes:
    return np.array(values, "<u4").tobytes()


def aligned(body: bytes, fill: int = 0, to: int = 4) -> bytes:
    return body + bytes([fill]) * (-len(body) % to)


def table(offs, sizes, names=None, **more) -> list[Span]:
    return [Span(i, names[i] if names else None, int(o), int(s), **{k: v[i] for k, v in more.items()}) for i, (o, s) in enumerate(zip(offs, sizes, strict=True))]


def stored(data: bytes, spans: list[Span], new: dict[int, tuple[bytes, int]]) -> list[bytes]:
    """Each member's bytes as they lie in the archive, the changed ones replaced."""
    return [new[s.ordinal][0] if s.ordinal in new else data[s.off : s.off + s.size] for s in spans]


# --- name tables -----------------------------------------------------------------------------------------------------

ROOT = 0xF000
DEEPEST = 32


def names(data: bytes, base: int, end: int, folder: int = ROOT, path: str = "", depth: int = 0) -> Iterator[tuple[int, str]]:
    """(file id, path) of a file-name table in reading order; Refused where it leaves [base, end)."""
    need(depth <= DEEPEST and end <= len(data))
    row = base + (folder & 0xFFF) * 8
    need(row + 6 <= end)
    at, ident = base + int(words(data, row, 1)[0]), int(words(data, row + 4, 1, "<u2")[0])
    while True:
        need(at < end)
        tag, at = data[at], at + 1
        if not tag:
            return
        long = tag & 0x7F
        need(long and at + long <= end)
        own = path + data[at : at + long].decode("cp932", "replace")
        at += long
        if tag & 0x80:
            below, at = int(words(data, at, 1, "<u2")[0]), at + 2
            need(below & ROOT == ROOT)
            yield from names(data, base, end, below, own + "/", depth + 1)
        else:
            yield ident, own
            ident += 1


# --- layouts with a magic --------------------------------------------------------------------------------------------


def narc_blocks(data: bytes) -> dict[bytes, tuple[int, int]]:
    at, n = (int(x) for x in words(data, 12, 2, "<u2"))
    found = {}
    for _ in range(n):
        size = int(words(data, at + 4, 1)[0])
        found[data[at : at + 4]] = (at, size)
        at += size
    need(b"GMIF" in found)
    return found


def narc_read(data: bytes) -> list[Span]:
    found = narc_blocks(data)
    ends = np.zeros((0, 2), np.int64)
    if b"BTAF" in found:
        at = found[b"BTAF"][0]
        count = int(words(data, at + 8, 1)[0])
        ends = words(data, at + 12, 2 * count).reshape(-1, 2)
    labels: list[str | None] = [None] * len(ends)
    if b"BTNF" in found:
        at, size = found[b"BTNF"]
        try:
            for ident, path in names(data, at + 8, min(at + size, len(data))):
                if ident < len(labels):
                    labels[ident] = path
        except Refused:  # names may be cut: members beyond have none
            pass
    body = found[b"GMIF"][0] + 8
    lo, hi = (np.minimum(body + ends[:, k], len(data)) for k in (0, 1))
    return table(lo, np.maximum(hi - lo, 0), labels)


def narc_lay(data, spans, new):
    found = narc_blocks(data)
    at, size = found.get(b"BTNF", (0, 0))
    label = data[at : at + size] or b"BTNF" + u32(16, 4) + bytes([0, 0, 1, 0])
    first_end = spans[0].off + spans[0].size if len(spans) > 1 else 0
    fill = data[first_end] if first_end and spans[1].off > first_end else 0xFF
    body, rows = bytearray(), []
    for b in stored(data, spans, new):
        rows += [len(body), len(body) + len(b)]
        body += aligned(b, fill)
    fat = b"BTAF" + u32(12 + 4 * len(rows), len(spans), *rows)
    tail = fat + label + b"GMIF" + u32(8 + len(body)) + body
    return b"NARC\xfe\xff\x00\x01" + u32(16 + len(tail)) + b"\x10\0\3\0" + tail


CCB_ROW = np.dtype([("name", "V24"), ("a", "<u4"), ("b", "<u4")])
#: Fixed values of the format: codec byte to codec, 0 is stored.
CCB_CODECS = {0: "stored", 0x10: "lz10", 0x11: "lz11", 0x30: "rle"}


def ccb_read(data: bytes) -> list[Span]:
    n = int(words(data, 6, 1, "<u2")[0])
    need(8 + 32 * n <= len(data))
    rows = np.frombuffer(data, CCB_ROW, n, 8)
    packed, kinds = rows["a"].astype(np.int64) >> 8, rows["b"] & 255
    need(all(int(k) in CCB_CODECS for k in kinds))
    ends = 8 + 32 * n + np.cumsum(packed)
    need((int(ends[-1]) if n else 8) == len(data))
    labels = [bytes(r).split(b"\0")[0].decode("ascii", "replace") for r in rows["name"]]
    return table(ends - packed, packed, labels, how=[CCB_CODECS[int(k)] for k in kinds], full=[int(x) for x in rows["b"] >> 8], flags=[int(x) for x in rows["a"] & 255])


def ccb_lay(data, spans, new):
    bodies = stored(data, spans, new)
    codes = {v: k for k, v in CCB_CODECS.items()}
    head = b"".join(
        data[8 + 32 * s.ordinal :][:24] + u32(s.flags | len(b) << 8, codes[s.how] | (new[s.ordinal][1] if s.ordinal in new else s.full) << 8) for s, b in zip(spans, bodies, strict=True)
    )
    return data[:8] + head + b"".join(bodies)


def ntrp_read(data: bytes) -> list[Span]:
    rows = words(data, 12, 2 * min(4096, max(len(data) - 12, 0) // 8)).reshape(-1, 2)
    off, size = rows[:, 0], rows[:, 1]
    good = (off >= 12) & (size > 0) & (off + size <= len(data)) & (np.diff(off, prepend=0) >= 0)
    n = len(good) if good.all() else int(np.argmin(good))
    need(n and off[0] >= 12 + 8 * n)
    return table(off[:n], size[:n])


def ntrp_lay(data, spans, new):
    if all(len(b) == spans[i].size for i, (b, _) in new.items()):
        return patched(data, {spans[i].off: b for i, (b, _) in new.items()})
    out, rows = bytearray(data[: spans[0].off]), []
    for b in stored(data, spans, new):
        rows += [len(out), len(b)]
        out += aligned(b)
    return patched(bytes(out), {12: u32(*rows)})


def patched(data: bytes, at: dict[int, bytes]) -> bytes:
    out = bytearray(data)
    for off, b in at.items():
        out[off : off + len(b)] = b
    return bytes(out)


def zip_files(data: bytes) -> list[zipfile.ZipInfo]:
    try:
        return zipfile.ZipFile(io.BytesIO(data)).infolist()
    except (zipfile.BadZipFile, ValueError, NotImplementedError, EOFError):
        raise Refused from None


def zip_read(data: bytes) -> list[Span]:
    out = []
    for info in zip_files(data):
        if info.is_dir():
            continue
        need(info.compress_type in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED))
        begin = info.header_offset + 30 + int(words(data, info.header_offset + 26, 2, "<u2").sum())
        out.append(Span(len(out), info.filename, begin, info.compress_size, "deflate" if info.compress_type else "stored", info.file_size))
    return out


def zip_lay(data, spans, new):
    out, ordinal = io.BytesIO(), 0
    with zipfile.ZipFile(io.BytesIO(data)) as old, zipfile.ZipFile(out, "w") as made:
        for info in old.infolist():
            body = b""
            if not info.is_dir():
                span = spans[ordinal]
                body = decode(span.how, *new[ordinal]) if ordinal in new else old.read(info)
                ordinal += 1
            row = zipfile.ZipInfo(info.filename, info.date_time)
            row.compress_type, row.external_attr = info.compress_type, info.external_attr
            made.writestr(row, body, compresslevel=9)
    return out.getvalue()


def path_hash(path: str) -> int:
    """Entry names of hashed zips: CRC-32 from 0 without the last complement, over the lower-cased path with single backslashes."""
    clean = re.sub(r"[/\\]+", r"\\", path).lstrip("\\").lower()
    return zlib.crc32(bytes(ord(c) & 255 for c in clean), 0xFFFFFFFF) ^ 0xFFFFFFFF


# --- layouts without a magic -----------------------------------------------------------------------------------------


def nitrofs_read(data: bytes) -> list[Span]:
    need(len(data) >= 32)
    fnt, fnt_size, fat, fat_size = (int(x) for x in words(data, 0, 4))
    need(min(fnt, fat) >= 16 and fnt_size and fat_size and fat_size % 8 == 0 and max(fnt + fnt_size, fat + fat_size) <= len(data))
    found = dict(names(data, fnt, fnt + fnt_size))
    n = fat_size // 8
    need(found.keys() == set(range(n)))
    ends = words(data, fat, 2 * n).reshape(-1, 2)
    need((ends[:, 0] >= max(fnt + fnt_size, fat + fat_size)).all() and (ends[:, 0] <= ends[:, 1]).all() and (ends[:, 1] <= len(data)).all())
    return table(ends[:, 0], ends[:, 1] - ends[:, 0], found)


def nitrofs_lay(data, spans, new):
    out, rows = bytearray(data[: min(s.off for s in spans)]), []
    base = len(out)
    for b in stored(data, spans, new):
        rows += [len(out), len(out) + len(b)]
        out += b + b"\xff" * (-(len(out) + len(b) - base) % 4)
    return patched(bytes(out), {int(words(data, 8, 1)[0]): u32(*rows)})


def offsets_read(data: bytes) -> list[Span]:
    need(len(data) >= 12)
    n = int(words(data, 0, 1)[0])
    need(1 <= n <= 1 << 16)
    offs = words(data, 4, n + 1)
    live = offs[:-1][offs[:-1] > 0]
    need(offs[-1] == len(data) and len(live) and live[0] >= 8 + 4 * n and (np.diff(live) >= 0).all() and live[-1] <= len(data))
    sizes = np.zeros(n, np.int64)
    sizes[offs[:-1] > 0] = np.diff(np.append(live, len(data)))
    return table(offs[:-1], sizes)


def offsets_lay(data, spans, new):
    at, offs, bodies = 8 + 4 * len(spans), [], stored(data, spans, new)
    for s, b in zip(spans, bodies, strict=True):
        offs.append(at if s.off or s.ordinal in new else 0)
        at += len(b)
    return u32(len(spans), *offs, at) + b"".join(bodies)


def implicit_read(data: bytes) -> list[Span]:
    need(len(data) >= 8)
    first = int(words(data, 0, 1)[0])
    need(first % 4 == 0 and 4 <= first <= min(len(data), 4 << 16))
    edges = np.append(words(data, 0, first // 4), len(data))
    need(len(edges) > 2 and (np.diff(edges) >= 0).all())
    return table(edges[:-1], np.diff(edges))


def implicit_lay(data, spans, new):
    bodies = stored(data, spans, new)
    return u32(*(4 * len(spans) + np.cumsum([0] + [len(b) for b in bodies[:-1]]))) + b"".join(bodies)


#: Most padding between members, and most members, of a pair table.
PAIR_GAP, PAIR_MOST = 32, 4096


def pairs_read(data: bytes) -> list[Span]:
    need(len(data) >= 12)
    n = int(words(data, 0, 1)[0])
    need(1 <= n <= PAIR_MOST)
    rows = words(data, 4, 2 * n).reshape(-1, 2)
    gaps = np.append(rows[:, 0], len(data)) - np.append(4 + 8 * n, rows.sum(axis=1))
    need((gaps >= 0).all() and (gaps <= PAIR_GAP).all())
    return table(rows[:, 0], rows[:, 1])


def pairs_lay(data, spans, new):
    head = 4 + 8 * len(spans)
    body, rows = bytearray(data[head : spans[0].off]), []
    for s, b in zip(spans, stored(data, spans, new), strict=True):
        rows += [head + len(body), len(b)]
        body += b
        if s is not spans[-1]:
            body = bytearray(aligned(bytes(body)))
    return data[:4] + u32(*rows) + bytes(body) + data[spans[-1].off + spans[-1].size :]


def index_read(data: bytes) -> list[Span]:
    need(len(data) >= 40 and not any(data[:8]))
    rows, edge = [], len(data)
    while 8 + 12 * (len(rows) + 1) <= edge:
        flags, off, size = (int(x) for x in words(data, 8 + 12 * len(rows), 3))
        rows.append((flags, off, size))
        if size:
            need(off >= 20 and off + size <= len(data))
            edge = min(edge, off)
    n = (edge - 8) // 12
    need(n > 0 and edge - 8 - 12 * n < 32 and any(r[2] for r in rows[:n]))
    return [Span(i, None, off, size, flags=flags) for i, (flags, off, size) in enumerate(rows[:n])]


def index_lay(data, spans, new):
    """A body that fits stays in its place, zero-filled; a greater one goes to the end."""
    for i in sorted(new):
        b, s = new[i][0], spans[i]
        at = s.off if len(b) <= s.size else len(aligned(data))
        body = b.ljust(s.size, b"\0") if at == s.off else b
        data = patched(aligned(data) if at != s.off else data, {at: body, 8 + 12 * i: u32(s.flags, at, len(b))})
    return data


#: The type words that sibling packs' names differ by.
PACK_TYPES = ("ncgr", "nclr", "nscr", "ncer", "nanr", "ncg", "ncl", "nsc", "nce", "nan")


def named_blocks_read(data: bytes) -> list[Span]:
    need(len(data) >= 32 and not any(data[:4]))
    n, edge = (int(x) for x in words(data, 4, 2, ">u4"))
    need(0 < n <= 20000 and 16 < edge < len(data))
    labels, sizes, at = [], [], 16
    for _ in range(n):
        need(at < edge)
        label = data[at + 1 : at + 1 + data[at]]
        need(re.fullmatch(rb"[ -~]+", label))
        at += 1 + len(label)
        sizes.append(int(words(data, at, 1, ">u4")[0]))
        labels.append(label.decode("ascii"))
        at += 4
    ends = at + np.cumsum(sizes)
    need(at - 4 == edge and ends[-1] == len(data))
    how, full = zip(*(block_codec(data[e - s : e]) for e, s in zip(ends, sizes, strict=True)), strict=True)
    return table(ends - sizes, sizes, labels, how=how, full=full)


def block_codec(block: bytes) -> tuple[str, int]:
    """A block is zlib only if its stream gives the size before it and leaves nothing but zeros."""
    if len(block) > 6 and block[4] == 0x78:
        z = zlib.decompressobj()
        try:
            n = len(z.decompress(block[4:]))
        except zlib.error:
            n = -1
        if n == int.from_bytes(block[:4], "little") and not any(z.unused_data):
            return "zlib", n
    return "stored", len(block)


def named_blocks_lay(data, spans, new):
    bodies = stored(data, spans, new)
    grown = sum(max(0, -(-(full - spans[i].full) // 512) * 512) for i, (_, full) in new.items())
    rows = b"".join(bytes([len(s.name)]) + s.name.encode("ascii") + len(b).to_bytes(4, "big") for s, b in zip(spans, bodies, strict=True))
    work = int.from_bytes(data[12:16], "big") + grown
    return data[:8] + (12 + len(rows)).to_bytes(4, "big") + work.to_bytes(4, "big") + rows + b"".join(bodies)


#: Most padding between two streams of a chain.
CHAIN_PAD = 16


def chain_read(data: bytes) -> list[Span]:
    need(data[:1] in (b"\x10", b"\x11"))
    out, at = [], 0
    while at < len(data):
        pad = re.compile(rb"[\0\xff]{0,%d}" % CHAIN_PAD).match(data, at)
        at = pad.end()
        if not data[at:].strip(b"\0\xff"):
            break
        need(data[at] in (0x10, 0x11))
        try:
            raw, used = bios.lz_decode(data[at:])
        except bios.CodecError:
            raise Refused from None
        need(used > 4)
        out.append(Span(len(out), None, at, used, "lz10 stream" if data[at] == 0x10 else "lz11 stream", len(raw)))
        at += used
    need(len(out) >= 2)
    return out


#: Those with a magic first, then the stricter layouts before the looser ones.
KINDS = {
    k.name: k
    for k in (
        Kind("narc", b"NARC", narc_read, narc_lay),
        Kind("ccb", b"CCB ", ccb_read, ccb_lay),
        Kind("ntrp", b"NTRP", ntrp_read, ntrp_lay),
        Kind("zip", b"PK\3\4", zip_read, zip_lay),
        Kind("nitrofs", b"", nitrofs_read, nitrofs_lay),
        Kind("cingpack", b"", named_blocks_read, named_blocks_lay),
        Kind("indexpack", b"", index_read, index_lay),
        Kind("offset_archive", b"", offsets_read, offsets_lay),
        Kind("pair_table", b"", pairs_read, pairs_lay),
        Kind("lzchain", b"", chain_read, None),
        Kind("member_table", b"", implicit_read, implicit_lay),
    )
}


def detect(data: bytes) -> tuple[str, list[Span]] | None:
    for kind in KINDS.values():
        found = kind.spans(data)
        if found:
            return kind.name, found
    return None


def decode(how: str, raw: bytes, full: int) -> bytes:
    """A member's payload from its stored bytes."""
    if how == "zlib":
        return zlib.decompress(raw[4:])
    if how == "deflate":
        return zlib.decompress(raw, -15)
    if how.endswith(" stream"):
        return bios.lz_decode(raw)[0]
    if how == "stored" or not full:
        return raw
    code, run, _ = bios.CODECS[how]
    return run(bytes([code]) + full.to_bytes(3, "little") + raw)[0]


def encode(how: str, payload: bytes) -> bytes:
    if how == "zlib":
        return u32(len(payload)) + zlib.compress(payload, 9)
    if how == "deflate":
        z = zlib.compressobj(9, wbits=-15)
        return z.compress(payload) + z.flush()
    return payload if how == "stored" or not payload else bios.CODECS[how][2](payload)[4:]


def pack(name: str, data: bytes, changes: dict[int, bytes]) -> bytes:
    """The archive with the payloads of `changes` (by ordinal) put in; members not named keep their stored bytes."""
    kind = KINDS[name]
    spans = kind.spans(data)
    if spans is None or kind.lay is None or not all(0 <= i < len(spans) for i in changes):
        raise Refused(f"no {name} archive that can be written, or no such member")
    return kind.lay(data, spans, {i: (encode(spans[i].how, b), len(b)) for i, b in changes.items()})
