"""Tables that say where things are: typed row packets and their archives, name trees, offset tables of unknown containers."""

from __future__ import annotations

import struct
from collections import Counter
from dataclasses import dataclass

import numpy as np

from .archives import Refused, need

# --- typed rows ----------------------------------------------------------------------------

#: Column types and how they are stored.
TYPES = {0: ">B", 1: ">b", 2: ">H", 3: ">h", 4: ">I", 5: ">i", 6: ">Q", 7: ">q", 8: ">f", 10: ">I", 11: ">II"}
PER_ROW, CONSTANT = 0x50, (0x30, 0x70)
WRAPPERS = (b"CPK ", b"TOC ", b"ITOC", b"ETOC", b"GTOC")


def rows(data: bytes, at: int = 0) -> tuple[list[dict], list[dict]]:
    """The rows of a packet as dicts (binary values as absolute (offset, size)), and where each row's own values are stored."""
    at += 16 if data[at : at + 4] in WRAPPERS else 0
    need(data[at : at + 4] == b"@UTF" and len(data) >= at + 32)
    base = at + 8
    first, strings, blobs, _, columns, wide, count = struct.unpack_from(">IIIIHHI", data, base)

    def text(o: int) -> str:
        o += base + strings
        return data[o : data.index(b"\0", o)].decode("utf-8", "replace")

    def value(kind: int, p: int):
        need(kind in TYPES and p + struct.calcsize(TYPES[kind]) <= len(data))
        v = struct.unpack_from(TYPES[kind], data, p)
        v = text(v[0]) if kind == 10 else (base + blobs + v[0], v[1]) if kind == 11 else v[0]
        return v, p + struct.calcsize(TYPES[kind])

    p, plan, fixed = base + 24, [], {}
    for _ in range(columns):
        flags, name = struct.unpack_from(">BI", data, p)
        p += 5
        label, kind, how = text(name), flags & 15, flags & 0xF0
        if how in CONSTANT:
            fixed[label], p = value(kind, p)
        elif how == PER_ROW:
            plan.append((label, kind))
        else:
            fixed[label] = None
    out, places = [], []
    for r in range(count):
        p, row, own = base + first + r * wide, dict(fixed), {}
        for label, kind in plan:
            own[label] = (p, kind)
            row[label], p = value(kind, p)
        out.append(row)
        places.append(own)
    return out, places


def packet(name: str, columns: list[tuple[str, int]], values: list[list]) -> bytes:
    """A packet whose columns are stored by row."""
    strings, blobs = bytearray(b"\0"), bytearray()

    def text(s: str) -> int:
        strings.extend(s.encode() + b"\0")
        return len(strings) - len(s.encode()) - 1

    title = text(name)
    head = b"".join(struct.pack(">BI", PER_ROW | kind, text(label)) for label, kind in columns)
    body = b""
    for row in values:
        for (_, kind), v in zip(columns, row, strict=True):
            if kind == 10:
                body += struct.pack(">I", text(v))
            elif kind == 11:
                body += struct.pack(">II", len(blobs), len(v))
                blobs.extend(v)
            else:
                body += struct.pack(TYPES[kind], v)
    first = 24 + len(head)
    at = first + len(body)
    size = sum(struct.calcsize(TYPES[k]) for _, k in columns)
    inner = struct.pack(">IIIIHHI", first, at, at + len(strings), title, len(columns), size, len(values)) + head + body + bytes(strings) + bytes(blobs)
    return b"@UTF" + struct.pack(">I", len(inner)) + inner


@dataclass(frozen=True)
class Entry:
    name: str
    off: int
    size: int
    full: int
    stored_at: tuple[int, int] | None


def cpk_entries(data: bytes) -> list[Entry]:
    """The files of an archive of packets, by its table of names or by that of ids, whose files are aligned one after another."""
    need(data[:4] == b"CPK ")
    try:
        head = rows(data, 16)[0][0]
        start = lambda f: (lambda v: v[0] if isinstance(v, tuple) else v)(head.get(f))
        content, toc, ids = head.get("ContentOffset") or 0, start("TocOffset"), start("ItocOffset")
        if toc:
            found, places = rows(data, toc)
            base = min(content or toc, toc)
            return [
                Entry("/".join(x for x in (r.get("DirName"), r.get("FileName") or "?") if x), o if o > (content or toc) else o + base, n, r.get("ExtractSize") or n, p.get("FileSize"))
                for r, p in zip(found, places, strict=True)
                if (o := r.get("FileOffset")) is not None and (n := r.get("FileSize")) is not None
            ]
        need(ids)
        align, sizes = head.get("Align") or 2048, {}
        top = rows(data, ids)[0][0]
        for part in ("DataL", "DataH"):
            if top.get(part) and top[part][1]:
                for r, p in zip(*rows(data, top[part][0]), strict=True):
                    sizes[r["ID"]] = (r["FileSize"], r.get("ExtractSize") or r["FileSize"], p.get("FileSize"))
        out, at = [], content
        for i in sorted(sizes):
            n, full, place = sizes[i]
            out.append(Entry(f"{i:08d}.bin", at, n, full, place))
            at += -(-n // align) * align
        return out
    except (struct.error, IndexError, ValueError, KeyError) as e:
        raise Refused(str(e)) from None


def cpk_grow(data: bytes, off: int, size: int) -> bytes | None:
    """The archive with room for `size` bytes at `off`, up to the next file, and its table saying so; None where they don't fit."""
    found = cpk_entries(data)
    one = next((e for e in found if e.off == off), None)
    if one is None or one.stored_at is None or one.stored_at[1] not in TYPES:
        return None
    limit = min([e.off for e in found if e.off > off] or [len(data)])
    fmt = TYPES[one.stored_at[1]]
    if off + size > max(limit, off + one.size if size <= one.size else 0) or size >= 1 << 8 * struct.calcsize(fmt):
        return None
    out = bytearray(data)
    struct.pack_into(fmt, out, one.stored_at[0], size)
    return bytes(out)


def cpk(bodies: list[bytes], align: int = 64) -> bytes:
    """An archive by ids: a header packet, a table of ids, aligned bodies."""
    sub = packet("CpkItocL", [("ID", 2), ("FileSize", 4), ("ExtractSize", 4)], [[i, len(b), len(b)] for i, b in enumerate(bodies)])
    table = b"ITOC" + struct.pack("<II", 0xFF, 0) + bytes(4) + packet("CpkItocInfo", [("DataL", 11)], [[sub]])
    columns = [("ContentOffset", 6), ("ItocOffset", 6), ("Align", 2)]
    size = 16 + len(packet("CpkHeader", columns, [[0, 0, align]]))
    content = -(-(size + len(table)) // align) * align
    out = b"CPK " + bytes(12) + packet("CpkHeader", columns, [[content, size, align]]) + table
    out = out.ljust(content, b"\0")
    for b in bodies:
        out += b.ljust(-(-len(b) // align) * align, b"\0")
    return out


# --- name trees ----------------------------------------------------------------------------

#: Extensions of kinds; those that may be any.
KIND_OF = {"nclr": "NCLR", "ncgr": "NCGR", "ncbr": "NCGR", "nscr": "NSCR", "ncer": "NCER", "nanr": "NANR", "nsbmd": "NSBMD", "nsbtx": "NSBTX", "nftr": "NFTR"}
ANY_KIND, DEEPEST = ("bin", ""), 32


def tree_names(data: bytes) -> list[str]:
    """Paths of a tree's leaves, depth first: a node is a count and entries (length, name, child's place or 0)."""
    out: list[str] = []

    def node(at: int, path: str, depth: int) -> None:
        need(depth <= DEEPEST and at + 2 <= len(data))
        p = at + 2
        for _ in range(int.from_bytes(data[at : at + 2], "little")):
            n = int.from_bytes(data[p : p + 2], "little")
            name = data[p + 2 : p + 2 + n]
            need(n and p + 6 + n <= len(data) and all(32 <= c < 127 for c in name))
            child = int.from_bytes(data[p + 2 + n : p + 6 + n], "little")
            p += 6 + n
            if child:
                need(at < child < len(data))
                node(child, f"{path}{name.decode()}/", depth + 1)
            else:
                out.append(path + name.decode())

    node(0, "", 0)
    need(out)
    return out


def tree(paths: list[str]) -> bytes:
    """A tree of the paths, folders in the order they come first."""
    top: dict = {}
    for p in paths:
        *folders, name = p.split("/")
        at = top
        for f in folders:
            at = at.setdefault(f, {})
        at[name] = None
    size = lambda folder: 2 + sum(6 + len(n.encode()) for n in folder)
    out, queue, free = b"", [top], size(top)
    for folder in queue:
        out += struct.pack("<H", len(folder))
        for name, child in folder.items():
            out += struct.pack("<H", len(name.encode())) + name.encode() + struct.pack("<I", free if child is not None else 0)
            if child is not None:
                queue.append(child)
                free += size(child)
    return out


def assigned(kinds: list[str], paths: list[str]) -> dict[int, str]:
    """item -> path: the longest run of equal kinds first, and so on beside it; between them, as many paths of any kind as items take their places."""
    from difflib import SequenceMatcher

    kind = lambda p: (lambda e: KIND_OF.get(e, "*" if e in ANY_KIND else None))(p.rsplit("/", 1)[-1].rpartition(".")[2].lower() if "." in p.rsplit("/", 1)[-1] else "")
    own = [(p, k) for p in paths if (k := kind(p))]
    out: dict[int, str] = {}
    for what, a, b, c, d in SequenceMatcher(None, [k for _, k in own], kinds, autojunk=False).get_opcodes():
        free = [p for p, k in own[a:b] if what == "equal" or k == "*"]
        if what == "equal" or what == "replace" and len(free) == d - c:
            out |= dict(zip(range(c, d), free, strict=True))
    return out


# --- offset tables -------------------------------------------------------------------------


@dataclass(frozen=True)
class OffsetTable:
    base: int
    stride: int
    cover: float
    offsets: tuple[int, ...]
    sizes: dict[int, tuple[int, bool]]
    totals: tuple[int, ...]


#: Bases that are tried, spans that vote for them, and the share of spans that a table must explain.
BASES, VOTERS, COVER = 6, 64, 0.8


def offset_table(data: bytes, spans: list[tuple[int, int]]) -> OffsetTable | None:
    """The table in front of the first of the spans (start, length) that holds their starts less a base, and their lengths beside them."""
    if len(spans) < 2:
        return None
    first = min(s for s, _ in spans)
    end = min(first, len(data)) // 4 * 4
    if end < 8:
        return None
    words = np.frombuffer(data, "<u4", end // 4).astype(np.int64)
    distinct = np.unique(words)
    votes: Counter = Counter()
    for s, _ in spans[:VOTERS]:
        votes.update(int(d) for d in s - distinct if 0 <= d <= end + 0x1000)
    where: dict[int, int] = {}
    for i, v in enumerate(words.tolist()):
        where.setdefault(v, 4 * i)
    best = None
    for base, _ in votes.most_common(BASES):
        at = {s: where[s - base] for s, _ in spans if s - base in where}
        if len(at) / len(spans) >= COVER and (best is None or len(at) > len(best[1])):
            best = base, at
    if best is None:
        return None
    base, at = best
    sizes = {}
    for s, n in spans:
        for step in (4, 8, -4) if s in at else ():
            q = at[s] + step
            if 0 <= q < end and words[q // 4] in (n, n + 3 & ~3):
                sizes[s] = (q, bool(words[q // 4] == n))
                break
    marks = sorted(at.values())
    steps = Counter(b - a for a, b in zip(marks, marks[1:], strict=False))
    stride = steps.most_common(1)[0][0] if steps else 4
    near = [p for p in range(marks[0] % stride if stride else marks[0], end - 3, stride or 4) if marks[0] - 4 * stride <= p <= marks[-1] + 64 * stride and first <= words[p // 4] + base <= len(data)]
    return OffsetTable(base, stride, round(len(at) / len(spans), 3), tuple(sorted({*near, *marks})), sizes, tuple(4 * i for i in np.flatnonzero(words == len(data)).tolist()))


def grown(data: bytes, table: OffsetTable, start: int, old: int, new: bytes, align: int = 4) -> bytes:
    """The container with `new` in the place of the `old` bytes at start: what follows moves by whole `align` bytes, and the table says so."""
    more = -(-(len(new) - old) // align) * align
    out = bytearray(data[:start] + new + bytes(old + more - len(new)) + data[start + old :])
    put = lambda p, v: struct.pack_into("<I", out, p, v)
    for p in table.offsets:
        v = int.from_bytes(out[p : p + 4], "little")
        if v + table.base > start:
            put(p, v + more)
    if start in table.sizes:
        p, exact = table.sizes[start]
        put(p, len(new) if exact else len(new) + 3 & ~3)
    for p in table.totals:
        put(p, len(out))
    return bytes(out)
