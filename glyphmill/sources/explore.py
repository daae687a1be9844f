"""From files to graphics items: codecs taken off, archives opened, the rest carved; one pass, each file by itself."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from glyphmill.codecs import bios, studio
from glyphmill.codecs.bios import CodecError
from glyphmill.containers import archives as A
from glyphmill.formats import nitro

#: Archives inside archives are opened to this depth; deeper ones are items themselves.
DEEPEST = 3
#: A stream may not claim to be more than this many times its length (and 64 bytes in any case).
RATIO = 64
ITEMS = "path string, pos int, item string, loc array<string>, kind string, size bigint, content binary, error string"
#: Items leave in batches of at most this many rows or bytes, one item at least.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


#: Codecs with a header of their own that are tried on files and members, and how many bytes may follow their streams.
STUDIO = ("lze", "at6p", "bitlz", "lz40", "lz60", "aklz", "lz10_hdr", "lz10_solcomp")
SPARE = {"lze": 5, "at6p": 1, "bitlz": 4, "lz40": 4, "lz60": 4, "aklz": 8, "lz10_hdr": 4, "lz10_solcomp": 4}


def unwrap(data: bytes) -> tuple[bytes, str | None]:
    """The payload and its codec, or the data itself: the size must be right, and what follows an LZ10 stream padding."""
    for name, (first, decode) in bios.READERS.items():
        if data[:1] != bytes([first]):
            continue
        try:
            _, size, at = bios.header(data, (first,))
            if not 0 < size <= max(64, RATIO * len(data)) or name.startswith("diff") and -(-len(data) // 4) != -(-(at + size) // 4):
                return data, None
            out, used = decode(data)
        except bios.CodecError:
            return data, None
        rest = data[used:]
        if len(out) != size or name == "lz10" and len(rest) > 16 and rest.strip(b"\0\xff"):
            return data, None
        return out, name
    for name in STUDIO:
        try:
            out, used = studio.CODECS[name][0](data)
        except (CodecError, IndexError):
            continue
        if 0 <= len(data) - used < SPARE[name] and 16 <= len(out) <= max(64, RATIO * len(data)):
            return out, name
    return data, None


def walk(data: bytes, item: str, loc: tuple[str, ...] = (), depth: int = 0) -> Iterator[tuple[str, tuple[str, ...], str | None, bytes]]:
    """(item, locator, kind, content) of everything inside; kind is None for what nothing knows."""
    chain = A.KINDS["lzchain"].spans(data) if depth < 2 else None
    if chain:
        for s in chain:
            yield from walk(A.decode(s.how, data[s.off : s.off + s.size], s.full), f"{item}/{s.ordinal:04d}", (*loc, f"lzchain:{s.ordinal}"), depth + 1)
        return
    data, codec = unwrap(data)
    if codec:
        loc = (*loc, f"codec:{codec}")
        # a difference filter may stand under a codec; only that pair is followed
        inner, under = unwrap(data) if data[:1] in (b"\x81", b"\x82") else (data, None)
        if under:
            data, loc = inner, (*loc, f"codec:{under}")
    h = nitro.header(data)
    found = None if depth >= DEEPEST or h and h.kind != "NARC" else A.detect(data)
    if found and (A.KINDS[found[0]].magic or depth == 0 and not codec or found[0] in ("nitrofs", "cingpack", "pair_table")):
        for s in found[1]:
            try:
                body = A.decode(s.how, data[s.off : s.off + s.size], s.full)
            except (ValueError, A.zlib.error):
                continue
            if body:
                yield from walk(body, f"{item}/{s.name or f'{s.ordinal:04d}'}", (*loc, f"{found[0]}:{s.ordinal}"), depth + 1)
    elif h:
        yield item, loc, h.kind, data
    else:
        hits = [(at, size, kind) for at, size, kind in nitro.carve(data)]
        for at, size, kind in hits:
            yield f"{item}@{at:x}", (*loc, f"carve:{at}"), kind, data[at : at + size]
        for at, name, _, kind in nitro.carve_packed(data):
            if not any(o <= at < o + n for o, n, _ in hits):
                try:
                    body = bios.CODECS[name][1](data[at:])[0]
                except bios.CodecError:
                    continue
                hits.append((at, 0, kind))
                yield f"{item}@{at:x}", (*loc, f"{name}:{at}"), kind, body
        if not hits:
            yield item, loc, None, data


def explore(files: DataFrame) -> DataFrame:
    """(path, pos, item, loc, kind, size, content, error) for files of (path, content); pos numbers a file's items in their order.

    Null and empty contents give no rows. A file that breaks a parser gives one row with its error; others go on.
    No shuffle: a file is explored where it is read, its items leave in batches.
    """
    names = [c.split()[0] for c in ITEMS.split(", ")]

    def items(batches):
        for batch in batches:
            for path, data in zip(batch["path"], batch["content"], strict=True):
                if data is None or not len(data):
                    continue
                pos = 0
                try:
                    for pos, (item, loc, kind, body) in enumerate(walk(bytes(data), path or "")):
                        yield path, pos, item, list(loc), kind, len(body), body, None
                except Exception as e:  # one bad file must not end the scan; the row says which and why
                    yield path, pos + 1, None, None, None, len(data), None, f"{type(e).__name__}: {e}"

    def run(batches):
        held, size = [], 0
        for row in items(batches):
            held.append(row)
            size += len(row[6] or b"")
            if len(held) >= BATCH_ROWS or size >= BATCH_BYTES:
                yield pd.DataFrame(held, columns=names)
                held, size = [], 0
        if held:
            yield pd.DataFrame(held, columns=names)

    return files.select("path", "content").mapInPandas(run, ITEMS)
