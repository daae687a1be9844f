"""Locators: the bytes at the end of a way into a file, and a file written again from edits at the ends of many ways.

A way is a tuple of steps. `narc:3` (or any archive's name) is a member, `codec:lz11` takes a codec off, `slice:off:size` and
`carve:off` are files inside others, `lz:off:codec:length` a packed stream inside others, `blz` program code packed from its
end, `srl:path` a file of an image inside a file, `banner` an image's banner, `cpk:off:length:full` a packed file of a
packet archive. Edits are put in from the inside out by recursion: a parent is written once, from all its changed children.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.codecs import bios, studio
from glyphmill.codecs.bios import CodecError
from glyphmill.containers import archives as A
from glyphmill.containers import tables as T
from glyphmill.formats import nitro

from .cartridge import BANNER_AT, BANNER_SIZES, Cartridge, words

Way = tuple[str, ...]


class EditError(ValueError):
    """An edit that can't be written, with the reason; nothing is written then."""


def argument(step: str) -> tuple[str, list[str]]:
    kind, *rest = step.split(":")
    return kind, rest


def region(data: bytes) -> tuple[int, int]:
    """Where an image's banner lies, and its size."""
    at = int(words(data, BANNER_AT, 1)[0])
    return at, BANNER_SIZES.get(int(words(data, at, 1, "<u2")[0]), BANNER_SIZES[1])


def child(data: bytes, step: str) -> bytes:
    """The bytes one step further in."""
    kind, a = argument(step)
    try:
        if kind == "codec":
            return studio.CODECS[a[0]][0](data)[0]
        if kind == "blz":
            return studio.backward_decode(data)[0]
        if kind == "slice":
            return data[int(a[0]) : int(a[0]) + int(a[1])]
        if kind == "carve":
            h = nitro.header(data, int(a[0]))
            A.need(h)
            return data[int(a[0]) : int(a[0]) + h.size]
        if kind == "lz":
            return studio.CODECS[a[1]][0](data[int(a[0]) : int(a[0]) + int(a[2])])[0]
        if kind == "cpk":
            out = studio.layla_decode(data[int(a[0]) : int(a[0]) + int(a[1])])[0]
            A.need(len(out) == int(a[2]))
            return out
        if kind == "srl":
            return Cartridge(data).read(":".join(a))
        if kind == "banner":
            at, n = region(data)
            return data[at : at + n]
        spans = A.KINDS[kind].spans(data)
        A.need(spans is not None and int(a[0]) < len(spans))
        s = spans[int(a[0])]
        return A.decode(s.how, data[s.off : s.off + s.size], s.full)
    except (ValueError, KeyError, IndexError, StopIteration, A.zlib.error) as e:
        raise EditError(f"no {step}: {e}") from None


def resolve(data: bytes, way: Way) -> bytes:
    for step in way:
        data = child(data, step)
    return data


def rewritten(data: bytes, edits: dict[Way, bytes], whole: bool = True) -> bytes:
    """`data` with all edits put in. whole: whether the data are a file of their own, which may grow."""
    if () in edits:
        data, edits = edits[()], {w: b for w, b in edits.items() if w}
    inner: dict[str, dict[Way, bytes]] = {}
    for way, body in edits.items():
        inner.setdefault(way[0], {})[way[1:]] = body
    if not inner:
        return data
    new = {step: rewritten(child(data, step), own, False) for step, own in inner.items()}
    kinds = {argument(s)[0] for s in new}
    if kinds & {"codec", "blz"} and len(new) > 1 or len(kinds) > 1 and not kinds <= {"slice", "carve", "lz", "cpk"} and not kinds <= {"srl", "banner"}:
        raise EditError(f"steps of different kinds: {sorted(kinds)}")
    kind = kinds.pop()
    try:
        if kind == "codec":
            (step, body), = new.items()
            return packed(argument(step)[1][0], body, data)
        if kind == "blz":
            return studio.backward_encode(*new.values())
        if kind in ("srl", "banner"):
            files = {":".join(argument(s)[1]): b for s, b in new.items() if s != "banner"}
            return Cartridge(data).rebuild(files, new.get("banner"))
        if kind in A.KINDS:
            return A.pack(kind, data, {int(argument(s)[1][0]): b for s, b in new.items()})
    except (CodecError, A.Refused) as e:
        raise EditError(str(e)) from None
    table = None
    # the last place first: what comes before keeps its place
    for step, body in sorted(new.items(), key=lambda x: -int(argument(x[0])[1][0])):
        kind, a = argument(step)
        at = int(a[0])
        old = int(a[2]) if kind == "lz" else len(child(data, step)) if kind == "carve" else int(a[1])
        if kind in ("slice", "carve"):
            if len(body) != old:
                raise EditError(f"{step}: {old} bytes are now {len(body)}, and nothing says how to move what follows")
            data = data[:at] + body + data[at + old :]
        elif kind == "lz":
            out = packed(a[1], body, data[at : at + old], pad=False)
            if whole and at == 0 and not data[old:].strip(b"\0\xff"):
                return out + bytes(-len(out) % 4)
            if len(out) > old:
                table = table or T.offset_table(data, spans_of(data, new))
                if table is None or at not in table.sizes:
                    raise EditError(f"{step}: {len(out)} bytes for {old}, and no table of offsets")
                data = T.grown(data, table, at, old, out)
            else:
                data = data[:at] + out.ljust(old, b"\0") + data[at + old :]
        elif kind == "cpk":
            out = studio.layla_encode(body, data[at : at + 8])
            if len(out) > old:
                more = T.cpk_grow(data, at, len(out)) if data[:4] == b"CPK " else None
                if more is None:
                    raise EditError(f"{step}: {len(out)} bytes for {old}")
                data = more[:at] + out + more[at + len(out) :]
            else:  # unread bytes before the stream fill the room
                spare = old - len(out)
                size = int.from_bytes(out[12:16], "little") + spare
                out = out[:12] + size.to_bytes(4, "little") + bytes(spare) + out[16:]
                data = data[:at] + out + data[at + old :]
        else:
            raise EditError(f"nothing writes {step}")
    return data


def spans_of(data: bytes, new: dict) -> list[tuple[int, int]]:
    """All files and streams that are found in the container, with those that are edited."""
    found = {(at, size) for at, size, _ in nitro.carve(data)}
    for at, name, _, _ in nitro.carve_packed(data):
        try:
            found.add((at, bios.CODECS[name][1](data[at:])[1]))
        except CodecError:
            continue
    for step in new:
        kind, a = argument(step)
        if kind == "lz":
            found = {(p, n) for p, n in found if p != int(a[0])} | {(int(a[0]), int(a[2]))}
    return sorted(found)


def packed(codec: str, body: bytes, before: bytes, pad: bool = True) -> bytes:
    """The body under its codec again: the same type, and the same small choices as the stream that it replaces."""
    if codec == "at6p":
        return studio.delta_encode(body, before[4])
    if codec == "bitlz":
        return studio.bit_encode(body, before[0])
    out = studio.CODECS[codec][1](body)
    if not pad and codec in ("lz10", "lz11", "lz40", "lz60"):
        used = studio.CODECS[codec][0](out)[1]
        return out[:used]
    return out


def edited(files: DataFrame, edits: DataFrame) -> DataFrame:
    """files (path, content) with edits (path, loc array<string>, payload) put in, and `error`, which says why a file keeps its bytes.

    The edits of one file come together in one row, no more than the file; files without edits never reach Python.
    """

    def one(data, steps, bodies):
        if data is None:
            return None
        try:
            return rewritten(bytes(data), {tuple(s): bytes(b) for s, b in zip(steps, bodies, strict=True)}), None
        except ValueError as e:
            return None, str(e) or type(e).__name__

    run = F.udf(one, "struct<data:binary,error:string>", useArrow=True)
    all_ = edits.groupBy("path").agg(F.collect_list("loc").alias("__steps"), F.collect_list("payload").alias("__bodies"))
    both = files.join(all_, "path", "left")
    both = both.withColumn("__new", F.when(F.col("__steps").isNotNull(), run(F.when(F.col("__steps").isNotNull(), F.col("content")), "__steps", "__bodies")))
    return both.select("path", F.coalesce("__new.data", "content").alias("content"), F.col("__new.error").alias("error"))


def all_resolved(data: bytes, ways: list[Way]) -> list[tuple[bytes | None, str | None]]:
    """The ends of many ways into one file, with what they share opened once; or why there is none."""
    opened: dict[Way, bytes] = {(): data}

    def at(way: Way) -> bytes:
        if way not in opened:
            opened[way] = child(at(way[:-1]), way[-1])
        return opened[way]

    out: list = []
    for way in ways:
        try:
            out.append((at(way), None))
        except EditError as e:
            out.append((None, str(e)))
    return out


def contents(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (path, loc, ...) with the payload at the end of each way, and why there is none. A file's bytes go to Python once, with all its ways."""
    run = F.udf(lambda data, ways: None if data is None else all_resolved(bytes(data), [tuple(w) for w in ways]), "array<struct<payload:binary,error:string>>", useArrow=True)
    ways = wanted.select("path", "loc").distinct().groupBy("path").agg(F.collect_list("loc").alias("__ways"))
    both = ways.join(files.select("path", "content"), "path").withColumn("__got", run("content", "__ways"))
    each = both.select("path", F.explode(F.arrays_zip("__ways", "__got")).alias("__e")).select("path", F.col("__e.__ways").alias("loc"), F.col("__e.__got.payload").alias("payload"), F.col("__e.__got.error").alias("error"))
    return wanted.join(each, ["path", "loc"]).select(*wanted.columns, "payload", "error")
