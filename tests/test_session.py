import struct

import pytest

from glyphmill.codecs import bios, studio
from glyphmill.containers import build as B
from glyphmill.containers import tables as T
from glyphmill.sources import session as S
from glyphmill.sources.cartridge import Cartridge


def nested():
    inner = B.narc([(f"{i}.bin", f"member {i} ".encode() * 9) for i in range(5)])
    return B.narc([("a.l", studio.lz_encode_best(inner)), ("b.bin", b"plain"), ("c.arc", studio.huff_encode(B.ntrp([("x", b"one" * 20), ("y", b"two" * 20)])))])


def test_ways_in_and_edits():
    data = nested()
    way = ("narc:0", "codec:lz10", "narc:3")
    assert S.resolve(data, way) == b"member 3 " * 9
    assert S.rewritten(data, {}) == data
    edits = {way: b"grown " * 99, ("narc:0", "codec:lz10", "narc:1"): b"", ("narc:1",): b"other", ("narc:2", "codec:huff8", "ntrp:1"): b"2" * 500}
    new = S.rewritten(data, edits)
    for w, body in edits.items():
        assert S.resolve(new, w) == body
    assert S.resolve(new, ("narc:0", "codec:lz10", "narc:4")) == b"member 4 " * 9 and S.resolve(new, ("narc:2", "codec:huff8", "ntrp:0")) == b"one" * 20
    for bad in (("narc:9",), ("codec:rle",), ("slice:x:1",), ("nothing:1",)):
        with pytest.raises(S.EditError):
            S.resolve(data, bad)
    with pytest.raises(S.EditError):
        S.rewritten(data, {("narc:1",): b"", ("ntrp:0",): b""})


def test_slots_tables_and_code():
    body = b"text that repeats, " * 40
    packed = bios.lz_encode(body)
    # a stream that is all of its file may grow, one in a slot only as far as that
    whole = S.rewritten(packed + bytes(3), {(f"lz:0:lz10:{len(packed)}",): bytes(range(256)) * 4})
    assert bios.lz_decode(whole)[0] == bytes(range(256)) * 4
    held = b"head" + packed + b"tail"
    way = (f"lz:4:lz10:{len(packed)}",)
    assert S.resolve(S.rewritten(held, {way: b"x" * 700}), way) == b"x" * 700 and S.rewritten(held, {way: b"x" * 700}).endswith(b"tail")
    with pytest.raises(S.EditError):
        S.rewritten(held, {way: bytes(range(256)) * 4})
    # a table of offsets in front lets it grow
    streams = [bios.lz_encode(b"%d, " % k * 60) for k in range(4)]
    streams = [s + bytes(-len(s) % 4) for s in streams]
    at, head = 36, []
    for s in streams:
        head += [at, len(s)]
        at += len(s)
    data = struct.pack("<I", at) + struct.pack("<8I", *head) + b"".join(streams)
    spans = [tuple(head[2 * k : 2 * k + 2]) for k in range(4)]
    assert T.offset_table(data, spans)
    ways = [(f"lz:{o}:lz10:{n}",) for o, n in spans]
    new = S.rewritten(data, {ways[1]: bytes(range(200)), **{w: b"%d, " % k * 60 for k, w in enumerate(ways) if k != 1}})
    o, n = struct.unpack_from("<II", new, 4 + 8)
    assert bios.lz_decode(new[o : o + n])[0] == bytes(range(200)) and struct.unpack_from("<I", new)[0] == len(new)
    o, n = struct.unpack_from("<II", new, 4 + 24)
    assert bios.lz_decode(new[o : o + n])[0] == b"3, " * 60
    with pytest.raises(S.EditError):
        S.rewritten(b"abcdef", {("slice:1:2",): b"xyz"})
    assert S.rewritten(b"abcdef", {("slice:1:2",): b"XY", ("slice:4:1",): b"E"}) == b"aXYdEf"
    code = studio.backward_encode(body)
    assert S.resolve(S.rewritten(code, {("blz",): body + b"more"}), ("blz",)) == body + b"more"
    plain = bytes(256) + body
    layla = studio.layla_encode(plain)
    archive = T.cpk([layla, b"next"], 512)
    e = T.cpk_entries(archive)[0]
    way = (f"cpk:{e.off}:{e.size}:{len(plain)}",)
    assert S.resolve(archive, way) == plain
    less = S.rewritten(archive, {way: bytes(256) + body[:-100] + b"z" * 100})
    assert S.resolve(less, (f"cpk:{e.off}:{T.cpk_entries(less)[0].size}:{len(plain)}",)) == bytes(256) + body[:-100] + b"z" * 100


def test_images_inside(spark):
    banner = B.banner(bytes(512), [0] * 16, ["t"] * 6)
    inner = B.cartridge("IN", "AAAA", [("d/x.bin", b"inside")], banner=banner)
    outer = B.cartridge("OUT", "BBBB", [("data.srl", inner), ("y.bin", b"y")], banner=banner)
    image = Cartridge(S.rewritten(outer, {("srl:data.srl", "srl:d/x.bin"): b"changed inside"}))
    assert S.resolve(image.data, ("srl:data.srl", "srl:d/x.bin")) == b"changed inside" and image.read("y.bin") == b"y"
    new = banner[:0x240] + b"T\0" + banner[0x242:]
    assert S.resolve(S.rewritten(outer, {("banner",): new}), ("banner",)) == new
    files = spark.createDataFrame([("f", bytearray(nested())), ("g", bytearray(b"untouched")), ("h", bytearray(b"bad"))], "path string, content binary")
    edits = spark.createDataFrame([("f", ["narc:1"], bytearray(b"new")), ("f", ["narc:0", "codec:lz10", "narc:2"], bytearray(b"two")), ("h", ["narc:0"], bytearray(b""))], "path string, loc array<string>, payload binary")
    out = {r.path: r for r in S.edited(files, edits).collect()}
    assert S.resolve(bytes(out["f"].content), ("narc:0", "codec:lz10", "narc:2")) == b"two" and bytes(out["g"].content) == b"untouched" and out["g"].error is None
    assert bytes(out["h"].content) == b"bad" and out["h"].error
    got = S.contents(files, edits.select("path", "loc")).collect()
    assert sorted((r.path, bytes(r.payload) if r.payload is not None else None) for r in got if r.path == "f") == [("f", b"member 2 " * 9), ("f", b"plain")] and all(r.error for r in got if r.path == "h")
