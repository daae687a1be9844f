import io
import struct
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from glyphmill.codecs import bios
from glyphmill.containers import archives as A
from glyphmill.containers import frames
from glyphmill.formats import nitro
from glyphmill.sources import cartridge as C
from glyphmill.sources import explore as E


def fnt(*labels):
    return struct.pack("<IHH", 8, 0, 1) + b"".join(bytes([len(x)]) + x for x in labels) + b"\0"


def palette(n=16):
    body = b"TTLP" + struct.pack("<II", 24 + 2 * n, 3) + bytes(8) + bytes(range(2 * n)) + bytes(4)
    return b"RLCN\xff\xfe\x00\x01" + struct.pack("<IHH", 16 + len(body), 16, 1) + body


def narc(bodies=(b"abcd", b"", b"xyz"), labels=(b"a.bin", b"b.bin", b"c.bin")):
    table = fnt(*labels)
    table += b"\xff" * (-len(table) % 4)
    name = b"BTNF" + struct.pack("<I", 8 + len(table)) + table
    fat, body = b"", b""
    for b in bodies:
        fat += struct.pack("<II", len(body), len(body) + len(b))
        body += b + b"\xff" * (-len(b) % 4)
    rest = b"BTAF" + struct.pack("<II", 12 + len(fat), len(bodies)) + fat + name + b"GMIF" + struct.pack("<I", 8 + len(body)) + body
    return b"NARC\xfe\xff\x00\x01" + struct.pack("<IHH", 16 + len(rest), 16, 3) + rest


def nitrofs():
    table, bodies = fnt(b"a.ncg.l", b"b.ncl.l"), (b"\1" * 10, b"\2" * 32)
    fat = 16 + len(table)
    at = fat + 16 + (-(fat + 16) % 4)
    head = struct.pack("<4I", 16, len(table), fat, 16) + table + struct.pack("<4I", at, at + 10, at + 12, at + 44)
    return head.ljust(at, b"\xff") + bodies[0] + b"\xff\xff" + bodies[1]


def ccb():
    packed = bios.lz_encode(b"hello " * 20)[4:]
    rows = b"one".ljust(24, b"\0") + struct.pack("<II", 7 | len(packed) << 8, 0x10 | 120 << 8) + b"two".ljust(24, b"\0") + struct.pack("<II", 3 << 8, 3 << 8)
    return b"CCB \0\1" + struct.pack("<H", 2) + rows + packed + b"raw"


def zipped():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(zipfile.ZipInfo("d/"), b"")
        z.writestr(zipfile.ZipInfo("d/s"), b"stored")
        info = zipfile.ZipInfo("d/z")
        info.compress_type = zipfile.ZIP_DEFLATED
        z.writestr(info, b"deflated " * 30, compresslevel=9)
    return out.getvalue()


def cing():
    z = struct.pack("<I", 300) + zlib.compress(b"abc" * 100, 9)
    rows = b"\5a.txt" + struct.pack(">I", len(z)) + b"\5b.bra" + struct.pack(">I", 4)
    return bytes(4) + struct.pack(">III", 2, 12 + len(rows), 0x1000) + rows + z + b"rawb"


SAMPLES = {
    "narc": (narc(), [b"abcd", b"", b"xyz"]),
    "nitrofs": (nitrofs(), [b"\1" * 10, b"\2" * 32]),
    "ccb": (ccb(), [b"hello " * 20, b"raw"]),
    "zip": (zipped(), [b"stored", b"deflated " * 30]),
    "cingpack": (cing(), [b"abc" * 100, b"rawb"]),
    "ntrp": (b"NTRP\4\4\4\0" + struct.pack("<7I", 0, 36, 4, 40, 6, 0, 0) + b"mem1member", [b"mem1", b"member"]),
    "indexpack": (bytes(8) + struct.pack("<9I", 1, 52, 4, 0, 0, 0, 2, 56, 4) + bytes(8) + b"bodytail", [b"body", b"", b"tail"]),
    "offset_archive": (struct.pack("<5I", 3, 20, 0, 24, 30) + b"fourfive56", [b"four", b"", b"five56"]),
    "pair_table": (struct.pack("<5I", 2, 20, 32, 52, 64) + b"\1" * 32 + b"\2" * 64, [b"\1" * 32, b"\2" * 64]),
    "lzchain": (bios.lz_encode(b"hello world" * 20).ljust(32, b"\0") + bios.lz_encode(b"\5" * 300), [b"hello world" * 20, b"\5" * 300]),
    "member_table": (struct.pack("<3I", 12, 15, 15) + b"abcdefg", [b"abc", b"", b"defg"]),
}


def payloads(name, data):
    return [A.decode(s.how, data[s.off : s.off + s.size], s.full) for s in A.KINDS[name].spans(data)]


@pytest.mark.parametrize("name", SAMPLES)
def test_read_and_rewrite(name):
    data, expected = SAMPLES[name]
    assert A.detect(data)[0] == name and payloads(name, data) == expected
    if name == "lzchain":
        with pytest.raises(A.Refused):
            A.pack(name, data, {})
        return
    assert A.pack(name, data, {}) == data
    for new in (b"grown " * 30, b"s"):
        last = len(expected) - 1
        first = expected[0] if name == "indexpack" else new  # a table whose first body moves no longer shows where it ends
        made = A.pack(name, data, {last: new * 2} if name == "indexpack" else {0: new, last: new * 2})
        assert payloads(name, made) == [first, *expected[1:-1], new * 2]
    with pytest.raises(A.Refused):
        A.pack(name, data, {99: b""})


def test_names_and_refusals():
    assert [s.name for s in A.KINDS["narc"].spans(narc())] == ["a.bin", "b.bin", "c.bin"]
    assert [s.name for s in A.KINDS["nitrofs"].spans(nitrofs())] == ["a.ncg.l", "b.ncl.l"]
    junk = [b"", b"NARC", bytes(range(256)) * 4, b"\3\0\0\0" + bytes(8), struct.pack("<5I", 2, 20, 64, 52, 64) + bytes(96), bios.lz_encode(b"x" * 50), bytes(100)]
    assert [A.detect(j) for j in junk] == [None] * len(junk)
    for data, _ in SAMPLES.values():
        for cut in range(0, len(data), 3):
            A.detect(data[:cut])
    assert A.path_hash("//Data/a//b.BIN") == A.path_hash("data\\a\\b.bin") and A.path_hash("") == 0


def test_members_and_repack(spark):
    rows = [(n, bytearray(d)) for n, (d, _) in SAMPLES.items()] + [("junk", bytearray(b"nothing here")), ("empty", bytearray()), ("null", None)]
    df = spark.createDataFrame(rows, "id string, content binary")
    got = frames.members(df, "id").collect()
    assert {(r.id, r.container, r.ordinal, bytes(r.payload)) for r in got} == {(n, n, i, b) for n, (_, bodies) in SAMPLES.items() for i, b in enumerate(bodies)}
    assert frames.members(df, "id", kind="narc").count() == 3 and frames.members(df.limit(0), "id").count() == 0
    changes = spark.createDataFrame([("narc", 1, bytearray(b"new")), ("ccb", 0, bytearray(b"q" * 99)), ("junk", 0, bytearray(b"x")), ("narc", 9, bytearray(b"x")), ("lzchain", 0, bytearray(b"x"))], "id string, ordinal int, payload binary")
    out = {r.id: r for r in frames.repack(df, changes.where("ordinal < 9"), "id").collect()}
    assert payloads("narc", bytes(out["narc"].content)) == [b"abcd", b"new", b"xyz"] and payloads("ccb", bytes(out["ccb"].content)) == [b"q" * 99, b"raw"]
    assert bytes(out["zip"].content) == zipped() and out["junk"].error == "no archive" and bytes(out["junk"].content) == b"nothing here" and out["lzchain"].error
    assert out["null"].content is None and len(out) == len(rows)


def test_pack_group(spark):
    paths = {"data/ncgpack.dat": "data/pack", "NCLR.bin": "pack", "a/b/xNscrNcg.z": "a/b/xNcg", "a/plain.dat": "a/plain", "ncg/file": "ncg/file"}
    df = spark.createDataFrame([(k,) for k in paths], "p string")
    assert {r.p: r.g for r in df.select("p", frames.pack_group(F.col("p")).alias("g")).collect()} == paths


def image():
    table = fnt(b"x.bin")
    d = bytearray(b"\xff" * 0x4000)
    d[0:0x200] = bytes(0x200)
    d[0:16] = b"SAMPLE".ljust(12, b"\0") + b"ABCD"
    d[0x40:0x50] = struct.pack("<4I", 0x200, len(table), 0x220, 8)
    d[0x68:0x6C] = struct.pack("<I", 0x240)
    d[0x200 : 0x200 + len(table)] = table
    d[0x220:0x228] = struct.pack("<II", 0xC00, 0xC04)
    d[0x240:0x242] = b"\1\0"
    d[0xC00:0xC04] = b"KEEP"
    return C.patched(bytes(d), {0x80: C.u32(0xC04), C.CRC_AT: C.crc16(bytes(C.patched(bytes(d), {0x80: C.u32(0xC04)})[: C.CRC_AT])).to_bytes(2, "little")})


def test_cartridge():
    assert C.crc16(b"123456789") == 0x4B37
    rom = C.Cartridge(image())
    assert rom.text("title") == "SAMPLE" and rom.text("code") == "ABCD" and rom.files() == [(0, "x.bin", 0xC00, 4)] and rom.read("x.bin") == b"KEEP" and len(rom.banner()) == 0x840
    assert rom.rebuild({}) == image() and C.differing(image(), rom.rebuild({})) == []
    made = rom.rebuild({"x.bin": b"longer body"}, banner=b"\2\0", texts={"title": "NEW"})
    new = C.Cartridge(made)
    assert new.read(0) == b"longer body" and new.text("title") == "NEW" and len(made) == 0x4000 and C.differing(image(), made) == [0]
    assert made[0x240] == 2 and int.from_bytes(made[C.CRC_AT : C.CRC_AT + 2], "little") == C.crc16(made[: C.CRC_AT])
    with pytest.raises(A.Refused):
        C.Cartridge(b"\xff" * 0x200)


def test_cartridge_tables(spark):
    new = C.Cartridge(image()).rebuild({0: b"KEPT"})
    df = spark.createDataFrame([("a", bytearray(image())), ("b", bytearray(b"\xff" * 0x5000)), ("c", bytearray(b"tiny")), ("d", None)], "id string, content binary")
    assert [(r.id, r.fid, r.path, r.size, bytes(r.content)) for r in C.files(df, "id").collect()] == [("a", 0, "x.bin", 4, b"KEEP")]
    other = spark.createDataFrame([("a", bytearray(new))], "id string, content binary")
    assert C.changed(C.files(df, "id"), C.files(other, "id"), "id").count() == 1
    assert C.changed(C.files(df, "id"), C.files(df, "id"), "id").count() == 0


def test_open_source(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "x.bin").write_bytes(b"KEEP")
    (tmp_path / "y.nds").write_bytes(image())
    assert {(r.path, bytes(r.content)) for r in C.open_source(spark, str(tmp_path / "sub"), "folder").collect()} == {("x.bin", b"KEEP")}
    assert {r.path for r in C.open_source(spark, str(tmp_path), "folder").collect()} == {"sub/x.bin", "y.nds"}
    assert [(r.path, bytes(r.content)) for r in C.open_source(spark, str(tmp_path / "y.nds")).collect()] == [("x.bin", b"KEEP")]
    assert [r.path for r in C.open_source(spark, str(tmp_path / "sub" / "x.bin")).collect()] == ["x.bin"]


def test_carving():
    p = palette()
    assert nitro.header(p).kind == "NCLR" and [b[0] for b in nitro.blocks(p)] == [b"TTLP"] and nitro.header(p[:15]) is None
    blob = b"junk" + p + b"RLCN" + bytes(7) + p
    assert [(o, k) for o, _, k in nitro.carve(blob)] == [(4, "NCLR"), (4 + len(p) + 11, "NCLR")]
    packed = bytes(8) + bios.lz_encode(p)
    assert list(nitro.carve_packed(packed)) == [(8, "lz10", len(p), "NCLR")]


def test_explore(spark):
    p = palette()
    deep = p
    for _ in range(5):
        deep = narc((deep,), (b"in",))
    rows = [("plain", p), ("packed", bios.lz_encode(p)), ("narc", narc((p, b"zz", bios.lz_encode(p, 0x11)))), ("blob", b"junkjunk" + p + b"x" * 9), ("deep", deep), ("none", b"just bytes here"), ("empty", b"")]
    df = spark.createDataFrame([(n, bytearray(b)) for n, b in rows] + [("null", None)], "path string, content binary")
    out = {(r.path, r.item, "/".join(r.loc), r.kind) for r in E.explore(df).collect()}
    assert out == {
        ("plain", "plain", "", "NCLR"),
        ("packed", "packed", "codec:lz10", "NCLR"),
        ("narc", "narc/a.bin", "narc:0", "NCLR"),
        ("narc", "narc/b.bin", "narc:1", None),
        ("narc", "narc/c.bin", "narc:2/codec:lz11", "NCLR"),
        ("blob", "blob@8", "carve:8", "NCLR"),
        ("deep", "deep/in/in/in", "narc:0/narc:0/narc:0", "NARC"),
        ("none", "none", "", None),
    }


@pytest.mark.parametrize("under", ["diff8", "diff16"])
def test_filter_under_codec(under):
    data = bios.CODECS["lz10"][2](bios.CODECS[under][2](bytes(range(200)) * 2))
    assert list(E.walk(data, "f")) == [("f", ("codec:lz10", f"codec:{under}"), None, bytes(range(200)) * 2)]
