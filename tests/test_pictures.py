import struct

import numpy as np
import pytest

from glyphmill.containers.archives import Refused
from glyphmill.formats import pictures as P
from glyphmill.plans import pictures as D


def test_detection_and_refusals(spark):
    p = (np.arange(1024) % 16).astype(np.uint8)
    kinds = {}
    for kind, depths in D.DEPTHS.items():
        data = D.drawn(kind, p & ((1 << depths[0]) - 1), depths[0])
        name = {"ebp": "a.EBP", "level5_bg": "b.arc"}.get(kind, "x.bin")
        if kind not in ("level5_ani", "tex"):
            got = P.open_picture(data, name)
            assert got.kind == kind and got.pixels().shape == (1024,)
            kinds[kind] = (data, name)
            for cut in (0, 3, 12, len(data) // 2):
                with pytest.raises(Refused):
                    P.open_picture(data[:cut], "x.bin")
    rows = [(k, bytearray(d), n) for k, (d, n) in kinds.items()] + [("junk", bytearray(b"nothing"), "n"), ("null", None, None)]
    df = spark.createDataFrame(rows, "id string, content binary, name string")
    got = {r.id: r.p for r in df.select("id", P.picture(df.content, df.name).alias("p")).collect()}
    assert all(got[k].value.kind == k for k in kinds) and got["junk"].error and got["null"] is None


def test_direct_and_block_colours():
    red, blue = 31, 31 << 10
    raw = struct.pack("<4H", red | 0x8000, blue, 0xFFFF, 0)
    assert P.direct(raw, 2, 2).reshape(-1, 4).tolist() == [[255, 0, 0, 255], [0, 0, 255, 0], [255, 255, 255, 255], [0, 0, 0, 0]]
    palette = struct.pack("<4H", red, blue, 31 << 5, 0)
    codes = sum((k % 4) << 2 * k for k in range(16))
    for mode, third, fourth in ((0, [0, 255, 0, 255], [0, 0, 0, 0]), (1, [127, 0, 127, 255], [0, 0, 0, 0]), (2, [0, 255, 0, 255], [0, 0, 0, 255]), (3, [159, 0, 95, 255], [95, 0, 159, 255])):
        got = P.four_by_four(struct.pack("<I", codes), struct.pack("<H", mode << 14), palette, 4, 4)
        assert got[0].tolist() == [[255, 0, 0, 255], [0, 0, 255, 255], third, fourth]
    direct = struct.pack("<3I", 2, 2, 0x18) + raw
    assert P.ebp_rgba(direct).shape == (2, 2, 4)
    packed = struct.pack("<6I", 4, 4, 0x4444, 8, 2, 4) + palette + struct.pack("<I", codes) + struct.pack("<H", 2 << 14)
    assert P.ebp_rgba(packed)[0, 2].tolist() == [0, 255, 0, 255]


def test_first_pixel_counts_and_conflicts():
    # two map entries show one tile
    data = b"BGP1" + struct.pack("<IHHBBH6I", 0, 16, 8, 8, 8, 0, 0x28, 2, 0x2A, 64, 0x6A, 4) + bytes(2) + bytes(64) + struct.pack("<2H", 0, 0x400)
    p = P.bgp1(data)
    new = np.zeros((8, 16), np.int64)
    new[0, 0], new[0, 15], new[3, 9] = 5, 7, 9
    out, lost = p.write(new)
    seen = P.bgp1(out).pixels().reshape(8, 16)
    assert seen[0, 0] == 5 == seen[0, 15] and lost == 2 and seen[3, 9] == 0


def test_font_tables_and_photos():
    f = P.font(D.drawn("font", np.zeros(1024, np.uint8), 1))
    assert f.extra == {"line_height": 11, "widths": {g: (3 * g, 3 * g + 1, 3 * g + 2) for g in range(4)}, "codes": {65: 0, 66: 1, 67: 2, 68: 3}}
    assert P.photo(b"\xff\xd8\xff\xe0") == "JPEG" and P.photo(b"1234pu\x01\x01") == "PU" and P.photo(b"GIF89a") == "GIF" and P.photo(b"abc") is None
    tga = bytes([0, 0, 2]) + bytes(9) + struct.pack("<HHBB", 2, 2, 24, 0) + bytes(12)
    assert P.photo(tga, "a.TGA") == "TGA" and P.photo(tga, "a.bin") is None and P.photo(tga[:20], "a.tga") is None


def test_records_and_pointers():
    assert P.records(b"OBP1" + bytes(8) + b"BGP1" + bytes(4) + b"xOBP1xxx") == [(0, 12, "OBP1"), (12, 16, "BGP1")]
    data = b"SIR0" + struct.pack("<3I", 0, 16, 0) + bytes([0x81, 0x00, 4, 0])
    assert P.pointers(data) == [128, 132]
