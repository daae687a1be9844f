import struct

import numpy as np
import pytest

from glyphmill.containers.archives import Refused
from glyphmill.formats import graphics as G
from glyphmill.sources.cartridge import crc16


def made(magic, *blocks):
    body = b"".join(m + struct.pack("<I", 8 + len(b)) + b for m, b in blocks)
    return magic + b"\xff\xfe\x00\x01" + struct.pack("<IHH", 16 + len(body), 16, len(blocks)) + body


WORDS = np.arange(16, dtype="<u2") * 0x421 | 0x8000
NCLR = made(b"RLCN", (b"TTLP", struct.pack("<4I", 3, 0, 32, 16) + WORDS.tobytes()))
MAPPED = made(b"RLCN", (b"TTLP", struct.pack("<4I", 3, 0, 32, 16) + WORDS.tobytes()), (b"PMCP", struct.pack("<HHIH", 1, 0, 8, 2)))
PIXELS = bytes(range(32)) * 2
NCGR = made(b"RGCN", (b"RAHC", struct.pack("<HH6I", 0xFFFF, 0xFFFF, 3, 0, 1, 64, 24, 0)[:24] + PIXELS))
NSCR = made(b"RCSN", (b"NRCS", struct.pack("<HHII", 16, 999, 0, 12) + struct.pack("<6H", *range(6))))
OAM = struct.pack("<3H", 0x4000 | 0xF8, 0x4000 | 0x1F0 | 0x1000, 5 << 12 | 7) + struct.pack("<3H", 0x100 | 8, 0x3000, 9)
NCER = made(b"RECN", (b"KBEC", struct.pack("<HHIIII", 2, 0, 24, 1, 0, 0) + bytes(4) + struct.pack("<HHI", 2, 0, 0) + struct.pack("<HHI", 9, 0, 12) + OAM))


def test_palette():
    p = G.Palette.read(NCLR)
    assert p.bpp == 4 and p.rgb[1].tolist() == [8, 8, 8] and p.rgb[15].tolist() == [123] * 3 and p.write(p.rgb) == NCLR
    new = p.rgb.copy()
    new[3] = 255, 0, 0
    again = G.Palette.read(p.write(new))
    assert again.rgb[3].tolist() == [255, 0, 0] and (np.delete(again.rgb, 3, 0) == np.delete(p.rgb, 3, 0)).all()
    full = G.Palette.read(MAPPED).full()
    assert len(full) == 256 and not full[:32].any() and full[33].tolist() == [8] * 3
    lying = NCLR.replace(struct.pack("<I", 32) + struct.pack("<I", 16), struct.pack("<I", 9999) + struct.pack("<I", 16))
    assert len(G.Palette.read(lying).rgb) == 16
    with pytest.raises(Refused):
        G.Palette.read(NCGR)


def test_tiles():
    t = G.Tiles.read(NCGR)
    assert (t.bpp, t.width, t.height, t.linear, len(t.pixels)) == (4, 2, 1, True, 128) and t.pixels[:4].tolist() == [0, 0, 1, 0] and t.write(t.pixels) == NCGR
    new = t.pixels.copy()
    new[5] = 9
    assert G.Tiles.read(t.write(new)).pixels.tolist() == new.tolist()
    with pytest.raises(ValueError):
        t.write(new[:10])


def test_screen_and_cells():
    s = G.Screen.read(NSCR)
    assert (s.cols, s.rows, s.entries.tolist()) == (2, 3, list(range(6)))
    mapping, where, pieces = G.cells(NCER)
    assert mapping == 1 and where is None and [p["cell"] for p in pieces] == [0, 0]
    assert pieces[0] == {"cell": 0, "ordinal": 0, "x": -16, "y": -8, "w": 32, "h": 8, "tile": 7, "pal": 5, "rotscale": 0, "hflip": 1, "vflip": 0}
    assert pieces[1]["rotscale"] == 1 and pieces[1]["hflip"] == 0 and pieces[1]["tile"] == 9


def test_banner():
    for version, size in ((1, 0x840), (0x103, 0x23C0)):
        b = G.Banner(struct.pack("<H", version) + bytes(range(256)) * (size // 256 + 1))
        b = G.Banner(b.data[:size])
        icon = b.icon()
        out = G.Banner(b.write(icon, "new title"))
        assert (out.icon() == icon).all() and out.titles() == ["new title"] * 6 and len(out.data) == size
        assert int.from_bytes(out.data[2:4], "little") == crc16(out.data[0x20:0x840])
        icon[3, 30] ^= 1
        assert (G.Banner(out.write(icon)).icon() == icon).all()
    with pytest.raises(ValueError):
        b.write(title="x" * 128)
    with pytest.raises(Refused):
        G.Banner(b"\7\0" + bytes(0x900))


def test_columns(spark):
    df = spark.createDataFrame([(1, bytearray(NCLR)), (2, bytearray(NCGR)), (3, bytearray(NSCR)), (4, bytearray(NCER)), (5, bytearray(b"junk")), (6, None)], "id int, content binary")
    got = {r.id: r for r in df.select("id", G.palette("content").alias("p"), G.tiles("content").alias("t"), G.screen("content").alias("s"), G.pieces("content").alias("c")).collect()}
    assert got[1].p.value.bpp == 4 and got[1].t.error and len(got[2].t.value.pixels) == 128 and got[3].s.value.entries == list(range(6))
    assert [p.tile for p in got[4].c.value.pieces] == [7, 9] and got[5].p.value is None and got[5].p.error and got[6].p is None
