import numpy as np

from glyphmill.containers import build as B
from glyphmill.formats import layout as L
from glyphmill.formats.graphics import Tiles, cells
from glyphmill.formats.pictures import unpacked


def picture(w, h):
    y, x = np.mgrid[:h, :w]
    return ((np.sin(x / 5.0) + np.cos(y / 7.0) + 2) * 50).astype(np.uint8)


def test_widths():
    image = picture(96, 80)
    w, order = L.bitmap_width(image.ravel())
    assert w == 96 and L.confidence(order) > 0.1 and order[0][1] < order[1][1]
    # by brute force: all multiples of eight that divide
    assert {a for a, _ in order} == {w for w in range(8, 513, 8) if image.size % w == 0}
    assert L.resolved_bitmap_width(image.ravel(), 64)[0] == 96
    noise = np.random.default_rng(1).integers(0, 256, 64 * 64).astype(np.uint8)
    assert L.resolved_bitmap_width(noise, 64)[0] == 64 and L.bitmap_width(np.zeros(7, np.uint8), None)[0] == 7
    tiles = image.reshape(10, 8, 12, 8).swapaxes(1, 2).ravel()
    assert (L.tile_image(tiles, 12) == image).all() and L.resolved_tile_width(tiles, None)[0] == 12
    entries = (np.arange(32)[:, None] // 3 + np.arange(24)[None, :] // 4).ravel() | 0xF000
    assert L.screen_shape(entries)[0] == (24, 32) and L.screen_shape(np.array([1]))[0] == (1, 1)
    got = L.guessed_tiles(image.tobytes())
    assert (got["bpp"], got["width"], got["height"]) == (8, 96, 80) and L.guessed_tiles(b"") is None and L.guessed_tiles(b"abc") is None


def test_raw_depth():
    pal = np.arange(256, dtype="<u2").tobytes()
    smooth = picture(256, 64).reshape(8, 8, 32, 8).swapaxes(1, 2).astype(np.uint8).tobytes()
    light = np.where(np.arange(256) < 16, np.arange(256) % 2 * 31, np.arange(256) // 8)
    ramp = (light * 0x421).astype("<u2").tobytes()
    assert L.raw_depth(smooth, ramp, False, False) == 8 and L.raw_depth(smooth, pal[:32], False, False) == 4 and L.raw_depth(smooth, pal, True, True) == 4 and L.raw_depth(smooth, pal, False, True) == 8


def piece(cell, x, y, w, h, tile, **more):
    return {"cell": cell, "ordinal": 0, "x": x, "y": y, "w": w, "h": h, "tile": tile, "pal": 0, "hflip": 0, "vflip": 0} | more


def test_cells_by_brute_force():
    rng = np.random.default_rng(4)
    raw = rng.integers(0, 256, 64 * 40).astype(np.uint8)
    t = Tiles(b"", 8, 0, len(raw), raw, 8, 5, False)
    found = (0, None, [piece(0, 0, 0, 16, 8, 0), piece(0, 8, 0, 8, 8, 4, hflip=1), piece(1, -4, -4, 8, 16, 8, vflip=1), piece(1, 100, 50, 8, 8, 12)])
    places, _, w, h, boxes = L.cell_sheet(found, t, see_through=False)
    assert boxes == [(0, 0, 16, 8), (24, 0, 112, 62)] and (w, h) == (136, 62)
    image = places.reshape(h, w)
    for cell, (bx, by, _, _) in enumerate(boxes):
        own = [p for p in found[2] if p["cell"] == cell]
        x0, y0 = min(p["x"] for p in own), min(p["y"] for p in own)
        for yy in range(h - by):
            for xx in range(boxes[cell][2]):
                want = -1
                for p in own:  # the first that covers the pixel
                    u, v = xx - (p["x"] - x0), yy - (p["y"] - y0)
                    if 0 <= u < p["w"] and 0 <= v < p["h"]:
                        u, v = (p["w"] - 1 - u if p["hflip"] else u), (p["h"] - 1 - v if p["vflip"] else v)
                        want = p["tile"] * 32 + (v // 8 * (p["w"] // 8) + u // 8) * 64 + v % 8 * 8 + u % 8
                        break
                assert image[by + yy, bx + xx] == want
    apart = L.cell_sheet(found, t, apart=True)[4]
    assert len(apart) == 4 and L.mapping(found[2], 9, len(raw), 8) == 0 == L.mapping(found[2], 0, len(raw), 8)
    assert L.mapping([piece(0, 0, 0, 16, 8, 0), piece(0, 0, 0, 8, 8, 2)], 9, len(raw), 8) == 1
    assert L.shelves([(300, 10), (300, 20), (10, 5)])[0] == [(0, 0), (0, 18), (308, 18)]
    assert L.grid_fits([piece(0, 0, 0, 16, 8, 6)], len(raw), 64) and not L.grid_fits([piece(0, 0, 0, 16, 8, 7)], len(raw), 64)


def test_resources():
    pixels = bytes(range(64)) * 8
    char, pal = B.tiles(pixels, 2, 4), B.palette(list(range(256)))
    bg = L.resource_picture("bg", char, pal, B.screen(2, 2, [0, 0x401, 9999 & 1023, 3]))
    assert (bg.w, bg.h) == (16, 16) and bg.pixels().reshape(16, 16)[0].tolist() == [*range(8), *range(7, -1, -1)] and not bg.pixels().reshape(16, 16)[8:, :8].any()
    new = bg.pixels().copy()
    new[0] = 77
    out, lost = bg.write(new)
    assert lost == 0 and L.resource_picture("bg", out, pal, B.screen(2, 2, [0, 0x401, 1023, 3])).pixels()[0] == 77
    atlas = L.resource_picture("atlas", char, None, None)
    assert atlas.w % 8 == 0 and sorted(atlas.pixels().tolist()) == sorted(pixels)
    made = B.cells([(0, 0, 0), (8, 0, 4), (0, 8, 2)])
    sheet = L.resource_picture("cell", char, pal, made)
    assert (sheet.w, sheet.h) == (16, 16) and cells(made)[0] == 0 and sheet.pixels().reshape(16, 16)[0, 1] == 1
    assert unpacked(b"\x21", 4).tolist() == [1, 2]
