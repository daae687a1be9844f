"""How tiles, maps and sprite pieces make a picture, and how wide a picture is that doesn't say so.

All layouts give `places` (where a pixel is stored, NOWHERE for none) and palette rows, as pictures.Picture takes them.
"""

from __future__ import annotations

from itertools import pairwise

import numpy as np

from .graphics import Palette, Screen, Tiles, cells
from .pictures import NOWHERE, Picture, in_blocks, on_map

#: Width of a sheet of cells, and the gap between them.
SHEET, GAP = 512, 8
#: Pixels of one unit of tile numbers, by depth: 32 bytes.
UNIT = {4: 64, 8: 32}


def smoothness(image: np.ndarray) -> float:
    """Mean difference of vertical neighbours: low for pictures of the right width."""
    return float(np.abs(np.diff(image.astype(np.int32), axis=0)).mean()) if len(image) > 1 else float("inf")


def ranked(values: np.ndarray, widths) -> list[tuple[int, float]]:
    """(width, score) of the widths that divide the values, the smoothest first, the narrower on ties."""
    found = [(w, smoothness(values.reshape(-1, w))) for w in sorted({w for w in widths if w and len(values) % w == 0})]
    return sorted(found, key=lambda x: x[1])


def confidence(order: list[tuple[int, float]]) -> float:
    """How much better the first is than the second, from 0 to 1."""
    if len(order) < 2 or order[1][1] <= 0:
        return 1.0
    return max(0.0, min(1.0, 1 - order[0][1] / order[1][1]))


def bitmap_width(values: np.ndarray, declared: int | None = None, unit: int = 8, least: int = 8, most: int = 512) -> tuple[int, list]:
    top = min(most, len(values))
    order = ranked(values, [*range(-(-least // unit) * unit, top + 1, unit), declared or 0])
    return (order[0][0] if order else declared or len(values)), order


def tile_image(values: np.ndarray, cols: int) -> np.ndarray:
    places, h = in_tiles(len(values), cols)
    return np.where(places >= 0, values[np.clip(places, 0, len(values) - 1)], 0).reshape(h, -1)


def tile_width(values: np.ndarray, declared: int | None = None, least: int = 1, most: int = 32) -> tuple[int, list]:
    n = len(values) // 64
    widths = {c for c in range(least, min(most, n) + 1) if n % c == 0} | {c for c in (4, 8, 16, 32) if c <= n} | ({declared} if declared else set())
    order = sorted(((c, smoothness(tile_image(values, c))) for c in sorted(widths)), key=lambda x: x[1])
    return (order[0][0] if order else declared or n), order


def screen_shape(entries: np.ndarray, declared: tuple[int, int] | None = None, least: int = 8, most: int = 64) -> tuple[tuple[int, int], list]:
    n = len(entries)
    if n < 2:
        return declared or (n, 1), []
    widths = [w for w in range(least, min(most, n) + 1) if n % w == 0 and n // w > 1]
    if declared and declared[0] * declared[1] == n and declared[1] > 1:
        widths.append(declared[0])
    order = [((w, n // w), s) for w, s in ranked(np.asarray(entries, np.int64) & 1023, widths)]
    return (order[0][0] if order else declared or (n, 1)), order


def settled_width(found: int, order: list, declared: int | None, fits: bool) -> int:
    """The found width, unless it is no clear winner, or a sliver of the declared one, that fits too, and not far better."""
    if not declared or not fits:
        return found
    scores = dict(order)
    if confidence(order) < 0.05 or found * 8 <= declared or found * 4 <= declared and scores.get(declared, float("inf")) < 3 * scores[found]:
        return declared
    return found


def resolved_bitmap_width(values: np.ndarray, declared: int | None, **limits) -> tuple[int, float]:
    found, order = bitmap_width(values, declared, **limits)
    return settled_width(found, order, declared, bool(declared) and len(values) % declared == 0), round(confidence(order), 2)


def resolved_tile_width(values: np.ndarray, declared: int | None) -> tuple[int, float]:
    n = len(values) // 64
    found, order = tile_width(values, declared, 4 if n >= 32 else 1)
    out = settled_width(found, order, declared, bool(declared) and n % declared == 0)
    if not declared and confidence(order) < 0.15 and n >= 256 and n % 32 == 0:
        out = 32  # undecided: as wide as the screen
    return out, round(confidence(order), 2)


def guessed_tiles(data: bytes, most_bytes: int = 4 << 20) -> dict | None:
    """bpp, width, height and confidence of bytes that may be pixels and nothing else: the depth that is surer."""
    from .pictures import unpacked

    best = None
    for bpp in (4, 8) if data and len(data) <= most_bytes else ():
        values = unpacked(data, bpp)
        width, order = bitmap_width(values, most=256)
        if len(values) >= 64 and order and len(values) // width >= 2:
            one = {"bpp": bpp, "width": width, "height": len(values) // width, "confidence": round(confidence(order), 2)}
            best = one if best is None or one["confidence"] > best["confidence"] else best
    return best


def raw_depth(data: bytes, palette: bytes, rows_used: bool, mapped: bool) -> int:
    """Bits of headerless tiles: four for a small palette or a map with rows; else the smoother in true brightness."""
    from .pictures import unpacked

    if len(palette) < 512 or rows_used:
        return 4
    if mapped or len(data) % 64:
        return 8
    w = np.frombuffer(palette, "<u2", len(palette) // 2).astype(np.int32)
    light = np.zeros(256, np.int32)
    light[: min(256, len(w))] = ((w & 31) * 3 + (w >> 5 & 31) * 6 + (w >> 10 & 31))[:256]
    four, eight = (smoothness(light[tile_image(unpacked(data, b), 32)]) for b in (4, 8))
    return 4 if four <= eight else 8


# --- layouts -------------------------------------------------------------------------------


def in_tiles(n: int, cols: int) -> tuple[np.ndarray, int]:
    """Places of n pixels as 8x8 tiles, `cols` a row, and the picture's height."""
    tiles = n // 64
    cols = max(1, min(cols, tiles))
    rows = -(-tiles // cols)
    places = in_blocks(cols * 8, rows * 8, 8, 8)
    return np.where(places < tiles * 64, places, NOWHERE), rows * 8


def in_rows(n: int, width: int) -> tuple[np.ndarray, int]:
    h = -(-n // width)
    at = np.arange(h * width)
    return np.where(at < n, at, NOWHERE), h


def mapping(pieces: list[dict], declared: int, n: int, bpp: int) -> int:
    """The shift of tile numbers: the declared one if all pieces lie inside the pixels, else the fitting one whose pieces overlap least in part."""
    spans = {(p["tile"], p["w"] * p["h"]) for p in pieces}
    ranges = lambda m: sorted({((t << m) * UNIT[bpp], (t << m) * UNIT[bpp] + s) for t, s in spans})
    fit = [m for m in range(5) if all(b <= n for _, b in ranges(m))]
    if declared in fit:
        return declared
    partial = lambda m: sum(b < a[1] and (b, e) != a for a, (b, e) in pairwise(ranges(m)))
    return min(fit, key=lambda m: (partial(m), m)) if fit else declared if 0 <= declared <= 4 else 0


def grid_fits(pieces: list[dict], n: int, width: int) -> bool:
    """Whether all pieces, as rectangles at their tile of a picture `width` wide, lie inside it."""
    cols, rows = width // 8, n // width // 8
    return bool(cols) and all(p["tile"] % cols * 8 + p["w"] <= width and p["tile"] // cols < rows and p["tile"] // cols * 8 + p["h"] <= rows * 8 for p in pieces)


def shelves(boxes: list[tuple[int, int]], width: int = SHEET, gap: int = GAP) -> tuple[list[tuple[int, int]], int, int]:
    """Places of boxes on a sheet, left to right, a new row where one is full; and the sheet's size."""
    at, x, y, high, wide = [], 0, 0, 0, 0
    for w, h in boxes:
        if x and x + w > width:
            x, y, high = 0, y + high + gap, 0
        at.append((x, y))
        wide, high, x = max(wide, x + w), max(high, h), x + w + gap
    return at, max(8, wide), max(8, y + high)


def piece_places(p: dict, shift: int, bpp: int, linear: bool, grid: int | None, extra: int) -> np.ndarray:
    w, h = p["w"], p["h"]
    y, x = np.mgrid[:h, :w]
    if grid:
        cols = grid // 8
        row, col = divmod(p["tile"], cols)
        at = (row * 8 + y) * grid + col * 8 + x if linear else ((row + y // 8) * cols + col + x // 8) * 64 + y % 8 * 8 + x % 8
    else:
        at = (p["tile"] << shift) * UNIT[bpp] + extra + (np.arange(w * h).reshape(h, w) if linear else in_blocks(w, h, 8, 8).reshape(h, w))
    at = at[:, ::-1] if p["hflip"] else at
    return at[::-1] if p["vflip"] else at


def box(pieces: list[dict]) -> tuple[int, int, int, int]:
    """The pieces' bounding box, eight by eight at least."""
    if not pieces:
        return 0, 0, 8, 8
    x, y = min(p["x"] for p in pieces), min(p["y"] for p in pieces)
    return x, y, max(8, max(p["x"] + p["w"] for p in pieces) - x), max(8, max(p["y"] + p["h"] for p in pieces) - y)


def cell_sheet(found, tiles: Tiles, *, grid: int | None = None, apart: bool = False, see_through: bool = True):
    """places, rows, width, height and boxes of all cells on a sheet; `apart`: a box for each piece, so that none hides another."""
    declared, starts, pieces = found
    n, bpp = len(tiles.pixels), tiles.bpp
    shift = 0 if grid else mapping(pieces, declared, n, bpp)
    by_cell: dict[int, list[dict]] = {}
    for p in pieces:
        by_cell.setdefault(p["cell"], []).append(p)
    last = max(by_cell, default=-1)
    units = [(c, [p]) for c in sorted(by_cell) for p in by_cell[c]] if apart else [(c, by_cell.get(c, [])) for c in range(last + 1)]
    boxes = [box(own) for _, own in units]
    at, w, h = shelves([b[2:] for b in boxes])
    places, rows = np.full((h, w), NOWHERE, np.int64), np.zeros((h, w), np.int64)
    for (cell, own), (x0, y0, _, _), (sx, sy) in zip(units, boxes, at, strict=True):
        extra = starts[cell] * (2 if bpp == 4 else 1) if starts and cell < len(starts) else 0
        for p in reversed(own):  # the first is on top
            new = piece_places(p, shift, bpp, tiles.linear, grid, extra)
            y, x = sy + p["y"] - y0, sx + p["x"] - x0
            held = places[y : y + p["h"], x : x + p["w"]]
            shown = (new >= 0) & (new < n)
            if see_through:  # value 0 is never drawn
                shown &= (tiles.pixels[np.clip(new, 0, n - 1)] != 0) | (held < 0)
            held[shown] = new[shown]
            rows[y : y + p["h"], x : x + p["w"]][shown] = p["pal"]
    return places.ravel(), rows.ravel(), w, h, [(sx, sy, bw, bh) for (sx, sy), (_, _, bw, bh) in zip(at, boxes, strict=True)]


def cell_grid(found, tiles: Tiles) -> int | None:
    """The width of the picture that the pieces are rectangles of; None where they are runs: by what fits, or else what is smoother."""
    declared, _, pieces = found
    n, width = len(tiles.pixels), tiles.width * 8
    if not width or n % width or not grid_fits(pieces, n, width):
        return None
    shift = declared if 0 <= declared <= 4 else mapping(pieces, declared, n, tiles.bpp)
    if any((p["tile"] << shift) * UNIT[tiles.bpp] + p["w"] * p["h"] > n for p in pieces):
        return width
    if not tiles.linear:
        return None

    def score(grid):
        places, _, w, h, _ = cell_sheet(found, tiles, grid=grid)
        return smoothness(np.where(places >= 0, tiles.pixels[np.clip(places, 0, n - 1)], 0).reshape(h, w))

    return width if score(width) < score(None) else None


# --- resources -----------------------------------------------------------------------------


def grey(bpp: int) -> np.ndarray:
    step = 17 if bpp == 4 else 1
    return np.repeat((np.arange(16 if bpp == 4 else 256) * step)[:, None], 3, 1) if bpp == 8 else np.tile(np.repeat((np.arange(16) * 17)[:, None], 3, 1), (16, 1))


def resource_picture(kind: str, char: bytes, pal: bytes | None, map_: bytes | None, apart: bool = False) -> Picture:
    """A background, a sheet of cells, or an atlas, from the files of its tiles, palette and map."""
    t = Tiles.read(char)
    colours = Palette.read(pal).full()[:256] if pal else grey(t.bpp)
    extra: dict = {}
    if kind == "bg":
        s = Screen.read(map_)
        places, rows = on_map(s.entries[: s.cols * s.rows].astype(np.int64), s.cols)
        places = np.where(places < len(t.pixels), places, NOWHERE)
        w = s.cols * 8
    elif kind == "cell":
        found = cells(map_)
        places, rows, w, _, extra["boxes"] = cell_sheet(found, t, grid=cell_grid(found, t), apart=apart)
    else:
        if t.linear:
            w, extra["confidence"] = resolved_bitmap_width(t.pixels, t.width * 8)
            places, _ = in_rows(len(t.pixels), w)
        else:
            cols, extra["confidence"] = resolved_tile_width(t.pixels, t.width)
            places, _ = in_tiles(len(t.pixels), cols)
            w = 8 * max(1, min(cols, len(t.pixels) // 64))
        rows = np.zeros(len(places), np.int64)
    return Picture(char, kind, w, len(places) // w, t.bpp, t.at, t.size, colours, places, rows if t.bpp == 4 else None, extra=extra)
