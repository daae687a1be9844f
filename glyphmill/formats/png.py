"""Indexed pictures as PNG files: a byte a pixel, the palette, and which entries are clear."""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np

from glyphmill.containers.archives import need

MARK = b"\x89PNG\r\n\x1a\n"


def chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode(pixels: np.ndarray, w: int, h: int, palette: np.ndarray, clear: int = 0) -> bytes:
    """`clear`: entries from the first on that are transparent."""
    rows = np.zeros((h, w + 1), np.uint8)  # each row begins with its filter: none
    rows[:, 1:] = np.asarray(pixels, np.uint8).reshape(h, w)
    rgb = np.zeros((256, 3), np.uint8)
    rgb[: len(palette)] = np.asarray(palette)[:256]
    parts = [chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 3, 0, 0, 0)), chunk(b"PLTE", rgb.tobytes())]
    parts += [chunk(b"tRNS", bytes(clear))] if clear else []
    return MARK + b"".join([*parts, chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)), chunk(b"IEND", b"")])


def decode(data: bytes) -> tuple[np.ndarray, int, int, np.ndarray, bytes]:
    """Pixels, width, height, palette and the clear entries' alphas; Refused for files that are no whole indexed picture."""
    need(data[:8] == MARK)
    at, found = 8, {}
    while at + 12 <= len(data):
        n = int.from_bytes(data[at : at + 4], "big")
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        need(at + 12 + n <= len(data) and zlib.crc32(kind + body) == int.from_bytes(data[at + 8 + n : at + 12 + n], "big"))
        found[kind] = found.get(kind, b"") + body
        at += 12 + n
    need({b"IHDR", b"PLTE", b"IDAT", b"IEND"} <= found.keys())
    w, h, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", found[b"IHDR"])
    need(depth == 8 and colour == 3 and not interlaced)
    rows = np.frombuffer(zlib.decompress(found[b"IDAT"]), np.uint8)
    need(len(rows) == h * (w + 1))
    rows = rows.reshape(h, w + 1)
    out = np.zeros((h + 1, w), np.int64)
    for y in range(h):
        line, kind, up = rows[y, 1:].astype(np.int64), rows[y, 0], out[y]
        if kind == 0:
            out[y + 1] = line
        elif kind == 1:
            out[y + 1] = np.cumsum(line) & 255
        elif kind == 2:
            out[y + 1] = line + up & 255
        else:
            left = upper = 0
            for x in range(w):  # the filters by average and by the nearest of three go pixel by pixel
                above = int(up[x])
                if kind == 3:
                    guess = left + above >> 1
                else:
                    p = left + above - upper
                    guess = min((left, above, upper), key=lambda v: abs(p - v))
                left, upper = int(line[x]) + guess & 255, above
                out[y + 1, x] = left
    return out[1:].astype(np.uint8).ravel(), w, h, np.frombuffer(found[b"PLTE"], np.uint8).reshape(-1, 3), found.get(b"tRNS", b"")


def pixel_hash(pixels: np.ndarray, w: int, h: int) -> str:
    return hashlib.md5(np.asarray(pixels, np.uint8).tobytes() + f"({h}, {w})".encode()).hexdigest()


def table_digest(palette: np.ndarray, alphas: bytes) -> str:
    """sha256 of all 256 entries with their alphas."""
    rgba = np.zeros((256, 4), np.uint8)
    rgba[:, 3] = 255
    rgba[: len(palette), :3] = palette
    rgba[: len(alphas), 3] = np.frombuffer(alphas, np.uint8)
    return hashlib.sha256(rgba.tobytes()).hexdigest()
