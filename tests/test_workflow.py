import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphmill.codecs import studio
from glyphmill.containers import build as B
from glyphmill.formats import png
from glyphmill.sources import publish as P
from glyphmill.sources import workflow as W
from glyphmill.sources.session import EditError, resolve


def tiles(seed):
    return B.tiles(np.random.default_rng(seed).integers(1, 200, 64 * 8).astype(np.uint8).tobytes(), 4, 2)


def source():
    pal, screen = B.palette(list(range(0, 25600, 100))), B.screen(4, 2, list(range(8)))
    cell = B.cells([(0, 0, 0), (8, 0, 2), (0, 8, 4)])
    inner = B.narc([("p.bin", pal), ("t.bin", tiles(3)), ("s.bin", screen), ("c.bin", cell)])
    return {
        "ui/a.nclr": pal, "ui/a.ncgr": tiles(1), "ui/a.nscr": screen, "ui/b.ncgr": tiles(2), "data/pack.narc.l": studio.lz_encode_best(inner),
        "overlay9/x.bin": tiles(5), "other.txt": b"text",
    }


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame([(p, bytearray(b)) for p, b in source().items()], "path string, content binary").repartition(2)


@pytest.fixture(scope="module")
def found(spark, files):
    """One scan, kept as a table."""
    made = W.scan(files)
    return spark.createDataFrame(made.collect(), made.schema).coalesce(1)


def test_scan(files, found):
    got = sorted((r.kind, r.char, r.pal, r.map, r.layout) for r in found.collect())
    pack = "data/pack.narc.l#codec:lz10/narc:"
    assert got == [
        ("atlas", "ui/b.ncgr#", "ui/a.nclr#", None, "loose"), ("bg", f"{pack}1", f"{pack}0", f"{pack}2", "ordered"),
        ("bg", "ui/a.ncgr#", "ui/a.nclr#", "ui/a.nscr#", "loose"), ("cell", f"{pack}1", f"{pack}0", f"{pack}3", "ordered"),
    ]
    assert sorted(r.id for r in found.collect()) == [0, 1, 2, 3]
    assert {r.char for r in W.scan(files, only="O*", include_code=True).collect()} == {"overlay9/x.bin#"}
    assert {(r.kind, r.layout, r.n, r.without_palette) for r in W.stats(found).collect()} == {("atlas", "loose", 1, 0), ("bg", "ordered", 1, 0), ("bg", "loose", 1, 0), ("cell", "ordered", 1, 0)}


def pngs(folder):
    return sorted(os.path.join(r, f) for r, _, fs in os.walk(folder) for f in fs if f.endswith(".png"))


def edit(path, change):
    pixels, w, h, palette, alphas = png.decode(open(path, "rb").read())
    image = pixels.reshape(h, w).copy()
    change(image)
    open(path, "wb").write(png.encode(image.ravel(), w, h, palette, len(alphas)))


def test_dump_and_insert(spark, files, found, tmp_path):
    folder = f"{tmp_path}/dump"
    resources = found
    assert W.dump(files, resources, folder) == {"dumped": 4, "errors": 0}
    with pytest.raises(EditError, match="there already"):
        W.dump(files, resources, folder)
    before = source()
    same = {r.path: bytes(r.content) for r in W.insert(files, folder).collect()}
    assert same == before  # nothing edited: not a byte differs
    inner = next(p for p in pngs(folder) if "/bg/" in p and "pack" in p)

    def paint(image):
        image[0, 0], image[3, 9] = 150, 7

    edit(inner, paint)
    out = {r.path: bytes(r.content) for r in W.insert(files, folder).collect()}
    assert {p for p in out if out[p] != before[p]} == {"data/pack.narc.l"}
    new = resolve(out["data/pack.narc.l"], ("codec:lz10", "narc:1"))
    assert sum(a != b for a, b in zip(new, tiles(3), strict=True)) == 2 and len(pngs(folder)) == 4
    P.publish_files(W.insert(files, folder), f"{tmp_path}/out")
    assert open(f"{tmp_path}/out/data/pack.narc.l", "rb").read() == out["data/pack.narc.l"] and open(f"{tmp_path}/out/other.txt", "rb").read() == b"text"
    with pytest.raises(EditError, match="there already"):
        P.publish_files(files, f"{tmp_path}/out")
    # another picture of the same tiles asks for something else: all of it is refused
    cell = next(p for p in pngs(folder) if "/cell/" in p)

    def other(image):
        image[:8, :8] = 99

    edit(cell, other)
    with pytest.raises(EditError, match="same tiles"):
        W.insert(files, folder)
    os.remove(cell)
    with pytest.raises(EditError, match="no picture"):
        W.insert(files, folder)


def test_refusals(spark, files, found, tmp_path):
    folder = f"{tmp_path}/dump"
    W.dump(files, found.where("char LIKE 'ui/%'"), folder)
    one = pngs(folder)[0]
    good = open(one, "rb").read()
    pixels, w, h, palette, alphas = png.decode(good)
    for bad, why in ((good[:-20], "Refused"), (png.encode(pixels, h, w, palette, len(alphas)), "other size"), (png.encode(pixels, w, h, palette[::-1], len(alphas)), "other size"), (png.encode(pixels, w, h, palette, 0), "other size")):
        open(one, "wb").write(bad)
        with pytest.raises(EditError, match=why):
            W.insert(files, folder)
    open(one, "wb").write(good)
    with pytest.raises(EditError, match="not those"):
        W.insert(files.where("path <> 'other.txt'"), folder)
    with pytest.raises(EditError, match="leaves"):
        P.publish_files(files.withColumn("path", F.concat(F.lit("../"), "path")), f"{tmp_path}/x")
    with pytest.raises(EditError, match="twice"):
        P.publish_files(files.withColumn("path", F.lit("a")), f"{tmp_path}/x")
    assert not os.path.exists(f"{tmp_path}/x")


def test_images(tmp_path):
    banner = B.banner(bytes(512), [0] * 16, ["old"] * 6)
    image = B.cartridge("TITLE", "ABCE", [("a.bin", b"aaaa"), ("d/b.bin", b"bbbb" * 9)], banner=banner) + b"\xff" * 64
    out = f"{tmp_path}/new.bin"
    digest = W.insert_image(image, {"a.bin": b"AAAA"}, out, title="NEW", code="abcf", banner="two\nlines")
    new = open(out, "rb").read()
    from glyphmill.formats.graphics import Banner
    from glyphmill.sources.cartridge import Cartridge

    c = Cartridge(new)
    assert len(digest) == 64 and c.read("a.bin") == b"AAAA" and c.read("d/b.bin") == b"bbbb" * 9 and c.text("title") == "NEW" and c.text("code") == "ABCF" and Banner(c.banner()).titles()[0] == "two\nlines"
    with pytest.raises(EditError, match="there already"):
        W.insert_image(image, {"a.bin": b"x"}, out)
    for bad in ({"title": "é"}, {"title": "x" * 13}, {"code": "AB"}, {"banner": "\n\n\n"}, {}):
        with pytest.raises(EditError):
            W.insert_image(image, {}, f"{tmp_path}/other", **bad)
    with pytest.raises(EditError, match="besides"):
        W.verified(image, image[:0x200] + b"X" + image[0x201:], {})
    with pytest.raises(EditError, match="size"):
        W.verified(image, image + b"x", {})
    bad = bytearray(image)
    struct.pack_into("<H", bad, 0x15E, 1)
    with pytest.raises(EditError, match="checksum"):
        W.verified(image, bytes(bad), {})
    assert not os.path.exists(f"{tmp_path}/other")


def test_png_filters():
    import zlib

    rng = np.random.default_rng(2)
    image = rng.integers(0, 256, (10, 7)).astype(np.int64)
    rows, before = b"", np.zeros(7, np.int64)
    for y, line in enumerate(image):
        left, upper = np.concatenate([[0], line[:-1]]), np.concatenate([[0], before[:-1]])
        p = left + before - upper
        near = np.array([min((a, b, c), key=lambda v, p=q: abs(p - v)) for a, b, c, q in zip(left, before, upper, p)])
        guess = [0 * line, left, before, (left + before) // 2, near][y % 5]
        rows += bytes([y % 5]) + ((line - guess) % 256).astype(np.uint8).tobytes()
        before = line
    good = png.encode(image.ravel(), 7, 10, np.zeros((256, 3)), 0)
    made = good.replace(png.chunk(b"IDAT", zlib.compress(png_rows(image), 6)), png.chunk(b"IDAT", zlib.compress(rows)))
    assert made != good and (png.decode(made)[0].reshape(10, 7) == image).all() and (png.decode(good)[0].reshape(10, 7) == image).all()


def png_rows(image):
    return b"".join(b"\0" + r.astype(np.uint8).tobytes() for r in image)
