import random
import struct

import pytest

from glyphmill.containers import tables as T
from glyphmill.containers.archives import Refused


def test_packets_and_archives():
    data = b"junk" + T.packet("name", [("a", 0), ("b", 4), ("c", 10), ("d", 11), ("e", 8)], [[1, 70000, "text", b"blob", 0.5], [2, 3, "", b"", -1.0]])
    got, places = T.rows(data, 4)
    assert [(r["a"], r["b"], r["c"], r["e"]) for r in got] == [(1, 70000, "text", 0.5), (2, 3, "", -1.0)]
    o, n = got[0]["d"]
    assert data[o : o + n] == b"blob" and data[places[0]["b"][0] :][:4] == struct.pack(">I", 70000)
    bodies = [b"one", b"two" * 50, b"", b"four"]
    archive = T.cpk(bodies)
    found = T.cpk_entries(archive)
    assert [archive[e.off : e.off + e.size] for e in found] == bodies and [e.name for e in found] == [f"{i:08d}.bin" for i in range(4)]
    more = T.cpk_grow(archive, found[0].off, 40)
    assert T.cpk_entries(more)[0].size == 40 and T.cpk_entries(more)[1] == found[1] and T.cpk_grow(archive, found[0].off, 65) is None
    for cut in range(0, len(archive) - 400, 7):
        with pytest.raises(Refused):
            T.cpk_entries(archive[:cut])


def test_name_trees():
    paths = ["a.nclr", "dir/b.ncgr", "dir/sub/c.bin", "dir/d", "e.txt"]
    # folders come after their own folder's files, depth first
    assert sorted(T.tree_names(T.tree(paths))) == sorted(paths)
    assert T.tree_names(T.tree(["x/1", "x/2", "y"])) == ["x/1", "x/2", "y"]
    for bad in (b"", b"\1\0", struct.pack("<HH", 1, 3) + b"abc" + struct.pack("<I", 99), struct.pack("<HH", 1, 1) + b"\7" + bytes(4)):
        with pytest.raises(Refused):
            T.tree_names(bad)
    assert T.assigned(["NCLR", "NCGR", "NSBTX", "NCER"], ["p.nclr", "t.ncgr", "model.bin", "readme.txt", "c.ncer"]) == {0: "p.nclr", 1: "t.ncgr", 2: "model.bin", 3: "c.ncer"}
    assert T.assigned(["NCLR", "NANR", "NANR", "NCER"], ["p.nclr", "x.bin", "c.ncer"]) == {0: "p.nclr", 3: "c.ncer"}


def test_offset_tables():
    rng = random.Random(3)
    bodies = [bytes(rng.randrange(1, 256) for _ in range(4 * rng.randrange(3, 30))) for _ in range(9)]
    for base in (0, 16):
        head, at, spans = [], 8 + 8 * len(bodies), []
        for b in bodies:
            spans.append((at, len(b)))
            head += [at - base, len(b)]
            at += len(b)
        data = struct.pack("<II", 0x1234, at) + struct.pack(f"<{len(head)}I", *head) + b"".join(bodies)
        t = T.offset_table(data, spans)
        assert (t.base, t.stride, t.cover, t.totals) == (base, 8, 1.0, (4,)) and len(t.sizes) == 9
        new = T.grown(data, t, *spans[3], b"n" * 301)
        at, n = struct.unpack_from("<II", new, 8 + 8 * 3)
        assert new[at + base :][:n] == b"n" * 301 and struct.unpack_from("<I", new, 4)[0] == len(new)
        for k in range(9):
            at, n = struct.unpack_from("<II", new, 8 + 8 * k)
            assert k == 3 or new[at + base :][:n] == bodies[k]
    assert T.offset_table(bytes(100), [(60, 4)]) is None and T.offset_table(bytes(100), [(60, 4), (70, 5)]) is None
