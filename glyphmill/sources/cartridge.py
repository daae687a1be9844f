"""Cartridge images: header, file table, names, overlays, banner region; rebuilding and checking."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.containers.archives import ROOT, Refused, names, patched, u32, words

#: The sixteen header words from 0x20 on.
REGIONS = (
    "arm9_off", "arm9_entry", "arm9_ram", "arm9_size", "arm7_off", "arm7_entry", "arm7_ram", "arm7_size",
    "fnt_off", "fnt_size", "fat_off", "fat_size", "ov9_off", "ov9_size", "ov7_off", "ov7_size",
)
#: Where the title (12 bytes) and the code (4 bytes) lie.
TEXTS = {"title": (0, 12), "code": (12, 4)}
BANNER_AT, USED_AT, CRC_AT = 0x68, 0x80, 0x15E
#: Bytes of a banner by its version; others have the first version's.
BANNER_SIZES = {1: 0x840, 2: 0x940, 3: 0xA40, 0x103: 0x23C0}


def crc16(data: bytes, start: int = 0xFFFF) -> int:
    """CRC-16 with the reflected polynomial 0xA001, by a table of bytes."""
    crc = start
    for b in data:
        crc = crc >> 8 ^ CRC_TABLE[(crc ^ b) & 255]
    return crc


def _crc_table() -> list[int]:
    t = np.arange(256)
    for _ in range(8):
        t = np.where(t & 1, t >> 1 ^ 0xA001, t >> 1)
    return t.tolist()


CRC_TABLE = _crc_table()


@dataclass
class Cartridge:
    data: bytes
    regions: dict[str, int] = field(init=False)
    fat: np.ndarray = field(init=False)
    names: dict[int, str] = field(init=False)
    overlays: list[dict] = field(init=False)

    def __post_init__(self):
        d = self.data
        r = self.regions = dict(zip(REGIONS, (int(x) for x in words(d, 0x20, 16)), strict=True))
        self.fat = words(d, r["fat_off"], r["fat_size"] // 8 * 2).reshape(-1, 2)
        self.names = dict(names(d, r["fnt_off"], len(d), ROOT))
        self.overlays = []
        for cpu in (9, 7):
            rows = words(d, r[f"ov{cpu}_off"], r[f"ov{cpu}_size"] // 32 * 8).reshape(-1, 8)
            for i, v in enumerate(rows.tolist()):
                at = r[f"ov{cpu}_off"] + 32 * i
                self.overlays.append({"cpu": cpu, "id": v[0], "ram": v[1], "size": v[2], "bss": v[3], "fid": v[6], "comp_size": v[7] & 0xFFFFFF, "compressed": bool(v[7] >> 24 & 1), "at": at})
        for o in self.overlays:
            self.names.setdefault(o["fid"], f"overlay{o['cpu']}/overlay_{o['id']:04d}.bin")

    def text(self, what: str) -> str:
        at, n = TEXTS[what]
        raw = self.data[at : at + n]
        return (raw.rstrip(b"\0") if what == "title" else raw).decode("ascii", "replace")

    def read(self, key: int | str) -> bytes:
        lo, hi = self.fat[key if isinstance(key, int) else self.fid(key)]
        return self.data[lo:hi]

    def fid(self, path: str) -> int:
        wanted = path.strip("/")
        return next(i for i, p in self.names.items() if p == wanted)

    def arm(self, cpu: int) -> bytes:
        at = self.regions[f"arm{cpu}_off"]
        return self.data[at : at + self.regions[f"arm{cpu}_size"]]

    def banner(self) -> bytes:
        at = int(words(self.data, BANNER_AT, 1)[0])
        version = int(words(self.data, at, 1, "<u2")[0])
        return self.data[at : at + BANNER_SIZES.get(version, BANNER_SIZES[1])]

    def files(self) -> list[tuple[int, str, int, int]]:
        """(file id, path, offset, size) of the named files that are not empty."""
        return [(i, self.names[i], int(lo), int(hi - lo)) for i, (lo, hi) in enumerate(self.fat) if i in self.names and hi > lo]

    def rebuild(self, changes: dict[int | str, bytes], banner: bytes | None = None, comp_sizes: dict[int, int] | None = None, texts: dict[str, str] | None = None) -> bytes:
        """The image with files, banner, compressed overlay sizes and header texts put in.

        All before the first file behind the file table stays; files from there on are laid out anew in table order,
        each padded with 0xFF to four bytes; the image never gets shorter; used size and header CRC are renewed.
        """
        d, r = self.data, self.regions
        new = {k if isinstance(k, int) else self.fid(k): v for k, v in changes.items()}
        table_end = r["fat_off"] + 8 * len(self.fat)
        moved = (self.fat[:, 0] >= table_end) & (self.fat[:, 1] > self.fat[:, 0])
        base = int(self.fat[moved, 0].min()) if moved.any() else len(d)
        body, fat = bytearray(), self.fat.copy()
        for i, (lo, hi) in enumerate(self.fat):
            if lo < table_end and i not in new:
                continue
            one = new.get(i, d[lo:hi])
            fat[i] = base + len(body), base + len(body) + len(one)
            body += one + b"\xff" * (-(len(body) + len(one)) % 4)
        edits = {r["fat_off"]: u32(*fat.ravel()), USED_AT: u32(base + len(body))}
        if banner is not None:
            edits[int(words(d, BANNER_AT, 1)[0])] = banner
        for o in self.overlays:
            if o["fid"] in (comp_sizes or {}):
                edits[o["at"] + 28] = u32(comp_sizes[o["fid"]] | 1 << 24)
        for what, value in (texts or {}).items():
            at, n = TEXTS[what]
            raw = value.encode("ascii")
            if len(raw) > n:
                raise ValueError(f"{what} longer than {n} characters")
            edits[at] = raw.ljust(n, b"\0")
        out = patched(d[:base], edits)
        out = patched(out, {CRC_AT: crc16(out[:CRC_AT]).to_bytes(2, "little")}) + body
        return out.ljust(len(d), b"\xff")


def differing(old: bytes, new: bytes) -> list[int]:
    """File ids whose bytes differ between two images of the same file table."""
    a, b = Cartridge(old), Cartridge(new)
    return [i for i in range(max(len(a.fat), len(b.fat))) if i >= min(len(a.fat), len(b.fat)) or a.read(i) != b.read(i)]


# --- Spark -----------------------------------------------------------------------------------------------------------


def word(content: Column, at: int) -> Column:
    """The little-endian 32-bit word at a fixed place, as a long; null beyond the end."""
    raw = F.substring(content, at + 1, 4)
    return F.when(F.length(raw) == 4, F.conv(F.regexp_replace(F.hex(raw), "^(..)(..)(..)(..)$", "$4$3$2$1"), 16, 10).cast("long"))


def looks_like_cartridge(content: Column) -> Column:
    """Whether the header's name and file tables can be those of an image; JVM only, so that others never reach Python."""
    fnt, fnt_size, fat, fat_size = (word(content, 0x40 + 4 * i) for i in range(4))
    size = F.length(content)
    root = F.conv(F.regexp_replace(F.hex(content.substr((fnt + 5).cast("int"), F.lit(2))), "^(..)(..)$", "$2$1"), 16, 10).cast("int")
    inside = (fnt >= 0x200) & (fnt < size) & (fat >= 0x200) & (fat < size) & (fat_size % 8 == 0) & (fnt_size >= 8) & (fnt_size < 0x100000) & (fat + fat_size <= size)
    return F.coalesce((size >= 0x4000) & inside & (root < ROOT), F.lit(False))


FILES = "array<struct<fid:int,path:string,off:bigint,size:bigint>>"


def files(images: DataFrame, key: str, content: str = "content") -> DataFrame:
    """One row per file of each image: key, fid, path, size, content. Images that do not parse give none.

    Only the tables come from Python; the bytes are sliced in the JVM.
    """

    @F.udf(FILES, useArrow=True)
    def tables(data):
        try:
            return Cartridge(bytes(data)).files()
        except Refused:
            return []

    found = images.where(looks_like_cartridge(F.col(content))).withColumn("__f", F.explode(tables(content)))
    at = found.select(key, "__f.fid", "__f.path", "__f.size", F.col(content).substr((F.col("__f.off") + 1).cast("int"), F.col("__f.size").cast("int")).alias("content"))
    return at


def open_source(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """(source, path, size, content) of a cartridge image, a folder or one file, lazily."""
    if kind == "rom" or kind is None and path.lower().endswith(".nds"):
        images = spark.read.format("binaryFile").load(path).select(F.col("path").alias("source"), "content")
        return files(images, "source").select("source", "path", "size", "content")
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    root = "^file:/*" + path.strip("/") + "/" if kind == "folder" else "^.*/"
    short = F.regexp_replace("path", root, "")
    return df.select(F.lit(path).alias("source"), short.alias("path"), F.col("length").alias("size"), "content")


def changed(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Files that differ or are on one side only; compared by digest, so no content is shuffled."""
    a, b = (df.select(key, "path", F.sha2("content", 256).alias(side)) for df, side in ((before, "old"), (after, "new")))
    return a.join(b, [key, "path"], "full_outer").where(~F.col("old").eqNullSafe(F.col("new")))
