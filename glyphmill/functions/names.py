"""Names and paths: globs, extensions, stems, folders that pair, safe file names, locators, reasons, human sizes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_pattern(glob: str) -> str:
    """A case-insensitive glob as a pattern for lower-cased paths; * crosses slashes."""
    out = []
    i, low = 0, glob.lower()
    while i < len(low):
        c = low[i]
        i += 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and (end := low.find("]", i + 1)) > 0:
            body = low[i:end]
            out.append(f"[{'^' + body[1:] if body[0] == '!' else body}]")
            i = end + 1
        else:
            out.append(re.escape(c))
    return f"^{''.join(out)}$"


def matches(path: Column, glob: str) -> Column:
    return F.lower(path).rlike(glob_pattern(glob))


# --- parts of paths ------------------------------------------------------------------------

#: Folders that hold one kind each of the same resources; code that is scanned on request only.
KIND_FOLDERS = ("cell", "character", "colorpalette", "palette", "screen", "anim", "animation", "ncer", "ncgr", "ncbr", "nclr", "nscr", "nanr")
CODE_FOLDERS = ("overlay9/", "overlay7/")


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)/*$", 1)


def folder(path: Column) -> Column:
    """The path without its last part; `.` where there is none."""
    found = F.regexp_extract(path, "^(.*[^/])/+[^/]+/*$", 1)
    return F.when(found == "", ".").otherwise(found)


def stem(path: Column) -> Column:
    """The file's name without packing suffixes and without its extension."""
    name = F.regexp_replace(file_name(path), r"(?i)\.(lz|cmp|z|lz77|l)$", "")
    name = F.regexp_replace(name, r"\.[^.]*$", "")
    return F.regexp_replace(name, "(?i)_(lz|cmp)$", "")


def extension(path: Column) -> Column:
    """The lower-cased extension without closing underscores; `.l` only says that a file is packed; `.ncbr` is `.ncgr`."""
    last = lambda name: F.regexp_replace(F.lower(F.regexp_extract(name, r"[^.]\.*(\.[^.]+)$", 1)), "_+$", "")
    name = file_name(path)
    ext = last(name)
    inner = F.lower(F.regexp_extract(F.regexp_replace(name, r"\.[^.]+$", ""), r"[^.]\.*(\.[^.]+)$", 1))
    ext = F.when(ext == ".l", inner).otherwise(ext)
    return F.when(ext == ".ncbr", ".ncgr").otherwise(ext)


def pair_folder(path: Column) -> Column:
    """The folder whose files belong together: of a folder that holds one kind, the one above."""
    own = folder(path)
    return F.when(F.lower(file_name(own)).isin(*KIND_FOLDERS), folder(own)).otherwise(own)


def is_code(path: Column) -> Column:
    test = F.lit(False)
    for start in CODE_FOLDERS:
        test |= path.startswith(start)
    return test


def named_palette(path: Column, size: Column) -> Column:
    """A file named like a palette, of a palette's size."""
    name = F.lower(F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", ""))
    return name.rlike("^pal[^a-z]|^pal$|^.*_(pal|pl|plt)$") & size.between(32, 1024) & (size % 32 == 0)


def named_tiles(path: Column, size: Column) -> Column:
    name = F.lower(F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", ""))
    return name.endswith("_img") & (size >= 256) & (size % 32 == 0)


def escapes(path: Column) -> Column:
    """Whether a relative path leaves its folder, or is the folder itself."""
    depth = F.aggregate(
        F.filter(F.split(path, "/"), lambda x: (x != "") & (x != ".")),
        F.struct(F.lit(0).alias("now"), F.lit(0).alias("least")),
        lambda a, x: F.struct((a["now"] + F.when(x == "..", -1).otherwise(1)).alias("now"), F.least(a["least"], a["now"] + F.when(x == "..", -1).otherwise(1)).alias("least")),
    )
    return path.startswith("/") | (depth["least"] < 0) | (depth["now"] <= 0)


def png_name(kind: Column, name: Column, tex: Column, ident: Column) -> Column:
    """A safe, unique path below the kind's folder, that ends in the five-digit id."""
    base = F.regexp_replace(F.regexp_replace(name, r'[<>:"\\|?*]', "_"), "@", "_at_")
    return F.concat(kind, F.lit("/"), base, F.when(kind == "tex", F.concat(F.lit("_t"), tex.cast("string"))).otherwise(""), F.lit("_"), number(ident), F.lit(".png"))


def mirrored_png_name(kind: Column, name: Column, source: Column, tex: Column, ident: Column) -> Column:
    """A safe, unique path that follows the folders of the file it came from (source: null for none)."""
    name = F.regexp_replace(name, r"\\", "/")
    own = F.when(F.coalesce(source, F.lit("")).isin("") | name.startswith(source), name).otherwise(F.concat_ws("/", source, name))
    safe = F.regexp_replace(F.regexp_replace(F.regexp_replace(own, r'[<>:"|?*]', "_"), "@", "_at_"), "^/+|/+$", "")
    safe = F.when(safe.startswith("__banner__"), "_banner/icone").otherwise(safe)
    return F.concat(safe, F.when(kind == "tex", F.concat(F.lit("_t"), tex.cast("string"))).otherwise(""), F.lit("__"), kind, F.lit("_"), number(ident), F.lit(".png"))


def number(ident: Column) -> Column:
    """Five digits, or more where the number has more."""
    text = ident.cast("string")
    return F.when(F.length(text) < 5, F.lpad(text, 5, "0")).otherwise(text)


def human_size(n: Column) -> Column:
    step = lambda k: F.format_string("%.1f ", F.bround(n / float(1 << 10 * k), 1))
    return F.when(n < 1 << 10, F.format_string("%d B", n)).when(n < 1 << 20, F.concat(step(1), F.lit("KB"))).when(n < 1 << 30, F.concat(step(2), F.lit("MB"))).otherwise(F.concat(step(3), F.lit("GB")))


# --- locators: arrays of steps `kind:value:value ...` ----------------------------------------


def step_kind(step: Column) -> Column:
    return F.substring_index(step, ":", 1)


def locator_text(loc: Column) -> Column:
    """Kind and first value of each step."""
    return F.when(F.size(loc) > 0, F.array_join(F.transform(loc, lambda s: F.substring_index(s, ":", 2)), " > ")).otherwise("-")


def codecs_of(loc: Column) -> Column:
    part = lambda s, k: F.element_at(F.split(s, ":"), k)
    named = F.transform(loc, lambda s: F.when(step_kind(s) == "codec", part(s, 2)).when((step_kind(s) == "lz") & (F.size(F.split(s, ":")) > 2), F.try_element_at(F.split(s, ":"), F.lit(3))).when(step_kind(s) == "crilayla", "crilayla"))
    found = F.array_compact(named)
    return F.when(F.size(found) > 0, F.array_join(found, ", ")).otherwise("none")


def container_of(loc: Column) -> Column:
    found = F.filter(F.transform(loc, step_kind), lambda k: ~k.isin("file", "codec", "slice", "lz"))
    return F.when(F.size(found) > 0, F.array_join(found, " > ")).otherwise("-")


def resource_file(loc: Column, owner: Column, name: Column) -> Column:
    """The file that a resource lives in, by the first step of its pixels."""
    first = F.get(loc, F.lit(0))
    rest = F.regexp_extract(first, "^[^:]*:(.*)$", 1)
    return F.when(step_kind(first) == "file", rest).when(step_kind(first) == "banner", "(banner)").when(step_kind(first) == "arm", F.concat(F.lit("arm"), rest, F.lit(".bin"))).otherwise(F.coalesce(owner, name))


def locator_key(loc: Column) -> Column:
    """Locators that compare across edits: a stream that fills its file may be found as a codec, and used lengths change."""

    def one(s: Column, i: Column) -> Column:
        part = F.split(s, ":")
        lz = step_kind(s) == "lz"
        return F.when(lz & (i == 1) & (F.get(part, F.lit(1)) == "0"), F.concat(F.lit("codec:"), F.get(part, F.lit(2)))).when(lz, F.array_join(F.slice(part, 1, 3), ":")).otherwise(s)

    return F.array_join(F.transform(loc, one), "/")


# --- reasons -------------------------------------------------------------------------------

#: Extensions of sound and video, and of text.
SOUND = (".sdat", ".adx", ".mods", ".sad", ".strm", ".swav", ".swar", ".sseq", ".sbnk", ".wav", ".mp3", ".mod", ".vx", ".mov", ".moflex", ".mobiclip")
TEXT = (".txt", ".csv", ".xml", ".json", ".htx", ".msg", ".ini")


def reason(path: Column, size: Column) -> Column:
    """Why nothing may have been found in a file: code, sound, text, tiny, or unknown; only the last could hold graphics."""
    ext = F.regexp_replace(F.lower(F.regexp_extract(file_name(path), r"[^.](\.[^.]+)$", 1)), "_+$", "")
    return F.when(is_code(path) | path.startswith("arm"), "code").when(ext.isin(*SOUND), "sound").when(ext.isin(*TEXT), "text").when(size < 64, "tiny").otherwise("unknown")


def diagnosis(container: Column, entries: Column, codecs: Column) -> Column:
    """What is known of a file whose container is read but whose members are not."""
    packed = F.array_sort(F.array_distinct(F.filter(codecs, lambda c: c.isNotNull() & (c != "none"))))
    return F.concat(F.lit("container "), container, F.lit(" of "), entries.cast("string"), F.lit(" members, packed: "), F.when(F.size(packed) > 0, F.array_join(packed, " + ")).otherwise("no"))
