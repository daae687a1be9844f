"""From found items to resources: which tiles, palettes and maps belong together, and repairs of pairs that do not fit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.functions import names as N

from . import ordered as O
from . import pairing as P

#: Kinds that are paired: palettes, tiles, maps of tiles, maps of sprite pieces.
PALETTE, TILES, SCREEN, CELLS = "NCLR", "NCGR", "NSCR", "NCER"
MAPS = (SCREEN, CELLS)


def named(kind):
    """What a map's picture is called."""
    return F.when(kind == SCREEN, "bg").when(kind == CELLS, "cell").otherwise("atlas")


def pair_ordered(items: DataFrame) -> DataFrame:
    """owner, kind, char, pal, map from items (owner, pos, kind, loc) in the order of a container.

    The kind of an owner's first item opens its groups, but one palette in front of all is for all. A map takes the nearest
    tiles before it in its group, or the group's first; a group without a palette has the last one before it, or else
    the next one after it. Tiles that no map takes are an atlas.
    """
    g2d = items.where(F.col("kind").isin(PALETTE, TILES, *MAPS))
    whole = Window.partitionBy("owner").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, palettes = F.first("kind").over(whole), F.count_if(F.col("kind") == PALETTE).over(whole)
    g2d = g2d.withColumn("opener", F.when((first == PALETTE) & (palettes == 1), TILES).otherwise(first))
    g2d = O.segment(g2d, F.col("kind") == F.col("opener"), ["owner"], ["pos"], "part")
    part = Window.partitionBy("owner", "part").orderBy("pos")
    all_ = part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    of = lambda k: F.when(F.col("kind") == k, F.col("loc"))
    so_far = F.last(of(TILES), ignorenulls=True).over(part.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    g2d = g2d.withColumns({"own_pal": F.first(of(PALETTE), ignorenulls=True).over(all_), "char": F.coalesce(so_far, F.first(of(TILES), ignorenulls=True).over(all_))})
    # a group's palette is the same in all its rows, so that the last one before and the next one after are rows' too
    order = Window.partitionBy("owner").orderBy("pos")
    before = F.last("own_pal", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.first("own_pal", ignorenulls=True).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    g2d = g2d.withColumn("pal", F.coalesce("own_pal", before, after)).where("char IS NOT NULL")
    maps = g2d.where(F.col("kind").isin(*MAPS)).select("owner", named(F.col("kind")).alias("kind"), "char", "pal", F.col("loc").alias("map"))
    tiles = g2d.where(F.col("kind") == TILES).select("owner", F.lit("atlas").alias("kind"), F.col("loc").alias("char"), "pal", F.lit(None).cast("string").alias("map"))
    return maps.unionByName(tiles.join(maps.select("owner", "char").distinct(), ["owner", "char"], "left_anti"))


def pair_loose(items: DataFrame) -> DataFrame:
    """dir, kind, char, pal, map from files (path, kind, loc): the same stem in the same folder, or in folders of one kind each.

    Of equal stems and kinds the first path counts, and its least loc. Maps without tiles of their stem take the tiles with the most similar
    one, if that is clear, and their palette; tiles without a palette the most similar palette. Stems of eight hex digits are
    similar to none.
    """
    p = F.col("path")
    rows = items.select("path", "kind", "loc", N.pair_folder(p).alias("dir"), F.lower(N.stem(p)).alias("stem"))
    one = rows.groupBy("dir", "stem", "kind").agg(F.min_by("loc", F.struct("path", "loc")).alias("loc"))
    wide = one.groupBy("dir", "stem").pivot("kind", [PALETTE, TILES, *MAPS]).agg(F.first("loc"))
    fuzzy = ~F.col("stem").rlike("^[0-9a-f]{8}$")
    chars = wide.where(F.col(TILES).isNotNull()).select("dir", F.col("stem").alias("char_stem"), F.col("stem").alias("char_name"))
    homeless = wide.where(F.col(TILES).isNull() & (F.col(SCREEN).isNotNull() | F.col(CELLS).isNotNull()))
    near = P.similar_unique(homeless.where(fuzzy).select("dir", "stem", F.col("stem").alias("name")), "stem", "name", chars, "char_stem", "char_name", 2, ["dir"])
    taken = wide.select("dir", F.col("stem").alias("char_stem"), F.col(TILES).alias("char"), F.col(PALETTE).alias("char_pal"))
    lent = homeless.join(near.select("dir", "stem", "char_stem"), ["dir", "stem"]).join(taken, ["dir", "char_stem"])
    lent = lent.select("dir", "stem", "char", F.coalesce(PALETTE, "char_pal").alias("own_pal"), *MAPS)
    groups = wide.where(F.col(TILES).isNotNull()).select("dir", "stem", F.col(TILES).alias("char"), F.col(PALETTE).alias("own_pal"), *MAPS).unionByName(lent)
    pals = wide.where(F.col(PALETTE).isNotNull()).select("dir", F.col(PALETTE).alias("near_pal"), F.col("stem").alias("pal_name"))
    asks = groups.where(F.col("own_pal").isNull() & fuzzy).select("dir", "stem", F.col("stem").alias("name"))
    near = P.similar_unique(asks, "stem", "name", pals, "near_pal", "pal_name", 2, ["dir"]).select("dir", "stem", "near_pal")
    groups = groups.join(near, ["dir", "stem"], "left").withColumn("pal", F.coalesce("own_pal", "near_pal"))
    made = F.array_compact(F.array(*[F.when(F.col(k).isNotNull(), F.struct(F.lit(n).alias("kind"), F.col(k).alias("map"))) for k, n in ((SCREEN, "bg"), (CELLS, "cell"))]))
    none = F.array(F.struct(F.lit("atlas").alias("kind"), F.lit(None).cast("string").alias("map")))
    return groups.withColumn("m", F.explode(F.when(F.size(made) > 0, made).otherwise(none))).select("dir", "m.kind", "char", "pal", "m.map")


def repair_fits(maps: DataFrame, tiles: DataFrame) -> DataFrame:
    """group, map, char, refit from maps (group, map, pos, need, char) and tiles (group, char, pos, room).

    A map whose tiles have too little room takes those of its own rank, if the group has as many maps as tiles and they
    fit, or else the least that fit, the nearest rank on ties. Maps that fit, and those that nothing fits, keep what they have.
    """
    by = lambda: Window.partitionBy("group").orderBy("pos")
    slots = tiles.select("group", F.col("char").alias("slot"), "room", (F.row_number().over(by()) - 1).alias("slot_rank"), F.count(F.lit(1)).over(Window.partitionBy("group")).alias("slots"))
    own = slots.select("group", F.col("slot").alias("char"), F.col("room").alias("own_room"), "slots")
    rows = maps.withColumns({"rank": F.row_number().over(by()) - 1, "maps": F.count(F.lit(1)).over(Window.partitionBy("group"))}).join(own, ["group", "char"], "left")
    bad = rows.where((F.col("need") > F.col("own_room")) & (F.col("slots") > 1))
    same = bad.where("maps = slots").join(slots.select("group", F.col("slot").alias("ranked"), F.col("room").alias("ranked_room"), F.col("slot_rank").alias("rank")), ["group", "rank"]).where("ranked_room >= need").select("group", "map", "ranked")
    least = P.smallest_fit(bad, "map", "need", slots, "slot", "room", ["group"], "rank", "slot_rank")
    new = bad.select("group", "map").join(same, ["group", "map"], "left").join(least, ["group", "map"], "left").select("group", "map", F.coalesce("ranked", "slot").alias("__new")).where("__new IS NOT NULL")
    done = rows.join(new, ["group", "map"], "left")
    return done.select("group", "map", F.coalesce("__new", "char").alias("char"), F.col("__new").isNotNull().alias("refit"))


def repair_palettes(uses: DataFrame, rows: DataFrame) -> DataFrame:
    """owner, map, pal, repaired from uses (owner, map, pal, row: a palette row that the map uses) and rows (owner, pal, off, row, colours: distinct ones but the first).

    A palette whose used rows all have one colour at most is not the map's: the nearest one, by offset, whose used rows all
    have more takes its place; the earlier on ties.
    """
    used = uses.groupBy("owner", "map", "pal").agg(F.collect_set("row").alias("used"))  # sixteen rows at most
    shown = rows.groupBy("owner", "pal").agg(F.first("off").alias("off"), F.collect_set(F.when(F.col("colours") > 1, F.col("row"))).alias("good"))
    own = used.join(shown, ["owner", "pal"])
    bad = own.where(~F.arrays_overlap("used", "good"))
    # candidates are looked up by the whole set of rows that must be good: of sixteen rows there are few sets in a container
    sets = bad.select("owner", F.array_sort("used").alias("used")).distinct()
    able = sets.join(shown, "owner").where(F.size(F.array_except("used", "good")) == 0).select("owner", "used", F.col("pal").alias("new"), F.col("off").alias("place"))
    best = P.nearest(bad.select("owner", F.array_sort("used").alias("used"), "map", "off"), "map", "off", able, "new", "place", ["owner", "used"])
    done = used.select("owner", "map", "pal").join(best.select("owner", "map", "new"), ["owner", "map"], "left")
    return done.select("owner", "map", F.coalesce("new", "pal").alias("pal"), F.col("new").isNotNull().alias("repaired"))


def link_tables(rows: DataFrame, needs: DataFrame, rooms: DataFrame, least: int = 8) -> DataFrame:
    """table, tested, fitting, accepted: whether a table of rows (table, row, target) links map `row` to tiles `target` (needs: row, need; rooms: target, room).

    A reading is accepted if `least` rows or more can be tested and half of them fit.
    """
    both = rows.join(needs, "row").join(rooms, "target")
    told = both.groupBy("table").agg(F.count(F.lit(1)).alias("tested"), F.count_if(F.col("need") <= F.col("room")).alias("fitting"))
    return told.withColumn("accepted", (F.col("tested") >= least) & (2 * F.col("fitting") >= F.col("tested")))


def texture_palette(textures: DataFrame, palettes: DataFrame) -> DataFrame:
    """model, tex, pal from textures (model, idx, tex) and palettes (model, idx, pal): named after the texture, else of its index, else the first."""
    named_ = palettes.select("model", F.regexp_replace("pal", "_pl$", "").alias("tex"), F.col("pal").alias("by_name")).where(F.col("by_name").endswith("_pl")).groupBy("model", "tex").agg(F.min("by_name").alias("by_name"))
    at = palettes.select("model", "idx", F.col("pal").alias("by_idx"))
    first = palettes.groupBy("model").agg(F.min_by("pal", "idx").alias("first"))
    df = textures.join(named_, ["model", "tex"], "left").join(at, ["model", "idx"], "left").join(first, "model", "left")
    return df.select("model", "tex", F.coalesce("by_name", "by_idx", "first").alias("pal"))


def screen_archives(members: DataFrame) -> DataFrame:
    """archive, hits, live, accepted from members (archive, size, screen): most are maps, and maps share a few sizes."""
    live = members.where("size > 0").groupBy("archive").agg(F.count(F.lit(1)).alias("live"), F.count_if("screen").alias("hits"), F.count_distinct("size").alias("sizes"))
    return live.select("archive", "hits", "live", ((F.col("hits") > 0) & (2 * F.col("hits") >= F.col("live")) & (F.col("sizes") <= 0.1 * F.col("live"))).alias("accepted"))


def siblings(files: DataFrame) -> DataFrame:
    """path, other: files of the same folder and stem."""
    p = F.col("path")
    rows = files.select("path", N.folder(p).alias("dir"), F.regexp_replace(N.file_name(p), r"(?<=.)\.[^.]*$", "").alias("stem"))
    return rows.join(rows.withColumnRenamed("path", "other"), ["dir", "stem"]).where("path <> other").select("path", "other")


def numbered(resources: DataFrame, phase: str, path: str, pos: str) -> DataFrame:
    """Resources with ids in the order of the scan: rows are range-sorted and each partition counts on from those before it."""
    from pyspark.sql import types as T

    ordered = resources.repartitionByRange(phase, path, pos).sortWithinPartitions(phase, path, pos).withColumn("__p", F.spark_partition_id()).withColumn("__n", F.monotonically_increasing_id())
    starts = ordered.groupBy("__p").agg(F.count(F.lit(1)).alias("n"), F.min("__n").alias("least"))
    upto = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("__p", (F.coalesce(F.sum("n").over(upto), F.lit(0)) - F.col("least")).alias("__add"))
    return ordered.join(F.broadcast(starts), "__p").withColumn("id", (F.col("__n") + F.col("__add")).cast(T.LongType())).drop("__p", "__n", "__add")


def health(resources: DataFrame, files: DataFrame, misfits: int = 0) -> DataFrame:
    """integrity, g2d, g3d, identified in per cent: resources (kind, pal) without the banner; files (covered, candidate)."""
    gfx = resources.where("kind <> 'banner'")
    ok = F.count_if((F.col("kind") != "raw_screen") & (F.col("pal").isNotNull() | F.col("kind").isin("tex", "bitmap", "photo", "font")))
    n, tex = F.count(F.lit(1)), F.count_if(F.col("kind") == "tex")
    per = lambda x: x * 100.0 / n
    made = gfx.agg(per(F.greatest(F.lit(0), ok - misfits)).alias("integrity"), per(n - tex).alias("g2d"), per(tex).alias("g3d"))
    known = files.agg(F.least(F.lit(100.0), F.count_if("covered") * 100.0 / F.greatest(F.lit(1), F.count_if(F.col("covered") | F.col("candidate")))).alias("identified"))
    return made.crossJoin(known)  # one row each
