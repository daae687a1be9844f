"""Queries that pair, repair and measure items made from the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from glyphmill.operators import pairing as P
from glyphmill.operators import resources as R
from glyphmill.sources.tables import table

from .catalogue import query

KINDS = ("NCLR", "NCGR", "NSCR", "NCER", "NANR")
EVENT_KIND = "CASE event_type WHEN 'signup' THEN 'NCLR' WHEN 'view' THEN 'NCGR' WHEN 'error' THEN 'NSCR' WHEN 'click' THEN 'NCER' ELSE 'NANR' END"


def event_items(spark, d):
    kind = F.col("event_type")
    kind = F.when(kind == "signup", "NCLR").when(kind == "view", "NCGR").when(kind == "error", "NSCR").when(kind == "click", "NCER").otherwise("NANR")
    return table(spark, d, "events", "event_id", "user_id", "event_type").select(F.col("user_id").alias("owner"), F.col("event_id").alias("pos"), kind.alias("kind"), F.col("event_id").cast("string").alias("loc"))


@query(f"""WITH i AS (SELECT user_id AS owner, event_id AS pos, {EVENT_KIND} AS kind, CAST(event_id AS VARCHAR) AS loc FROM events),
g AS (SELECT * FROM i WHERE kind <> 'NANR'),
o AS (SELECT owner, CASE WHEN arg_min(kind, pos) = 'NCLR' AND count(*) FILTER (kind = 'NCLR') = 1 THEN 'NCGR' ELSE arg_min(kind, pos) END AS opener FROM g GROUP BY owner),
s AS (SELECT g.*, greatest(1, sum(CASE WHEN kind = opener THEN 1 ELSE 0 END) OVER (PARTITION BY g.owner ORDER BY pos)) AS part FROM g JOIN o ON o.owner = g.owner),
p AS (SELECT owner, part, arg_min(loc, pos) FILTER (kind = 'NCLR') AS own, arg_min(loc, pos) FILTER (kind = 'NCGR') AS first_char FROM s GROUP BY owner, part),
q AS (SELECT owner, part, first_char, coalesce(own, last_value(own IGNORE NULLS) OVER (PARTITION BY owner ORDER BY part ROWS UNBOUNDED PRECEDING),
  first_value(own IGNORE NULLS) OVER (PARTITION BY owner ORDER BY part ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS pal FROM p),
m AS (SELECT s.owner, s.kind, s.loc, q.pal, coalesce(last_value(CASE WHEN kind = 'NCGR' THEN loc END IGNORE NULLS) OVER (PARTITION BY s.owner, s.part ORDER BY pos ROWS UNBOUNDED PRECEDING), first_char) AS char
  FROM s JOIN q ON q.owner = s.owner AND q.part = s.part WHERE first_char IS NOT NULL)
SELECT owner, CASE kind WHEN 'NSCR' THEN 'bg' ELSE 'cell' END AS kind, char, pal, loc AS map FROM m WHERE kind IN ('NSCR', 'NCER')
UNION ALL SELECT owner, 'atlas', loc, pal, NULL FROM m t WHERE kind = 'NCGR' AND NOT EXISTS (SELECT 1 FROM m u WHERE u.kind IN ('NSCR', 'NCER') AND u.owner = t.owner AND u.char = t.loc)""")
def pair_ordered_items(spark, d):
    return R.pair_ordered(event_items(spark, d))


def loose_items(spark, d):
    """Files of a few kinds in folders by brand, some in folders of one kind."""
    parts = table(spark, d, "part", "p_partkey", "p_name", "p_brand", "p_size", "p_type")
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("p_size") % 5 + 1).cast("int"))
    inner = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("/"), F.when(kind == "NCLR", "Palette").when(kind == "NCGR", "Character").otherwise("Screen"))).otherwise("")
    stem = F.when(F.col("p_partkey") % 41 == 0, F.lpad(F.col("p_partkey").cast("string"), 8, "0")).otherwise(F.concat(F.regexp_replace("p_name", " ", ""), (F.col("p_partkey") % 5).cast("string")))
    path = F.concat(F.col("p_type"), F.regexp_replace("p_brand", "#", ""), inner, F.lit("/"), stem, F.lit("."), F.lower(kind))
    return parts.select(path.alias("path"), kind.alias("kind"), F.col("p_partkey").cast("string").alias("loc"))


LCP = "coalesce(list_max(list_filter(range(1, least(length({a}), length({b})) + 1), lambda n: {a}[1:n] = {b}[1:n])), 0)"


def _best(left: str, right: str, out: str) -> str:
    """The clear best of similar names, by all pairs of a folder."""
    lcp, lcs = LCP.format(a="l.stem", b="r.stem"), LCP.format(a="reverse(l.stem)", b="reverse(r.stem)")
    return f"""(SELECT dir, stem, {out} FROM (SELECT *, row_number() OVER (PARTITION BY dir, stem ORDER BY s DESC, h DESC, {out}) AS n, lead(s) OVER (PARTITION BY dir, stem ORDER BY s DESC, h DESC, {out}) AS s2,
      lead(h) OVER (PARTITION BY dir, stem ORDER BY s DESC, h DESC, {out}) AS h2, count(*) OVER (PARTITION BY dir, stem) AS k FROM (
      SELECT l.dir, l.stem, r.{out}, {lcp} AS h, {lcp} + least({lcs}, length(r.stem) - {lcp}) AS s FROM {left} l JOIN {right} r ON r.dir = l.dir WHERE NOT regexp_matches(l.stem, '^[0-9a-f]{{8}}$')))
    WHERE n = 1 AND (k = 1 OR (s >= 2 AND NOT (s2 = s AND h2 = h))))"""


@query(f"""WITH f AS (SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS loc, list_extract({list(KINDS)}, p_size % 5 + 1) AS kind, p_type || replace(p_brand, '#', '') AS dir, p_partkey % 3 = 0 AS inner_,
  lower(CASE WHEN p_partkey % 41 = 0 THEN lpad(CAST(p_partkey AS VARCHAR), 8, '0') ELSE replace(p_name, ' ', '') || p_partkey % 5 END) AS stem,
  CASE WHEN p_partkey % 41 = 0 THEN lpad(CAST(p_partkey AS VARCHAR), 8, '0') ELSE replace(p_name, ' ', '') || p_partkey % 5 END AS raw_stem FROM part),
i AS (SELECT *, dir || CASE WHEN inner_ THEN CASE kind WHEN 'NCLR' THEN '/Palette' WHEN 'NCGR' THEN '/Character' ELSE '/Screen' END ELSE '' END || '/' || raw_stem || '.' || lower(kind) AS path FROM f),
w AS MATERIALIZED (SELECT dir, stem, arg_min(loc, path || chr(1) || loc) FILTER (kind = 'NCLR') AS pal, arg_min(loc, path || chr(1) || loc) FILTER (kind = 'NCGR') AS char, arg_min(loc, path || chr(1) || loc) FILTER (kind = 'NSCR') AS scr, arg_min(loc, path || chr(1) || loc) FILTER (kind = 'NCER') AS cel
  FROM i WHERE kind <> 'NANR' GROUP BY dir, stem),
c AS (SELECT dir, stem, stem AS char_stem FROM w WHERE char IS NOT NULL), h AS (SELECT * FROM w WHERE char IS NULL AND (scr IS NOT NULL OR cel IS NOT NULL)),
n AS {_best('h', 'c', 'char_stem')},
g AS (SELECT dir, stem, char, pal, scr, cel FROM w WHERE char IS NOT NULL UNION ALL
  SELECT h.dir, h.stem, t.char, coalesce(h.pal, t.pal), h.scr, h.cel FROM h JOIN n ON n.dir = h.dir AND n.stem = h.stem JOIN w t ON t.dir = n.dir AND t.stem = n.char_stem),
pp AS (SELECT dir, stem, pal AS near_pal FROM w WHERE pal IS NOT NULL), ga AS (SELECT * FROM g WHERE pal IS NULL),
np AS {_best('ga', 'pp', 'near_pal')},
z AS (SELECT g.dir, g.stem, g.char, coalesce(g.pal, np.near_pal) AS pal, scr, cel FROM g LEFT JOIN np ON np.dir = g.dir AND np.stem = g.stem)
SELECT dir, 'bg' AS kind, char, pal, scr AS map FROM z WHERE scr IS NOT NULL UNION ALL SELECT dir, 'cell', char, pal, cel FROM z WHERE cel IS NOT NULL
UNION ALL SELECT dir, 'atlas', char, pal, NULL FROM z WHERE scr IS NULL AND cel IS NULL""")
def pair_loose_items(spark, d):
    return R.pair_loose(loose_items(spark, d))


@query("""WITH s AS (SELECT s_suppkey AS slot, s_nationkey AS g, CAST(s_suppkey % 7 AS INTEGER) * 10 AS room, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS r, count(*) OVER (PARTITION BY s_nationkey) AS slots FROM supplier),
c AS (SELECT c_custkey AS map, c_nationkey AS g, CAST(c_custkey % 70 AS INTEGER) AS need FROM customer WHERE c_custkey % 9 = 0),
m AS (SELECT c.*, row_number() OVER (PARTITION BY g ORDER BY map) - 1 AS r, count(*) OVER (PARTITION BY g) AS maps FROM c),
o AS (SELECT m.*, f.slot AS char, f.room AS own_room, f.slots FROM m LEFT JOIN (SELECT g, min(slot) AS slot, arg_min(room, slot) AS room, max(slots) AS slots FROM s GROUP BY g) f ON f.g = m.g),
b AS (SELECT * FROM o WHERE need > own_room AND slots > 1),
k AS (SELECT b.g, b.map, s.slot FROM b JOIN s ON s.g = b.g AND s.r = b.r WHERE b.maps = b.slots AND s.room >= b.need),
l AS (SELECT g, map, slot FROM (SELECT b.g, b.map, s.slot, row_number() OVER (PARTITION BY b.g, b.map ORDER BY s.room, abs(s.r - b.r), s.r) AS n FROM b JOIN s ON s.g = b.g AND s.room >= b.need) WHERE n = 1)
SELECT o.g AS nation, o.map, coalesce(k.slot, l.slot, o.char) AS char, k.slot IS NOT NULL OR l.slot IS NOT NULL AS refit FROM o LEFT JOIN k ON k.g = o.g AND k.map = o.map LEFT JOIN l ON l.g = o.g AND l.map = o.map WHERE o.char IS NOT NULL""")
def refit_maps(spark, d):
    """Customers as maps that need room, suppliers of their nation as tiles; at first all take the nation's first."""
    tiles = table(spark, d, "supplier", "s_suppkey", "s_nationkey").select(F.col("s_nationkey").alias("group"), F.col("s_suppkey").alias("char"), F.col("s_suppkey").alias("pos"), ((F.col("s_suppkey") % 7) * 10).cast("int").alias("room"))
    first = tiles.groupBy("group").agg(F.min("char").alias("char"))
    maps = table(spark, d, "customer", "c_custkey", "c_nationkey").where("c_custkey % 9 = 0").select(F.col("c_nationkey").alias("group"), F.col("c_custkey").alias("map"), F.col("c_custkey").alias("pos"), (F.col("c_custkey") % 70).cast("int").alias("need"))
    return R.repair_fits(maps.join(first, "group"), tiles).withColumnRenamed("group", "nation")


@query("""WITH r AS (SELECT s_nationkey AS owner, s_suppkey AS pal, s_suppkey * 3 AS off, CAST(row AS INTEGER) AS row, CAST((s_suppkey * 7 + row * 5) % 4 AS INTEGER) AS colours FROM supplier, range(0, 4) t(row)),
u AS (SELECT c_nationkey AS owner, c_custkey AS map, CAST((c_custkey + k) % 4 AS INTEGER) AS row FROM customer, range(0, 2) t(k) WHERE c_custkey % 5 = 0),
o AS (SELECT DISTINCT u.owner, u.map, f.pal FROM u JOIN (SELECT owner, min(pal) AS pal FROM r GROUP BY owner) f ON f.owner = u.owner),
b AS (SELECT o.* FROM o WHERE NOT EXISTS (SELECT 1 FROM u JOIN r ON r.row = u.row WHERE u.owner = o.owner AND u.map = o.map AND r.owner = o.owner AND r.pal = o.pal AND r.colours > 1)),
c AS (SELECT b.owner, b.map, p.pal, row_number() OVER (PARTITION BY b.owner, b.map ORDER BY abs(p.off - q.off), p.off) AS n FROM b
  JOIN (SELECT DISTINCT owner, pal, off FROM r) q ON q.owner = b.owner AND q.pal = b.pal JOIN (SELECT DISTINCT owner, pal, off FROM r) p ON p.owner = b.owner
  WHERE NOT EXISTS (SELECT 1 FROM u JOIN r ON r.row = u.row WHERE u.owner = b.owner AND u.map = b.map AND r.owner = b.owner AND r.pal = p.pal AND r.colours <= 1))
SELECT o.owner, o.map, coalesce(c.pal, o.pal) AS pal, c.pal IS NOT NULL AS repaired FROM o LEFT JOIN c ON c.owner = o.owner AND c.map = o.map AND c.n = 1""")
def repaired_palettes(spark, d):
    """Suppliers as palettes of four rows with few colours, customers of their nation as maps that use two rows."""
    sup = table(spark, d, "supplier", "s_suppkey", "s_nationkey")
    rows = sup.select(F.col("s_nationkey").alias("owner"), F.col("s_suppkey").alias("pal"), (F.col("s_suppkey") * 3).alias("off"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("row"))
    rows = rows.withColumn("colours", ((F.col("pal") * 7 + F.col("row") * 5) % 4).cast("int"))
    first = rows.groupBy("owner").agg(F.min("pal").alias("pal"))
    maps = table(spark, d, "customer", "c_custkey", "c_nationkey").where("c_custkey % 5 = 0").select(F.col("c_nationkey").alias("owner"), F.col("c_custkey").alias("map"), F.explode(F.array((F.col("c_custkey") % 4).cast("int"), ((F.col("c_custkey") + 1) % 4).cast("int"))).alias("row"))
    return R.repair_palettes(maps.join(first, "owner"), rows)


@query("""WITH t AS (SELECT CAST(l_suppkey % 9 AS INTEGER) AS tab, l_partkey AS row, max(l_quantity) AS q FROM lineitem GROUP BY 1, 2),
b AS (SELECT tab, p_size AS need, CAST(q AS INTEGER) + tab * 3 - 12 AS room FROM t JOIN part ON p_partkey = row)
SELECT tab AS "table", count(*) AS tested, count(*) FILTER (need <= room) AS fitting, count(*) >= 8 AND 2 * count(*) FILTER (need <= room) >= count(*) AS accepted FROM b GROUP BY tab""")
def linked_tables(spark, d):
    """Tables of rows tried as links from parts to tiles: accepted where half of what can be tested fits."""
    li = table(spark, d, "lineitem", "l_suppkey", "l_partkey", "l_quantity").groupBy((F.col("l_suppkey") % 9).cast("int").alias("table"), F.col("l_partkey").alias("row")).agg(F.max("l_quantity").cast("int").alias("q"))
    rows = li.withColumn("target", F.col("q") + F.col("table") * 3 - 12).select("table", "row", "target")
    needs = table(spark, d, "part", "p_partkey", "p_size").select(F.col("p_partkey").alias("row"), F.col("p_size").alias("need"))
    rooms = rows.select("target").distinct().withColumn("room", F.col("target"))
    return R.link_tables(rows, needs, rooms)


@query("""WITH t AS (SELECT o_custkey % 50 AS model, o_orderkey % 6 AS idx, 't' || (o_orderkey % 6) || '_' || (o_custkey % 50 % 3) AS tex FROM orders GROUP BY ALL),
p AS (SELECT o_custkey % 50 AS model, o_orderkey % 4 AS idx, CASE WHEN o_orderkey % 4 = 1 THEN 't5_' || (o_custkey % 50 % 3) || '_pl' ELSE 'p' || (o_orderkey % 4) END AS pal FROM orders WHERE o_custkey % 50 > 3 GROUP BY ALL)
SELECT t.model, t.tex, coalesce(n.pal, i.pal, f.pal) AS pal FROM t LEFT JOIN p n ON n.model = t.model AND n.pal = t.tex || '_pl' LEFT JOIN p i ON i.model = t.model AND i.idx = t.idx
LEFT JOIN (SELECT model, arg_min(pal, idx) AS pal FROM p GROUP BY model) f ON f.model = t.model""")
def texture_palettes(spark, d):
    o = table(spark, d, "orders", "o_orderkey", "o_custkey").withColumn("model", F.col("o_custkey") % 50)
    third = (F.col("model") % 3).cast("string")
    tex = o.select("model", (F.col("o_orderkey") % 6).alias("idx"), F.concat(F.lit("t"), (F.col("o_orderkey") % 6).cast("string"), F.lit("_"), third).alias("tex")).distinct()
    k = F.col("o_orderkey") % 4
    pal = o.where("model > 3").select("model", k.alias("idx"), F.when(k == 1, F.concat(F.lit("t5_"), third, F.lit("_pl"))).otherwise(F.concat(F.lit("p"), k.cast("string"))).alias("pal")).distinct()
    return R.texture_palette(tex, pal)


@query("""SELECT CAST(l_suppkey AS BIGINT) AS archive, count(*) FILTER (l_returnflag <> 'R') AS hits, count(*) AS live,
  count(*) FILTER (l_returnflag <> 'R') > 0 AND 2 * count(*) FILTER (l_returnflag <> 'R') >= count(*) AND count(DISTINCT l_linenumber + CASE WHEN l_suppkey % 2 = 0 THEN l_partkey ELSE 0 END) <= 0.1 * count(*) AS accepted FROM lineitem GROUP BY 1""")
def screen_gates(spark, d):
    """Archives of maps: most members are, and they share a few sizes."""
    li = table(spark, d, "lineitem", "l_suppkey", "l_partkey", "l_linenumber", "l_returnflag")
    size = F.col("l_linenumber") + F.when(F.col("l_suppkey") % 2 == 0, F.col("l_partkey")).otherwise(0)
    return R.screen_archives(li.select(F.col("l_suppkey").alias("archive"), size.alias("size"), (F.col("l_returnflag") != "R").alias("screen")))


@query("""SELECT l_orderkey, bool_or(hit) AS overlap FROM (SELECT a.l_orderkey, b.l_linenumber IS NOT NULL AS hit FROM lineitem a LEFT JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber
  AND a.l_partkey % 100 < b.l_partkey % 100 + b.l_quantity AND b.l_partkey % 100 < a.l_partkey % 100 + a.l_quantity AND a.l_suppkey % 60 < b.l_suppkey % 60 + 16 AND b.l_suppkey % 60 < a.l_suppkey % 60 + 16) GROUP BY l_orderkey""")
def pieces_overlap(spark, d):
    """Order lines as rectangles of a cell."""
    li = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    boxes = li.select("l_orderkey", F.col("l_linenumber").alias("ordinal"), (F.col("l_partkey") % 100).alias("x"), (F.col("l_suppkey") % 60).alias("y"), F.col("l_quantity").alias("w"), F.lit(16).alias("h"))
    return P.rectangles_overlap(boxes, ["l_orderkey"])


@query("""SELECT l_orderkey, min(x) AS x, min(y) AS y, greatest(8, max(x + w) - min(x)) AS w, greatest(8, max(y + 16) - min(y)) AS h, max((l_partkey % 64) * 32 + w * 16) AS need
  FROM (SELECT l_orderkey, l_partkey, l_partkey % 100 AS x, l_suppkey % 60 AS y, CAST(l_quantity AS BIGINT) AS w FROM lineitem) GROUP BY l_orderkey""")
def cell_boxes(spark, d):
    """Bounding boxes of cells, eight by eight at least, and the last byte of tiles that a cell needs."""
    li = table(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_quantity")
    p = li.select("l_orderkey", "l_partkey", (F.col("l_partkey") % 100).alias("x"), (F.col("l_suppkey") % 60).alias("y"), F.col("l_quantity").cast("long").alias("w"))
    eight = F.lit(8).cast("long")
    return p.groupBy("l_orderkey").agg(F.min("x").alias("x"), F.min("y").alias("y"), F.greatest(eight, F.max(F.col("x") + F.col("w")) - F.min("x")).alias("w"), F.greatest(eight, F.max(F.col("y") + 16) - F.min("y")).alias("h"), F.max((F.col("l_partkey") % 64) * 32 + F.col("w") * 16).alias("need"))


@query("""WITH r AS (SELECT DISTINCT l_orderkey, l_partkey % 64 * 64 AS a, l_partkey % 64 * 64 + CAST(l_quantity AS BIGINT) * 8 AS b FROM lineitem)
SELECT l_orderkey, count(*) FILTER (na < b AND (na <> a OR nb <> b)) AS partial FROM (SELECT *, lead(a) OVER (PARTITION BY l_orderkey ORDER BY a, b) AS na, lead(b) OVER (PARTITION BY l_orderkey ORDER BY a, b) AS nb FROM r) GROUP BY l_orderkey""")
def partial_overlaps(spark, d):
    """How many distinct ranges of tile data overlap the next one in part: what a wrong mapping mode shows."""
    li = table(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_quantity")
    r = li.select("l_orderkey", (F.col("l_partkey") % 64 * 64).alias("a"), (F.col("l_partkey") % 64 * 64 + F.col("l_quantity").cast("long") * 8).alias("b")).distinct()
    w = Window.partitionBy("l_orderkey").orderBy("a", "b")
    r = r.withColumns({"na": F.lead("a").over(w), "nb": F.lead("b").over(w)})
    return r.groupBy("l_orderkey").agg(F.count_if((F.col("na") < F.col("b")) & ((F.col("na") != F.col("a")) | (F.col("nb") != F.col("b")))).alias("partial"))


@query("""SELECT a.p_partkey, b.p_partkey AS other FROM (SELECT *, p_type || p_brand AS f, p_name AS s FROM part) a JOIN (SELECT *, p_type || p_brand AS f, p_name AS s FROM part) b ON a.f = b.f AND a.s = b.s AND a.p_partkey <> b.p_partkey""")
def sibling_files(spark, d):
    """Files of the same folder and stem, with other extensions."""
    parts = table(spark, d, "part", "p_partkey", "p_name", "p_brand", "p_type")
    files = parts.select(F.concat_ws("/", F.concat("p_type", "p_brand"), F.concat("p_name", F.lit(".x"), "p_partkey")).alias("path"))
    key = lambda c: F.regexp_extract(c, r"\.x(\d+)$", 1).cast("long")
    return R.siblings(files).select(key("path").alias("p_partkey"), key("other").alias("other"))


@query("""SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_orderstatus, o_orderpriority, o_orderkey) - 1 AS BIGINT) AS id FROM orders""")
def scan_ids(spark, d):
    """Ids in the order of the scan, without one task that sorts all."""
    o = table(spark, d, "orders", "o_orderkey", "o_orderstatus", "o_orderpriority")
    return R.numbered(o, "o_orderstatus", "o_orderpriority", "o_orderkey").select("o_orderkey", "id")


@query("""SELECT greatest(0, count(*) FILTER (kind <> 'raw_screen' AND (pal IS NOT NULL OR kind IN ('tex', 'bitmap', 'photo', 'font'))) - 3) * 100.0 / count(*) AS integrity, (count(*) - count(*) FILTER (kind = 'tex')) * 100.0 / count(*) AS g2d,
  count(*) FILTER (kind = 'tex') * 100.0 / count(*) AS g3d, (SELECT least(100.0, count(*) FILTER (l) * 100.0 / greatest(1, count(*) FILTER (l OR n_chars >= 64))) FROM (SELECT n_chars, EXISTS (SELECT 1 FROM labels x WHERE x.doc_id = d.doc_id) AS l FROM documents d)) AS identified
  FROM (SELECT CASE l_linenumber WHEN 1 THEN 'bg' WHEN 2 THEN 'cell' WHEN 3 THEN 'tex' WHEN 4 THEN 'banner' WHEN 5 THEN 'raw_screen' ELSE 'atlas' END AS kind, CASE WHEN l_tax > 0.02 THEN l_suppkey END AS pal FROM lineitem) WHERE kind <> 'banner'""")
def health_shares(spark, d):
    """Shares of resources that are whole, flat and textures, and of files that are identified."""
    n = F.col("l_linenumber")
    kind = F.when(n == 1, "bg").when(n == 2, "cell").when(n == 3, "tex").when(n == 4, "banner").when(n == 5, "raw_screen").otherwise("atlas")
    res = table(spark, d, "lineitem", "l_linenumber", "l_tax", "l_suppkey").select(kind.alias("kind"), F.when(F.col("l_tax") > 0.02, F.col("l_suppkey")).alias("pal"))
    files = table(spark, d, "documents", "doc_id", "n_chars").join(table(spark, d, "labels", "doc_id").distinct().withColumn("has", F.lit(True)), "doc_id", "left")
    return R.health(res, files.select(F.coalesce("has", F.lit(False)).alias("covered"), (F.col("n_chars") >= 64).alias("candidate")), misfits=3)


@query("""SELECT p_partkey, d.k AS owner FROM (SELECT p_partkey, p_name || (p_partkey % 30) AS n FROM part) p LEFT JOIN LATERAL (SELECT DISTINCT p_name || g AS k FROM part, range(0, 3) t(g) WHERE starts_with(p.n, p_name || g) ORDER BY length(p_name || g) DESC LIMIT 1) d ON true WHERE d.k IS NOT NULL""")
def shared_prefix_tiles(spark, d):
    """Maps that share the tiles whose name is the longest beginning of theirs."""
    parts = table(spark, d, "part", "p_partkey", "p_name")
    maps = parts.select("p_partkey", F.concat("p_name", (F.col("p_partkey") % 30).cast("string")).alias("name"))
    tiles = parts.select("p_name").distinct().select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda g: F.concat("p_name", g.cast("string")))).alias("prefix")).withColumn("owner", F.col("prefix"))
    return P.longest_prefix(maps, "p_partkey", "name", tiles, "owner", "prefix", [])


@query("""SELECT CASE WHEN p_partkey % 3 = 0 THEN 'narc' WHEN p_partkey % 3 = 1 THEN 'loose' ELSE 'raw' END AS mode, p_type AS kind, count(*) AS n FROM part WHERE NOT (p_partkey % 3 = 2 AND EXISTS (SELECT 1 FROM part q WHERE q.p_partkey % 3 = 0 AND q.p_name = part.p_name AND q.p_brand = part.p_brand)) GROUP BY 1, 2""")
def mode_counts(spark, d):
    """Resources of all modes together, without raw ones that a named one has claimed, counted by mode and kind."""
    parts = table(spark, d, "part", "p_partkey", "p_name", "p_brand", "p_type")
    mode = lambda k, name: parts.where(F.col("p_partkey") % 3 == k).withColumn("mode", F.lit(name))
    narc, loose, raw = (mode(k, n) for k, n in enumerate(("narc", "loose", "raw")))
    raw = raw.join(narc.select("p_name", "p_brand").distinct(), ["p_name", "p_brand"], "left_anti")
    return narc.unionByName(loose).unionByName(raw, allowMissingColumns=True).groupBy("mode", F.col("p_type").alias("kind")).agg(F.count(F.lit(1)).alias("n"))

