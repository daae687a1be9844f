"""Entity-resolution joins: left anti coverage, as-of, best unique match, longest prefix, smallest fit, nearest, overlaps, base names, upsert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def uncovered(files: DataFrame, pointers: DataFrame, key: str) -> DataFrame:
    """Rows that nothing points into."""
    return files.join(pointers.select(key).distinct(), key, "left_anti")


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, take: list[str]) -> DataFrame:
    """For each left row the last right row of its keys at or before it, by one sort of both sides; no range join."""
    both = left.withColumns({"__side": F.lit(1), **{f"__{c}": F.lit(None).cast(right.schema[c].dataType) for c in take}}).unionByName(
        right.select(*keys, at, F.lit(0).alias("__side"), *[F.col(c).alias(f"__{c}") for c in take]), allowMissingColumns=True
    )
    w = Window.partitionBy(*keys).orderBy(at, "__side", *[F.col(f"__{c}") for c in take]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    got = F.last(F.when(F.col("__side") == 0, F.struct(*[F.col(f"__{c}").alias(c) for c in take])), ignorenulls=True).over(w)
    return both.withColumn("__got", got).where("__side = 1").select(*left.columns, *[F.col(f"__got.{c}").alias(c) for c in take])


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common prefix."""
    most = F.least(F.length(a), F.length(b))
    same = F.filter(F.sequence(F.lit(1), F.greatest(most, F.lit(1))), lambda i: (i <= most) & (a.substr(F.lit(1), i) == b.substr(F.lit(1), i)))
    return F.coalesce(F.array_max(same), F.lit(0))


def similarity(a: Column, b: Column) -> tuple[Column, Column]:
    """Prefix plus suffix agreement, the suffix not counting what the prefix has; and the prefix alone."""
    head, tail = common_prefix(a, b), common_prefix(F.reverse(a), F.reverse(b))
    return head + F.least(tail, F.length(b) - head), head


def best_unique(df: DataFrame, keys: list[str], score: str, second: str, tie: list, least: int) -> DataFrame:
    """The best candidate if it scores `least` and no other has the same scores; an only candidate in any case."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), F.desc(second), *tie)
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    ranked = df.withColumns({"__r": F.row_number().over(w), "__s": F.lead(score).over(w), "__t": F.lead(second).over(w), "__n": n}).where("__r = 1")
    clear = F.col("__s").isNull() | ~((F.col("__s") == F.col(score)) & (F.col("__t") == F.col(second)))
    return ranked.where((F.col("__n") == 1) | ((F.col(score) >= least) & clear)).drop("__r", "__s", "__t", "__n")


def similar_unique(left: DataFrame, key: str, stem: str, right: DataFrame, other: str, name: str, least: int, within: list[str] = ()) -> DataFrame:
    """within, key, other, score: the rows of best_unique by similarity(stem, name) over all pairs of a group, without the pairs; null names are no candidates.

    A right row is found under each prefix and suffix of its name that do not overlap. A left row looks up its own, with
    prefixes up to the longest that the right side has; under the best key found lie just the rows with the best scores.
    All joins are by sorting: the optimiser takes exploded sides to be as small as their tables, and would broadcast them.
    """
    within = list(within)
    upto = lambda n: F.sequence(F.lit(0), n)
    head = lambda c, i: c.substr(F.lit(1), i)
    tail = lambda c, j: c.substr(F.length(c) - j + 1, j)
    n, s = F.col(name), F.col(stem)
    right = right.where(n.isNotNull())
    one = right.select(*within, other, name, F.explode(upto(F.length(n))).alias("__i"))
    two = one.select(*within, other, name, "__i", F.explode(upto(F.length(n) - F.col("__i"))).alias("__j")).where(F.col("__i") + F.col("__j") >= least)
    found = two.groupBy(*within, head(n, F.col("__i")).alias("__h"), tail(n, F.col("__j")).alias("__t")).agg(F.count(F.lit(1)).alias("__k"), F.min(other).alias(other))
    heads = one.where("__i > 0").select(*within, head(n, F.col("__i")).alias("__h")).distinct()
    own = left.select(*within, key, F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), lambda i: head(s, i))).alias("__h"))
    most = own.hint("merge").join(heads.hint("merge"), [*within, "__h"]).groupBy(*within, key).agg(F.max(F.length("__h")).alias("__most"))
    look = left.hint("merge").join(most.hint("merge"), [*within, key], "left").where(s.isNotNull()).select(*within, key, stem, F.explode(upto(F.coalesce("__most", F.lit(0)))).alias("__i"))
    look = look.select(*within, key, stem, "__i", F.explode(upto(F.length(s))).alias("__j")).where(F.col("__i") + F.col("__j") >= least)
    look = look.select(*within, key, head(s, F.col("__i")).alias("__h"), tail(s, F.col("__j")).alias("__t"), (F.col("__i") + F.col("__j")).alias("score"), "__i")
    best = look.hint("merge").join(found.hint("merge"), [*within, "__h", "__t"]).groupBy(*within, key).agg(F.max_by(F.struct("__k", other, "score"), F.struct("score", "__i")).alias("__b")).where("__b.__k = 1")
    best = best.select(*within, key, f"__b.{other}", "__b.score")
    # an only candidate is taken whatever its score
    only = right.groupBy(*within).agg(F.count(F.lit(1)).alias("__n"), F.min(other).alias(other), F.min(name).alias(name)).where("__n = 1")
    if not within:
        alone = left.where(s.isNotNull()).crossJoin(F.broadcast(only)).select(key, other, similarity(s, n)[0].alias("score"))
        return best.join(F.broadcast(only.select(F.lit(1))), F.lit(True), "left_anti").unionByName(alone)
    alone = left.where(s.isNotNull()).select(*within, key, stem).hint("merge").join(only.hint("merge"), within).select(*within, key, other, similarity(s, n)[0].alias("score"))
    return best.hint("merge").join(only.select(*within).hint("merge"), within, "left_anti").unionByName(alone)


def longest_prefix(left: DataFrame, key: str, name: str, right: DataFrame, other: str, prefix: str, within: list[str], fits: Column | None = None, carry: list[str] = ()) -> DataFrame:
    """within, key, other: for each left row the right row with the longest name that its own begins with and that fits; by keys, not pairs."""
    # names are looked up once each (rows, where a condition asks for more), with prefixes as long as some name on the right. What is
    # exploded is joined by sorting: the optimiser takes it to be as small as the table it was made of, and would broadcast it.
    asked = [*within, name] if fits is None else list(dict.fromkeys([*within, key, name, *carry]))
    sizes = right.select(F.length(prefix).alias("__n")).distinct().agg(F.collect_list("__n").alias("__sizes"))
    names = left.select(*asked).distinct().crossJoin(F.broadcast(sizes))
    own = names.select(*asked, F.explode(F.filter("__sizes", lambda n: n <= F.length(name))).alias("__n")).select(*asked, F.col(name).substr(F.lit(1), F.col("__n")).alias(prefix))
    right = right if fits is not None else right.groupBy(*within, prefix).agg(F.max(other).alias(other))
    hit = own.hint("merge").join(right.hint("merge"), [*within, prefix])
    hit = hit if fits is None else hit.where(fits)
    best = hit.groupBy(*asked).agg(F.max(F.struct(F.length(prefix).alias("n"), F.col(other).alias("o"))).alias("__b"))
    if fits is None:
        best = left.select(*within, key, F.col(name).alias("__name")).hint("merge").join(best.withColumnRenamed(name, "__name"), [*within, "__name"])
    return best.groupBy(*within, key).agg(F.max("__b").alias("__b")).select(*within, key, F.col("__b.o").alias(other))


def smallest_fit(needs: DataFrame, key: str, need: str, slots: DataFrame, slot: str, room: str, within: list[str], rank: str, slot_rank: str) -> DataFrame:
    """within, key, slot: the slot of least room that holds the need; of equal rooms the nearest rank, then the least rank.

    One sort of both sides finds the least room that is enough; only slots of that very room are joined.
    """
    rooms = slots.select(*within, F.col(room).alias("__v")).distinct().withColumn("__ask", F.lit(1))
    asked = needs.select(*within, F.col(need).alias("__v"), key, rank).withColumn("__ask", F.lit(0))
    w = Window.partitionBy(*within).orderBy(F.asc("__v"), F.asc("__ask")).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    both = asked.unionByName(rooms, allowMissingColumns=True).withColumn("__room", F.first(F.when(F.col("__ask") == 1, F.col("__v")), ignorenulls=True).over(w))
    best = both.where("__ask = 0 AND __room IS NOT NULL").select(*within, key, rank, F.col("__room").alias(room))
    hit = best.join(slots.select(*within, slot, room, slot_rank), [*within, room])
    return hit.groupBy(*within, key).agg(F.min(F.struct(F.abs(F.col(rank) - F.col(slot_rank)).alias("d"), F.col(slot_rank).alias("r"), F.col(slot).alias(slot))).alias("__b")).select(*within, key, f"__b.{slot}")


def nearest(left: DataFrame, key: str, at: str, right: DataFrame, other: str, place: str, within: list[str]) -> DataFrame:
    """within, key, other, distance: the nearest right row of the group, the earlier one on ties, by one sort of both sides."""
    marks = right.select(*within, F.col(place).alias("__v"), F.struct(F.col(place), F.col(other)).alias("__r"), F.lit(1).alias("__side"))
    asked = left.select(*within, F.col(at).alias("__v"), F.col(key), F.lit(0).alias("__side"))
    both = asked.unionByName(marks, allowMissingColumns=True)
    before = Window.partitionBy(*within).orderBy(F.asc("__v"), F.desc("__side"), F.desc(F.col(f"__r.{other}"))).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = Window.partitionBy(*within).orderBy(F.asc("__v"), F.asc("__side"), F.asc(F.col(f"__r.{other}"))).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    both = both.withColumns({"__a": F.last("__r", ignorenulls=True).over(before), "__b": F.first("__r", ignorenulls=True).over(after)}).where("__side = 0")
    gap = lambda c: F.abs(F.col("__v") - F.col(f"{c}.{place}"))
    take = F.when(F.col("__b").isNull() | (gap("__a") <= gap("__b")), F.col("__a")).otherwise(F.col("__b"))
    return both.withColumn("__t", take).where("__t IS NOT NULL").select(*within, key, F.col(f"__t.{other}").alias(other), gap("__t").alias("distance"))


def rectangles_overlap(boxes: DataFrame, cell: list[str], ordinal: str = "ordinal", x: str = "x", y: str = "y", w: str = "w", h: str = "h") -> DataFrame:
    """cell, overlap: whether two rectangles of a cell share a point. A cell has at most some hundred pieces (a hardware limit)."""
    a = boxes.select(*cell, *[F.col(c).alias(f"a_{c}") for c in (ordinal, x, y, w, h)])
    b = boxes.select(*cell, *[F.col(c).alias(f"b_{c}") for c in (ordinal, x, y, w, h)])
    meet = lambda p, n: (F.col(f"a_{p}") < F.col(f"b_{p}") + F.col(f"b_{n}")) & (F.col(f"b_{p}") < F.col(f"a_{p}") + F.col(f"a_{n}"))
    hit = a.join(b, cell).where((F.col(f"a_{ordinal}") < F.col(f"b_{ordinal}")) & meet(x, w) & meet(y, h)).select(*cell).distinct().withColumn("overlap", F.lit(True))
    return boxes.select(*cell).distinct().join(hit, cell, "left").withColumn("overlap", F.coalesce("overlap", F.lit(False)))


def by_base_name(files: DataFrame, key: str, name: str, records: DataFrame, record: str, base: str, preferred: Column) -> DataFrame:
    """Each file's record of the same base name, a preferred one first, then the least; files without one are kept."""
    hit = files.join(records, files[name] == records[base], "left")
    w = Window.partitionBy(key).orderBy(F.desc(F.coalesce(preferred, F.lit(False))), F.asc_nulls_last(record))
    return hit.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def overlaps(spans: DataFrame, keys: list[str], lo: str, hi: str, ident: str) -> DataFrame:
    """Whether a span of the group overlaps another, by one sort: a span overlaps an earlier one if it begins before their greatest end."""
    w = Window.partitionBy(*keys).orderBy(lo, hi, ident).rowsBetween(Window.unboundedPreceding, -1)
    hit = F.coalesce(F.col(lo) < F.max(hi).over(w), F.lit(False))
    return spans.withColumn("__hit", hit).groupBy(*keys).agg(F.bool_or("__hit").alias("overlap"), F.count(F.lit(1)).alias("n"))


def upsert(base: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """base with the changed values put in."""
    new = changes.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    merged = base.join(new, key, "left")
    return merged.select(*[F.coalesce(f"__{c}", c).alias(c) if c in columns else F.col(c) for c in base.columns])


def differences(a: DataFrame, b: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Counts of rows on one side only and of rows that differ."""
    x = a.select(*keys, F.struct(*values).alias("va"), F.lit(1).alias("ia"))
    y = b.select(*keys, F.struct(*values).alias("vb"), F.lit(1).alias("ib"))
    both = x.join(y, keys, "full_outer")
    return both.agg(F.count_if(F.col("ib").isNull()).alias("only_left"), F.count_if(F.col("ia").isNull()).alias("only_right"), F.count_if(F.col("ia").isNotNull() & F.col("ib").isNotNull() & ~F.col("va").eqNullSafe(F.col("vb"))).alias("different"), F.count(F.lit(1)).alias("compared"))
