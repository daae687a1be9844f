"""Line dedup: a suffix array over line-id sequences by distributed prefix doubling.

Lines are numbered by rank: first by their content (md5), then, level by level, the rank of 2^(k+1) lines
from a position comes from the pair of ranks of its two halves. Ranks are made by range-sorting
the distinct pairs, so they keep the suffixes' order; suffixes whose prefix is unique leave the
array, as no run through them repeats. A run of consecutive lines qualifies if it holds MIN_WORDS words or
more. For each position the shortest qualifying run from it, and the shortest up to it, is an interval of the
suffix array by the ranks of two overlapping prefixes; the interval's least position is the first
copy and all others are later copies, whose lines are deleted. Every maximal repeated run that
qualifies is the union of such runs, so that exactly its later copies go, whole.

Defined cases: positions are ordered by document id (null first), then the text's md5, then line; rows with equal id and text are one
document and each gets its result; a null text stays null; blank lines are lines of no words and go
only inside a run; a copy may overlap its source (a line repeated in one text leaves its first); a very long text is
one array of line hashes in its row, and what is computed from it are rows; other columns are passed through, also those
named like this module's own; an empty table gives no rows. All of it runs as built-in functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, drop, free_name, settle, spread_join

MIN_WORDS = 51
NO_ID = -(1 << 63)
KEY = ["did", "th"]
#: Rows that a task of the window steps takes at about most, whatever their compressed size.
TASK_ROWS = 200_000


def identity(key: str, text: str) -> list:
    return [F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(NO_ID)).alias("did"), F.unhex(F.md5(F.col(f"`{text}`").cast("binary"))).alias("th")]


def hashed_lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """did, th, d (a number of the row) and each line's content hash h and number of words w: all that is read of the texts, once."""
    lines = F.split(F.col(f"`{text}`"), "\n", -1)
    each = F.transform(lines, lambda x: F.struct(F.unhex(F.md5(x.cast("binary"))).alias("h"), F.size(F.regexp_extract_all(x, F.lit("[^ \\t-\\r]+"), F.lit(0))).alias("w")))
    return settle(docs.where(F.col(f"`{text}`").isNotNull()).select(*identity(key, text), F.monotonically_increasing_id().alias("d"), each.alias("lines")), "lines-texts")


def documents_in_order(texts: DataFrame) -> DataFrame:
    """d and o of one row of each document: o is in the order of did and th."""
    one = settle(texts.groupBy(*KEY).agg(F.min("d").alias("d")), "lines-documents")
    return settle(one.repartitionByRange(*KEY).sortWithinPartitions(*KEY).withColumn("o", F.monotonically_increasing_id()), "lines-order")


def ranked(rows: DataFrame, key: str, name: str) -> DataFrame:
    """Rows whose `key` repeats, with its order-keeping rank r in the key's stead."""
    groups = settle(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), f"{name}-groups")
    ranks = settle(groups.repartitionByRange(key).sortWithinPartitions(key).withColumn("r", F.monotonically_increasing_id()), f"{name}-ranks")
    done = settle(spread_join(rows, ranks, key).where("r IS NOT NULL").drop(key, "n"), name)
    drop(groups, ranks)
    return done


def windows(rows: DataFrame, min_words: int) -> DataFrame:
    """o, s, len of the shortest qualifying runs from and up to each position, inside stretches of repeated lines."""
    rows = rows.select("o", "i", F.col("w").cast("long").alias("w")).repartition(max(1, -(-rows.count() // TASK_ROWS)), "o")
    rows = rows.withColumn("isle", F.col("i") - F.row_number().over(Window.partitionBy("o").orderBy("i")))
    inside = Window.partitionBy("o", "isle").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("upto", F.sum("w").over(inside)).withColumn("before", F.col("upto") - F.col("w"))
    null = F.lit(None).cast("int")

    def passed(point: str, question, order: list) -> DataFrame:
        """For each row's question the last point before it, by one running pass over points and questions."""
        both = F.array(F.struct(F.col(point).alias("v"), F.lit(0).alias("ask"), F.col("i").alias("p")), F.struct(question.alias("v"), F.lit(1).alias("ask"), null.alias("p")))
        each = rows.select("o", "isle", F.col("i").alias("at"), F.explode(both).alias("x")).select("o", "isle", "at", "x.*")
        over = Window.partitionBy("o", "isle").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return each.withColumn("p", F.last("p", True).over(over)).where("ask = 1 AND p IS NOT NULL")

    # from i: the least end e with upto(e) >= before(i) + min_words; up to i: the greatest start s with before(s) <= upto(i) - min_words
    forward = passed("upto", F.col("before") + min_words, [F.desc("v"), "ask", F.desc("at")]).select("o", F.col("at").alias("s"), (F.col("p") - F.col("at") + 1).alias("len"))
    back = passed("before", F.col("upto") - min_words, ["v", "ask", "at"]).select("o", F.col("p").alias("s"), (F.col("at") - F.col("p") + 1).alias("len"))
    return forward.unionByName(back).distinct()


def later_copies(texts: DataFrame, order: DataFrame, *, min_words: int) -> DataFrame:
    """o, s, len of the qualifying runs that have an earlier copy."""
    rows = texts.select("d", F.posexplode("lines").alias("i", "line")).select("d", "i", F.col("line.h").alias("h"), F.col("line.w").alias("w"))
    first = ranked(rows, "h", "lines-first")
    level = settle(first.join(order.select("d", "o"), "d").drop("d"), "lines-0")  # of equal rows one is left
    drop(first)
    runs = settle(windows(level, min_words), "lines-runs")
    longest = runs.agg(F.max("len")).first()[0] or 0
    found, k = None, 0
    level_, level = level, level.drop("w")
    while (1 << k) <= longest:
        half = 1 << k
        own = runs.where((F.col("len") >= half) & (F.col("len") < 2 * half))
        a = level.select("o", F.col("i").alias("s"), F.col("r").alias("ra"))
        b = level.select("o", F.col("i").alias("s2"), F.col("r").alias("rb"))
        own = own.withColumn("s2", F.col("s") + F.col("len") - half).join(a, ["o", "s"]).join(b, ["o", "s2"])
        own = settle(own.select("o", "s", "len", F.struct("len", "ra", "rb").alias("interval")), f"lines-own-{k}")
        groups = own.groupBy("interval").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("o", "s")).alias("first")).where("n > 1")
        groups = settle(groups, f"lines-intervals-{k}")
        hit = spread_join(own, groups, "interval").where("n IS NOT NULL AND struct(o, s) <> first").select("o", "s", "len")
        hit = settle(hit, f"lines-copies-{k}")
        drop(own, groups)
        found = hit if found is None else found.unionByName(hit)
        if 2 * half <= longest:
            c = level.select("o", (F.col("i") - half).alias("i"), F.col("r").alias("rb"))
            pair = level.withColumnRenamed("r", "ra").join(c, ["o", "i"]).select("o", "i", F.struct("ra", "rb").alias("pair"))
            pair = settle(pair, f"lines-pairs-{k}")
            drop(level_)
            level = level_ = ranked(pair, "pair", f"lines-{k + 1}")
            drop(pair)
        k += 1
    drop(level_)
    return found if found is not None else runs


def deletions(copies: DataFrame) -> DataFrame:
    """o and the sorted, disjoint stretches (s, len) of deleted lines: runs that overlap or touch are one."""
    by_start = Window.partitionBy("o").orderBy("s")
    spans = copies.groupBy("o", "s").agg(F.max(F.col("s") + F.col("len")).alias("e"))
    spans = spans.withColumn("reach", F.max("e").over(by_start.rowsBetween(Window.unboundedPreceding, -1)))
    spans = spans.withColumn("no", F.count_if(F.col("reach").isNull() | (F.col("s") > F.col("reach"))).over(by_start.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    parts = spans.groupBy("o", "no").agg(F.min("s").alias("s"), (F.max("e") - F.min("s")).cast("int").alias("len"))
    return parts.groupBy("o").agg(F.array_sort(F.collect_list(F.struct("s", "len"))).alias("gone"))


def mark(docs: DataFrame, *, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> tuple[DataFrame, str]:
    """docs with a struct (clean text, n_lines, n_deleted), and the struct's name."""
    name = free_name("lines", docs.columns)
    texts = hashed_lines(docs, key, text)
    order = documents_in_order(texts)
    cut = deletions(later_copies(texts, order, min_words=min_words))
    gone = settle(cut.join(order, "o").select(*KEY, "gone"), "lines-gone")
    drop(texts, order)
    rows, parts = gone.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("gone")), F.lit(0))).first()
    if 40 * rows + 8 * parts <= BROADCAST_BYTES:  # else texts with their id and md5 are shuffled once
        gone = F.broadcast(gone)
    did, th = identity(key, text)
    d, t, g = (free_name(x, [*docs.columns, name]) for x in ("__did", "__th", "__gone"))
    df = docs.withColumns({d: did, t: F.coalesce(th, F.lit(b""))})
    df = df.join(gone.select(F.col("did").alias(d), F.col("th").alias(t), F.col("gone").alias(g)), [d, t], "left")
    lines, cut = F.split(F.col(f"`{text}`"), "\n", -1), F.col(f"`{g}`")
    n = F.size(lines)
    # the kept stretches lie between the deleted ones
    bounds = F.concat(F.array(F.lit(0)), F.flatten(F.transform(cut, lambda x: F.array(x["s"], x["s"] + x["len"]))), F.array(n))
    kept = F.flatten(F.transform(F.sequence(F.lit(0), F.size(cut)), lambda k: F.slice(lines, F.get(bounds, 2 * k) + 1, F.get(bounds, 2 * k + 1) - F.get(bounds, 2 * k))))
    deleted = F.coalesce(F.aggregate(F.transform(cut, lambda x: x["len"]), F.lit(0), lambda a, x: a + x), F.lit(0))
    clean = F.when(cut.isNull(), F.col(f"`{text}`")).otherwise(F.array_join(kept, "\n"))
    out = F.struct(clean.alias("text"), F.when(F.col(f"`{text}`").isNull(), 0).otherwise(n).cast("long").alias("n_lines"), deleted.cast("long").alias("n_deleted"))
    return df.select(*[F.col(f"`{c}`") for c in docs.columns], out.alias(name)), name


def dedup(docs: DataFrame, *, text: str = "text", **options) -> DataFrame:
    """The documents with their own columns and the later copies' lines deleted; a document that had words and has none left goes."""
    df, name = mark(docs, text=text, **options)
    clean = F.col(f"`{name}`.text")
    left = df.where(~((F.col(f"`{name}`.n_deleted") > 0) & ~F.coalesce(clean, F.lit("")).rlike("[^ \\t-\\r]")))
    own = {text: clean}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.when(F.col(f"`{name}`.n_deleted") > 0, F.length(clean).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return left.select(*[own[c].alias(c) if c in own else F.col(f"`{c}`") for c in docs.columns])


def op6(spark, sf_dir: str) -> DataFrame:
    df, name = mark(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    clean = F.col(f"{name}.text")
    return df.select("doc_id", F.col(f"{name}.n_lines").alias("n_lines"), F.col(f"{name}.n_deleted").alias("n_deleted"), F.sha2(F.coalesce(clean, F.lit("")), 256).alias("text_sha256"))


OP6_SQL = f"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, l, list_transform(l, lambda x: len(regexp_extract_all(x, '[^ \\t-\\r]+'))) AS n FROM d),
p AS (SELECT doc_id, l, n, unnest(range(1, len(l) + 1)) AS i FROM w),
q AS (
  SELECT doc_id, l, i AS s, list_min(list_filter(range(i, len(l) + 1), lambda e: list_sum(n[i:e]) >= {MIN_WORDS})) AS e FROM p
  UNION
  SELECT doc_id, l, list_max(list_filter(range(1, i + 1), lambda s: list_sum(n[s:i]) >= {MIN_WORDS})) AS s, i AS e FROM p),
k AS (SELECT doc_id, s, e, row_number() OVER (PARTITION BY l[s:e] ORDER BY doc_id, s) AS copy FROM q WHERE s IS NOT NULL AND e IS NOT NULL),
g AS (SELECT DISTINCT doc_id, unnest(range(s, e + 1)) AS i FROM k WHERE copy > 1),
a AS (SELECT doc_id, list(i) AS gone FROM g GROUP BY doc_id)
SELECT x.doc_id, CAST(coalesce(len(l), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_deleted,
  sha256(coalesce(CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_filter(l, lambda v, j: NOT list_contains(gone, j)), chr(10)) END, '')) AS text_sha256
FROM (SELECT documents.doc_id, documents.text, d.l FROM documents LEFT JOIN d ON d.doc_id = documents.doc_id) x LEFT JOIN a ON a.doc_id = x.doc_id
"""
