"""Named queries on the driver's tables, each with the SQL it is checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphmill.operators import ordered as O
from glyphmill.operators import pairing as P
from glyphmill.sources.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str):
    def add(fn):
        QUERIES[fn.__name__] = fn
        ORACLES[fn.__name__] = oracle
        return fn

    return add


def reason(text: str, chars: str):
    """Why nothing points into a document."""
    return F.when(F.col(chars) < 64, "tiny").when(F.col(text).contains("|"), "table").when(F.col(text).contains("\n"), "lines").otherwise("unknown")


REASON = "CASE WHEN n_chars < 64 THEN 'tiny' WHEN contains(text, '|') THEN 'table' WHEN contains(text, chr(10)) THEN 'lines' ELSE 'unknown' END"


@query(f"SELECT doc_id, n_chars, {REASON} AS reason, n_chars >= 64 AS candidate FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def coverage_gap(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", "doc_id", "n_chars", "text")
    gap = P.uncovered(docs, table(spark, d, "labels", "doc_id"), "doc_id")
    return gap.select("doc_id", "n_chars", reason("text", "n_chars").alias("reason"), (F.col("n_chars") >= 64).alias("candidate")).orderBy(F.desc("n_chars"), "doc_id")


@query("SELECT count(*) AS files, count(*) FILTER (has) AS covered, count(*) FILTER (NOT has AND n_chars >= 64) AS candidates, CAST(coalesce(sum(n_chars) FILTER (NOT has), 0) AS BIGINT) AS unknown_chars FROM (SELECT n_chars, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) AS has FROM documents d)")
def coverage_totals(spark, d):
    marked = table(spark, d, "documents", "doc_id", "n_chars").join(table(spark, d, "labels", "doc_id").distinct().withColumn("has", F.lit(True)), "doc_id", "left")
    has = F.coalesce("has", F.lit(False))
    return marked.agg(F.count(F.lit(1)).alias("files"), F.count_if(has).alias("covered"), F.count_if(~has & (F.col("n_chars") >= 64)).alias("candidates"), F.coalesce(F.sum(F.when(~has, F.col("n_chars"))), F.lit(0)).alias("unknown_chars"))


@query("SELECT event_type, count(*) AS n, count(*) FILTER (value IS NULL) AS without_value FROM events GROUP BY event_type")
def kind_counts(spark, d):
    return table(spark, d, "events", "event_type", "value").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value").isNull()).alias("without_value"))


@query("SELECT event_type, event_id, CAST(rank AS INTEGER) AS rank FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rank FROM events) WHERE rank <= 3")
def per_kind_limit(spark, d):
    return O.top_per_key(table(spark, d, "events", "event_type", "event_id"), ["event_type"], ["event_id"], 3)


@query("SELECT event_id, event_type FROM events ORDER BY event_id LIMIT 25")
def first_overall(spark, d):
    return table(spark, d, "events", "event_id", "event_type").orderBy("event_id").limit(25)


@query("SELECT lang, source, n, CAST(rank AS INTEGER) AS rank FROM (SELECT lang, source, n, row_number() OVER (PARTITION BY lang ORDER BY n DESC, source) AS rank FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source)) WHERE rank <= 12")
def ext_topk(spark, d):
    counts = table(spark, d, "documents", "lang", "source").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    return O.top_per_key(counts, ["lang"], [F.desc("n"), "source"], 12)


@query("SELECT lang, source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars, CAST(grouping(lang) * 2 + grouping(source) AS BIGINT) AS level FROM documents GROUP BY CUBE (lang, source)")
def stats_cube(spark, d):
    return table(spark, d, "documents", "lang", "source", "n_chars").cube("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"), F.grouping_id().cast("long").alias("level"))


@query("SELECT lang, source, count(*) AS n, max(n_chars) AS longest FROM documents GROUP BY ROLLUP (lang, source)")
def stats_rollup(spark, d):
    return table(spark, d, "documents", "lang", "source", "n_chars").rollup("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.max("n_chars").alias("longest"))


@query("SELECT user_id, event_id, greatest(CAST(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT), 1) AS segment FROM events")
def group_opener(spark, d):
    ev = table(spark, d, "events", "user_id", "event_id", "ts", "event_type")
    return O.segment(ev, F.col("event_type") == "signup", ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "segment")


@query("SELECT event_id, last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_view FROM events")
def nearest_preceding(spark, d):
    ev = table(spark, d, "events", "user_id", "event_id", "ts", "event_type")
    return ev.select("event_id", O.carry_forward(F.when(F.col("event_type") == "view", F.col("event_id")), ["user_id"], ["ts", "event_id"]).alias("last_view"))


@query("SELECT event_id, first_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next_purchase FROM events")
def borrow_next(spark, d):
    ev = table(spark, d, "events", "user_id", "event_id", "ts", "event_type")
    back = O.carry_forward(F.when(F.col("event_type") == "purchase", F.col("event_id")), ["user_id"], [F.desc("ts"), F.desc("event_id")])
    return ev.select("event_id", back.alias("next_purchase"))


@query("SELECT event_id, (SELECT max_by(o_orderkey, row(o_orderdate, o_orderkey)) FROM orders WHERE o_custkey = e.user_id AND o_orderdate <= e.ts) AS order_key FROM events e")
def asof_lookup(spark, d):
    ev = table(spark, d, "events", "event_id", "user_id", "ts")
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("order_key"))
    return P.as_of(ev, orders, ["user_id"], "ts", ["order_key"]).select("event_id", "order_key")


@query("SELECT l_orderkey, l_linenumber, CAST(coalesce(sum(ceil(l_quantity / 16) * 16) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first FROM lineitem")
def aligned_offsets(spark, d):
    li = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_quantity")
    return li.select("l_orderkey", "l_linenumber", O.aligned_offset(F.col("l_quantity"), 16, ["l_orderkey"], ["l_linenumber", "l_quantity"]).alias("first"))


@query("SELECT user_id, bool_and(back IS NULL OR value >= back) AS monotone, count(*) AS n FROM (SELECT user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS back FROM events) GROUP BY user_id")
def monotone_check(spark, d):
    return O.monotone(table(spark, d, "events", "user_id", "event_id", "ts", "value"), F.col("value"), ["user_id"], ["ts", "event_id"])


@query("SELECT o_custkey, o_orderkey, lead(o_orderkey, 1, 9999999) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - o_orderkey AS size FROM orders")
def slot_sizes(spark, d):
    o = table(spark, d, "orders", "o_custkey", "o_orderkey")
    return o.select("o_custkey", "o_orderkey", O.slot_size(F.col("o_orderkey"), F.lit(9999999).cast("long"), ["o_custkey"], ["o_orderkey"]).alias("size"))


@query("WITH s AS (SELECT p_size, count(*) AS k FROM part GROUP BY p_size), v AS (SELECT b.p_size - a.p_size AS delta, CAST(sum(a.k * b.k) AS BIGINT) AS votes FROM s a JOIN s b ON b.p_size > a.p_size GROUP BY 1) SELECT delta, votes FROM v ORDER BY votes DESC, delta LIMIT 6")
def base_votes(spark, d):
    # at most 50 sizes exist: votes are counted on the histogram, not on the parts
    sizes = table(spark, d, "part", "p_size").groupBy("p_size").agg(F.count(F.lit(1)).alias("k"))
    a, b = sizes.select(F.col("p_size").alias("x"), F.col("k").alias("kx")), sizes.select(F.col("p_size").alias("y"), F.col("k").alias("ky"))
    votes = a.join(b, F.col("y") > F.col("x")).groupBy((F.col("y") - F.col("x")).alias("delta")).agg(F.sum(F.col("kx") * F.col("ky")).alias("votes"))
    return votes.orderBy(F.desc("votes"), "delta").limit(6)


@query("SELECT p_partkey, fit FROM (SELECT p.p_partkey, (SELECT min(q.p_size) FROM part q WHERE q.p_brand = p.p_brand AND q.p_size > p.p_size) AS fit FROM part p)")
def smallest_fit(spark, d):
    part = table(spark, d, "part", "p_partkey", "p_brand", "p_size")
    sizes = part.select("p_brand", "p_size").distinct()
    nxt = sizes.withColumn("fit", F.lead("p_size").over(Window.partitionBy("p_brand").orderBy("p_size")))
    return part.join(nxt, ["p_brand", "p_size"]).select("p_partkey", "fit")


@query("SELECT p.p_partkey, (SELECT min_by(q.p_partkey, row(abs(q.p_partkey - p.p_partkey), q.p_partkey)) FROM part q WHERE q.p_brand = p.p_brand AND q.p_size >= 25) AS nearest FROM part p")
def nearest_offset(spark, d):
    part = table(spark, d, "part", "p_partkey", "p_brand", "p_size")
    good = F.when(F.col("p_size") >= 25, F.col("p_partkey"))
    before = O.carry_forward(good, ["p_brand"], ["p_partkey"])
    after = O.carry_forward(good, ["p_brand"], [F.desc("p_partkey")])
    near = part.select("p_partkey", before.alias("b"), after.alias("a"))
    pick = F.when(F.col("a").isNull() | (F.col("p_partkey") - F.col("b") <= F.col("a") - F.col("p_partkey")), F.col("b")).otherwise(F.col("a"))
    return near.select("p_partkey", pick.alias("nearest"))


@query("SELECT p_partkey, (SELECT max_by(t, row(length(t), t)) FROM (SELECT DISTINCT split_part(p_type, ' ', 1) AS t FROM part) WHERE starts_with(p.p_type, t)) AS prefix FROM part p")
def prefix_match(spark, d):
    part = table(spark, d, "part", "p_partkey", "p_type")
    heads = part.select(F.split_part("p_type", F.lit(" "), F.lit(1)).alias("prefix")).distinct()
    # prefixes of a text are few: equi-join on them instead of a theta join
    own = part.select("p_partkey", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("p_type"), F.lit(1))), lambda i: F.col("p_type").substr(F.lit(1), i))).alias("prefix"))
    best = own.join(heads, "prefix").groupBy("p_partkey").agg(F.max_by("prefix", F.struct(F.length("prefix"), "prefix")).alias("prefix"))
    return part.select("p_partkey").join(best, "p_partkey", "left")


def _lcp(a: str, b: str) -> str:
    return f"CAST(coalesce(list_max(list_filter(range(1, least(length({a}), length({b})) + 1), lambda i: {a}[1:i] = {b}[1:i])), 0) AS INTEGER)"


@query(
    f"""WITH c AS (SELECT n.n_nationkey, n.n_name, r.n_nationkey AS other, r.n_name AS other_name FROM nation n JOIN nation r ON n.n_regionkey = r.n_regionkey AND n.n_nationkey <> r.n_nationkey),
s AS (SELECT *, {_lcp("n_name", "other_name")} AS lcp, {_lcp("reverse(n_name)", "reverse(other_name)")} AS lcs FROM c),
t AS (SELECT *, lcp + least(lcs, CAST(length(other_name) AS INTEGER) - lcp) AS score FROM s),
r AS (SELECT *, row_number() OVER w AS k, lead(score) OVER w AS s2, lead(lcp) OVER w AS l2, count(*) OVER (PARTITION BY n_nationkey) AS n FROM t WINDOW w AS (PARTITION BY n_nationkey ORDER BY score DESC, lcp DESC, other))
SELECT n_nationkey, other, CAST(score AS INTEGER) AS score FROM r WHERE k = 1 AND (n = 1 OR (score >= 2 AND (s2 IS NULL OR NOT (s2 = score AND l2 = lcp))))"""
)
def best_similar_unique(spark, d):
    n = table(spark, d, "nation")
    o = n.select(F.col("n_nationkey").alias("other"), F.col("n_name").alias("other_name"), "n_regionkey")
    c = n.join(o, "n_regionkey").where("n_nationkey <> other")
    score, lcp = P.similarity(F.col("n_name"), F.col("other_name"))
    c = c.select("n_nationkey", "other", score.alias("score"), lcp.alias("lcp"))
    return P.best_unique(c, ["n_nationkey"], "score", "lcp", ["other"], 2).select("n_nationkey", "other", "score")


@query(
    f"""WITH p AS (SELECT p_partkey, p_name || '#' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS stem FROM part), c AS (SELECT p_partkey, stem, s_suppkey, s_name FROM p CROSS JOIN supplier),
s AS (SELECT *, {_lcp("stem", "s_name")} AS lcp, {_lcp("reverse(stem)", "reverse(s_name)")} AS lcs FROM c),
t AS (SELECT *, lcp + least(lcs, CAST(length(s_name) AS INTEGER) - lcp) AS score FROM s),
r AS (SELECT *, row_number() OVER w AS k, lead(score) OVER w AS s2, lead(lcp) OVER w AS l2, count(*) OVER (PARTITION BY p_partkey) AS n FROM t WINDOW w AS (PARTITION BY p_partkey ORDER BY score DESC, lcp DESC, s_suppkey))
SELECT p_partkey, s_suppkey, CAST(score AS INTEGER) AS score FROM r WHERE k = 1 AND (n = 1 OR (score >= 2 AND (s2 IS NULL OR NOT (s2 = score AND l2 = lcp))))"""
)
def similar_supplier(spark, d):
    parts = table(spark, d, "part", "p_partkey", "p_name").select("p_partkey", F.concat("p_name", F.lit("#"), F.lpad(F.col("p_partkey").cast("string"), 9, "0")).alias("stem"))
    return P.similar_unique(parts, "p_partkey", "stem", table(spark, d, "supplier", "s_suppkey", "s_name"), "s_suppkey", "s_name", 2)


@query("WITH e AS (SELECT user_id, event_id, epoch_us(ts) AS lo, epoch_us(ts) + CAST(floor(abs(coalesce(value, 0))) AS BIGINT) * 1000000 + 1 AS hi FROM events) SELECT user_id, bool_or(EXISTS (SELECT 1 FROM e b WHERE b.user_id = e.user_id AND b.event_id <> e.event_id AND b.lo < e.hi AND e.lo < b.hi)) AS overlap, count(*) AS n FROM e GROUP BY user_id")
def interval_overlap(spark, d):
    ev = table(spark, d, "events", "user_id", "event_id", "ts", "value")
    lo = F.unix_micros(F.col("ts").cast("timestamp"))
    spans = ev.select("user_id", "event_id", lo.alias("lo"), (lo + F.floor(F.abs(F.coalesce("value", F.lit(0.0)))) * 1000000 + 1).alias("hi"))
    return P.overlaps(spans, ["user_id"], "lo", "hi", "event_id")


@query("SELECT user_id, first_type, count(*) FILTER (event_type IS DISTINCT FROM first_type) AS conflicts FROM (SELECT user_id, event_type, first_value(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS first_type FROM events) GROUP BY user_id, first_type")
def first_wins_conflicts(spark, d):
    ev = table(spark, d, "events", "user_id", "event_id", "ts", "event_type")
    each = ev.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("k"), F.min(F.struct("ts", "event_id")).alias("at"))
    done = each.groupBy("user_id").agg(F.min_by("event_type", "at").alias("first_type"), F.sum("k").alias("all"), F.min_by("k", "at").alias("same"))
    return done.select("user_id", "first_type", (F.col("all") - F.col("same")).alias("conflicts"))


WIDTHS = (4, 8, 16, 32)


@query(
    f"""WITH w AS (SELECT unnest([{", ".join(map(str, WIDTHS))}]) AS width), e AS (SELECT vec_id, embedding AS v FROM embeddings),
s AS (SELECT vec_id, width, list_sum(list_transform(range(1, len(v) - width + 1), lambda i: floor(abs(CAST(v[i + width] AS DOUBLE) - CAST(v[i] AS DOUBLE)) * 1000000))) / (len(v) - width) AS score FROM e, w),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score, width) AS k FROM s)
SELECT vec_id, width FROM r WHERE k = 1"""
)
def best_width(spark, d):
    e = table(spark, d, "embeddings", "vec_id", "embedding").withColumn("width", F.explode(F.array(*[F.lit(w) for w in WIDTHS])))
    v, n = F.transform("embedding", lambda x: x.cast("double")), F.size("embedding")
    diff = F.transform(F.sequence(F.lit(0), n - F.col("width") - 1), lambda i: F.floor(F.abs(F.get(v, i + F.col("width")) - F.get(v, i)) * 1000000).cast("double"))
    scored = e.select("vec_id", "width", (F.aggregate(diff, F.lit(0.0), lambda a, x: a + x) / (n - F.col("width"))).alias("score"))
    return scored.groupBy("vec_id").agg(F.min_by("width", F.struct("score", "width")).alias("width"))


@query("WITH c AS (SELECT user_id, event_type, count(*) AS score FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER w AS k, lead(score) OVER w AS runner_up FROM c WINDOW w AS (PARTITION BY user_id ORDER BY score, event_type)) SELECT user_id, event_type, score, runner_up, CASE WHEN runner_up IS NULL OR runner_up <= 0 THEN 1.0::DOUBLE ELSE greatest(0.0, least(1.0, CAST(runner_up - score AS DOUBLE) / runner_up)) END AS confidence FROM r WHERE k = 1")
def winner_confidence(spark, d):
    c = table(spark, d, "events", "user_id", "event_type").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("score"))
    return O.winner(c, ["user_id"], "score", ["score", "event_type"])


@query("SELECT label, count(*) AS n, count(*) FILTER (list_min(embedding) = list_max(embedding)) AS constant FROM embeddings GROUP BY label")
def constant_groups(spark, d):
    e = table(spark, d, "embeddings", "label", "embedding")
    return e.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.array_min("embedding") == F.array_max("embedding")).alias("constant"))


@query("SELECT doc_id, md5(text) AS pixel_hash, sha256(text) AS identity FROM documents")
def content_hash(spark, d):
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", F.md5(F.col("text").cast("binary")).alias("pixel_hash"), F.sha2(F.col("text").cast("binary"), 256).alias("identity"))


@query("SELECT sha256(text) AS identity, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1")
def dup_groups(spark, d):
    keyed = table(spark, d, "documents", "doc_id", "text").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("identity"))
    return keyed.groupBy("identity").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first")).where("n > 1")


@query("SELECT source, count(*) AS n, sha256(string_agg(line, chr(10) ORDER BY line)) AS digest FROM (SELECT source, lpad(CAST(doc_id AS VARCHAR), 12, '0') || ':' || md5(text) AS line FROM documents) GROUP BY source")
def folder_digest(spark, d):
    # the digest of a folder needs its sorted list of (name, hash); texts are reduced to hashes first
    lines = table(spark, d, "documents", "doc_id", "source", "text").select("source", F.concat(F.lpad(F.col("doc_id").cast("string"), 12, "0"), F.lit(":"), F.md5(F.col("text").cast("binary"))).alias("line"))
    return lines.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("line")), "\n"), 256).alias("digest"))


@query("SELECT c, count(*) AS n FROM (SELECT unnest(string_split(p_name, '')) AS c FROM part) WHERE c <> '' GROUP BY c")
def byte_histogram(spark, d):
    chars = table(spark, d, "part", "p_name").select(F.explode(F.split("p_name", "")).alias("c")).where("c <> ''")
    return chars.groupBy("c").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS c FROM documents) WHERE c <> '' GROUP BY c")
def text_histogram(spark, d):
    # the first of two aggregations counts inside the tasks: only their distinct characters are shuffled
    chars = table(spark, d, "documents", "text").select(F.explode(F.split("text", "")).alias("c")).where("c <> ''")
    return chars.groupBy("c").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT page_id, tag, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)) AS tag FROM pages) GROUP BY page_id, tag")
def magic_carve(spark, d):
    tags = table(spark, d, "pages", "page_id", "html").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("<([a-z][a-z0-9]*)"), F.lit(1))).alias("tag"))
    return tags.groupBy("page_id", "tag").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT page_id, split_part(url, '/', -1) AS base, min(page_id) OVER (PARTITION BY split_part(url, '/', -1)) AS first_page FROM pages")
def basename_match(spark, d):
    named = table(spark, d, "pages", "page_id", "url").select("page_id", F.element_at(F.split("url", "/"), -1).alias("base"))
    return named.join(named.groupBy("base").agg(F.min("page_id").alias("first_page")), "base").select("page_id", "base", "first_page")


@query("SELECT page_id, url FROM pages WHERE regexp_matches(lower(url), '^https://.*example\\.org/.*[0-9]$')")
def path_glob(spark, d):
    from glyphmill.functions.names import glob_pattern

    return table(spark, d, "pages", "page_id", "url").where(F.lower("url").rlike(glob_pattern("HTTPS://*example.org/*[0-9]")))


@query("SELECT p_partkey, p_partkey & 1023 AS tile, (p_partkey >> 10) & 1 AS hflip, (p_partkey >> 11) & 1 AS vflip, (p_partkey >> 12) & 15 AS subpal, ((p_partkey & 31) << 3) | ((p_partkey & 31) >> 2) AS red, ((p_partkey & 31) * 255) // 31 AS red_scaled FROM part")
def bit_fields(spark, d):
    from glyphmill.functions import bits

    return table(spark, d, "part", "p_partkey").select("p_partkey", *[c.alias(k) for k, c in bits.map_entry(F.col("p_partkey")).items()], bits.five_to_eight(F.col("p_partkey").bitwiseAND(31)).alias("red"), bits.five_to_eight_scaled(F.col("p_partkey").bitwiseAND(31)).alias("red_scaled"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'URGENT' ELSE o_orderpriority END AS o_orderpriority FROM orders")
def refit_upsert(spark, d):
    o = table(spark, d, "orders", "o_orderkey", "o_orderstatus", "o_orderpriority")
    changes = o.where("o_orderstatus = 'O'").select("o_orderkey", F.lit("URGENT").alias("o_orderpriority"))
    return P.upsert(o.select("o_orderkey", "o_orderpriority"), changes, "o_orderkey", ["o_orderpriority"])


@query("WITH p AS (SELECT page_id, string_split(url, '/') AS s FROM pages), a AS (SELECT page_id, unnest(list_transform(range(1, len(s) + 1), lambda i: array_to_string(s[1:i], '/'))) AS folder FROM p) SELECT folder, count(*) AS n FROM a GROUP BY folder")
def ancestor_rollup(spark, d):
    s = F.split("url", "/")
    up = table(spark, d, "pages", "page_id", "url").select(F.explode(F.transform(F.sequence(F.lit(1), F.size(s)), lambda i: F.array_join(F.slice(s, F.lit(1), i), "/"))).alias("folder"))
    return up.groupBy("folder").agg(F.count(F.lit(1)).alias("n"))


@query("WITH a AS (SELECT l_orderkey, l_linenumber, l_quantity AS v FROM lineitem WHERE l_linenumber <= 4), b AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN l_quantity + 1 ELSE l_quantity END AS v FROM lineitem WHERE l_linenumber >= 2) SELECT count(*) FILTER (b.l_orderkey IS NULL) AS only_left, count(*) FILTER (a.l_orderkey IS NULL) AS only_right, count(*) FILTER (a.l_orderkey IS NOT NULL AND b.l_orderkey IS NOT NULL AND a.v IS DISTINCT FROM b.v) AS different, count(*) AS compared FROM a FULL OUTER JOIN b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber")
def verify_equal(spark, d):
    li = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    a = li.where("l_linenumber <= 4").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("v"))
    b = li.where("l_linenumber >= 2").select("l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") == "R", F.col("l_quantity") + 1).otherwise(F.col("l_quantity")).alias("v"))
    return P.differences(a, b, ["l_orderkey", "l_linenumber"], ["v"])


@query("WITH s AS (SELECT l_orderkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 4))) AS DECIMAL(28, 4)) AS total, count(*) AS lines FROM lineitem GROUP BY 1) SELECT o_orderkey, coalesce(lines, 0) AS lines, coalesce(total > CAST(o_totalprice AS DECIMAL(18, 4)), false) AS above FROM orders LEFT JOIN s ON l_orderkey = o_orderkey")
def two_pass_audit(spark, d):
    li = table(spark, d, "lineitem", "l_orderkey", "l_extendedprice")
    sums = li.groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,4)")).alias("total"), F.count(F.lit(1)).alias("lines"))
    o = table(spark, d, "orders", "o_orderkey", "o_totalprice").join(sums, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return o.select("o_orderkey", F.coalesce("lines", F.lit(0)).alias("lines"), F.coalesce(F.col("total") > F.col("o_totalprice").cast("decimal(18,4)"), F.lit(False)).alias("above"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18, 2))) AS DOUBLE) AS sum_qty, CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 4))) AS DOUBLE) AS sum_price FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def pricing_summary(spark, d):
    li = table(spark, d, "lineitem", "l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", "l_shipdate").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("sum_qty"), F.sum(F.col("l_extendedprice").cast("decimal(18,4)")).cast("double").alias("sum_price"))


@query("SELECT kind, count(*) FILTER (ok) AS ok, count(*) FILTER (NOT ok) AS mismatch, count(*) FILTER (ok IS NULL) AS skipped FROM (SELECT event_type AS kind, value >= 50 AS ok FROM events) GROUP BY kind")
def roundtrip_summary(spark, d):
    ev = table(spark, d, "events", "event_type", "value").select(F.col("event_type").alias("kind"), (F.col("value") >= 50).alias("ok"))
    return ev.groupBy("kind").agg(F.count_if("ok").alias("ok"), F.count_if(~F.col("ok")).alias("mismatch"), F.count_if(F.col("ok").isNull()).alias("skipped"))
