"""MinHash near-dedup by BagMinHash: weighted Jaccard of the multisets of five-word shingles.

Signatures: each shingle with count w runs Poisson processes over the discretised weight levels (0, 1], (1, 2],
(2, 4], (4, 8] ..., thinned in the level where w lies; each of M components keeps its earliest point, so that two
documents agree in a component with the probability of their weighted Jaccard similarity. Processes stop
once they pass the latest of a document's components, so that heavy multisets cost little more.

BANDS bands of ROWS components make candidates; every pair that counts is verified on the multisets
themselves. Exact copies (equal multisets) are one representative from the start. In a bucket each member is
compared with a pivot only, at first the least, then the best connected; members already in one component need no
comparison. What is still unconnected in a bucket after PIVOT_ROUNDS is compared pair by pair, across components
only, so that no link between different texts that share a bucket is lost. Buckets of more than PAIR_ROWS are then cut
to blocks, a file each; a task reads two blocks, counts all overlaps at once, and gives the links of a spanning forest.

Defined cases: words are lower-cased runs of ASCII letters, digits and non-ASCII characters; a text of fewer than five words
has one shingle of all its words; a text of none is alone in its class; null ids count as greatest; rows with equal ids
and texts are in one class, and keep_one keeps one of them; a very long text is a step of its own, and its multiset, six bytes
a word, a value of its row; other columns are passed through, whatever they are called; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import files
from .common import BROADCAST_BYTES, annotate, drop, free_name, settle, spread_join, work_dir
from .components import components
from .text import ALNUM, mix, words

SHINGLE = 5
BANDS, ROWS = 20, 3
M = BANDS * ROWS
#: 5 * overlap >= 4 * union: a similarity of 0.8 or more.
NUM, DEN = 4, 5
PIVOT_ROUNDS = 2
#: Buckets up to this size are compared by rows of pairs, larger ones by blocks of about BLOCK_ROWS members.
PAIR_ROWS, BLOCK_ROWS = 48, 256
#: Pairs of blocks that a task compares at about most.
BLOCK_PAIRS = 8
#: Distinct elements that are held at a time as a dense matrix.
COLUMNS = 8192
#: Text bytes that signatures are made of at a time: each word takes some hundred bytes meanwhile.
STEP = 1 << 20
#: Candidates up to this many are sent to all tasks as a list of 16-byte keys; more are joined by shuffle.
BROADCAST_KEYS = 1_000_000
U = np.uint64


def shingles(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """48-bit hashes of all texts' shingles, and n+1 bounds."""
    h, bounds = words(texts, ALNUM)
    n = np.diff(bounds)
    count = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
    cut = np.concatenate([[0], np.cumsum(count)])
    if not len(h):
        return np.zeros(0, U), cut
    with np.errstate(over="ignore"):
        doc = np.repeat(np.arange(len(texts)), count)
        start = bounds[doc] + np.arange(len(doc)) - cut[doc]
        out = np.zeros(len(doc), U)
        for k in range(SHINGLE):
            at = start + k
            inside = at < bounds[doc + 1]
            out = mix(out * U(0x100000001B3) + np.where(inside, h[np.minimum(at, len(h) - 1)], U(k + 1)))
    return out & U((1 << 48) - 1), cut


def signatures(element: np.ndarray, weight: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """BagMinHash: n_docs x M arrival times of the distinct (doc, element) rows with whole weights."""
    levels = np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64) + 1
    row = np.repeat(np.arange(len(element)), levels)
    level = np.arange(len(row)) - np.repeat(np.cumsum(levels) - levels, levels)
    low = np.where(level == 0, 0, 1 << np.maximum(level - 1, 0)).astype(np.float64)
    width = np.where(level <= 1, 1, 1 << np.maximum(level - 1, 0)).astype(np.float64)
    share = np.minimum(1.0, (weight[row] - low) / width)
    with np.errstate(over="ignore"):
        state = mix(element[row] * U(0x9E3779B97F4A7C15) + level.astype(U))
    d, t = doc[row], np.zeros(len(row))
    rate = M * width
    best = np.full(n_docs * M, np.inf)
    last = np.full(n_docs, np.inf)
    while len(d):
        with np.errstate(over="ignore"):
            state = mix(state + U(0xD1B54A32D192ED03))
        t = t - np.log(((state >> U(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate
        with np.errstate(over="ignore"):
            other = mix(state ^ U(0xA0761D6478BD642F))
        slot = ((other >> U(40)) * U(M) >> U(24)).astype(np.int64)
        ok = (other & U((1 << 32) - 1)).astype(np.float64) * 2.0**-32 < share
        np.minimum.at(best, d[ok] * M + slot[ok], t[ok])
        last = best.reshape(n_docs, M).max(1)
        live = t < last[d]
        d, t, state, rate, share = d[live], t[live], state[live], rate[live], share[live]
    return best.reshape(n_docs, M)


def counted(h: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct elements with counts and documents, and each document's sorted hashes."""
    doc = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]) if len(h) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    return h[at], np.diff(np.append(at, len(h))), doc[at], [h[a:b] for a, b in zip(cut, cut[1:], strict=False)]


def packed(own: np.ndarray) -> bytes:
    return own.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


SIGNED = T.StructType([T.StructField("ck", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])
BAG = T.StructType([T.StructField("ck", T.BinaryType()), T.StructField("bag", T.BinaryType())])


def content_key(blob: bytes) -> bytes | None:
    return hashlib.md5(blob).digest() if blob else None


def sign(texts: list[bytes | None]) -> dict:
    h, cut = shingles(texts)
    element, weight, doc, own = counted(h, cut)
    sig = signatures(element, weight, doc, len(texts))
    bits = sig.view(U).reshape(len(texts), BANDS, ROWS)
    with np.errstate(over="ignore"):
        key = np.arange(BANDS, dtype=U)[None, :] + U(1)
        for k in range(ROWS):
            key = mix(key * U(0x9E3779B97F4A7C15) ^ bits[:, :, k])
    keys = key.view(np.int64)
    cks = [content_key(packed(x)) for x in own]
    return {"ck": cks, "n": [len(x) for x in own], "bands": [k.tolist() if c else [] for k, c in zip(keys, cks, strict=True)]}


def bags(texts: list[bytes | None]) -> dict:
    h, cut = shingles(texts)
    own = [packed(x) for x in counted(h, cut)[3]]
    return {"ck": [content_key(x) for x in own], "bag": own}


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the multisets' intersection; both are sorted."""
    both = np.concatenate([a, b])
    side = np.concatenate([np.zeros(len(a), np.int8), np.ones(len(b), np.int8)])
    order = np.argsort(both, kind="stable")
    both, side = both[order], side[order]
    at = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else np.zeros(0, int)
    total = np.diff(np.append(at, len(both)))
    second = np.add.reduceat(side.astype(np.int64), at) if len(at) else total
    return int(np.minimum(second, total - second).sum())


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    k = overlap(a, b)
    return DEN * k >= NUM * (len(a) + len(b) - k)


def verified(pairs: DataFrame, bag: DataFrame) -> DataFrame:
    """The pairs (a, b) whose multisets are similar enough."""
    x = pairs.join(bag.select(F.col("ck").alias("a"), F.col("bag").alias("bag_a")), "a")
    x = x.join(bag.select(F.col("ck").alias("b"), F.col("bag").alias("bag_b")), "b")

    def run(batches):
        for pdf in batches:
            ok = [similar(unpacked(p), unpacked(q)) for p, q in zip(pdf.bag_a, pdf.bag_b, strict=True)]
            yield pd.DataFrame({"a": pdf.a, "b": pdf.b})[np.array(ok, bool)]

    return x.select("a", "b", "bag_a", "bag_b").mapInPandas(run, "a binary, b binary")


def elements(bag: np.ndarray) -> np.ndarray:
    """A sorted multiset as a set: the k-th occurrence of a hash is an element of its own."""
    if not len(bag):
        return bag
    new = np.concatenate([[True], bag[1:] != bag[:-1]])
    at = np.arange(len(bag))
    nth = at - np.maximum.accumulate(np.where(new, at, 0))
    with np.errstate(over="ignore"):
        return np.where(nth > 0, mix(bag + nth.astype(U) * U(0x9E3779B97F4A7C15)), bag)


def overlaps(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of a multiset of x with one of y."""
    out = np.zeros((len(x), len(y)), np.float32)
    sides = []
    for bags_ in (x, y):
        flat = np.concatenate([elements(b) for b in bags_])
        sides.append((flat, np.repeat(np.arange(len(bags_)), [len(b) for b in bags_])))
    shared = np.intersect1d(sides[0][0], sides[1][0])
    for k in range(0, len(shared), COLUMNS):
        part, dense = shared[k : k + COLUMNS], []
        for (flat, row), n in zip(sides, out.shape, strict=True):
            at = np.minimum(np.searchsorted(part, flat), len(part) - 1)
            hit = part[at] == flat
            m = np.zeros((n, len(part)), np.float32)
            m[row[hit], at[hit]] = 1
            dense.append(m)
        out += dense[0] @ dense[1].T
    return out.astype(np.int64)


def block_links(x: pa.Table, y: pa.Table) -> list[tuple[bytes, bytes]]:
    """Links between members with different labels, as many as connect the same labels."""
    place: dict = {}
    la, lb = (np.array([place.setdefault(v, len(place)) for v in t.column("label").to_pylist()]) for t in (x, y))
    if len(place) < 2:
        return []
    one, two = ([unpacked(b) for b in t.column("bag").to_pylist()] for t in (x, y))
    k = overlaps(one, two)
    size = np.array([len(b) for b in one])[:, None] + np.array([len(b) for b in two])[None, :]
    i, j = np.nonzero((DEN * k >= NUM * (size - k)) & (la[:, None] != lb[None, :]))
    _, first = np.unique(la[i] * len(place) + lb[j], return_index=True)
    up = list(range(len(place)))

    def top(v):
        while up[v] != v:
            up[v] = up[up[v]]
            v = up[v]
        return v

    a, b, out = x.column("ck").to_pylist(), y.column("ck").to_pylist(), []
    for p, q in zip(i[first].tolist(), j[first].tolist(), strict=True):
        u, v = top(la[p]), top(lb[q])
        if u != v:
            up[u] = v
            out.append((min(a[p], b[q]), max(a[p], b[q])))
    return out


def block_rest(members: DataFrame, bag: DataFrame) -> DataFrame:
    """Links (a, b) across labels inside large buckets. members: bucket, ck, label, n_rows. Each block is written once."""
    folder = work_dir(members.sparkSession, "neardup-blocks")
    n_blocks = F.ceil(F.col("n_rows") / BLOCK_ROWS)
    rows = members.select("bucket", "ck", "label", n_blocks.cast("int").alias("blocks"), F.pmod(F.xxhash64("ck"), n_blocks).cast("int").alias("block")).join(bag, "ck")

    def keep(key, table):
        bucket, block, blocks = (k.as_py() for k in key)
        name = f"{bucket}-{block}-{uuid.uuid4().hex[:8]}.arrow"  # a retried task writes another file
        out = pa.BufferOutputStream()
        with pa.ipc.new_file(out, table.select(["ck", "label", "bag"]).schema) as f:
            f.write_table(table.select(["ck", "label", "bag"]))
        files.put(folder, name, out.getvalue().to_pybytes())
        return pa.table({"bucket": pa.array([bucket], pa.int64()), "block": pa.array([block], pa.int32()), "blocks": pa.array([blocks], pa.int32()), "file": pa.array([name])})

    kept = settle(rows.groupBy("bucket", "block", "blocks").applyInArrow(keep, "bucket long, block int, blocks int, file string"), "neardup-blocks-kept")
    todo = kept.select("bucket", F.col("file").alias("x"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("j"))
    # a block that got no member has no file
    todo = settle(todo.join(kept.select("bucket", F.col("block").alias("j"), F.col("file").alias("y")), ["bucket", "j"]).select("x", "y"), "neardup-block-pairs")
    # dealt by number: two file names a row say nothing of the work behind them
    todo = todo.repartition(max(1, -(-todo.count() // BLOCK_PAIRS)), "x", "y")

    def load(name: str) -> pa.Table:
        return pa.ipc.open_file(pa.BufferReader(files.read(folder, name))).read_all()

    def run(batches):
        for batch in batches:
            for one, two in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                x = load(one)
                found = block_links(x, x if one == two else load(two))
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.binary()) for k in (0, 1)], names=["a", "b"])

    return todo.mapInArrow(run, "a binary, b binary")


def bags_of(docs: DataFrame, text: str, wanted: DataFrame) -> DataFrame:
    """One multiset for each wanted content key, from a second pass over the texts."""
    key = free_name("bag", [])
    every = annotate(docs.select(F.col(f"`{text}`").alias("text")), "text", lambda t, _: bags(t), BAG, [], name=key, limit=STEP).select(f"{key}.ck", f"{key}.bag")
    small = wanted.count() <= BROADCAST_KEYS
    got = every.join(F.broadcast(wanted) if small else wanted, "ck", "left_semi")
    return settle(got.groupBy("ck").agg(F.first("bag").alias("bag")), "neardup-bags")


def links(members: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """node, label: components of content keys under verified links, complete for all that share a bucket and are similar. members: bucket, ck, n."""
    sets = [F.bit_xor(F.xxhash64("ck", F.lit(k))).alias(f"set{k}") for k in (0, 1)]
    pivots = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n_rows"), F.min("ck").alias("pivot"), F.min_by("n", "ck").alias("pivot_n"), *sets)
    # of buckets with the same members (by two 64-bit hashes of the set) one is enough
    pivots = pivots.where("n_rows > 1").groupBy("n_rows", "pivot", "pivot_n", "set0", "set1").agg(F.min("bucket").alias("bucket"))
    pivots = settle(pivots.select("bucket", "n_rows", "pivot", "pivot_n"), "neardup-pivots")
    members = settle(spread_join(members, pivots, "bucket", size="n_rows").where("pivot IS NOT NULL").select("bucket", "ck", "n", "pivot", "pivot_n"), "neardup-members")
    bag = bags_of(docs, text, members.select("ck").distinct())
    long_enough = lambda x, y: (F.col(x) * DEN >= F.col(y) * NUM) & (F.col(y) * DEN >= F.col(x) * NUM)

    def ordered(df: DataFrame, x: str, y: str) -> DataFrame:
        return df.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).where("a <> b").distinct()

    tested = settle(ordered(members.where(long_enough("n", "pivot_n")), "ck", "pivot"), "neardup-pairs")
    found = settle(verified(tested, bag), "neardup-links")
    members = members.select("bucket", "ck", "n")
    # later turns carry the components so far as stars, next to the new links
    stars, new = None, found
    for turn in range(PIVOT_ROUNDS):
        label = settle(components(new if stars is None else stars.unionByName(new)), "neardup-labels")
        stars = label.where("node <> label").select(F.col("node").alias("a"), F.col("label").alias("b"))
        ends = found.select(F.explode(F.array("a", "b")).alias("ck"), F.lit(None).cast("binary").alias("label"), F.lit(1).alias("link"))
        info = label.select(F.col("node").alias("ck"), "label", F.lit(0).alias("link")).unionByName(ends)
        known = members.join(info.groupBy("ck").agg(F.max("label").alias("label"), F.sum("link").alias("degree")), "ck", "left")
        known = settle(known.select("bucket", "ck", "n", F.coalesce("label", "ck").alias("label"), F.coalesce("degree", F.lit(0)).alias("degree")), "neardup-known")
        state = known.groupBy("bucket").agg(F.count(F.lit(1)).alias("n_rows"), F.min("label").alias("l0"), F.max("label").alias("l1"), F.max(F.struct("degree", "ck", "label", "n")).alias("best"))
        open_ = settle(state.where("l0 <> l1").select("bucket", "n_rows", F.col("best.ck").alias("pivot"), F.col("best.label").alias("pivot_label"), F.col("best.n").alias("pivot_n")), "neardup-open")
        if open_.isEmpty():
            return label
        members = settle(spread_join(known, open_, "bucket", size="n_rows").where("pivot IS NOT NULL"), "neardup-left")
        if turn == PIVOT_ROUNDS - 1:
            break
        more = ordered(members.where("label <> pivot_label").where(long_enough("n", "pivot_n")), "ck", "pivot")
        more = settle(more.join(tested, ["a", "b"], "left_anti"), "neardup-pairs")
        new = settle(verified(more, bag), "neardup-links")
        if new.isEmpty():
            break
        found, tested = found.unionByName(new), tested.unionByName(more)
        members = members.select("bucket", "ck", "n")
    # what is left: pairs across components inside a bucket
    large, members = members.where(F.col("n_rows") > PAIR_ROWS), members.where(F.col("n_rows") <= PAIR_ROWS)
    x = members.select("bucket", F.col("ck").alias("a"), F.col("n").alias("na"), F.col("label").alias("la"))
    y = members.select("bucket", F.col("ck").alias("b"), F.col("n").alias("nb"), F.col("label").alias("lb"))
    rest = x.join(y, "bucket").where("la <> lb AND a < b").where(long_enough("na", "nb")).select("a", "b").distinct()
    new = verified(rest.join(tested, ["a", "b"], "left_anti"), bag)
    if not large.isEmpty():
        new = new.unionByName(block_rest(large, bag))
    new = settle(new, "neardup-rest")
    return label if new.isEmpty() else components(stars.unionByName(new))


def classes(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """A narrow row a document (key, th: the text's md5, ck, n_shingles, class_key: null for a text without words ...), and a row a class (class_key, n_docs, class_id)."""
    name = "signed"
    # the md5 is taken JVM-side, next to the signatures, so that rows of equal ids can be told apart by their texts
    source = docs.select(F.col(f"`{key}`").alias("id"), digest(text).alias("th"), F.col(f"`{text}`").alias("text"))
    signed = annotate(source, "text", lambda t, _: sign(t), SIGNED, ["id", "th"], name=name, limit=STEP)
    signed = settle(signed.select("id", "th", f"{name}.ck", f"{name}.n", f"{name}.bands"), "neardup-signed")
    # equal keys have equal bands and lengths
    keys = signed.where("ck IS NOT NULL").groupBy("ck").agg(F.count(F.lit(1)).alias("n_same"), F.min("id").alias("least"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    distinct = settle(keys, "neardup-distinct")
    label = links(distinct.select(F.explode(F.array_distinct("bands")).alias("bucket"), "ck", "n"), docs, text)
    keys = settle(distinct.select("ck", "n_same", "least").join(label.withColumnRenamed("node", "ck"), "ck", "left").select("ck", "n_same", "least", F.coalesce("label", "ck").alias("class_key")), "neardup-keys")
    drop(distinct)
    groups = settle(keys.groupBy("class_key").agg(F.sum("n_same").alias("n_docs"), F.min("least").alias("class_id"), F.count(F.lit(1)).alias("n")), "neardup-classes")
    whole = spread_join(keys, groups, "class_key").select("ck", "n_same", "n_docs", "class_id", "class_key")
    whole = settle(whole.withColumnRenamed("n_same", "n_copies"), "neardup-of")
    drop(keys)
    rows = spread_join(signed.select("id", "th", "ck", F.col("n").alias("n_shingles")), whole, "ck", size="n_copies")
    rows = rows.select(F.col("id").alias(key), "th", "ck", "n_shingles", "class_key", F.coalesce("n_docs", F.lit(1)).alias("n_docs"), F.when(F.col("ck").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"))
    return rows, groups


def digest(text: str):
    return F.unhex(F.md5(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")))


def keep_one(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each class, that with the least id (of equal ids, one), with its own columns; texts without words stay.

    No text is shuffled as long as the rows that go (id and md5) are few enough to be broadcast; rows equal in id
    and text meet by themselves, so that one of them is taken.
    """
    rows, _ = classes(docs, key=key, text=text)
    rows = settle(rows.where("ck IS NOT NULL").select(F.col(f"`{key}`").alias("id"), "th", "class_key"), "neardup-rows")
    best = rows.groupBy("class_key").agg(F.min(F.struct(F.col("id").isNull().alias("null"), "id", "th")).alias("best"), F.count(F.lit(1)).alias("n"))
    best = settle(best.select("class_key", "n", F.col("best.id").alias("best_id"), F.col("best.th").alias("best_th")), "neardup-best")
    same = F.col("id").eqNullSafe(F.col("best_id")) & (F.col("th") == F.col("best_th"))
    told = spread_join(rows, best, "class_key").select("id", "th", same.alias("stays"))
    # what goes, and what stays but is there more than once
    told = told.groupBy("id", "th").agg(F.first("stays").alias("stays"), F.count(F.lit(1)).alias("times")).where("NOT stays OR times > 1")
    told = settle(told.select("id", "th", "stays"), "neardup-told")
    i, h, s = (free_name(x, docs.columns) for x in ("__id", "__th", "__stays"))
    small = told.count() * 48 <= BROADCAST_BYTES
    marks = told.select(F.col("id").alias(i), F.col("th").alias(h), F.col("stays").alias(s))
    on = F.col(f"`{key}`").eqNullSafe(F.col(i)) & (digest(text) == F.col(h))
    df = docs.join(F.broadcast(marks) if small else marks, on, "left")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    again = df.where(F.col(f"`{s}`")).dropDuplicates([i, h]).select(*columns)
    return df.where(F.col(f"`{s}`").isNull()).select(*columns).unionByName(again)


def op7(spark, sf_dir: str) -> DataFrame:
    rows, _ = classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", "n_shingles", "class_id", F.col("n_docs").alias("class_docs"))


def brute(rows: list[tuple]) -> dict:
    """Classes of (id, text) by comparing all pairs, for tests: id -> least id."""
    import re
    from collections import Counter

    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    bag = {}
    for i, t in rows:
        w = word.findall((t or "").translate(low))
        bag[i] = Counter(tuple(w[k : k + SHINGLE]) for k in range(max(1, len(w) - SHINGLE + 1))) if w else None
    up = {i: i for i in bag}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(bag)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if bag[a] and bag[b]:
                k = sum((bag[a] & bag[b]).values())
                if DEN * k >= NUM * (sum(bag[a].values()) + sum(bag[b].values()) - k):
                    x, y = top(a), top(b)
                    up[max(x, y)] = min(x, y)
    return {i: top(i) for i in ids}
