"""Benchmark decontamination by training suffix arrays.

Each step of a task (some MB of documents) is a shard. Its words are numbered by the
benchmark's vocabulary; stretches of such words too short to hold any window are left out,
which loses no match of a window. A suffix array of the rest is built by prefix doubling; every
test suffix is binary-searched in it, which gives the windows' occurrences and the longest
verbatim match with its place. No shuffle: documents stay where they were read. The benchmark
goes to the tasks in blocks of at most BLOCK_BYTES of text, a pass over the documents each; where there is more than one, what
the passes found so far is written with the documents, so that driver and tasks hold one block at a time.

Defined cases: a null or wordless text has no words and no hits; a null or wordless item has
no window; items with equal ids count once in the list of ids; null item ids hit, but are not
listed; rows are judged one by one, so repeated rows give repeated results; an empty benchmark
leaves all clean; a very long text is a shard of its own; other columns are passed through, whatever they are called; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SMALL_STEP, annotate, drop, free_name, settle
from .text import ALNUM, words

#: Most benchmark text in one broadcast.
BLOCK_BYTES = 32 << 20
HITS = T.ArrayType(T.LongType())
FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("runs", HITS),  # start, end, start, end ... of hit words
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("longest_words", T.LongType()),
        T.StructField("longest_at", T.LongType()),
    ]
)


class Tests:
    """The test suffixes of a block of benchmark items."""

    def __init__(self, rows: list[tuple], window: int):
        texts = [(t or "").encode() for _, t in rows]
        h, bounds = words(texts, ALNUM)
        self.vocabulary, ids = np.unique(h, return_inverse=True)
        ids = ids.astype(np.int64) + 1
        self.item = [None if i is None else str(i) for i, _ in rows]
        parts, at, left, size, item, n = [], [], [], [], [], 0
        for k in range(len(rows)):
            own = ids[bounds[k] : bounds[k + 1]]
            parts += [own, np.array([-1])]
            m = len(own)
            if m:
                at.append(n + np.arange(m))
                left.append(m - np.arange(m))
                size.append(np.where(m - np.arange(m) >= min(window, m), min(window, m), 0))
                item.append(np.full(m, k))
            n += m + 1
        join = lambda x: np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64)
        self.words, self.at, self.left, self.size, self.of = join(parts), join(at), join(left), join(size), join(item)
        self.least = int(self.size[self.size > 0].min()) if len(self.size) else 0


def suffix_array(s: np.ndarray, depth: int) -> np.ndarray:
    """Positions of s by the order of what follows, by prefix doubling, to `depth` symbols at least."""
    rank = np.unique(s, return_inverse=True)[1].astype(np.int64)
    order, h = np.argsort(rank, kind="stable"), 1
    while h < depth:
        after = np.zeros_like(rank)
        after[:-h] = rank[h:] + 1
        pair = rank * (len(s) + 2) + after
        order = np.argsort(pair, kind="stable")
        new = np.concatenate([[0], np.cumsum(np.diff(pair[order]) != 0)])
        rank[order] = new
        if new[-1] == len(s) - 1:
            break
        h *= 2
    return order


def place(s: np.ndarray, sa: np.ndarray, t: np.ndarray, at: np.ndarray, size: np.ndarray, upper: bool) -> np.ndarray:
    """For each test suffix, cut to `size` words, its lower or upper bound in sa, by binary search."""
    lo, hi = np.zeros(len(at), np.int64), np.full(len(at), len(sa), np.int64)
    while (open_ := lo < hi).any():
        mid = (lo + hi) >> 1
        less, same = np.zeros(len(at), bool), open_.copy()
        where = sa[np.minimum(mid, len(sa) - 1)]
        live, d = np.flatnonzero(open_), 0
        while len(live):
            done = size[live] <= d
            live = live[~done]
            if not len(live):
                break
            p = where[live] + d
            a = np.where(p < len(s), s[np.minimum(p, len(s) - 1)], -1)
            b = t[at[live] + d]
            less[live[a < b]] = True
            same[live[a != b]] = False
            live = live[a == b]
            d += 1
        go = (less | same) if upper else less
        lo = np.where(open_ & go, mid + 1, lo)
        hi = np.where(open_ & ~go, mid, hi)
    return lo


def common(s: np.ndarray, where: np.ndarray, t: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Words that agree from where[] in s and at[] in t."""
    n, live, d = np.zeros(len(at), np.int64), np.flatnonzero(where >= 0), 0
    while len(live := live[size[live] > d]):
        p = where[live] + d
        live = live[(p < len(s)) & (s[np.minimum(p, len(s) - 1)] == t[at[live] + d])]
        n[live] = d = d + 1
    return n


def search(texts: list[bytes | None], tests: Tests) -> dict:
    """n_words, hit runs, item ids and the longest match of each text."""
    h, bounds = words(texts, ALNUM)
    n_docs, n = len(texts), np.diff(bounds)
    out = {"n_words": n.tolist(), "runs": [[] for _ in texts], "items": [[] for _ in texts], "longest_words": [0] * n_docs, "longest_at": [None] * n_docs}
    if not len(h) or not tests.least:
        return out
    spot = np.minimum(np.searchsorted(tests.vocabulary, h), len(tests.vocabulary) - 1)
    known = tests.vocabulary[spot] == h
    doc = np.repeat(np.arange(n_docs), n)
    cut = np.flatnonzero(np.diff(np.concatenate([[False], known, [False]]).astype(np.int8)) != 0)
    # runs of known words, broken between documents
    starts = np.unique(np.concatenate([cut[::2], bounds[:-1][(n > 0)]]))
    starts = starts[known[starts]]
    stops = np.minimum(cut[1::2][np.searchsorted(cut[1::2], starts, side="right")], bounds[1:][doc[starts]])
    long = stops - starts >= tests.least
    starts, stops = starts[long], stops[long]
    if not len(starts):
        return out
    length = stops - starts + 1  # with a separator, below any word
    total = int(length.sum())
    first = np.cumsum(length) - length
    origin = np.arange(total) - np.repeat(first, length) + np.repeat(starts, length)
    s = np.where(origin < np.repeat(stops, length), spot[np.minimum(origin, len(h) - 1)] + 1, 0).astype(np.int64)
    sa = suffix_array(s, int(tests.left.max()) + 1)
    sa = sa[s[sa] > 0]
    t = tests.words
    # occurrences of windows
    w = np.flatnonzero(tests.size > 0)
    lo, hi = (place(s, sa, t, tests.at[w], tests.size[w], up) for up in (False, True))
    w, lo, count = w[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
    if len(w):
        each = np.repeat(np.arange(len(w)), count)
        hit = origin[sa[np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count) + lo[each]]]
        d = doc[hit]
        edge = np.zeros(len(h) + 1, np.int64)
        np.add.at(edge, hit, 1)
        np.add.at(edge, hit + tests.size[w[each]], -1)
        covered = np.cumsum(edge[:-1]) > 0
        other = np.concatenate([[True], doc[1:] != doc[:-1]])
        begin = np.flatnonzero(covered & (other | ~np.concatenate([[False], covered[:-1]])))
        end = np.flatnonzero(covered & (np.append(other[1:], True) | ~np.append(covered[1:], False))) + 1
        for a, b in zip(begin, end, strict=True):
            out["runs"][doc[a]] += [int(a - bounds[doc[a]]), int(b - bounds[doc[a]])]
        for k, i in np.unique(np.stack([d, tests.of[w[each]]], 1), axis=0):
            if tests.item[i] is not None:
                out["items"][k].append(tests.item[i])
        out["items"] = [sorted(set(x)) for x in out["items"]]
    # longest verbatim matches: each whole test suffix against its neighbours in the array
    at = place(s, sa, t, tests.at, tests.left, False)
    for side in (at - 1, at):
        where = np.where((side >= 0) & (side < len(sa)), sa[np.clip(side, 0, len(sa) - 1)], -1)
        k = common(s, where, t, tests.at, tests.left)
        for j in np.flatnonzero(k >= tests.least):
            p = origin[where[j]]
            if k[j] > out["longest_words"][doc[p]]:
                out["longest_words"][doc[p]], out["longest_at"][doc[p]] = int(k[j]), int(p - bounds[doc[p]])
    return out


def merged(a: list[int], b: list[int]) -> list[int]:
    spans = sorted([*zip(a[::2], a[1::2], strict=True), *zip(b[::2], b[1::2], strict=True)])
    out: list[int] = []
    for x, y in spans:
        if out and x <= out[-1]:
            out[-1] = max(out[-1], y)
        else:
            out += [x, y]
    return out


def blocks(benchmark: DataFrame, item: str, text: str, window: int, limit: int):
    """The benchmark, cut to blocks of at most `limit` bytes; rows are streamed, one partition at a time."""
    rows, held = [], 0
    for row in benchmark.select(F.col(item), F.col(text)).toLocalIterator():
        size = len((row[1] or "").encode())
        if held and held + size > limit:
            yield Tests(rows, window)
            rows, held = [], 0
        rows.append((row[0], row[1]))
        held += size
    yield Tests(rows, window)


def contamination(docs: DataFrame, benchmark: DataFrame, *, keep: list[str], text: str = "text", item: str = "item_id", item_text: str = "text", window: int = 13, limit: int = BLOCK_BYTES) -> tuple[DataFrame, str]:
    """`keep` columns and a struct of FOUND for each document, and the struct's name."""
    spark, name = docs.sparkSession, free_name("found", docs.columns)
    df, need = docs, list(dict.fromkeys([*keep, text]))
    parts = blocks(benchmark, item, item_text, window, limit)
    tests, k, older = next(parts), 0, None
    while tests is not None:
        after = next(parts, None)
        held = spark.sparkContext.broadcast(tests)
        before = name if k else None

        def fn(texts, batch, held=held, before=before):
            got = search(texts, held.value)
            if before:
                for i, old in enumerate(batch.column(before).to_pylist()):
                    got["runs"][i] = merged(old["runs"], got["runs"][i])
                    got["items"][i] = sorted({*old["items"], *got["items"][i]})
                    if old["longest_words"] >= got["longest_words"][i]:
                        got["longest_words"][i], got["longest_at"][i] = old["longest_words"], old["longest_at"]
            return got

        wanted = [*(need if after else keep)]
        # the earlier struct travels along and is replaced
        df = annotate(df, text, fn, FOUND, [*wanted, *([before] if before else [])], name="found_new" if before else name, limit=SMALL_STEP)
        df = df.select(*[F.col(f"`{c}`") for c in wanted], F.col(f"`{df.columns[-1]}`").alias(name))
        if after:
            df = settle(df, "decontaminate-blocks")
            held.destroy()
            drop(older)
            older = df
        tests, k = after, k + 1
    return df, name


def verdict(found: str, per_hit: int = 20):
    """Columns of the contract from the struct."""
    n_hit = F.expr(f"cast(aggregate(`{found}`.runs, struct(0L as s, 0 as i), (a, x) -> struct(a.s + if(a.i % 2 = 0, -x, x) as s, a.i + 1 as i), a -> a.s) as bigint)")
    items, n = F.col(f"`{found}`.items"), F.col(f"`{found}`.n_words")
    return {
        "n_words": n,
        "n_hit": n_hit,
        "n_items": F.size(items).cast("long"),
        "items_sha256": F.sha2(F.array_join(items, ","), 256),
        "contaminated": (n_hit > 0) & (F.lit(per_hit) * n_hit >= n),
        "longest_words": F.col(f"`{found}`.longest_words"),
    }


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that are not contaminated, with their own columns."""
    columns = docs.columns
    df, found = contamination(docs, benchmark, keep=columns, **options)
    return df.where(~verdict(found)["contaminated"]).select(*[F.col(f"`{c}`") for c in columns])


def op1(spark, sf_dir: str) -> DataFrame:
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    df, found = contamination(docs, bench, keep=["doc_id"])
    return df.select("doc_id", *[c.alias(k) for k, c in verdict(found).items() if k != "longest_words"])


OP1_SQL = r"""
WITH low AS (SELECT 'doc' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'item', item_id, text FROM benchmark),
w AS (SELECT kind, id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM low),
i AS (SELECT id, ws, least(13, len(ws)) AS n FROM w WHERE kind = 'item' AND len(ws) > 0),
g AS (SELECT DISTINCT id AS item, n, array_to_string(list_slice(ws, k, k + n - 1), ' ') AS g FROM (SELECT *, unnest(range(1, len(ws) - n + 2)) AS k FROM i)),
d AS (SELECT id, ws, n, unnest(range(1, len(ws) - n + 2)) AS k FROM w, (SELECT DISTINCT n FROM g) WHERE kind = 'doc' AND len(ws) >= n),
h AS (SELECT d.id, d.n, d.k, g.item FROM d JOIN g ON g.n = d.n AND g.g = array_to_string(list_slice(d.ws, d.k, d.k + d.n - 1), ' ')),
hits AS (SELECT id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT id, unnest(range(k, k + n)) AS p FROM h) GROUP BY id),
items AS (SELECT id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT id, CAST(item AS VARCHAR) AS item FROM h) GROUP BY id)
SELECT w.id AS doc_id, CAST(coalesce(len(ws), 0) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(ws), false) AS contaminated
FROM w LEFT JOIN hits ON hits.id = w.id LEFT JOIN items ON items.id = w.id WHERE kind = 'doc'
"""


def brute(texts: dict, items: dict, window: int = 13) -> dict:
    """By regular expressions and slices, for tests: doc id -> (n_words, n_hit, item ids)."""
    import re

    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    cut = lambda t: word.findall((t or "").translate(low))
    grams: dict = {}
    for i, t in items.items():
        w = cut(t)
        for k in range(len(w) - window + 1) if len(w) >= window else range(min(1, len(w))):
            grams.setdefault(tuple(w[k : k + window]), set()).add(str(i))
    out = {}
    for i, t in texts.items():
        w, hit, ids = cut(t), set(), set()
        for size in {len(g) for g in grams}:
            for k in range(len(w) - size + 1):
                if g := grams.get(tuple(w[k : k + size])):
                    hit |= set(range(k, k + size))
                    ids |= g
        out[i] = (len(w), len(hit), sorted(ids))
    return out


def digest(ids: list[str]) -> str:
    return hashlib.sha256(",".join(ids).encode()).hexdigest()
