import random

import numpy as np

from glyphmill.llm import neardup as N
from glyphmill.llm.components import components


def test_signatures_are_unbiased():
    rng = np.random.default_rng(3)
    a, b, n = [], [], 0
    agree = []
    for _ in range(60):
        ids = rng.integers(0, 1 << 48, 60).astype(np.uint64)
        wa, wb = rng.integers(1, 9, 60), rng.integers(1, 9, 60)
        wa[40:] = wb[40:]
        sig = N.signatures(np.concatenate([ids, ids]), np.concatenate([wa, wb]), np.repeat([0, 1], 60), 2)
        agree.append((sig[0] == sig[1]).mean() - np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum())
    assert abs(np.mean(agree)) < 0.02
    assert not a and not b and not n


def variants(rng, base, n, changes):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(changes + 1)):
            w[rng.randrange(len(w))] = f"v{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_classes_equal_brute_force(spark):
    rng = random.Random(9)
    texts = []
    for k in range(6):
        base = [f"b{k}x{rng.randrange(900)}" for _ in range(200)]
        texts += variants(rng, base, 15, 6)
    texts += [" ".join(f"u{i}y{j}" for j in range(30)) for i in range(40)]
    hub = [f"h{j}" for j in range(150)]
    texts += variants(rng, hub, 60, 2) + [" ".join(hub)] * 30
    texts += ["rep eat ed " * 40, "rep eat ed " * 44, "a b", "A, b!", "a c", None, "", "...", "one"]
    order = list(range(len(texts)))
    rng.shuffle(order)
    rows = [(i, texts[k]) for i, k in enumerate(order)]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, signed int").repartition(5)
    got, _ = N.classes(docs)
    got = {r.doc_id: r for r in got.collect()}
    want = N.brute(rows)
    assert {i: r.class_id for i, r in got.items()} == want
    sizes = {}
    for c in want.values():
        sizes[c] = sizes.get(c, 0) + 1
    assert all(r.n_docs == sizes[want[i]] for i, r in got.items())
    left = N.keep_one(docs)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == sorted(sizes)


def test_blocks_find_what_pairs_do(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"w{j}" for j in range(120)]
    texts = [" ".join(f"v{rng.randrange(10**6)}" if rng.random() < 0.012 * (k % 4) else w for w in base) for k in range(70)]
    texts += ["la la la " * k for k in (20, 21, 22, 40)]
    bag = [np.sort(h) for h in np.split(*(lambda h, cut: (h, cut[1:-1]))(*N.shingles([t.encode() for t in texts])))]
    k = N.overlaps(bag[:40], bag[30:])
    assert all(k[i, j] == N.overlap(bag[i], bag[30 + j]) for i in range(40) for j in range(len(bag) - 30))
    monkeypatch.setattr(N, "PAIR_ROWS", 1)
    monkeypatch.setattr(N, "BLOCK_ROWS", 8)
    monkeypatch.setattr(N, "PIVOT_ROUNDS", 1)
    rows = list(enumerate(texts))
    got, _ = N.classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.class_id for r in got.collect()} == N.brute(rows)


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 300)] + [(rng.randrange(400, 440), rng.randrange(400, 440)) for _ in range(30)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {}
    for a, b in edges:
        if a != b:
            up.setdefault(a, set()).add(b)
            up.setdefault(b, set()).add(a)
    for s in up:
        seen, todo = {s}, [s]
        while todo:
            for y in up[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        assert got[s] == min(seen)
    assert set(got) == set(up)


def test_nulls_repeats_empty(spark):
    same = "one two three four five six"
    docs = spark.createDataFrame([(None, same), (7, same), (7, same), (7, "other words are here in this one"), (None, None)], "doc_id long, text string")
    rows, _ = N.classes(docs)
    assert sorted(((r.doc_id, r.class_id, r.n_docs) for r in rows.collect()), key=repr) == sorted([(None, 7, 3), (7, 7, 3), (7, 7, 3), (7, 7, 1), (None, None, 1)], key=repr)
    assert N.keep_one(docs).count() == 3
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert N.keep_one(empty).count() == 0
