import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from glyphmill.llm import scoring as S
from glyphmill.llm.text import found_words


def docs():
    rng = random.Random(4)
    syllables = ["th", "er", "on", "ing", "É", "at"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4)))
    rows = [(i, " ".join(word() for _ in range(rng.randrange(0, 120)))) for i in range(150)]
    return [*rows, (500, None), (501, ""), (502, "A\x0bB c\x1cd  \n"), (None, "null id"), (7, rows[7][1]), (503, "x" * 3000), (504, "long text of one line " * 60_000)]


def cut(t):
    return [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w] + [None]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def base(rows):
    count = Counter(w for i, t in rows if not held(i) for w in cut(t))
    n, v = sum(count.values()), len(count)
    return [(i, held(i), len(cut(t)), sum(count[w] > 0 for w in cut(t)), n, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in cut(t))) for i, t in rows]


def test_contract(spark):
    rows = docs()
    got = S.score(spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, chunk int, held_out int").repartition(3)).collect()
    key = lambda r: (repr(r[0]), r[2], r[5])
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=key)
    for g, w in zip(got, sorted(base(rows), key=key), strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5]) and g[6] < 0 and math.isfinite(g[6])


def test_empty(spark):
    assert S.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    only_held = next(i for i in range(50) if held(i))
    r = S.score(spark.createDataFrame([(only_held, "a b")], "doc_id long, text string")).first()
    assert (r.n_tokens, r.n_known, r.train_tokens) == (3, 0, 0) and r.score < 0 and math.isfinite(r.score)


def fitted(texts, bits=16):
    """The model of one task over the texts, without Spark."""
    raw = [t.encode() for t in texts]
    h = np.concatenate([found_words(raw, S.SOLID)[0], np.full(len(raw), S.END, np.uint64)])
    keys, counts = np.unique(h, return_counts=True)
    inside = np.flatnonzero(counts > 2)
    inside = inside[np.argsort(-counts[inside], kind="stable")][: S.HEAD]
    once, twice = int((counts == 1).sum()), int((counts == 2).sum())
    discount = once / (once + 2 * twice) if once and twice else 0.5
    rest = np.delete(counts, inside)
    tree = S.Tree(keys[inside], counts[inside], int(rest.sum()) - once, once)
    model = S.Model(S.Mixer(tree, bits), S.Speller(), discount, max(1e-9, rest.sum() - discount * len(rest)))
    s = S.Stream(raw, keys, counts)
    leaf = s.leaves(tree, 2)
    for k in range(0, len(leaf), S.SLICE):
        model.mixer.learn(leaf[k : k + S.SLICE], s.c1[k : k + S.SLICE], s.c2[k : k + S.SLICE])
    first = np.unique(s.hash, return_index=True)[1]
    first = first[s.size[first] > 0]
    model.speller.run(s.data, s.start[first], s.size[first], True)
    return model, keys, counts


def some_texts(n=300):
    rng = random.Random(1)
    vocabulary = ["".join(rng.choice(["tha", "er", "on", "É"]) for _ in range(rng.randrange(1, 5))) for _ in range(400)]
    return [" ".join(rng.choices(vocabulary, k=60) + [f"new{i}", f"pair{i % 130}"]) for i in range(n)]


def scalar(model, leaf, c1, c2):
    """A token's way through the tree, decision by decision, in Python's floats."""
    m = model.mixer
    share, trust = m.refined()
    total = 0.0
    for j in range(int(m.tree.at[leaf]), int(m.tree.at[leaf] + m.tree.size[leaf])):
        node, bit = int(m.tree.nodes[j]), int(m.tree.bits[j])
        p0 = float(m.tree.share[node])
        xs, levels = [math.log(p0 / (1 - p0))], []
        for table, c in zip(m.tables, (c1, c2), strict=True):
            x = (int(c) ^ (node * 0x9E3779B1 & 0xFFFFFFFF)) * 0x85EBCA6B & 0xFFFFFFFF
            both = table[(x ^ x >> 15) >> (32 - m.bits)]
            xs.append(math.log((both.imag + p0) / (both.real + 1 - p0)))
            levels.append(min(5, math.ceil(math.log2(min(int(both.real + both.imag), 255) + 1) * 0.75)))
        gate = levels[0] * 6 + levels[1]
        dot = max(-16, min(16, sum(float(m.weights[k][gate]) * x for k, x in enumerate([*xs, 1.0]))))
        p = 1 / (1 + math.exp(-dot))
        cell = levels[0] * S.BUCKETS + int(max(0, min(S.BUCKETS - 1, (dot + 12) * S.BUCKETS / 24)))
        p += float(trust[cell]) * (float(share[cell]) - p)
        total += math.log10(max(p if bit else 1 - p, 1e-9))
    return total


def spelled(sp, word):
    """A word's bits in Python's floats."""
    total, mask = 0.0, 0xFFFFFFFF
    data = word + b" "
    for j, byte in enumerate(data):
        hashes, h = [], 0
        for k in range(1, S.SPELL_TABLES + 1):
            h = (h * 0x2545F491 + (data[j - k] if j >= k else 0x20) + k) & mask
            hashes.append(h)
        node = 1
        for b in range(7, -1, -1):
            bit, xs, levels = byte >> b & 1, [], []
            for k, h in enumerate(hashes):
                x = (h ^ (node * 0x9E3779B1 & mask)) * 0x85EBCA6B & mask
                at = ((x ^ x >> 15) >> (32 - S.SPELL_BITS)) + (k << S.SPELL_BITS)
                n0, n1 = float(sp.table[2 * at]), float(sp.table[2 * at + 1])
                xs.append(math.log((n1 + 0.1) / (n0 + 0.1)))
                levels.append(min(5, math.ceil(math.log2(min(int(n0 + n1), 255) + 1) * 0.75)))
            gate = (levels[-1] * 6 + levels[-2]) * 8 + b
            dot = max(-16, min(16, sum(float(sp.weights[k][gate]) * x for k, x in enumerate([*xs, 1.0]))))
            p = 1 / (1 + math.exp(-dot))
            total += math.log10(max(p if bit else 1 - p, 1e-9))
            node = 2 * node + bit
    return total


def test_score_equals_a_scalar_model():
    texts = some_texts()
    model, keys, counts = fitted(texts[:250])
    s = S.Stream([t.encode() for t in texts[250:260]], keys, counts)
    got, leaf, tree = model.score(s), s.leaves(model.mixer.tree, 1), model.mixer.tree
    assert (leaf == tree.new).any() and (leaf == tree.tail).any() and (leaf < tree.tail).any()
    for j in range(len(leaf)):
        want = scalar(model, leaf[j], s.c1[j], s.c2[j])
        if leaf[j] == tree.tail:
            want += math.log10((s.count[j] - model.discount) / model.tail_mass)
        if leaf[j] == tree.new:
            want += spelled(model.speller, bytes(s.data[s.start[j] : s.start[j] + s.size[j]]))
        assert got[j] == pytest.approx(want, abs=2e-3)


def test_tokens_are_a_distribution():
    model, keys, counts = fitted(some_texts())
    tree = model.mixer.tree
    leaves = np.arange(len(tree.size))
    for c1, c2 in ((0, 1), (12345, 678)):
        p = 10 ** model.mixer.score(leaves, np.full(len(leaves), c1, np.uint32), np.full(len(leaves), c2, np.uint32))
        assert p.sum() == pytest.approx(1, abs=1e-3)
    rest = counts[~np.isin(keys, tree.hashes)]
    assert ((rest - model.discount) / model.tail_mass).sum() == pytest.approx(1)
    # the next byte's probabilities sum to one at most
    words = np.array([[0x74, v] for v in range(256) if v != S.SPACE], np.uint8)
    sp = model.speller
    assert (10 ** sp.run(words.ravel(), np.arange(len(words)) * 2, np.full(len(words), 2), False)).sum() < 1


def test_earlier_words_count(spark):
    rng = random.Random(8)
    follow = {w: rng.sample(range(40), 3) for w in range(40)}

    def line():
        at = [rng.randrange(40)]
        while len(at) < 60:
            at.append(rng.choice(follow[at[-1]]))
        return [f"w{i}" for i in at]

    held_ids = [i for i in range(5000) if held(i)]
    rows = [(i, " ".join(line())) for i in range(600) if not held(i)]
    fluent, salad = held_ids[100], held_ids[101]
    words = line()
    rows += [(fluent, " ".join(words)), (salad, " ".join(rng.sample(words, len(words))))]
    got = {r.doc_id: r for r in S.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[fluent].held_out and got[salad].held_out and got[fluent].base_score == pytest.approx(got[salad].base_score)
    assert got[fluent].score > got[salad].score + 10 and got[fluent].score > got[fluent].base_score + 10


def test_slots_follow_the_corpus():
    assert S.bits_for(10) == S.LEAST_BITS < S.bits_for(1 << 12) < S.bits_for(1 << 13) < S.bits_for(1 << 30) == S.MOST_BITS


def test_tasks_are_summed(spark, monkeypatch):
    # many chunks and tasks: counts stay exact, and the sums score about as well as one task
    texts = some_texts(120)
    rows = [(i, t) for i, t in enumerate(texts)]
    one = S.score(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).toPandas()
    monkeypatch.setattr(S, "CHUNK_BYTES", 3000)
    many = S.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).toPandas()
    a, b = one.set_index("doc_id").sort_index(), many.set_index("doc_id").sort_index()
    assert (a.n_known == b.n_known).all() and np.allclose(a.base_score, b.base_score)
    assert abs(a.score.sum() / b.score.sum() - 1) < 0.05
