import random
import re
from collections import Counter

import numpy as np

from glyphmill.llm import quality as Q


def brute(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    grams = Counter(zip(words, words[1:], words[2:]))
    inside = {j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside)


def rows():
    rng = random.Random(1)
    texts = [None, "", " \n\t", "é" * 10, "a b c a b c", "x\ny\nx\n \nx", "a b c\x1cd", "wort " * 80]
    texts += [" ".join(rng.choice(["ab", "cde", "fghi", "jklmn"]) + rng.choice("abcdefgh") for _ in range(rng.randrange(60, 200))) for _ in range(400)]
    texts += [" ".join("### $$$ %%% ab" for _ in range(20)) + f" {i} " + " ".join(f"q{j}#$%&" for j in range(100)) for i in range(5)]
    return [(i, t, [None, "en", "de"][i % 3], "hot" if i % 2 else None, i) for i, t in enumerate(texts)]


def test_base_and_outliers(spark):
    data = rows()
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, quality int").repartition(4)
    df = Q.judge(docs, keep=["doc_id"])
    got = {r.doc_id: r.quality for r in df.collect()}
    assert len(got) == len(data)
    for i, t, *_ in data:
        q = got[i]
        want = brute(t)
        assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words) == want, (i, t)
        assert q.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (q.base_failed and q.kept)
    assert sorted(i for i, q in got.items() if not q.base_failed and not q.kept) == [r[0] for r in data[-5:]]
    left = Q.reject(docs)
    assert left.columns == docs.columns and left.count() == sum(q.kept for q in got.values())


def mcd(x, tries=300):
    """The reweighted MCD's mean and inverse covariance by numpy: many starts, steps to the end, the least determinant."""
    rng, floor = np.random.default_rng(0), np.diag(np.square(Q.FLOORS))
    h = (len(x) + 1) // 2

    def of(part, factor):
        mean = part.mean(0)
        return mean, (part - mean).T @ (part - mean) / len(part) * factor + floor

    def d2(at):
        return np.einsum("ij,ij->i", (x - at[0]) @ np.linalg.inv(at[1]), x - at[0])

    best = None
    for _ in range(tries):
        at = of(x[rng.choice(len(x), Q.P + 1, replace=False)], 1)
        last = np.inf
        while (now := np.linalg.det((at := of(x[(d := d2(at)) <= np.sort(d)[h - 1]], Q.consistency(0.5)))[1])) < last * (1 - 1e-9):
            last = now
        if best is None or last < best[0]:
            best = (last, at)
    at = best[1]
    return of(x[d2(at) <= Q.NEAR], Q.consistency(Q.REWEIGHT))


def test_chi_square():
    # values of the usual tables
    assert abs(Q.chi2_quantile(0.05, 6) - 12.592) < 1e-3 and abs(Q.chi2_quantile(0.5, 6) - 5.348) < 1e-3 and abs(Q.chi2_quantile(0.01, 8) - 20.090) < 1e-3
    x = np.random.default_rng(1).standard_normal((200_000, Q.P))
    near = x[(x**2).sum(1) <= Q.chi2_quantile(0.5, Q.P)]
    assert abs(np.cov(near.T).trace() / Q.P * Q.consistency(0.5) - 1) < 0.02


def test_verdicts_equal_a_brute_force_mcd(spark):
    rng = random.Random(7)

    def text(word, marks):
        return " ".join(word() + ("#" if rng.random() < marks else "") for _ in range(rng.randrange(60, 160)))

    kinds = {
        ("en", "a"): lambda: text(lambda: rng.choice("abcdefgh") * rng.randrange(2, 9), 0.01),
        ("en", "b"): lambda: text(lambda: rng.choice("ABCDxyz") * rng.randrange(1, 4), 0.2),
        ("de", None): lambda: text(lambda: rng.choice("abcd") + rng.choice("xyzuvw") * rng.randrange(6, 14), 0.0),
    }
    data, groups = [], {}
    for (lang, source), make in kinds.items():
        for k in range(150):
            junk = k % 10 == 0
            t = " ".join(f"q{rng.randrange(999)}#$%&|" for _ in range(80)) if junk else make()
            data.append((len(data), t, lang, source))
    small = [(len(data) + k, kinds["en", "a"](), "en", f"small{k % 4}") for k in range(20)]
    data += small + [(900 + k, kinds["de", None](), "fr", "x") for k in range(5)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string").repartition(5)
    got = {r.doc_id: r.quality for r in Q.judge(docs, keep=["doc_id"]).collect()}
    vectors = {}
    for i, t, lang, source in data:
        q = Q.stats([t.encode()])
        if not got[i].base_failed:
            vectors[i] = np.array(q["x"][0])
            for name in (("source", lang, source), ("language", lang), ("all",)):
                groups.setdefault(name, []).append(i)
    for i, t, lang, source in data:
        if i in vectors:
            name = ("source", lang, source) if len(groups["source", lang, source]) >= Q.LEAST_ROWS else ("language", lang) if len(groups["language", lang]) >= Q.LEAST_ROWS else ("all",)
            assert got[i].estimate == name[0]
            if name not in made_cache:
                made_cache[name] = mcd(np.array([vectors[j] for j in groups[name]]))
            mean, cov = made_cache[name]
            d2 = (vectors[i] - mean) @ np.linalg.inv(cov) @ (vectors[i] - mean)
            assert abs(got[i].distance2 - d2) < 0.02 * max(d2, 1) and got[i].kept == (d2 <= Q.CUTOFF), (i, name)
    assert {q.estimate for q in got.values()} >= {"source", "language", "all"} and sum(not q.kept for q in got.values()) >= 40


made_cache: dict = {}


def test_edges(spark):
    rng = random.Random(2)
    same = " ".join(rng.choice("abcdefgh") + str(k) for k in range(70))
    # copies, a constant group, a text of many megabytes, and columns named like the module's own
    data = [(i, same, "en", "a", 1, 2) for i in range(80)] + [(100, "word and more " * 400_000 + same, "en", "a", 1, 2), (None, None, None, None, None, None)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, quality int, g_lang int")
    df = Q.judge(docs, keep=docs.columns)
    assert df.columns == [*docs.columns, "quality_"]
    got = {r.doc_id: r.quality_ for r in df.collect()}
    assert all(got[i].kept and got[i].distance2 < 1e-6 for i in range(80)) and got[None].base_failed and not got[None].kept and got[None].estimate is None
    assert got[100].n_words == 1_200_070 and got[100].base_failed


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert Q.reject(docs).count() == 0
