import random

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from glyphmill.llm import decontaminate, neardup, packing
from glyphmill.llm.common import settle, table, tokenizer_path

from . import test_lines, test_quality

OUTLIERS = range(900, 905)


def fixture():
    rng = random.Random(12)
    word = lambda: rng.choice(["ab", "cde", "fghi", "jklmn"]) + rng.choice("abcdefgh")
    line = lambda: " ".join(word() for _ in range(rng.randrange(55, 75)))
    docs = {i: [line() for _ in range(rng.randrange(2, 4))] for i in range(400)}
    item = " ".join(word() for _ in range(30))
    for i in range(20, 24):  # a shared line of more than 50 words, and a short one
        docs[i][1:] = [docs[20][1], "a short line"]
    for i in range(300, 306):  # near copies: a word changed in each line
        docs[i] = [x.replace(x.split()[9], "changed", 1) for x in docs[i - 100]]
    docs[310] = list(docs[11])
    for i in range(320, 324):
        docs[i][0] += " " + item
    for i, text in enumerate(["", "too few words", " ".join(["again and again"] * 40)]):
        docs[800 + i] = [text]
    for i in OUTLIERS:
        docs[i] = [" ".join("### $$$ %%% ab" for _ in range(20)) + f" {i} " + " ".join(f"q{j}#$%&" for j in range(100))]
    return [(i, "\n".join(x)) for i, x in docs.items()], [(1, item), (2, "never seen " * 10)]


def after_quality(rows, items):
    def good(i, text):
        n, *_, repeat = test_quality.brute(text)
        return n >= 50 and 100 * repeat <= 50 * n and i not in OUTLIERS

    return [(i, t) for i, t in rows if good(i, t)]


def after_lines(rows, items):
    want = test_lines.brute(rows, 51)
    # a document that had words and has none left goes
    return [(i, want[(i, t)]) for i, t in rows if want[(i, t)] == t or want[(i, t)].split()]


def after_near_dedup(rows, items):
    least = neardup.brute(rows)
    return [(i, t) for i, t in rows if not t.split() or least[i] == i]


def after_decontamination(rows, items):
    found = decontaminate.brute(dict(rows), dict(items))
    return [(i, t) for i, t in rows if not (found[i][1] and 20 * found[i][1] >= found[i][0])]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    rows, items = fixture()
    made = [(i, t, "en", "a", len(t)) for i, t in rows]
    spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages_and_run(spark, folder):
    rows, items = fixture()
    docs = table(spark, folder, "documents")
    brutes = [after_quality, after_lines, after_near_dedup, after_decontamination]
    for (name, stage), brute in zip(corpus_pipeline.STAGES[:-1], brutes, strict=True):
        docs = settle(stage(spark, docs, folder), "test-pipeline")
        want = brute(rows, items)
        assert want != rows, name
        rows = want
        assert sorted((r.doc_id, r.text) for r in docs.collect()) == sorted(rows), name
    t = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    got = corpus_pipeline.run(spark, folder).collect()
    size, spots = {}, {}
    for r in got:
        size[r.doc_id] = size.get(r.doc_id, 0) + r.length
        spots.setdefault(r.sequence_id, []).append((r.offset, r.offset + r.length))
    assert size == {i: len(t.encode(text, add_special_tokens=False).ids) + 1 for i, text in rows}
    for at in spots.values():
        at.sort()
        assert at[0][0] == 0 and at[-1][1] <= packing.SIZE and all(a[1] == b[0] for a, b in zip(at, at[1:]))
