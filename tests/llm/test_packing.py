import random
import zlib

import numpy as np
from tokenizers import Tokenizer

from glyphmill.llm import packing as P
from glyphmill.llm.common import tokenizer_path
from glyphmill.llm.tokens import encoder

ODD = ["foo, bar. Foo. x), 3, É. ab.", "İx İ. ŉ, ǅ.", None, "", " ", "  a  b ", "\n\n x\n", "tab\t\tx", "don't I'll we've 'S", "a b", "éclair ẞ Straße", "<|endoftext|> x <|startoftext|>", "12 345,6!!", "日本語 テキスト", "x" * 3000, "İstanbul ŉ ǅ", "\r\n\r\n a \r b", "a\x1cb\x0bc", "end  \n  "]


def test_tokens_equal_the_library():
    rng = random.Random(5)
    texts = [*ODD, *["".join(rng.choice(" \n\tab'sT1,.é#") for _ in range(rng.randrange(80))) for _ in range(3000)]]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        t, e = Tokenizer.from_file(tokenizer_path(name)), encoder(tokenizer_path(name))
        got = e.ids([None if x is None else x.encode() for x in texts])
        for x, ids in zip(texts, got):
            assert np.frombuffer(ids, "<u4").tolist() == t.encode(x or "", add_special_tokens=False).ids, repr(x)


def test_plan_uses_all_and_fills():
    rng = np.random.default_rng(2)
    for _ in range(20):
        counts = np.zeros(65, np.int64)
        for x in rng.integers(1, 65, rng.integers(1, 400)):
            counts[x] += 1
        counts[7] += 500
        got = np.zeros(65, np.int64)
        total = 0
        for times, lengths in P.plan(counts):
            assert sum(lengths) <= 64
            total += times
            for x in lengths:
                got[x] += times
        assert (got == counts).all()
        need = -(-int((counts * np.arange(65)).sum()) // 64)
        assert total <= max(need * 1.02 + 1, (counts[33:]).sum() * 1.02 + need * 0.3 + 2)


def test_pack(spark):
    rng = random.Random(6)
    texts = [*ODD, *[" ".join(rng.choice(["the", "of", "xq"]) for _ in range(int(rng.expovariate(1 / 150)))) for _ in range(300)], "word " * 9000, *["same text here"] * 200]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, length int").repartition(5)
    rows = P.pack(docs).collect()
    t = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for i, x in enumerate(texts):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 0]
        own = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.piece for r in own] == [*range(len(own))] and sum(r.length for r in own) == len(ids)
        at = 0
        for r in own:
            assert r.start == at and zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes()) == r.ids_crc32
            at += r.length
        assert len(own) == -(-len(ids) // 2048) and all(r.length == 2048 for r in own[1:])
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert len(by_seq) <= -(-sum(r.length for r in rows) // 2048) + 1


def test_empty(spark):
    assert P.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_texts_are_encoded_in_small_steps(spark, monkeypatch):
    from types import SimpleNamespace

    import pyarrow as pa

    docs = spark.createDataFrame([(0, "")], "doc_id long, text string")
    seen = []
    code = SimpleNamespace(ids=lambda texts: seen.append(sum(map(len, texts))) or [np.zeros(len(t), np.uint32) for t in texts])
    monkeypatch.setattr(P, "encoder", lambda path: code)
    one = SimpleNamespace(schema=docs.schema, select=lambda *c: SimpleNamespace(mapInArrow=lambda run, schema: run))
    batch = pa.RecordBatch.from_pydict({"doc_id": [*range(6)], "text": ["x" * 500_000] * 6})
    made = [*P.pieces(one, "", end=0, size=2048, key="doc_id", text="text")([batch])]
    assert max(seen) <= 1 << 20 and sum(seen) == 3_000_000
    assert sum(sum(m.column("length").to_pylist()) for m in made) == 3_000_006


def test_the_cache_is_small():
    import tracemalloc

    from glyphmill.llm.tokens import Encoder

    rng = random.Random(8)
    code = Encoder(tokenizer_path("byte_bpe_50k.json"))
    texts = [" ".join("".join(rng.choice("abcdefgh") for _ in range(8)) for _ in range(30_000)).encode() for _ in range(5)]
    first = [x.tolist() for x in code.ids(texts)]
    code.clear()
    tracemalloc.start()
    for t in texts:
        code.ids([t])
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 80 * len({w for t in texts for w in t.split()})
    assert [x.tolist() for x in code.ids(texts)] == first


def test_the_cache_is_cleared():
    from glyphmill.llm.tokens import Encoder

    code = Encoder(tokenizer_path("byte_bpe_50k.json"))
    code.most = 50
    texts = [" ".join(f"w{i}x{j}" for j in range(40)).encode() for i in range(20)]
    want = [Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json")).encode(t.decode(), add_special_tokens=False).ids for t in texts]
    for _ in range(2):
        assert [code.ids([t])[0].tolist() for t in texts] == want and code.held < 50 + 200


def test_rows_go_to_workers_in_small_batches(spark):
    from glyphmill.llm.common import BATCH, settle

    def run(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows]})

    before = spark.conf.get(BATCH)
    made = settle(spark.range(0, 5000, 1, 1).mapInArrow(run, "n long"), "t", P.BATCH_ROWS)
    assert [r.n for r in made.collect()] == [1000] * 5 and spark.conf.get(BATCH) == before
