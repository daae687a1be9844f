import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from glyphmill.llm import coder, files
from glyphmill.llm import token_files as TF
from glyphmill.llm.common import tokenizer_path, work_dir
from glyphmill.llm.tokens import Encoder


def test_coder_round_trip():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 300, 500)
    cases = [rng.integers(0, 49408, 9000), np.concatenate([base] * 40), np.zeros(9000, int), np.arange(49408), np.array([5]), np.tile([1, 2], 9000), rng.geometric(0.3, 20000), rng.integers(0, coder.MOST_IDS, 9000), np.array([coder.MOST_IDS - 1, 0])]
    for ids in cases:
        keys, null, counts, back = TF.unpack_file(TF.pack_file([None, 2], np.array([1, len(ids) - 1]), ids.astype(np.int64)))
        assert (back == ids).all() and keys.tolist() == [0, 2] and null.tolist() == [True, False] and counts.sum() == len(ids)
    packed = TF.pack_file([1], np.array([20000]), np.tile(base, 40))
    assert len(packed) < 15000
    assert coder.encode([], 1) == [] and coder.decode([], [], 1) == []
    with pytest.raises(ValueError, match="ids below"):
        coder.encode([np.array([coder.MOST_IDS])], coder.MOST_IDS + 1)


def test_blocks_stand_alone():
    rng = np.random.default_rng(2)
    blocks = [rng.geometric(0.01, n) for n in (8192, 100, 8192, 3)]
    together = coder.encode(blocks, 5000)
    for b, p in zip(blocks, together, strict=True):
        assert coder.encode([b], 5000) == [p] and (coder.decode([p], [len(b)], 5000)[0] == b).all()


def test_damage_is_found():
    data = bytearray(TF.pack_file([1], np.array([5000]), np.arange(5000)))
    data[-40] ^= 1
    with pytest.raises(TF.Corrupt):
        TF.unpack_file(bytes(data))


@pytest.mark.parametrize("file_ids", [TF.FILE_IDS, 700])
def test_files(spark, file_ids):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["The", "foo,", "l'été"]) for _ in range(rng.randrange(60))), 0) for i in range(80)]
    rows += [(None, "null id", 0), (5, "again", 0), (200, None, 0), (-(1 << 63), "least", 0), (5, "again", 0), (6, "日本 語 x", 0), (201, "", 0), (202, "x " * 5000, 0)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int").repartition(3)
    folder = work_dir(spark, "t")
    path = tokenizer_path("word_bpe_49k.json")
    TF.write(docs, folder, path, file_ids=file_ids)
    files.put(folder, "tokens-000000-0000-orphan.gmtok", b"left by a lost task")
    got = sorted(TF.read(spark, folder).collect(), key=lambda r: r.start)
    t = Tokenizer.from_file(path)
    want = [(i, [*t.encode(x or "", add_special_tokens=False).ids, 1]) for i, x, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, zlib.crc32((r[1] or "").encode())))]
    at = 0
    for r, (i, ids) in zip(got, want, strict=True):
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_encoder_equals_the_library():
    rng = random.Random(3)
    texts = ["", " ", "  a", "a  ", "a \n b\t\tc \r\n d", "\n\nx", "don't I'll  x", "hello, world. (foo)", "é ü  Ÿ ǅ", "a\x0bb", "x\u00a0y", "<|endoftext|> k", "日本 語", "İstanbul ŉ", "w" * 3_000_000]
    texts += ["".join(rng.choice(" \n\t,.ab'sé1") for _ in range(rng.randrange(40))) for _ in range(2000)]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        path = tokenizer_path(name)
        code = Encoder(path)
        assert code.kind
        want = Tokenizer.from_file(path).encode_batch_fast(texts[:14] + texts[15:], add_special_tokens=False)
        raw = [t.encode() for t in texts]
        for _ in range(2):
            got = code.ids(raw)
            assert [x.tolist() for x in got[:14] + got[15:]] == [e.ids for e in want]
        assert len(got[14]) > 0


def test_empty(spark):
    folder = work_dir(spark, "t")
    TF.write(spark.createDataFrame([], "doc_id long, text string"), folder, tokenizer_path("word_bpe_49k.json"))
    assert TF.read(spark, folder).count() == 0


def test_ids_must_be_whole_numbers(spark):
    with pytest.raises(TypeError, match="whole number"):
        TF.write(spark.createDataFrame([("a", "x")], "doc_id string, text string"), work_dir(spark, "t"), tokenizer_path("word_bpe_49k.json"))


def test_shares_are_found_again():
    rng = np.random.default_rng(6)
    for alphabet in (1, 5, 3000, 49408, coder.MOST_IDS):
        zero = coder.Order0(40, alphabet)
        for _ in range(3):
            zero.add((rng.zipf(1.2, (64, 40)) % alphabet).astype(np.int32))
            zero.renew()
            ids = rng.integers(0, alphabet, (9, 40)).astype(np.int32)
            start, width = zero.shares(ids, zero.slot(ids))
            # in whole numbers, by definition
            for step in range(9):
                for k in range(0, 40, 7):
                    i = int(ids[step, k])
                    slot = int(np.searchsorted(zero.low, i, "right")) - 1
                    a, b = (int(zero.sums[k, slot + j]) for j in range(2))
                    low, n = int(zero.low[slot]), int(zero.width[slot])
                    first, last = ((b - a) * (i - low + j) // n for j in range(2))
                    assert (start[step, k], width[step, k]) == (a + first, last - first) and last > first
            for v in (start, start + width - 1, start + width // 2):
                for step in range(9):
                    got = zero.find(np.arange(40), v[step])
                    assert all((x == y).all() for x, y in zip(got, (ids[step], start[step], width[step]), strict=True))


def test_the_bytes_stay_the_same():
    import hashlib

    rng = np.random.default_rng(9)
    blocks = [(rng.zipf(1.2, n) % 49408).astype(np.int64) for n in (8192, 3000, 8192, 50)]
    assert hashlib.sha256(b"".join(coder.encode(blocks, 49408))).hexdigest() == "d628a6448117710e7354b069450d7fc0b53e1d2dc56528c57cc466dec26d249f"


def test_files_are_decoded_together(monkeypatch):
    rng = np.random.default_rng(11)
    all_ids = [rng.integers(0, most, n) for most, n in ((90, 20000), (3000, 9000), (49408, 8192), (2, 1))]
    packed = [TF.pack_file([k], np.array([len(ids)]), ids, 49408) for k, ids in enumerate(all_ids)] + [TF.pack_file([], np.zeros(0, int), np.zeros(0, int), 49408)]
    calls = []
    decode = coder.decode
    monkeypatch.setattr(coder, "decode", lambda p, n, alphabet: calls.append(alphabet) or decode(p, n, alphabet))
    got = TF.unpack_files(packed)
    assert calls == [49408] and len(got[-1][3]) == 0
    for k, ids in enumerate(all_ids):
        assert got[k][0].tolist() == [k] and (got[k][3] == ids).all()


def test_contexts_before_each_step():
    rng = np.random.default_rng(12)
    for alphabet in (1, 3, 40, 5000):
        s = (rng.zipf(1.3, (5, 700)) % alphabet + 1).astype(np.int32)
        past = np.concatenate([np.zeros((5, 2), np.int32), s], axis=1)
        rows = np.concatenate(coder.slots(past[:, 1:-1], past[:, :-2]))
        got = coder.held_before(rows, s)
        for r in range(10):
            table = {}
            for step in range(700):
                p, c = table.get(int(rows[r, step]), (0, 0))
                assert got[r, step] == p * coder.LEVELS + c
                x = int(s[r % 5, step])
                table[int(rows[r, step])] = (p, min(c + 1, coder.LEVELS - 1)) if x == p else (x, 1) if c <= 2 else (p, c >> 1)


def test_chunks_are_cut_at_marks_and_asked_for_together():
    rng = random.Random(13)
    words = ["the", "L'été", "don't", "Ça", "naïve", "x×y", "é÷", "ÉÉ", "ab1", "it's", "!'s", "we'll,'ll", "İş"]
    texts = [" ".join(rng.choice(words) + "".join(rng.choice("!?.,%&*-_'\"") for _ in range(rng.choice([0, 0, 1, 2, 9, 12]))) for _ in range(30)) for _ in range(500)]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        path = tokenizer_path(name)
        code = Encoder(path)
        want = [e.ids for e in Tokenizer.from_file(path).encode_batch_fast(texts, add_special_tokens=False)]
        assert [x.tolist() for x in code.ids([t.encode() for t in texts])] == want
        # letters and marks are chunks of their own: new words ask for no new chunk but for those of letters, in one string
        asked = []
        ask = code.ask
        code.ask = lambda x, ask=ask, asked=asked: asked.extend(x) or ask(x)
        code.ids([b"a zzzq!!! z\xc3\xa9zq%%% zz\xc3\xa9.."])
        assert not any(c in x for x in asked[:1] for c in "!%.") and "zzzq" in asked[0] and "zézq" in asked[0]
