import numpy as np

from glyphmill.llm import text as X


def test_words_differ_and_agree():
    a = "ab ba abc cab AB x" .split()
    h, bounds = X.words([w.encode() for w in a])
    assert bounds.tolist() == list(range(7)) and len(set(h.tolist())) == 5 and h[0] == h[4]
    big = ("word%d " * 3 % (1, 2, 3)).encode() * 200_000
    h, bounds = X.words([None, big, b"word1"])
    assert len(np.unique(h)) == 3 and h[-1] == h[0] and bounds.tolist() == [0, 0, 600_000, 600_001]
