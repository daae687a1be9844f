"""Token ids by a tokenizer's file: the library's own results, with a cache of white-space chunks.

The public tokenizers named in KNOWN never join characters across the chunk bounds used here, so a text's ids
are its chunks' ids one after another. Chunks are found and hashed (64 bits) by numpy over many texts at once; the
library is asked once for each distinct chunk, and a text's ids are gathered from what it answered. New chunks of letters
alone (ASCII and U+00C0 to U+00FF) are asked for many in one string, as their first or last ids tell where they end. All that is used
for texts of plain characters only (tab, newline, carriage return, printable ASCII and Latin letters of
U+00A1 to U+024F, none of the added tokens' strings); any other text, and any text for a tokenizer whose
normaliser and pre-tokenizer are not exactly those of KNOWN, goes to the library as a whole. The cache is an open table of
hashes in numpy arrays (12 bytes a place, half empty at least), and is cleared when it holds CACHE entries (or `most`, set by its user). Two chunks of one worker's cache share
a hash with a chance of 7e-8.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pandas as pd

CACHE = 1_600_000
#: The least size of the cache's table.
LEAST_BITS = 16
#: Bytes that are hashed at a time; a longer chunk is hashed alone.
PIECE = 1 << 20
#: The normalisers and pre-tokenizers (as in the tokenizers' files) that the chunk rules hold for.
WORD_END = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
)
BYTE_LEVEL = (None, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True})
KNOWN = {"words": WORD_END, "spaced": BYTE_LEVEL}

WHITE = np.zeros(256, bool)
WHITE[[0x09, 0x0A, 0x0D, 0x20]] = True
#: Bytes of plain texts: white space, printable ASCII, the lead bytes C2 to C9 and what follows them.
PLAIN = WHITE.copy()
PLAIN[[*range(0x20, 0x7F), *range(0x80, 0xC0), *range(0xC2, 0xCA)]] = True
LETTER = np.zeros(256, bool)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
#: Marks that never join a letter before them; an apostrophe may.
MARK = np.zeros(256, bool)
MARK[[i for i in range(0x21, 0x7F) if not chr(i).isalnum() and i != 0x27]] = True
#: Most marks at a word's end that are cut off; with more the word stays whole.
MARKS = 8
#: New chunks that are sent to the library as one string.
TOGETHER = 512
_VALUE = np.random.default_rng(23).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

_OPEN: dict[str, Encoder] = {}


def powers(n: int) -> list[np.ndarray]:
    """The powers of the base and of its inverse modulo 2^64."""
    if len(_POWERS[0]) < n:
        with np.errstate(over="ignore"):
            for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
                _POWERS[k] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n, PIECE), np.uint64(base))]))
    return _POWERS


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the given spans (sorted, apart from one another)."""
    out = np.empty(len(start), np.uint64)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(start):
            j = max(i + 1, int(np.searchsorted(end, start[i] + PIECE, "right")))
            a, b = int(start[i]), int(end[j - 1])
            up, down = powers(b - a + 1)
            sums = np.concatenate([[np.uint64(0)], np.cumsum(_VALUE[data[a:b]] * up[: b - a])])
            s, e = start[i:j] - a, end[i:j] - a
            x = (sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64)
            out[i:j] = x ^ x >> np.uint64(32)
            i = j
    out[out == 0] = 1  # 0 is no key
    return out


def letters(data: np.ndarray) -> np.ndarray:
    """Which bytes are of ASCII letters or of letters from U+00C0 to U+00FF."""
    out = LETTER[data]
    lead = (data[:-1] == 0xC3).nonzero()[0]
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
    out[lead] = out[lead + 1] = True
    return out


def spans(data: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the chunks of texts that are each closed by a zero byte."""
    solid = ~WHITE[data] & (data != 0)
    edge = np.flatnonzero(np.diff(solid, prepend=False, append=False))
    start, end = edge[::2], edge[1::2]
    # marks between a letter and a word's end are cut off there by both pre-tokenizers
    letter, cut = letters(data), end.copy()
    some = np.flatnonzero(MARK[data[end - 1]])
    mark = np.zeros(len(end), bool)
    for _ in range(MARKS):
        cut[some] -= 1
        some = some[cut[some] > start[some]]
        last = cut[some] - 1
        mark[some[letter[last]]] = True
        some = some[MARK[data[last]]]
    mark = np.flatnonzero(mark)
    mark = end[mark], cut[mark]
    if kind == "words":
        return with_marks(start, end, mark)
    # a single space before a word belongs to it; of more white space before a word the rest is a chunk, and
    # so is the last one if it is no space; white space at a text's end is one chunk
    own = np.zeros(len(start), bool)
    own[start > 0] = data[start[start > 0] - 1] == 0x20
    white = WHITE[data]
    edge = np.flatnonzero(np.diff(white, prepend=False, append=False))
    first, last = edge[::2], edge[1::2]
    before = solid[np.minimum(last, len(data) - 1)] & (last < len(data))
    stop = last - before
    most = stop > first
    single = before & (data[last - 1] != 0x20) if len(last) else before
    starts = np.concatenate([start - own, first[most], last[single] - 1])
    ends = np.concatenate([end, stop[most], last[single]])
    order = np.argsort(starts, kind="stable")
    return with_marks(starts[order], ends[order], mark)


def with_marks(start: np.ndarray, end: np.ndarray, mark: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The chunks, with the marks of those that have some as chunks of their own. mark: where such chunks end, and where their marks begin."""
    last, cut = mark
    if not len(last):
        return start, end
    k = np.searchsorted(end, last)
    end = end.copy()
    end[k] = cut
    return np.insert(start, k + 1, cut), np.insert(end, k + 1, last)


def ragged(size: np.ndarray) -> np.ndarray:
    """0, 1, ... size[0] - 1, 0, 1, ..."""
    upto = np.cumsum(size)
    return np.arange(int(upto[-1]) if len(upto) else 0) - np.repeat(upto - size, size)


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library, self.most = Tokenizer.from_file(path), CACHE
        with open(path) as f:
            made = json.load(f)
        self.added = [t["content"].encode() for t in made["added_tokens"]]
        rules = (made["normalizer"], made["pre_tokenizer"])
        self.kind = next((k for k, known in KNOWN.items() if known == rules and not made.get("truncation")), None)
        if self.kind:
            # an id that ends a word, or that begins with the space before one
            tells = made["model"].get("end_of_word_suffix") if self.kind == "words" else "\u0120"
            found = self.library.get_vocab()
            self.edge = np.zeros(max(found.values()) + 1, bool)
            for t, i in found.items():
                self.edge[i] = bool(tells) and (t.endswith(tells) if self.kind == "words" else t.startswith(tells))
        self.clear()

    def clear(self) -> None:
        self.held = 0
        # open addressing: a key (0: none) and its slot, looked for from the hash's upper bits on
        self.key, self.slot = np.zeros(1 << LEAST_BITS, np.uint64), np.zeros(1 << LEAST_BITS, np.int32)
        self.flat = np.zeros(1 << 16, np.uint32)
        self.at = np.zeros(1 << 12, np.int32)  # slot k's ids are flat[at[k]:at[k + 1]]

    def home(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(65 - len(self.key).bit_length())).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The keys' slots, -1 for those that have none."""
        at, last = self.home(keys), len(self.key) - 1
        found = self.key[at]
        slot = self.slot[at]
        open_ = np.flatnonzero(found != keys)
        while len(open_):
            none = found[open_] == 0
            slot[open_[none]] = -1
            open_ = open_[~none]
            at[open_] = (at[open_] + 1) & last
            found[open_] = self.key[at[open_]]
            same = found[open_] == keys[open_]
            slot[open_[same]] = self.slot[at[open_[same]]]
            open_ = open_[~same]
        return slot

    def put(self, keys: np.ndarray, slots: np.ndarray) -> None:
        """Distinct new keys; the table stays half empty."""
        if 2 * (self.held + len(keys)) > len(self.key):
            old = np.flatnonzero(self.key)
            keys, slots = np.concatenate([self.key[old], keys]), np.concatenate([self.slot[old], slots])
            size = 1 << (2 * len(keys)).bit_length()
            self.key, self.slot, self.held = np.zeros(size, np.uint64), np.zeros(size, np.int32), 0
        at, last = self.home(keys), len(self.key) - 1
        todo = np.arange(len(keys))
        while len(todo):
            spot = at[todo]
            free = todo[self.key[spot] == 0]
            self.key[at[free]] = keys[free]  # of several at one place the last stays
            mine = self.key[spot] == keys[todo]
            self.slot[spot[mine]] = slots[todo[mine]]
            todo = todo[~mine]
            at[todo] = (at[todo] + 1) & last
        self.held += len(keys)

    def ask(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def letters(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids and their number for chunks of letters alone (behind a space, for the spaced kind), asked for many together."""
        size = end - start
        gap = int(self.kind == "words")  # a space between words; the spaced kind has its own
        upto = np.cumsum(size + gap)
        text = np.full(int(upto[-1]), 0x20, np.uint8)
        at = np.repeat(upto - size - gap, size) + ragged(size)
        text[at] = data[np.repeat(start, size) + ragged(size)]
        cut = [0, *upto[TOGETHER - 1 :: TOGETHER].tolist(), int(upto[-1])]
        raw = text.tobytes()
        parts = self.ask([raw[a:b].decode() for a, b in zip(cut, cut[1:], strict=False) if b > a])
        ids = np.fromiter((i for p in parts for i in p), np.uint32, sum(map(len, parts)))
        edge = np.flatnonzero(self.edge[ids])
        if len(edge) != len(start):
            return None
        return ids, np.diff(edge, prepend=-1) if gap else np.diff(np.append(edge, len(ids)))

    def add(self, keys: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Gives new chunks their slots."""
        lead = start + int(self.kind == "spaced")
        some = np.flatnonzero((end > lead) & ((lead == start) | (data[start] == 0x20)))
        plain, size = np.zeros(len(start), bool), (end - lead)[some]
        if len(some):
            own = data[np.repeat(lead[some], size) + ragged(size)]
            plain[some] = np.logical_and.reduceat(letters(own), np.cumsum(size) - size)
        one, rest = np.flatnonzero(plain), np.flatnonzero(~plain)
        got = self.letters(data, start[one], end[one]) if len(one) else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        if got is None:  # a vocabulary whose marks don't tell
            one, rest, got = one[:0], np.arange(len(start)), (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        lists = self.ask([data[start[k] : end[k]].tobytes().decode() for k in rest]) if len(rest) else []
        ids = np.concatenate([got[0], np.fromiter((i for x in lists for i in x), np.uint32, sum(map(len, lists)))])
        size = np.concatenate([got[1], np.array([len(x) for x in lists], np.int64)])
        n, m = self.held, len(size)
        if n + m + 1 > len(self.at):
            self.at = np.concatenate([self.at, np.zeros(max(len(self.at) // 2, m + 1), np.int32)])
        at = int(self.at[n])
        self.at[n + 1 : n + m + 1] = at + np.cumsum(size)
        if at + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat) // 2, len(ids)), np.uint32)])
        self.flat[at : at + len(ids)] = ids
        slots = np.empty(m, np.int64)
        slots[np.concatenate([one, rest])] = np.arange(n, n + m)
        self.put(keys, slots)
        return slots

    def ids(self, texts: list[bytes | None]) -> list[np.ndarray]:
        """Each text's ids as unsigned 32-bit integers."""
        out: list = [np.zeros(0, np.uint32)] * len(texts)
        full = [i for i, t in enumerate(texts) if t]
        if not full:
            return out
        plain = self.plain([texts[i] for i in full]) if self.kind else np.zeros(len(full), bool)
        fast = [i for i, ok in zip(full, plain, strict=True) if ok]
        other = [i for i, ok in zip(full, plain, strict=True) if not ok]
        if other:
            for i, e in zip(other, self.ask([texts[i].decode() for i in other]), strict=True):
                out[i] = np.array(e, np.uint32)
        if fast:
            for i, e in zip(fast, self.gathered([texts[i] for i in fast]), strict=True):
                out[i] = e
        return out

    def plain(self, texts: list[bytes]) -> np.ndarray:
        data = np.frombuffer(b"".join(texts), np.uint8)
        bad = ~PLAIN[data]
        # U+0080 to U+00A0, and what lies beyond U+024F
        bad[1:] |= ((data[:-1] == 0xC2) & (data[1:] < 0xA1)) | ((data[:-1] == 0xC9) & (data[1:] > 0x8F))
        size = np.array([len(t) for t in texts])
        ok = ~np.logical_or.reduceat(bad, np.cumsum(size) - size)
        for k in np.flatnonzero(ok):
            ok[k] = not any(a in texts[k] for a in self.added)
        return ok

    def gathered(self, texts: list[bytes]) -> list[np.ndarray]:
        data = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
        start, end = spans(data, self.kind)
        if self.held > self.most:
            self.clear()
        keys = hashes(data, start, end)
        own = self.find(keys)
        new = np.flatnonzero(own < 0)
        if len(new):
            code, key = pd.factorize(keys[new])
            first = np.empty(len(key), np.int64)
            first[code[::-1]] = new[::-1]
            own[new] = self.add(key, data, start[first], end[first])[code]
        at = self.at[own]
        size = self.at[own + 1] - at
        upto = np.cumsum(size)
        ids = self.flat[np.repeat(at, size) + ragged(size)]
        # the chunks' ids, cut where the texts end
        text_end = np.cumsum([len(t) + 1 for t in texts])
        cut = np.concatenate([[0], upto])[np.searchsorted(start, text_end)]
        return np.split(ids, cut[:-1])


def encoder(path: str) -> Encoder:
    """The worker's own, kept from task to task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _OPEN:
        _OPEN[path] = Encoder(path)
    return _OPEN[path]
