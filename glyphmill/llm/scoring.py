"""LM scoring by online logistic context mixing over the bits of tokens, along the words of a text.

The end of a text is a token of its own; a text's first token follows an end. Tokens are decided bit by bit along a
Huffman tree of the HEAD most frequent training tokens and two leaves more: other known tokens, and unknown ones. Each
decision has three predictors: the exact counts of the tree (order 0), and hashed contexts of the token before (order
1) and of the two tokens before (order 2), with the decision's place in the tree. The hashed counts are smoothed by
order 0; the log-odds of all three are mixed by weights that a gate selects from how often the contexts were seen, and
the mix is refined by an adaptive probability map. A known token outside the head then goes by its exact, discounted
count; an unknown one is spelled: its bytes and a closing space by a second mix, of hashed contexts of the bytes before.

Tasks read the training texts in order and learn online: a slice of tokens is predicted, the weights follow the
errors, then the contexts' counts take the slice in. A training token that occurs once in all is new where it stands,
so that it teaches the unknown leaf. The tasks' counts and maps are summed, their weights
averaged by how much each has learnt from; texts are scored with the sums. The spelling is learnt from each known token
once, in the chunk where it comes first.

Counts of all tokens (the base, the tree, the other known tokens) are exact rows by 64-bit hashes of the tokens, which
grow with the corpus and are never collected: each chunk of texts gets the counts of its own tokens in a file of the
shared folder. (Of 10^9 distinct tokens, two share a hash with a chance of 3 %; their counts would be added.)
Collected and broadcast are tables of fixed size: the head, and the hashed counts, whose slots follow the number of
training tokens up to 2^MOST_BITS an order, without collision checks: in a larger corpus, contexts that are frequent
there outweigh those they share a slot with, and the gated weights learn what an order is still worth.

Defined cases: a null or empty text is its end token; documents with a null id are training documents; repeated
rows count and are scored each; with no training document every count is 0; a very long text is a step of its own,
in slices of tokens; columns other than the id and the text are not read, whatever they are called; an empty table
gives no rows.
"""

from __future__ import annotations

import heapq
import io

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import files
from .common import drop, settle, steps, work_dir
from .text import SOLID, found_words, mix
from .tokens import ragged

U, U32 = np.uint64, np.uint32
#: Text bytes that the chunks of a table hold on the average, and hashes that a task holds before it counts them.
CHUNK_BYTES, HELD_HASHES = 32 << 20, 1 << 22
#: Text bytes that are cut to tokens at a time.
PIECE_BYTES = 1 << 20
#: Text bytes that a learning task reads at least, as each begins with fresh weights.
TASK_BYTES = 8 << 20
#: The end of a text, among the hashes of tokens.
END = U(0x5851F42D4C957F2D)
HEAD = 1 << 15
LEAST_BITS, MOST_BITS = 14, 21
SLICE = 3072
LEVEL = np.minimum(5, np.ceil(np.log2(np.arange(256) + 1.0) * 0.75)).astype(np.int64)
LEVELS = 6
GATES = LEVELS * LEVELS
INPUTS = 4
RATE = 0.05
BUCKETS, TRUST = 32, 50.0
SPELL_BITS, SPELL_TABLES, SPELL_SLICE, SPELL_RATE = 19, 5, 2048, 0.3
SPELL_GATES = LEVELS * LEVELS * 8
SPACE = 0x20
#: Entries of a table that are summed together.
PART = 1 << 14
#: Tasks that sum the parts, for each of the groups that tasks are summed in first.
SUM_TASKS = 16


# --- the tree of the frequent tokens -----------------------------------------------------


class Tree:
    """Huffman tree; leaf k is the k-th token of the head, then known tokens outside it, then unknown ones."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, other: int, new: int):
        order = np.argsort(hashes)
        self.hashes, self.tail, self.new = hashes[order], len(hashes), len(hashes) + 1
        weight = [*(counts[order].tolist()), max(1, other), max(1, new)]
        heap = [(w, i) for i, w in enumerate(weight)]
        heapq.heapify(heap)
        n, up, side, share = len(weight), {}, {}, []
        while len(heap) > 1:
            (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
            node = n + len(share)
            up[i] = up[j] = node
            side[i], side[j] = 0, 1
            share.append(b / (a + b))
            heapq.heappush(heap, (a + b, node))
        nodes, bits, size = [], [], []
        for leaf in range(n):
            at, way = leaf, []
            while at in up:
                way.append((up[at] - n, side[at]))
                at = up[at]
            size.append(len(way))
            nodes += [x for x, _ in reversed(way)]
            bits += [x for _, x in reversed(way)]
        self.size = np.array(size, np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.nodes, self.bits = np.array(nodes, np.int64), np.array(bits, np.float32)
        self.turn = np.arange(len(share)).astype(U32) * U32(0x9E3779B1)
        self.share = np.array(share, np.float32)
        self.odds = np.log(self.share / (1 - self.share))

    def leaves(self, hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
        """The leaf of each token. known: whether training documents have it, for tokens outside the head."""
        spot = np.minimum(np.searchsorted(self.hashes, hashes), max(0, self.tail - 1))
        inside = self.hashes[spot] == hashes if self.tail else np.zeros(len(hashes), bool)
        return np.where(inside, spot, np.where(known, self.tail, self.new))


def bits_for(tokens: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, (16 * int(tokens)).bit_length()))


class Mixer:
    """Hashed counts of orders 1 and 2, gated weights and the adaptive map."""

    def __init__(self, tree: Tree, bits: int):
        self.tree, self.bits = tree, bits
        # n0 and n1 of a slot as one complex number: one look-up gives both
        self.tables = [np.zeros(1 << bits, np.complex64) for _ in range(2)]
        seen1, seen2 = np.repeat(np.arange(LEVELS) > 0, LEVELS), np.tile(np.arange(LEVELS) > 0, LEVELS)
        self.weights = np.stack([np.where(seen1 | seen2, 0.3, 1.0), 0.4 * seen1, 0.4 * seen2, np.zeros(GATES)]).astype(np.float32)
        self.map = np.zeros((2, LEVELS * BUCKETS))

    def decisions(self, leaf: np.ndarray, c1: np.ndarray, c2: np.ndarray):
        """Row, place, bit and slots of each decision on tokens with the given leaves and context hashes."""
        tree = self.tree
        size = tree.size.take(leaf)
        row = np.repeat(np.arange(len(leaf)), size)
        upto = np.cumsum(size)
        at = (tree.at.take(leaf) - upto + size).take(row)
        at += np.arange(len(row))
        node, bit = tree.nodes.take(at), tree.bits.take(at)
        slots = []
        turn = tree.turn.take(node)
        for c in (c1, c2):
            x = c.take(row)
            x ^= turn
            x *= U32(0x85EBCA6B)
            x ^= x >> U32(15)
            x >>= U32(32 - self.bits)
            slots.append(x.astype(np.int64))
        return row, node, bit, slots

    def mixed(self, node: np.ndarray, slots: list[np.ndarray]):
        """Inputs, gate and level of the contexts, mixed log-odds."""
        p0 = self.tree.share.take(node)  # prior counts of one in all
        q0 = np.float32(1) - p0
        xs, levels = [self.tree.odds.take(node)], []
        for table, s in zip(self.tables, slots, strict=True):
            both = table.take(s)
            n0, n1 = both.real, both.imag
            x = n1 + p0
            x /= n0 + q0
            xs.append(np.log(x, out=x))
            n = n0 + n1
            levels.append(LEVEL.take(np.minimum(n, np.float32(255), out=n).astype(np.int64)))
        gate = levels[0] * LEVELS
        gate += levels[1]
        w = self.weights
        dot = w[3].take(gate)
        for k in range(3):
            dot += w[k].take(gate) * xs[k]
        return xs, gate, levels[0], np.clip(dot, -16, 16, out=dot)

    def cell(self, level: np.ndarray, dot: np.ndarray) -> np.ndarray:
        x = dot + np.float32(12)
        x *= np.float32(BUCKETS / 24)
        return level * BUCKETS + np.clip(x, 0, BUCKETS - 1, out=x).astype(np.int64)

    def learn(self, leaf: np.ndarray, c1: np.ndarray, c2: np.ndarray) -> None:
        """A slice of tokens: predicted, then learnt from."""
        _, node, bit, slots = self.decisions(leaf, c1, c2)
        xs, gate, level, dot = self.mixed(node, slots)
        p = 1 / (1 + np.exp(-dot))
        err = bit - p
        pull = RATE / np.maximum(np.bincount(gate, minlength=GATES), 1)
        for k in range(3):
            self.weights[k] += pull * np.bincount(gate, err * xs[k], GATES)
        self.weights[3] += pull * np.bincount(gate, err, GATES)
        cell = self.cell(level, dot)
        self.map[0] += np.bincount(cell, minlength=LEVELS * BUCKETS)
        self.map[1] += np.bincount(cell, bit, LEVELS * BUCKETS)
        for table, s in zip(self.tables, slots, strict=True):
            np.add.at(table.view(np.float32), 2 * s + (bit > 0), np.float32(1))

    def refined(self) -> tuple[np.ndarray, np.ndarray]:
        """What the map says in each cell, and how far it is followed."""
        return ((self.map[1] + 1e-2) / (self.map[0] + 2e-2)).astype(np.float32), (0.5 * self.map[0] / (self.map[0] + TRUST)).astype(np.float32)

    def score(self, leaf: np.ndarray, c1: np.ndarray, c2: np.ndarray) -> np.ndarray:
        """log10 of the tokens' ways through the tree."""
        out, (share, trust) = np.zeros(len(leaf)), self.refined()
        for k in range(0, len(leaf), SLICE):
            cut = slice(k, k + SLICE)
            row, node, bit, slots = self.decisions(leaf[cut], c1[cut], c2[cut])
            _, _, level, dot = self.mixed(node, slots)
            p = 1 / (1 + np.exp(-dot))
            cell = self.cell(level, dot)
            p += trust.take(cell) * (share.take(cell) - p)
            p = np.abs(p + bit - np.float32(1))
            out[cut] = np.bincount(row, np.log10(np.maximum(p, np.float32(1e-9))), len(out[cut]))
        return out


# --- spelling of unknown tokens ------------------------------------------------------------


class Speller:
    """Bits of the bytes of unknown tokens: hashed contexts of one to SPELL_TABLES bytes before, gated weights."""

    def __init__(self):
        self.table = np.zeros(2 * SPELL_TABLES << SPELL_BITS, np.float32)
        self.weights = np.full((SPELL_TABLES + 1, SPELL_GATES), 0.3, np.float32)

    def contexts(self, data: np.ndarray, start: np.ndarray, size: np.ndarray):
        """For each byte of the tokens with their closing space: token, value and the hashes of its contexts."""
        token = np.repeat(np.arange(len(size)), size + 1)
        place = ragged(size + 1)
        last = place == size[token]
        value = np.where(last, SPACE, data[np.minimum(start[token] + place, len(data) - 1)]) if len(data) else np.full(len(token), SPACE)
        value = value.astype(U32)
        hashes, h = [], np.zeros(len(value), U32)
        for k in range(1, SPELL_TABLES + 1):
            before = np.full(len(value), SPACE, U32)
            before[k:] = value[:-k]
            h = h * U32(0x2545F491) + np.where(place >= k, before, U32(SPACE)) + U32(k)
            hashes.append(h)
        return token, value, hashes

    def slots(self, hashes: list[np.ndarray], node: np.ndarray) -> list[np.ndarray]:
        out = []
        for k, h in enumerate(hashes):
            x = (h ^ node * U32(0x9E3779B1)) * U32(0x85EBCA6B)
            out.append(((x ^ x >> U32(15)) >> U32(32 - SPELL_BITS)).astype(np.int64) + (k << SPELL_BITS))
        return out

    def mixed(self, slots: list[np.ndarray], bit_no: int):
        xs, levels = [], []
        for s in slots:
            n0, n1 = self.table[2 * s], self.table[2 * s + 1]
            xs.append(np.log((n1 + np.float32(0.1)) / (n0 + np.float32(0.1))))
            levels.append(LEVEL[np.minimum(n0 + n1, np.float32(255)).astype(np.int32)])
        gate = (levels[-1] * LEVELS + levels[-2]) * 8 + bit_no
        dot = self.weights[-1][gate]
        for k, x in enumerate(xs):
            dot += self.weights[k][gate] * x
        return xs, gate, np.clip(dot, -16, 16)

    def run(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, learn: bool) -> np.ndarray:
        """log10 of each token's probability; online, slice after slice, if learning."""
        out = np.zeros(len(size))
        for k in range(0, len(size), SPELL_SLICE):
            token, value, hashes = self.contexts(data, start[k : k + SPELL_SLICE], size[k : k + SPELL_SLICE])
            node, total, met = np.ones(len(value), U32), np.zeros(len(value)), []
            for b in range(7, -1, -1):
                bit = (value >> U32(b)) & U32(1)
                slots = self.slots(hashes, node)
                xs, gate, dot = self.mixed(slots, b)
                p = 1 / (1 + np.exp(-dot))
                if learn:
                    err = bit - p
                    pull = SPELL_RATE / np.maximum(np.bincount(gate, minlength=SPELL_GATES), 1)
                    for i, x in enumerate(xs):
                        self.weights[i] += pull * np.bincount(gate, err * x, SPELL_GATES)
                    self.weights[-1] += pull * np.bincount(gate, err, SPELL_GATES)
                    met += [2 * s + bit for s in slots]
                else:
                    total += np.log10(np.maximum(np.where(bit > 0, p, 1 - p), 1e-9))
                node = node * U32(2) + bit
            if learn and met:
                np.add.at(self.table, np.concatenate(met), np.float32(1))
            out[k : k + SPELL_SLICE] = np.bincount(token, total, len(size[k : k + SPELL_SLICE]))
        return out


# --- streams of tokens -------------------------------------------------------------------


class Stream:
    """The tokens of some texts, one after another with their ends, and what their chunk knows of them."""

    def __init__(self, texts: list[bytes | None], keys: np.ndarray, counts: np.ndarray):
        h, bounds, self.data, start, size = found_words(texts, SOLID)
        n = np.diff(bounds)
        self.doc = np.repeat(np.arange(len(texts)), n + 1)
        word = np.arange(len(h)) + np.repeat(np.arange(len(texts)), n)
        total = len(self.doc)
        self.hash = np.full(total, END, U)
        self.hash[word] = h
        self.start, self.size = np.zeros(total, np.int64), np.zeros(total, np.int64)
        self.start[word], self.size[word] = start, size
        self.code, self.distinct = pd.factorize(self.hash)
        at = np.minimum(np.searchsorted(keys, self.distinct), len(keys) - 1)
        self.known = np.where(keys[at] == self.distinct, counts[at], 0)
        self.spot = at  # of the distinct tokens in keys, where they are there
        self.count = self.known[self.code]
        # contexts of the one token and the two tokens before; a text's first token follows an end
        own = (mix(self.distinct) >> U(32)).astype(U32)
        first = np.concatenate([[True], self.doc[1:] != self.doc[:-1]])
        c = own[self.code]
        self.c1 = np.concatenate([[U32(0)], c[:-1]])
        self.c1[first] = U32(0)
        back = np.concatenate([[U32(0)], self.c1[:-1]])
        back[first] = U32(1)
        self.c2 = self.c1 * U32(0x2545F491) + back * U32(0x9E3779B1) + U32(7)

    def leaves(self, tree: Tree, least: int) -> np.ndarray:
        """Leaves, where tokens that training documents have less than `least` times are unknown."""
        return tree.leaves(self.distinct, self.known >= least)[self.code]


class Model:
    """All that scores a text."""

    def __init__(self, mixer: Mixer, speller: Speller, discount: float, tail_mass: float):
        self.mixer, self.speller, self.discount, self.tail_mass = mixer, speller, discount, tail_mass

    def score(self, s: Stream) -> np.ndarray:
        """log10 of each token's probability."""
        tree = self.mixer.tree
        leaf = s.leaves(tree, 1)
        out = self.mixer.score(leaf, s.c1, s.c2)
        tail = leaf == tree.tail
        out[tail] += np.log10((s.count[tail] - self.discount) / self.tail_mass)
        new = np.flatnonzero(leaf == tree.new)
        out[new] += self.speller.run(s.data, s.start[new], s.size[new], False)
        return out


# --- over the corpus -----------------------------------------------------------------------


def chunked(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, int]:
    """id, text, held_out, chunk: a copy of the texts, cut to chunks of about CHUNK_BYTES; and how many bytes they hold."""
    held = F.crc32(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).cast("binary")) % 7 == 2
    rows, size = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.col(f"`{text}`"))), F.lit(0))).first()
    some = max(1, CHUNK_BYTES * rows // max(1, size))
    made = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"), held.alias("held_out"), F.expr(f"monotonically_increasing_id() div {some}").alias("chunk"))
    return settle(made, "scoring-texts"), size


def by_chunk(batches):
    """Pieces of some MB of text, none across chunks: chunk, texts, held_out and the record batch."""
    for batch in batches:
        for piece in steps(batch, "text", PIECE_BYTES):
            chunk = piece.column("chunk").to_numpy()
            cut = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), len(chunk)]
            for a, b in zip(cut, cut[1:], strict=False):
                part = piece.slice(a, b - a)
                yield int(chunk[a]), part.column("text").cast(pa.binary()).to_pylist(), part.column("held_out").to_numpy(zero_copy_only=False), part


def chunk_counts(base: DataFrame) -> DataFrame:
    """chunk, h, c: each chunk's distinct tokens with their count in its training documents."""

    def summed(parts):
        h, c = (np.concatenate(x) for x in zip(*parts, strict=True))
        code, distinct = pd.factorize(h)
        return distinct, np.bincount(code, c, len(distinct)).astype(np.int64)

    def run(batches):
        parts, held, now = [], 0, None

        def flush():
            h, c = summed(parts)
            order = np.argsort(h)
            done = pa.table({"chunk": pa.array(np.full(len(h), now)), "h": pa.array(h[order].view(np.int64)), "c": pa.array(c[order])})
            return done.to_batches(max_chunksize=100_000)

        for chunk, texts, held_out, _ in by_chunk(batches):
            if now is not None and chunk != now:
                yield from flush()
                parts, held = [], 0
            now = chunk
            h, bounds = found_words(texts, SOLID)[:2]
            n = np.diff(bounds)
            parts += [(h, np.repeat(~held_out, n).astype(np.int64)), (np.full(len(n), END, U), (~held_out).astype(np.int64))]
            held += len(h)
            if held > HELD_HASHES:
                parts, held = [summed(parts)], 0
        if now is not None:
            yield from flush()

    return base.mapInArrow(run, "chunk long, h long, c long")


def write_counts(counts: DataFrame, folder: str) -> int:
    """A file a chunk: its tokens' hashes in order, with their counts in all training documents. Returns how many."""
    chunks = counts.select("chunk").distinct().count()

    def run(batches):
        now, held = None, []

        def flush():
            table = pa.Table.from_batches(held).select(["h", "total", "lead"])
            order = np.argsort(table.column("h").to_numpy().view(U))
            out = io.BytesIO()
            with pa.ipc.new_file(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as f:
                f.write_table(table.take(pa.array(order)))
            files.put(folder, f"chunk-{now}.arrow", out.getvalue())

        for batch in batches:
            chunk = batch.column("chunk").to_numpy()
            cut = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), len(chunk)]
            for a, b in zip(cut, cut[1:], strict=False):
                if b > a:
                    if now is not None and chunk[a] != now:
                        flush()
                        held = []
                    now = int(chunk[a])
                    held.append(batch.slice(a, b - a))
        if held:
            flush()
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64())], names=["chunk"])

    # a task that is tried again writes the same files again
    counts.select("chunk", "h", "total", "lead").repartition(max(1, chunks), "chunk").sortWithinPartitions("chunk").mapInArrow(run, "chunk long").agg(F.count(F.lit(1))).first()
    return chunks


class Lookup:
    """The counts of the chunk that is read, from its file."""

    def __init__(self, folder: str):
        self.folder, self.now = folder, None

    def stream(self, chunk: int, texts: list) -> Stream:
        if chunk != self.now:
            got = pa.ipc.open_file(pa.BufferReader(files.read(self.folder, f"chunk-{chunk}.arrow"))).read_all()
            self.now, self.keys, self.counts = chunk, got.column("h").to_numpy().view(U), got.column("total").to_numpy()
            self.lead = got.column("lead").to_numpy(zero_copy_only=False).copy()
        return Stream(texts, self.keys, self.counts)

    def first(self, s: Stream) -> np.ndarray:
        """Places of words that come first, in all training documents, in this chunk and here; each is given once."""
        fresh = np.flatnonzero(self.lead[s.spot])
        self.lead[s.spot[fresh]] = False
        place = np.empty(len(s.distinct), np.int64)
        place[s.code[::-1]] = np.arange(len(s.code))[::-1]
        place = place[fresh]
        return place[s.size[place] > 0]


SUMS = "part int, task int, n long, value binary"


def summed_parts(parts: DataFrame, salt: int) -> DataFrame:
    """Sums of the parts' arrays, as streams: a task holds one array."""

    def run(batches):
        now, total, n = None, None, 0
        for batch in batches:
            for part, task, k, value in zip(*[batch.column(c).to_pylist() for c in ("part", "task", "n", "value")], strict=True):
                array = np.frombuffer(pa.decompress(value, k * 4, codec="zstd", asbytes=True), np.float32)
                if now != (part, task):
                    if now is not None:
                        yield packed(*now, total)
                    now, total = (part, task), array.astype(np.float64)
                else:
                    total += array
        if now is not None:
            yield packed(*now, total)

    salted = parts.withColumn("task", F.pmod("task", F.lit(salt)))
    # dealt by number, as the arrays are large rows
    return salted.repartition(SUM_TASKS * salt, "part", "task").sortWithinPartitions("part", "task").mapInArrow(run, SUMS)


def packed(part: int, task: int, array: np.ndarray) -> pa.RecordBatch:
    raw = array.astype(np.float32)
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([task], pa.int32()), pa.array([len(raw)], pa.int64()), pa.array([pa.compress(raw.tobytes(), codec="zstd", asbytes=True)], pa.binary())], names=["part", "task", "n", "value"])


def flat_state(mixer: Mixer, speller: Speller, learnt: float) -> np.ndarray:
    """All that a task has learnt, as one array: counts and maps, weights times what they were learnt from, and that."""
    parts = [*(t.view(np.float32) for t in mixer.tables), speller.table, mixer.map.ravel(), mixer.weights.ravel() * learnt, speller.weights.ravel() * learnt, [learnt]]
    return np.concatenate([np.asarray(p, np.float32) for p in parts])


def from_state(tree: Tree, bits: int, state: np.ndarray | None) -> tuple[Mixer, Speller]:
    mixer, speller = Mixer(tree, bits), Speller()
    if state is None or not state[-1]:
        return mixer, speller
    sizes = [2 << bits, 2 << bits, speller.table.size, mixer.map.size, mixer.weights.size, speller.weights.size]
    one, two, table, map_, w, v = np.split(state[:-1], np.cumsum(sizes)[:-1])
    mixer.tables = [x.view(np.complex64) for x in (one, two)]
    speller.table = table
    mixer.map = map_.reshape(mixer.map.shape).astype(np.float64)
    mixer.weights = (w / state[-1]).reshape(mixer.weights.shape).astype(np.float32)
    speller.weights = (v / state[-1]).reshape(speller.weights.shape).astype(np.float32)
    return mixer, speller


def learnt_state(base: DataFrame, tasks: int, folder: str, chunks: int, tree, bits: int) -> np.ndarray | None:
    """What all tasks have learnt from the training documents: an array of fixed size."""

    def run(batches):
        from pyspark import TaskContext

        mixer, speller, look, learnt = Mixer(tree.value, bits), Speller(), Lookup(folder), 0
        for chunk, texts, held_out, _ in by_chunk(batches):
            s = look.stream(chunk, [t for t, held in zip(texts, held_out, strict=True) if not held])
            if not len(s.doc):
                continue
            leaf = s.leaves(tree.value, 2)  # without its own occurrence, a token that occurs once is unknown
            for k in range(0, len(leaf), SLICE):
                cut = slice(k, k + SLICE)
                mixer.learn(leaf[cut], s.c1[cut], s.c2[cut])
            first = look.first(s)
            speller.run(s.data, s.start[first], s.size[first], True)
            learnt += len(leaf)
        if learnt:
            state, task = flat_state(mixer, speller, learnt / 1e6), TaskContext.get().partitionId()
            for k in range(0, len(state), PART):
                yield packed(k // PART, task, state[k : k + PART])

    parts = base.where("NOT held_out").select("chunk", "text", "held_out").coalesce(tasks).mapInArrow(run, SUMS)
    once = summed_parts(parts, max(1, int(chunks**0.5)))
    rows = sorted(summed_parts(once, 1).collect(), key=lambda r: r["part"])  # the tables' parts, a fixed number
    if not rows:
        return None
    return np.concatenate([np.frombuffer(pa.decompress(r["value"], r["n"] * 4, codec="zstd", asbytes=True), np.float32) for r in rows])


def score(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score, bytes."""
    spark = docs.sparkSession
    folder = work_dir(spark, "scoring")
    base, size = chunked(docs, key, text)
    words = chunk_counts(base)
    same = Window.partitionBy("h")
    counts = settle(words.select("chunk", "h", F.sum("c").over(same).alias("total"), (F.col("chunk") == F.coalesce(F.min(F.when(F.col("c") > 0, F.col("chunk"))).over(same), F.lit(-1))).alias("lead")), "scoring-counts")
    chunks = write_counts(counts, folder)
    known = counts.where("lead AND total > 0")
    n, v, once, twice = known.agg(F.coalesce(F.sum("total"), F.lit(0)), F.count(F.lit(1)), F.count_if(F.col("total") == 1), F.count_if(F.col("total") == 2)).first()
    head = known.where("total > 2").orderBy(F.desc("total"), "h").limit(HEAD).select("h", "total").collect()
    drop(counts)
    inside = sum(r["total"] for r in head)
    others, other_types = n - inside - once, v - len(head) - once
    discount = once / (once + 2 * twice) if once and twice else 0.5
    tree = Tree(np.array([r["h"] for r in head], np.int64).view(U), np.array([r["total"] for r in head], np.int64), others, once)
    tail_mass = max(1e-9, (n - inside) - discount * (other_types + once))
    held_tree, bits = spark.sparkContext.broadcast(tree), bits_for(n)
    state = spark.sparkContext.broadcast(learnt_state(base, max(1, -(-size // TASK_BYTES)), folder, chunks, held_tree, bits))
    floor = float(np.log10(n + v + 1))
    schema = T.StructType([T.StructField("id", docs.schema[key].dataType), T.StructField("held_out", T.BooleanType()), *[T.StructField(x, T.LongType()) for x in ("n_tokens", "n_known", "bytes")], *[T.StructField(x, T.DoubleType()) for x in ("base_score", "score")]])

    def run(batches):
        model, look = Model(*from_state(held_tree.value, bits, state.value), discount, tail_mass), Lookup(folder)
        for chunk, texts, _, part in by_chunk(batches):
            s = look.stream(chunk, texts)
            per = lambda x, s=s, m=len(texts): np.bincount(s.doc, x, m)
            tokens = np.bincount(s.doc, minlength=len(texts))
            lb = np.log10(s.known + 1.0)[s.code]
            columns = [pa.array(tokens), pa.array(per(s.count > 0).astype(np.int64)), pa.array([len(t or b"") for t in texts], pa.int64()), pa.array(per(lb) - tokens * floor), pa.array(per(model.score(s)))]
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("held_out"), *columns], names=schema.names)

    done = base.select("id", "text", "held_out", "chunk").mapInArrow(run, schema)
    return done.select(F.col("id").alias(key), "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score", "bytes")


def op9(spark, sf_dir: str) -> DataFrame:
    df = score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    bits = -F.col("score") * float(np.log2(10)) / F.greatest(F.col("bytes"), F.lit(1))
    return df.select(*[c for c in df.columns if c != "bytes"], bits.alias("bits_per_byte"))


