"""Adaptive context-mixing range coder for token ids, many blocks in step.

A block is coded on its own, from fresh models, and decoded from its bytes, its number of ids and the size of its
alphabet alone. Three predictions are mixed for each id: the id that last followed the two ids before (order 2), the
one that last followed the id before (order 1), each with a weight that adapts to how often predictions of its
confidence came true, and an adaptive distribution over all ids (order 0). Order 0 counts the block's ids so far
in SLOTS0 slots, over a falling prior: ids below DIRECT have a slot each, the others share slots of equal numbers of ids.
Weights and order 0's running sums are made anew from what was coded since, at growing distances (renewals). The mixed interval drives a carry-less range coder
with 64-bit low and 32-bit output words. All blocks of a call take each step together as numpy vectors; the encoder, which knows all
ids, makes the shares of many steps at once and takes steps in the range coder alone.
"""

from __future__ import annotations

import struct

import numpy as np

BLOCK = 8192
ORDER0_BITS, TOTAL_BITS = 20, 26
#: Ids must be below this: every id keeps a share of order 0.
MOST_IDS = 1 << 19
SLOTS0, DIRECT = 4095, 3072
SLOTS1, SLOTS2 = 1 << 12, 1 << 13
LEVELS = 8
#: Prior counts of order 0 in all, how they fall with the id, and the longest way between two renewals.
PRIOR, FALL, RENEW = 256.0, 512.0, 1024
#: Running sums are searched in three steps of this many; its cube is SLOTS0 + 1.
STRIDE_BITS = 4
STRIDE = 1 << STRIDE_BITS
#: Blocks whose sums are made anew at a time, and steps whose shares are made at a time: both stay in the processor's cache.
LANES, SPELL = 16, 256
#: Blocks whose models the encoder makes at a time.
TOGETHER = 64
U = np.uint64
WORD = U(1 << 32)
W_START = (0.0, 0.2, 0.4, 0.55, 0.65, 0.75, 0.82, 0.88)
#: A weight's start counts as so many predictions; what was learnt counts half after each renewal.
TRUST, KEEP = 8.0, 0.5
SCALE = np.float32((1 << TOTAL_BITS) - (1 << ORDER0_BITS) * 2)
#: By confidence, after a miss and after a hit: what is added to it, and whether the context takes the new id with confidence 1 (a hit is never 0 or empty).
_C = np.arange(LEVELS, dtype=np.int32)
STEP = np.concatenate([(_C >> 1) - _C, np.minimum(_C + 1, LEVELS - 1) - _C]).astype(np.int32)
ANEW = np.concatenate([_C <= 2, np.zeros(LEVELS, bool)])


def renewals(longest: int) -> set[int]:
    """Steps before which order 0's sums are made anew: early ones near one another, later ones RENEW apart."""
    out, at = set(), 16
    while at < longest:
        out.add(at)
        at += min(at, RENEW)
    return out


class Order0:
    """Adaptive counts of n blocks over an alphabet, with running sums of shares of 2^ORDER0_BITS. across: a block's steps are a row, not a column."""

    def __init__(self, n: int, alphabet: int, across: bool = False):
        if alphabet > MOST_IDS:
            raise ValueError(f"ids up to {alphabet - 1}; the coder takes ids below {MOST_IDS}")
        self.n = n
        alphabet = max(1, alphabet)
        self.direct = min(DIRECT, alphabet)
        groups = SLOTS0 - DIRECT
        self.wide = max(1, -(-(alphabet - self.direct) // groups))
        low = np.concatenate([np.arange(self.direct), np.arange(self.direct, alphabet, self.wide)])
        self.low = low.astype(np.int64)
        self.width = np.diff(np.append(self.low, alphabet))
        self.slots = len(self.low)
        self.of = np.repeat(np.arange(self.slots), self.width)
        self.row = np.arange(n, dtype=np.int64) * self.slots
        prior = self.width / (self.low + self.width / 2 + FALL)
        self.count = np.tile((prior * (PRIOR / prior.sum())).astype(np.float32), (n, 1))
        self.flat = self.count.reshape(-1)
        self.floor = np.cumsum(self.width).astype(np.int32)
        self.spare = (1 << ORDER0_BITS) - alphabet
        # where each slot's share begins, the end of the last, and the end again up to SLOTS0 + 1 places
        self.stride = STRIDE**3
        self.edge = np.arange(n, dtype=np.int64) * self.stride
        self.sums = np.full((n, self.stride), 1 << ORDER0_BITS, np.int32)
        self.sums[:, 0] = 0
        self.cum = self.sums.reshape(-1)
        self.fine = self.sums.reshape(-1, STRIDE)
        self.some = np.empty((min(n, LANES), self.slots))
        self.whole, self.begin = self.width.astype(np.float64), self.low.astype(np.float64)
        if across:
            self.row, self.edge = self.row[:, None], self.edge[:, None]
        self.renew()

    def renew(self) -> None:
        """Every id keeps a share of one; the rest goes by counts."""
        for k in range(0, self.n, LANES):
            count, sums = self.count[k : k + LANES], self.sums[k : k + LANES, 1 : self.slots + 1]
            upto = self.some[: len(count)]
            upto[:] = count
            np.cumsum(upto, axis=1, out=upto)
            upto *= self.spare / upto[:, -1:]
            sums[:] = upto  # cut: what a rounding put above spare goes
            sums += self.floor
        middle = self.sums[:, ::STRIDE].copy()  # not a view: rows are taken from it
        self.middle, self.top = middle.reshape(-1, STRIDE), middle[:, ::STRIDE].copy()

    def slot(self, ids: np.ndarray) -> np.ndarray:
        return self.of.take(ids)

    def shares(self, ids: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the shares of whole steps' ids begin, and how wide they are."""
        at = self.edge + slot
        a = self.cum.take(at).astype(np.float64)
        share = self.cum.take(at + 1) - a
        wide, k = self.whole.take(slot), ids - self.low.take(slot)
        # quotients of whole numbers below 2^53 are cut exactly: none rounds up to a whole number that it doesn't reach
        first = np.floor(share * k / wide)
        return (a + first).astype(np.int64), (np.floor(share * (k + 1) / wide) - first).astype(np.int64)

    def find(self, lane: np.ndarray | None, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids whose shares hold v, where these begin, and how wide they are, as whole float64. lane: the blocks (None: all)."""
        v32 = v.astype(np.int32)[:, None]
        edge = self.edge if lane is None else self.edge.take(lane)
        at = edge >> 2 * STRIDE_BITS
        at += upto(self.top if lane is None else self.top.take(lane, axis=0), v32)
        place = upto(self.middle.take(at, axis=0), v32)
        at <<= STRIDE_BITS
        at += place
        place = upto(self.fine.take(at, axis=0), v32)
        at <<= STRIDE_BITS
        at += place
        slot = at - edge
        a = self.cum.take(at).astype(np.float64)
        at += 1
        share = self.cum.take(at) - a
        wide = self.whole.take(slot)
        k = v - a
        k += 1
        k *= wide
        k -= 1
        k /= share
        np.floor(k, out=k)
        start = share * k
        start /= wide
        np.floor(start, out=start)
        ids = self.begin.take(slot)
        ids += k
        k += 1
        share *= k
        share /= wide
        np.floor(share, out=share)
        share -= start
        start += a
        return ids, start, share

    def add(self, ids: np.ndarray) -> None:
        """Counts whole steps."""
        np.add.at(self.flat, self.row + self.slot(ids), np.float32(1))


def upto(sums: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The last place in each row, rising from at most v, that is not above v."""
    place = (sums <= v).argmin(axis=1)  # the first above v; 0 if none is
    place -= 1
    place &= STRIDE - 1
    return place


def slots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slots of orders 2 and 1 behind the ids a (plus one) and, before them, b."""
    one = a * np.int32(40503)
    two = b * np.int32(30011)
    two ^= one
    two >>= 3
    two &= np.int32(SLOTS2 - 1)
    one >>= 4
    one &= np.int32(SLOTS1 - 1)
    return two, one


class Weights:
    """Weights of n blocks by confidence: orders 2 and 1 side by side, in tables of 2n rows of 2 * LEVELS, misses before hits."""

    def __init__(self, n: int):
        self.n = n
        self.rows = np.arange(2 * n, dtype=np.int32) * (2 * LEVELS)
        self.seen, self.true = np.full((2 * n, LEVELS), TRUST), np.tile(np.array(W_START) * TRUST, (2 * n, 1))
        self.renew(None)

    def renew(self, code: np.ndarray | None) -> None:
        """Weights from the predictions since the last time. code: their places in the tables."""
        if code is not None:
            count = np.bincount(code.ravel(), minlength=4 * self.n * LEVELS).reshape(-1, 2, LEVELS)
            self.seen = self.seen * KEEP + count.sum(axis=1)
            self.true = self.true * KEEP + count[:, 1]
        weight = np.clip((self.true + 0.02) / (self.seen + 0.04), 0.002, 0.985).astype(np.float32)
        weight[:, 0] = 0  # an empty slot predicts nothing
        weight = np.concatenate([weight, weight], axis=1).ravel()
        self.two = (weight[: len(weight) // 2] * SCALE).astype(np.int32)
        self.left, self.weight = (SCALE - self.two).astype(np.float64), weight.astype(np.float64)

    def shares(self, two: np.ndarray, one: np.ndarray, differ: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shares of 2^TOTAL_BITS that orders 2 and 1 give their predictions. two, one: the places of these; differ: whether they are different ids."""
        f1 = self.left.take(two)
        f1 *= self.weight.take(one)
        f1 = f1.astype(np.int32)
        f1 *= differ
        return self.two.take(two), f1


class Models:
    """Contexts and weights of n blocks by steps: orders 2 and 1 side by side, in arrays of 2n.

    A slot of a context holds the id it predicts (plus one; 0: none) times LEVELS, and a confidence.
    """

    def __init__(self, n: int, longest: int):
        self.n, self.weights = n, Weights(n)
        lane = np.arange(n, dtype=np.int32)
        self.row = np.concatenate([lane * SLOTS2, lane * SLOTS1 + np.int32(n * SLOTS2)])
        self.table = np.zeros(n * (SLOTS1 + SLOTS2), np.int32)
        self.a, self.b = np.zeros(n, np.int32), np.zeros(n, np.int32)
        self.near, self.at = np.empty(2 * n, np.int32), np.empty(2 * n, np.int64)
        self.held, self.p, self.c, self.level = (np.empty(2 * n, np.int32) for _ in range(4))
        self.p2, self.p1 = self.p[:n], self.p[n:]
        self.came, self.hit = np.empty(2 * n, np.int32), np.empty(2 * n, bool)
        self.past = np.empty((min(longest, RENEW), 2 * n), np.int32)
        self.steps = 0

    def renew(self) -> None:
        self.weights.renew(self.past[: self.steps])
        self.steps = 0

    def predict(self) -> tuple[np.ndarray, np.ndarray]:
        """Shares of 2^TOTAL_BITS that orders 2 and 1 give their predictions p2 and p1 (ids plus one)."""
        n = self.n
        self.near[:n], self.near[n:] = slots(self.a, self.b)
        self.near += self.row
        self.at[:] = self.near
        self.table.take(self.at, out=self.held, mode="clip")
        np.right_shift(self.held, 3, out=self.p)
        np.bitwise_and(self.held, 7, out=self.c)
        np.add(self.weights.rows, self.c, out=self.level)
        return self.weights.shares(self.level[:n], self.level[n:], self.p1 != self.p2)

    def update(self, s: np.ndarray) -> None:
        """s: the ids plus one."""
        n = self.n
        np.equal(self.p2, s, out=self.hit[:n])
        np.equal(self.p1, s, out=self.hit[n:])
        up = self.hit.view(np.int8) << np.int8(3)
        np.add(self.level, up, out=self.past[self.steps])
        self.steps += 1
        self.c += up
        np.left_shift(s, 3, out=self.came[:n])
        self.came[:n] += 1
        self.came[n:] = self.came[:n]
        self.held += STEP.take(self.c)
        np.copyto(self.held, self.came, where=ANEW.take(self.c))
        self.table[self.at] = self.held
        self.b, self.a = self.a, s


def sorted_blocks(sizes: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks by size, longest first: order, sizes, and how many are live at each step."""
    order = np.argsort([-x for x in sizes], kind="stable")
    size = np.array([sizes[i] for i in order], np.int64)
    live = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), side="left")
    return order, size, live


def held_before(rows: np.ndarray, s: np.ndarray) -> np.ndarray:
    """What the context of each step holds as the step begins. rows: each step's slot, a row a table; s: the ids plus one, a row a block.

    A slot's steps follow one another in the tables sorted by slot and step; all slots take their k-th step together.
    """
    n, longest = rows.shape
    bits = (longest - 1).bit_length()
    kind = np.int32 if int(rows.max()) >> (31 - bits) == 0 else np.int64
    at = rows.astype(kind) << bits
    at |= np.arange(longest, dtype=kind)
    at.sort(axis=1)
    slot = at >> bits
    first = np.ones((n, longest), bool)
    np.not_equal(slot[:, 1:], slot[:, :-1], out=first[:, 1:])
    at &= kind((1 << bits) - 1)
    at += (np.arange(n) % len(s) * longest).astype(kind)[:, None]
    s8 = (s.reshape(-1) << 3).take(at).reshape(-1)
    begin = np.flatnonzero(first)
    size = np.diff(begin, append=n * longest)
    begin = begin[np.argsort((-size).astype(np.int16 if longest < 1 << 15 else np.int64), kind="stable")]
    live = len(size) - np.cumsum(np.bincount(size))  # slots with more than k steps
    out = np.zeros(n * longest, np.int32)
    held = s8.take(begin) + np.int32(1)
    for k in range(1, len(live) - 1):
        m = int(live[k])
        e = begin[:m] + k
        held = held[:m]
        out[e] = held
        came = s8.take(e)
        c = held & np.int32(7)
        c += ((held ^ came) < LEVELS).view(np.int8) << 3
        held = held + STEP.take(c)
        np.copyto(held, came + np.int32(1), where=ANEW.take(c))
    back = np.empty((n, longest), np.int32)
    at += (np.arange(n) // len(s) * s.size).astype(kind)[:, None]
    back.reshape(-1)[at.reshape(-1)] = out
    return back


def intervals(ids: np.ndarray, alphabet: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the shares of 2^TOTAL_BITS of all ids begin, and how wide they are: all steps of some blocks, a row each."""
    n, longest = ids.shape
    s = ids + np.int32(1)
    past = np.zeros((n, longest + 2), np.int32)
    past[:, 2:] = s
    rows = np.concatenate(slots(past[:, 1:-1], past[:, :-2]))
    held = held_before(rows, s)
    m, zero = Weights(n), Order0(n, alphabet, across=True)
    level = held & np.int32(7)
    level += m.rows[:, None]
    held >>= 3
    p2, p1 = held[:n], held[n:]
    hit, differ = held == np.concatenate([s, s]), p1 != p2
    code = level + (hit.view(np.int8) << np.int8(3))
    start, width = np.empty((n, longest), np.uint32), np.empty((n, longest), np.uint32)
    edges = [0, *sorted(renewals(longest)), longest]
    for x, y in zip(edges, edges[1:], strict=False):
        if x:
            zero.add(ids[:, since:x])
            zero.renew()
            m.renew(code[:, since:x])
        since = x
        # a few steps at a time, which stay in the processor's cache
        for x in range(x, y, SPELL):
            z = slice(x, min(x + SPELL, y))
            f2, f1 = m.shares(level[:n, z], level[n:, z], differ[:, z])
            use2 = hit[:n, z] & (f2 > 0)
            use1 = hit[n:, z] & ~use2 & (f1 > 0)
            lo, wide = zero.shares(ids[:, z], zero.slot(ids[:, z]))
            before = f2 + f1
            f0 = (1 << TOTAL_BITS) - before.astype(np.int64)
            wide += lo
            lo *= f0
            lo >>= ORDER0_BITS
            wide *= f0
            wide >>= ORDER0_BITS
            wide -= lo
            lo += before
            for use, a, b in ((use1, f2, f1), (use2, 0, f2)):
                np.copyto(lo, a, where=use)
                np.copyto(wide, b, where=use)
            start[:, z], width[:, z] = lo, wide
    return start, width


def encode(blocks: list[np.ndarray], alphabet: int) -> list[bytes]:
    """One payload a block; blocks hold ids below alphabet.

    All ids are known, so that the models need no steps of their own; the range coder goes by steps.
    """
    if not blocks:
        return []
    order, size, live = sorted_blocks([len(b) for b in blocks])
    n, longest = len(blocks), int(size[0])
    starts, widths = np.zeros((longest, n), np.uint32), np.zeros((longest, n), np.uint32)
    for k in range(0, n, TOGETHER):
        own = order[k : k + TOGETHER]
        if not size[k]:
            break
        ids = np.zeros((len(own), int(size[k])), np.int32)
        for row, i in zip(ids, own, strict=True):
            row[: len(blocks[i])] = blocks[i]
        a, b = intervals(ids, alphabet)
        starts[: size[k], k : k + len(own)], widths[: size[k], k : k + len(own)] = a.T, b.T
    low, span = np.zeros(n, U), np.full(n, (1 << 64) - 1, U)
    go, cut = np.zeros((longest, n), bool), np.empty(n, bool)
    r, end = np.empty(n, U), np.empty(n, U)
    tail = np.zeros(n, U)
    ends = set(size.tolist())
    for step in range(longest):
        full = go[step]
        np.right_shift(span, U(TOTAL_BITS), out=r)
        np.multiply(r, widths[step], out=span)
        np.multiply(r, starts[step], out=r)
        np.add(low, r, out=low)
        np.less(span, WORD, out=full)
        np.add(low, span, out=end)
        np.bitwise_xor(low, end, out=end)
        np.greater_equal(end, WORD, out=cut)
        np.logical_and(cut, full, out=cut)
        some = cut.nonzero()[0]
        if len(some):
            span[some] = (~low.take(some) + U(1)) & (WORD - U(1))
        # the interval's upper word goes out, or would if it were full: it takes the place of its share
        np.right_shift(low, U(32), out=starts[step], casting="unsafe")
        np.multiply(full, U(32), out=r)
        np.left_shift(low, r, out=low)
        np.left_shift(span, r, out=span)
        if step + 1 in ends:
            np.copyto(tail, low, where=size == step + 1)
    result: list = [b""] * n
    for k in range(0, n, TOGETHER):
        words, out = (np.ascontiguousarray(x[:, k : k + TOGETHER].T) for x in (starts, go))
        for j, i in enumerate(order[k : k + TOGETHER]):
            if m := int(size[k + j]):
                last = int(tail[k + j])
                result[i] = words[j, :m][out[j, :m]].astype("<u4").tobytes() + struct.pack("<II", last >> 32, last & 0xFFFFFFFF)
    return result


def decode(payloads: list[bytes], sizes: list[int], alphabet: int) -> list[np.ndarray]:
    """The blocks' ids."""
    if not payloads:
        return []
    order, size, live = sorted_blocks(sizes)
    n, longest = len(payloads), int(size[0])
    width_ = max(len(p) // 4 for p in payloads) + 4
    words = np.zeros((n, width_), np.uint32)
    for k, i in enumerate(order):
        w = np.frombuffer(payloads[i], "<u4")
        words[k, : len(w)] = w
    words = words.reshape(-1)
    off = (words[::width_].astype(U) << U(32)) | words[1::width_]  # what was read less the low end
    read = np.arange(n, dtype=np.int64) * width_ + 2
    m, zero, since = Models(n, longest), Order0(n, alphabet), 0
    low, span = np.zeros(n, U), np.full(n, (1 << 64) - 1, U)
    grid = np.zeros((longest, n), np.int32)
    again = renewals(longest)
    r, end, full, cut = np.empty(n, U), np.empty(n, U), np.empty(n, bool), np.empty(n, bool)
    rest, share = np.empty(n), np.empty(n)
    for step in range(longest):
        k = int(live[step])
        if step in again:
            zero.add(grid[since:step])
            zero.renew()
            m.renew()
            since = step
        f2, f1 = m.predict()
        np.right_shift(span, U(TOTAL_BITS), out=r)
        np.floor_divide(off, r, out=end)
        np.minimum(end, U((1 << TOTAL_BITS) - 1), out=end)
        v = end.astype(np.int32)
        before = f2 + f1
        held = np.subtract(v, before, out=rest)
        known = (held < 0).nonzero()[0]
        # order 0 of all blocks, then those that the contexts foretold; quotients of whole numbers below 2^53 are cut exactly
        np.maximum(held, 0, out=held)
        held += 1
        held *= 1 << ORDER0_BITS
        held -= 1
        f0 = np.subtract(1 << TOTAL_BITS, before, out=share)
        held /= f0
        np.floor(held, out=held)
        ids, start, width = zero.find(None, held)
        f0 *= 1 / (1 << ORDER0_BITS)
        width += start
        width *= f0
        np.floor(width, out=width)
        start *= f0
        np.floor(start, out=start)
        width -= start
        start += before
        s = ids.astype(np.int32)
        s += 1
        if len(known):
            a = f2.take(known)
            two = v.take(known) < a
            s[known] = np.where(two, m.p2.take(known), m.p1.take(known))
            start[known] = np.where(two, 0, a)
            width[known] = np.where(two, a, f1.take(known))
        if k < n:
            s[k:] = 1
        m.update(s)
        np.subtract(s, 1, out=grid[step])
        np.multiply(r, start.astype(U), out=end)
        low += end
        off -= end
        np.multiply(r, width.astype(U), out=span)
        np.less(span, WORD, out=full)
        np.add(low, span, out=end)
        end ^= low
        np.greater_equal(end, WORD, out=cut)
        cut &= full
        some = cut.nonzero()[0]
        if len(some):
            span[some] = (~low.take(some) + U(1)) & (WORD - U(1))
        r[:] = full
        read += r.view(np.int64)
        np.multiply(r, words.take(read - 1), out=end)
        r *= WORD - U(1)
        r += U(1)
        low *= r
        span *= r
        off *= r
        off |= end
        if k < n:  # ended blocks idle
            span[k:], low[k:], off[k:] = U((1 << 64) - 1), U(0), U(0)
    result: list = [None] * n
    for k in range(0, n, TOGETHER):
        ids = np.ascontiguousarray(grid[:, k : k + TOGETHER].T)
        for j, i in enumerate(order[k : k + TOGETHER]):
            result[i] = ids[j, : size[k + j]]
    return result
