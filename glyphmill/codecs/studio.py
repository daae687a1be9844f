"""Codecs of single studios and of program code, next to the console's own (bios.py): decode and encode of whole streams.

Each decode gives the bytes and how much input they took; damaged input raises CodecError. Encoders take the
cheapest parse for the stream's own prices (matching.py).
"""

from __future__ import annotations

import heapq
import struct
from collections import Counter

from . import bios
from .bios import CodecError, copy, head, header
from .matching import cheapest, flagged, longest


def units_of(data: bytes, prices, *, most: int, far: int, near: int = 1, least: int = 3, literal: int = 9, cuts=()):
    """The cheapest units, as (place, length, distance)."""
    at = 0
    for n, d in cheapest(longest(data, least=least, most=most, near=near, far=far), literal, prices, cuts, least):
        yield at, n, d
        at += n


def copies(data: bytes, at: int, size: int, unit, negated: bool = False) -> tuple[bytes, int]:
    """A stream of flagged groups: unit(place) gives a copy's length, distance and the place behind it."""
    out = bytearray()
    try:
        while len(out) < size:
            flags, at = (-data[at] if negated else data[at]) & 0xFF, at + 1
            for k in range(8):
                if len(out) >= size:
                    break
                if flags << k & 0x80:
                    n, distance, at = unit(at)
                    copy(out, distance, min(n, size - len(out)))
                else:
                    out.append(data[at])
                    at += 1
    except IndexError:
        raise CodecError("cut stream") from None
    return bytes(out), at


# --- the console's LZ streams by the cheapest parse ------------------------------------------


def lz_encode_best(data: bytes, kind: int = 0x10) -> bytes:
    """An LZ stream of type 0x10 or 0x11 with the fewest bits, padded to four bytes."""
    if kind == 0x10:
        most, cuts, wide = 18, range(3, 18), lambda n: 2
    else:
        most, cuts, wide = 0x10110, (*range(3, 17), 0x110), lambda n: 2 if n <= 16 else 3 if n <= 0x110 else 4

    def piece(n: int, back: int) -> bytes:
        back -= 1
        if kind == 0x10:
            return struct.pack(">H", n - 3 << 12 | back)
        if n <= 16:
            return struct.pack(">H", n - 1 << 12 | back)
        if n <= 0x110:
            return (n - 0x11 << 12 | back).to_bytes(3, "big")
        return (1 << 28 | n - 0x111 << 12 | back).to_bytes(4, "big")

    units = units_of(data, lambda n, d: 1 + 8 * wide(n), most=most, far=4096, cuts=cuts)
    out = head(kind, len(data)) + flagged((d > 0, piece(n, d) if d else data[i : i + 1]) for i, n, d in units)
    return out + bytes(-len(out) % 4)


# --- Huffman codes -------------------------------------------------------------------------


def huff_encode(data: bytes, bits: int = 8) -> bytes:
    """Huffman codes of 4 (low half first) or 8 bits, as bios.huff_decode reads them."""
    symbols = [x for b in data for x in (b & 15, b >> 4)] if bits == 4 else list(data)
    count = Counter(symbols)
    for x in range(2):  # a tree has two leaves at least
        if len(count) < 2:
            count.setdefault(x if x not in count else x + 1, 0)
    try:
        root = code_tree(count)
        tree = tree_bytes(root)
    except OverflowError:  # too wide for the nodes' six bits: bushes of 32 symbols along a stem
        ranked = [x for x, _ in count.most_common()]
        bushes = [code_tree({x: count[x] for x in ranked[k : k + 32]}) for k in range(0, len(ranked), 32)]
        root = bushes.pop()
        while bushes:
            root = (bushes.pop(), root)
        tree = tree_bytes(root)
    codes: dict[int, str] = {}
    todo = [(root, "")]
    while todo:
        node, code = todo.pop()
        if isinstance(node, tuple):
            todo += [(node[0], code + "0"), (node[1], code + "1")]
        else:
            codes[node] = code
    stream = "".join(map(codes.__getitem__, symbols))
    stream += "0" * (-len(stream) % 32)
    words = b"".join(int(stream[k : k + 32], 2).to_bytes(4, "little") for k in range(0, len(stream), 32))
    return head(0x20 | bits, len(data)) + tree + words


def code_tree(count: dict[int, int]):
    """Nested pairs of symbols."""
    heap = [(n, x, x) for x, n in sorted(count.items())]
    heapq.heapify(heap)
    number = 256
    while len(heap) > 1:
        (m, _, a), (n, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        heapq.heappush(heap, (m + n, number, (a, b)))
        number += 1
    return heap[0][2]


def tree_bytes(root) -> bytes:
    """The tree's table: the smaller half of a node comes first, so that the other's pair is not far; OverflowError if one is."""

    def inner(node) -> int:
        return 1 + inner(node[0]) + inner(node[1]) if isinstance(node, tuple) else 0

    slots: dict[int, int] = {}
    free = 1  # pairs in use; the first holds the table's size and the root

    def place(node, at: int):
        nonlocal free
        pair, free = free, free + 1
        distance = pair - at // 2 - 1
        if distance > 63:
            raise OverflowError
        halves = [(inner(child), side, child) for side, child in enumerate(node)]
        slots[at] = distance | (0x80 if halves[0][0] == 0 else 0) | (0x40 if halves[1][0] == 0 else 0)
        for size, side, child in sorted(halves, key=lambda h: h[:2]):
            if size:
                place(child, 2 * pair + side)
            else:
                slots[2 * pair + side] = child

    place(root, 1)
    size = free + free % 2  # whole words
    slots[0] = size - 1
    return bytes(slots.get(k, 0) for k in range(2 * size))


# --- LZ with negated flags -----------------------------------------------------------------


def lz40_decode(data: bytes) -> tuple[bytes, int]:
    """Types 0x40 and 0x60: flags are stored negated; a copy's low four bits are its length, or say that more bytes have it."""
    _, size, at = header(data, (0x40, 0x60))

    def unit(at: int):
        word = data[at] | data[at + 1] << 8
        pick, back = word & 15, word >> 4
        if pick > 1:
            return pick, back or CUT, at + 2
        if pick == 0:
            return data[at + 2] + 16, back or CUT, at + 3
        return (data[at + 2] | data[at + 3] << 8) + 272, back or CUT, at + 4

    return copies(data, at, size, unit, negated=True)


#: A distance that no output reaches.
CUT = 1 << 62


def lz40_encode(data: bytes, kind: int = 0x40) -> bytes:
    def piece(n: int, back: int) -> bytes:
        if n < 16:
            return struct.pack("<H", back << 4 | n)
        if n < 272:
            return struct.pack("<HB", back << 4, n - 16)
        return struct.pack("<HH", back << 4 | 1, n - 272)

    units = units_of(data, lambda n, d: 17 if n < 16 else 25 if n < 272 else 33, most=65807, far=4095, cuts=(*range(3, 16), 271))
    out = head(kind, len(data)) + flagged(((d > 0, piece(n, d) if d else data[i : i + 1]) for i, n, d in units), lambda x: -x)
    return out + bytes(-len(out) % 4)


# --- backward LZ of program code -----------------------------------------------------------


def backward_footer(data: bytes) -> tuple[int, int, int] | None:
    """Coded length, footer length, and by how much the file grows; None if the end is no such footer."""
    if len(data) < 8:
        return None
    coded, size, more = int.from_bytes(data[-8:-5], "little"), data[-5], int.from_bytes(data[-4:], "little")
    fits = more and 8 <= size <= 11 and size <= coded <= len(data) and not data[-size:-8].strip(b"\xff")
    return (coded, size, more) if fits else None


def backward_decode(data: bytes, kept: int = 0) -> tuple[bytes, int]:
    """Program code coded from its end: a plain start, then a stream that is read, and written, backwards. `kept` bytes after the footer stay."""
    body, tail = data[: len(data) - kept], data[len(data) - kept :]
    found = backward_footer(body)
    if found is None:
        raise CodecError("no footer")
    coded, size, more = found
    start = len(body) - coded
    stream = body[start : len(body) - size][::-1]

    def unit(at: int):
        word = stream[at] << 8 | stream[at + 1]
        return (word >> 12) + 3, (word & 0xFFF) + 3, at + 2

    return body[:start] + copies(stream, 0, coded + more, unit)[0][::-1] + tail, len(data)


def backward_encode(data: bytes, start: int = 0) -> bytes:
    """Codes data[start:]; CodecError where nothing is gained, as the footer can't say that."""
    turned = data[start:][::-1]
    units = units_of(turned, lambda n, d: 17, most=18, near=3, far=4098, cuts=range(3, 18))
    stream = flagged((d > 0, struct.pack(">H", n - 3 << 12 | d - 3) if d else turned[i : i + 1]) for i, n, d in units)[::-1]
    more = len(turned) - len(stream) - 8
    if more <= 0:
        raise CodecError("nothing to gain")
    return data[:start] + stream + (len(stream) + 8).to_bytes(3, "little") + b"\x08" + struct.pack("<I", more)


# --- streams with a magic ------------------------------------------------------------------


def le_decode(data: bytes) -> tuple[bytes, int]:
    """"Le": codes of two bits, four to a byte, lowest first: long copy, short copy, one literal, three literals."""
    if len(data) < 7 or data[:2] != b"Le" or data[5]:
        raise CodecError("no such header")
    size, at, out = int.from_bytes(data[2:5], "little"), 6, bytearray()
    try:
        while len(out) < size:
            codes, at = data[at], at + 1
            for k in range(0, 8, 2):
                if len(out) >= size:
                    break
                code = codes >> k & 3
                if code > 1:
                    n = 2 * code - 3
                    out += data[at : at + n]
                    if at + n > len(data):
                        raise IndexError
                elif code:
                    n = 1
                    copy(out, (data[at] & 3) + 1, min((data[at] >> 2) + 2, size - len(out)))
                else:
                    n, word = 2, data[at] | data[at + 1] << 8
                    copy(out, (word & 0xFFF) + 5, min((word >> 12) + 3, size - len(out)))
                at += n
    except IndexError:
        raise CodecError("cut stream") from None
    if len(out) != size:
        raise CodecError("longer than it says")
    return bytes(out), at


def le_encode(data: bytes) -> bytes:
    near = longest(data, least=2, most=65, far=4)
    far = longest(data, least=3, most=18, near=5, far=4100)
    # the better of a short copy (one byte for up to 65 bytes) and a long one (two for up to 18)
    found = [s if s[0] >= f[0] else f for s, f in zip(near, far, strict=True)]
    tokens, at = [], 0
    for n, d in cheapest(found, 10, lambda n, d: 10 if d < 5 else 18, range(2, 18), 2):
        if d == 0:
            tokens.append((2, data[at : at + 1]))
        elif d < 5:
            tokens.append((1, bytes([n - 2 << 2 | d - 1])))
        elif n < 3:
            tokens += [(2, data[k : k + 1]) for k in range(at, at + n)]
        else:
            tokens.append((0, struct.pack("<H", n - 3 << 12 | d - 5)))
        at += n
    joined: list = []
    for code, body in tokens:  # three literals in a row are one code
        joined.append((code, body))
        if len(joined) > 2 and all(c == 2 for c, _ in joined[-3:]):
            joined[-3:] = [(3, b"".join(b for _, b in joined[-3:]))]
    out = bytearray(b"Le" + len(data).to_bytes(3, "little") + b"\0")
    for k in range(0, len(joined), 4):
        four = joined[k : k + 4]
        out.append(sum(c << 2 * j for j, (c, _) in enumerate(four)))
        out += b"".join(b for _, b in four)
    return bytes(out)


class LowBits:
    """Bits from a byte string, lowest first."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at, self.end = data, 8 * at, 8 * len(data)

    def take(self, n: int) -> int:
        a, b = self.at >> 3, self.at + n + 7 >> 3
        value = int.from_bytes(self.data[a:b], "little") >> (self.at & 7) & (1 << n) - 1
        self.at += n
        if self.at > self.end:
            raise CodecError("cut stream")
        return value

    def zeros(self, most: int) -> int:
        """How many zeros come before the next one, which is taken too."""
        n = 0
        while not self.take(1):
            n += 1
            if n > most:
                raise CodecError("no such prefix")
        return n


class LowWriter:
    def __init__(self):
        self.value = self.size = 0
        self.out = bytearray()

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.size
        self.size += n
        whole = self.size // 8
        self.out += (self.value & (1 << 8 * whole) - 1).to_bytes(whole, "little")
        self.value >>= 8 * whole
        self.size -= 8 * whole

    def done(self) -> bytes:
        return bytes(self.out) + (bytes([self.value]) if self.size else b"")


#: Widths of a number's field, chosen by the zeros before it.
FIELD_WIDTHS = (2, 4, 6, 10)


def field_bits(value: int) -> int:
    return next(k + 1 + w for k, w in enumerate(FIELD_WIDTHS) if value < 1 << w)


def put_field(bits: LowWriter, value: int) -> None:
    k = next(k for k, w in enumerate(FIELD_WIDTHS) if value < 1 << w)
    bits.put(1 << k, k + 1)
    bits.put(value, FIELD_WIDTHS[k])


def bit_decode(data: bytes) -> tuple[bytes, int]:
    """Bit by bit: type (0 plain, 1 distances of ten bits, 2 of a chosen width), size, then literals (1) and copies (0)."""
    if len(data) < 5 or data[0] > 2:
        raise CodecError("no such header")
    kind, size = data[0], int.from_bytes(data[1:5], "little")
    if kind == 0:
        if len(data) < 5 + size:
            raise CodecError("cut stream")
        return data[5 : 5 + size], 5 + size
    bits, out = LowBits(data, 5), bytearray()
    while len(out) < size:
        if bits.take(1):
            out.append(bits.take(8))
            continue
        back = bits.take(10) if kind == 1 else bits.take(FIELD_WIDTHS[bits.zeros(3)])
        n = bits.take(FIELD_WIDTHS[bits.zeros(3)])
        if not n or len(out) + n > size:
            raise CodecError("a copy past the end")
        copy(out, back + 1, n)
    return bytes(out), bits.at + 7 >> 3


def bit_encode(data: bytes, kind: int = 2) -> bytes:
    if kind == 0:
        return b"\0" + struct.pack("<I", len(data)) + data
    bits = LowWriter()
    bits.put(kind, 8)
    bits.put(len(data), 32)
    price = lambda n, d: 1 + (10 if kind == 1 else field_bits(d - 1)) + field_bits(n)
    for i, n, d in units_of(data, price, least=2, most=1023, far=1024, cuts=(2, 3, 15, 63)):
        bits.put(0 if d else 1, 1)
        if not d:
            bits.put(data[i], 8)
            continue
        bits.put(d - 1, 10) if kind == 1 else put_field(bits, d - 1)
        put_field(bits, n)
    out = bits.done()
    return out + bytes(-len(out) % 4)


def member_decode(data: bytes) -> tuple[bytes, int]:
    """A member with its size twice, the first with the top bit set: copies of two bytes (a byte), or of up to eight (two)."""
    if len(data) < 8 or not data[3] & 0x80:
        raise CodecError("no such header")
    size = int.from_bytes(data[4:8], "little")
    if not size or int.from_bytes(data[:4], "little") & 0x7FFFFFFF != size:
        raise CodecError("no such header")

    def unit(at: int):
        t = data[at]
        return (2, t + 1, at + 1) if t < 0x80 else ((t >> 4 & 7) + 1, ((t & 15) << 8 | data[at + 1]) + 1, at + 2)

    return copies(data, 8, size, unit)


def member_encode(data: bytes) -> bytes:
    def piece(n: int, d: int) -> bytes:
        return bytes([d - 1]) if short(n, d) else bytes([0x80 | n - 1 << 4 | d - 1 >> 8, d - 1 & 0xFF])

    short = lambda n, d: n == 2 and d <= 128
    units = units_of(data, lambda n, d: 9 if short(n, d) else 17, least=2, most=8, far=4096, cuts=range(2, 8))
    body = flagged((d > 0, piece(n, d) if d else data[i : i + 1]) for i, n, d in units)
    return struct.pack("<II", 0x80000000 | len(data), len(data)) + body


def delta_decode(data: bytes) -> tuple[bytes, int]:
    """"AT6P": each byte by its difference from the one before, as numbers behind as many zeros as they have bits."""
    if len(data) < 0x16 or data[:4] != b"AT6P":
        raise CodecError("no such header")
    size = int.from_bytes(data[0x10:0x13], "little")
    if not size:
        return b"", 0x14
    now, before = data[0x14], None
    out, bits = bytearray([now]), LowBits(data + bytes(2), 0x16)
    while len(out) < size:
        k = bits.zeros(8)
        n = (1 << k) - 1 + (bits.take(k) if k else 0)
        if n == 1:
            if before is None:
                raise CodecError("nothing before")
            before, now = now, before
        elif n:
            before, now = now, (now + (-(n >> 1) if n & 1 else n >> 1)) & 0xFF
        out.append(now)
    return bytes(out), len(data)


def delta_encode(data: bytes, tag: int = 0) -> bytes:
    bits, before = LowWriter(), None
    if data:
        bits.put(data[0], 16)
    for last, byte in zip(data, data[1:], strict=False):
        up, down = byte - last & 0xFF, last - byte & 0xFF
        n = 0 if byte == last else 1 if byte == before else 2 * up if up <= down else 2 * down + 1
        k = (n + 1).bit_length() - 1
        bits.put(1 << k, k + 1)
        bits.put(n + 1 - (1 << k), k)
        if byte != last:
            before = last
    body = bits.done()
    return b"AT6P" + struct.pack("<I", (0x14 + len(body) << 8 | tag) & 0xFFFFFFFF) + bytes(8) + struct.pack("<I", len(data)) + body


#: Bytes that stand plain, and the widths of a copy length's fields (a full one is followed by the next).
PLAIN_START, LENGTH_FIELDS = 0x100, (2, 3, 5, 8)


def layla_sizes(data: bytes) -> tuple[int, int] | None:
    """Size without the plain start, and of the stream; the magic may be blank."""
    if len(data) < 16 + PLAIN_START or data[:8] not in (b"CRILAYLA", bytes(8)):
        return None
    size, coded = struct.unpack_from("<II", data, 8)
    return (size, coded) if size and 16 + coded + PLAIN_START == len(data) else None


def layla_decode(data: bytes) -> tuple[bytes, int]:
    """The stream is read from its last byte, highest bit first, and makes the output from its end."""
    sizes = layla_sizes(data)
    if sizes is None:
        raise CodecError("no such header")
    size, coded = sizes
    # the same stream as lowest-first bits of the bytes as they lie backwards, each turned round
    turned = bytes(TURNED[b] for b in reversed(data[16 : 16 + coded]))
    bits, out = LowBits(turned), bytearray()
    number = lambda n: int(f"{bits.take(n):0{n}b}"[::-1], 2)
    while len(out) < size:
        if not bits.take(1):
            out.append(number(8))
            continue
        back, n = number(13) + 3, 3
        for width in (*LENGTH_FIELDS, *[8] * size):
            more = number(width)
            n += more
            if more != (1 << width) - 1:
                break
        if len(out) + n > size:
            raise CodecError("a copy past the end")
        copy(out, back, n)
    return data[16 + coded :] + bytes(out[::-1]), len(data)


TURNED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def length_fields(n: int) -> list[tuple[int, int]]:
    """(value, width) of a copy length's fields."""
    rest, out = n - 3, []
    for width in LENGTH_FIELDS:
        part = min(rest, (1 << width) - 1)
        out.append((part, width))
        rest -= part
        if part < (1 << width) - 1:
            return out
    while True:
        part = min(rest, 255)
        out.append((part, 8))
        rest -= part
        if part < 255:
            return out


def layla_encode(data: bytes, magic: bytes = b"CRILAYLA") -> bytes:
    if len(data) <= PLAIN_START:
        raise CodecError("too short")
    turned = data[PLAIN_START:][::-1]
    price = lambda n, d: 14 + sum(w for _, w in length_fields(n))
    bits = []
    for i, n, d in units_of(turned, price, most=4096, near=3, far=8194, cuts=(5, 12, 43, 298)):
        if d:
            bits += ["1", f"{d - 3:013b}", *(f"{v:0{w}b}" for v, w in length_fields(n))]
        else:
            bits += ["0", f"{turned[i]:08b}"]
    stream = "".join(bits)
    stream += "0" * (-len(stream) % 8)
    coded = int(stream, 2).to_bytes(len(stream) // 8, "big")[::-1]
    return magic + struct.pack("<II", len(turned), len(coded)) + coded + data[:PLAIN_START]


# --- console streams behind a prefix --------------------------------------------------------

#: Prefixes of an LZ stream of type 0x10, and the codec that an envelope's first word names.
PREFIXES = {"lz10_hdr": b"LZ77", "lz10_solcomp": b"SOLCOMP\0"}
ENVELOPES = {1: "rle", 2: "lz10", 3: "huff4", 4: "huff8"}


def prefixed_decode(data: bytes, name: str) -> tuple[bytes, int]:
    if not data.startswith(PREFIXES[name]):
        raise CodecError("no such prefix")
    out, used = bios.lz_decode(data[len(PREFIXES[name]) :])
    return out, used + len(PREFIXES[name])


def envelope_decode(data: bytes) -> tuple[bytes, int]:
    """A console stream behind a word that names its codec; after an LZ stream only padding may follow."""
    name = ENVELOPES.get(int.from_bytes(data[:4], "little")) if len(data) >= 8 else None
    if name is None or data[4] != bios.READERS[name][0]:
        raise CodecError("no such envelope")
    out, used = bios.READERS[name][1](data[4:])
    if name == "lz10" and (len(data) - 4 - used > 3 or any(data[4 + used :])):
        raise CodecError("more than the stream")
    return out, 4 + used


def envelope_encode(data: bytes, kind: int) -> bytes:
    return struct.pack("<I", kind) + CODECS[ENVELOPES[kind]][1](data)


#: name -> (decode, encode)
CODECS = {
    "lz10": (bios.lz_decode, lz_encode_best),
    "lz11": (bios.lz_decode, lambda d: lz_encode_best(d, 0x11)),
    "rle": (bios.rle_decode, bios.rle_encode),
    "diff8": (bios.diff_decode, bios.diff_encode),
    "diff16": (bios.diff_decode, lambda d: bios.diff_encode(d, 0x82)),
    "huff4": (bios.huff_decode, lambda d: huff_encode(d, 4)),
    "huff8": (bios.huff_decode, huff_encode),
    "lz40": (lz40_decode, lz40_encode),
    "lz60": (lz40_decode, lambda d: lz40_encode(d, 0x60)),
    "blz": (backward_decode, backward_encode),
    "lze": (le_decode, le_encode),
    "bitlz": (bit_decode, bit_encode),
    "aklz": (member_decode, member_encode),
    "at6p": (delta_decode, delta_encode),
    "crilayla": (layla_decode, layla_encode),
    **{name: ((lambda d, n=name: prefixed_decode(d, n)), (lambda d, p=p: p + lz_encode_best(d))) for name, p in PREFIXES.items()},
    **{f"envelope{k}": (envelope_decode, (lambda d, k=k: envelope_encode(d, k))) for k in ENVELOPES},
}
