"""Matches and cheapest parses, shared by the codecs that copy from what came before."""

from __future__ import annotations

from collections.abc import Callable, Iterable

#: Earlier places with the same first bytes that are tried, nearest first.
TRIES = 48


def shared(data: bytes, a: int, b: int, most: int) -> int:
    """How many bytes from a and from b agree, up to `most`: whole slices first, halved where they differ."""
    k = 0
    step = 8
    while k < most:
        n = min(step, most - k)
        if data[a + k : a + k + n] == data[b + k : b + k + n]:
            k, step = k + n, 2 * step
        elif n == 1:
            break
        else:
            step = n // 2
    return k


def longest(data: bytes, *, least: int, most: int, near: int = 1, far: int) -> list[tuple[int, int]]:
    """(length, distance) of the longest match at each place, (0, 0) where none has `least` bytes."""
    found, heads = [(0, 0)] * len(data), {}
    for i in range(len(data) - least + 1):
        places = heads.setdefault(data[i : i + least], [])
        best = (0, 0)
        for j in reversed(places[-TRIES:]):
            if i - j > far:
                break
            if i - j >= near:
                n = shared(data, j, i, min(most, len(data) - i))
                if n > best[0]:
                    best = (n, i - j)
                    if i + n == len(data) or n == most:
                        break
        found[i] = best
        places.append(i)
    return found


def cheapest(found: list[tuple[int, int]], literal: int, price: Callable[[int, int], int], cuts: Iterable[int] = (), least: int = 3) -> list[tuple[int, int]]:
    """The units (length, distance), or (1, 0) for a literal, whose bits are fewest, by prices from the end on.

    A match may be cut to any of `cuts`, the lengths at which the next price begins.
    """
    n = len(found)
    bits, step = [0] * (n + 1), [(1, 0)] * n
    cuts = sorted(cuts)
    for i in range(n - 1, -1, -1):
        best = literal + bits[i + 1]
        length, distance = found[i]
        if length >= least:
            for m in [*(c for c in cuts if least <= c < length), length]:
                cost = price(m, distance) + bits[i + m]
                if cost < best:
                    best, step[i] = cost, (m, distance)
        bits[i] = best
    units, i = [], 0
    while i < n:
        units.append(step[i])
        i += step[i][0]
    return units


def flagged(units: Iterable[tuple[bool, bytes]], flag: Callable[[int], int] = lambda x: x) -> bytes:
    """Groups of eight units, each behind a byte of their flags, the first unit's highest."""
    out, group = bytearray(), []

    def close():
        out.append(flag(sum(bit << 7 - k for k, (bit, _) in enumerate(group))) & 0xFF)
        out.extend(b"".join(b for _, b in group))
        group.clear()

    for unit in units:
        group.append(unit)
        if len(group) == 8:
            close()
    if group:
        close()
    return bytes(out)
