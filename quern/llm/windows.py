"""Numpy helpers for the inside of a task: names of substrings, words of a byte buffer, winnowed anchors.

A name is a 64-bit polynomial hash of a run of symbols, mixed; equal runs have equal names,
and the names of all runs of one length come from one cumulative sum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_B = 0x9E3779B97F4A7C15 | 1
_B_INV = pow(_B, -1, 1 << 64)
#: Pieces hold fewer symbols than this, so that a position fits beside a hash in one word.
PIECE = 1 << 20
_LOW = np.uint64(PIECE - 1)
_SYMBOLS = np.random.default_rng(20240601).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        grown = np.full(max(n, PIECE + 1), base, np.uint64)
        grown[0] = 1
        _powers[base] = have = np.multiply.accumulate(grown)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xA24BAED4963EE407)
    return x ^ (x >> np.uint64(32))


class Names:
    """Names of the runs of a symbol sequence."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(symbols * _power(_B, n), out=self.sums[1:])
        self.back = _power(_B_INV, n + 1)

    def at(self, start: np.ndarray, length: int | np.ndarray) -> np.ndarray:
        return mix((self.sums[start + length] - self.sums[start]) * self.back[start])

    def all(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return mix((self.sums[length:] - self.sums[:n]) * self.back[:n])


def symbols_of_bytes(data: np.ndarray) -> np.ndarray:
    return _SYMBOLS[data]


def is_space(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def lowered(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words cut at ASCII white space and at text ends: (start, end, symbol) of each, and its count before each text, n + 1.

    Works through the buffer in pieces cut between words, so memory beside the result is bounded by the longest word.
    """
    starts, ends, names = [], [], []
    n, at = len(data), 0
    first = np.zeros(n + 1, bool)
    first[offsets[:-1][offsets[:-1] < n]] = True
    while at < n:
        stop = min(at + PIECE, n)
        while stop < n and not first[stop]:  # on to white space or to the next text
            ahead = data[stop : stop + 4096]
            cut = np.flatnonzero(is_space(ahead) | first[stop : stop + len(ahead)])
            stop += int(cut[0]) if len(cut) else len(ahead)
            if len(cut):
                break
        piece = data[at:stop]
        black = ~is_space(piece)
        begin = black.copy()
        begin[1:] &= ~black[:-1] | first[at + 1 : stop]
        finish = black.copy()
        finish[:-1] &= ~black[1:] | first[at + 1 : stop]
        s, e = np.flatnonzero(begin), np.flatnonzero(finish) + 1
        starts.append(s + at)
        ends.append(e + at)
        names.append(Names(symbols_of_bytes(piece)).at(s, e - s))
        at = stop
    start, end, name = (np.concatenate(x) if x else np.zeros(0, k) for x, k in ((starts, np.int64), (ends, np.int64), (names, np.uint64)))
    return start, end, name, np.searchsorted(start, offsets)


def pieces(offsets: np.ndarray, overlap: int) -> Iterator[list[tuple[int, int, int]]]:
    """Lists of (text, from, to), together under PIECE symbols. A longer text is cut, with that overlap."""
    out: list[tuple[int, int, int]] = []
    held = 0
    for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        while True:
            c = min(b, a + PIECE - 1)
            if held + c - a >= PIECE:
                yield out
                out, held = [], 0
            out.append((k, a, c))
            held += c - a
            if c == b:
                break
            a = c - overlap
    if out:
        yield out


def least_in_window(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of keys[i : i + width] for every i that has so many."""
    n = len(keys)
    if n < width:
        return keys[:0]
    rows = -(-n // width)
    padded = np.full(rows * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:n] = keys
    block = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    behind = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def governed(symbols: np.ndarray, sizes: np.ndarray, length: int, gram: int) -> tuple[Names, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows of ``length`` symbols grouped by the anchor that governs them.

    symbols: texts of these sizes, end to end, under PIECE in all. The anchor of a window is
    the leftmost gram of least hash inside it, so equal windows have equal anchors at equal
    places, wherever they stand. Returns names, and for each run of neighbouring window
    starts with one anchor: its first start, its last, the anchor's place, and the text.
    """
    names = Names(symbols)
    none = np.zeros(0, np.int64)
    if len(symbols) < length:
        return names, none, none, none, none
    width = length - gram + 1
    grams = names.all(gram)
    least = least_in_window((grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64), width)
    text = np.repeat(np.arange(len(sizes)), sizes)
    end = np.repeat(np.cumsum(sizes), sizes)
    starts = np.flatnonzero(np.arange(length, len(least) + length) <= end[: len(least)])
    if not len(starts):
        return names, none, none, none, none
    anchor = (least[starts] & _LOW).astype(np.int64)
    new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    return names, starts[first], starts[last], anchor[first], text[starts[first]]
