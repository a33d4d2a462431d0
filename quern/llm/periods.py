"""Runs of words that repeat with a period, by the algorithm of Kolpakov and Kucherov.

Every text is searched on its own, inside the scan. Its words are cut into Lempel-Ziv
factors (the longest stretch that also starts earlier, or one new word), read off a suffix
automaton. A run that touches a factor's start is found by Main's comparison of the words on
both sides of it, in linear time; a run strictly inside a factor stands at the factor's
earlier occurrence too, and is copied from there.

Only runs of four periods or more count. Each five words in a row of such a run stand twice in
the text, so stretches without a repeated five are passed over first; no run can lie in them.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import text_bytes, tuned

#: A run has this many periods and words at least; GRAM words of it in a row always stand twice.
EXPONENT, LEAST, GRAM = 4, 6, 5
_RESULT = "id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def automaton(w: list[int]) -> tuple[list[dict], list[int]]:
    """Suffix automaton: the transitions of each state, and where its strings first end."""
    to, link, size, first = [{}], [-1], [0], [-1]
    last = 0
    for at, c in enumerate(w):
        new = len(to)
        to.append({})
        size.append(size[last] + 1)
        first.append(at)
        link.append(0)
        p = last
        while p >= 0 and c not in to[p]:
            to[p][c] = new
            p = link[p]
        if p >= 0:
            q = to[p][c]
            if size[q] == size[p] + 1:
                link[new] = q
            else:
                twin = len(to)
                to.append(dict(to[q]))
                size.append(size[p] + 1)
                first.append(first[q])
                link.append(link[q])
                link[q] = link[new] = twin
                while p >= 0 and to[p].get(c) == q:
                    to[p][c] = twin
                    p = link[p]
        last = new
    return to, first


def factors(w: list[int]) -> list[tuple[int, int, int]]:
    """(from, to, where it starts before) of the Lempel-Ziv factors; -1 for a new word. An earlier occurrence may overlap the factor."""
    to, first = automaton(w)
    out, at, n = [], 0, len(w)
    while at < n:
        state, k = 0, 0
        while at + k < n:
            ahead = to[state].get(w[at + k], -1)
            if ahead < 0 or first[ahead] - k >= at:
                break
            state, k = ahead, k + 1
        out.append((at, at + k, first[state] - k + 1) if k else (at, at + 1, -1))
        at = out[-1][1]
    return out


def prefixes(s: list[int]) -> list[int]:
    """For each place, how many symbols from there on equal the beginning (the Z function)."""
    n = len(s)
    z = [0] * n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def crossing(w: list[int], before: int, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """Main's step: (first word, last word, period) of runs that touch the boundary ``at`` and end before ``end``.

    [before, at) and [at, end) are neighbouring factors. A run that goes on past ``at``
    cannot start a period or more before ``before``, or the factor there would have been
    longer; with four periods in it, its period is under a third of both factors.
    """
    most = (end - before) // (EXPONENT - 1)
    low = max(0, before - most)
    x, y = w[low:at], w[at:end]
    nx, ny = len(x), len(y)
    back = x[::-1]
    # Equal words from (at, at + p) on, and back from (at - 1, at + p - 1): the run holds the period after the boundary.
    ahead = prefixes([*y, -1, *x, *y])
    behind = prefixes([*back, -1, *y[::-1], *back])
    for p in range(1, min(most, ny) + 1):
        right = ahead[p] if p < ny else 0
        left = behind[nx + 1 + ny - p]
        if left + right + p >= max(LEAST, EXPONENT * p):
            yield from maximal(w, at - left, at + p + right - 1, p, low, end)
    # The same from (at - p, at) on and back from (at - p - 1, at - 1): it holds the period before it.
    for p in range(1, min(most, nx) + 1):
        right = ahead[ny + 1 + nx - p]
        left = behind[p] if p < nx else 0
        if left + right + p >= max(LEAST, EXPONENT * p):
            yield from maximal(w, at - p - left, min(at + right, end) - 1, p, low, end)


def maximal(w: list[int], start: int, last: int, p: int, low: int, end: int) -> Iterator[tuple[int, int, int]]:
    """The run, unless the words compared ended before it does; another boundary finds it whole then."""
    cut = (start == low and start > 0 and w[start - 1] == w[start - 1 + p]) or (last == end - 1 and end < len(w) and w[end] == w[end - p])
    if not cut:
        yield start, last, p


def runs_of(w: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of the maximal runs of EXPONENT periods and LEAST words, by start, then period."""
    found: dict[tuple[int, int], int] = {}  # of the periods that a stretch has, the smallest
    starts: dict[int, set[int]] = {}

    def add(start: int, last: int, p: int) -> None:
        found[start, last] = min(p, found.get((start, last), p))
        starts.setdefault(start, set()).add(last)

    before = 0
    for at, end, source in [*factors(w), (len(w), len(w), -1)]:
        if at:
            for run in crossing(w, before, at, end):
                add(*run)
        if source >= 0 and starts:
            shift, stop = at - source, source + end - at - 1
            for start in range(source + 1, stop):  # in order: a copy may be copied again where factor and source overlap
                for last in starts.get(start, ()):
                    if last < stop:
                        add(start + shift, last + shift, found[start, last])
        before = at
    return sorted((start, last - start + 1, p) for (start, last), p in found.items())


def candidates(ids: np.ndarray) -> list[tuple[int, int]]:
    """Stretches (from, to) of words in which every GRAM words in a row stand twice in the text. Each run lies in one of them, with no word beside it that could belong to it."""
    n = len(ids) - GRAM + 1
    if n < LEAST - GRAM + 1:
        return []
    gram = np.zeros(n, np.uint64)
    for k in range(GRAM):  # equal grams have equal names; another gram of the same name only leaves more to be searched
        gram = (gram ^ ids[k : k + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        gram ^= gram >> np.uint64(29)
    order = np.argsort(gram, kind="stable")
    same = gram[order[1:]] == gram[order[:-1]]
    twice = np.zeros(n + 2, np.int8)
    twice[order[1:][same] + 1] = 1
    twice[order[:-1][same] + 1] = 1
    edge = np.diff(twice)
    return [(a, b + GRAM - 1) for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True) if b - a > LEAST - GRAM]


def search(words: list[bytes]) -> list[tuple[int, int, int]]:
    """runs_of, for the words of a text."""
    index: dict[bytes, int] = {}
    ids = [index.setdefault(x, len(index)) for x in words]
    return [(start + a, length, p) for a, b in candidates(np.array(ids, np.int64)) for start, length, p in runs_of(ids[a:b])]


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words with a periodic end for one id in ten, as op13's contract asks. A null id changes nothing."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    period = words[a : a + 1 + (n - a) // (3 + g % 8)]
    whole, rest = divmod(n - a, len(period))
    return words[:a] + period * whole + period[:rest]


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that stand in a run after its first period."""
    drop = np.zeros(len(words) + 1, np.int32)
    for start, length, p in found:
        drop[start + p] += 1
        drop[start + length] -= 1
    gone = np.cumsum(drop[:-1]) > 0
    return [x for x, g in zip(words, gone.tolist(), strict=True) if not g] if found else words


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plant: bool = False) -> DataFrame:
    """One row for each row of docs: (id_col, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256).

    Words are cut at ASCII white space and compared as they stand. A run is a stretch of
    LEAST words and EXPONENT of its smallest period, or more, that no neighbouring word
    extends. start, length, period and exponent_milli are those of the longest one, the
    first of several, and null without one. runs_sha256 is the hash of all runs, one
    ``start,length,period`` a line; collapsed_sha256 that of the words left when each run
    keeps one period. Null and empty texts have no words; null ids stay null; repeated rows
    give repeated rows; other columns are not read. ``plant`` first makes the end of some
    texts periodic (``planted``). A text is searched in one task, in memory of some 700
    bytes for each word that stands in a candidate stretch.
    """
    tuned(docs.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = text_bytes(b.column(1))
            raw, rows = data.tobytes(), []
            for k, doc_id in enumerate(b.column(0).to_pylist()):
                words = raw[offsets[k] : offsets[k + 1]].split()
                if plant:
                    words = planted(words, doc_id)
                found = search(words)
                best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
                top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
                listed = "".join(f"{s},{n},{p}\n" for s, n, p in found).encode()
                rows.append((doc_id, len(found), *top, hashlib.sha256(listed).hexdigest(), hashlib.sha256(b" ".join(collapsed(words, found))).hexdigest()))
            kinds = [pa.int64()] * 6 + [pa.string()] * 2
            names = [x.split()[0] for x in _RESULT.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    ids = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return ids.mapInArrow(scan, _RESULT).withColumnRenamed("id", id_col)
