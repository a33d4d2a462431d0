"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import xxhash

SPACE = re.compile(rb"[^\x20\x09-\x0D]+")


def lowered(b: bytes) -> bytes:
    return bytes(c + 32 if 65 <= c <= 90 else c for c in b)


def components(ids: list, links: list[tuple]) -> dict:
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def fingerprint(text: str | None, width: int = 4) -> int:
    words = [w.decode() for w in SPACE.findall(lowered((text or "").encode()))]
    if not words:
        return 0
    shingles = [" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def simhash(docs: list[tuple[int, str | None]], budget: int = 4) -> dict[int, tuple[str, int]]:
    fp = {i: fingerprint(t) for i, t in docs}
    ids = sorted(fp)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if bin(fp[a] ^ fp[b]).count("1") <= budget]
    comp = components(ids, links)
    return {i: (f"{fp[i]:016x}", comp[i]) for i in ids}


def covered(sequences: list[list], length: int) -> list[np.ndarray]:
    """For each sequence, which symbols lie in a window that starts at two places."""
    starts = Counter(tuple(s[k : k + length]) if not isinstance(s, bytes) else s[k : k + length] for s in sequences for k in range(len(s) - length + 1))
    out = []
    for s in sequences:
        hit = np.zeros(len(s), bool)
        for k in range(len(s) - length + 1):
            if starts[tuple(s[k : k + length]) if not isinstance(s, bytes) else s[k : k + length]] > 1:
                hit[k : k + length] = True
        out.append(hit)
    return out


def runs(hit: np.ndarray) -> int:
    return int(hit[:1].sum() + (hit[1:] & ~hit[:-1]).sum())


def suffixes(docs: list[tuple[int, str | None]], length: int, report: int = 256) -> list[tuple]:
    raw = [(t or "").encode() for _, t in docs]
    rows = zip(docs, raw, covered(raw, length), covered(raw, min(report, length)), strict=True)
    return [(i, len(r), int(h.sum()), runs(h), hashlib.sha256(bytes(c for c, x in zip(r, h) if not x)).hexdigest(), int(n.sum())) for (i, _), r, h, n in rows]


def passages(docs: list[tuple[int, str | None]], length: int) -> list[tuple]:
    raw = [SPACE.findall((t or "").encode()) for _, t in docs]
    return [(i, len(r), int(h.sum()), hashlib.sha256(b" ".join(w for w, x in zip(r, h) if not x)).hexdigest()) for (i, _), r, h in zip(docs, raw, covered(raw, length))]


def vectors(rows: list[tuple[int, list | None]], least: float) -> dict[int, tuple[int, int]]:
    good = {i: np.array(v, float) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    ids = sorted(good)
    cos = lambda a, b: good[a] @ good[b] / np.linalg.norm(good[a]) / np.linalg.norm(good[b])
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if cos(a, b) >= least]
    comp = components([i for i, _ in rows], links)
    n = Counter(x for p in links for x in p)
    return {i: (n[i], comp[i]) for i, _ in rows}


def edit(a: list, b: list) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def leaks(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]], similarity: float = 0.8) -> dict[tuple[int, int], int]:
    """Least distance of each item to any stretch of each text, where it is near enough."""
    split = lambda t: re.findall(r"[a-z0-9\u0080-\U0010ffff]+", (t or "").lower())
    out = {}
    for d, t in docs:
        w = split(t)
        for k, x in items:
            item = split(x)
            if not item:
                continue
            row = [0] * (len(w) + 1)
            for i, a in enumerate(item, 1):
                last, row[0] = row[0], i
                for j, b in enumerate(w, 1):
                    last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a != b))
            if min(row) <= int((1 - similarity) * len(item) + 1e-9):
                out[d, k] = min(row)
    return out


def licences(text: str | None) -> tuple:
    words = [w.decode() for w in re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered((text or "").encode()))]
    starts, labels = [], set()
    for phrase, label in (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")):
        p = phrase.split()
        for k in range(len(words) - len(p) + 1):
            if words[k : k + len(p)] == p:
                starts.append(k)
                labels.add(label)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def padding(lengths: list[int], ends: list[int]) -> int:
    return sum(min(e for e in ends if e >= n) - n for n in lengths)
