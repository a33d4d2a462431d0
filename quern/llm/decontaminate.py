"""Benchmark decontamination by CGK embeddings and bit sampling, with exact edit verification.

A text is contaminated by a benchmark item if some stretch of it is within ``similarity`` of
the item: the word edit distance is at most (1 - similarity) of the item's words.

Windows. An item of n words with k edits keeps one of any k + 1 disjoint pieces whole, so a
window can only match where a piece of the item stands; every such place gives a window of
the item's size, aligned by the piece. No window that could match is passed over.

Hashing. The CGK walk embeds a window: it copies words, and a random bit of each word and
step says whether to go on to the next one, so strings at a small edit distance come to agree
at most places again after each edit. Windows whose embedding agrees with the item's on all
of a few sampled places, in any of many samples, are candidates. The walks grow with the
edits that are allowed, so that RECALL of the items at their full number of random edits come
out; ``measured`` puts such items through the very same steps.

Verification. The exact edit distance of the item to the best stretch around the window.

Items are few and go to every task; if they aren't, they are dealt to runs of bounded size.
Texts are scanned where they lie, and kept or dropped there: nothing is shuffled.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import windows
from quern.llm.common import text_bytes, tuned

#: Words of benchmark text that one run of the scan takes along: some 50 MB in a task.
RUN_WORDS = 1_000_000
#: Samples of a walk, places of a sample, and the share of fully edited items to find.
SAMPLES, PLACES, RECALL = 16, 3, 0.99


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Names of the lower-cased words (letters, digits, non-ASCII) of texts, and their count before each text."""
    data, offsets = text_bytes(pc.utf8_lower(column.cast(pa.large_string()).fill_null("")))
    wordly = (data >= 128) | ((data >= 97) & (data <= 122)) | ((data >= 48) & (data <= 57))
    _, _, name, count = windows.words(np.where(wordly, data, np.uint8(32)), offsets)
    return name, count


def errors(n: int, similarity: float) -> int:
    return int(np.floor((1 - similarity) * n + 1e-9))


def embed(rows: np.ndarray, size: np.ndarray, walk: int) -> np.ndarray:
    """CGK embeddings of rows of symbols (padded), in 3 steps for each symbol of the widest row."""
    m, width = rows.shape
    at, out = np.zeros(m, np.int64), np.zeros((m, 3 * width), np.uint64)
    every = np.arange(m)
    for j in range(3 * width):
        inside = at < size
        symbol = np.where(inside, rows[every, np.minimum(at, width - 1)], np.uint64(0))
        out[:, j] = symbol
        at += inside & (windows.mix(symbol + np.uint64(0x9E3779B97F4A7C15 * (j * 64 + walk + 1) % 2**64)) & np.uint64(1)).astype(bool)
    return out


def sampled(size: int, walk: int) -> np.ndarray:
    """SAMPLES x PLACES places of an embedding, the same for all strings of that size."""
    return np.random.default_rng([size, walk]).integers(0, max(1, 2 * size), (SAMPLES, PLACES))


def stretch(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """(distance, end) of the stretch of text of least edit distance to item, the first of its kind."""
    column = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64)
    for k, word in enumerate(item):
        change = np.minimum(row[1:] + 1, row[:-1] + (text != word))
        row = np.concatenate(([k + 1], change)) - column
        row = np.minimum.accumulate(row) + column
    return int(row.min()), int(row.argmin())


@dataclass
class Items:
    """Benchmark items, and what their windows are found by. walks: of each item, how many its windows go through."""

    ids: list
    words: list[np.ndarray]
    similarity: float
    walks: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)
    marks: dict[int, list[np.ndarray]] = field(default_factory=dict)

    def prepare(self, walks: int = 0) -> Items:
        """walks: so many for every item; 0 for as many as RECALL takes."""
        self.walks = np.array([walks or walks_for(errors(len(w), self.similarity)) for w in self.words], np.int64)
        by_size: dict[int, list[tuple[int, int, int]]] = {}
        for k, w in enumerate(self.words):
            e = errors(len(w), self.similarity)
            q = len(w) // (e + 1)
            names = windows.Names(w)
            for p in range(e + 1):
                by_size.setdefault(q, []).append((int(names.at(np.array([p * q]), q)[0]), k, p * q))
        for n in {len(w) for w in self.words}:
            same = [k for k, w in enumerate(self.words) if len(w) == n]
            every = np.stack([self.words[k] for k in same])
            by_walk = [embed(every, np.full(len(same), n), walk)[:, sampled(n, walk)] for walk in range(int(self.walks[same].max()))]
            for row, k in enumerate(same):
                self.marks[k] = [x[row] for x in by_walk[: self.walks[k]]]
        for q, rows in by_size.items():
            rows.sort()
            self.seeds[q] = tuple(np.array([r[c] for r in rows], t) for c, t in ((0, np.uint64), (1, np.int64), (2, np.int64)))
        return self

    def windows_at(self, names: windows.Names, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(item, window start) for every place of a piece among n words."""
        for q, (seed, item, offset) in self.seeds.items():
            if n < q:
                continue
            grams = names.all(q)
            table = np.zeros(1 << 20, bool)
            table[(seed >> np.uint64(44)).astype(np.int64)] = True
            hit = np.flatnonzero(table[(grams >> np.uint64(44)).astype(np.int64)])
            lo, hi = np.searchsorted(seed, grams[hit], "left"), np.searchsorted(seed, grams[hit], "right")
            times = hi - lo
            place = np.repeat(hit, times)
            s = np.repeat(lo, times) + np.arange(len(place)) - np.repeat(np.cumsum(times) - times, times)
            yield item[s], place - offset[s]

    def hits(self, words: np.ndarray, item: np.ndarray, start: np.ndarray) -> np.ndarray:
        """For each window, of its item's size, the first walk in which it shares a sample of the embedding with the item; -1 for none."""
        out = np.full(len(item), -1)
        sizes = np.array([len(w) for w in self.words])[item]
        for n in np.unique(sizes):
            for part in np.array_split(np.flatnonzero(sizes == n), -(-int((sizes == n).sum()) // 4096)):
                at = start[part][:, None] + np.arange(n)
                rows = np.where((at >= 0) & (at < len(words)), words[np.clip(at, 0, len(words) - 1)], np.uint64(0))
                for walk in range(int(self.walks[item[part]].max())):
                    open_ = np.flatnonzero((out[part] < 0) & (self.walks[item[part]] > walk))
                    if not len(open_):
                        break
                    got = embed(rows[open_], np.full(len(open_), n), walk)[:, sampled(int(n), walk)]
                    want = np.stack([self.marks[k][walk] for k in item[part][open_]])
                    hit = (got == want).all(2).any(1)
                    out[part[open_[hit]]] = walk
        return out

    def places(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, window start), each once."""
        found = list(self.windows_at(windows.Names(words), len(words)))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        item, start = (np.concatenate(x) for x in zip(*found, strict=True))
        return tuple(np.unique(np.stack([item, start]), axis=1))

    def matches(self, words: np.ndarray, cuts: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, item, first word, words, distance) for each item in each text, at its nearest stretch, the first of equals."""
        item, start = self.places(words)
        if not len(item):
            return
        keep = self.hits(words, item, start) >= 0
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for k, s in zip(item[keep].tolist(), start[keep].tolist(), strict=True):
            own, e = self.words[k], errors(len(self.words[k]), self.similarity)
            first = np.searchsorted(cuts, s, "right") - 1
            last = np.searchsorted(cuts, s + len(own) - 1, "right") - 1
            for text in range(max(0, first), min(last, len(cuts) - 2) + 1):  # a window may reach over a text's end
                lo, hi = max(cuts[text], s - e), min(cuts[text + 1], s + len(own) + e)
                if hi - lo < len(own) - e:
                    continue
                distance, end = stretch(own, words[lo:hi])
                if distance > e:
                    continue
                back, size = stretch(own[::-1], words[lo : lo + end][::-1])
                got = (distance, int(lo + end - size - cuts[text]), size)
                if (text, k) not in best or got < best[text, k]:
                    best[text, k] = got
        for (text, k), (distance, at, size) in sorted(best.items()):
            yield text, k, at, size, distance


def edited(word: np.ndarray, edits: int, r: np.random.Generator) -> np.ndarray:
    """With so many random replacements, insertions and deletions."""
    out = word.tolist()
    for _ in range(edits):
        kind, at = r.integers(3), int(r.integers(len(out)))
        new = int(r.integers(1, 1 << 63))
        out[at : at + (kind != 1)] = [new] if kind < 2 else []
        if not out:
            out = [new]
    return np.array(out, np.uint64)


def measured(n: int, similarity: float, trials: int, most: int) -> np.ndarray:
    """Share of items of n words, at their full number of edits, that come out by walk 1, 2, ...: the recall of the whole candidate search."""
    r = np.random.default_rng([n, trials])
    words = r.integers(1, 1 << 63, (trials, n), np.uint64)
    items = Items(list(range(trials)), list(words), similarity).prepare(most)
    parts, cuts = [], [0]
    for w in words:
        parts += [r.integers(1, 1 << 63, n, np.uint64), edited(w, errors(n, similarity), r)]
        cuts.append(cuts[-1] + n + len(parts[-1]))
    text = np.concatenate([*parts, r.integers(1, 1 << 63, n, np.uint64)])
    item, start = items.places(text)
    walk = items.hits(text, item, start)
    first = np.full(trials, most)
    np.minimum.at(first, item[walk >= 0], walk[walk >= 0])
    return np.array([(first < k + 1).mean() for k in range(most)])


def walks_for(edits: int) -> int:
    """By ``measured``, 400 items a size: sizes 10, 32, 64, 128, 256 take 4, 5, 6, 7 and 12 walks for 0.99; these are more."""
    return 6 + edits // 4 if edits else 1


def _prepared(docs: DataFrame, items: DataFrame, item_col: str, item_text: str, similarity: float) -> Iterator:
    """The items for every task, in runs of about RUN_WORDS words."""
    spark = tuned(docs.sparkSession)
    usable = items.select(F.col(item_col).cast("long").alias("item"), F.col(item_text).alias("text")).filter("item IS NOT NULL AND text IS NOT NULL")
    words = usable.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    runs = -(-words // RUN_WORDS) or 1
    for run in range(runs):  # more than one only for a benchmark of over RUN_WORDS words
        part = usable.filter(F.pmod(F.xxhash64("item", "text"), F.lit(runs)) == run).distinct().orderBy("item", "text").collect()
        names, count = tokens(pa.array([r["text"] for r in part], pa.large_string()))
        split = [names[count[k] : count[k + 1]] for k in range(len(part))]
        kept = [k for k, w in enumerate(split) if len(w)]
        yield spark.sparkContext.broadcast(pickle.dumps(Items([part[k]["item"] for k in kept], [split[k] for k in kept], similarity).prepare()))


def matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", similarity: float = 0.8) -> DataFrame:
    """One row for each item in each text of docs: (id_col, item_col, first_word, n_words, distance).

    Words are runs of letters, digits and non-ASCII characters in lower case. The row tells
    the nearest stretch, the first of equals, in words from 0, and its edit distance. Null or
    wordless texts and items match nothing; a null id stays null; a row that comes twice
    matches twice; an item id that comes twice matches by each of its texts. Other columns are
    not read.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    out = None
    for shared in _prepared(docs, items, item_col, item_text, similarity):
        found = _scan(plain, shared)
        out = found if out is None else out.unionAll(found)
    return out.withColumnsRenamed({"id": id_col, "item": item_col})


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", similarity: float = 0.8) -> DataFrame:
    """The rows of docs that hold no item, with all their columns, whatever their names.

    A null text holds none; null ids and repeated rows are judged like any other. A row is
    kept or dropped in the task that scans it.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text_col}`").alias("text"))
    for shared in _prepared(docs, items, item_col, item_text, similarity):

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = pickle.loads(shared.value)
            for b in batches:
                stay = np.ones(b.num_rows, bool)
                for text, *_ in items.matches(*tokens(b.column(1))):
                    stay[text] = False
                yield b.filter(pa.array(stay))

        rows = rows.mapInArrow(keep, rows.schema)
    return rows.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def _scan(plain: DataFrame, shared) -> DataFrame:
    kinds = [pa.int64()] * 2 + [pa.int32()] * 3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = pickle.loads(shared.value)
        for b in batches:
            words, cuts = tokens(b.column(1))
            rows = [(b.column(0)[text].as_py(), items.ids[k], at, size, distance) for text, k, at, size, distance in items.matches(words, cuts)]
            cols = [pa.array(list(x), k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays(cols, ["id", "item", "first_word", "n_words", "distance"])

    return plain.mapInArrow(run, "id long, item long, first_word int, n_words int, distance int")
