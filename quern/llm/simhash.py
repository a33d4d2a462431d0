"""SimHash near-duplicates by a self-join of binary tries.

A text becomes a 64-bit fingerprint; two fingerprints link when at most ``budget`` bits
differ. Distinct fingerprints are dealt to subtries: the 64 bits are cut into budget + 1
blocks, and any linked pair agrees wholly on one of them, so each fingerprint goes into one
subtrie for each block, the one whose path is its own bits there. A subtrie that holds too
many is dealt on in the same way by the bits that its path doesn't use, whatever the size of
the table; so the copies of a fingerprint are bounded and subtries keep their size as the
table grows. Inside a subtrie node pairs are walked together, level by level, differing bits
add up, and a pair of nodes over the budget is dropped with everything below it. What is
still too full after DEALS rounds is cut into chunks and the walk runs over pairs of chunks,
so no task holds an unbounded group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import windows
from quern.llm.common import Workspace, partitions, row_key, text_bytes
from quern.llm.components import components, merge

BITS = 64
#: Node pairs that are walked at a time, and pairs of leaves small enough to compare outright.
FRONT, LEAF = 1 << 13, 256
#: Fingerprints that a subtrie keeps together, at most, and rounds of dealing: (budget + 1) to the power of that many copies of each at the most.
FULL, DEALS = 50_000, 3


def fingerprint(text: bytes, width: int) -> int:
    """Of A-Z lower-cased words cut at ASCII white space: bit b is 1 if over half of the shingle hashes have it."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    if len(words) <= width:
        cuts = [(0, len(line))]
    else:
        starts = np.concatenate(([0], ends[:-1] + 1))
        cuts = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(line[a:b], 42) for a, b in cuts), np.uint64)
    votes = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = hashes[k : k + (1 << 16)]
        votes += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """(id, fp long). Null and wordless texts have fingerprint 0."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = np.fromiter((fingerprint(x or b"", width) for x in b.column(1).cast(pa.binary()).to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got.view(np.int64))], ["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(scan, "id long, fp long")


def paths(budget: int, deals: int) -> list[list[int]]:
    """For each round of dealing the masks (signed) of the bits that a subtrie's path takes; way w of a round is dealt on by ways w * (budget + 1) + 0, 1, ... of the next."""
    out, now = [], [(0, list(range(BITS)))]
    for _ in range(deals):
        parts = [(mask, rest, part.tolist()) for mask, rest in now for part in np.array_split(np.array(rest, np.int64), budget + 1)]
        now = [(mask | sum(1 << b for b in part), [x for x in rest if x not in part]) for mask, rest, part in parts]
        out.append([mask - (mask >> (BITS - 1) << BITS) for mask, _ in now])
    return out


def _pairs(na: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For group sizes na, nb: the group, and both positions inside it, of every pair."""
    n = na * nb
    group = np.repeat(np.arange(len(n)), n)
    k = np.arange(len(group)) - np.repeat(np.cumsum(n) - n, n)
    return group, k // nb[group], k % nb[group]


def walk(fps: np.ndarray, roots: list[tuple[np.ndarray, ...]], budget: int) -> np.ndarray:
    """Walks tries of sorted fingerprints together; returns for each fingerprint the least position it is linked to.

    fps: uint64, ascending inside each trie. roots: arrays (lo, hi, lo2, hi2) of the node
    pairs to start from, positions in fps; equal ranges mean a trie against itself.
    """
    parent = np.arange(len(fps))
    lo, hi, lo2, hi2 = roots
    todo = [(lo, hi, lo2, hi2, np.zeros(len(lo), np.int64), np.full(len(lo), BITS - 1, np.int64))]
    while todo:
        lo, hi, lo2, hi2, diff, bit = todo.pop()
        if len(lo) > FRONT:  # depth first, a bounded front at a time
            todo += [tuple(x[k : k + FRONT] for x in (lo, hi, lo2, hi2, diff, bit)) for k in range(0, len(lo), FRONT)]
            continue
        na, nb = hi - lo, hi2 - lo2
        leaf = (na * nb <= LEAF) | (bit < 0)
        if leaf.any():
            g, i, j = _pairs(na[leaf], nb[leaf])
            a, b = lo[leaf][g] + i, lo2[leaf][g] + j
            near = (a != b) & (np.bitwise_count(fps[a] ^ fps[b]) <= budget)
            merge(parent, a[near], b[near])
        lo, hi, lo2, hi2, diff, bit = (x[~leaf] for x in (lo, hi, lo2, hi2, diff, bit))
        if not len(lo):
            continue
        mid, mid2 = _split(fps, lo, hi, bit), _split(fps, lo2, hi2, bit)
        own = (lo == lo2) & (hi == hi2)
        parts = [
            (lo, mid, lo2, mid2, diff),
            (mid, hi, mid2, hi2, diff),
            (lo, mid, mid2, hi2, diff + 1),
            (np.where(own, 0, mid), np.where(own, 0, hi), lo2, mid2, diff + 1),  # a trie against itself meets its halves once
        ]
        lo, hi, lo2, hi2, diff = (np.concatenate(x) for x in zip(*parts, strict=True))
        bit = np.tile(bit - 1, 4)
        keep = (hi > lo) & (hi2 > lo2) & (diff <= budget) & ~((lo == lo2) & (hi - lo == 1) & (hi2 - lo2 == 1))
        todo.append(tuple(x[keep] for x in (lo, hi, lo2, hi2, diff, bit)))
    return parent


def _split(fps: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """Where the bit turns to 1 inside each sorted node, by halving."""
    a, b = lo.copy(), hi.copy()
    one = np.uint64(1)
    while (open_ := a < b).any():
        mid = (a + b) // 2
        at = np.minimum(mid, len(fps) - 1)
        is_one = ((fps[at] >> bit.astype(np.uint64)) & one).astype(bool)
        b = np.where(open_ & is_one, mid, b)
        a = np.where(open_ & ~is_one, mid + 1, a)
    return a


def _cells(key: np.ndarray, side: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """Rows sorted by (key, side, fingerprint) and the node pairs to walk: a key with one side is walked against itself."""
    order = np.lexsort((fps, side, key))
    key, side = key[order], side[order]
    new = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (side[1:] != side[:-1]))))
    end = np.append(new[1:], len(key))
    follows = np.append((key[new][1:] == key[new][:-1]), False)  # this node is side 0 and the next is side 1 of the same key
    second = np.concatenate(([False], follows[:-1]))
    mate = np.arange(len(new)) + follows
    first = ~second
    alone = first & ~follows & (side[new] == 0)
    use = np.flatnonzero(alone | (first & follows))
    m = mate[use]
    return order, (new[use], end[use], new[m], end[m])


def link_forest(ws: Workspace, fps: DataFrame, budget: int = 4) -> DataFrame:
    """(a, b): links that join exactly the fingerprints whose link graph is connected. fps: one distinct long column fp.

    Each task returns a spanning forest of the links it finds, never all pairs.
    """
    spark = ws.spark
    n = fps.count()
    total = n * (budget + 1)
    tasks = max(4 * partitions(spark), -(-total // FULL))
    most = max(256, min(FULL, total // tasks))
    masks = paths(budget, DEALS)

    def dealt_by(rows: DataFrame, deal: int, way) -> DataFrame:
        path = F.col("fp").bitwiseAND(F.get(F.array(*[F.lit(m) for m in masks[deal]]), F.col("way")))
        return rows.select("fp", F.explode(way).alias("way")).select("fp", "way", F.xxhash64(F.lit(deal), "way", path).alias("cell"))

    ways = F.sequence(F.lit(0), F.lit(budget))
    dealt = dealt_by(fps, 0, ways)
    for deal in range(1, DEALS):
        # A subtrie is dealt on where chunks of it would make more copies than that. There are fewer of them than rows / most.
        full = ws.save(dealt.groupBy("cell").count().filter(F.col("count") > most * (budget + 1)).select("cell"))
        if full.isEmpty():
            break
        over = dealt.join(F.broadcast(full), "cell", "left_semi")
        dealt = ws.save(dealt.join(F.broadcast(full), "cell", "left_anti").select("fp", "way", "cell").union(dealt_by(over, deal, F.transform(ways, lambda w: F.col("way") * (budget + 1) + w))))
    # Subtries to cut: rows / most of them at the most.
    sizes = ws.save(dealt.groupBy("cell").count().filter(F.col("count") > most).select("cell", F.ceil(F.col("count") / F.lit(most)).cast("int").alias("cut")))
    dealt = dealt.join(F.broadcast(sizes), "cell", "left").withColumn("chunks", F.coalesce("cut", F.lit(1))).withColumn("chunk", F.pmod(F.xxhash64("fp", F.lit(7)), F.col("chunks")).cast("int"))
    # Chunk i meets chunk j: once for each pair i <= j.
    meets = dealt.select(
        "fp", "cell", "chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")
    ).select(
        "fp", F.xxhash64("cell", F.least("chunk", "other"), F.greatest("chunk", "other")).alias("key"), (F.col("chunk") > F.col("other")).cast("int").alias("side")
    )
    binned = meets.withColumn("bin", F.pmod("key", F.lit(tasks)))

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        f = rows["fp"].to_numpy().view(np.uint64)
        order, roots = _cells(rows["key"].to_numpy(), rows["side"].to_numpy(), f)
        f = f[order]
        parent = walk(f, roots, budget)
        got = np.flatnonzero(parent != np.arange(len(parent)))
        s = f.view(np.int64)
        return pd.DataFrame({"a": s[got], "b": s[parent[got]]})

    return binned.groupBy("bin").applyInPandas(join, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, budget: int = 4) -> DataFrame:
    """One row for each row of docs: (id_col, fingerprint, component_id).

    component_id is the least id reachable by links of at most ``budget`` differing bits,
    the row's own included. Null and wordless texts share fingerprint 0 and link like any
    other. A null id is kept and never becomes a component's id, unless no id is known.
    Repeated rows come out as often as they went in; other columns are not read.
    """
    ws = Workspace(docs.sparkSession, "simhash")
    marked = ws.save(fingerprints(docs, id_col, text_col, width))
    reps = ws.save(marked.groupBy("fp").agg(F.min("id").alias("rep")))
    found = ws.save(components(ws, link_forest(ws, reps.select("fp"), budget)))
    linked = found.join(reps, found["node"] == reps["fp"]).select("node", "root", "rep")
    least = ws.save(linked.groupBy("root").agg(F.min("rep").alias("least")))
    by_fp = ws.save(reps.join(found, reps["fp"] == found["node"], "left").join(least, "root", "left").select("fp", F.coalesce("least", "rep").alias("component_id")))
    return marked.join(by_fp, "fp").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: Minima of a text's shingle hashes that candidates are found by: BANDS groups of ROWS.
BANDS, ROWS = 10, 3
#: Pairs with one text that stay on one key, texts of a group that are compared pair by pair, and keys that are broadcast.
HOT, MEMBERS, KEYS = 512, 32, 1_000_000
#: Seats that elements of differences are counted in, at most (two bytes each), and elements that a task counts, about. Fewer seats than elements tell rare ones less well; the links are the same.
SEATS, ELEMENTS = 1 << 24, 5_000_000
_MUL, _ADD = np.random.default_rng(77).integers(1, 1 << 63, (2, BANDS * ROWS), np.uint64) * np.uint64(2) + np.uint64(1)


def _runs(names: windows.Names, start: np.ndarray, size: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of each text, and their number in it, one at least."""
    n = np.maximum(size - width + 1, 1)
    at = np.repeat(start, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return names.at(at, np.repeat(np.minimum(size, width), n)), n


def sketches(keyed: DataFrame, width: int, shingle: int) -> DataFrame:
    """keyed: _id, _h, text. (_id, _h, fp, bands): a fingerprint of ``width`` words, and hashed minima of shingles of ``shingle`` words.

    Texts with fewer words than a shingle are one shingle.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = text_bytes(b.column(2))
            _, _, words, count = windows.words(windows.lowered(data), offsets)
            n = b.num_rows
            votes, total = np.zeros((n, BITS), np.int64), np.zeros(n, np.int64)
            least = np.full((n, BANDS * ROWS), np.uint64(0xFFFFFFFFFFFFFFFF))
            for part in windows.pieces(count, shingle - 1):  # a longer text comes in several
                text, start, stop = (np.array(x) for x in zip(*part, strict=True))
                names = windows.Names(np.concatenate([words[a:b] for _, a, b in part]))
                begin, size = np.concatenate(([0], np.cumsum(stop - start)[:-1])), stop - start
                hashes, times = _runs(names, begin, size, width)
                ends = np.cumsum(times)
                for row, lo, hi in zip(text.tolist(), (ends - times).tolist(), ends.tolist(), strict=True):
                    for k in range(lo, hi, 1 << 15):
                        own = hashes[k : min(hi, k + (1 << 15))]
                        votes[row] += np.unpackbits(own.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
                    total[row] += hi - lo
                hashes, times = _runs(names, begin, size, shingle)
                first = np.cumsum(times) - times
                for k in range(BANDS * ROWS):
                    got = np.minimum.reduceat(windows.mix(hashes * _MUL[k] + _ADD[k]), first)
                    np.minimum.at(least[:, k], text, got)
            bits = votes * 2 > total[:, None]
            bits[np.diff(count) == 0] = False
            fp = np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()
            weights = _MUL[:ROWS]
            bands = windows.mix((least.reshape(n, BANDS, ROWS) * weights).sum(2, dtype=np.uint64))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(fp.astype(np.uint64).view(np.int64)), pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), pa.array(bands.view(np.int64).ravel()))],
                ["_id", "_h", "fp", "bands"],
            )

    return keyed.mapInArrow(scan, "_id long, _h long, fp long, bands array<long>")


def shingle_sets(keyed: DataFrame, shingle: int) -> DataFrame:
    """keyed: _id, _h, text. (_h, n, s): the different shingles of each row's text by their hashes, and how many there are."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = text_bytes(b.column(2))
            _, _, words, count = windows.words(windows.lowered(data), offsets)
            own: list[list[np.ndarray]] = [[] for _ in range(b.num_rows)]
            for part in windows.pieces(count, shingle - 1):  # a longer text comes in several
                text, start, stop = (np.array(x) for x in zip(*part, strict=True))
                names = windows.Names(np.concatenate([words[a:b] for _, a, b in part]))
                begin, size = np.concatenate(([0], np.cumsum(stop - start)[:-1])), stop - start
                hashes, times = _runs(names, begin, size, shingle)
                for row, h in zip(text.tolist(), np.split(hashes, np.cumsum(times)[:-1]), strict=True):
                    own[row].append(h)
            sets = [np.unique(np.concatenate(x)) if x else np.zeros(0, np.uint64) for x in own]
            n = np.array([len(x) for x in sets], np.int32)
            flat = np.concatenate([*sets, np.zeros(0, np.uint64)]).astype(np.uint64).view(np.int64)
            s = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(n), s], ["_h", "n", "s"])

    return keyed.mapInArrow(scan, "_h long, n int, s array<long>")


def _beside(ws: Workspace, pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs: a, b and more. With the numbers na, nb and the sets sa, sb of both texts. A text that is b of many pairs is dealt over several keys."""
    ends = ws.save(pairs.groupBy("b").count())
    parts = F.coalesce("parts", F.lit(1))
    hot = ws.save(ends.filter(F.col("count") > HOT).select("b", F.ceil(F.col("count") / HOT).cast("int").alias("parts")))
    # Few pairs meet the sets where these lie, and only the sets of their ends move.
    few = ends.agg(F.sum("count")).first()[0] or 0
    near = F.broadcast if few <= KEYS else (lambda df: df)
    left = near(pairs.join(F.broadcast(hot), "b", "left").withColumn("part", F.pmod(F.xxhash64("a"), parts).cast("int")).drop("parts"))
    right = sets.select(F.col("_h").alias("b"), F.col("n").alias("nb"), F.col("s").alias("sb")).join(near(ends.select("b")), "b", "left_semi").join(F.broadcast(hot), "b", "left")
    right = right.select("b", "nb", "sb", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    return sets.select(F.col("_h").alias("a"), F.col("n").alias("na"), F.col("s").alias("sa")).join(left, "a").join(right, ["b", "part"])


def alike(ws: Workspace, pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets have a Jaccard similarity of ``similarity`` or more, exactly."""
    met = _beside(ws, pairs, sets).select("a", "b", "na", "nb", F.size(F.array_intersect("sa", "sb")).alias("met"))
    return met.filter(F.col("met") + 1e-9 >= similarity * (F.col("na") + F.col("nb") - F.col("met"))).select("a", "b")


def _places(b: np.ndarray, e: np.ndarray, seats: int) -> np.ndarray:
    """The seat of element e of hub b's differences among so many, a power of two."""
    return (windows.mix(e.view(np.uint64) + windows.mix(b.view(np.uint64))) & np.uint64(seats - 1)).astype(np.int64)


def _lists(batches: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """The batches in pieces of about so many elements of their last column, a list: a piece, its elements, and the row in it of each."""
    for whole in batches:
        ends = np.cumsum(np.asarray(whole.columns[-1].value_lengths()).astype(np.int64))
        cuts = np.flatnonzero(np.diff(ends // most, prepend=-1)).tolist()
        for lo, hi in zip(cuts, [*cuts[1:], whole.num_rows], strict=True):
            b = whole.slice(lo, hi - lo)
            d = b.columns[-1]
            yield b, np.asarray(d.flatten()).astype(np.int64), np.repeat(np.arange(hi - lo), np.asarray(d.value_lengths()))


def _often(each: DataFrame) -> np.ndarray:
    """How many of a hub's members have an element in their differences, by its seat: never too few, and too many where others share the seat.

    each: b, d. Tasks count in arrays of up to SEATS seats and these are added up, so what moves is bounded whatever the table.
    """
    n = each.agg(F.sum(F.size("d"))).first()[0] or 0
    seats = min(SEATS, max(1 << 12, 1 << int(8 * n).bit_length()))
    cut = min(seats, 1 << 16)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        had = np.zeros(seats, np.uint16)
        for batch, e, row in _lists(batches):
            at, times = np.unique(_places(batch.column(0).to_numpy()[row], e, seats), return_counts=True)
            had[at] = np.minimum(had[at] + times, 65535)
        for k in range(0, seats, cut):
            if had[k : k + cut].any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([had[k : k + cut].tobytes()], pa.binary())], ["k", "had"])

    def add(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, np.uint16).astype(np.int64) for x in rows["had"])
        return pd.DataFrame({"k": [int(key[0])], "had": [np.minimum(total, 65535).astype(np.uint16).tobytes()]})

    parts = each.select("b", "d").coalesce(4 + n // ELEMENTS).mapInArrow(count, "k long, had binary")
    out = np.zeros(seats, np.uint16)
    for k, had in parts.groupBy("k").applyInPandas(add, "k long, had binary").collect():
        out[k : k + cut] = np.frombuffer(had, np.uint16)
    return out


def _prefixes(each: DataFrame, similarity: float) -> DataFrame:
    """each: b, a, na, nb, root, out, d. A row for each element of d that a pair can first meet by: at, its place in d from the rarest on, and whether it is among the first of _apart."""
    c = (1 - similarity) / (1 + similarity)
    shared = each.sparkSession.sparkContext.broadcast(_often(each))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        had = shared.value
        for batch, e, row in _lists(batches):
            b, a, na, nb, root, out = (np.asarray(batch.column(k)) for k in range(6))
            n = had[_places(b[row], e, len(had))]
            order = np.lexsort((e, n, row))
            e, n, row = e[order], n[order], row[order]
            d = np.bincount(row, minlength=len(b))
            at = np.arange(len(e)) - (np.cumsum(d) - d)[row]
            near = np.floor(na * (1 - similarity) / similarity + 1e-6).astype(np.int64) + 1
            first = np.minimum(near, d - np.floor((d + c * (nb - na)) / 2 + 1e-6).astype(np.int64))
            keep = (n > 1) & (at < np.where(out, near, first)[row])
            e, at, row = e[keep], at[keep], row[keep]
            columns = [b[row], a[row], na[row], root[row], out[row], d[row], at, at < first[row], e]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["b", "a", "na", "root", "out", "d", "at", "first", "e"])

    return each.mapInArrow(scan, "b long, a long, na int, root long, out boolean, d long, at long, first boolean, e long")


def _apart(ws: Workspace, members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): pairs of a hub's members, one of them at least unlike the hub, that can be alike; none that is alike is missing.

    members: (b, a, root, out), a hub, a member, its component and whether that is another
    than the hub's. A set is told by what it and the hub's do not share, its difference. Sets
    x and y are alike if their differences d differ in at most c * (x + y) elements, c = (1 -
    similarity) / (1 + similarity); y is out, so d(y) > c * (hub + y); so d(x) and d(y) share
    over (d(x) + c * (hub - x)) / 2 elements. Neither is larger than the other by more than
    1 / similarity, so all but x * (1 - similarity) / similarity elements of d(x) are in d(y),
    and so for y. With elements in one order for a hub, rare ones first, the first that both
    share is then among the first of x and of y by these bounds, and what follows it on both
    sides is enough for the rest. So a member has a row for a quarter of its own shingles at
    the most (similarity 0.8), however far the hub is, and none for those that it alone has.
    """
    c = (1 - similarity) / (1 + similarity)
    both = _beside(ws, members, sets)
    differ = F.concat(F.array_except("sa", "sb"), F.array_except("sb", "sa"))
    rows = ws.save(_prefixes(ws.save(both.select("b", "a", "na", "nb", "root", "out", differ.alias("d"))), similarity))
    first = rows.filter("first").select("b", "e", *[F.col(k).alias(f"_{k}") for k in ("a", "na", "root", "out", "d", "at")])
    once = ~F.col("_out") | (F.col("a") > F.col("_a"))
    sized = F.least("na", "_na") + 1e-9 >= similarity * F.greatest("na", "_na")
    enough = F.least(F.col("d") - F.col("at"), F.col("_d") - F.col("_at")) + 1e-6 >= (F.col("d") + F.col("_d") - c * (F.col("na") + F.col("_na"))) / 2
    y, x = rows.filter("out").alias("y"), first.alias("x")
    met = y.join(x, (F.col("y.b") == F.col("x.b")) & (F.col("y.e") == F.col("x.e")) & (F.col("a") != F.col("_a")) & (F.col("root") != F.col("_root")) & once & sized & enough)
    return met.select(F.greatest("a", "_a").alias("a"), F.least("a", "_a").alias("b"))


def near_links(ws: Workspace, groups: DataFrame, pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(node, root) of the texts that links of ``similarity`` or more join, each of them checked.

    groups: (g, _h), texts that share a candidate key; pairs: (a, b), other candidates. In each
    group a hub, the member whose keys hold the most texts, is compared with every member. A
    pair that may be left has a member in another component than the hub's. In groups of up
    to MEMBERS such pairs are compared one by one, in larger ones those that differ from the
    hub in enough of the same shingles; so no link inside a group is lost, and a group of
    near copies, or of unlike texts, costs about one comparison a member.
    """
    groups = groups.join(sets.select("_h", "n"), "_h")
    groups = ws.save(groups.join(groups.groupBy("g").agg(F.count("*").alias("size")), "g").filter("size > 1"))
    rank = groups.groupBy("_h").agg(F.sum("size").alias("rank"))
    ends = groups.select("g", "_h", "n").join(rank, "_h").groupBy("g").agg(F.max(F.struct("rank", "_h", "n")).alias("hub"))
    hubs = ws.save(ends.select("g", F.col("hub._h").alias("b"), F.col("hub.n").alias("nb")))
    sized = lambda n, m: F.least(n, m) + 1e-9 >= similarity * F.greatest(n, m)
    met = groups.join(hubs, "g").filter((F.col("_h") != F.col("b")) & sized("n", "nb")).select(F.greatest("_h", "b").alias("a"), F.least("_h", "b").alias("b"))
    links = ws.save(alike(ws, ws.save(met.union(pairs.select(F.greatest("a", "b"), F.least("a", "b"))).distinct()), sets, similarity))
    joined = ws.save(components(ws, links))
    # Members with their components, in groups where some are in another than the hub's.
    name = lambda t, c, r: t.join(joined.toDF(c, r), c, "left").withColumn(r, F.coalesce(r, c))
    placed = name(name(groups.filter("size > 2"), "_h", "root").join(hubs.select("g", "b"), "g"), "b", "own")
    placed = ws.save(placed.filter(F.col("_h") != F.col("b")).select("g", "b", "size", F.col("_h").alias("a"), "n", "root", (F.col("root") != F.col("own")).alias("out")))
    left = placed.filter("out").select("g").distinct()
    few = placed.filter(F.col("size") <= MEMBERS).join(left, "g", "left_semi")
    one, other = few.filter("out").select("g", "a", "n", "root"), few.select("g", *[F.col(k).alias(f"_{k}") for k in ("a", "n", "root", "out")])
    met = one.join(other, "g").filter((F.col("root") != F.col("_root")) & (~F.col("_out") | (F.col("a") > F.col("_a"))) & sized("n", "_n"))
    met = met.select(F.greatest("a", "_a").alias("a"), F.least("a", "_a").alias("b"))
    many = ws.save(placed.filter(F.col("size") > MEMBERS).join(left, "g", "left_semi").select("b", "a", "root", "out").distinct())
    if not many.isEmpty():
        met = met.union(_apart(ws, many, sets, similarity))
    met = ws.save(met.distinct())
    if met.isEmpty():
        return joined
    # What is joined so far is a star by now and needs few steps more.
    return ws.save(components(ws, ws.save(alike(ws, met, sets, similarity).union(joined.select("node", "root")))))


def near_classes(ws: Workspace, keyed: DataFrame, width: int = 2, budget: int = 4, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(_h, _id, root): each different text with its least id, and the name of its class of near copies. keyed: _id, _h, text."""
    marked = ws.save(sketches(keyed, width, shingle))
    texts = ws.save(marked.groupBy("_h").agg(F.min("_id").alias("_id"), F.min("fp").alias("fp"), F.min("bands").alias("bands")))
    ws.drop(marked)
    ends = ws.save(texts.groupBy("fp").agg(F.min("_h").alias("_h")))
    forest = link_forest(ws, ends.select("fp"), budget).distinct()
    pairs = ws.save(forest.join(ends.toDF("a", "ha"), "a").join(ends.toDF("b", "hb"), "b").select(F.col("ha").alias("a"), F.col("hb").alias("b")))
    by_band = texts.select("_h", F.posexplode("bands").alias("band", "least")).select(F.xxhash64("band", "least").alias("g"), "_h")
    every = by_band.union(texts.select(F.xxhash64(F.lit("fp"), "fp").alias("g"), "_h"))
    shared = every.groupBy("g").count().filter("count > 1").select("g")
    groups = ws.save(every.join(shared, "g"))
    picked = ws.save(groups.select("_h").union(pairs.select("a")).union(pairs.select("b")).distinct().join(texts.select("_h", "_id"), "_h"))
    few = F.broadcast(picked) if picked.count() <= KEYS else picked
    sets = ws.save(shingle_sets(keyed.join(few, ["_id", "_h"], "left_semi").select("_id", "_h", "text"), shingle).dropDuplicates(["_h"]))
    joined = near_links(ws, groups, pairs, sets, similarity)
    return texts.select("_h", "_id").join(joined.withColumnRenamed("node", "_h"), "_h", "left").withColumn("root", F.coalesce("root", "_h"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 2, budget: int = 4, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs that stay when of each group of copies and near copies one does: that of the least (id, hash of the text).

    Texts link if their sets of shingles of ``shingle`` words, A-Z lower-cased, have a Jaccard
    similarity of ``similarity`` or more; every link is checked on the whole sets. Candidates
    are texts whose fingerprints are within ``budget`` bits, linked by the trie self-join, and,
    whatever their fingerprints, texts that agree on all minima of a band: a pair of similarity
    0.8 does so in 999 of 1000 cases. Null and wordless texts are one group. A null id counts
    as the least. Rows that repeat are copies of each other. All columns pass through,
    whatever their names. An empty table gives an empty result.
    """
    ws = Workspace(docs.sparkSession, "copies")
    key = row_key(id_col, text_col)
    keyed = docs.select(*key, F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    grouped = near_classes(ws, keyed, width, budget, shingle, similarity)
    stay = ws.save(grouped.groupBy("root").agg(F.min(F.struct("_id", "_h")).alias("one")).select("one.*"))
    # Only records that come twice with the same id need to be told apart; all other texts move once, or not at all where the keys are few.
    times = ws.save(docs.select(*key).groupBy("_id", "_h").count().join(stay, ["_id", "_h"]))
    rows = docs.select(*key, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))

    def of(keys: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(keys) if keys.count() <= KEYS else keys, ["_id", "_h"], "left_semi")

    once, more = of(times.filter("count = 1").select("_id", "_h")), of(times.filter("count > 1").select("_id", "_h")).dropDuplicates(["_id", "_h"])
    return once.union(more).select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
