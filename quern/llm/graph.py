"""Embedding near-duplicates over a robust-pruned flat graph.

Different vectors are dealt to clusters, each to its nearest ones, so clusters overlap; a
cluster that is too large is cut into shards. Every shard gets a graph: each vector is joined
to its near ones, leaving out those that a kept neighbour is nearer to (robust pruning). A
vector's lists from all its shards are united. Then every vector is searched for in the
shards of the clusters near it: greedily from the shard's medoid, and from its own place
where it is a member, to the nearest vectors, and on from there over all neighbours within
the range. Hits are verified by the cosine in double precision. A brute-force audit of
vectors picked without regard to what was found measures recall; if it is short, the search takes in more clusters.

A link has one task where it counts, for both of its ends, whichever end found the other: the
shards are so dealt that a task holds both. So counts are symmetric although no pair leaves
its task: tasks return a count for each end and a spanning forest of their links.
A shard and the part of the queries it meets are both bounded, so no group is held whole.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from math import sqrt
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import Workspace, partitions
from quern.llm.components import components, merge

#: Vectors that clusters are fitted on, at most, and clusters, at most: both bound what the driver holds. A cluster is cut
#: into parts beyond 4096 vectors, so from 268 million different vectors on the work grows faster than their number.
SAMPLE, CLUSTERS = 131_072, 65_536
#: Degree of the graph, candidates of a vector for it, slack of the pruning, and width of the greedy search.
DEGREE, POOL, SLACK, BEAM = 16, 48, 1.2, 24
#: Overlap of the clusters in cosine, and how far off a cluster may be that is looked in.
OVERLAP, REACH = 0.15, 0.25
#: Queries with links that the audit goes on to, queries it asks at most (so its work is linear in the table), and the recall it asks for.
AUDIT, ASKED, RECALL = 256, 8192, 0.98


def unit(a: np.ndarray) -> np.ndarray:
    return a / np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-300)


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of an array<double> column whose rows are of one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(n, -1) if n else np.zeros((0, 1))


def nearest(u: np.ndarray, centres: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For blocks of rows: centres by falling cosine, at most so many, and the cosines."""
    most = min(most, len(centres))
    block = max(64, min(2048, (1 << 24) // len(centres)))
    for k in range(0, len(u), block):
        s = u[k : k + block] @ centres.T
        top = np.argpartition(-s, most - 1, axis=1)[:, :most]
        value = np.take_along_axis(s, top, 1)
        order = np.argsort(-value, axis=1, kind="stable")
        yield np.take_along_axis(top, order, 1), np.take_along_axis(value, order, 1)


def fit_centres(sample: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """Spherical k-means, from rows spread evenly over the sample."""
    centres = sample[np.linspace(0, len(sample) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        own = np.concatenate([t[:, 0] for t, _ in nearest(sample, centres, 1)])
        total = np.zeros_like(centres)
        np.add.at(total, own, sample)
        size = np.linalg.norm(total, axis=1)
        centres[size > 0] = total[size > 0] / size[size > 0, None]
    return centres


def robust_prune(u: np.ndarray, degree: int = DEGREE, pool: int = POOL, slack: float = SLACK) -> np.ndarray:
    """Neighbour lists (-1: none) of unit rows. A candidate is left out if a kept neighbour is nearer to it by ``slack`` than the row is."""
    n = len(u)
    pool = min(pool, n - 1)
    if pool < 1:
        return np.full((n, 1), -1)
    out = np.full((n, min(degree, pool)), -1)
    for lo in range(0, n, 512):
        rows = np.arange(lo, min(n, lo + 512))
        s = u[rows] @ u.T
        s[np.arange(len(rows)), rows] = -np.inf
        near = np.argpartition(-s, pool - 1, axis=1)[:, :pool]
        value = np.take_along_axis(s, near, 1)
        order = np.argsort(-value, axis=1, kind="stable")
        near, value = np.take_along_axis(near, order, 1), np.take_along_axis(value, order, 1)
        far = np.sqrt(np.maximum(2 - 2 * value, 0))
        open_ = np.ones(near.shape, bool)
        every = np.arange(len(rows))
        for d in range(out.shape[1]):
            some = open_.any(1)
            if not some.any():
                break
            pick = open_.argmax(1)  # the nearest that is left
            kept = near[every, pick]
            out[rows[some], d] = kept[some]
            between = np.sqrt(np.maximum(2 - 2 * np.einsum("ij,ikj->ik", u[kept], u[near]), 0))
            open_ &= slack * between > far
            open_[every, pick] = False
    return out


def united(lists: list[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and targets of an undirected graph from (from, to) pairs; repeats and loops go."""
    if not lists:
        return np.zeros(n + 1, np.int64), np.zeros(0, np.int64)
    e = np.concatenate(lists, axis=1)
    e = np.concatenate([e, e[::-1]], axis=1)
    code = np.unique(e[0] * n + e[1])
    a, b = code // n, code % n
    a, b = a[a != b], b[a != b]
    return np.searchsorted(a, np.arange(n + 1)), b


def search(u: np.ndarray, at: np.ndarray, to: np.ndarray, queries: np.ndarray, own: np.ndarray, least: float, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """(query, member) pairs with a cosine of ``least`` or more that a range-expanding greedy search finds.

    u: unit rows of the shard; at, to: its graph; own: the query's place in the shard, or -1.
    Queries walk together, BLOCK at a time: each holds its best ``beam`` members and opens the
    best that is not open yet; when none is left, members in the range are opened until no new
    one comes. The cosines of a block are one matrix product, which costs less than gathering
    the rows met at each step; the walk alone decides which of them are looked at.
    """
    got = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    if len(u):
        medoid = int(np.argmax(u @ u.sum(0)))
        for k in range(0, len(queries), BLOCK):
            q, v = _walk(queries[k : k + BLOCK] @ u.T, at, to, medoid, own[k : k + BLOCK], least, beam)
            got.append((q + k, v))
    return np.concatenate([q for q, _ in got]), np.concatenate([v for _, v in got])


#: Queries that walk together: their cosines with a shard of 4096 are 32 MB.
BLOCK = 1024


def _walk(cosines: np.ndarray, at: np.ndarray, to: np.ndarray, medoid: int, own: np.ndarray, least: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
    m, n = cosines.shape
    seen, opened = np.zeros((m, n), bool), np.zeros((m, n), bool)
    best, place = np.full((m, beam), -np.inf), np.zeros((m, beam), np.int64)  # the best that each query has seen
    opened_best = np.ones((m, beam), bool)

    mark = np.zeros(m * n, np.int32)

    def visit(q: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those that are new, each once, in the order given."""
        code = q * n + v
        code = code[~seen.ravel()[code]]
        mark[code] = nth = np.arange(len(code), dtype=np.int32)
        code = code[mark[code] == nth]
        seen.ravel()[code] = True
        return code // n, code % n

    def around(q: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        times = at[v + 1] - at[v]
        k = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        return np.repeat(q, times), to[np.repeat(at[v], times) + k]

    def hold(q: np.ndarray, v: np.ndarray) -> None:
        """Takes new ones in among the best; q ascends."""
        if not len(q):
            return
        first = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1])))
        times = np.diff(np.append(first, len(q)))
        some, row = q[first], np.repeat(np.arange(len(first)), times)
        nth = np.arange(len(q)) - first[row]
        new, where = np.full((len(some), times.max()), -np.inf), np.zeros((len(some), times.max()), np.int64)
        new[row, nth], where[row, nth] = cosines[q, v], v
        every, spots = np.concatenate([best[some], new], axis=1), np.concatenate([place[some], where], axis=1)
        done = np.concatenate([opened_best[some], ~np.isfinite(new)], axis=1)
        top = np.argpartition(-every, beam - 1, axis=1)[:, :beam]
        best[some], place[some], opened_best[some] = (np.take_along_axis(x, top, 1) for x in (every, spots, done))

    hold(*visit(np.arange(m), np.full(m, medoid)))
    mine = np.flatnonzero(own >= 0)
    hold(*visit(mine, own[mine]))
    live = np.arange(m)
    while len(live):
        s = np.where(opened_best[live], -np.inf, best[live])
        pick = s.argmax(1)
        some = np.isfinite(s[np.arange(len(live)), pick])
        live, pick = live[some], pick[some]
        opened_best[live, pick] = True
        opened[live, place[live, pick]] = True
        hold(*visit(*around(live, place[live, pick])))
    inside = cosines >= least
    while True:
        q, v = np.nonzero(seen & inside & ~opened)
        if not len(q):
            break
        opened[q, v] = True
        for k in range(0, len(q), 1 << 14):
            visit(*around(q[k : k + (1 << 14)], v[k : k + (1 << 14)]))
    return np.nonzero(seen & inside)


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what (a, b) join: each id and the least position it reaches."""
    ids, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = np.arange(len(ids))
    merge(parent, flat[: len(a)], flat[len(a) :])
    other = np.flatnonzero(parent != np.arange(len(ids)))
    return ids[other], ids[parent[other]]


class Clusters:
    """Where vectors go. Sent to every task: at most CLUSTERS rows."""

    def __init__(self, centres: np.ndarray):
        self.centres = centres

    def deal(self, df: DataFrame, most: int, margin: float) -> DataFrame:
        """df: id, v. (id, looks, own): the clusters near a vector, nearest first, and how many of them it is a member of (two at most)."""
        shared = df.sparkSession.sparkContext.broadcast(self.centres)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids, u, at = b.column(0).to_numpy(), unit(matrix(b.column(1))), 0
                for top, value in nearest(u, shared.value, max(2, most)):
                    ok, near = value >= value[:, :1] - margin, value[:, :2] >= value[:, :1] - OVERLAP
                    ok[:, most:] = False
                    ok[:, :2] |= near
                    ends = np.concatenate(([0], np.cumsum(ok.sum(1)))).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at : at + len(top)]), pa.ListArray.from_arrays(pa.array(ends), pa.array(top[ok].astype(np.int32))), pa.array(near.sum(1).astype(np.int32))], ["id", "looks", "own"])
                    at += len(top)

        return df.mapInArrow(run, "id long, looks array<int>, own int")


def _binned(df: DataFrame, n: int) -> DataFrame:
    return df.withColumn("bin", F.pmod("key", F.lit(n)))


def build(ws: Workspace, vectors: DataFrame, members: DataFrame, shards: DataFrame, tasks: int) -> DataFrame:
    """The united neighbour lists (id, near array<long>) of all shards. vectors: id, v; members: id, c, rank; shards: c, parts."""
    placed = members.join(F.broadcast(shards), "c").select("id", F.xxhash64("c", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).alias("key"))
    placed = _binned(placed.join(vectors.select("id", "v"), "id"), tasks)

    def graphs(rows: pa.Table) -> pa.Table:
        ids, keys, v = rows["id"].to_numpy(), rows["key"].to_numpy(), unit(matrix(rows["v"]))
        out = []
        for key in np.unique(keys):
            own = np.flatnonzero(keys == key)
            near = robust_prune(v[own])
            row, col = np.nonzero(near >= 0)
            out.append(np.stack([ids[own[row]], ids[own[near[row, col]]]]))
        e = np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int64)
        return pa.table({"id": e[0], "to": e[1]})

    edges = placed.groupBy("bin").applyInArrow(graphs, "id long, to long")
    return ws.save(edges.groupBy("id").agg(F.collect_set("to").alias("near")))


def find(ws: Workspace, vectors: DataFrame, dealt: DataFrame, shards: DataFrame, near: DataFrame, every: bool, least: float, tasks: int) -> DataFrame:
    """(id, n, links, other): for each vector and task, linked rows counted by ``copies`` and linked vectors (other null), and links of a forest (n null).

    vectors: id, v, copies; dealt: id, looks, own; every: all vectors look in all clusters. A
    cluster's rows, members and others that look in it, are dealt to as many lots as it has
    shards, and two lots meet in one task, whichever of them holds the member. A link counts
    in the cluster that is nearest to one of its ends; where each end looks in the other's, in
    that of the lesser number. So it counts once, and for both ends.
    """
    lot = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    rows = dealt.select("id", F.col("looks")[0].alias("home"), "own", F.lit(None).cast("array<int>").alias("looks") if every else F.col("looks"), F.posexplode("looks").alias("rank", "c"))
    rows = rows.withColumn("kind", F.when(F.col("rank") == 0, 1).when(F.col("rank") < F.col("own"), 0).otherwise(2)).join(F.broadcast(shards), "c")
    rows = rows.join(vectors, "id").join(near, "id", "left").select("id", "v", "copies", "home", "looks", "kind", F.when(F.col("kind") < 2, F.col("near")).alias("near"), "c", lot.alias("p"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("q"))
    rows = rows.select("id", "v", "copies", "home", "looks", "kind", "near", "c", F.xxhash64("c", F.least("p", "q"), F.greatest("p", "q")).alias("key"), (F.col("p") > F.col("q")).alias("second"), (F.col("p") != F.col("q")).alias("two"))

    def seek(table: pa.Table) -> pa.Table:
        ids, keys, kinds, copies, home, c, second, two = (table[x].to_numpy() for x in ("id", "key", "kind", "copies", "home", "c", "second", "two"))
        v = unit(matrix(table["v"]))
        links, look = _Lists(table["near"]), _Lists(table["looks"])
        ends, many, roots = [], [], []
        for key in np.unique(keys):
            here = np.flatnonzero(keys == key)
            one, other = (here[~second[here]], here[second[here]]) if two[here[0]] else (here, here)
            hits = []
            for ask, held in ((one, other), (other, one)) if two[here[0]] else ((here, here),):
                own = held[kinds[held] < 2]
                if not len(own) or not len(ask):
                    continue
                own = own[np.argsort(ids[own], kind="stable")]
                names = ids[own]
                frm, to = links.of(own)
                place = np.minimum(np.searchsorted(names, to), len(names) - 1)
                inside = names[place] == to
                at, edge = united([np.stack([frm[inside], place[inside]])], len(own))
                mine = np.minimum(np.searchsorted(names, ids[ask]), len(names) - 1)
                q, m = search(v[own], at, edge, v[ask], np.where(names[mine] == ids[ask], mine, -1), least)
                hits.append(np.stack([ask[q], own[m]]))
            a, b = np.concatenate(hits, axis=1) if hits else np.zeros((2, 0), np.int64)
            a, b = np.where(kinds[a] == 1, a, b), np.where(kinds[a] == 1, b, a)  # a: an end that is at home here
            real = (ids[a] != ids[b]) & (kinds[a] == 1)
            a, b = a[real], b[real]
            guest = kinds[b] != 1
            if guest.any():
                back = np.full(len(a), every) if every else look.hold(a, home[b])  # b could be found from where it is at home
                stays = ~guest | ~back | (c[a] < home[b])
                a, b = a[stays], b[stays]
            pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
            a, b = pair
            ends.append(np.concatenate([ids[a], ids[b]]))
            many.append(np.concatenate([copies[b], copies[a]]))
            roots.append(np.stack(_forest(ids[a], ids[b])))
        end, n = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (ends, many))
        i, at = np.unique(end, return_inverse=True)
        total = np.zeros(len(i), np.int64)
        np.add.at(total, at, n)
        a, b = np.concatenate(roots, axis=1) if roots else np.zeros((2, 0), np.int64)
        none = np.zeros(len(a), np.int64)
        joins = np.arange(len(i) + len(a)) >= len(i)
        return pa.table(
            {"id": pa.array(np.concatenate([i, a])), "n": pa.array(np.concatenate([total, none]), mask=joins), "links": pa.array(np.concatenate([np.bincount(at, minlength=len(i)).astype(np.int64), none])), "other": pa.array(np.concatenate([np.zeros(len(i), np.int64), b]), mask=~joins)}
        )

    return ws.save(_binned(rows, tasks).groupBy("bin").applyInArrow(seek, "id long, n long, links long, other long"))


class _Lists:
    """An array column of a group: what the lists of some rows hold. Null lists are empty."""

    def __init__(self, column: pa.ChunkedArray):
        lists = column.combine_chunks()
        self.sizes = lists.value_lengths().fill_null(0).to_numpy().astype(np.int64)
        self.flat = lists.flatten().to_numpy()
        self.starts = np.cumsum(self.sizes) - self.sizes

    def of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number among rows, value) of each entry."""
        n = self.sizes[rows]
        at = np.repeat(np.arange(len(rows)), n)
        return at, self.flat[np.repeat(self.starts[rows] - np.cumsum(n) + n, n) + np.arange(len(at))]

    def hold(self, rows: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Whether the list of rows[i] holds values[i]."""
        at, entry = self.of(rows)
        return np.bincount(at[entry == values[at]], minlength=len(rows)) > 0


class Audit(NamedTuple):
    """Vectors asked, those of them that truly have links, true links, found ones, recall (1 without links), and the interval of it that the sample allows at 95 %."""

    asked: int
    linked: int
    links: int
    found: int
    recall: float
    low: float
    high: float


def audited(vectors: DataFrame, counts: DataFrame, least: float, most: int = AUDIT, asked_most: int = ASKED) -> Audit:
    """Recall against brute force: links of different vectors that were found over all that the asked ones have.

    counts: id, links. Vectors are asked in the order of a hash, whatever was found for them, in
    blocks, each four times the one before, until ``most`` that truly have links are among them,
    or ``asked_most`` were asked, or none is left. So the work is linear in the table. Where links
    are so rare that few are met the interval is wide, and without any it is 0 to 1. The interval
    (Wilson's) takes each linked vector for one trial, because links of one vector are found or missed together.
    """
    asked_n, linked, true_n, found_n, block, last = 0, 0, 0, 0, most, None
    h = F.xxhash64("id", F.lit(9))
    while linked < most and asked_n < asked_most:
        rest = vectors if last is None else vectors.filter((h > last[0]) | ((h == last[0]) & (F.col("id") > last[1])))
        asked = rest.select(h.alias("h"), "id", "v").orderBy("h", "id").limit(min(block, asked_most - asked_n)).collect()
        if not asked:
            break
        asked_n += len(asked)
        last = (asked[-1]["h"], asked[-1]["id"])
        shared = vectors.sparkSession.sparkContext.broadcast((np.array([r["id"] for r in asked]), unit(np.array([r["v"] for r in asked]))))

        def brute(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, q = shared.value
            total = np.zeros(len(names), np.int64)
            for b in batches:
                u, own = unit(matrix(b.column(1))), b.column(0).to_numpy()
                for k in range(0, len(u), 1024):
                    total += ((q @ u[k : k + 1024].T >= least) & (names[:, None] != own[None, k : k + 1024])).sum(1)
            some = total > 0
            yield pa.RecordBatch.from_arrays([pa.array(names[some]), pa.array(total[some])], ["id", "n"])

        true = vectors.select("id", "v").mapInArrow(brute, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
        row = true.join(counts.select("id", F.col("links").alias("m")), "id", "left").agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.least("n", F.coalesce("m", F.lit(0)))).alias("m")).first()
        linked, true_n, found_n = linked + row["k"], true_n + (row["n"] or 0), found_n + (row["m"] or 0)
        block *= 4
    if not true_n:
        return Audit(asked_n, 0, 0, 0, 1.0, 0.0, 1.0)
    r, z2 = found_n / true_n, 1.96**2
    half = 1.96 * sqrt(r * (1 - r) / linked + z2 / (4 * linked**2))
    return Audit(asked_n, linked, true_n, found_n, r, *(max(0.0, min(1.0, (r + z2 / (2 * linked) + x) / (1 + z2 / linked))) for x in (-half, half)))


def audit(vectors: DataFrame, counts: DataFrame, least: float, most: int = AUDIT) -> float:
    """The recall that ``audited`` measures."""
    return audited(vectors, counts, least, most).recall


def near_vectors(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.95, cell: int = 0, probes: int = 4, recall: float = RECALL) -> DataFrame:
    """One row for each row of embeddings: (id_col, n_links, component_id, kept).

    Rows link if their cosine is ``least`` or more. n_links counts other rows; component_id is
    the least id reachable by links, the row's own included; kept says whether it is the
    row's own. Equal vectors are searched for once and link with each other. A vector that
    is null, empty, zero, or holds a null or non-finite component links with nothing, and so
    does one whose length differs from the most common one's (of the least, on a tie).
    A row with a null id links and counts, and has a null component where it is alone.
    Rows that repeat an id are rows of their own. Other columns are not read.
    A link counts for both of its ends, whichever of them found it.
    The search looks in ``probes`` clusters; while the audit finds less than ``recall``, in
    four times as many, and at last in all. What the last audit found is logged, as a warning
    where its recall is under 0.9 or links were so few that it may be.
    """
    return searched(embeddings, id_col, vector_col, least, cell, probes, recall)[0]


def searched(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.95, cell: int = 0, probes: int = 4, recall: float = RECALL) -> tuple[DataFrame, float]:
    """What ``near_vectors`` returns, and the recall against brute force that the last audit measured (1 where there are no links)."""
    spark = embeddings.sparkSession
    ws = Workspace(spark, "graph")
    v = F.col("v")
    plain = embeddings.select(F.col(id_col).cast("long").alias("vec"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    plain = plain.withColumn("v", F.when(F.coalesce(fine, F.lit(False)), v))
    common = plain.filter("v IS NOT NULL").groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").first()
    size = common["size"] if common else 1
    plain = ws.save(plain.withColumn("v", F.when(F.size("v") == size, v)))
    # A name for each different vector: its hash. The vector itself is compared too.
    named = plain.filter("v IS NOT NULL").withColumn("id", F.xxhash64("v"))
    vectors = ws.save(named.groupBy("id", "v").agg(F.count("*").alias("copies"), F.min("vec").alias("first")))
    n = vectors.count()
    if not n:
        return plain.select(F.col("vec").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("vec").alias("component_id"), F.lit(True).alias("kept")), 1.0
    cell = cell or min(4096, max(256, n // 2000))
    sample = unit(np.stack(vectors.select("id", "v").orderBy("id").limit(SAMPLE).toPandas()["v"].to_list()))  # at most SAMPLE vectors
    clusters = Clusters(fit_centres(sample, min(CLUSTERS, max(1, n // cell), max(1, len(sample) // 4))))
    tasks = max(4 * partitions(spark), n // 20_000)
    bare = vectors.select("id", "v", "copies")
    while True:
        every = probes >= len(clusters.centres)
        dealt = ws.save(clusters.deal(bare.select("id", "v"), min(probes, len(clusters.centres)), 3.0 if every else REACH))
        near_to = dealt.select("id", "own", F.posexplode("looks").alias("rank", "c"))
        members = near_to.filter("rank < own").select("id", "c", "rank")
        # At most CLUSTERS rows. Up to four times as many may look in a shard as are its members.
        shards = ws.save(near_to.groupBy("c").agg(F.sum((F.col("rank") < F.col("own")).cast("int")).alias("held"), F.count("*").alias("all")).select("c", F.ceil(F.greatest("held", F.col("all") / 4, F.lit(1)) / cell).cast("int").alias("parts")))
        near = build(ws, bare, members, shards, tasks)
        got = find(ws, bare, dealt, shards, near, every, least, tasks)
        counts = ws.save(got.filter("n IS NOT NULL").groupBy("id").agg(F.sum("n").alias("n"), F.sum("links").alias("links")))
        seen = audited(bare, counts, least)
        reached = seen.recall
        weak = reached < 0.9 or (seen.low < 0.9 and n > seen.asked)
        logging.getLogger(__name__).log(logging.WARNING if weak and (every or reached >= recall) else logging.INFO, "%s with %d of %d clusters looked in", seen, min(probes, len(clusters.centres)), len(clusters.centres))
        if every or reached >= recall:
            break
        ws.drop(dealt, shards, near, got, counts)
        probes *= 4
    found = components(ws, got.filter("other IS NOT NULL").select("id", "other"))
    placed = ws.save(vectors.select("id", "v", "copies", "first").join(counts.select("id", "n"), "id", "left").join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id")))
    roots = ws.save(placed.groupBy("root").agg(F.min("first").alias("component_id")))
    by_vector = ws.save(placed.join(roots, "root").select("id", "v", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"))
    done = named.join(by_vector, ["id", "v"]).select("vec", "n_links", "component_id")
    done = done.unionByName(plain.filter("v IS NULL").select("vec", F.lit(0).cast("long").alias("n_links"), F.col("vec").alias("component_id")))
    return done.select(F.col("vec").alias(id_col), "n_links", "component_id", F.col("vec").eqNullSafe(F.col("component_id")).alias("kept")), reached
