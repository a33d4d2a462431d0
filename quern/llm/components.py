"""Connected components of a link table, by alternating large-star and small-star steps.

Every step is a grouped minimum (combined before its shuffle) and an equi-join that adaptive
execution can split, so a hub of any degree is spread over tasks; nothing goes to the driver
but a row count and a checksum. A table of WHOLE links or fewer, counted first, is joined up in
one task instead: the rounds' many small jobs would cost more than their rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import Workspace

#: So many links (two longs each, 16 MB) are joined up in one task; more of them go through the rounds. The rows are the same.
WHOLE = 1_000_000


def merge(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union-find over arrays: joins the sets of a[i] and b[i]."""
    while len(a):
        a, b = parent[a], parent[b]
        keep = a != b
        a, b = a[keep], b[keep]
        if not len(a):
            break
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent[:] = up


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All links of a small table: each node and the least one of its component."""
    got = list(batches)
    if not got:
        return
    hi, lo = (np.concatenate([b.column(k).to_numpy(zero_copy_only=False) for b in got]) for k in (0, 1))
    nodes, at = np.unique(np.concatenate([hi, lo]), return_inverse=True)
    parent = np.arange(len(nodes))
    merge(parent, at[: len(hi)], at[len(hi) :])  # nodes ascend, so the least place is the least node
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[parent])], ["node", "root"])



def _star(ws: Workspace, links: DataFrame, rows: int, large: bool) -> DataFrame:
    """links: (hi, lo), hi > lo, so many rows. Returns links of the same components, nearer to stars."""
    if large:
        both = links.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(links.select("lo", "hi"))
    else:
        both = links.select(F.col("hi").alias("u"), F.col("lo").alias("v"))
    # Saved, so that the join below has a plain exchange on either side and hubs can be split.
    least = ws.save(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), rows)
    joined = both.join(least, "u")
    if large:
        out = joined.filter("v > u AND v <> m").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
    else:
        out = joined.filter("v <> m").select(F.col("v").alias("hi"), F.col("m").alias("lo")).union(least.filter("u <> m").select("u", "m"))
    out = ws.save(out.distinct(), rows)
    ws.drop(least)
    return out


def _sign(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())


def components(ws: Workspace, links: DataFrame, whole: int = WHOLE) -> DataFrame:
    """(node, root) for each node that has a link: root is the least node of its component.

    links: two long columns, in either order, repeats and loops allowed. A table without
    links gives an empty table. ``whole``: different links that one task may join up. What is
    returned is worked out at each use; save it to use it twice.
    """
    a, b = (F.col(c) for c in links.columns[:2])
    now = ws.save(links.filter(a != b).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct())
    sign = _sign(now)
    if sign[0] <= whole:
        return now.coalesce(1).mapInArrow(_joined, "node long, root long")
    while sign[0]:
        large = _star(ws, now, sign[0], True)
        small = _star(ws, large, sign[0], False)
        ws.drop(now, large)
        now, was, sign = small, sign, _sign(small)
        if sign == was:
            break
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(now.select("lo", "lo").distinct())
