"""Packing into optimal length buckets.

The lengths of all texts make one histogram. Dynamic programming over it picks the bucket
boundaries for which padding every text to its bucket's boundary costs least. Inside a
bucket texts form batches of at most ``budget`` tokens, padding included.

The histogram has a row for each length that occurs. Different lengths add up to no more
than all tokens do, so a corpus of T tokens has at most the root of 2 T of them: 4.5 million
for ten trillion tokens. Only the histogram goes to the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import Workspace

#: About as many texts take part in one numbering of batches. A bucket of any size is cut into such shares.
SHARE = 1000


def tokens(text: Column) -> Column:
    """Words and single marks: runs of letters, digits and underscores, and every other character that is not white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"(?U)\w+|[^\w\s]")).cast("long")


def boundaries(steps: np.ndarray, count: np.ndarray, total: np.ndarray, buckets: int) -> list[int]:
    """Ascending bucket boundaries, at most so many, of least padding.

    steps: ascending; count and total: texts of each step, and their tokens. The cheapest
    last cut never moves back as the last step grows, so each round of the programme halves
    the ranges that cuts are sought in: m log m steps a bucket.
    """
    m = len(steps)
    if not m:
        return []
    n, s = np.concatenate(([0], np.cumsum(count))), np.concatenate(([0], np.cumsum(total)))
    best = (steps * n[1:] - s[1:]).astype(np.float64)  # of texts up to step j in one bucket
    cuts = []
    for _ in range(min(buckets, m) - 1):
        now, frm = _cheapest_cuts(best, steps, n, s)
        worse = now >= best  # one bucket less does as well
        now[worse], frm[worse] = best[worse], -1
        cuts.append(frm)
        best = now
    out, j = [], m - 1
    for frm in reversed(cuts):
        if frm[j] > 0:
            out.append(int(steps[j]))
            j = int(frm[j]) - 1
    out.append(int(steps[j]))
    return out[::-1]


def _cheapest_cuts(best: np.ndarray, steps: np.ndarray, n: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each step j, the least cost of texts up to j with one bucket more, and the first step of that bucket (-1: none)."""
    m = len(steps)
    now, frm = np.full(m, np.inf), np.full(m, -1)
    lo, hi, first, last = np.array([1]), np.array([m]), np.array([1]), np.array([m - 1])  # steps [lo, hi), their cuts in [first, last]
    while len(lo):
        mid = (lo + hi) // 2
        stop = np.minimum(last, mid)
        wide = stop - first + 1
        row = np.repeat(np.arange(len(mid)), wide)
        at = np.cumsum(wide) - wide
        k = np.arange(len(row)) - at[row] + first[row]  # the bucket holds steps k .. mid
        j = mid[row]
        cost = best[k - 1] + steps[j] * (n[j + 1] - n[k]) - (s[j + 1] - s[k])
        least = np.minimum.reduceat(cost, at)
        hit = np.flatnonzero(cost == least[row])
        pick = k[hit[np.searchsorted(row[hit], np.arange(len(mid)))]]
        now[mid], frm[mid] = least, pick
        lo, hi, first, last = np.concatenate([lo, mid + 1]), np.concatenate([mid, hi]), np.concatenate([first, pick]), np.concatenate([pick, last])
        some = hi > lo
        lo, hi, first, last = lo[some], hi[some], first[some], last[some]
    return now, frm


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = 16, budget: int = 8192, length: Column | None = None) -> DataFrame:
    """One row for each row of docs: (id_col, n_tokens, bucket, boundary, batch, slot, padding).

    bucket counts from 0; boundary is the length its texts are padded to. A batch is named
    "bucket-share-number" and holds up to budget // boundary texts, or one where a text is
    longer than the budget; no text is cut. Every share but for its last batch is full.
    Null texts have no tokens; empty texts count as one token of padding at least. Null
    ids and repeated rows are packed like others, spread over all shares of their bucket. Other columns are not read. An empty
    table gives an empty result.
    """
    ws = Workspace(docs.sparkSession, "packing")
    # spread tells rows apart whatever their ids and texts, so that no id or copy fills a share. It is saved, and so the same for every later task.
    sized = ws.save(docs.select(F.col(id_col).alias("id"), (tokens(F.col(text_col)) if length is None else F.coalesce(length, F.lit(0)).cast("long")).alias("n_tokens"), F.xxhash64(F.monotonically_increasing_id()).alias("spread")))
    steps = sized.groupBy(F.greatest("n_tokens", F.lit(1)).alias("step")).agg(F.count("*").alias("n"), F.sum("n_tokens").alias("s"))
    hist = steps.toPandas().sort_values("step")  # as many rows as there are lengths
    step, count = hist["step"].to_numpy(np.int64), hist["n"].to_numpy(np.int64)
    ends = boundaries(step, count, hist["s"].to_numpy(np.int64), buckets)
    inside = np.searchsorted(np.array(ends, np.int64), step)
    held = np.bincount(inside, count, len(ends)).astype(np.int64) if len(ends) else np.zeros(0, np.int64)
    room = [max(1, budget // b) for b in ends]
    # Shares are whole batches wide, so that few are left part full.
    shares = [max(1, int(h // max(r, SHARE // r * r))) for h, r in zip(held, room, strict=True)]

    def by_bucket(values: list[int]) -> Column:
        return F.element_at(F.array(*[F.lit(v).cast("long") for v in values or [1]]), (F.col("bucket") + 1).cast("int"))

    # How many boundaries lie below the length.
    placed = sized.withColumn("bucket", sum([(F.col("n_tokens") > b).cast("int") for b in ends[:-1]], F.lit(0)).cast("int"))
    placed = placed.withColumn("share", F.pmod(F.col("spread"), by_bucket(shares)).cast("int"))
    # About SHARE rows in each window, whatever the bucket holds.
    rank = F.expr("row_number() OVER (PARTITION BY bucket, share ORDER BY spread, id, n_tokens)") - 1
    return (
        placed.withColumn("rank", rank)
        .withColumn("boundary", by_bucket(ends))
        .withColumn("room", by_bucket(room))
        .select(
            F.col("id").alias(id_col), "n_tokens", "bucket", "boundary",
            F.concat_ws("-", "bucket", "share", F.floor(F.col("rank") / F.col("room"))).alias("batch"),
            (F.col("rank") % F.col("room")).cast("int").alias("slot"), (F.col("boundary") - F.col("n_tokens")).alias("padding"),
        )
    )
