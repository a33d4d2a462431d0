"""Removal of byte strings that stand twice in the corpus, by prefix doubling over sampled suffixes.

A suffix array finds strings that repeat by ranking every suffix by its first 1, 2, 4, ...
bytes. Here Spark does the ranking: a round takes (position, rank of its first n bytes,
rank of the n bytes after them), groups the pairs to get the rank of the first 2 n bytes,
and drops every position whose rank is unique, until the length looked for is reached.
Ranks are names (hashes) and not ordinals, because only equality counts here and ordinals
would need one global order.

Ranking all positions would move every byte of the corpus many times over, so rounds start
on samples of the suffixes and reach single ones last:

1. Winnowed suffixes, about one in 150, by ``gram`` bytes (``repeats``). Strings that repeat
   have anchors that repeat; runs of suffixes that are equal as a whole are settled by a count.
2. In the rims that remain, one of every ``block`` neighbouring suffixes, by the bytes they
   share. A block whose shared bytes are unique holds no repeat; one that is equal to
   another as a whole is all repeats.
3. The suffixes in the blocks left over, by doubling: 64, 128, 256 or 100, 200, 400 bytes.

The whole goes twice: by 256 bytes, then by 400 for the texts that have repeats of 256.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import repeats
from quern.llm.common import Workspace

_RESULT = "_id long, _h long, n_removed long, n_spans long, kept_sha256 string"


def steps_of(length: int, first: int) -> list[tuple[int, int]]:
    """(from, size) of the block that each round adds: 0-100, 100-200, 200-400 for 100 and 400."""
    out, have = [(0, min(first, length))], min(first, length)
    while have < length:
        out.append((have, min(have, length - have)))
        have += out[-1][1]
    return out


def double(ws: Workspace, suffixes: DataFrame, rounds: int) -> DataFrame:
    """(key, at) of suffixes whose run occurs once and whose first bytes equal another's. n0 ... are the ranks of their blocks."""
    ranked = suffixes.withColumn("rank", F.col("n0"))
    for k in range(rounds):
        if k:
            ranked = ranked.withColumn("rank", F.xxhash64("rank", f"n{k}"))
        now = ws.save(ranked.drop(f"n{k}"))
        # A rank whose suffixes all belong to runs that are settled needs no further look either.
        shared = ws.save(now.groupBy("rank").agg(F.count("*").alias("n"), F.max("alone").alias("open")).filter("n > 1 AND open = 1").select("rank"))
        ranked = now.join(shared, "rank")
    return ranked.filter("alone = 1").select(*repeats.KEY, "at")


def match(ws: Workspace, texts: DataFrame, length: int, first: int, block: int) -> DataFrame:
    """Spans (key, lo, hi) of the suffixes in rims whose first bytes equal another's."""
    blocks = ws.save(repeats.rim_blocks(texts, "bytes", length, block).withColumn("hull", F.coalesce("hull", F.xxhash64(*repeats.KEY, "at"))))
    hulls = ws.save(blocks.groupBy("core", "hull").agg(F.count("*").alias("n"), F.max("alone").alias("alone"), F.min(F.struct(*repeats.KEY, "at", "last")).alias("one")))
    cores = ws.save(hulls.groupBy("core").agg(F.count("*").alias("hulls"), F.max(F.when(F.col("n") == 1, F.col("alone")).otherwise(0)).alias("open")).filter("hulls > 1 AND open = 1").select("core"))
    left = hulls.join(cores, "core").select("one.*", F.when(F.col("n") == 1, F.col("alone")).otherwise(0).alias("alone"))
    left = ws.save(left.groupBy(*repeats.KEY).agg(F.collect_list(F.struct("at", "last", "alone")).alias("rims")))
    suffixes = repeats.rim_windows(texts.select(*repeats.KEY, "text").join(left, repeats.KEY), "bytes", length, steps_of(length, first))
    single = double(ws, suffixes, len(steps_of(length, first))).select(*repeats.KEY, F.col("at").alias("lo"), (F.col("at") + length).alias("hi"))
    twice = ws.save(hulls.filter("n > 1 AND alone = 1").select("core", "hull"))
    whole = blocks.filter("alone = 1").join(twice, ["core", "hull"]).select(*repeats.KEY, F.col("at").alias("lo"), (F.col("last") + length).alias("hi"))
    return whole.union(single)


def _kept(data: np.ndarray, lo: np.ndarray, hi: np.ndarray, _start: np.ndarray, _end: np.ndarray) -> tuple:
    mark = np.zeros(len(data) + 1, np.int32)
    np.add.at(mark, lo, 1)
    np.add.at(mark, hi, -1)
    return int((hi - lo).sum()), len(lo), hashlib.sha256(data[np.cumsum(mark[:-1]) == 0].tobytes()).hexdigest()


def covered_bytes(spans: DataFrame) -> DataFrame:
    """(key, n_repeated): how many bytes the spans of each text cover together."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    step = lambda a, s: F.struct(F.greatest(a["end"], s["hi"]).alias("end"), (a["n"] + F.greatest(F.lit(0), s["hi"] - F.greatest(a["end"], s["lo"]))).alias("n"))
    return repeats.covered(spans).select(*repeats.KEY, F.aggregate("spans", start, step)["n"].alias("n_repeated"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, gram: int = 100, block: int = 16, report: int = 256) -> DataFrame:
    """One row for each row of docs: (id_col, n_bytes, n_removed, n_spans, kept_sha256, n_repeated).

    Removed is every byte that lies in a string of ``length`` bytes which starts at another
    place too, in the same text or elsewhere, overlapping or not. Null texts are empty;
    texts shorter than length lose nothing; a row that comes twice loses all of it, if it
    is long enough. Null ids stay null. Other columns are not read. n_repeated counts the
    bytes in strings of ``report`` bytes that start at two places: repeats that are worth
    knowing and too short to go. Only texts that have any are looked at for longer ones.
    """
    ws = Workspace(docs.sparkSession, "suffixes")
    report = min(report, length)
    match_at = lambda n, first: lambda w, t: match(w, t, n, min(first, n), min(block, n))
    small = min(gram, 64)
    near, short = repeats.repeated(ws, repeats.keyed(docs, id_col, text_col), "bytes", report, small, match_at(report, small))
    repeated = ws.save(covered_bytes(short))
    texts, spans = repeats.repeated(ws, near, "bytes", length, gram, match_at(length, gram)) if report < length else (near, short)
    cut = repeats.without(texts, spans, "bytes", _RESULT, _kept)
    base = docs.select(*repeats.row_key(id_col, text_col), F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = base.select(*repeats.KEY, id_col, F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("whole"))
    return base.join(cut, repeats.KEY, "left").join(repeated, repeats.KEY, "left").select(
        id_col, "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.coalesce("kept_sha256", "whole").alias("kept_sha256"),
        F.coalesce("n_repeated", F.lit(0)).alias("n_repeated"),
    )
