"""Removal of word passages that stand twice in the corpus, by seeds and their extension.

Seeds are winnowed anchors of a few words; texts meet on them. A seed is extended both ways
to every window of the wanted length that it governs, so two texts that share a window share
a seed with the same extension, and maximal repeats are the unions of matched windows. The
extensions are compared by name and not pair by pair: a seed in a million texts costs a
million rows, not their square (``repeats``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import repeats
from quern.llm.common import Workspace

_RESULT = "_id long, _h long, n_removed long, kept_sha256 string"


def extend(ws: Workspace, texts: DataFrame, length: int) -> DataFrame:
    """Spans (key, lo, hi) of extended seeds whose run occurs once and whose words equal another's."""
    seeds = ws.save(repeats.rim_windows(texts, "words", length, [(0, length)]))
    shared = ws.save(seeds.groupBy("n0").agg(F.count("*").alias("n"), F.max("alone").alias("open")).filter("n > 1 AND open = 1").select("n0"))
    return seeds.filter("alone = 1").join(shared, "n0").select(*repeats.KEY, F.col("at").alias("lo"), (F.col("at") + length).alias("hi"))


def _kept(data: np.ndarray, lo: np.ndarray, hi: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple:
    mark = np.zeros(len(start) + 1, np.int32)
    np.add.at(mark, lo, 1)
    np.add.at(mark, hi, -1)
    stay = np.flatnonzero(np.cumsum(mark[:-1]) == 0)
    raw = data.tobytes()
    return int((hi - lo).sum()), hashlib.sha256(b" ".join(raw[a:b] for a, b in zip(start[stay].tolist(), end[stay].tolist(), strict=True))).hexdigest()


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        split = [(x or b"").split() for x in b.column(3).cast(pa.binary()).to_pylist()]
        sha = [hashlib.sha256(b" ".join(w)).hexdigest() for w in split]
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([len(w) for w in split], pa.int64()), pa.array(sha, pa.string())], ["_id", "_h", "id", "n_words", "whole"])


def remove_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 35, gram: int = 8) -> DataFrame:
    """One row for each row of docs: (id_col, n_words, n_removed, kept_sha256).

    Words are cut at ASCII white space and compared as they stand. Removed is every word
    that lies in a window of ``length`` words which starts at another place too. Null texts
    have no words; shorter texts lose nothing; a row that comes twice loses all of it, if
    it is long enough. Null ids stay null. Other columns are not read.
    """
    ws = Workspace(docs.sparkSession, "passages")
    texts, spans = repeats.repeated(ws, repeats.keyed(docs, id_col, text_col), "words", length, gram, lambda w, t: extend(w, t, length))
    cut = repeats.without(texts, spans, "words", _RESULT, _kept)
    base = docs.select(*repeats.row_key(id_col, text_col), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(_whole, "_id long, _h long, id long, n_words long, whole string")
    return base.join(cut, repeats.KEY, "left").select(F.col("id").alias(id_col), "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("kept_sha256", "whole").alias("kept_sha256"))
